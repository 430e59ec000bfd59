"""DuckDB SQL of the queries that SQL can express: those whose result needs neither a trained model nor hashes of our own."""

from . import line_dedup, lloyd_codes, quality_lines, warc_archive

GAP = "[ \\t\\n\\x0b\\f\\r]+"
WORD = "[^ \\t\\n\\x0b\\f\\r]"
HOST = "coalesce('=' || source, 'null')"


def normal(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '{GAP}', ' ', 'g'), ' '))"


def frequent(share: float, small: float) -> str:
    """CTEs rows(host, text, doc row), lines and frequent(host, line), over distinct texts."""
    return f"""rows AS MATERIALIZED (SELECT row_number() OVER () AS k, *, {HOST} AS host FROM documents),
pages AS MATERIALIZED (SELECT DISTINCT host, text FROM rows WHERE text IS NOT NULL),
plines AS MATERIALIZED (SELECT host, text, {normal('l')} AS line, length(l) AS n FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS l FROM pages) WHERE regexp_matches(l, '{WORD}')),
frequent AS MATERIALIZED (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS c FROM plines GROUP BY ALL) JOIN (SELECT host, count(*) AS h FROM pages GROUP BY host) USING (host) WHERE c > greatest({share}e0, {small}e0 / sqrt(h)) * h)"""


OP3 = f"""WITH {frequent(line_dedup.MAX_RATIO, line_dedup.SMALL_HOST)},
w AS MATERIALIZED (SELECT *, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words FROM rows),
win AS MATERIALIZED (SELECT k, i, list_slice(words, i, i + 7) AS s FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT k, i FROM win JOIN (SELECT k, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (k, s)),
cover AS (SELECT k, count(DISTINCT i + j) AS c FROM again, range(0, 8) t(j) GROUP BY k),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS c FROM (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM rows) WHERE regexp_matches(l, '{WORD}') GROUP BY k),
lost AS (SELECT host, text, sum(CASE WHEN f.line IS NOT NULL THEN n END) / CAST(sum(n) AS DOUBLE) AS lost FROM plines p LEFT JOIN frequent f USING (host, line) GROUP BY ALL),
figures AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(w.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.c, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.c, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0e0) AS lost_share FROM w LEFT JOIN cover USING (k) LEFT JOIN dup USING (k) LEFT JOIN lost ON lost.host = w.host AND lost.text = w.text)
SELECT *, NOT base_failed AND 1 - lost_share >= {quality_lines.LEAST_KEPT} AS kept FROM (SELECT *, n_words < {quality_lines.LEAST_WORDS} OR 100 * n_repeat_words > {quality_lines.MOST_REPEATED} * n_words AS base_failed FROM figures)"""

OP8 = f"""WITH {frequent(line_dedup.MAX_RATIO, line_dedup.SMALL_HOST)},
each AS (SELECT k, i, l, f.line IS NOT NULL AS bad FROM (SELECT k, host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows WHERE text IS NOT NULL) x LEFT JOIN frequent f ON f.host = x.host AND f.line = {normal('l')} AND regexp_matches(l, '{WORD}')),
clean AS (SELECT k, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad), '') AS t, count_if(bad) AS gone FROM each GROUP BY k)
SELECT doc_id, t AS text, lang, source, CAST(length(t) AS BIGINT) AS n_chars, CAST(coalesce(gone, 0) AS BIGINT) AS n_lines_removed FROM rows LEFT JOIN clean USING (k)"""

OP11 = f"""WITH p AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= {warc_archive.LEAST_REVISIT} GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT p.*, first, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM p LEFT JOIN m ON m.h = p.h) p"""


def lloyd_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Rounds one after another; every round's sums are taken anew from all rows."""
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS k, vec_id, label, x FROM (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0))",
        f"c AS MATERIALIZED (SELECT k, p, i, x[p * w + i + 1] AS x FROM (SELECT k, x, len(x) // {parts} AS w, unnest(range({parts})) AS p FROM v), LATERAL (SELECT unnest(range(w)) AS i))",
        f"b0 AS MATERIALIZED (SELECT p, k - 1 AS e, i, x AS y FROM c WHERE k <= {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT k, p, min(struct_pack(d := d, e := e)) AS n FROM (SELECT k, c.p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM c JOIN b{r} b ON b.p = c.p AND b.i = c.i GROUP BY ALL) GROUP BY ALL)")
        if r < rounds:
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN (SELECT c.p, a.n.e AS e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM c JOIN a{r} a USING (k, p) GROUP BY ALL) m USING (p, e, i))")
    return (
        "WITH " + ",\n".join(ctes) + f""",
o AS (SELECT k, string_agg(lpad(printf('%x', n.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM a{rounds} GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256 FROM o JOIN v USING (k)"""
    )


OP12 = lloyd_sql(lloyd_codes.PARTS, lloyd_codes.ENTRIES, lloyd_codes.ROUNDS, lloyd_codes.SCALE)

# CRC-32 of an id's decimal digits, bit by bit; nodes are whole prefixes, and members' leaves and savings are summed over pairs
CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, z: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)))"
OP13 = f"""WITH t AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS nth FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, nth) AS depth, role, text FROM (SELECT c.conv_id, 0 AS own, nth, role, text FROM c JOIN t ON t.conv_id = base AND nth <= h UNION ALL SELECT c.conv_id, 1, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND nth > h)),
pre AS MATERIALIZED (SELECT conv_id, depth, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS seq, length(text) AS chars FROM r UNION ALL SELECT conv_id, 0, [], 0 FROM c),
deep AS (SELECT conv_id, max(depth) AS deepest FROM pre GROUP BY 1),
node AS MATERIALIZED (SELECT depth, seq, min(conv_id) AS id, count(*) AS n, max(deepest) = depth AS leaf, (count(*) - 1) * any_value(chars) AS saves, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (deepest = depth), '') AS ends FROM pre JOIN deep USING (conv_id) GROUP BY depth, seq),
sums AS (SELECT a.depth, a.seq, count_if(b.leaf) AS leaves, sum(b.saves) AS saved FROM node a JOIN node b ON b.depth >= a.depth AND b.seq[:a.depth] = a.seq GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, seq[:depth - 1] AS seq, count(*) AS k FROM node WHERE depth > 0 GROUP BY ALL)
SELECT n.id AS conv_id, n.depth, u.id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN sums s ON s.depth = n.depth AND s.seq = n.seq LEFT JOIN kids ON kids.depth = n.depth AND kids.seq = n.seq LEFT JOIN node u ON u.depth = n.depth - 1 AND u.seq = n.seq[:n.depth - 1]"""

ORACLES: dict[str, str] = {"op3_quality_lines": OP3, "op8_frequent_lines": OP8, "op11_web_archive": OP11, "op12_vector_codes": OP12, "op13_prefix_trie": OP13}
