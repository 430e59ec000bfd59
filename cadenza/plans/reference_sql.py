"""DuckDB text that checks the registered queries, written on its own: nothing here reads the operators' expressions.

Where the operators use window frames over rows, this text joins each row to the calendar rows before it (`past_...`), and
where they use lags it joins the one row meant. Rules are rows of a table here, expressions there.
"""

from __future__ import annotations

MARKETS = ("sh000001", "sz399001")
CENTS = "CAST({} AS DECIMAL(18,2))"
P, S, D = (CENTS.format(c) for c in ("l_extendedprice", "l_quantity", "l_discount"))
BARS = f"""min_by(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 CAST(sum({P} * {S}) AS DOUBLE) / CAST(sum({S}) AS DOUBLE) AS close, CAST(sum({S}) AS DOUBLE) AS volume_shares, CAST(sum({P} * {S}) AS DOUBLE) AS amount_yuan,
 CAST(sum({D} * {S}) AS DOUBLE) / CAST(sum({S}) AS DOUBLE) AS turnover"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cal": ((), "SELECT row_number() OVER (ORDER BY d) - 1 AS cal_idx, d FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem WHERE l_shipdate IS NOT NULL)"),
    "ent": (("cal",), "SELECT stock_id, number, CAST((SELECT min(d) FROM cal) + CAST((number % 5) * 28 AS INTEGER) AS DATE) AS list_date FROM (SELECT DISTINCT p_brand AS stock_id, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS number FROM part)"),
    "bars": ((), f"SELECT p_brand AS stock_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, {BARS} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"),
    "kept": (("bars", "cal", "ent"), "SELECT b.* FROM bars b JOIN cal USING (d) JOIN ent USING (stock_id) WHERE (number * 7 + cal_idx * 3) % 97 <> 0"),
    "dense": (("cal", "ent", "kept"), "SELECT e.stock_id, e.list_date, c.cal_idx, c.d, CASE WHEN c.d < e.list_date THEN -1 WHEN k.close IS NOT NULL THEN 1 ELSE 0 END AS state, "
              + ", ".join(f"CASE WHEN c.d >= e.list_date THEN k.{x} END AS {x}" for x in ("open", "high", "low", "close", "volume_shares", "amount_yuan", "turnover")) + " FROM ent e CROSS JOIN cal c LEFT JOIN kept k ON k.stock_id = e.stock_id AND k.d = c.d"),
    # the traded row before each traded row, by the greatest earlier index
    "panel": (("dense",), """SELECT a.*, CASE WHEN a.state = 1 THEN coalesce(a.close / b.close - 1, 0e0) END AS r
 FROM dense a LEFT JOIN (SELECT x.stock_id, x.cal_idx, max(y.cal_idx) AS before FROM dense x JOIN dense y ON x.stock_id = y.stock_id AND y.cal_idx < x.cal_idx AND y.state = 1 GROUP BY 1, 2) p ON p.stock_id = a.stock_id AND p.cal_idx = a.cal_idx
 LEFT JOIN dense b ON b.stock_id = p.stock_id AND b.cal_idx = p.before"""),
    # the level is the product of all returns after the first traded row
    "quoted": (("panel",), """SELECT a.*, CASE WHEN a.state = 1 THEN 100 * coalesce(x.growth, 1e0) END AS q FROM panel a LEFT JOIN
 (SELECT a.stock_id, a.cal_idx, product(1 + b.r) AS growth FROM panel a JOIN panel b ON b.stock_id = a.stock_id AND b.cal_idx <= a.cal_idx AND b.state = 1 JOIN (SELECT stock_id, min(cal_idx) AS first FROM panel WHERE state = 1 GROUP BY 1) f ON f.stock_id = b.stock_id AND b.cal_idx > f.first GROUP BY 1, 2) x
 ON x.stock_id = a.stock_id AND x.cal_idx = a.cal_idx"""),
    "markets": (("cal",), f"SELECT s.symbol, c.cal_idx, m.close FROM cal c CROSS JOIN (SELECT unnest(['sh000001', 'sz399001']) AS symbol) s LEFT JOIN (SELECT CASE l_linestatus WHEN 'F' THEN 'sh000001' ELSE 'sz399001' END AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, CAST(sum({P} * {S}) AS DOUBLE) / CAST(sum({S}) AS DOUBLE) AS close FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_shipdate IS NOT NULL GROUP BY 1, 2) m ON m.symbol = s.symbol AND m.d = c.d"),
    "mret": (("markets",), "SELECT a.symbol, a.cal_idx, CASE WHEN b.close > 0 THEN a.close / b.close - 1 END AS ret FROM markets a LEFT JOIN markets b ON b.symbol = a.symbol AND b.cal_idx = a.cal_idx - 1"),
    "mstat": (("mret",), "SELECT a.symbol, a.cal_idx, k, CASE WHEN a.cal_idx + 1 >= k THEN avg(b.ret) END AS m, CASE WHEN a.cal_idx + 1 >= k AND count(b.ret) >= 2 THEN stddev_pop(b.ret) END AS s FROM mret a CROSS JOIN (SELECT unnest([5, 20]) AS k) JOIN mret b ON b.symbol = a.symbol AND b.cal_idx BETWEEN a.cal_idx - k + 1 AND a.cal_idx GROUP BY 1, 2, 3"),
    "targets": (("panel",), "SELECT a.*, b.cal_idx AS target_idx, CASE WHEN b.state IS NULL THEN 3 WHEN b.state = 1 THEN 1 WHEN b.state = 0 THEN 2 ELSE 4 END AS target_status, CASE WHEN b.state = 1 THEN b.cal_idx END AS label_available_idx, CASE WHEN b.state = 1 THEN b.r END AS y FROM panel a LEFT JOIN panel b ON b.stock_id = a.stock_id AND b.cal_idx = a.cal_idx + 1"),
    "samples": (("targets",), "SELECT *, state = 1 AS prediction_eligible, dense_rank() OVER (ORDER BY stock_id) - 1 AS stock_idx, row_number() OVER (ORDER BY stock_id, cal_idx) - 1 AS row_id FROM targets WHERE state >= 0"),
}

_PAST = "count(*) AS rows_, count(b.r) AS n_r, avg(b.r) AS avg_r, stddev_pop(b.r) AS std_r, avg(b.volume_shares) AS avg_volume_shares, avg(b.amount_yuan) AS avg_amount_yuan, avg(b.turnover) AS avg_turnover, count(b.q) AS n_q, avg(b.q) AS avg_q, max(b.q) AS max_q, min(b.q) AS min_q, count_if(b.state = 0) AS paused, count_if(b.state = 1) AS traded"


def past(k: int, last: int = 0) -> str:
    """The name of the frame of statistics over the k calendar rows that end `last` rows before each."""
    name = f"past_{k}_{last}"
    CTES[name] = (("quoted",), f"SELECT a.stock_id, a.cal_idx, {_PAST} FROM quoted a JOIN quoted b ON b.stock_id = a.stock_id AND b.cal_idx BETWEEN a.cal_idx - {k - 1 + last} AND a.cal_idx - {last} GROUP BY 1, 2")
    return name


#: What a feature reads: frames of past rows as p<k>_<last>, rows k before as l<k>, the market's by symbol and window.
FEATURE_SQL: dict[str, str] = {f"return_lag_{k}": f"l{k}.r" if k else "a.r" for k in (0, 1, 2, 5, 10, 20, 60)}
for _k in (5, 10, 20, 60):
    FEATURE_SQL[f"return_mean_{_k}"] = f"CASE WHEN p{_k}_0.rows_ = {_k} THEN p{_k}_0.avg_r END"
    FEATURE_SQL[f"return_std_{_k}"] = f"CASE WHEN p{_k}_0.rows_ = {_k} AND p{_k}_0.n_r >= 2 THEN p{_k}_0.std_r END"
    FEATURE_SQL[f"return_valid_fraction_{_k}"] = f"CASE WHEN p{_k}_0.rows_ = {_k} THEN p{_k}_0.n_r / {_k}e0 END"
FEATURE_SQL |= {
    "candle_body": "CASE WHEN a.open > 0 THEN a.close / a.open - 1 END",
    "high_low_range": "CASE WHEN a.low > 0 THEN a.high / a.low - 1 END",
    "close_position": "CASE WHEN a.high > a.low THEN (a.close - a.low) / (a.high - a.low) END",
    "upper_shadow": "CASE WHEN a.close > 0 THEN (a.high - greatest(a.open, a.close)) / a.close END",
    "lower_shadow": "CASE WHEN a.close > 0 THEN (least(a.open, a.close) - a.low) / a.close END",
    **{f"{x}_relative_{k}": f"CASE WHEN p{k}_1.rows_ = {k} AND p{k}_1.avg_{x} > 0 THEN a.{x} / p{k}_1.avg_{x} - 1 END" for x in ("volume_shares", "amount_yuan") for k in (5, 20)},
    "turnover": "a.turnover",
    "turnover_change_1": "a.turnover - l1.turnover",
    "turnover_relative_20": "CASE WHEN p20_1.rows_ = 20 AND p20_1.avg_turnover > 0 THEN a.turnover / p20_1.avg_turnover - 1 END",
    **{f"{s}_{n}": x for i, s in enumerate(MARKETS) for n, x in {"return_0": f"m{i}.ret", "return_mean_5": f"m{i}_5.m", "return_mean_20": f"m{i}_20.m", "return_std_5": f"m{i}_5.s", "return_std_20": f"m{i}_20.s"}.items()},
    "listing_age_days": "CASE WHEN a.state >= 0 THEN CAST(a.d - a.list_date AS DOUBLE) END",
    "suspended_days_20": "CASE WHEN p20_0.rows_ = 20 THEN CAST(p20_0.paused AS DOUBLE) END",
    "days_since_previous_trade": "CAST(a.cal_idx - t.before AS DOUBLE)",
    **{f"quote_index_ma_deviation_{k}": f"CASE WHEN p{k}_0.n_q = {k} AND p{k}_0.avg_q > 0 THEN a.q / p{k}_0.avg_q - 1 END" for k in (20, 60)},
    "quote_index_ma_change_20_5": "CASE WHEN p20_0.n_q = 20 AND p20_5.n_q = 20 AND p20_5.avg_q > 0 THEN p20_0.avg_q / p20_5.avg_q - 1 END",
    "quote_index_prior_high_distance_20": "CASE WHEN p20_1.n_q = 20 AND p20_1.max_q > 0 THEN a.q / p20_1.max_q - 1 END",
    "quote_index_prior_low_distance_20": "CASE WHEN p20_1.n_q = 20 AND p20_1.min_q > 0 THEN a.q / p20_1.min_q - 1 END",
}


def _join(alias: str, frame: str, on: str) -> str:
    return f" LEFT JOIN {frame} {alias} ON {on}"


def _features() -> None:
    spans = [(k, 0) for k in (5, 10, 20, 60)] + [(5, 1), (20, 1), (20, 5)]
    frames = {f"p{k}_{last}": past(k, last) for k, last in spans}
    same = lambda x, at="a.cal_idx": f"{x}.stock_id = a.stock_id AND {x}.cal_idx = {at}"
    joins = "".join(_join(alias, frame, same(alias)) for alias, frame in frames.items())
    joins += "".join(_join(f"l{k}", "quoted", same(f"l{k}", f"a.cal_idx - {k}")) for k in (1, 2, 5, 10, 20, 60))
    joins += _join("t", "last_trade", same("t"))
    for i, s in enumerate(MARKETS):
        joins += _join(f"m{i}", "mret", f"m{i}.symbol = '{s}' AND m{i}.cal_idx = a.cal_idx")
        joins += "".join(_join(f"m{i}_{k}", "mstat", f"m{i}_{k}.symbol = '{s}' AND m{i}_{k}.cal_idx = a.cal_idx AND m{i}_{k}.k = {k}") for k in (5, 20))
    CTES["last_trade"] = (("quoted",), "SELECT a.stock_id, a.cal_idx, max(b.cal_idx) AS before FROM quoted a JOIN quoted b ON b.stock_id = a.stock_id AND b.cal_idx < a.cal_idx AND b.state = 1 GROUP BY 1, 2")
    CTES["feats"] = (("quoted", "mret", "mstat", "last_trade", *frames.values()), "SELECT a.stock_id, a.cal_idx, a.d, a.state, " + ", ".join(f"CAST({x} AS FLOAT) AS {n}" for n, x in FEATURE_SQL.items()) + f" FROM quoted a{joins}")


def _indicators() -> None:
    frames = {f"w{k}": past(k, 1) for k in (20, 40, 60, 120, 250)} | {f"n{k // 2}": past(k // 2, 1) for k in (20, 60)} | {f"o{k // 2}": past(k // 2, k // 2 + 1) for k in (20, 40, 60)}
    frames["n20"] = past(20, 1)
    out: dict[str, str] = {}
    for k in (20, 40, 60):
        full = f"w{k}.n_q = {k}"
        out[f"prior_width_{k}"] = f"CASE WHEN {full} THEN w{k}.max_q / w{k}.min_q - 1 END"
        out[f"prior_drift_{k}"] = f"CASE WHEN {full} THEN l1.q / l{k}.q - 1 END"
        out[f"breakout_{k}"] = f"CASE WHEN {full} THEN a.q / w{k}.max_q - 1 END"
        h = k // 2
        out[f"channel_higher_{k}"] = f"CASE WHEN {full} THEN CAST(n{h}.max_q > o{h}.max_q AND n{h}.min_q > o{h}.min_q AS DOUBLE) END"
    for k in (60, 120, 250):
        full = f"w{k}.n_q = {k}"
        out[f"bottom_position_{k}"] = f"CASE WHEN {full} AND w{k}.max_q > w{k}.min_q THEN (l1.q - w{k}.min_q) / (w{k}.max_q - w{k}.min_q) END"
        out[f"prior_drawdown_{k}"] = f"CASE WHEN {full} THEN l1.q / w{k}.max_q - 1 END"
        out[f"bottom_low_distance_{k}"] = f"CASE WHEN {full} THEN l1.q / w{k}.min_q - 1 END"
    out["volume_history_complete"] = "CASE WHEN w20.traded = 20 THEN 1 ELSE 0 END"
    out["volume_ratio_20"] = "CASE WHEN w20.rows_ = 20 AND w20.avg_volume_shares > 0 THEN a.volume_shares / w20.avg_volume_shares END"
    same = lambda x, at="a.cal_idx": f"{x}.stock_id = a.stock_id AND {x}.cal_idx = {at}"
    joins = "".join(_join(alias, frame, same(alias)) for alias, frame in frames.items()) + "".join(_join(f"l{k}", "quoted", same(f"l{k}", f"a.cal_idx - {k}")) for k in (1, 20, 40, 60))
    CTES["plain_ind"] = (("quoted", *frames.values()), "SELECT a.*, " + ", ".join(f"{x} AS {n}" for n, x in out.items()) + f" FROM quoted a{joins}")
    name = "plain_ind"
    for k in (20, 40, 60):
        w = f"OVER (PARTITION BY stock_id ORDER BY cal_idx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        m, s2 = (k - 1) / 2, k * (k * k - 1) / 12
        CTES[f"logs_{k}"] = ((name,), f"SELECT *, CASE WHEN count(q) {w} = {k} THEN list(ln(q)) {w} END AS v{k} FROM {name}")
        CTES[f"mid_{k}"] = ((f"logs_{k}",), f"SELECT *, list_sum(v{k}) / {k} AS m{k} FROM logs_{k}")
        CTES[f"slope_{k}"] = ((f"mid_{k}",), f"SELECT *, list_transform(v{k}, lambda x: x - m{k}) AS c{k}, list_sum(list_transform(v{k}, lambda x, i: (x - m{k}) * (i - 1 - {m}))) / {s2} AS s{k} FROM mid_{k}")
        CTES[f"res_{k}"] = ((f"slope_{k}",), f"SELECT *, list_transform(c{k}, lambda x, i: x - s{k} * (i - 1 - {m})) AS e{k} FROM slope_{k}")
        CTES[f"chan_{k}"] = ((f"res_{k}",), f"""SELECT *, exp(s{k} * {k - 1}) - 1 AS channel_gain_{k},
 CASE WHEN list_max(v{k}) > list_min(v{k}) THEN greatest(0e0, least(1e0, 1 - list_sum(list_transform(e{k}, lambda x: x * x)) / list_sum(list_transform(c{k}, lambda x: x * x)))) END AS channel_r2_{k},
 exp(list_max(e{k}) - list_min(e{k})) - 1 AS channel_width_{k}, sqrt(list_sum(list_transform(e{k}, lambda x: x * x)) / {k}) AS channel_sigma_{k}, ln(q) - (m{k} + s{k} * {k - m}) AS channel_offset_{k} FROM res_{k}""")
        name = f"chan_{k}"
    CTES["inds"] = ((name,), f"SELECT * FROM {name}")


_features()
_indicators()

#: The ten events of an outcome.
EVENTS = {
    "up": "y > 0", "down": "y < 0", "up_ge_1": "y >= 0.01e0", "down_ge_1": "y <= -0.01e0", "up_ge_2": "y >= 0.02e0", "down_ge_2": "y <= -0.02e0",
    "up_ge_3": "y >= 0.03e0", "down_ge_3": "y <= -0.03e0", "up_ge_5": "y >= 0.05e0", "down_ge_5": "y <= -0.05e0",
}
EVENT_COLUMNS = ", ".join(f"{x} AS {n}" for n, x in EVENTS.items())


def rounded(x: str, digits: int = 6) -> str:
    """As the queries round: half up, but for a hair, so that noise at a tie rounds alike; no negative zero."""
    return f"(floor(({x}) * 1e{digits} + 0.5001e0) / 1e{digits} + 0e0)"


def with_ctes(body: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """The body after the CTEs that it needs, in order."""
    known = CTES | (extra or {})
    order: list[str] = []

    def visit(n: str) -> None:
        for x in known[n][0]:
            visit(x)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n][1]})" for n in order) + "\n" + body


def columns(names: tuple[str, ...] | list[str], digits: int = 6) -> str:
    return ", ".join(f"{rounded(f'CAST({n} AS DOUBLE)', digits)} AS {n}" for n in names)
