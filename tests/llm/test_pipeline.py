"""The stages against their own brute force, one after another, and the SQL of the queries that have it."""

import re
import shutil
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from cadenza.llm import line_dedup, queries

from .test_operators import reachable, shingle_sets


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            kept[name] = docs.collect()
    raw = spark.read.parquet(f"{data}/documents.parquet").collect()
    judged = {r.doc_id: r.kept for r in queries.op3_quality_lines(spark, data).collect()}
    assert {r.doc_id for r in kept["quality rules"]} == {r.doc_id for r in raw if judged[r.doc_id]}
    assert len(kept["line dedup"]) == len(kept["quality rules"])
    rows = [(r.doc_id, r.text, r.source) for r in kept["line dedup"]]
    sets = shingle_sets(rows, 5)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = reachable(sets, links)
    assert sorted(r.doc_id for r in kept["near copies"]) == sorted(set(groups.values()))
    uses = Counter(r.doc_id for r in kept["mixing"])
    assert set(uses) == {r.doc_id for r in kept["near copies"]} and max(uses.values()) <= 2
    assert Counter(r.doc_id for r in docs.where("start = 0").collect()) == uses
    shutil.rmtree(tmp_path)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: None if pd.isna(x) else x if isinstance(x, str | bool) else round(float(x), 9)
    tidy = lambda df: sorted(repr([cell(x) for x in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert tidy(got) == tidy(want)


def test_names():
    assert [n for n in queries.queries() if re.match(r"op\d+_", n)] == sorted((n for n in queries.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(queries.queries()) == 14 and line_dedup.MAX_RATIO < 1
