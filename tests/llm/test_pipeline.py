from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from brindle.llm.common import stage, sweep, tables_made
from tests.llm.conftest import prose
from tests.llm.test_dedup import near_components


def test_stages_take_effect(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    base = prose(1, 200)
    planted = [(9001, "123 ... 456", "en", "x", 1), (9002, None, "en", "x", 0), (9003, base, "en", "x", 1), (9004, base.replace(" ", "  "), "en", "x", 1), (9005, base + " one more word", "en", "x", 1), (9006, prose(4, 80) + "\n" + bench, "en", "x", 1)]
    docs = src.unionByName(spark.createDataFrame(planted, src.schema))
    steps = {}
    at = docs
    for name, step in P.STAGES:
        out = step(spark, at, sf_dir)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        at = stage(out, f"test-{name}")
        steps[name] = {r.doc_id: r for r in at.collect()} if name != "packing" else at.collect()
    assert {9001, 9002} & set(steps["language"]) == set() and {9003, 9006} <= set(steps["language"])
    assert len(steps["language"]) == docs.count() - 2
    assert 9004 not in steps["exact"] and 9003 in steps["exact"]
    groups = near_components({d: r.text for d, r in steps["exact"].items()}, 5)
    assert set(steps["near"]) == {d for d, (_, g) in groups.items() if d == g} and 9005 not in steps["near"]
    assert 9006 not in steps["leaks"] and 9006 in steps["near"]
    pieces = steps["packing"]
    assert {r.doc_id for r in pieces} == set(steps["leaks"])
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)


def test_run_equals_its_stages(spark, sf_dir):
    made = tables_made()
    out = P.run(spark, sf_dir)
    assert out.count() > 0 and tables_made() - made == 2  # the last stage's documents and ids
    sweep(spark, made)
    assert tables_made() == made and 4 <= len(P.STAGES) <= 5


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, odd_docs, no_docs, name):
    step = dict(P.STAGES)[name]
    extra = odd_docs.selectExpr("*", "0.5 AS score", "'s' AS spans", "true AS held_out", "'x' AS lang_pred", "2 AS row", "3 AS k", "4 AS explained", "5 AS chunks", "6 AS doc")
    rows = step(spark, extra, sf_dir).collect()
    assert step(spark, no_docs, sf_dir).count() == 0
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == 11
        return
    gone = {"language": {None, 2, 3, 4, 6, 7}, "exact": {3}, "near": set(), "leaks": set()}[name]
    want = [r for r in extra.collect() if r.doc_id not in gone]
    if name in ("exact", "near"):
        want = [r for r in want if r.doc_id != 5]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in want) and set(map(str, rows)) == set(map(str, want))
    nothing = step(spark, extra.withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string")), sf_dir).count()
    assert nothing == {"language": 11, "exact": 1, "near": 11, "leaks": 11}[name]
