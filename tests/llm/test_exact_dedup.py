from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import exact_dedup as E
from brindle.llm.queries import QUERIES, SQL
from tests.compare import assert_same


def test_equals_sql(spark, duck, sf_dir):
    assert_same(QUERIES["op9_exact_lsm_dedup"](spark, sf_dir), duck, SQL["op9_exact_lsm_dedup"])


def test_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in E.exact_dedup(odd_docs, memtable_rows=2).collect()}
    assert (rows[5].keep_id, rows[5].group_size, rows[5].kept) == (1, 3, False)
    assert rows[2].keep_id == rows[3].keep_id == 2 and rows[2].group_size == 2
    assert rows[4].text_sha256 == hashlib.sha256(b" ").hexdigest()
    assert rows[None].kept and rows[None].keep_id is None and E.exact_dedup(no_docs).count() == 0


def test_rows_without_an_id(spark, duck):
    rows = [(None, "a b"), (None, "a  b"), (7, "a\tb"), (None, "c"), (None, "c"), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in E.exact_dedup(docs).collect())
    want = [(None, 7, 3, False)] * 2 + [(7, 7, 3, True)] + [(None, None, 2, True)] * 2 + [(3, 3, 2, True), (None, 3, 2, False)]
    assert got == sorted((str(d), str(k), n, x) for d, k, n, x in want)
    assert sorted((r.doc_id is None, r.text) for r in E.drop_copies(docs.where("doc_id is null or doc_id = 7")).collect()) == [(False, "a\tb"), (True, ""), (True, "c")]


def test_drop_copies_keeps_rows_whole(spark, odd_docs, no_docs):
    twice = odd_docs.unionByName(odd_docs)
    kept = E.drop_copies(twice)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.where("doc_id is null or doc_id not in (3, 5)").collect()))
    assert E.drop_copies(no_docs).count() == 0


def digest(i: int) -> bytes:
    return hashlib.sha256(str(i).encode()).digest()


def test_index_keeps_smallest_ids_over_flushes_and_compactions():
    rng = np.random.default_rng(0)
    index, want = E.LsmIndex(memtable_rows=50, fan_in=3), {}
    for _ in range(60):
        k = rng.integers(0, 400, 17)
        ids = rng.integers(0, 10_000, 17)
        index.put(np.array([digest(x) for x in k], E._KEY), ids, np.ones(17, np.int64))
        for a, b in zip(k.tolist(), ids.tolist(), strict=True):
            low, n = want.get(digest(a), (b, 0))
            want[digest(a)] = (min(low, b), n + 1)
    got = {}
    for keys, ids, counts in index.items():
        raw = keys.tobytes()
        got |= {raw[32 * i : 32 * i + 32]: (int(ids[i]), int(counts[i])) for i in range(len(ids))}
    assert got == want


def test_filter_has_no_false_negatives():
    keys = np.sort(np.array([digest(i) for i in range(500)], E._KEY))
    run = E.Run(keys, np.arange(500), np.ones(500, np.int64))
    assert (run.find(keys) == np.arange(500)).all()
    assert (run.find(np.array([digest(i) for i in range(500, 900)], E._KEY)) == -1).all()


def test_texts_that_share_a_digest_are_told_apart(spark):
    rows = [(1, 1, 4, "k", True, None), (2, 1, 4, "k", True, None), (3, 1, 4, "k", False, "x"), (4, 1, 4, "k", False, "x")]
    checked = spark.createDataFrame(rows, "doc_id long, keep_id long, n long, digest string, same boolean, norm string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E._split_collisions(checked, []).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2)}


def test_normalised_is_ascii_space_only(spark):
    text = "a \t\n b c\x0b\x0cd"
    got = spark.createDataFrame([(text,)], "t string").select(E.normalised(F.col("t")).alias("n")).first()["n"]
    assert got == re.sub(r"[\x20\x09-\x0D]+", " ", text)
