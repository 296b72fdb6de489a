from __future__ import annotations

import numpy as np

from brindle.llm import decontaminate as D
from tests.llm.conftest import prose


def test_search_equals_exhaustive_scores(texts):
    items = [(i, prose(i, 20 + i)) for i in range(40)] + [(100, prose(3, 300))]
    index = D.Bm25Index(items)
    postings = [{} for _ in index.segment_item]
    for key, first, n in zip(index.key, index.key_first, index.key_count, strict=True):
        for p in range(first, first + n):
            postings[index.segment[p]][key // index.blocks] = index.weight[p]
    listed = [D.words(prose(1000 + i, 200) if i % 2 else items[i][1]) for i in range(30)]
    window, term, _ = D._passages(index, listed)
    for threshold in (0.2, 0.5, 0.9):
        for table in (index.place, None):
            index.place = table
            got = {(w, s): v for w, s, v in zip(*(x.tolist() for x in index.search(window, term, threshold)), strict=True)}
            want = {}
            for w in np.unique(window):
                own = set(term[window == w].tolist())
                for s, bag in enumerate(postings):
                    v = sum(bag[t] for t in own if t in bag)
                    if v >= threshold - 1e-9:
                        want[int(w), s] = v
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_planted_items_are_found_and_others_left(spark, sf_dir, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench = {r.item_id: r.text for r in items.collect()}
    clean = {d: t for d, t in texts.items() if not any(b in t for b in bench.values())}
    planted = {}
    for k, (i, b) in enumerate(sorted(bench.items())):
        planted[5000 + k] = (i, prose(k, 37 * k % 300) + " " + b.upper() + "\n" + prose(k + 1, 90))
    docs = spark.createDataFrame([(d, t) for d, t in clean.items()] + [(d, t) for d, (_, t) in planted.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert {(d, i) for d, (i, _) in planted.items()} <= got
    assert {d for d, _ in got} <= set(planted)


def test_long_items_and_many_indexes(spark):
    long = prose(77, 700) + "\nAnd the answer is forty two lamps."
    items = spark.createDataFrame([(1, long), (2, prose(5, 30)), (3, None), (4, ""), (2, prose(5, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(6, 100) + " " + long), (2, long[: len(long) // 3]), (3, prose(9, 400))], "doc_id long, text string")
    for per in (1, 50):
        assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items, items_per_index=per).collect()] == [(1, 1)]


def test_question_without_answer_is_no_leak(spark):
    q, a = prose(1, 40), "Zebra quilt vortex jumble."
    items = spark.createDataFrame([(1, f"{q} {a}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{q} {a}"), (2, q)], "doc_id long, text string")
    assert [r.doc_id for r in D.contaminated(docs, items).collect()] == [1]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Some plain text about a lamp.")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contaminated(odd_docs, items).collect()) == [1, 5, 5]
    assert D.contaminated(no_docs, items).count() == 0
    assert D.contaminated(odd_docs, items.where("false")).count() == 0


def test_answers_far_from_their_question_and_many_indexes(spark):
    from tests.llm.conftest import prose

    items = [(i, f"{prose(900 + i, 70)} The answer to it is number {i} of the {prose(300 + i, 6)}") for i in range(30)]
    listed = spark.createDataFrame(items, "item_id long, text string")
    question, answer = items[7][1].split(" The answer")
    far = f"{question} {prose(1, 900)} The answer{answer}"
    docs = spark.createDataFrame([(1, far), (2, question), (3, prose(2, 400)), (None, items[3][1])], "doc_id long, text string")
    whole = sorted(map(tuple, D.contaminated(docs, listed).collect()), key=str)
    assert [(r[0], r[1]) for r in whole] == [(1, 7), (None, 3)]
    parts = sorted(map(tuple, D.contaminated(docs, listed, items_per_index=6).collect()), key=str)
    assert [(r[0], r[1], round(r[2], 9)) for r in parts] == [(r[0], r[1], round(r[2], 9)) for r in whole]
    assert {r.doc_id for r in D.drop_contaminated(docs, listed, items_per_index=6).collect()} == {2, 3}


def test_verification_equals_brute_force(spark):
    from tests.llm.conftest import prose

    items = [(i, f"{prose(40 + i, 30)} Is it so? Then {prose(80 + i, 8)}") for i in range(8)]
    texts = [f"{prose(200 + i, 50)} {items[i % 8][1]} {prose(300 + i, 50)}" for i in range(16)] + [prose(400 + i, 200) for i in range(10)]
    texts = [t if i % 3 else " ".join(w for k, w in enumerate(t.split()) if k % 13) for i, t in enumerate(texts)]
    index = D.Bm25Index(items)
    got = {(d, hit[0]) for d, found in enumerate(D.leaks(index, texts, 0.5, 0.8)) for hit in found}
    want = set()
    for d, t in enumerate(texts):
        there = D.words(t)
        for i, text in items:
            q, a = D.question_and_answer(text)
            if len(D.grams(q) & D.grams(there)) >= 0.8 * len(D.grams(q)) and len(set(a) & set(there)) >= 0.8 * len(set(a)):
                want.add((d, i))
    assert got == want and len(want) > 5
