from __future__ import annotations

import random
import zlib

import numpy as np

from brindle.llm import language_id as L
from brindle.llm import toxicity as T
from brindle.llm.trees import BoostedTrees, platt, sigmoid


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    changed = docs.selectExpr("doc_id", "text", "IF(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) AS lang")
    a = sorted(map(tuple, L.identify(docs).collect()))
    assert a == sorted(map(tuple, L.identify(changed).collect()))


def test_language_odd_rows(odd_docs, no_docs):
    rows = L.identify(odd_docs).collect()
    assert len(rows) == 11 and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4, 7))
    assert L.identify(no_docs).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs.where("lang is null")).collect()} == {"und"}


def test_ngrams_of_a_batch_equal_single_texts():
    r = random.Random(4)
    for _ in range(100):
        texts = ["".join(r.choice("abc .é\n1") for _ in range(r.randrange(14))) for _ in range(r.randrange(1, 5))]
        h, counts, _ = L.ngrams(texts)
        at = 0
        for t, n in zip(texts, counts, strict=True):
            alone, c, _ = L.ngrams([t])
            assert c[0] == n and sorted(alone) == sorted(h[at : at + n])
            at += n


def test_filters_return_every_language_of_a_gram():
    table = np.zeros((1, 1 << 12), np.uint64)
    f = L.LanguageFilters(["a", "b"], table, np.zeros(2), np.ones(2))
    grams, _, _ = L.ngrams(["lamp river stone"])
    for k, own in enumerate((grams[:8], grams[4:])):
        for j in range(f.hashes):
            np.bitwise_or.at(table[0], ((own >> np.uint64(21 * j)) & np.uint64(table.shape[1] - 1)).astype(np.int64), np.uint64(1 << k))
    masks = f.masks(grams)[0]
    assert all(masks[:8] & np.uint64(1)) and all(masks[4:] & np.uint64(2))


def test_more_than_64_languages(spark):
    r = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 6)]  # each language writes with letters of its own
    rows = [(i, " ".join("".join(r.choice(letters[6 * k : 6 * k + 6]) for _ in range(r.randrange(2, 6))) for _ in range(30)), f"l{k:02d}") for i in range(70 * 8) for k in [i % 70]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows) and all(x.lang_pred == f"l{x.doc_id % 70:02d}" for x in got)
    few = L.fit(docs, table_bytes=1 << 17)
    assert few.table.shape == (2, 1 << 13) and L.identify(docs, few).where("lang_pred = concat('l', lpad(doc_id % 70, 2, '0'))").count() > 500


def test_counting_grams_takes_few_texts_at_a_time():
    import pyarrow as pa

    texts = ["lamp river stone " * 2000] * 60 + [None, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 62), pa.array([t or "" for t in texts])], ["lang", "text"])
    parts = list(L._count_grams(iter([batch])))
    h, _, _ = L.ngrams([texts[0]])
    assert len(parts) > 3 and sum(p.column("n").to_numpy().sum() for p in parts) == 60 * len(h)


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(5)
    terms = ["abcabc", "abcd", "bcabca", "cab"]
    a = T.LexiconAutomaton(terms, max_states=40)
    for _ in range(2000):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
        want = min([(e, i) for i, t in enumerate(terms) for k in range(1, len(w) + 1) if (e := edits(w[:k], t)) <= (len(t) >= 6)], default=(9, -1))
        assert a.match(w) == want


def test_short_terms_match_whole_words():
    r = random.Random(6)
    terms = ["abcab", "cabca", "abcabc", "abc$", "bcba$"]
    a = T.LexiconAutomaton(terms, max_states=40)
    for _ in range(3000):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
        want = []
        for i, t in enumerate(terms):
            if t.endswith("$"):
                want += [(0, i)] * (w == t[:-1])
            elif len(t) == 5:
                want += [(0, i)] * w.startswith(t) + [(1, i)] * (edits(w, t) <= 1)
            else:
                want += [(e, i) for k in range(1, len(w) + 1) if (e := edits(w[:k], t)) <= 1]
        assert a.match(w) == min(want, default=(9, -1)), w


def test_short_and_misspelt_words_are_learned(spark):
    r = random.Random(7)
    plain = "river lamp stone trust green winter table cloud drum scam".split()
    # Every misspelling is too rare to be a term of its own.
    bad = [lambda: "scum", lambda: "clown", lambda: "idiot", lambda: "c" + r.choice("bcdfghjkmnpqrstvwxz") + "own" if r.random() < 0.5 else "clo" + r.choice("abcdefghijklmnopqrstuvxyz") + "n"]
    rows = [(i, " ".join(r.choices(plain, k=30) + ([bad[i // 8 % 4]()] if i % 8 == 0 else [])), int(i % 8 == 0)) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    table = T.HitTable(T.LexiconAutomaton(model.terms))
    lift = {w: model.weights.get(table[w][::-1], 0.0) if table[w] else 0.0 for w in ["scum", "clown", "clawn", "scam", "drum", "scums"]}
    assert all(lift[w] > 1 for w in ("scum", "clown", "clawn")) and lift["scam"] == lift["drum"] == lift["scums"] == 0, lift
    scores = {r.doc_id: r.score for r in T.score_toxicity(spark.createDataFrame([(1, "you are scum"), (2, "you are a clawn"), (3, "the river and the table")], "doc_id long, text string"), model=model).collect()}
    assert scores[1] >= 0.5 and scores[2] >= 0.5 and scores[3] < 0.5, scores


def test_quotation_is_told_from_use():
    table = T.HitTable(T.LexiconAutomaton(["stupid"]))
    found, n = T.hits('You are stupid. He said stupid. The word "stupid" hurts a lot in every single way. Stupjd!', table)
    assert [(e, q) for _, e, q in found] == [(0, False), (0, True), (0, True), (1, False)] and n == 17
    for text, want in [
        ('She stated: "you are a pathetic stupid clown, go away" and left', True),
        ("They wrote « tu es stupid et le reste » hier", True),
        ("don't be stupid, you can't", False),
        ('a "nice" stupid "thing"', False),
        ("'go away stupid one', they shouted", True),
        ('an open " mark\nthen stupid "', False),
    ]:
        assert [q for *_, q in T.hits(text, table)[0]] == [want], text


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = T.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    pos, neg = [r.score for r in held if r.toxic], np.sort([r.score for r in held if not r.toxic])
    auc = np.mean([(np.searchsorted(neg, p, "left") + np.searchsorted(neg, p, "right")) / 2 / len(neg) for p in pos])
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    precision, recall = hit / max(1, sum(r.predicted for r in held)), hit / len(pos)
    assert auc > 0.9 and precision > 0.8 and recall > 0.8, (auc, precision, recall)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_quoted_terms_score_below_direct_ones(spark):
    r = random.Random(8)
    plain = "river lamp stone trust green winter table cloud drum scam".split()
    rows = []
    for i in range(1600):
        base = r.choices(plain, k=30)
        bad = r.choice(["clown", "scum", "idiot"])
        # Toxic documents use the words; others quote them as often.
        extra, toxic = ([f"you {bad}"], 1) if i % 8 == 0 else ([f'she found "you {bad}" there'], 0) if i % 8 == 1 else ([], 0)
        rows.append((i, " ".join(base[:15] + extra + base[15:]), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = T.score_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    use, quote = [x for x in out if x.doc_id % 8 == 0], [x for x in out if x.doc_id % 8 == 1]
    assert all(x.n_hits == x.n_quoted > 0 for x in quote) and all(x.n_quoted == 0 for x in use)
    caught, left = np.mean([x.predicted for x in use]), np.mean([1 - x.predicted for x in quote])
    print(f"direct use caught {caught:.2f}, quotations left alone {left:.2f}")
    assert caught > 0.95 and left > 0.95


def test_lexicon_is_clean(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet").where(~T.held_out())
    model = T.fit(docs.where(~T.held_out()), labels)
    print(len(model.terms), model.terms)
    assert 8 <= len(model.terms) <= 40


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (9, 1, 0), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert T.score_toxicity(odd_docs, labels).count() == 11
    assert T.score_toxicity(no_docs, labels).count() == 0
    assert T.score_toxicity(odd_docs, labels.where("false")).count() == 11


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(3000, 4))
    y = ((X[:, 0] > 0) ^ (X[:, 1] > 0.5)).astype(int)
    t = BoostedTrees().fit(X[:2000], y[:2000])
    margin = t.margin(X[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.95
    a, b = platt(margin, y[2000:])
    p = sigmoid(a * margin + b)
    assert abs(p.mean() - y[2000:].mean()) < 0.03
    assert BoostedTrees().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((3, 2))).shape == (3,)
