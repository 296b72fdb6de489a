from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import near_dedup as N
from brindle.llm import suffix_dedup as S
from brindle.llm.components import components
from tests.llm.conftest import prose


def word_sets(texts, k):
    out = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        out[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def near_components(texts, k, percent=80):
    sets, parent = word_sets(texts, k), {d: d for d in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b >= a or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def family(texts):
    """The table's documents and groups of edits around the threshold."""
    base = prose(1, 150)
    more = {10_000 + i: edited(base, i % 9, i) for i in range(120)}
    return {d: t for d, t in texts.items() if d < 120} | more


@pytest.mark.parametrize("chunk", [24_000_000, 9_000])
def test_near_components_equal_brute_force(spark, family, chunk):
    docs = spark.createDataFrame(list(family.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_dedup(docs, words=4, chunk_chars=chunk).collect()}
    assert got == near_components(family, 4)


def test_near_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in N.near_dedup(odd_docs).collect()}
    assert rows[5].component_id == 1 and not rows[5].kept
    assert all(rows[d].component_id == d and rows[d].n_shingles == 0 for d in (2, 3, 4))
    assert rows[8].kept and rows[None].kept and rows[None].component_id is None
    assert N.near_dedup(no_docs).count() == 0


@pytest.mark.parametrize("chunk", [24_000_000, 9_000])
def test_rows_that_stay_equal_the_verdicts(spark, family, chunk):
    docs = spark.createDataFrame([(d, t, "x") for d, t in family.items()], "doc_id long, text string, source string")
    want = {d for d, (_, g) in near_components(family, 4).items() if d == g}
    got = N.drop_near_copies(docs, words=4, chunk_chars=chunk)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_rows_that_stay_odd(spark, odd_docs, no_docs):
    kept = N.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.where("doc_id is null or doc_id != 5").collect()))
    assert N.drop_near_copies(no_docs).count() == 0
    rows = [(None, "a b c d e f"), (4, "a B c d e f"), (4, "other words than those of its namesake"), (9, "other words than those of its namesake"), (None, "a row of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in N.drop_near_copies(docs).collect()} == {rows[1], rows[2], rows[4]}
    verdict = N.near_dedup(docs).collect()
    assert len(verdict) == 5 and [r.kept for r in verdict if r.doc_id == 9] == [False] and sorted(r.kept for r in verdict if r.doc_id is None) == [False, True]


def test_min_max_signature_estimates_similarity():
    h, rng = N.MinMaxHasher(), np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 1000, np.uint64)
    a, b = x[:900], x[100:]
    assert abs((h.signature(a) == h.signature(b)).mean() - 0.8) < 0.08
    assert h.miss(0.8) < 1e-3 and len(h.signature(a)) == 2 * h.perms
    assert all(len({v % h.perms for v in row}) == h.rows for row in h.pick.tolist())


def test_shingles_count_like_tuples():
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice("aB \n\té中") for _ in range(r.randrange(50)))
        for k in (1, 4):
            assert len(N.shingles(t, k)) == len(word_sets({0: t}, k)[0])


def test_link_sets_equals_all_pairs():
    r = random.Random(6)
    for _ in range(20):
        base = [set(r.sample(range(60), 20)) for _ in range(3)]
        sets = []
        for _ in range(20):
            s = set(r.choice(base))
            for _ in range(r.randrange(4)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(100))
            sets.append(s)
        label = N.link_sets([np.array(sorted(s), np.uint64) for s in sets], 80)
        parent = list(range(20))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(20):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(20)] == label.tolist()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)] + [(301, 300), (300, 301)]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def repeats(texts, length, passage):
    raw = {d: t.encode() for d, t in texts.items()}
    seen = Counter(p[i : i + length] for p in raw.values() for i in range(len(p) - length + 1))
    among = Counter(w for p in raw.values() for w in {p[i : i + passage] for i in range(len(p) - passage + 1)})

    def covered(p, size, found):
        mask = np.zeros(len(p) + 1, np.int64)
        for i in range(len(p) - size + 1):
            if found[p[i : i + size]] > 1:
                mask[i] += 1
                mask[i + size] -= 1
        return np.cumsum(mask)[: len(p)] > 0

    out = {}
    for d, p in raw.items():
        mask = covered(p, length, seen)
        kept = np.frombuffer(p, np.uint8)[~mask].tobytes()
        out[d] = (len(p), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(covered(p, passage, among).sum()))
    return out


@pytest.mark.parametrize(("length", "passage", "gram", "chunk", "bits"), [(400, 256, 32, 2_000_000, 64), (60, 40, 12, 2_000_000, 64), (60, 40, 12, 700, 64), (40, 60, 12, 700, 64), (60, 40, 12, 5000, 1)])
def test_repeats_equal_brute_force(spark, texts, length, passage, gram, chunk, bits):
    own = {d: t for d, t in texts.items() if d < 60}
    shared = prose(2, 60)
    own |= {1000 + i: prose(50 + i, 20) + " " + edited(shared, i % 4, i) + " " + prose(90 + i, 10) for i in range(12)}
    own |= {2000: "ab" * 700, 2001: "x" * 1000, 2002: "line one of text\n" * 60, 2003: "é" * 300, 2004: shared, 2005: shared, 2006: prose(7, 40) * 3, 2007: prose(8, 30) + "x" * 55}
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_shared) for r in S.remove_repeats(docs, length, passage, gram, chunk, bits).collect()}
    assert got == repeats(own, length, passage)


def test_passages_of_over_50_words_are_seen(spark):
    passage = prose(77, 51)
    rows = [(i, f"{prose(500 + i, 60)} {passage} {prose(600 + i, 40)}") for i in range(6)] + [(100 + i, prose(700 + i, 150)) for i in range(6)] + [(200, "and so it said to all of them " * 40)]
    got = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(passage) < 400 and all((got[d].n_shared > 0) == (d < 6) for d, _ in rows)
    assert all(got[d].n_removed == 0 for d, _ in rows if d < 200) and got[200].n_removed > 0


def test_repeated_rows_are_one_document_for_passages(spark):
    t = prose(5, 120)
    got = S.remove_repeats(spark.createDataFrame([(1, t)] * 5 + [(2, prose(6, 120))], "doc_id long, text string")).collect()
    assert len(got) == 6 and [(r.n_removed > 0, r.n_shared) for r in got if r.doc_id == 1] == [(True, 0)] * 5


def test_repeats_odd_rows(odd_docs, no_docs):
    rows = S.remove_repeats(odd_docs).collect()
    assert len(rows) == 11 and all(r.n_bytes == 0 for r in rows if r.doc_id in (2, 3))
    assert S.remove_repeats(no_docs).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(8)
    for _ in range(40):
        codes = np.array([r.randrange(1, 4) for _ in range(r.randrange(1, 80))], np.uint16)
        sa = S.suffix_array(codes, len(codes))
        suffixes = [codes[i:].tolist() for i in range(len(codes))]
        assert sa.tolist() == sorted(range(len(codes)), key=lambda i: suffixes[i])
        got = S.common_prefixes(codes, sa, 1000, lanes=3)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < min(len(suffixes[a]), len(suffixes[b])) and suffixes[a][n] == suffixes[b][n]:
                n += 1
            assert got[b] == n


def test_merge_by_binary_search():
    r = random.Random(9)
    for _ in range(40):
        parts = ["".join(r.choice("ab\x00") for _ in range(r.randrange(60))).encode() for _ in range(6)]
        docs = [r.randrange(3) for _ in parts]
        rows = [S.Part(max(0, len(p) - 4), p, d, d) for p, d in zip(parts, docs, strict=True)]
        sides = [S.Shard(rows[k : k + 3], 9) for k in (0, 3)]
        for one, other in (sides, sides[::-1]):
            found, apart = one.found_in(other, 5)
            where = {}
            for side in sides:
                for p in side.parts:
                    for i in range(p.windows):
                        where.setdefault(p.raw[i : i + 5], set()).add(p.low)
            there = {p.raw[i : i + 5] for p in other.parts for i in range(p.windows)}
            assert [x.tolist() for x in found] == [[p.raw[i : i + 5] in there for i in range(p.windows)] for p in one.parts]
            assert [x.tolist() for x in apart] == [[p.raw[i : i + 5] in there and len(where[p.raw[i : i + 5]]) > 1 for i in range(p.windows)] for p in one.parts]
