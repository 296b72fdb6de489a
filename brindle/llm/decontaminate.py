"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks.

Test items are cut into segments of at most ``cell`` words and indexed.  Every document
is read as overlapping passages of two cells, so that a copied segment lies whole in one
of them.  A passage is a query; weights are divided by the segment's own score, so that
one threshold, the share of a segment's BM25 mass, serves all.  Retrieval is exact:

* WAND: a passage whose terms' upper bounds sum to less than the threshold is skipped,
  and only terms beyond the longest prefix of weak terms can name a candidate;
* block-max: a block of segments is opened only if the sum of its block maxima reaches
  the threshold.

All passages of a batch go through these steps together as sorted arrays.  Retrieved
items are verified on shingles: enough of the question and of the answer must be there.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stage, worker

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence is all question."""
    parts = [p for p in map(words, _SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(seq: list[str], n: int = 5) -> set[tuple[str, ...]]:
    return {tuple(seq[i : i + n]) for i in range(max(1, len(seq) - n + 1))} if seq else set()


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, element) for all elements of [first, first + count)."""
    which = np.repeat(np.arange(len(first)), count)
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, first[which] + within


@dataclass
class Item:
    item_id: int
    question: list[str]
    answer: list[str]


def segment_sizes(n: int, cell: int) -> list[int]:
    """Words in each of the even segments of at most ``cell`` words."""
    parts = -(-n // cell)
    return [(j + 1) * n // parts - j * n // parts for j in range(parts)]


@dataclass
class Corpus:
    """Statistics of all items, whichever index holds them."""

    df: dict[str, int]  # segments with each term
    segments: int
    mean: float


class Bm25Index:
    """Inverted index with block maxima over item segments; weights are shares of a segment's own score."""

    def __init__(self, items: list[tuple[int, str]], cell: int = 64, k1: float = 1.2, b: float = 0.75, block: int = 8, corpus: Corpus | None = None):
        self.cell, self.block = cell, block
        self.items = [Item(i, *question_and_answer(t)) for i, t in items]
        self.term_id: dict[str, int] = {}
        flat, sizes, owners = array("q"), [], []
        for k, (_, text) in enumerate(items):
            listed = words(text)
            flat.extend([self.term_id.setdefault(w, len(self.term_id)) for w in listed])
            sizes += segment_sizes(len(listed), cell)
            owners += [k] * (len(sizes) - len(owners))
        self.segment_item = owners
        size = np.array(sizes, np.int64)
        seg_of = np.repeat(np.arange(len(size)), size)
        terms, segments = len(self.term_id), max(1, len(size))
        # A term counts once in a passage, so the segment's own score counts it once too.
        pair, f = np.unique(np.frombuffer(flat, np.int64) * segments + seg_of, return_counts=True)
        term, self.segment = pair // segments, pair % segments
        df, n, mean = np.bincount(term, minlength=terms).astype(np.float64), len(size), float(size.mean()) if len(size) else 1.0
        if corpus:  # all items, of which this index holds some
            df, n, mean = np.array([corpus.df[w] for w in self.term_id], np.float64), corpus.segments, corpus.mean
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5))[term] * f * (k1 + 1) / (f + k1 * (1 - b + b * size[self.segment] / mean)) if len(pair) else np.zeros(0)
        self.weight = weight / np.bincount(self.segment, weight, segments)[self.segment] if len(pair) else weight
        self.blocks = max(1, -(-len(size) // block))
        # Postings are in order of (term, segment), so those of a (term, block) are a range.
        key = term * self.blocks + self.segment // block
        self.key, self.key_first = np.unique(key, return_index=True)
        self.key_count = np.diff(np.r_[self.key_first, len(key)])
        self.key_max = np.maximum.reduceat(self.weight, self.key_first) if len(key) else np.zeros(0)
        self.term_first = np.searchsorted(self.key, np.arange(terms) * self.blocks)
        self.term_count = np.searchsorted(self.key, (np.arange(terms) + 1) * self.blocks) - self.term_first
        self.place = None  # of each (term, block) in the keys, while such a table is small
        if terms * self.blocks <= 1 << 22:
            self.place = np.full(terms * self.blocks, -1, np.int32)
            self.place[self.key] = np.arange(len(self.key))
        self.bound = np.zeros(terms)
        np.maximum.at(self.bound, term, self.weight)

    def search(self, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, segment, score) of all scores >= threshold, for distinct (window, term) pairs sorted by window."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        eps = 1e-9
        if not len(window):
            return none
        # WAND: skip passages that cannot reach the threshold whatever they meet.
        ub = self.bound[term]
        total = np.bincount(window, ub)
        live = total[window] >= threshold - eps
        window, term, ub = window[live], term[live], ub[live]
        if not len(window):
            return none
        # Terms in order of their bounds; those before the threshold is passed are not essential.
        order = np.lexsort((ub, window))
        window, term, ub = window[order], term[order], ub[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        group = np.cumsum(np.r_[True, window[1:] != window[:-1]]) - 1
        names = window[first]
        cum = np.cumsum(ub)
        inside = cum - (cum[first] - ub[first])[group]
        essential = inside >= threshold - eps
        weak = np.bincount(group[~essential], ub[~essential], len(names))
        # Candidate blocks come from essential terms; weak terms add their sum at most.
        g, t = group[essential], term[essential]
        which, place = _ranges(self.term_first[t], self.term_count[t])
        pair = g[which] * self.blocks + self.key[place] % self.blocks
        cand, back = np.unique(pair, return_inverse=True)
        best = np.bincount(back, self.key_max[place], len(cand))
        cand, best = self._at_least(cand, best, weak, threshold - eps)
        if not len(cand):
            return none
        # Block maxima of the weak terms, then of whole passages.
        count = np.diff(np.r_[first, len(window)])
        which, at = _ranges(first[cand // self.blocks], count[cand // self.blocks])
        find = term[at] * self.blocks + cand[which] % self.blocks
        place = self._find(find)
        there = place >= 0
        best = np.bincount(which[there], self.key_max[place[there]], len(cand))
        keep = best >= threshold - eps
        ok = there & keep[which]
        # Open the blocks that remain: exact scores of their segments.
        span, post = _ranges(self.key_first[place[ok]], self.key_count[place[ok]])
        n = int(self.segment.max()) + 1
        hit, back = np.unique((cand[which[ok]] // self.blocks)[span] * n + self.segment[post], return_inverse=True)
        score = np.bincount(back, self.weight[post], len(hit))
        good = score >= threshold - eps
        return names[hit[good] // n], hit[good] % n, score[good]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each (term, block) key, or -1."""
        if self.place is not None:
            return self.place[keys]
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)

    def _at_least(self, cand: np.ndarray, best: np.ndarray, weak: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        keep = best + weak[cand // self.blocks] >= threshold
        return cand[keep], best[keep]


def _passages(index: Bm25Index, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) pairs in order, and each document's first passage."""
    cell = index.cell
    cells = np.array([max(1, -(-len(w) // cell)) for w in texts])
    base = np.cumsum(cells) - cells
    windows, terms = [], []
    get = index.term_id.get
    for k, w in enumerate(texts):
        ids = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        c = at // cell
        t = ids[at]
        own = base[k] + c  # passage c spans cells c and c + 1
        earlier = c > 0
        windows += [own, own[earlier] - 1]
        terms += [t, t[earlier]]
    n = max(1, len(index.term_id))
    pairs = np.unique(np.concatenate(windows) * n + np.concatenate(terms)) if windows else np.zeros(0, np.int64)
    return pairs // n, pairs % n, base


def leaks(index: Bm25Index, texts: list[str], threshold: float, overlap: float) -> list[list[tuple[int, float, float, float | None]]]:
    """Per text: (item_id, score, question overlap, answer overlap) of verified items; an item of one sentence has no answer."""
    out: list[list[tuple[int, float, float, float | None]]] = [[] for _ in texts]
    listed = [words(t) for t in texts]
    window, term, base = _passages(index, listed)
    w, s, score = index.search(window, term, threshold)
    if not len(w):
        return out
    doc = np.searchsorted(base, w, side="right") - 1
    found: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for d, x, seg, v in zip(doc.tolist(), w.tolist(), s.tolist(), score.tolist(), strict=True):
        found.setdefault((d, index.segment_item[seg]), []).append((x - int(base[d]), v))
    for (d, k), places in sorted(found.items()):
        item = index.items[k]
        seen: set[tuple[str, ...]] = set()
        near: set[str] = set()
        for c, _ in places:  # the passage and a cell on either side
            part = listed[d][max(0, (c - 1) * index.cell) : (c + 3) * index.cell]
            seen |= grams(part, min(5, max(1, len(item.question))))
            near.update(part)
        asked = grams(item.question)
        q = len(asked & seen) / max(1, len(asked))
        if q < overlap:
            continue
        a = None
        if item.answer:
            # Its words near the question, or, since an answer may stand anywhere, its pairs of words in the whole document.
            own, pairs = set(item.answer), grams(item.answer, 2)
            a = len(own & near) / len(own)
            if a < overlap:
                a = max(a, len(pairs & grams(listed[d], min(2, len(item.answer)))) / len(pairs))
        if a is None or a >= overlap:
            out[d].append((item.item_id, max(v for _, v in places), q, a))
    return out


_OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _found(index: Bm25Index, texts: list[str], threshold: float, overlap: float, batch_chars: int = 400_000) -> Iterator[list[tuple]]:
    """``leaks`` of each text, some texts at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= batch_chars or i + 1 == len(texts):
            yield from leaks(index, texts[start : i + 1], threshold, overlap)
            start, size = i + 1, 0


def _scan(sent, threshold: float, overlap: float):
    @worker("leaks")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = [(d, *hit) for d, found in zip(b.column("doc_id").to_pylist(), _found(sent.value, texts, threshold, overlap), strict=True) for hit in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _clean(sent, threshold: float, overlap: float):
    @worker("leaks")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [not found for found in _found(sent.value, b.column("text").to_pylist(), threshold, overlap)]
            yield b.select(["row"]).filter(pa.array(clean, pa.bool_()))

    return run


def _item_terms(cell: int):
    """Segments that hold each term of an item; a row without a term has the item's segments and words."""

    @worker("leaks")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df: Counter = Counter()
            segments = total = 0
            for text in b.column("text").to_pylist():
                listed, at = words(text), 0
                for n in segment_sizes(len(listed), cell):
                    df.update(set(listed[at : at + n]))
                    at += n
                    segments += 1
                total += len(listed)
            yield pa.RecordBatch.from_arrays([pa.array([*df, None], pa.string()), pa.array([*df.values(), segments], pa.int64()), pa.array([0] * len(df) + [total], pa.int64())], ["term", "n", "words"])

    return run


def _indexes(items: DataFrame, items_per_index: int, cell: int = 64) -> Iterator[Bm25Index]:
    """Indexes of at most ``items_per_index`` items each, weighted by the statistics of all items."""
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    parts = max(1, -(-usable.count() // items_per_index))
    if parts > 1:
        # Hash parts are uneven by a little; a tenth more of them keeps each within the bound.
        parts += -(-parts // 10)
        usable = stage(usable, "leak-items")
        terms = stage(usable.select("text").transform(in_arrow, _item_terms(cell), "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "leak-terms")
        whole = terms.where("term is null").first()
    for p in range(parts):
        own = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        corpus = None
        if parts > 1:
            used = own.select("text").transform(in_arrow, _item_terms(cell), "term string, n long, words long").select("term").distinct()
            corpus = Corpus({r["term"]: r["n"] for r in terms.join(used, "term").collect()}, whole["n"], whole["words"] / max(1, whole["n"]))
        rows = own.orderBy("item_id", "text").collect()
        yield Bm25Index([(r["item_id"], r["text"]) for r in rows], cell, corpus=corpus)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, items_per_index: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified leaks, one row per (document row, item): doc_id, item_id, score, question_overlap, answer_overlap.

    ``items`` has item_id and text; all sentences but the last are the question, the last
    is the answer.  An item of one sentence has no answer: its answer_overlap is null and
    the question decides.  Question overlap counts 5-word shingles in the retrieved
    passages and a cell around them; answer overlap counts words there or, if those are too
    few, pairs of words in the whole document.
    An index holds ``items_per_index`` items at most, since it is broadcast; more items make
    more indexes with common statistics, and the documents are read once for each.
    Null and empty texts and items match nothing; repeated rows are reported each; a null
    doc_id is carried along; empty tables give no rows; extra columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    found = [base.transform(in_arrow, _scan(send(index), threshold, overlap), _OUT) for index in _indexes(items, items_per_index)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, items_per_index: int = 50_000, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, whole, in which ``contaminated`` finds nothing.

    Rows pass through the search, so nothing is shuffled, and each is judged by its own
    text, whatever its id.
    """
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kind = f"row {out.schema['row'].dataType.simpleString()}"
    for index in _indexes(items, items_per_index):
        rows = out.select("row", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"))
        out = rows.transform(in_arrow, _clean(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap), kind)
    return out.select("row.*")
