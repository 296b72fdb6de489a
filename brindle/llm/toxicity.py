"""Toxicity: Levenshtein automata intersected with a lexicon trie, judged in context.

Lexicon terms (stems of 5 to 8 letters, and whole words of 3 or 4) are learned from
labelled documents.  Terms of 6 letters and more allow one edit, those of 5 letters
against whole words only, shorter ones none.  A word is matched by the product of a Levenshtein automaton for one edit and the trie of terms: a state is
the set of trie nodes reachable with the edits spent so far.  States are made once and
memoised, so that most words leave the automaton after a few letters.  Hits are split
by the window around them: quoted or reported mentions apart from direct use.  Boosted
trees turn the weighted counts into a calibrated score.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_bucket, in_arrow, worker
from .trees import BoostedTrees, platt, sigmoid

_WORD = re.compile(r"\w+")
#: Stretches between a pair of quotation marks in one line, and words that report speech; fixed values.
_QUOTED = re.compile(r""""[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|‘[^’\n]*’(?!\w)|(?<!\w)'[^'\n]*'(?!\w)|`[^`\n]*`""")
_REPORTING = frozenset("said says called quote quoted quotes word term wrote writes dit mot sagte wort dijo palabra".split())
_STEMS = (5, 6, 7, 8)
_SHORT = (3, 4)
#: Marks the end of a word: a term that closes with it is matched by whole words alone.
END = "$"


class LexiconAutomaton:
    """Trie of terms x Levenshtein automaton.

    Accepts words with a prefix within one edit of a term.  Terms one letter shorter than
    ``fuzzy_from`` allow the edit to whole words only, still shorter ones and those that
    close with ``END`` allow none; the latter are whole words.
    """

    def __init__(self, terms: list[str], fuzzy_from: int = 6, max_states: int = 50_000):
        self.terms, self.max_states = terms, max_states
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.depth: list[int] = [0]
        edit_ends = []  # nodes where a match with one edit ends
        for i, term in enumerate(terms):
            self.term_at[node := self._insert(term)] = i
            if len(term) >= fuzzy_from and not term.endswith(END):
                edit_ends.append(node)
            elif len(term) == fuzzy_from - 1 and not term.endswith(END):
                self.term_at[node := self._insert(term + END)] = i
                edit_ends.append(node)
        self.edit_end = [False] * len(self.children)
        self.long = [False] * len(self.children)  # the end of a term that allows an edit lies here or below
        parent = {child: node for node, below in enumerate(self.children) for child in below.values()}
        for node in edit_ends:
            self.edit_end[node] = True
            while node is not None and not self.long[node]:
                self.long[node] = True
                node = parent.get(node)
        self.reset()

    def _insert(self, term: str) -> int:
        node = 0
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term_at.append(-1)
                self.depth.append(self.depth[node] + 1)
            node = self.children[node][c]
        return node

    def reset(self) -> None:
        self.ids: dict[frozenset[tuple[int, int]], int] = {}
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int]] = []  # (edits, term), or (9, -1)
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # a missing letter: step down the trie without reading
            node, edits = todo.pop()
            if edits == 0 and self.long[node]:
                for c, child in self.children[node].items():
                    if self.long[child] and c != END and (child, 1) not in pairs:
                        pairs.add((child, 1))
        key = frozenset((n, e) for n, e in pairs if e == 0 or (n, 0) not in pairs)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term_at[n]) for n, e in key if self.term_at[n] >= 0 and (e == 0 or self.edit_end[n])]
            self.accepts.append(min(ends, default=(9, -1)))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits))
            if edits == 0 and self.long[node] and c != END:
                out.add((node, 1))  # an additional letter
                out.update((x, 1) for k, x in self.children[node].items() if self.long[x] and k != END)  # another letter
        to = self._state(out) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int]:
        """(edits, term) of the best term that the word or a prefix of it matches; (9, -1) if none."""
        if len(self.sets) > self.max_states:
            self.reset()
        state, best = self.start, (9, -1)
        for c in word + END:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            best = min(best, self.accepts[state])
        return best


class HitTable(dict):
    """Memo of word to match, bounded: it starts anew when full."""

    def __init__(self, automaton: LexiconAutomaton, limit: int = 300_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) >= self.limit:
            self.clear()
        hit = self.automaton.match(word)
        self[word] = out = None if hit[1] < 0 else hit
        return out


def hits(text: str, table: HitTable) -> tuple[list[tuple[int, int, bool]], int]:
    """([(term, edits, quoted)], words): quoted tells mention from use.

    A hit is a mention if it stands between a pair of quotation marks of its line, however
    much else stands there, or if one of the four words before it reports speech.
    """
    low = text.lower()
    words = _WORD.findall(low)
    found = list(map(table.__getitem__, words))
    if not any(found):
        return [], len(words)
    pairs = [m.span() for m in _QUOTED.finditer(low)]
    opens = [s for s, _ in pairs]
    out = []
    for i, (hit, span) in enumerate(zip(found, _WORD.finditer(low), strict=True)):
        if hit:
            k = bisect_right(opens, span.start()) - 1
            marked = k >= 0 and span.end() <= pairs[k][1]
            reported = not _REPORTING.isdisjoint(words[max(0, i - 4) : i])
            out.append((hit[1], hit[0], marked or reported))
    return out, len(words)


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)  # log lift of (term, edits)
    trees: BoostedTrees = field(default_factory=BoostedTrees)
    slope: float = 1.0
    offset: float = 0.0
    shift: float = 0.0  # moves the best cut of the training scores to 0.5

    def features(self, found: list[tuple[int, int, bool]], words: int) -> list[float]:
        direct = [self.weights.get((t, e), 0.0) for t, e, q in found if not q]
        quoted = [self.weights.get((t, e), 0.0) for t, e, q in found if q]
        exact = [self.weights.get((t, e), 0.0) for t, e, q in found if not q and e == 0]
        per = 1000.0 / max(20, words)
        return [sum(direct), sum(direct) * per, max(direct, default=0.0), sum(exact), sum(exact) * per, float(len(exact)), len(exact) * per, sum(quoted), sum(quoted) * per, float(len({t for t, _, q in found if not q})), np.log1p(words)]

    def score(self, X: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.trees.margin(X) + self.offset - self.shift)


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen, total = (Counter(), Counter()), (Counter(), Counter())
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = Counter(_WORD.findall(text.lower()))
            stems: Counter = Counter()
            for w, n in words.items():
                for k in _STEMS:
                    if len(w) >= k:
                        stems[w[:k]] += n
                if len(w) in _SHORT:
                    stems[w + END] += n
            seen[y].update(stems.keys())
            total[y].update(stems)
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0], total[1], total[0])]], ["stem", "d1", "d0", "t1", "t0"])


def _hit_rows(terms: list[str]):
    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HitTable(LexiconAutomaton(terms))
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = [hits(t, table) for t in texts]
            flat = [[v for h, c in zip(found, _contexts(t, table) if found else (), strict=True) for v in (h[0], h[1], int(h[2]), c)] for t, (found, _) in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([n for _, n in rows], pa.int64()), pa.array(flat, pa.list_(pa.int32()))], ["doc_id", "toxic", "words", "flat"])

    return run


def _contexts(text: str, table: HitTable) -> list[int]:
    """A number for the words on either side of each hit: copies of a passage have the same ones."""
    words = ["", *_WORD.findall(text.lower()), ""]
    return [zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode("utf-8", "surrogatepass")) >> 1 for i in range(1, len(words) - 1) if table[words[i]]]


def _pick_terms(pdf, n1: int, n0: int, w1: float, w0: float, most: int) -> list[str]:
    """Stems and short words that are over-represented in toxic documents, the shortest of nested ones that say the same."""
    pdf = pdf.assign(lift=((pdf.t1 + 0.5) / (w1 + 1)) / ((pdf.t0 + 0.5) / (w0 + 1)), gap=pdf.d1 / n1 - pdf.d0 / n0)
    good = pdf[(pdf.lift >= 6) & (pdf.d1 >= max(3, 0.002 * n1)) & (pdf.d1 / n1 >= 2 * pdf.d0 / n0)].sort_values(["gap", "stem"], ascending=[False, True])
    terms: list[str] = []
    cover: dict[str, int] = dict(zip(good.stem, good.t1, strict=True))
    for stem in good.stem:
        nested = [t for t in terms if t.startswith(stem) or stem.startswith(t)]
        if any(stem.startswith(t) and cover[t] <= 3 * cover[stem] or t.startswith(stem) for t in nested):
            continue
        terms.append(stem)
        if len(terms) == most:
            break
    return terms


def _found(train: DataFrame, terms: list[str], half) -> tuple[list[list[tuple[int, int, bool, int]]], np.ndarray, np.ndarray, np.ndarray]:
    """(hits with their contexts, words, label, whether terms were picked from it) of each document of the sample."""
    rows = train.transform(in_arrow, _hit_rows(terms), "doc_id long, toxic int, words long, flat array<int>").withColumn("half", half).orderBy("doc_id").toPandas()
    found = [[(int(f[i]), int(f[i + 1]), bool(f[i + 2]), int(f[i + 3])) for i in range(0, len(f), 4)] for f in rows["flat"]]
    return found, rows["words"].to_numpy(), rows["toxic"].to_numpy(), rows["half"].to_numpy(bool)


def _proven(terms: list[str], found: list, words: np.ndarray, y: np.ndarray, own: np.ndarray, lift: float = 3.0, spread: int = 3) -> list[str]:
    """Terms over-represented in toxic documents of the other half too, in ``spread`` different contexts there.

    Contexts tell a word that people use from one that stands in copies of one passage.
    """
    n = np.bincount(y[~own], minlength=2)
    df = (Counter(), Counter())
    contexts: dict[int, set[int]] = {}
    for f, label, mine in zip(found, y, own, strict=True):
        if not mine:
            df[label].update({t for t, e, _, _ in f if e == 0})
            for t, e, _, c in f:
                if label and e == 0:
                    contexts.setdefault(t, set()).add(c)
    rate = lambda k, c: (df[c][k] + 0.5) / (n[c] + 1)
    return [t for k, t in enumerate(terms) if len(contexts.get(k, ())) >= spread and rate(k, 1) >= lift * rate(k, 0)]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 12_000, lexicon: int = 200) -> ToxicityModel:
    """Model from about ``sample_docs`` labelled documents (doc_id, text) x (doc_id, toxic).

    The sample is drawn by a hash of the id.  At most ``lexicon`` terms are picked from one
    half, weights and trees learned from it too; the other half confirms terms and
    calibrates scores.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = max(1, marks.count())
    drawn = F.crc32(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")).cast("binary")) < int(min(1.0, sample_docs / total) * (1 << 32)) + 1
    train = docs.where("doc_id is not null and text is not null").where(drawn).join(marks.where(drawn), "doc_id").select("doc_id", "text", "toxic")
    from .common import stage

    train = stage(train, "toxicity-sample")
    model = ToxicityModel()
    half = F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string")).cast("binary")) % 2 == 0
    sizes = {r["toxic"]: (r["n"], r["w"]) for r in train.where(half).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("w")).collect()}
    if len(sizes) < 2:
        return model
    (n0, w0), (n1, w1) = sizes[0], sizes[1]
    stems = train.where(half).transform(in_arrow, _stem_counts, "stem string, d1 long, d0 long, t1 long, t0 long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("d1", "d0", "t1", "t0")])
    # Long-winded stems are cut on the executors; what comes here is bounded.
    picked = stems.where((F.col("d1") >= 3) & (F.col("d1") * n0 >= 2 * F.col("d0") * n1)).orderBy(F.desc(F.col("d1") / n1 - F.col("d0") / n0), "stem").limit(20 * lexicon).toPandas()
    model.terms = _pick_terms(picked, n1, n0, w1 / 6, w0 / 6, lexicon)
    # A term must prove itself on the other half, where it was not picked; what was there by chance fails.
    model.terms = _proven(model.terms, *_found(train, model.terms, half))
    (found, words, y, own), df = _found(train, model.terms, half), (Counter(), Counter())
    for f, label, mine in zip(found, y, own, strict=True):
        if mine:
            df[label].update({(t, e) for t, e, *_ in f})
    for key in df[0].keys() | df[1].keys():
        # Matches that no toxic document has weigh nothing, however few documents are toxic.
        model.weights[key] = 0.0 if not df[1][key] else float(np.clip(np.log(((df[1][key] + 0.5) / (n1 + 1)) / ((df[0][key] + 0.5) / (n0 + 1))), 0, 6))
    X = np.array([model.features([h[:3] for h in f], n) for f, n in zip(found, words, strict=True)])
    model.trees.fit(X[own], y[own])
    margin = model.trees.margin(X[~own])
    model.slope, model.offset = platt(margin, y[~own])
    p = model.slope * margin + model.offset
    model.shift = _best_cut(p, y[~own])
    return model


def _best_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """Margin with the best F1; within (-1, 1) so that scores stay near their calibration."""
    best, at = -1.0, 0.0
    for cut in np.linspace(-1, 1, 41):
        hit = margin >= cut
        f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + (y == 1).sum())
        if f1 > best + 1e-12 or f1 == best and abs(cut) < abs(at):
            best, at = f1, float(cut)
    return at


_OUT = "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_quoted long"


def _score(sent):
    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = HitTable(LexiconAutomaton(model.terms))
        for b in batches:
            rows = [hits(t or "", table) for t in b.column("text").to_pylist()]
            score = model.score(np.array([model.features(f, n) for f, n in rows])) if rows else np.zeros(0)
            columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(f) for f, _ in rows], pa.int64()), pa.array([sum(q for *_, q in f) for f, _ in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *columns], ["doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(ascii_bucket(id_col, 5) == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: doc_id, held_out, score, predicted, n_hits, n_quoted.

    Without ``model`` one is learned from ``labels`` (doc_id, toxic) of rows that are not
    held out.  Null and empty texts are scored as texts without hits; with no usable label
    every score is 0.5 or the prior.  Repeated rows get equal results; a null id is carried
    along and counts as not held out; an empty table gives no rows.  Extra columns are
    not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        model = fit(base.where(~held_out()), labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic")).where(~held_out()))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of bounded size
    return base.select("doc_id", "text", held_out().alias("held_out")).transform(in_arrow, _score(sent), _OUT)
