"""Language identification with bit-sliced n-gram Bloom filters.

One filter per language, all with the same size and hash functions, lie side by side:
entry ``i`` of the table is a bitmask of the languages whose filter has bit ``i`` set,
in as many 64-bit words as there are languages to tell.
Three lookups and two ANDs therefore return every language that contains an n-gram.
Per-language popcounts over all n-grams of a text are corrected for each filter's
false-positive rate; the language that explains most n-grams is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_bucket, in_arrow, stage, worker

UNDETERMINED = "und"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x = x * _M2
    x ^= x >> np.uint64(32)
    return x


def ngrams(texts: list[str], sizes: tuple[int, ...] = (3, 4)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, number per text, letters per text): n-grams of lower-cased words with one space around each."""
    n_texts = len(texts)
    joined = "\x00".join(t.lower().replace("\x00", " ") for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    edge = cp == 0
    letter = _letter_table()[cp]
    text_of = np.cumsum(edge)
    letters = np.bincount(text_of[letter], minlength=n_texts) if len(cp) else np.zeros(n_texts, np.int64)
    # Keep letters, edges, and the first of each run of other characters, as a space.
    other = ~letter & ~edge
    keep = letter | edge | (other & ~np.r_[False, other[:-1]])
    cp, edge, other, text_of = cp[keep], edge[keep], other[keep], text_of[keep]
    c = np.where(other, np.uint32(32), cp)
    # An edge stands for a space to its neighbours, but no n-gram has one inside.
    inner = np.r_[True, edge, True]
    c = np.r_[np.uint32(32), np.where(edge, np.uint32(32), c), np.uint32(32)].astype(np.uint64)
    text_of = np.r_[0, text_of, n_texts - 1]
    hashes, owners = [], []
    crossed = np.cumsum(inner)
    for n in sizes:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = c[:m].copy()
        for k in range(1, n):
            h = h * np.uint64(0x10FFFF + 0x2F) + c[k : k + m]
        inside = crossed[n - 2 : n - 2 + m] - crossed[:m] == 0  # no edge among the inner characters
        both = (c[:m] != 32) | (c[n - 1 :] != 32)  # not only the blanks around
        ok = inside & both
        hashes.append(_mix(h[ok] + np.uint64(n)))
        # An n-gram that begins at an edge belongs to the text behind it.
        owners.append(text_of[1 : m + 1][ok])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(o, kind="stable")
    return h[order], np.bincount(o, minlength=n_texts), letters


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # uint64 bitmasks: words x entries
    false_rate: np.ndarray  # of each language's filter
    home_rate: np.ndarray  # share of a language's own n-grams that its filter holds
    hashes: int = 3

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Bitmask, words x n-grams, of the languages that contain each n-gram."""
        size = np.uint64(self.table.shape[1] - 1)
        at = [((h >> np.uint64(21 * k)) & size).astype(np.int64) for k in range(self.hashes)]
        out = np.empty((len(self.table), len(h)), np.uint64)
        for w, row in enumerate(self.table):
            out[w] = row[at[0]]
            for a in at[1:]:
                out[w] &= row[a]
        return out

    def explained(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams that each language contains, corrected for false positives."""
        masks, ends = self.masks(h), np.cumsum(counts)
        out = np.zeros((len(counts), len(self.languages)))
        hits = np.zeros(len(h) + 1, np.int32)
        for k in range(len(self.languages)):
            np.cumsum((masks[k >> 6] >> np.uint64(k & 63)) & np.uint64(1), dtype=np.int32, out=hits[1:])
            pop = hits[ends] - hits[ends - counts]
            f = self.false_rate[k]
            out[:, k] = np.clip((pop - counts * f) / np.maximum(1e-9, (1 - f) * counts * self.home_rate[k]), 0, 1.5)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, explained share) of each text; score is the winner's share of the two best."""
        h, counts, letters = ngrams(texts)
        share = self.explained(h, counts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        order = np.argsort(-share, axis=1, kind="stable")
        best = share[np.arange(len(texts)), order[:, 0]]
        second = share[np.arange(len(texts)), order[:, 1]] if len(self.languages) > 1 else np.zeros(len(texts))
        known = letters > 0
        score = np.where(known & (best > 0), best / np.maximum(best + second, 1e-9), 0.0)
        return [self.languages[j] if k else UNDETERMINED for j, k in zip(order[:, 0], known, strict=True)], np.clip(score, 0, 1), np.where(known, np.minimum(best, 1.0), 0.0)


@worker("language")
def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of some texts at a time, so that memory does not follow the size of a batch."""
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for rows in _groups(own):
                h, _, _ = ngrams(own[rows])
                grams, n = np.unique(h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, per_language: int = 2500, max_grams: int = 150_000, total_grams: int = 3_000_000, bits: int = 21, table_bytes: int = 1 << 28, at_least: float = 0.08) -> LanguageFilters:
    """Filters from about ``per_language`` documents of each language, however many there are.

    ``docs`` has doc_id, text and lang of rows to learn from.  An n-gram enters a
    language's filter if it is at least ``at_least`` times as frequent there as in the
    language where it is most frequent; each filter takes its ``max_grams`` most frequent
    ones, or an equal share of ``total_grams`` if that is less (those that tie at the cut
    stay out).  A table beyond ``table_bytes`` gets fewer entries a filter, and false
    positives are corrected at the rate that follows.
    """
    rows = docs.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return LanguageFilters([], np.zeros((1, 1 << 6), np.uint64), np.zeros(0), np.ones(0))
    words = -(-len(languages) // 64)
    while bits > 12 and 8 * words << bits > table_bytes:
        bits -= 1
    most = max(1, min(max_grams, total_grams // len(languages), (1 << bits) // 12))
    shares = F.broadcast(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("share")))  # a row a language
    drawn = F.crc32(F.concat(F.lit("language:"), F.col("doc_id").cast("string")).cast("binary")) < F.col("share") * float(1 << 32)
    texts = rows.join(shares, "lang").where(drawn).select("lang", "text")
    counts = stage(texts.transform(in_arrow, _count_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).where("n > 1"), "language-grams")
    # The least count that keeps at most `most` n-grams of each language, from how often each count occurs.
    cut: dict[str, int] = {}
    taken: dict[str, int] = {}
    for r in counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("k")).orderBy("lang", F.desc("n")).collect():
        taken[r["lang"]] = taken.get(r["lang"], 0) + r["k"]
        if taken[r["lang"]] <= most:
            cut[r["lang"]] = r["n"]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(list(cut.items()), "lang string, least long"))
    pdf = counts.join(cuts, "lang").where("n >= least").select("lang", "gram", "n").toPandas()  # total_grams rows at most
    totals = pdf.groupby("lang")["n"].sum()
    pdf["rate"] = pdf["n"] / pdf["lang"].map(totals)
    peak = pdf.groupby("gram")["rate"].transform("max")
    pdf["keep"] = pdf["rate"] >= at_least * peak
    table = np.zeros((words, 1 << bits), np.uint64)
    filters = LanguageFilters(languages, table, np.zeros(len(languages)), np.ones(len(languages)))
    size = np.uint64(table.shape[1] - 1)
    for k, lang in enumerate(languages):
        own = pdf[pdf["lang"] == lang]
        h = own["gram"][own["keep"]].to_numpy().view(np.uint64)
        for j in range(filters.hashes):
            np.bitwise_or.at(table[k >> 6], ((h >> np.uint64(21 * j)) & size).astype(np.int64), np.uint64(1 << (k & 63)))
        filters.home_rate[k] = max(0.05, own["n"][own["keep"]].sum() / max(1, own["n"].sum()))
        fill = float(((table[k >> 6] >> np.uint64(k & 63)) & np.uint64(1)).mean())
        filters.false_rate[k] = fill**filters.hashes
    return filters


_OUT = "lang_pred string, score double, explained double"


def _predict(filters, carried: list[str]):
    @worker("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = filters.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for rows in _groups(texts):
                lang, score, explained = model.predict(texts[rows])
                part = b.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*map(part.column, carried), pa.array(lang, pa.string()), pa.array(score), pa.array(explained)], [*carried, "lang_pred", "score", "explained"])

    return run


def _groups(texts: list[str], limit: int = 200_000) -> Iterator[slice]:
    """Slices of about ``limit`` characters, of one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(ascii_bucket(id_col, 4) == 2, F.lit(False))


def identify(docs: DataFrame, filters: LanguageFilters | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score, explained.

    Without ``filters`` they are learned from rows of ``docs`` that are not held out.
    A null text, or one without a letter, is ``und`` with score 0; so is every text when
    nothing could be learned.  Repeated rows get equal results; a null id is carried
    along and counts as not held out; an empty table gives no rows.  Extra columns
    are not read, and lang is read for learning only.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    if filters is None:
        filters = fit(base.where(~held_out() & F.col("doc_id").isNotNull()))
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # at most table_bytes at any size of input
    rows = base.select("doc_id", held_out().alias("held_out"), "text")
    return rows.transform(in_arrow, _predict(sent, ["doc_id", "held_out"]), f"doc_id long, held_out boolean, {_OUT}")


def drop_unexplained(docs: DataFrame, least: float = 0.3, filters: LanguageFilters | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs``, whole, with a letter and a language that explains ``least`` of their n-grams.

    Rows pass through the prediction, so nothing is shuffled, and each is judged by its own
    text, whatever its id.  If no language can be learned nothing is known, and all stay.
    """
    if filters is None:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        filters = fit(base.where(~held_out() & F.col("doc_id").isNotNull()))
    if not filters.languages:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    judged = rows.transform(in_arrow, _predict(sent, ["row"]), f"row {rows.schema['row'].dataType.simpleString()}, {_OUT}")
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("explained") >= least)).select("row.*")
