"""Near-duplicate components by min-max hashing, confirmed on full shingle sets.

1. Each document's set of word shingles is hashed.  Under every permutation both the
   minimum and the maximum are kept, so a signature of 2p values takes p evaluations.
   Bands alternate minima and maxima of different permutations.
2. Documents with one set are a class; its smallest id represents it, so exact copies
   never meet each other again.
3. Representatives that share a band are tied to the band's smallest id.  The connected
   families contain every true component, because any link shares a band (see `miss`).
4. Inside a family, full sets are compared: from each member found, every member not yet
   reached is checked exactly, so no link is lost and no list of pairs is made.  A large
   family is cut into chunks, and every pair of chunks is a task of bounded size.  Sets
   hold 64-bit hashes of shingles; among the k distinct shingles of a chunk pair, two
   share a hash with a chance of about k * k / 2**65.
5. The links found give the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, in_arrow, shards, stage, worker
from .components import components

_FOLD = bytes(32 if b in b"\t\n\x0b\x0c\r " else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


KEPT["near"] = _forget_powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; a shorter text is one shingle."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    solid = np.r_[False, raw != 32, False]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])]
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    k = min(words, len(word))
    out = word[: len(word) - k + 1].copy()
    for j in range(1, k):
        out = _mix(out + np.uint64(0x632BE59BD9B4E019)) + word[j : len(word) - k + 1 + j]
    return np.unique(_mix(out + np.uint64(k)))


class MinMaxHasher:
    """Band keys of shingle sets from minima and maxima of ``bands * rows / 2`` permutations."""

    def __init__(self, bands: int = 40, rows: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.perms = bands, rows, bands * rows // 2
        self.a = rng.integers(1 << 62, 1 << 63, self.perms, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bands, np.uint64)
        # Value j < perms is a minimum, perms + j a maximum; a band draws from different permutations.
        order = np.arange(2 * self.perms).reshape(2, self.perms)
        half = rows // 2
        self.pick = np.concatenate([order[0].reshape(bands, half), np.roll(order[1].reshape(bands, rows - half), 1, axis=0)], axis=1) if rows % 2 == 0 else order.reshape(-1)[: bands * rows].reshape(bands, rows)

    def signature(self, x: np.ndarray) -> np.ndarray:
        low = np.full(self.perms, np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(self.perms, np.uint64)
        for i in range(0, len(x), 2048):  # stays in the processor's cache
            part = x[i : i + 2048]
            for j in range(0, self.perms, 16):
                h = self.a[j : j + 16, None] * part[None, :]
                np.minimum(low[j : j + 16], h.min(1), out=low[j : j + 16])
                np.maximum(high[j : j + 16], h.max(1), out=high[j : j + 16])
        return np.concatenate([low, high])

    def band_keys(self, x: np.ndarray) -> np.ndarray:
        s = self.signature(x)[self.pick]
        key = self.salt.copy()
        for r in range(self.rows):
            key = _mix(key + s[:, r] * np.uint64(0x9E3779B97F4A7C15))
        return key.view(np.int64)

    def miss(self, similarity: float) -> float:
        """Chance that a pair of this similarity shares no band."""
        return (1 - similarity**self.rows) ** self.bands


def _signatures(words: int, hasher: MinMaxHasher):
    @worker("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bands = [], [], []
            for text in b.column("text").to_pylist():
                x = shingles(text, words)
                n.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                bands.append(hasher.band_keys(x) if len(x) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in bands])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "h", "n_shingles", "set_key", "bands"])

    return run


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number (smallest index) of each set; links need 100 * |A & B| >= percent * |A | B|.

    Breadth-first: from each reached set, all sets not reached yet are compared at once.
    A set in few words reaches its group in one step; what is never reached is compared
    with every member, so the answer is exact.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, flat = np.unique(flat, return_inverse=True)
    offsets = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    lists, first = owner[order], np.searchsorted(flat[order], np.arange(flat.max() + 2) if len(flat) else np.zeros(1))
    label = np.full(n, -1, np.int64)
    open_ = np.ones(n, bool)
    waiting = list(range(n - 1, -1, -1))
    while waiting:
        seed = waiting.pop()
        if not open_[seed]:
            continue
        label[seed], open_[seed] = seed, False
        frontier = [seed]
        while frontier and open_.any():
            i = frontier.pop()
            own = flat[offsets[i] : offsets[i + 1]]
            # Postings of the set's shingles: how many of them each other set has.
            spans = [lists[first[v] : first[v + 1]] for v in own]
            shared = np.bincount(np.concatenate(spans), minlength=n)
            hit = np.flatnonzero(open_ & (100 * shared >= percent * (sizes + sizes[i] - shared)) & (shared > 0))
            label[hit], open_[hit] = seed, False
            frontier.extend(hit.tolist())
    return label


def _link_chunk(words: int, percent: int):
    """Rows sorted by (family, left, right); links of each group as (u, v) to its smallest id."""

    def solve(ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        label = link_sets([shingles(texts[i], words) for i in order], percent)
        return [(ids[order[i]], ids[order[int(j)]]) for i, j in enumerate(label) if i != j]

    @worker("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, out = None, [], [], []

        def flush() -> pa.RecordBatch:
            u, v = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            for f, left, right, doc, text in zip(*(b.column(c).to_pylist() for c in ("family", "left", "right", "doc_id", "text")), strict=True):
                if (f, left, right) != key:
                    if len(ids) > 1:
                        out += solve(ids, texts)
                    key, ids, texts = (f, left, right), [], []
                    if len(out) > 8192:
                        yield flush()
                ids.append(doc)
                texts.append(text)
        if len(ids) > 1:
            out += solve(ids, texts)
        if out:
            yield flush()

    return run


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 8, chunk_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose ``words``-word shingle sets have Jaccard >= percent / 100.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable),
    kept (doc_id = component_id).  A text without words (null, empty or blank) is linked with
    nothing.  Rows that repeat an id are kept or dropped together.  A row without an id can
    only be told by its set: it is dropped for a row with an id and the same set, and else
    kept, with a null component_id.  An empty table gives an empty result; extra columns are
    not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed, classes, members = _candidates(base, words, MinMaxHasher(bands, rows))
    # Members are many at scale, so the plan is the same at every size: a shuffled join.
    texts = stage(base.join(members.hint("merge"), "doc_id").select("family", "doc_id", "text", F.length("text").cast("long").alias("size")), "near-members")
    links = components(_family_links(texts, words, percent, chunk_chars, shards(docs.sparkSession)))
    labels = classes.join(links.select(F.col("u").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 8, chunk_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``near_dedup`` keeps, whole.

    Rows are shuffled once, to meet what is known of their id and text: those in no family
    are decided there, and only members of families travel on.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    signed, classes, members = _candidates(base.select("doc_id", text.alias("text")), words, MinMaxHasher(bands, rows))
    # A row stays in the race if it represents its class; without words, or without an id in the class, it stays for good.
    known = signed.select("doc_id", "h", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key", "left")
    known = known.where("rep is null or doc_id = rep").select(F.col("doc_id").alias("k"), F.col("h").alias("k_h"), F.when(F.col("rep").isNotNull(), F.col("doc_id")).alias("racer"))
    known = known.join(members.select(F.col("doc_id").alias("racer"), "family"), "racer", "left")
    met = base.withColumn("h", F.xxhash64(text)).join(known.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("k_h")))
    met = stage(met.select("doc_id", "row", "family"), "near-rows")
    own = met.where("family is not null")
    links = components(_family_links(own.select("family", "doc_id", text.alias("text"), F.length(text).cast("long").alias("size")), words, percent, chunk_chars, shards(docs.sparkSession)))
    kept = own.join(links.select("u").hint("merge"), F.col("doc_id") == F.col("u"), "left_anti")
    return met.where("family is null").select("row").unionByName(kept.select("row")).select("row.*")


def _candidates(base: DataFrame, words: int, hasher: MinMaxHasher) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of rows, classes of equal sets, members of families) of ``base(doc_id, text)``."""
    signed = base.withColumn("h", F.xxhash64("text")).transform(in_arrow, _signatures(words, hasher), "doc_id long, h long, n_shingles long, set_key binary, bands array<long>")
    signed = stage(signed, "near-signatures")
    # Every row of a class has the same bands, so the class keeps those of any row.
    classes = stage(signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "near-classes")
    keyed = classes.where("rep is not null").select("rep", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("band", "least")
    ties = keyed.join(shared, "band").where("rep != least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    families = stage(components(ties), "near-families")  # u, component: every member but the first
    members = families.select(F.col("u").alias("doc_id"), F.col("component").alias("family")).unionByName(families.select(F.col("component").alias("doc_id"), F.col("component").alias("family")).distinct())
    return signed, classes, members


def _family_links(texts: DataFrame, words: int, percent: int, chunk_chars: int, n: int) -> DataFrame:
    """Confirmed links (u, v); families beyond ``chunk_chars`` are compared chunk by chunk."""
    large = texts.groupBy("family").agg(F.ceil(F.sum("size") / F.lit(chunk_chars)).cast("int").alias("chunks")).where("chunks > 1")
    if large.limit(50_001).count() <= 50_000:  # 12 bytes each: a size-checked broadcast
        large = F.broadcast(large)
    chunks = F.coalesce("chunks", F.lit(1))
    placed = texts.join(large, "family", "left").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    pairs = placed.withColumn("other", other).select("family", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "doc_id", "text")
    grouped = pairs.repartition(n, "family", "left", "right").sortWithinPartitions("family", "left", "right")
    return grouped.transform(in_arrow, _link_chunk(words, percent), "u long, v long")
