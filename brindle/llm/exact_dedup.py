"""Exact deduplication with a log-structured merge index.

Every map task fills a memtable with (digest, smallest id, count), flushes it as
sorted runs, and so pre-aggregates before anything is shuffled: a text that makes
up a third of all rows becomes one run entry per task.  Runs meet in digest shards,
where compaction merges them and keeps the smallest identifier.  A hit is a
document whose digest belongs to a group; its bytes are compared with those of the
row that stays, and texts that only share a digest are split into groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, dealt_anew, in_arrow, shards, stage, worker

_KEY = np.dtype("S32")
_RUN = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


class Bloom:
    """Filter of one sorted run; digests are uniform, so their own words serve as hashes."""

    def __init__(self, keys: np.ndarray, bits_per_key: int = 10, hashes: int = 4):
        self.mask = np.uint64((1 << max(6, int(max(1, len(keys)) * bits_per_key - 1).bit_length())) - 1)
        self.hashes = hashes
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for h in self._positions(keys):
            np.bitwise_or.at(self.bits, h >> 3, (1 << (h & 7)).astype(np.uint8))

    def _positions(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        words = keys.view(np.uint64).reshape(len(keys), 4)
        for k in range(self.hashes):
            yield (words[:, k] & self.mask).astype(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for h in self._positions(keys):
            out &= (self.bits[h >> 3] >> (h & 7)) & 1 == 1
        return out


class Run:
    """An immutable sorted run of distinct digests."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.keys, self.ids, self.counts = keys, ids, counts
        self.filter = Bloom(keys)

    @staticmethod
    def sort(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, ids, counts = keys[order], ids[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.minimum.reduceat(ids, first) if len(first) else ids, np.add.reduceat(counts, first) if len(first) else counts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1; the filter spares most absent keys the binary search."""
        at = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.filter.may_hold(keys))
        if len(maybe) and len(self.keys):
            pos = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            hit = self.keys[pos] == keys[maybe]
            at[maybe[hit]] = pos[hit]
        return at


class LsmIndex:
    """Memtable plus sorted runs; ``compact`` merges runs of similar size."""

    def __init__(self, memtable_rows: int = 200_000, fan_in: int = 4):
        self.memtable_rows, self.fan_in = memtable_rows, fan_in
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending_rows = 0
        self.runs: list[Run] = []

    def put(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, ids, counts))
        self.pending_rows += len(keys)
        if self.pending_rows >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        if not self.pending_rows:
            self.pending = []
            return
        keys, ids, counts = Run.sort(*(np.concatenate(x) for x in zip(*self.pending, strict=True)))
        self.pending, self.pending_rows = [], 0
        for run in self.runs:  # entries that an older run has are folded into it
            at = run.find(keys)
            hit = at >= 0
            if hit.any():
                run.ids[at[hit]] = np.minimum(run.ids[at[hit]], ids[hit])
                run.counts[at[hit]] += counts[hit]
                keys, ids, counts = keys[~hit], ids[~hit], counts[~hit]
        if len(keys):
            self.runs.append(Run(keys, ids.copy(), counts.copy()))
        if len(self.runs) >= self.fan_in:
            self.compact()

    def compact(self) -> None:
        if len(self.runs) > 1:
            parts = zip(*((r.keys, r.ids, r.counts) for r in self.runs), strict=True)
            self.runs = [Run(*Run.sort(*(np.concatenate(x) for x in parts)))]

    def items(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.flush()
        self.compact()
        for r in self.runs:
            yield r.keys, r.ids, r.counts


def _batches(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), rows):
        raw = keys[i : i + rows].tobytes()
        n = len(raw) // 32
        offsets = pa.py_buffer(np.arange(0, 32 * (n + 1), 32, dtype=np.int32))
        digest = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([digest, pa.array(ids[i : i + rows]), pa.array(counts[i : i + rows])], schema=_RUN)


def _keys(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(32))
    raw = fixed.buffers()[1]
    return np.frombuffer(raw, _KEY, count=len(fixed), offset=32 * fixed.offset) if len(fixed) else np.zeros(0, _KEY)


# A byte string dtype drops trailing NULs when single values are taken out, but sorting,
# comparison and tobytes() of whole arrays keep all 32 bytes, which is all that is used here.


def _memtables(memtable_rows: int):
    @worker("exact")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pre-aggregates a map task; sorted runs leave whenever the memtable is full."""
        table: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            table.append((_keys(b.column("digest")), ids, np.ones(len(ids), np.int64)))
            rows += len(ids)
            if rows >= memtable_rows:
                yield from _batches(*Run.sort(*(np.concatenate(x) for x in zip(*table, strict=True))))
                table, rows = [], 0
        if rows:
            yield from _batches(*Run.sort(*(np.concatenate(x) for x in zip(*table, strict=True))))

    return run


def _merge(memtable_rows: int):
    @worker("exact")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(memtable_rows)
        for b in batches:
            index.put(_keys(b.column("digest")), b.column("keep_id").to_numpy(), b.column("n").to_numpy())
        for part in index.items():
            yield from _batches(*part)

    return run


def normalised(text):
    """``text`` (null: empty) with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def build_index(docs: DataFrame, memtable_rows: int = 200_000) -> DataFrame:
    """One row (digest, keep_id, n) per distinct ``digest`` of ``docs(doc_id, digest)``."""
    runs = docs.select("doc_id", "digest").transform(in_arrow, _memtables(memtable_rows), "digest binary, keep_id long, n long")
    return runs.repartition(shards(docs.sparkSession), "digest").transform(in_arrow, _merge(memtable_rows), "digest binary, keep_id long, n long")


#: Stands for a missing id inside the index, so that any real one is smaller.
_NO_ID = (1 << 63) - 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 200_000) -> DataFrame:
    """Groups of equal normalised texts.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Null texts count as empty and form one group with empty ones.  A repeated row
    (same id, same text) counts in ``group_size`` and is kept with its twin, as both
    carry the smallest id.  A missing id is larger than any other: its row is dropped
    if an equal text has an id, and otherwise kept with a null ``keep_id`` (the largest
    64-bit number means a missing id as well).  An empty table gives an empty result;
    columns besides the two named are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = _groups(base, F.col("text"), [], memtable_rows)
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), real("keep_id").alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 200_000) -> DataFrame:
    """Rows of ``docs`` without exact copies: of equal normalised texts one row with the smallest id stays.

    Whole rows travel with their digest, so texts are shuffled once.  Rows with the same
    id and text leave one; rows without an id leave one if no equal text has an id.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = _groups(base, F.col("row")[text_col], ["row"], memtable_rows).where("doc_id = keep_id")
    once = out.where("group_size = 1").select("row").unionByName(out.where("group_size > 1").dropDuplicates(["digest", "keep_id"]).select("row"))
    return once.select("row.*")


def _groups(base: DataFrame, text, carried: list[str], memtable_rows: int) -> DataFrame:
    """(doc_id, keep_id, group_size, digest, *carried) of every row; missing ids are ``_NO_ID``."""
    base = base.withColumns({"doc_id": F.coalesce("doc_id", F.lit(_NO_ID)), "digest": F.unhex(F.sha2(normalised(text).cast("binary"), 256))})
    index = build_index(base, memtable_rows)
    many = F.col("n") > 1
    # Texts travel once to their digest's shard; only those of real groups are kept for the byte check.
    joined = stage(base.join(index, "digest").select("doc_id", "digest", "keep_id", "n", F.when(many, normalised(text)).alias("norm"), *carried), "exact-hits")
    alone = joined.where(~many).select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest", *carried)
    hits = joined.where(many)
    keepers = hits.where("doc_id = keep_id").groupBy("keep_id", "digest").agg(F.min("norm").alias("keep_norm"))
    same = F.col("norm") == F.col("keep_norm")
    checked = hits.join(dealt_anew(keepers, "keep_id"), ["keep_id", "digest"]).select("doc_id", "keep_id", "n", "digest", same.alias("same"), F.when(~same, F.col("norm")).alias("norm"), *carried)
    checked = stage(checked, "exact-checked")
    settled = checked.where("same").select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest", *carried)
    if not checked.where("not same").isEmpty():
        settled = _split_collisions(checked, carried)
    return alone.unionByName(settled)


def _split_collisions(checked: DataFrame, carried: list[str]) -> DataFrame:
    """Different texts under one digest: each text becomes a group of its own."""
    other = checked.where("not same")
    groups = other.groupBy("digest", "norm").agg(F.min("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    moved = other.join(groups, ["digest", "norm"]).select("doc_id", F.col("own_keep").alias("keep_id"), F.col("own_n").alias("group_size"), "digest", *carried)
    gone = other.groupBy("keep_id", "digest").agg(F.count(F.lit(1)).alias("gone"))
    stay = checked.where("same").join(gone, ["keep_id", "digest"], "left")
    return stay.select("doc_id", "keep_id", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"), "digest", *carried).unionByName(moved)
