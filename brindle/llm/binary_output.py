"""Token ids as compressed binary blocks: static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, serves every block and is written beside
them.  A block holds whole documents; its ids are dealt round-robin to interleaved
lanes, which numpy advances together.  Blocks carry the lanes' states at checkpoints:
any stretch can be decoded on its own, and a whole block is decoded from all its
checkpoints at once.  Checksums cover a block's bytes, its ids and the table.

A folder of token files has three Parquet tables: ``blocks`` (part, block), ``table``
(symbol, freq, vocabulary) and ``parts`` (part, n_tokens).

Block layout, little-endian: magic ``BRA2``; crc32 of all that follows it; then
u32 lanes, steps, checkpoint distance, checkpoints, words, ids crc32, table crc32,
documents; u64 tokens, u64 tokens of the part before the block; i64 document ids; u8
whether each id is null; i64 document lengths; per checkpoint u64 first word and u64
states; u32 words.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, scratch_dir, shards, stage, worker
from .packing import _slices
from .tokens import END_ID, encoder

SCALE = 20  # frequencies sum to 2**SCALE
_LOW = np.uint64(1 << 31)
_MAGIC = b"BRA2"
_HEAD = struct.Struct("<8I2Q")


class FrequencyTable:
    """Counts scaled to 2**SCALE; every symbol that occurs keeps a share of one or more."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        if len(counts) > 1 << (SCALE - 1):
            raise ValueError("vocabulary too large for the table")
        total = max(1, int(counts.sum()))
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (1 << SCALE) / total).astype(np.int64)), 0)
        if not freq.any():
            freq[0] = 1
        over = int(freq.sum()) - (1 << SCALE)
        while over > 0:  # minimal shares came on top: the largest give way
            big = np.argsort(-freq, kind="stable")[: max(1, min(over, 64))]
            take = np.minimum(freq[big] - 1, max(1, over // len(big)))
            take = np.where(np.cumsum(take) <= over, take, 0)
            if not take.any():
                take[0] = min(over, int(freq[big[0]]) - 1)
            freq[big] -= take
            over -= int(take.sum())
        freq[int(np.argmax(freq))] -= over
        self._set(freq)

    @classmethod
    def of(cls, freq: np.ndarray) -> FrequencyTable:
        """A table as it was written."""
        if int(freq.sum()) != 1 << SCALE:
            raise ValueError("damaged frequency table")
        out = cls.__new__(cls)
        out._set(np.asarray(freq, np.int64))
        return out

    def _set(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.filler = int(np.argmax(freq))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """Symbol of each of the 2**SCALE slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


@dataclass
class Block:
    doc_ids: np.ndarray
    nulls: np.ndarray
    lengths: np.ndarray
    lanes: int
    steps: int
    every: int
    tokens: int
    before: int  # tokens of the part before the block
    ids_crc: int
    firsts: np.ndarray  # first word of each checkpoint
    states: np.ndarray  # checkpoints x lanes
    words: np.ndarray


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, table: FrequencyTable, lanes: int = 4096, every: int = 64, nulls: np.ndarray | None = None, before: int = 0) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, table.filler, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, _LOW, np.uint64)
    shift, low32 = np.uint64(63 - SCALE), np.uint64(0xFFFFFFFF)
    freq, start = table.freq[grid], table.start[grid]
    emitted: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # words emitted so far from the end, states
    written = 0
    for i in range(steps - 1, -1, -1):
        f, c = freq[i], start[i]
        full = x >= (f << shift)
        if full.any():
            emitted.append((x[full] & low32).astype("<u4"))
            written += len(emitted[-1])
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
        if i % every == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(emitted[::-1]) if emitted else np.zeros(0, "<u4")
    marks.reverse()
    nulls = np.zeros(len(doc_ids), np.uint8) if nulls is None else np.asarray(nulls, np.uint8)
    head = _HEAD.pack(lanes, steps, every, len(marks), len(words), zlib.crc32(np.asarray(ids, "<u4").tobytes()), table.crc, len(doc_ids), n, before)
    body = b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), nulls.tobytes(), np.asarray(lengths, "<i8").tobytes(), *(struct.pack("<Q", len(words) - w) + s.astype("<u8").tobytes() for w, s in marks), words.tobytes()])
    return _MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def read_block(raw: bytes, table: FrequencyTable) -> Block:
    """The parts of a block; raises ValueError for damage or another table."""
    if raw[:4] != _MAGIC or struct.unpack_from("<I", raw, 4)[0] != zlib.crc32(memoryview(raw)[8:]):
        raise ValueError("damaged block")
    lanes, steps, every, marks, words, ids_crc, table_crc, n_docs, n, before = _HEAD.unpack_from(raw, 8)
    if table_crc != table.crc:
        raise ValueError("block was written with another frequency table")
    at = 8 + _HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    nulls = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
    lengths = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    points = np.frombuffer(raw, "<u8", marks * (lanes + 1), at).reshape(marks, lanes + 1)
    return Block(doc_ids, nulls, lengths, lanes, steps, every, n, before, ids_crc, points[:, 0].astype(np.int64), points[:, 1:], np.frombuffer(raw, "<u4", words, at + points.nbytes))


def decode_stretches(block: Block, table: FrequencyTable, first: int, stop: int) -> np.ndarray:
    """Ids from checkpoint ``first`` to checkpoint ``stop``, padding included; all stretches advance together."""
    if first >= stop:
        return np.zeros(0, np.uint32)
    x = block.states[first:stop].astype(np.uint64)
    at = block.firsts[first:stop].copy()
    count = np.minimum(block.every, block.steps - np.arange(first, stop) * block.every)  # only the last stretch is shorter
    out = np.empty((stop - first, block.every, block.lanes), np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for i in range(int(count.max())):
        if i == count[-1] and i < count[0]:
            x, at = x[:-1], at[:-1]
        k = len(x)
        slot = x & mask
        s = table.slots[slot.astype(np.int64)]
        out[:k, i] = s
        x = table.freq[s] * (x >> scale) + slot - table.start[s]
        need = x < _LOW
        taken = need.sum(1)
        if taken.any():
            rows, lanes = np.nonzero(need)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(taken) - taken, taken) + at[rows]
            x[rows, lanes] = (x[rows, lanes] << half) | block.words[place].astype(np.uint64)
            at = at + taken
    return out.reshape(-1)[: int(count.sum()) * block.lanes]


def decode_block(block: Block, table: FrequencyTable) -> np.ndarray:
    ids = decode_stretches(block, table, 0, len(block.firsts))[: block.tokens]
    if zlib.crc32(ids.astype("<u4").tobytes()) != block.ids_crc:
        raise ValueError("ids don't match their checksum")
    return ids


def decode_range(block: Block, table: FrequencyTable, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) from the checkpoints that cover them alone."""
    span = block.every * block.lanes
    first, last = start // span, min(-(-stop // span), len(block.firsts))
    return decode_stretches(block, table, first, last)[start - first * span : min(stop, block.tokens) - first * span]


#: A row that holds a task's counts of ids, in place of a document's ids.
_COUNTS = -1
_COUNT = np.dtype([("symbol", "<u4"), ("n", "<u8")])


def _tokenized(path: str, mode: str, generation: int):
    """Ids of each text; a task's last row counts them, so that they are not read once more for that."""

    @worker("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, mode, generation)
        end = np.array([END_ID], enc.dtype).tobytes()
        counts = np.zeros(enc.vocabulary, np.int64)
        names = ["doc_id", "n_tokens", "ids"]
        for whole in batches:
            for b in _slices(whole):
                ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
                n = np.fromiter((len(x) // enc.width for x in ids), np.int64, len(ids))
                counts += np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=enc.vocabulary)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], names)
        some = np.flatnonzero(counts)
        if len(some):
            packed = np.empty(len(some), _COUNT)
            packed["symbol"], packed["n"] = some, counts[some]
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([_COUNTS], pa.int64()), pa.array([packed.tobytes()], pa.binary())], names)

    return run


@worker("tokens")
def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("ids").to_pylist():
            packed = np.frombuffer(raw, _COUNT)
            yield pa.RecordBatch.from_arrays([pa.array(packed["symbol"].astype(np.int64)), pa.array(packed["n"].astype(np.int64))], ["symbol", "n"])


def _encode(width: int, table: FrequencyTable, block_tokens: int):
    """Rows in order; a block knows how many tokens of its part stand before it."""

    @worker("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        lens: list[int] = []
        raws: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), f"<u{width}").astype(np.int64)
            raw = encode_block(ids, np.array([d or 0 for d in docs]), np.array(lens), table, nulls=np.array([d is None for d in docs]), before=before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["part", "n_tokens", "block"])

        for b in batches:
            for part_of in _slices(b):
                for d, n, raw in zip(*(part_of.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                    docs.append(d)
                    lens.append(n)
                    raws.append(raw)
                    size += n
                    if size >= block_tokens:
                        yield block()
                        before += size
                        docs, lens, raws, size = [], [], [], 0
        if docs:
            yield block()

    return run


def _decode(sent):
    @worker("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bases = sent.value
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), strict=True):
                block = read_block(raw, table)
                ids = memoryview(decode_block(block, table).astype("<u4").tobytes())
                ends = np.cumsum(block.lengths)
                crc = [zlib.crc32(ids[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, block.lengths, strict=True)]
                columns = [pa.array(block.doc_ids, mask=block.nulls), *map(pa.array, (bases[part] + block.before + ends - block.lengths, block.lengths, np.array(crc, np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str = "byte_bpe_50k.json", mode: str = "space", block_tokens: int = 1 << 19, generation: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize whole texts, count ids, and write rANS blocks in ascending doc_id order; returns their folder.

    Without ``path`` a folder of the shared scratch space is made.  Texts are tokenized
    where they lie, and only ids are sorted.  A null text counts as empty, so a document
    has its end id at least.  Rows with a null id come first; rows with equal ids stand in
    the order of a hash of their token ids.  ``generation`` bounds what a worker remembers
    of pieces (see ``tokens.encoder``).  An empty table makes files without documents.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    path = (path or f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}").rstrip("/")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    staged = stage(base.transform(in_arrow, _tokenized(tokenizer, mode, generation), "doc_id long, n_tokens long, ids binary"), "token-ids")
    enc = encoder(tokenizer, mode, generation)
    counts = np.zeros(enc.vocabulary, np.int64)
    for r in staged.where(F.col("n_tokens") == _COUNTS).select("ids").transform(in_arrow, _unpacked, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]  # a row for each id of the vocabulary at most
    table = FrequencyTable(counts)
    some = np.flatnonzero(table.freq)
    rows = [(int(k), int(table.freq[k]), len(table.freq)) for k in some]
    spark.createDataFrame(rows, "symbol long, freq long, vocabulary long").coalesce(1).write.parquet(f"{path}/table")
    # The hash lets a range boundary fall between rows of one id.
    order = ["doc_id", F.xxhash64("ids")]
    ordered = staged.where(F.col("n_tokens") != _COUNTS).repartitionByRange(shards(spark), *order).sortWithinPartitions(*order, "ids")
    ordered.transform(in_arrow, _encode(enc.width, table, block_tokens), "part int, n_tokens long, block binary").write.parquet(f"{path}/blocks")
    blocks = spark.read.schema("part int, n_tokens long").parquet(f"{path}/blocks")
    blocks.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_table(spark: SparkSession, path: str) -> FrequencyTable:
    """The frequency table of a folder of token files: one row for each id in use."""
    rows = spark.read.schema("symbol long, freq long, vocabulary long").parquet(f"{path}/table").collect()
    freq = np.zeros(max((r["vocabulary"] for r in rows), default=1), np.int64)
    for r in rows:
        freq[r["symbol"]] = r["freq"]
    return FrequencyTable.of(freq)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    table, bases, total = read_table(spark, path), {}, 0
    for r in spark.read.schema("part int, n_tokens long").parquet(f"{path}/parts").orderBy("part").collect():  # a row a part
        bases[r["part"]] = total
        total += r["n_tokens"]
    sent = spark.sparkContext.broadcast((table, bases))  # a vocabulary and a number a part
    blocks = spark.read.schema("part int, block binary").parquet(f"{path}/blocks")
    return blocks.transform(in_arrow, _decode(sent), "doc_id long, start long, n_tokens long, ids_crc32 long")
