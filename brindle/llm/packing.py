"""Packing token streams into fixed windows: concatenate and cut.

Pass one tokenizes each partition and records how many tokens every document has
before it there; the partition totals, one row per partition, are summed to global
offsets.  Pass two adds them and cuts at multiples of the window.  A document that
crosses a cut yields boundary records, one piece a window.  Nothing is shuffled
but the totals, and a row is never looked at together with another one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stage, worker
from .tokens import END_ID, encoder

_STAGED = "part int, seq long, doc_id long, before long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_boundary boolean, ids binary"


def tokenized(path: str, mode: str, generation: int = 300_000, end_id: int | None = END_ID):
    """mapInArrow body: (doc_id, text) to ids, with running totals inside the partition."""

    @worker("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, mode, generation)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for whole in batches:
            for b in _slices(whole):
                ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
                n = np.fromiter((len(x) // enc.width for x in ids), np.int64, len(ids))
                at = before + np.cumsum(n) - n
                rows = [np.full(len(ids), part, np.int32), seq + np.arange(len(ids)), b.column("doc_id"), at, n, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in rows], ["part", "seq", "doc_id", "before", "n_tokens", "ids"])
                seq, before = seq + len(ids), before + int(n.sum())

    return run


def _slices(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes, and of one row at least."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def part_offsets(staged: DataFrame) -> dict[int, int]:
    """Tokens before each partition.  One number a partition comes to the driver."""
    totals = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    out, total = {}, 0
    for part, n in totals:
        out[part], total = total, total + n
    return out


def _cut(window: int, width: int, bases):
    @worker("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for b in batches:
            out: list[tuple] = []
            for part, doc, before, n, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "before", "n_tokens", "ids")), strict=True):
                first = base[part] + before
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, window)
                    length = min(n - at, window - offset)
                    piece = ids[at : at + length].tobytes()
                    out.append((doc, at, length, zlib.crc32(piece), n, sequence, offset, length < n, piece))
                    at += length
            names = [c.split()[0] for c in _PIECES.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
            for i in range(0, len(out), 4096):
                columns = zip(*out[i : i + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", mode: str = "drop", window: int = 4096, generation: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens, the last one shorter.

    Returns one row per piece: doc_id, start (ids of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset, is_boundary (the document spans
    sequences) and ids (little-endian unsigned 32-bit).  ``generation`` bounds what a
    worker remembers of pieces (see ``tokens.encoder``).  A null or empty text is one
    end id.  Rows with equal or null doc_id are packed one by one like any other.  An
    empty table gives no pieces; columns besides the two named are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    staged = stage(base.transform(in_arrow, tokenized(tokenizer, mode, generation), _STAGED), "pack-ids")
    bases = docs.sparkSession.sparkContext.broadcast(part_offsets(staged))
    return staged.transform(in_arrow, _cut(window, encoder(tokenizer, mode, generation).width, bases), _PIECES)
