"""Removal of long repeated byte strings with suffix arrays.

A byte goes if some ``length``-byte string over it also starts anywhere else.  Beside
that, bytes are counted that stand in a passage: a string of ``passage`` bytes that also
stands in another document.

1. Every window of the shorter of the two lengths has a minimizer, the least hash of its
   ``gram``-byte strings.  Successive windows with one minimizer form a segment, whose
   bytes reach as far as the longer length.  Equal windows have equal minimizers, so
   they can only meet inside the segments of one minimizer.
2. Minimizers with one segment alone, in which they occur once, cannot hold a repeat.
   The others' segments are cut out of their texts; a task sends equal bytes at most
   three times, which is enough to see that they recur, and in another document.
3. Segments are dealt to shards by minimizer.  A shard's suffix array is built by
   Larsson-Sadakane refinement, its common prefixes by Kasai's algorithm; windows whose
   common prefix is long enough are repeated.  A minimizer with too many bytes for one
   shard is split, and each two of its shards are merged by binary search in the other's
   suffix array.
4. Repeated windows go back to their documents by minimizer and a hash of the segment's
   bytes.  Bytes under one hash are compared wherever they meet; if any differ, all is
   done again under another hash, so no result rests on a hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, shards, stage, worker
from .near_dedup import _mix, _power_tables


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` (values below 512) in order of their first ``depth`` symbols or more.

    Larsson-Sadakane: after packing the first ``h`` symbols, only groups that are still tied
    are sorted again, by the rank of the suffix ``h`` places on; ``h`` doubles each round.
    """
    n = len(codes)
    # As many symbols in a 63-bit key as the symbols that occur allow.
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    dense = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint64)
    dense[used] = np.arange(1, len(used) + 1)
    bits = max(1, int(len(used)).bit_length())
    h = 63 // bits
    padded = np.zeros(n + h, np.uint64)
    padded[:n] = dense[codes]
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(bits)) | padded[k : k + n]
    sa = np.argsort(key).astype(np.int32)
    sorted_key = key[sa]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    del key, sorted_key, padded
    rank = np.zeros(n + 1, np.int32)  # the last entry, 0, stands for the end

    def regroup(at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Ranks of ``sa[at]`` from group starts, and which places are still tied."""
        # A group is named by its first place.
        rank[sa[at]] = np.maximum.accumulate(np.where(first, at + 1, 0))
        return ~(first & np.r_[first[1:], True])

    at = np.arange(n, dtype=np.int32)
    tied = regroup(at, new) if n else new
    while h < depth:
        at = at[tied]
        if not len(at):
            break
        pos = sa[at]
        both = (rank[pos].astype(np.int64) << 32) | rank[np.minimum(pos + h, n)]
        order = np.argsort(both)
        sa[at] = pos[order]
        both = both[order]
        tied = regroup(at, np.r_[True, both[1:] != both[:-1]])
        h *= 2
    return sa


def common_prefixes(codes: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Kasai: for each text position, symbols shared with its predecessor in ``sa``, at most ``cap``.

    The text is cut in lanes that advance together; inside a lane the length falls by one
    at most from a position to the next, as in the sequential algorithm.
    """
    n = len(codes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    text = np.r_[codes.astype(np.int32), np.full(cap + 1, -1, np.int32)]
    other = np.r_[codes.astype(np.int32), np.full(cap + 1, -2, np.int32)]
    step = -(-n // lanes)
    i = np.arange(0, n, step)
    stop = np.minimum(i + step, n)
    h = np.zeros(len(i), np.int64)
    j = before[i]
    while len(i):
        more = (j >= 0) & (h < cap)
        more &= text[i + h] == other[np.maximum(j, 0) + h]
        h = h + more
        done = ~more
        at = i[done]
        out[at] = h[done]
        i = i + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        live = i < stop
        if not live.all():
            i, h, stop = i[live], h[live], stop[live]
        j = before[i]
        h = np.where(j < 0, 0, h)
    return out


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all parts, each followed by 0, and where each part starts."""
    sizes = np.array([len(p) + 1 for p in parts])
    codes = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes)
    codes[ends - 1] = 0
    return codes, ends - sizes


@dataclass
class Part:
    """Bytes of a segment, its windows, and the first and last document that it was met in; ``again``: more than once."""

    windows: int
    raw: bytes
    low: int
    high: int
    again: bool = False
    side: int = 0

    def meet(self, doc: int) -> None:
        self.low, self.high, self.again = min(self.low, doc), max(self.high, doc), True


class Shard:
    """Suffix array and common prefixes over parts; windows start at the first places of each."""

    def __init__(self, parts: list[Part], cap: int):
        self.parts = parts
        self.codes, self.starts = _joined([p.raw for p in parts])
        sizes = np.array([len(p.raw) + 1 for p in parts])
        self.owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        place = np.arange(len(self.codes)) - self.starts[self.owner]
        counts = np.array([p.windows for p in parts])
        self.room = np.where(place < counts[self.owner], sizes[self.owner] - 1 - place, -1).astype(np.int32)  # bytes behind each window start
        self.sa = suffix_array(self.codes, len(self.codes))  # Kasai needs the full order
        self.prefix = common_prefixes(self.codes, self.sa, cap)[self.sa]
        self.met = np.array([(p.low, p.high, 1 + p.again) for p in parts], np.int64).reshape(-1, 3)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places in order, group of each; first and last document and number of each group); a group's windows are equal."""
        at = np.flatnonzero(self.room[self.sa] >= length)
        order = self.sa[at]
        if not len(at):
            return order, at, at, at, at
        # What two windows share is the least of the prefixes between them.
        shared = np.minimum.reduceat(self.prefix[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else np.zeros(0, np.int64)
        first = np.r_[True, shared < length]
        met = self.met[self.owner[order]]
        starts = np.flatnonzero(first)
        return order, np.cumsum(first) - 1, np.minimum.reduceat(met[:, 0], starts), np.maximum.reduceat(met[:, 1], starts), np.add.reduceat(met[:, 2], starts)

    def per_part(self, order: np.ndarray, hit: np.ndarray) -> list[np.ndarray]:
        flags = np.zeros(len(self.codes), bool)
        flags[order[hit]] = True
        return [flags[s : s + p.windows] for s, p in zip(self.starts.tolist(), self.parts, strict=True)]

    def repeats(self, length: int) -> list[np.ndarray]:
        """Per part, whether the window at each start occurs anywhere else."""
        order, group, _, _, number = self.windows(length)
        return self.per_part(order, (number > 1)[group])

    def shared(self, length: int) -> list[np.ndarray]:
        """Per part, whether the window at each start occurs in another document."""
        order, group, low, high, _ = self.windows(length)
        return self.per_part(order, (low != high)[group])

    def found_in(self, other: Shard, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per part, whether each window occurs in ``other``, and whether there or here in another document."""
        order, group, low, high, _ = self.windows(length)
        there, their_group, their_low, their_high, _ = other.windows(length)
        # One window of each group is sought; all searches halve their range together.
        heads = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])] if len(order) else order
        place = _search_all(other.codes, there, self.codes, heads, length)
        hit = place >= 0
        apart = np.zeros(len(heads), bool)
        if hit.any():
            g = their_group[place[hit]]
            apart[hit] = (np.minimum(their_low[g], low[hit]) != np.maximum(their_high[g], high[hit]))
        return self.per_part(order, hit[group]), self.per_part(order, apart[group])


def _search_all(codes: np.ndarray, sa: np.ndarray, text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Where in ``sa`` a window of ``codes`` equals text[at : at + length]; -1 if none does."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    found = np.full(len(at), -1, np.int64)
    live = np.arange(len(at)) if len(sa) else np.zeros(0, np.int64)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less, equal = _compare(codes, sa[mid], text, at[live], length)
        found[live[equal]] = mid[equal]
        low[live] = np.where(less, mid + 1, low[live])
        high[live] = np.where(less, high[live], mid)
        live = live[~equal & (low[live] < high[live])]
    return found


def _compare(codes: np.ndarray, at: np.ndarray, text: np.ndarray, to: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes[at:] < text[to:], equal) over ``length`` symbols."""
    less, live = np.zeros(len(at), bool), np.arange(len(at))
    k = 0
    while k < length and len(live):
        span = min(16, length - k)
        x = codes[at[live, None] + np.arange(k, k + span)]
        y = text[to[live, None] + np.arange(k, k + span)]
        differ = x != y
        some = differ.any(1)
        first = differ.argmax(1)
        rows = np.arange(len(live))
        less[live[some]] = (x[rows, first] < y[rows, first])[some]
        live = live[~some]
        k += span
    equal = np.zeros(len(at), bool)
    equal[live] = True
    return less, equal


def _content(sums: np.ndarray, down: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of raw[first:stop] from prefix sums of the rolling hash."""
    return _mix((sums[stop] - sums[first]) * down[first] + _mix((stop - first).astype(np.uint64)))


def _minimizers(raw: np.ndarray, short: int, reach: int, gram: int, salt: int = 0, hash_bits: int = 64) -> tuple[np.ndarray, ...]:
    """Segments of a text: first window, windows, end of its bytes, minimizer, content hash, folds.

    ``folds`` tells whether the minimizer occurs more than once in the segment; only then
    can two windows of it be equal.  With a ``salt`` contents are hashed by BLAKE2.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < short:
        return none, none, none, none, none, np.zeros(0, bool)
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width, windows = short - gram + 1, n - short + 1
    blocks = -(-len(h) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = h
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, windows])
    stop = np.minimum(first + count - 1 + reach, n)
    if salt:
        key = salt.to_bytes(8, "little")
        content = np.array([int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8, key=key).digest(), "little") for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.uint64)
    else:
        content = _content(sums, down, first, stop) >> np.uint64(64 - hash_bits)
    value = least[first]
    ends = first + count + width - 1
    twice = [c > 1 and np.count_nonzero(h[s:e] == v) > 1 for s, e, c, v in zip(first.tolist(), ends.tolist(), count.tolist(), value, strict=True)]
    return first, count, stop, value.view(np.int64), content.view(np.int64), np.array(twice, bool)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _segments(short: int, reach: int, gram: int, salt: int, hash_bits: int):
    @worker("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, parts, size = [], [], 0

            def rows() -> pa.RecordBatch:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *map(pa.array, columns)], ["key", "at", "windows", "stop", "anchor", "content", "folds"])

            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                part = _minimizers(_bytes(text), short, reach, gram, salt, hash_bits)
                keys += [key] * len(part[0])
                parts.append(part)
                size += len(part[0])
                if size >= 50_000:
                    yield rows()
                    keys, parts, size = [], [], 0
            if size:
                yield rows()

    return run


_PART = ["anchor", "content", "windows", "doc", "bytes"]
_PART_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _cut_out(remember: int = 20_000):
    """Bytes of a text's segments.  A task sends equal bytes twice, and once more if only then in another text."""

    @worker("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}  # (minimizer, content): bytes, document, times sent, in two documents
        for b in batches:
            out: list[tuple] = []
            for doc, text, segments in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "segments")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for s in segments:
                    pair, part = (s["anchor"], s["content"]), raw[s["at"] : s["stop"]]
                    known = seen.get(pair)
                    if known is None:
                        if len(seen) >= remember:
                            seen.clear()
                        seen[pair] = [part, doc, 1, False]
                    elif known[0] == part:
                        apart = doc != known[1]
                        if known[2] > 1 and (known[3] or not apart):
                            continue
                        known[2] += 1
                        known[3] |= apart
                    # Other bytes under this hash are sent each time: the shard must see them.
                    out.append((*pair, s["windows"], doc, part))
                if len(out) > 2048:
                    yield _rows(out, _PART, _PART_KINDS)
                    out = []
            if out:
                yield _rows(out, _PART, _PART_KINDS)

    return run


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_RUNS = pa.list_(pa.int64())


def _covered(repeated: np.ndarray, length: int) -> list[int]:
    """[from, to, from, to, ...] of the bytes that repeated windows cover."""
    edges = np.flatnonzero(np.diff(np.r_[False, repeated, False].astype(np.int8)))
    out: list[int] = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if out and s <= out[-1]:
            out[-1] = e + length - 1
        else:
            out += [s, e + length - 1]
    return out


_FOUND = ["anchor", "content", "removed", "shared"]
_FOUND_KINDS = [pa.int64(), pa.int64(), _RUNS, _RUNS]


class CollisionError(Exception):
    """Different bytes were met under one hash."""


def _search(length: int, passage: int, chunk_bytes: int):
    """Rows sorted by (anchor, left, right): suffix arrays over whole minimizers, or over two split shards.

    A row with null runs tells that different bytes met under its hash.
    """
    cap = max(length, passage)

    @worker("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], Part] = {}  # by minimizer and content
        batch: dict[tuple[int, int], Part] = {}
        key, size = None, 0

        def emit(pairs: Iterable[tuple[int, int]], removed: list[np.ndarray], shared: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = [(*pair, _covered(r, length), _covered(s, passage)) for pair, r, s in zip(pairs, removed, shared, strict=True) if r.any() or s.any()]
            if rows:
                yield _rows(rows, _FOUND, _FOUND_KINDS)

        def whole() -> Iterator[pa.RecordBatch]:
            if batch:
                one = Shard(list(batch.values()), cap)
                yield from emit(batch, one.repeats(length), one.shared(passage))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if key is None:
                return
            _, left, right = key
            if left == right:  # one shard; small ones share a suffix array
                if len(group) == 1 and (p := next(iter(group.values()))).again:
                    # The same bytes twice and nothing else, compared byte by byte: all windows are repeated.
                    places = np.arange(p.windows)
                    size -= len(p.raw)
                    yield from emit(group, [places <= len(p.raw) - length], [(places <= len(p.raw) - passage) & (p.low != p.high)])
                else:
                    batch.update(group)
                return
            sides = [{k: p for k, p in group.items() if p.side == side} for side in (left, right)]
            if all(sides):
                a, b = (Shard(list(s.values()), cap) for s in sides)
                for pairs, one, other in ((sides[0], a, b), (sides[1], b, a)):
                    removed, _ = one.found_in(other, length)
                    _, shared = one.found_in(other, passage)
                    yield from emit(pairs, removed, shared)

        for b in batches:
            for anchor, left, right, chunk, content, windows, doc, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "left", "right", "chunk", "content", "windows", "doc", "bytes")), strict=True):
                if (anchor, left, right) != key:
                    yield from close()
                    key, group = (anchor, left, right), {}
                    if size >= chunk_bytes:
                        yield from whole()
                        batch, size = {}, 0
                known = group.get((anchor, content))
                if known is None:
                    group[anchor, content] = Part(windows, raw, doc, doc, side=chunk)
                    size += len(raw)
                elif known.raw != raw:
                    yield _rows([(anchor, content, None, None)], _FOUND, _FOUND_KINDS)
                else:
                    known.meet(doc)
        yield from close()
        yield from whole()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            removed = _union((r["from"], r["to"]) for r in runs or () if r["gone"])
            shared = _union((r["from"], r["to"]) for r in runs or () if not r["gone"])
            kept, at = [], 0
            for start, stop in removed:
                kept.append(raw[at:start])
                at = stop
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((doc, len(raw), sum(e - s for s, e in removed), len(removed), hashlib.sha256(rest).hexdigest(), sum(e - s for s, e in shared), rest))
        if out:
            yield _rows(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"], [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()])


def _union(spans) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover together."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 256, gram: int = 32, chunk_bytes: int = 2_000_000, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the bytes of strings of ``length`` bytes that start more than once in all of them.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256, n_shared (bytes in strings of ``passage`` bytes, about 50 words, that
    also stand in another document, which stay if no longer string repeats), kept (the
    remaining bytes).  A null text counts as empty.  Rows that repeat a text lose all of it
    if it has ``length`` bytes; rows with the same id and text are one document for
    ``n_shared``.  ``hash_bits`` are the bits of the first content hash.  A null id is carried along; an empty table gives no rows; extra columns
    are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")).cast("binary"))))
    for salt in range(8):
        try:
            runs = _runs(base, length, passage, gram, chunk_bytes, salt, hash_bits)
            break
        except CollisionError:
            continue
    else:
        raise RuntimeError("every hash of contents collided")
    return base.join(runs, "key", "left").select("doc_id", "text", "runs").transform(in_arrow, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary")


def _runs(base: DataFrame, length: int, passage: int, gram: int, chunk_bytes: int, salt: int, hash_bits: int) -> DataFrame:
    """(key, runs) of texts with something to remove or shared; raises CollisionError."""
    short, reach = min(length, passage), max(length, passage)
    segments = base.select("key", "text").transform(in_arrow, _segments(short, reach, gram, salt, hash_bits), "key binary, at long, windows long, stop long, anchor long, content long, folds boolean")
    segments = stage(segments, "suffix-segments")
    contents = segments.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("stop") - F.col("at")).alias("size"), F.max("folds").alias("folds"))
    anchors = contents.groupBy("anchor").agg(F.sum("n").alias("n"), F.max("folds").alias("folds"), F.sum("size").alias("bytes"))
    hard = stage(anchors.where((F.col("n") > 1) | F.col("folds")).select(F.col("anchor").alias("hard"), F.ceil(F.col("bytes") / chunk_bytes).cast("int").alias("chunks")), "suffix-hard")
    met = segments.drop("folds").join(hard.hint("merge"), F.col("anchor") == F.col("hard")).drop("hard")
    met = stage(met, "suffix-met")
    per_text = met.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("at", "windows", "stop", "anchor", "content")).alias("segments"))
    cut = base.join(per_text.hint("merge"), F.col("key") == F.col("k")).select(F.xxhash64("key").alias("doc"), "text", "segments")
    parts = cut.transform(in_arrow, _cut_out(), "anchor long, content long, windows long, doc long, bytes binary")
    found = stage(_shard_search(parts, hard, length, passage, chunk_bytes), "suffix-found")
    if not found.where("removed is null").isEmpty():
        raise CollisionError
    found = found.select(F.col("anchor").alias("a"), F.col("content").alias("c"), "removed", "shared")

    def spans(runs: str, gone: bool):
        steps = F.sequence(F.lit(0), (F.size(runs) / 2).cast("int") - 1)
        made = F.transform(steps, lambda i: F.struct((F.col("at") + F.col(runs)[i * 2]).alias("from"), (F.col("at") + F.col(runs)[i * 2 + 1]).alias("to"), F.lit(gone).alias("gone")))
        return F.when(F.size(runs) > 0, made).otherwise(F.array().cast("array<struct<from:bigint,to:bigint,gone:boolean>>"))

    hits = met.join(found.hint("merge"), (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c")))
    hits = hits.select("key", F.explode(F.concat(spans("removed", True), spans("shared", False))).alias("r"))
    return hits.groupBy("key").agg(F.collect_set("r").alias("runs"))


def _shard_search(parts: DataFrame, hard: DataFrame, length: int, passage: int, chunk_bytes: int, most: int = 50_000) -> DataFrame:
    """Deal segments to shards; minimizers beyond ``chunk_bytes`` become several shards, searched two by two."""
    spark = parts.sparkSession
    large = hard.where("chunks > 1")
    if large.limit(most + 1).count() <= most:  # 16 bytes each: a size-checked broadcast
        large = F.broadcast(large)
    placed = parts.join(large, F.col("anchor") == F.col("hard"), "left")
    chunks = F.coalesce("chunks", F.lit(1))
    placed = placed.withColumn("chunk", F.pmod(F.col("content"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pairs = placed.select("anchor", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "content", "windows", "doc", "bytes")
    dealt = pairs.repartition(shards(spark), "anchor", "left", "right").sortWithinPartitions("anchor", "left", "right", "content")
    return dealt.transform(in_arrow, _search(length, passage, chunk_bytes), "anchor long, content long, removed array<long>, shared array<long>")
