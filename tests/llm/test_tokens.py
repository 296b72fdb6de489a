from __future__ import annotations

import os
import subprocess
import sys
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import binary_output as B
from brindle.llm.packing import pack
from brindle.llm.tokens import PieceEncoder, encoder, tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@lru_cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def reference(name, text):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "mode"), [(BYTE, "space"), (WORD, "drop")])
def test_pieces_equal_library(name, mode):
    enc = PieceEncoder(name, mode, generation=40)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(st.sampled_from([*" \n\t\r\x00\x1c\xa0ab'sté.,1²Σ中́<|>_", "<|endoftext|>", "<|StartOfText|>", ", ", ". "]), max_size=14).map("".join), max_size=4))
    def check(texts):
        want = [np.array(library(name).encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
        assert enc.encode(texts) == want

    check()


def test_pack_equals_library(small_docs, texts):
    rows = pack(small_docs, window=512).collect()
    ids = {d: reference(WORD, t) for d, t in texts.items()}
    seen = {d: 0 for d in ids}
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        assert r.is_boundary == (r.length < r.doc_tokens)
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in ids.items()}
    fill: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.setdefault(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] += r.length
    assert all(n == 512 for s, n in fill.items() if s != max(fill)) and sorted(fill) == list(range(len(fill)))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pack(odd_docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.start == 0 for r in rows) == 11
    assert pack(no_docs).count() == 0
    files = B.write_token_files(odd_docs, block_tokens=1000)
    got = B.read_token_files(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    want, at = [], 0
    for r in odd_docs.orderBy("doc_id", "text").collect():
        ids = reference(BYTE, r.text)
        want.append((at, len(ids), crc(ids)))
        at += len(ids)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert B.read_token_files(spark, B.write_token_files(no_docs)).count() == 0


def test_files_equal_library(spark, small_docs, texts):
    got = {r.doc_id: r for r in B.read_token_files(spark, B.write_token_files(small_docs, block_tokens=20_000)).collect()}
    at = 0
    for d in sorted(texts):
        ids = reference(BYTE, texts[d])
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("n", [1, 63, 64, 1000, 40_000])
def test_block_round_trip_and_ranges(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000)
    table = B.FrequencyTable(np.bincount(ids, minlength=5001))
    assert int(table.freq.sum()) == 1 << B.SCALE and (table.freq[np.unique(ids)] > 0).all()
    raw = B.encode_block(ids, np.array([7]), np.array([n]), table, lanes=32, every=16)
    block = B.read_block(raw, table)
    assert (B.decode_block(block, table) == ids).all()
    for a, b in ((0, n), (n // 3, n // 2), (n - 1, n)):
        assert (B.decode_range(block, table, a, b) == ids[a:b]).all()
    for k in (5, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError, match="damaged"):
            B.read_block(raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :], table)
    with pytest.raises(ValueError, match="table"):
        B.read_block(raw, B.FrequencyTable(np.ones(10)))


def test_special_spellings_are_special_tokens(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|startoftext|>a, b.<|endoftext|>"), (3, "<|ENDOFTEXT|> x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in B.read_token_files(spark, B.write_token_files(docs)).collect()}
    packed = {r.doc_id: r for r in pack(docs).collect()}
    for d, t in rows:
        assert (got[d].n_tokens, got[d].ids_crc32) == (len(reference(BYTE, t)), crc(reference(BYTE, t)))
        assert (packed[d].doc_tokens, packed[d].ids_crc32) == (len(reference(WORD, t)), crc(reference(WORD, t)))
    assert 50256 in reference(BYTE, rows[0][1]) and 49406 in reference(WORD, rows[1][1])


def test_files_are_read_by_a_fresh_process(spark, small_docs, tmp_path):
    path = f"file://{tmp_path}/files"
    B.write_token_files(small_docs, path, block_tokens=50_000)
    want = sorted(map(tuple, B.read_token_files(spark, path).collect()))
    code = (
        "import sys; from pyspark.sql import SparkSession; from brindle.llm.binary_output import read_token_files\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', sorted(map(tuple, read_token_files(s, sys.argv[1]).collect())))"
    )
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, env=env, timeout=300, cwd=tmp_path)
    assert f"ROWS {want}" in out.stdout, out.stderr[-2000:]


def test_equal_ids_keep_all_rows(spark):
    docs = spark.createDataFrame([(7, f"text {i % 50}") for i in range(400)], "doc_id long, text string")
    got = B.read_token_files(spark, B.write_token_files(docs, block_tokens=100)).orderBy("start").collect()
    assert len(got) == 400 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_frequency_table_with_many_rare_symbols():
    counts = np.ones(50_000, np.int64)
    counts[0] = 10**12
    t = B.FrequencyTable(counts)
    assert int(t.freq.sum()) == 1 << B.SCALE and int(t.freq.min()) == 1
    assert int(B.FrequencyTable(np.zeros(5)).freq.sum()) == 1 << B.SCALE


def test_compression_beats_two_bytes(texts):
    enc = encoder(BYTE, "space")
    ids = np.frombuffer(b"".join(enc.encode(list(texts.values()))), enc.dtype).astype(np.int64)
    table = B.FrequencyTable(np.bincount(ids, minlength=enc.vocabulary))
    assert len(B.encode_block(ids, np.array([0]), np.array([len(ids)]), table)) < 1.6 * len(ids)
