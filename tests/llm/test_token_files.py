import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import tokens as T  # noqa: E402

NAME = "byte_bpe_50k.json"


@pytest.mark.parametrize("n", [1, 5, 513, 70000])
def test_codes_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50257, n).astype(np.uint32)
    ids[rng.random(n) < 0.3] %= 200
    ids[n // 2] = 1 << 30
    chunks, bitmaps, ranks = T.dac_encode(ids)
    assert (T.dac_decode(chunks, bitmaps) == ids).all()
    at = rng.permutation(n)
    assert (T.dac_get(chunks, bitmaps, ranks, at) == ids[at]).all()


def test_pieces_equal_whole_encoding():
    encode = T.encoder(NAME)
    bits = ["a", "B c", " ", "  ", "\n", "\t", "é", "ñ1", "'s", "'ll", " 12", "!!", "<|endoftext|>", "　", "\x1c",
            "日本", "🙂", "\r\n", "word", ".", ",", "×.", "—", "\x85", "é.", " “q", "²."]
    random.seed(5)
    for some in (bits, [b for b in bits if "<" not in b]):
        texts = ["".join(random.choice(some) for _ in range(random.randint(0, 14))) for _ in range(4000)] + [None]
        ids, sizes = encode(pa.array(texts))
        ends = np.cumsum(sizes)
        for text, s, e in zip(texts, ends - sizes, ends):
            assert ids[s:e].tolist() == encode.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_full_memory_is_emptied_without_loss(monkeypatch):
    monkeypatch.setattr(T, "CACHED_PIECES", 50)
    encode = T.PieceEncoder(T.tokenizer_file(NAME))
    for k in range(6):
        text = " ".join(f"w{k}{i}" for i in range(40))
        ids, _ = encode(pa.array([text]))
        assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_match_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 1 << 16)
    path = str(tmp_path / "tokens")
    docs = fixtures.frame(spark)
    T.write_tokens(docs, path, NAME, parts=3)
    files = T.token_files(spark, path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32)
                  for r in T.token_digest(files).collect()), key=lambda r: r[2])
    tokenizer = T.encoder(NAME).tokenizer
    start, every, want = 0, [], []
    order = sorted(fixtures.documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for doc in order:
        ids = tokenizer.encode(doc[1] or "", add_special_tokens=False).ids + [0]
        want.append((doc[0] is not None, doc[0] or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert got == want
    at = spark.createDataFrame([(p,) for p in [0, 1, start - 1, start, -5, *range(3, start, 501)]], "pos bigint")
    found = {r.pos: r.id for r in T.tokens_at(files, at).collect()}
    assert found == {p: every[p] for p in [0, 1, start - 1, *range(3, start, 501)]}


def test_documents_longer_than_a_segment(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(60000))
    docs = spark.createDataFrame([(1, text), (2, "b"), (3, text)], "doc_id bigint, text string")
    T.write_tokens(docs, str(tmp_path / "f"), NAME, parts=1)
    files = T.token_files(spark, str(tmp_path / "f"))
    assert files.count() > 2
    ids = T.encoder(NAME).tokenizer.encode(text, add_special_tokens=False).ids + [0]
    crc = zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = {r.doc_id: r for r in T.token_digest(files).collect()}
    assert rows[1].ids_crc32 == rows[3].ids_crc32 == crc
    assert (rows[1].start, rows[2].start, rows[3].start) == (0, len(ids), len(ids) + rows[2].n_tokens)


def test_empty_table(spark, tmp_path):
    T.write_tokens(fixtures.empty(spark), str(tmp_path / "e"), NAME)
    assert T.token_digest(T.token_files(spark, str(tmp_path / "e"))).count() == 0
