import hashlib
import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import longmatch as L  # noqa: E402


def brute(texts, length):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_matching_statistics_match_brute_force():
    random.seed(0)
    for trial in range(40):
        parts = [bytes(random.choice(b"ab\0") for _ in range(random.randint(1, 50))) for _ in range(random.randint(1, 9))]
        if trial % 2:
            parts = [p + parts[0] for p in parts]
        index = L.RunIndex(parts)
        got = index.matching_statistics()
        places = [(k, i, p[i:]) for k, p in enumerate(parts) for i in range(len(p))]
        for k, i, x in places:
            want = max((len(os.path.commonprefix([x, y])) for a, b, y in places if (a, b) != (k, i)), default=0)
            assert got[index.begin[k] + i] == want


def digests(df):
    return sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                  for r in df.collect())


def expected(rows, length):
    return sorted((r[0] or -1, *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], length)))


@pytest.mark.parametrize("segments", [2048, 2])
def test_removed_bytes_match_brute_force(spark, monkeypatch, segments):
    monkeypatch.setattr(L, "GROUP_SEGMENTS", segments)
    random.seed(7)
    shared = ["".join(random.choice("abcdé \n") for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(60):
        text = "".join(random.choice("abcdefgh ") for _ in range(random.randint(0, 200)))
        if i % 3:
            s = shared[i % 2]
            cut = random.randint(0, 120)
            text += s[cut:] if i % 5 else s[:cut] + "#" + s[cut + 1:]
        rows.append((i % 57, text))
    rows += [(None, shared[2]), (None, shared[2]), (100, None), (101, ""), (102, "z" * 500), (103, "xy" * 99)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digests(L.remove_repeats(docs, length=80, gram=16)) == expected(rows, 80)


def test_awkward_documents(spark):
    rows = [r for r in fixtures.documents() if len(r[1] or "") < 5000]
    assert digests(L.remove_repeats(fixtures.frame(spark, rows))) == expected(rows, L.LENGTH)
    assert L.remove_repeats(fixtures.empty(spark)).count() == 0


def test_documents_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert digests(L.remove_repeats(docs)) == expected(rows, L.LENGTH)
