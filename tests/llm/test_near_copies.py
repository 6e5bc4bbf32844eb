import os
import sys
from collections import defaultdict

import numpy as np
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import simhash as S  # noqa: E402
from maskforge.llm.components import connected_components  # noqa: E402


def classes(items, pairs):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def slow_fingerprint(text, words=4):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    count = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def cloud(seed=0, centres=60):
    rng = np.random.default_rng(seed)
    out = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(6):
            x = int(base)
            for _ in range(rng.integers(0, 5)):
                x ^= 1 << int(rng.integers(0, 64))
            out.add(x)
    return np.array(sorted(out), np.uint64)


def near(fp, d):
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= d, 1))
    return list(zip(fp[i].tolist(), fp[j].tolist()))


def test_index_finds_every_link():
    fp = cloud()
    for d in (0, 1, 4):
        a, b = S.unit_links(np.zeros(len(fp), np.int64), fp, d)
        assert classes(fp.tolist(), zip(a.tolist(), b.tolist())) == classes(fp.tolist(), near(fp, d))


def test_links_with_split_units_and_agreeing_blocks(spark):
    fp = cloud(1)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    want = classes(fp.tolist(), near(fp, 4))
    for kw in ({}, {"unit_rows": 1}, {"unit_rows": 16}, {"agree": 2}):
        edges = S.links(nodes, 4, **kw).collect()
        pairs = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in edges]
        assert classes(fp.tolist(), pairs) == want


def test_components_on_chains_stars_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201),
                                                                                   (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == classes({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_documents(spark):
    rows = fixtures.documents()
    got = S.simhash_components(fixtures.frame(spark)).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(r[1]) for r in rows]
    of = classes(set(fps), near(np.array(sorted(set(fps)), np.uint64), 4))
    low = defaultdict(lambda: None)
    for r, f in zip(rows, fps):
        if r[0] is not None and (low[of[f]] is None or r[0] < low[of[f]]):
            low[of[f]] = r[0]
    want = sorted((r[0] or -1, f"{f:016x}", low[of[f]] or -1) for r, f in zip(rows, fps))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got) == want
    assert S.simhash_components(fixtures.empty(spark)).count() == 0


def test_dedup_keeps_one_row_and_all_columns(spark):
    docs = fixtures.frame(spark)
    kept = S.simhash_dedup(docs)
    assert kept.dtypes == docs.dtypes
    found = S.simhash_components(docs).where("doc_id = component_id").select("doc_id").distinct().collect()
    orphan = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in orphan if x is not None) == sorted(r.doc_id for r in found)
    assert S.simhash_dedup(fixtures.empty(spark)).count() == 0
