import hashlib
import math
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import digest as D  # noqa: E402


def bin_of(window: bytes) -> int:
    unit = 1 << 20
    mass = [0] + [round(n * math.log2(n) * unit) for n in range(1, D.WINDOW + 1)]
    whole = mass[D.WINDOW]
    return (whole - sum(mass[n] for n in Counter(window).values())) * (D.BINS - 1) // whole


def brute_selected(text: bytes, ranks) -> list[int]:
    if not text:
        return []
    if len(text) < D.WINDOW:
        text = text.ljust(D.WINDOW, b"\0")
    rank = [ranks[bin_of(text[i:i + D.WINDOW])] for i in range(len(text) - D.WINDOW + 1)]
    wins = Counter()
    for begin in range(1 - D.REACH, len(rank)):
        near = range(max(begin, 0), min(begin + D.REACH, len(rank)))
        wins[min(near, key=lambda i: (rank[i], i))] += 1
    return sorted(i for i, n in wins.items() if n >= D.POPULAR)


def texts():
    random.seed(3)
    words = ["".join(random.choice("abcdefghé🙂") for _ in range(random.randint(1, 9))) for _ in range(300)]
    out = [" ".join(random.choice(words) for _ in range(random.randint(1, 120))).encode() for _ in range(40)]
    return [*out, b"", b"a", b"x" * 500, b"ab" * 200, bytes(range(32)), bytes(range(33)), out[0]]


def test_selection_matches_brute_force():
    random.seed(5)
    ranks = np.array(random.sample(range(D.BINS), D.BINS))
    some = texts()
    data, offsets = D._joined(some)
    got = D.selected(data, offsets, ranks)
    want = [int(o) + i for o, t in zip(offsets, some) for i in brute_selected(t, ranks)]
    assert got.tolist() == want


def test_every_text_with_a_byte_has_a_feature_and_equal_texts_equal_digests():
    ranks = np.arange(D.BINS)
    some = texts()
    made = D.digests(some, ranks)
    assert [d.n > 0 for d in made] == [len(t) > 0 for t in some]
    assert str(made[0]) == str(made[-1]) and D.likeness(made[0], made[-1]) == 1
    again = D.digests(some[::-1], ranks)[::-1]  # neighbours in a slice change nothing
    assert [str(d) for d in again] == [str(d) for d in made]
    for d in made:
        back = D.Digest.parse(str(d))
        assert back.n == d.n and np.array_equal(back.filters, d.filters)


def test_likeness_follows_the_shared_part():
    random.seed(9)

    def text(n):
        return "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    base, other = text(30000), text(30000)
    half = base[:15000] + text(15000)
    ranks = np.arange(D.BINS)
    a, b, c, short = D.digests([x.encode() for x in (base, half, other, base[:8000])], ranks)
    assert len(a.filters) > 1
    assert 0.35 < D.likeness(a, b) < 0.65
    assert D.likeness(a, c) < 0.02 and D.likeness(a, b) == D.likeness(b, a)
    assert 0.2 < D.likeness(a, short) < 0.7


def expected(rows):
    key = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, r in enumerate(key):
        text, following = r[1] or "", key[(i + 1) % len(key)][1] or ""
        n = len(text) // 4
        yield r[0], len(text), hashlib.sha256((text[:len(text) - n] + following[:n]).encode()).hexdigest()


@pytest.mark.parametrize("width", ["1", "4", "13"])
def test_edited_texts_follow_the_order_of_ids(spark, width):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rows = fixtures.documents()
        seen, once = set(), []
        for r in rows:  # ids once each, as their order decides
            if r[0] not in seen:
                seen.add(r[0])
                once.append(r)
        docs = fixtures.frame(spark, once)
        got = D.edit_study(docs, D.entropy_ranks(docs)).collect()
        assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(
            (d or -1, n, h) for d, n, h in expected(once))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repeated_rows_stay_and_empty_tables_are_empty(spark):
    docs = fixtures.frame(spark)
    ranks = D.entropy_ranks(docs)
    got = D.edit_study(docs, ranks).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in fixtures.documents())
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint
    assert by_id[5].fingerprint == "0:" and by_id[5].near_next == 1  # empty next to empty
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert D.edit_study(fixtures.empty(spark), D.entropy_ranks(fixtures.empty(spark))).count() == 0
    one = fixtures.frame(spark, [fixtures.row(1, "an only row is its own next one, as this text shows")])
    assert [(r.doc_id, r.near_next) for r in D.edit_study(one, ranks).collect()] == [(1, 1.0)]


def test_ranks_count_every_window_and_extra_columns_stay(spark):
    docs = fixtures.frame(spark).withColumnRenamed("t", "fingerprint")
    count = Counter()
    for r in fixtures.documents():
        t = (r[1] or "").encode()
        if len(t) < 3000:
            count.update(bin_of(t[i:i + D.WINDOW]) for i in range(len(t) - D.WINDOW + 1))
    short = docs.where("text IS NULL OR length(text) < 3000")
    order = sorted(range(D.BINS), key=lambda b: (b < D.TRIVIAL, count[b], b))
    ranks = D.entropy_ranks(short)
    assert [int(ranks[b]) for b in order] == list(range(D.BINS))
    out = D.fingerprints(docs, ranks)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
