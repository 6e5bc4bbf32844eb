import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import phrases as P  # noqa: E402

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(SMALL)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, P.LONGEST + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                sub = lang, w[i:i + m]
                inside[sub] = max(inside[sub], a)
    out = []
    for lang in n:
        scored = []
        for (of, w), a in cand.items():
            if of != lang or 100 * inside[of, w] >= 80 * a:
                continue
            cuts = [(2000000 * a // (f[of, w[:k]] + f[of, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(w).encode(), f[of, w[:k]], f[of, w[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n, words):
    random.seed(seed)
    vocabulary = [random.choice("abcdeé🙂XY") * random.randint(1, 3) + str(i % 7) for i in range(words)]
    fixed = [" ".join(random.choices(vocabulary, k=random.randint(2, 6))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [random.choice(fixed) if random.random() < 0.4 else random.choice(vocabulary)
                 for _ in range(random.randint(0, 60))]
        text = "".join(p + random.choice([" ", " ", "  ", "\t", ". ", "\n", "!", " - "]) for p in parts)
        out.append((None if i % 11 == 0 else i, None if i % 13 == 0 else text, random.choice(["en", "en", "en", "de", None])))
    return out


@pytest.mark.parametrize("seed,least,top,shards", [(1, 3, 5, 4), (2, 5, 2000, 4), (3, 30, 50, 4), (4, 4, 2000, 1), (5, 2, 9, 7)])
def test_phrases_match_brute_force(spark, monkeypatch, seed, least, top, shards):
    monkeypatch.setattr(P, "SHARDS", shards)
    monkeypatch.setattr(P, "CHUNK", 500)
    rows = corpus(seed, 150, 30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    got = rows_of(P.phrase_collocations(df, least=least, top=top))
    assert got == brute([r[::-1][:2] for r in rows], least, top)
    assert got


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "FILTER_BITS", 64)  # every bit set: all phrases are counted
    rows = corpus(8, 60, 20)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert rows_of(P.phrase_collocations(df, least=4)) == brute([r[::-1][:2] for r in rows], 4, P.TOP)


def test_support_is_complete_in_shards():
    for n in ([10, 20, 30], [1, 1, 998], [7, 0, 5]):
        least = [-(-P.LEAST * x // sum(n)) for x in n]
        assert sum(max(s - 1, 0) for s in least) < P.LEAST


def test_equal_hashes_add_candidates_only(spark, monkeypatch):
    rows = corpus(6, 60, 20)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    every = np.full(P.FILTER_BITS // 64, ~np.uint64(0))  # all phrases are candidates
    f, _ = counted([r[::-1][:2] for r in rows])
    got = {(r.lang, r.phrase): r.a for r in P.phrase_counts(P._rows(df, "doc_id", "text", "lang"), every, 3).collect()}
    assert got == {(lang, " ".join(w)): a for (lang, w), a in f.items() if a >= 3}


def test_awkward_rows(spark):
    rows = fixtures.documents()
    got = rows_of(P.phrase_collocations(fixtures.frame(spark), least=3))
    assert got == brute([(r[2], r[1]) for r in rows], 3, P.TOP)
    assert P.phrase_collocations(fixtures.empty(spark)).count() == 0
    assert P.phrase_collocations(fixtures.frame(spark, rows[:2])).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 18
    counts = spark.createDataFrame(
        [("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 5),
         ("en", "b c", 10 ** 17 * 8), ("en", "c", 10 ** 18), ("en", "a b c", 10 ** 17 * 8)],
        "lang string, phrase string, a bigint")
    totals = spark.createDataFrame([("en", 9 * 10 ** 18)], "lang string, n bigint")
    got = {r.phrase: (r.l, r.r, r.score) for r in P.collocations(counts, totals).collect()}
    assert got["a b"] == (big + 1, big + 5, 2000000 * big // (2 * big + 6))
    assert "b c" not in got  # inside "a b c", which is as frequent
    assert got["a b c"] == min(((big + 1, 8 * 10 ** 17, 2000000 * 8 * 10 ** 17 // (big + 1 + 8 * 10 ** 17)),
                                (big, 10 ** 18, 2000000 * 8 * 10 ** 17 // (big + 10 ** 18))), key=lambda x: x[2])
