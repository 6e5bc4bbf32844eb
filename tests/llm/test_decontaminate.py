import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import decontaminate as D  # noqa: E402

SF = "/root/testdata/sf0.001"


def slow(a, b):
    """Matches of the best local alignment, by the textbook table."""
    table = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s, m = table[i - 1][j - 1]
            step = (s + 2, m + 1) if a[i - 1] == b[j - 1] else (s - 1, m)
            options = [step, (table[i - 1][j][0] - 1, table[i - 1][j][1]), (table[i][j - 1][0] - 1, table[i][j - 1][1])]
            table[i][j] = max([(0, 0)] + [x for x in options if x[0] > 0])
            best = max(best, table[i][j])
    return best[1]


def test_alignment_matches_the_table():
    random.seed(2)
    for _ in range(300):
        a, b = ([random.randint(0, 5) for _ in range(random.randint(5, n))] for n in (14, 25))
        assert D.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == slow(a, b)


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 2:
            out.append("zzchanged")
        elif x < 0.75 * share:
            continue
        else:
            out.append(w)
            if x < share:
                out.append("zzadded")
    return out


def test_verbatim_and_edited_copies_are_found(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(9)
    texts = {r.item_id: r.text for r in items.collect()}
    clean = [r.text for r in docs.limit(20).collect()]
    planted = []
    for k, (item, text) in enumerate(sorted(texts.items())):
        words = edited(text.split(), rng, 0.0 if k % 2 else 0.15)
        planted.append((10_000 + item, clean[k % 20][:500] + "\n" + " ".join(words).upper() + " " + clean[k % 20][500:900]))
    found = D.contaminated(docs.unionByName(spark.createDataFrame(planted, docs.schema)), items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    exact = {(10_000 + i, i) for k, i in enumerate(sorted(texts)) if k % 2}
    changed = {(10_000 + i, i) for k, i in enumerate(sorted(texts)) if not k % 2}
    assert exact <= got and len(changed & got) >= 0.8 * len(changed)
    # brute force over every pair agrees
    words_of = {r[0]: D.words_of(__import__("pyarrow").array([r[1]]))[0] for r in planted}
    for doc, words in words_of.items():
        for item, text in texts.items():
            w = D.words_of(__import__("pyarrow").array([text]))[0]
            assert ((doc, item) in got) == (D.align(w, words)[0] >= 0.8 * len(w))


def test_frequent_copies_stay_rare_seeds(spark):
    item = "seven grey geese watch the slow river from the far bank while nobody minds the noise"
    docs = spark.createDataFrame([(i, item if i % 3 == 0 else f"plain prose number {i} about other things entirely")
                                  for i in range(300)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "too short")], "item_id bigint, text string")
    got = {r.doc_id for r in D.contaminated(docs, items).collect()}
    assert got == set(range(0, 300, 3))
    kept = D.drop_contaminated(docs, items)
    assert kept.count() == 200 and kept.dtypes == docs.dtypes


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, D.contaminated(docs, items).collect()))
    blocks = D.item_blocks(items, docs, "item_id", "text", "text", 200)
    assert len(blocks) > 3
    monkeypatch.setattr(D, "item_blocks", lambda *a: blocks)
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == want and want


def test_awkward_documents(spark):
    docs = fixtures.frame(spark)
    items = spark.createDataFrame([(1, fixtures.PROSE, "x")], "item_id bigint, text string, id string")
    got = sorted((r.doc_id or -1) for r in D.contaminated(docs, items).collect())
    assert got == [-1, 1, 2, 2, 3, 4, 16]
    kept = D.drop_contaminated(docs, items)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count() - 7
    assert D.contaminated(fixtures.empty(spark), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0


def test_added_and_dropped_words_leave_a_seed(spark):
    docs = spark.createDataFrame(
        [(1, "so alpha beta gamma new delta epsilon zeta it went"), (2, "alpha beta gamma delta epsilon zeta"),
         (3, "alpha gamma epsilon beta"), (4, "one two three four six seven eight nine ten and on"),
         (5, "of alpha beta gamma epsilon zeta there")] + [(i, f"plain prose {i} on other things entirely") for i in range(6, 60)],
        "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven eight nine ten")],
                                  "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (5, 1)}


def test_recall_against_full_alignment(spark):
    """Items of 5 to 60 words, copies with up to a fifth of the words added, dropped or changed."""
    import pyarrow as pa
    rng = random.Random(17)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(120)]
    docs = []
    for k in range(600):
        _, text = items[k % 120]
        prose = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(5, 80)))
        docs.append((k, prose() + " " + " ".join(edited(text.split(), rng, rng.choice([0, 0.1, 0.2, 0.25]))) + " " + prose()))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    words = {i: D.words_of(pa.array([t]))[0] for i, t in items}
    want, planted = set(), 0
    for k, text in docs:
        w = D.words_of(pa.array([text]))[0]
        i = k % 120
        if D.align(words[i], w)[0] >= 0.8 * len(words[i]):
            want.add((k, i))
    found = len(want & got) / len(want)
    assert len(want) > 300 and found >= 0.97, found
