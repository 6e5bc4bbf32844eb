import os
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures  # noqa: E402

from maskforge.llm import nbsvm, robust  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_base_counts_match_brute_force(spark):
    rows = fixtures.documents()
    got = robust.outliers(fixtures.frame(spark)).collect()
    want = []
    for r in rows:
        c = counts(r[1])
        want.append((r[0] or -1, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed) for r in got) == sorted(want)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert robust.outliers(fixtures.empty(spark)).count() == 0


def test_counts_do_not_depend_on_slices():
    texts = [r[1] for r in fixtures.documents()]
    whole = robust.text_statistics(pa.array(texts))
    for i, t in enumerate(texts):
        alone = robust.text_statistics(pa.array([t], pa.string()))
        assert all(int(whole[k][i]) == int(alone[k][0]) for k in whole)


def test_mcd_ignores_a_third_of_outliers(spark):
    rng = np.random.default_rng(4)
    words = ["ab", "river", "stone", "mind", "lamp", "grey", "walking", "over", "under"]
    clean = [" ".join(rng.choice(words, rng.integers(80, 200))) + "." for _ in range(300)]
    junk = [" ".join(w.upper() + "###" for w in rng.choice(words, 100)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)],
                                 "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in robust.outliers(docs).collect()}
    ok = [i for i in range(300) if not got[i].base_failed]
    assert np.mean([got[i].kept for i in ok]) > 0.98
    assert not any(got[i].kept for i in range(300, 400))
    assert min(got[i].distance for i in range(300, 400)) > 5 * max(got[i].distance for i in ok)


def test_small_groups_use_wider_ones(spark):
    docs = [(i, fixtures.PROSE + f" {i} more words follow here to make it long enough for the rules of size " * 2,
             "en", f"s{i}") for i in range(60)]
    got = robust.outliers(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"),
                          min_rows=50).collect()
    assert all(r.distance >= 0 for r in got) and any(r.distance > 0 for r in got)


def test_classifier_learns_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = nbsvm.train(docs, labels.where(~nbsvm.held_out()))
    got = (nbsvm.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(nbsvm.held_out())
           .select("score", "quality").toPandas())
    assert ((got.score >= 0.3).astype(int) == got.quality).mean() > 0.95
    assert (got[got.quality == 1].score >= 0.3).mean() > 0.98


def test_classifier_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    flipped = labels.withColumn("quality", F.when(nbsvm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(map(tuple, nbsvm.score(docs, nbsvm.train(docs, x.where(~nbsvm.held_out())), keep=["doc_id"]).collect()))
              for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_classifier_edge_cases(spark):
    docs = fixtures.frame(spark)
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    out = nbsvm.score(docs, nbsvm.train(docs, one))
    assert out.columns == docs.columns + ["score"] and out.count() == docs.count()
    assert out.agg(F.min("score")).first()[0] > 0.999
    none = nbsvm.train(docs, one.where("quality > 5"))
    assert {r.score for r in nbsvm.score(docs, none, keep=["doc_id"]).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1), (9, 0), (10, 0), (4, 1), (13, 0), (14, 0)], "doc_id bigint, quality int")
    scores = [r.score for r in nbsvm.score(docs, nbsvm.train(docs, both), keep=["doc_id"]).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert nbsvm.score(fixtures.empty(spark), none).count() == 0
    assert nbsvm.train(fixtures.empty(spark), both).slope == 0.0


def test_mcd_rejects_junk_of_a_third_and_nearly_half(spark):
    rng = np.random.default_rng(7)
    words = ["ab", "river", "stone", "mind", "lamp", "grey", "walking", "over", "under"]
    rows, junk = [], set()
    for source, n_junk in (("third", 132), ("half", 180)):
        for k in range(400):
            text = " ".join(rng.choice(words, rng.integers(80, 200))) + "."
            if k < n_junk:
                text = " ".join(w.upper() + "###" for w in rng.choice(words, 100))
                junk.add(len(rows))
            rows.append((len(rows), text, "en", source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in robust.outliers(docs).collect()}
    assert not any(got[i].kept for i in junk)
    assert np.mean([got[i].kept for i in got if i not in junk and not got[i].base_failed]) > 0.98
