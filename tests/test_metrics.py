import itertools
import math

import numpy as np

from maskforge.functions.stem import stem
from maskforge.operators import metrics as E


def test_edit_similarity():
    assert math.isclose(E.edit_similarity("kitten", "sitting"), 8 / 13)
    assert E.edit_similarity("", "") == 1.0


def _is_subsequence(x, y):
    rest = iter(y)
    return all(c in rest for c in x)


def _longest(a, b):
    """Longest common subsequence by trying every subsequence of the shorter side."""
    short, long = sorted((a, b), key=len)
    return next(k for k in range(len(short), -1, -1)
                if any(_is_subsequence(c, long) for c in itertools.combinations(short, k)))


def test_lcs_against_brute_force():
    import random
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcd ") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abcd ") for _ in range(rng.randint(0, 9))]
        assert E.lcs_len(a, b) == _longest(a, b)


def test_rouge():
    assert math.isclose(E.rouge_l(["a", "b", "c"], ["a", "c"]), 0.8)
    assert E.rouge_l([], ["a"]) == 0.0


def test_identity_scores_one():
    toks = ["const", " ", "x", " ", "=", " ", "1", ";"]
    assert E.rouge_l(toks, toks) == 1.0
    assert math.isclose(E.bleu4(toks, toks), 1.0)
    assert math.isclose(E.meteor_exact(toks, toks), 1 - 0.5 * (1 / len(toks)) ** 3)


def test_bleu_no_unigram_match():
    assert E.bleu4(["a"], ["b"]) == 0.0


def test_meteor_by_hand():
    # two matches in one chunk: P = 2/3, R = 2/2
    f = (2 / 3) / (0.9 * 2 / 3 + 0.1)
    assert math.isclose(E.meteor_exact(["a", "b"], ["a", "b", "c"]), (1 - 0.5 * (1 / 2) ** 3) * f)
    # the same words in the other order: two chunks
    assert math.isclose(E.meteor_exact(["a", "b"], ["b", "a"]), 0.5)
    assert E.meteor_exact(["a"], ["b"]) == E.meteor_exact([], ["b"]) == 0.0
    # repeated words pair from the end
    assert math.isclose(E.meteor_exact(["x", "x", "y"], ["x", "y"]),
                        (1 - 0.5 * (1 / 2) ** 3) * (2 / 3) / (0.9 + 0.1 * 2 / 3))


def test_stems():
    # pairs from the published description of the steps
    for word, want in {
        "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
        "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
        "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
        "decisiveness": "decis", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic",
        "formative": "form", "electriciti": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
        "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
        "homologou": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controll": "control", "roll": "roll", "x1": "x1", "as": "as", "": "",
    }.items():
        assert stem(word) == want, word


def test_meteor_stages_by_hand():
    f = lambda m, h, r: (m / h) * (m / r) / (0.9 * m / h + 0.1 * m / r)
    # an equal word, an equal stem, a synonym: one chunk of three
    syn = {"car": ("s1", "s2"), "auto": ("s2",)}
    ref, hyp = ["fast", "running", "car"], ["Fast", "runs", "auto"]
    assert math.isclose(E.meteor(ref, hyp, syn), 1 - 0.5 * (1 / 3) ** 3)
    assert math.isclose(E.meteor(ref, hyp), (1 - 0.5 * (1 / 2) ** 3) * f(2, 3, 3))
    assert math.isclose(E.meteor_exact(ref, hyp), 0.5 * f(1, 3, 3))
    # a word paired by an earlier stage is not free for a later one
    assert math.isclose(E.meteor(["run", "runs"], ["runs"]), 0.5 * f(1, 1, 2))
    assert math.isclose(E.meteor(["auto"], ["car", "car"], syn), 0.5 * f(1, 2, 1))
    assert E.meteor(["auto"], ["bus"], syn) == 0.0


def test_meteor_with_a_synonym_table(spark):
    rows = [(1, ["fast", "car"], ["fast", "auto"]), (2, ["bus"], ["car"]), (3, None, ["x"]), (4, [], ["x"]), (None, ["Auto"], ["CAR"])]
    pairs = spark.createDataFrame(rows, "k int, r array<string>, h array<string>")
    table = spark.createDataFrame([("Car", "g"), ("auto", "g"), ("auto", "g"), ("x", None), (None, "g")], "word string, grp string")
    got = {r.k: r.meteor for r in E.with_meteor(pairs, ["k"], "r", "h", table).collect()}
    assert math.isclose(got[1], 1 - 0.5 * (1 / 2) ** 3) and got[2] == 0.0 and got[3] is None and got[4] == 0.0 and got[None] == 0.5
    plain = {r.k: r.meteor for r in E.with_meteor(pairs, ["k"], "r", "h").collect()}
    assert math.isclose(plain[1], 0.5 * 0.5) and plain[None] == 0.0


def test_chunk_bounds():
    from maskforge.operators.packing import chunk_bounds
    # lines end before 3, 5 and 10; the last line does not fit and keeps its last 4 tokens
    assert chunk_bounds(np.array([3, 5, 10]), 4) == [(0, 3), (3, 5), (6, 10)]
    assert chunk_bounds(np.array([3, 5, 10]), 5) == [(0, 5), (5, 10)]
    assert chunk_bounds(np.array([], int), 4) == []


def test_chunks_cover_every_token_of_lines_that_fit():
    from maskforge.operators.packing import chunk_bounds
    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 9, rng.integers(1, 30)))
        bounds = chunk_bounds(ends, 8)
        assert bounds[0][0] == 0 and bounds[-1][1] == ends[-1]
        assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
        assert all(0 < b - a <= 8 and b in ends for a, b in bounds)


def test_sample_bounds():
    from maskforge.operators.packing import sample_bounds
    # words start at 1, 3 and 5; the special at 4 ends a sample behind it
    assert sample_bounds(np.array([1, 3, 5, 5]), np.array([1, 3, 4, 5]), 7, 4) == [(0, 3), (3, 5), (5, 7)]
    assert sample_bounds(np.array([], int), np.array([], int), 5, 4) == [(0, 4), (4, 5)]
    assert sample_bounds(np.array([0]), np.array([0]), 4, 4) == [(0, 4)]


def test_detokenise_by_hand(spark):
    from maskforge.operators.detokenise import SPACE, detokenise
    vocab = spark.createDataFrame([(1, f"{SPACE}let"), (2, "ter"), (3, "</s>"), (4, f"{SPACE}x"), (5, "<NUM_LIT>"), (6, SPACE)],
                                  "id long, token string")
    rows = [("a", k, i) for k, i in enumerate((1, 2, 4, 5, 4, 0, 1))] + [("b", 0, 6), ("b", 1, 4), ("b", 2, 3), ("b", 3, 99),
                                                                       ("b", 4, 2), ("c", 0, 0)]
    got = {r.d: r.text for r in detokenise(spark.createDataFrame(rows, "d string, place int, id long"), vocab, "d").collect()}
    assert got == {"a": "letter x <NUM_LIT> x", "b": "x </s> ter"}
