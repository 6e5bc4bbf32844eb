"""Small documents with every awkward case the operators define a result for."""

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          # names the operators use inside
          "id bigint, t string, key bigint, fp bigint, n bigint, g string, spans string, epochs bigint, "
          "bucket bigint, row bigint, h string, normal bigint, owner string")

PROSE = ("the quick brown fox jumps over the lazy dog while seven grey geese watch from the far bank of a "
         "slow river and nobody in the village minds the noise because market day has come again at last")


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None, 7, "clash", 1, 2, 3, "g", "x", 4, 5, 6, "h", 8, "o")


def documents():
    long = " ".join(f"word{i % 997} tail{i % 89}" for i in range(12000))
    near = PROSE.replace("lazy", "idle")
    return [
        row(1, PROSE), row(2, PROSE), row(2, PROSE), row(3, near), row(4, near + " indeed"),
        row(5, None), row(6, ""), row(7, " \t\n"), row(8, "\n\n"), row(9, long), row(10, long + " end"),
        row(None, PROSE), row(None, "orphan text without an id but with some words"),
        row(11, "é🙂 " * 120, None, None), row(12, "one\ntwo\none\nTwo!\n" * 3, "de", "s2"),
        row(13, "A B a b " * 60, "de", "s2"), row(14, "x" * 1000, "de", "s2"), row(15, "x" * 1000, "de", "s2"),
        row(16, "Licensed under the MIT License.\n" + PROSE, "fr", "s3"), row(17, "ties", "fr", "s3"),
        row(18, "ties", "fr", "s3"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return frame(spark, [])
