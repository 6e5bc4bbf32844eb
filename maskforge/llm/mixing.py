"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A tree of levels (domain, language, source) shares a token budget.  Each node's capacity is
what its leaves hold times the allowed epochs; leaves below a weight of 0 take nothing and add no
capacity.  From the root down, a node's budget is
poured over its children in proportion to their weights; children that fill up pass
their shortage to their siblings, and only what a whole subtree cannot take was never given
to it, so ancestors redistribute last.  A leaf that gets ``f`` times its tokens and a rest
takes every document ``f`` times and, in the order of the next seeded epoch, the prefix of
documents whose tokens fit the rest.

The prefix is found without ordering a leaf in one task: an epoch's order is the order of
md5 values, so a leaf is dealt into buckets by md5 range, bucket totals find the bucket
where the budget runs out, and only that bucket is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskforge.llm.common import WORD, sized_join, staged

#: documents of a leaf that share a bucket, on average
BUCKET_ROWS = 4096
#: leaves up to which their table is broadcast
BROADCAST_LEAVES = 100_000


def word_count(text_col: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")


def _pour(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes(parent..., name, cap, weight, budget)`` -> the same with ``share``.

    Children are taken by capacity over weight; a child is full when its capacity times
    the weights from it on does not exceed the budget left before it times its weight.
    """
    by = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc(), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    num = lambda c: F.col(c).cast("double")
    some = nodes.where("weight > 0 and cap > 0")
    some = some.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    some = some.withColumn("open", F.sum("weight").over(after))
    some = some.withColumn("full", num("cap") * num("open") <= (num("budget") - num("used")) * num("weight"))
    some = some.withColumn("kept", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
    some = some.withColumn("rest", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    part = F.floor((num("budget") - num("kept")) * num("weight") / num("rest"))
    return some.withColumn("share", F.when(F.col("full"), F.col("cap"))
                           .otherwise(F.least(F.col("cap"), part)).cast("bigint")
                           ).drop("used", "open", "full", "kept", "rest")


def _path(names: list[str]) -> Column:
    """Names from the root joined by ``/``; in a name ``%`` is written ``%25`` and ``/`` ``%2F``."""
    def safe(c):
        return F.replace(F.replace(F.col(c), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))

    return F.concat_ws("/", *map(safe, names))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """``leaves(levels..., tokens)`` -> the same with ``share`` (tokens to take).

    ``weights(path STRING, weight BIGINT)``: names from the root as ``_path`` joins them; nodes
    that are not listed weigh 1.  Where a node of a leaf's path has weight 0 the leaf takes nothing
    and is left out, so its siblings' capacity alone counts on every level above it.
    """
    closed = weights.where("weight <= 0").select("path")
    for depth in range(1, len(levels) + 1):
        leaves = leaves.withColumn("path", _path(levels[:depth])).join(closed, "path", "left_anti").drop("path")
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    done = None
    for depth in range(1, len(levels) + 1):
        here, parent = levels[:depth], levels[:depth - 1]
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("path", _path(here))
        nodes = nodes.join(weights, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        if done is None:
            nodes = nodes.withColumn("top", F.lit(0)).withColumn("budget", budget.cast("bigint"))
            total = Window.partitionBy("top")  # as many rows as the tree has first-level nodes
            nodes = nodes.withColumn("budget", F.least("budget", F.sum("cap").over(total)))
            done = _pour(nodes, ["top"], here[-1]).drop("top")
        else:
            nodes = nodes.join(done.select(*parent, F.col("share").alias("budget")), parent)
            done = _pour(nodes, parent, here[-1])
        done = done.select(*here, "share")
    return leaves.drop("cap").join(done, levels)


def _order(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def plan_mix(docs: DataFrame, levels: list[str], weights: DataFrame, budget_share: float, max_epochs: int,
             seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Narrow rows ``(id, levels..., n)`` and leaves ``(levels..., tokens, share, epochs,
    rest, buckets, bucket, cutoff)``: documents of the epoch after the full ones are taken in
    buckets before ``bucket``, and in it up to the md5 ``cutoff``."""
    names = [f"level{i}" for i in range(len(levels))]
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                                                    for c, n in zip(levels, names)], word_count(text_col).alias("n"))
    rows = staged(rows, "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    leaves = leaf_budgets(leaves, names, weights, F.lit(int(total * budget_share)), max_epochs)
    epochs = F.floor(F.col("share") / F.col("tokens")).cast("bigint")
    leaves = leaves.withColumn("epochs", epochs).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    leaves = staged(leaves.withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS)), "mix-leaves")
    dealt = _with_bucket(rows, leaves, names, seed, "id").where("rest > 0")
    sums = dealt.groupBy(*names, "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*names).orderBy("bucket")  # one row per BUCKET_ROWS documents
    ends = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > rest")
    last = ends.groupBy(*names).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n"))
                                                     .alias("left")), "bucket").alias("e"))
    last = staged(last.select(*names, F.col("e.bucket").alias("bucket"), F.col("e.left").alias("left")), "mix-ends")
    edge = sized_join(dealt, last, [*names, "bucket"], "inner", BROADCAST_LEAVES)
    ordered = Window.partitionBy(*names).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = edge.withColumn("upto", F.sum("n").over(ordered)).where("upto <= left")
    cutoff = fits.groupBy(*names).agg(F.max("key").alias("cutoff"))
    leaves = leaves.join(last.drop("left"), names, "left").join(cutoff, names, "left")
    return rows, staged(leaves, "mix-plan")


def _with_bucket(rows: DataFrame, leaves: DataFrame, names: list[str], seed: int, id_col: str) -> DataFrame:
    out = sized_join(rows, leaves, names, "inner", BROADCAST_LEAVES)
    out = out.withColumn("key", _order(seed, F.col("epochs"), F.col(id_col)))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    name = "bucket" if "bucket" not in leaves.columns else "own"
    return out.withColumn(name, F.floor(place * F.col("buckets")))


def _taken(rows: DataFrame, plan: DataFrame, names: list[str], seed: int, id_col: str) -> DataFrame:
    out = _with_bucket(rows, plan, names, seed, id_col)
    # without a bucket where it runs out, the rest covers the whole epoch or is nothing
    prefix = F.when(F.col("rest") <= 0, False).when(F.col("bucket").isNull(), True).otherwise(
        (F.col("own") < F.col("bucket")) | ((F.col("own") == F.col("bucket"))
                                            & (F.col("key") <= F.coalesce("cutoff", F.lit("")))))
    out = out.withColumn("copies", F.col("epochs") + prefix.cast("bigint")).where("copies > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))


def mixed_ids(docs: DataFrame, levels: list[str], weights: DataFrame, budget_share: float = 1.0, max_epochs: int = 4,
              seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and epoch it is taken in: ``(<id_col>, epoch, n_tokens, levels...)``.

    The budget is ``budget_share`` of all tokens (words).  Null level values are the name
    ''; null ids order as ''; rows that repeat an id have equal places and are taken or left
    together; documents without words take no budget but follow their leaf's order; leaves
    without words, and all below a node of weight 0, give nothing and leave their budget to others;
    an empty table gives an empty result.
    """
    names = [f"level{i}" for i in range(len(levels))]
    rows, plan = plan_mix(docs, levels, weights, budget_share, max_epochs, seed, id_col, text_col)
    out = _taken(rows, plan, names, seed, "id")
    return out.select(F.col("id").alias(id_col), "epoch", F.col("n").alias("n_tokens"),
                      *[F.col(n).alias(c) for n, c in zip(names, levels)])


def mixed_documents(docs: DataFrame, levels: dict[str, Column], weights: DataFrame, budget_share: float = 1.0,
                    max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it (see :func:`mixed_ids`);
    only the plan's leaf table is joined, so texts are not shuffled."""
    names = [f"__level{i}" for i in range(len(levels))]
    wide = docs.withColumns(dict(zip(names, levels.values())))
    _, plan = plan_mix(wide, names, weights, budget_share, max_epochs, seed, id_col, text_col)
    plan = plan.select(*[F.col(f"level{i}").alias(n) for i, n in enumerate(names)],
                       *[F.col(c).alias(f"__{c}") for c in ("epochs", "rest", "buckets", "bucket", "cutoff")])
    wide = wide.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names})
    row = F.struct(*docs.columns)
    narrow = wide.select(*names, F.col(id_col).alias("__id"), row.alias("__row"))
    plan = plan.select(*names, *[F.col(f"__{c}").alias(c) for c in ("epochs", "rest", "buckets", "bucket", "cutoff")])
    out = _taken(narrow, plan, names, seed, "__id")
    return out.select("__row.*")


def oracle(weights: dict[str, int], max_epochs: int, seed: int, domain_sql: str) -> str:
    """DuckDB twin of :func:`mixed_ids` over ``documents`` with the whole budget."""
    values = ", ".join(f"('{k}', {v})" for k, v in sorted(weights.items()))

    def safe(c: str) -> str:
        return f"replace(replace({c}, '%', '%25'), '/', '%2F')"

    prefixes = ", ".join(" || '/' || ".join(map(safe, ("domain", "lang", "source")[:k])) for k in (1, 2, 3))

    def pour(out: str, cols: str, parent: str, name: str, budget: str) -> str:
        of = f"PARTITION BY {parent}" if parent else ""
        path = " || '/' || ".join(map(safe, cols.split(", ")))
        return f"""
{out}n AS (SELECT {cols}, sum(cap) AS cap, {path} AS path FROM leaf GROUP BY {cols}),
{out}w AS (SELECT n.*, coalesce(w.weight, 1) AS weight, {budget} AS budget FROM {out}n n LEFT JOIN weights w USING (path)
  {f"JOIN {parent_name[out]} p USING ({parent})" if parent else ""}),
{out}o AS (SELECT *, CAST(coalesce(sum(cap) OVER ({of} ORDER BY CAST(cap AS DOUBLE) / weight, {name}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS used,
  CAST(sum(weight) OVER ({of} ORDER BY CAST(cap AS DOUBLE) / weight, {name}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open
  FROM {out}w WHERE weight > 0 AND cap > 0),
{out}f AS (SELECT *, CAST(cap AS DOUBLE) * open <= (CAST(budget AS DOUBLE) - used) * CAST(weight AS DOUBLE) AS full_up
  FROM {out}o),
{out}s AS (SELECT *, CAST(sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({of}) AS DOUBLE) AS kept,
  CAST(sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({of}) AS DOUBLE) AS rest FROM {out}f),
{out} AS (SELECT {cols}, CAST(CASE WHEN full_up THEN cap ELSE least(cap, CAST(floor(
  (CAST(budget AS DOUBLE) - kept) * CAST(weight AS DOUBLE) / rest) AS BIGINT)) END AS BIGINT) AS share FROM {out}s)"""

    parent_name = {"l2": "l1", "l3": "l2"}
    return f"""
WITH weights(path, weight) AS (VALUES {values}),
docs AS (SELECT doc_id, {domain_sql} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
every AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {max_epochs} AS BIGINT) AS cap
  FROM docs GROUP BY ALL),
leaf AS (SELECT * FROM every WHERE NOT EXISTS (SELECT 1 FROM weights w WHERE w.weight <= 0 AND w.path IN ({prefixes}))),
total AS (SELECT CAST(least((SELECT sum(tokens) FROM every), sum(cap)) AS BIGINT) AS budget FROM leaf),
{pour("l1", "domain", "", "domain", "(SELECT budget FROM total)").strip()},{pour("l2", "domain, lang", "domain", "lang", "p.share")},{pour("l3", "domain, lang, source", "domain, lang", "source", "p.share")},
plan AS (SELECT domain, lang, source, share // tokens AS epochs, share - (share // tokens) * tokens AS rest
  FROM leaf JOIN l3 USING (domain, lang, source)),
keyed AS (SELECT d.*, epochs, rest, md5(concat_ws('|', '{seed}', CAST(epochs AS VARCHAR),
  coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM docs d JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
taken AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, unnest(range(0, copies)) AS epoch, n AS n_tokens, domain, lang, source FROM taken
"""
