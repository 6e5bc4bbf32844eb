"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Every text is searched for the fixed kinds below.  Each match's value is hashed and the
hashes are counted over the whole corpus by distinct owner and repository.  A value that
at least ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOS`` repositories hold is a widely copied
example; one held by a single owner in fewer repositories is owner-specific.  Long mixed tokens outside the fixed matches become spans of the
further kind ``owned`` when they are owner-specific, for such a token is a live-looking
credential although no key word stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskforge.llm.common import staged

# fixed values: kind, pattern, group with the secret, least length of that group
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"()(AKIA[A-Z0-9]+)", 2, 18),
    ("hex", r"()([0-9a-f]{16,})", 2, 16),
    ("owned", r"()([A-Za-z0-9+/_=-]{20,})", 2, 20),
)
BASE = ("assign", "access", "hex")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 3


def _looks_mixed(value: Column) -> Column:
    """At least one digit, upper-case and lower-case letter, and 12 distinct characters."""
    return (value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= 12))


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Lengths of what stands before each match, and the matches, of one kind."""
    some = text.rlike(pattern)
    before = F.when(some, F.transform(F.split(text, pattern, -1), F.length))
    return F.struct(
        F.lit(kind).alias("kind"), before.alias("before"),
        F.when(some, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)).alias("sizes"),
        F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("secrets"))


def candidates(marked: DataFrame) -> DataFrame:
    """One row per accepted match: ``row, owner, repo, kind, rank, start, stop, h``
    (positions in code points; ``h``: hash of the value)."""
    each = marked.select("row", "owner", "repo", F.explode("ks").alias("k")).select(
        "row", "owner", "repo", "k.kind", F.posexplode(
            F.arrays_zip(F.col("k.before").alias("before"), F.col("k.sizes").alias("size"),
                         F.col("k.secrets").alias("secret"))).alias("i", "m"))
    each = each.where("m.size is not null")  # what stands after the last match
    upto = Window.partitionBy("row", "kind").orderBy("i")  # the matches of one text
    each = each.withColumn("stop", F.sum(F.col("m.before") + F.col("m.size")).over(upto))
    least = F.create_map(*[F.lit(x) for k, _, _, n in KINDS for x in (k, n)])
    rank = F.create_map(*[F.lit(x) for i, (k, *_) in enumerate(KINDS) for x in (k, i)])
    each = each.where((F.length("m.secret") >= least[F.col("kind")])
                      & ((F.col("kind") != "owned") | _looks_mixed(F.col("m.secret"))))
    return each.select("row", "owner", "repo", "kind", rank[F.col("kind")].alias("rank"),
                       (F.col("stop") - F.col("m.size")).cast("bigint").alias("start"),
                       F.col("stop").cast("bigint").alias("stop"), F.sha2("m.secret", 256).alias("h"))


def ownership(found: DataFrame) -> DataFrame:
    """``(h, owners, repos)``: in how many owners and repositories a value occurs."""
    held = found.groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def _joined(kinds: tuple[str, ...] | None = None) -> Column:
    spans = F.col("spans")
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
                 repo: Column | None = None) -> DataFrame:
    """Secret spans of every row of ``docs``.

    Returns ``(<id_col>, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_examples,
    n_live, most_owners, most_repos)``, one row per input row; the last two are the most owners and
    repositories that hold one of its values.  ``owner`` and ``repo`` default to the column
    ``source`` and to ``source``/``lang``; null owners count as one unnamed owner.  Null and
    empty texts have no spans; repeated rows stay; an empty table gives an empty result;
    columns other than those named are not read.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    # one pass over the texts; the staged rows are small and keep their row numbers
    marked = rows.withColumn("row", F.monotonically_increasing_id())
    kinds = F.array(*[_found(F.coalesce("text", F.lit("")), k, p, g) for k, p, g, _ in KINDS])
    marked = staged(marked.select("row", "id", "owner", "repo",
                                  F.filter(kinds, lambda k: k["before"].isNotNull()).alias("ks")), "secrets-rows")
    found = staged(candidates(marked), "secrets-found")
    freq = ownership(found)
    known = found.join(freq, "h")
    known = known.where((F.col("kind") != "owned") | ((F.col("owners") == 1) & (F.col("repos") < EXAMPLE_REPOS)))
    per = known.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "stop", "kind", "owners", "repos")).alias("spans"))
    # an owned span must stand clear of the fixed kinds' spans of its text
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    clear = F.filter("spans", lambda s: (s["kind"] != "owned") | ~F.exists(
        base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    per = per.withColumn("spans", clear)
    none = F.expr("CAST(array() AS array<struct<start:bigint,rank:int,stop:bigint,kind:string,owners:bigint,repos:bigint>>)")
    out = marked.select("row", "id").join(per, "row", "left").withColumn("spans", F.coalesce("spans", none))

    def n(test):
        return F.size(F.filter("spans", test)).cast("bigint")

    def of_kind(kind):
        return n(lambda s: s["kind"] == kind)

    return out.select(
        F.col("id").alias(id_col), *[of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined().alias("spans"),
        of_kind("owned").alias("n_owned"),
        n(lambda s: (s["owners"] >= EXAMPLE_OWNERS) | (s["repos"] >= EXAMPLE_REPOS)).alias("n_examples"),
        n(lambda s: (s["owners"] == 1) & (s["repos"] < EXAMPLE_REPOS)).alias("n_live"),
        *[F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).alias(f"most_{c}") for c in ("owners", "repos")])


def oracle() -> str:
    """DuckDB twin of :func:`secret_spans` over ``documents``."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    kinds = "\nUNION ALL ".join(f"""SELECT row, owner, repo, '{k}' AS kind, {r} AS rank, {n} AS least,
  string_split_regex(text, {q(p)}) AS ps, regexp_extract_all(text, {q(p)}, 0) AS ms, regexp_extract_all(text, {q(p)}, {g}) AS ss
  FROM docs""" for r, (k, p, g, n) in enumerate(KINDS))
    base = ", ".join(q(k) for k in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
  concat_ws('/', source, lang) AS repo FROM documents),
k AS ({kinds}),
e AS (SELECT row, owner, repo, kind, rank, least, ps, ms, ss, unnest(range(1, len(ms) + 1)) AS i FROM k),
m AS (SELECT row, owner, repo, kind, rank, least, ss[i] AS secret, length(ms[i]) AS size,
  CAST(list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS BIGINT) AS start FROM e),
a AS (SELECT *, start + size AS stop FROM m WHERE length(secret) >= least AND (kind <> 'owned' OR (
  regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[a-z]')
  AND len(list_distinct(string_split(secret, ''))) >= 12))),
f AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM a GROUP BY secret),
s AS (SELECT a.*, owners, repos FROM a JOIN f USING (secret)
  WHERE kind <> 'owned' OR (owners = 1 AND repos < {EXAMPLE_REPOS})),
c AS (SELECT * FROM s WHERE kind <> 'owned' OR NOT EXISTS (SELECT 1 FROM s b WHERE b.row = s.row AND b.kind <> 'owned'
  AND b.start < s.stop AND s.start < b.stop))
SELECT d.doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access,
  count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans,
  count(CASE WHEN kind = 'owned' THEN 1 END) AS n_owned,
  count(CASE WHEN owners >= {EXAMPLE_OWNERS} OR repos >= {EXAMPLE_REPOS} THEN 1 END) AS n_examples,
  count(CASE WHEN owners = 1 AND repos < {EXAMPLE_REPOS} THEN 1 END) AS n_live,
  coalesce(max(owners), 0) AS most_owners, coalesce(max(repos), 0) AS most_repos
FROM docs d LEFT JOIN c USING (row) GROUP BY d.row, d.doc_id"""
