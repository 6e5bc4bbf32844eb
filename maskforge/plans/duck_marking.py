"""DuckDB twins of the marking queries on the derived code corpus.

The corpus has a known grammar, so potential types need no fold here: its only colons stand
in ``: number``, whose span ends before the next ``=`` (taking the blank along) or ``,``.
Each span is replaced by one private-use character, which the lexer gives a token of its own
that no marker may precede; the text is put back afterwards.
"""

from __future__ import annotations

from maskforge import config as C
from maskforge.functions import lexer as L
from maskforge.plans import duck as Q
from maskforge.sources import tables as T

_WIDE, _NARROW = "chr(57344)", "chr(57345)"
_MARKER = r"/\*<marker:[0-9]+>\*/"
_OPTIONAL = "(?:" + _MARKER + ")?"
_IDENT = r"[A-Za-z_$][\w$]*"
_TYPE = r"[A-Za-z_$][\w$.]*(?:<[^<>()=;{}]*>)?(?:\[\])*"
_MASKABLE = ", ".join(Q.q(t) for t in L.MASKABLE)

TOKENS = f"""code AS ({T.duck_code_corpus_cte()}),
tl AS (SELECT path, {Q.tokenize(f"replace(replace(content, ': number ', {_WIDE}), ': number', {_NARROW})")} AS t FROM code),
tk AS (SELECT path, len(t) AS n, unnest(range(0, len(t))) AS i, unnest(t) AS tok FROM tl),
inr AS (SELECT path, i, tok.type IN ({_MASKABLE}) AS fits, tok.type = 'LineTerminatorSequence' AS is_end,
  sum(CASE WHEN tok.type = 'LineTerminatorSequence' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS ln,
  sum(CASE WHEN tok.type = 'LineTerminatorSequence' THEN 1 ELSE 0 END) OVER (PARTITION BY path) AS n_ends
  FROM tk WHERE i BETWEEN 1 AND n - 2),
inl AS (SELECT path, i, ln, fits FROM inr WHERE NOT is_end AND ln < n_ends)"""

LINE_SPANS = f"""WITH {TOKENS}
SELECT path, CAST(count(DISTINCT ln) AS INTEGER) AS lines,
  CAST(count(DISTINCT CASE WHEN fits THEN ln END) AS INTEGER) AS maskable_lines
FROM code LEFT JOIN inl USING (path) GROUP BY path"""

MARKED = f"""{TOKENS},
fit AS (SELECT path, i, dense_rank() OVER (PARTITION BY path ORDER BY ln) - 1 AS k FROM inl WHERE fits),
per AS (SELECT path, k, md5(concat_ws('-', path, '42', 'line', k)) AS h,
  arg_min(i, (md5(concat_ws('-', path, '42', 'token', k, i)), i)) AS i FROM fit GROUP BY path, k),
rk AS (SELECT path, k, i, row_number() OVER (PARTITION BY path ORDER BY h, k) AS r, count(*) OVER (PARTITION BY path) AS n FROM per),
ch AS (SELECT path, i, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS j FROM rk
  WHERE r <= least(greatest(floor(n * CAST({C.LINE_MASK_CHANCE} AS DOUBLE)), 1), n)),
marked AS (SELECT path, count(j) AS n_markers, replace(replace(string_agg(
    CASE WHEN j IS NULL THEN '' ELSE '/*<marker:' || j || '>*/' END || tok.value, '' ORDER BY i),
    {_WIDE}, ': number '), {_NARROW}, ': number') AS text FROM tk LEFT JOIN ch USING (path, i) GROUP BY path)"""

MARKERS = f"WITH {MARKED} SELECT path, CAST(n_markers AS INTEGER) AS n_markers, md5(text) AS digest FROM marked"


def _variants(files: str) -> str:
    """Valid markers of three variants, and those common to all, capped."""
    explicit = (f"regexp_replace(regexp_replace(text, {Q.q(r'(\blet ' + _OPTIONAL + r's[0-9]+)')}, '\\1: string', 'g'), "
                f"{Q.q('(, ' + _OPTIONAL + 'b)(' + _OPTIONAL + r'\))')}, '\\1: number\\2: string', 'g')")
    annotated = (r"(\b(?:const|let|var)\s+" + _OPTIONAL + _IDENT + r"|[(,]\s*" + _OPTIONAL + _IDENT + r"|\))\s*:\s*" + _TYPE)
    untyped = f"regexp_replace(text, {Q.q(annotated)}, '\\1', 'g')"
    line = Q.js_trim(Q.remove_comments("line"))
    return f"""{MARKED},
vs AS (SELECT path, unnest(['normal', 'explicit', 'untyped']) AS variant, unnest([text, {explicit}, {untyped}]) AS text
  FROM marked {files}),
mk AS (SELECT path, variant, text, unnest(regexp_extract_all(text, {Q.q(_MARKER)})) AS marker FROM vs),
ml AS (SELECT path, variant, marker, strpos(text, marker) AS at_, count(*) OVER (PARTITION BY path, variant, marker) AS c,
  regexp_extract(substr(text, strpos(text, marker) + length(marker)), '^[^\\n\\r]+') AS line FROM mk),
good AS (SELECT path, variant, marker FROM ml WHERE c = 1 AND at_ > 1 AND line <> '' AND {line} <> ''),
cm AS (SELECT path, marker, CAST(regexp_extract(marker, '[0-9]+') AS INTEGER) AS number FROM good
  GROUP BY path, marker HAVING count(DISTINCT variant) = 3),
common AS (SELECT path, marker, number FROM cm QUALIFY row_number() OVER (
  PARTITION BY path ORDER BY md5(concat_ws('-', path, '42', marker))) <= {C.NUM_MARKERS})"""


COMMON = f"""WITH {_variants("")}
SELECT path, CAST(count(marker) AS INTEGER) AS n_common, coalesce(string_agg(marker, ',' ORDER BY number), '') AS markers
FROM marked LEFT JOIN common USING (path) GROUP BY path"""


def _tasks(replace_literals: bool) -> str:
    u = Q.uniform("concat_ws('-', path, '42')")
    grid = ", ".join(f"('{n}', {m})" for n, m in C.COMMENT_CLASSES)
    return f"""{_variants(f"WHERE {u} >= 0.8 AND {u} < 0.9")},
ps AS (SELECT path, variant, marker, row_number() OVER (PARTITION BY path, variant ORDER BY number) - 1 AS ordinal, text,
  strpos(text, marker) AS at_ FROM vs JOIN common USING (path)),
pt AS (SELECT *, regexp_extract(substr(text, at_ + length(marker),
    coalesce(lead(at_) OVER (PARTITION BY path, variant ORDER BY ordinal), length(text) + 1) - at_ - length(marker)),
    '^[^\\n\\r]+') AS line FROM ps),
bad AS (SELECT DISTINCT path FROM pt WHERE line = ''),
rt AS (SELECT path, variant, marker, ordinal, substr(text, 1, at_ - 1) AS inp, {Q.js_trim(Q.remove_comments("line"))} AS gt
  FROM pt WHERE path NOT IN (SELECT path FROM bad)),
grid AS (SELECT * FROM (VALUES {grid}) AS grid(comments, preserved)),
tasks AS (SELECT path, variant, comments, CAST(ordinal AS INTEGER) AS ordinal, marker,
  {Q.preprocess("inp", "preserved", replace_literals)} AS input, {Q.preprocess("gt", "preserved", replace_literals)} AS gt
  FROM rt, grid)"""


TASKS = f"""WITH {_tasks(True)}
SELECT path, 'test' AS split, variant, comments, ordinal, marker, md5(input) AS input_digest, gt FROM tasks"""

SIZES = f"""WITH {_tasks(False)}
SELECT variant || '-' || comments AS dataset, count(*) AS tasks, sum(length(gt)) AS gt_chars FROM tasks GROUP BY 1"""

SINK = f"""WITH {_tasks(True)}
SELECT variant, comments, count(*) AS tasks, sum(length(input)) AS input_chars FROM tasks GROUP BY 1, 2"""


def _scored() -> str:
    """Exact match of the previous-line baseline on every test task, per dataset."""
    # imported here: that module registers queries built on this one
    from maskforge.plans.q_metrics import postprocess_sql
    return f"""{_tasks(True)},
bl AS (SELECT path, ordinal, variant || '-' || comments AS dataset, {postprocess_sql("gt", "g")},
  {postprocess_sql("coalesce([x for x in string_split(input, '<EOL>') if trim(x) <> ''][-1], '')", "p")} FROM tasks),
em AS (SELECT path, ordinal, dataset, p = '' AS empty, CAST(g = p AS INTEGER) AS hit FROM bl)"""


def significance(pairs=C.COMPARISONS) -> str:
    """A1-A8 for exact match: differences are -1, 0 or 1, so all non-zero ones share a rank."""
    planned = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""WITH {_scored()},
planned AS (SELECT * FROM (VALUES {planned}) AS planned(pop1, pop2)),
al AS (SELECT pop1, pop2, a.hit AS x, b.hit AS y FROM planned JOIN em a ON a.dataset = pop1
  JOIN em b ON b.dataset = pop2 AND b.path = a.path AND b.ordinal = a.ordinal WHERE NOT a.empty AND NOT b.empty),
st AS (SELECT pop1, pop2, count(*) AS pairs, CAST(sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS DOUBLE) AS n,
  CAST(sum(CASE WHEN x > y THEN 1 ELSE 0 END) AS DOUBLE) AS plus, avg(x) - avg(y) AS delta FROM al GROUP BY 1, 2),
z AS (SELECT *, (least(plus, n - plus) * (n + 1) / 2.0 - n * (n + 1) / 4.0)
  / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - (n * n * n - n) / 48.0) AS z FROM st WHERE n > 0)
SELECT pop1, pop2, coalesce(st.pairs, 0) AS pairs, CAST(nullif(st.n, 0) AS BIGINT) AS n, round(z.z, 6) AS z,
  round(st.delta, 9) AS delta
FROM planned LEFT JOIN st USING (pop1, pop2) LEFT JOIN z USING (pop1, pop2)"""


def leaderboard() -> str:
    """E14's exact-match column: the share of hits in percent per types and comments."""
    types = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.TYPE_CODES)
    comments = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.COMMENT_CODES)
    return f"""WITH {_scored()}
SELECT CASE split_part(dataset, '-', 1) {types} END AS types, CASE split_part(dataset, '-', 2) {comments} END AS comments,
  CAST(sum(CASE WHEN empty THEN 0 ELSE 1 END) AS BIGINT) AS n, CAST(sum(CASE WHEN empty THEN 0 ELSE hit END) AS BIGINT) AS hits
FROM em GROUP BY 1, 2"""
