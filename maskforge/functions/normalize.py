"""P4-P11 token normalisation and E2/E15 prediction clean-up, as Column functions.

The whole normalisation of one document is a single projection:

1. tokenise (P1) and replace templates with substitutions by an empty template (P4);
2. drop comments by class bitmask; marker comments always go (P5/P6);
3. render every token to text (P10), prefixing whitespace tokens and line
   terminators with two Unicode noncharacters as boundary sentinels;
4. P8 (a whitespace token directly after another one is dropped unless it is in a
   line's leading indentation) and P9 (a line terminator directly after another is
   dropped) become two regular-expression rewrites over the sentinel text, because
   the sentinels keep token boundaries visible even where a removed comment used to
   sit between two whitespace tokens;
5. strip the sentinels.

No window, no explode, no shuffle; cost is linear in the document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.functions import lexer as L

WS_MARK = "\uFDD0"   # noncharacters: never part of interchanged text
LT_MARK = "\uFDD1"
_J_WS = r"\uFDD0"
_J_LT = r"\uFDD1"
_J_WS_BODY = r"[\t\x0B\f\uFEFF\p{Zs}]++"
_J_LT_BODY = r"(?:<EOL>|\r\n|[\n\r\u2028\u2029])"
# JavaScript's \s (used by trim / split / replace in the study's code)
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

P8_PATTERN = ("(" + _J_LT + _J_LT_BODY + "(?:" + _J_WS + _J_WS_BODY + ")*+)"
              "|(" + _J_WS + _J_WS_BODY + ")(?:" + _J_WS + _J_WS_BODY + ")++")
P9_PATTERN = "(" + _J_LT + _J_LT_BODY + ")(?:" + _J_LT + _J_LT_BODY + ")++"


def is_docblock(tok: Column) -> Column:
    v = tok["value"]
    lines = F.split(v, "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return ((tok["type"] == L.MULTI_LINE_COMMENT) & v.startswith("/**")
            & F.forall(rest, lambda line: line.rlike("^" + JS_SPACE + r"*\*")))


def is_marker_comment(tok: Column) -> Column:
    return (tok["type"] == L.MULTI_LINE_COMMENT) & tok["value"].rlike(C.MARKER_PATTERN)


def keep_comment_class(tok: Column, preserved: int | Column) -> Column:
    """True when the token survives the comment filter for bitmask ``preserved``
    (a Python int, or an INT column for a per-row comment class)."""
    p = preserved if isinstance(preserved, Column) else F.lit(preserved)

    def off(bit):
        return p.bitwiseAND(F.lit(bit)) == 0

    doc = is_docblock(tok)
    is_ml = tok["type"] == L.MULTI_LINE_COMMENT
    drop = (is_marker_comment(tok)
            | (off(C.MULTI_LINE) & is_ml & ~doc)
            | (off(C.MULTI_LINE) & off(C.DOCBLOCK) & doc)
            | (off(C.SINGLE_LINE) & (tok["type"] == L.SINGLE_LINE_COMMENT)))
    return ~drop


def replace_templates(tokens: Column) -> Column:
    """A template with substitutions becomes the empty template ``````."""
    return F.transform(tokens, lambda t: F.when(
        t["type"] == L.TEMPLATE_STRING,
        F.struct(F.lit(L.NO_SUB_TEMPLATE).alias("type"), F.lit("``").alias("value")),
    ).otherwise(t))


def _render_as(cls: str, v: Column, replace_literals: bool) -> Column:
    """P4 and P10 for one token text of class ``cls``, with boundary sentinels on whitespace and newlines."""
    if cls == L.WHITESPACE:
        return F.concat(F.lit(WS_MARK), v)
    if cls == L.LINE_TERMINATOR:
        return F.concat(F.lit(LT_MARK), F.lit("<EOL>") if replace_literals else v)
    if cls == L.TEMPLATE_STRING:
        return F.lit("`<STR_LIT>`" if replace_literals else "``")
    if replace_literals:
        if cls in (L.STRING, L.NO_SUB_TEMPLATE):
            return F.concat(F.substring(v, 1, 1), F.lit("<STR_LIT>"), F.substring(v, -1, 1))
        if cls == L.MULTI_LINE_COMMENT:
            return F.replace(v, F.lit("\n"), F.lit("<EOL>"))
        if cls == L.NUMBER:
            return F.lit("<NUM_LIT>")
    return v


def _render(tok: Column, replace_literals: bool) -> Column:
    """:func:`_render_as` for a token whose class is a value."""
    t, v = tok["type"], tok["value"]
    out = F
    for cls in (L.WHITESPACE, L.LINE_TERMINATOR, L.TEMPLATE_STRING, L.STRING, L.NO_SUB_TEMPLATE, L.MULTI_LINE_COMMENT, L.NUMBER):
        out = out.when(t == cls, _render_as(cls, v, replace_literals))
    return out.otherwise(v)


#: what the comment filter asks of a rendered token
_KEPT, _SINGLE, _MULTI, _DOC, _MARKER = range(5)


def rendered(tokens: Column, replace_literals: bool) -> Column:
    """ARRAY<STRUCT<kind, text>>: every token as P4 and P10 render it, with its kind of comment, so
    that the filters of several comment classes need no further look at the token."""
    def kind(t):
        return (F.when(t["type"] == L.SINGLE_LINE_COMMENT, F.lit(_SINGLE)).when(t["type"] != L.MULTI_LINE_COMMENT, F.lit(_KEPT))
                .when(is_marker_comment(t), F.lit(_MARKER)).when(is_docblock(t), F.lit(_DOC)).otherwise(F.lit(_MULTI)))

    return F.transform(tokens, lambda t: F.struct(kind(t).alias("kind"), _render(t, replace_literals).alias("text")))


def class_texts(shown: Column, preserved: int) -> Column:
    """P6 on :func:`rendered` tokens: their texts, empty for comments that go, places unchanged."""
    dropped = [_MARKER]
    if not preserved & C.SINGLE_LINE:
        dropped.append(_SINGLE)
    if not preserved & C.MULTI_LINE:
        dropped += [_MULTI] if preserved & C.DOCBLOCK else [_MULTI, _DOC]
    return F.transform(shown, lambda x: F.when((x["kind"] == _KEPT) | ~x["kind"].isin(*dropped), x["text"]).otherwise(F.lit("")))


def dedupe_space(sentinel_text: Column, source: Column | None = None) -> Column:
    """P8 then P9 over sentinel text, then strip the sentinels; of a ``source`` text without these
    characters every one in its sentinel text is a sentinel."""
    s = F.regexp_replace(sentinel_text, P8_PATTERN, "$1$2")
    s = F.regexp_replace(s, P9_PATTERN, "$1")
    if source is None:
        return _stripped(s)
    own = source.contains(WS_MARK) | source.contains(LT_MARK)
    return L.once(s, lambda x: F.when(own, _stripped(x)).otherwise(
        F.replace(F.replace(x, F.lit(WS_MARK), F.lit("")), F.lit(LT_MARK), F.lit(""))))


def _stripped(s: Column) -> Column:
    # a sentinel stands right before its token; the same characters of a text never do
    return F.regexp_replace(s, _J_WS + r"(?=[\t\x0B\f\uFEFF\p{Zs}])|" + _J_LT + "(?=" + _J_LT_BODY + ")", "")


def preprocess(text: Column, preserved: int | Column, replace_literals: bool) -> Column:
    """P1 -> P4 -> P6 -> P8 -> P9 -> P10 in one projection.

    A token's class is known where its first characters are told apart, so it is rendered there."""
    def shown(v):
        def one(cls):
            tok = F.struct(F.lit(cls).alias("type"), v.alias("value"))
            text = _render_as(cls, v, replace_literals)
            if cls in (L.SINGLE_LINE_COMMENT, L.MULTI_LINE_COMMENT):
                text = F.when(keep_comment_class(tok, preserved), text).otherwise(F.lit(""))
            return text

        return L.classify(v, one)

    return dedupe_space(F.array_join(F.transform(L.token_values(text), shown), ""), F.coalesce(text, F.lit("")))


def preprocess_tokens(tokens: Column, preserved: int | Column, replace_literals: bool) -> Column:
    """P11 on an already tokenised column (tokenise once, normalise per class)."""
    def text(t):
        comment = t["type"].isin(L.SINGLE_LINE_COMMENT, L.MULTI_LINE_COMMENT)
        return F.when(comment & ~keep_comment_class(t, preserved), F.lit("")).otherwise(_render(t, replace_literals))

    return dedupe_space(F.array_join(F.transform(tokens, text), ""))


def class_text(shown: Column, preserved: int) -> Column:
    """P11 for one comment class of :func:`rendered` tokens."""
    return dedupe_space(F.array_join(class_texts(shown, preserved), ""))


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, "^" + JS_SPACE + "+|" + JS_SPACE + "+$", "")


def postprocess(code: Column, compat_bos_cut: bool = False) -> Column:
    """Normalise a prediction or ground truth before scoring.

    Cut at ``<s>`` / ``</s>``, drop comments, numbers -> ``0``, strings -> ``""``,
    whitespace tokens -> one space, placeholders -> ``""`` / ``0``, collapse all
    whitespace, trim.  ``compat_bos_cut`` keeps the original off-by-two cut after
    ``<s>`` (which leaves ``s>`` in front).
    """
    c = F.coalesce(code, F.lit(""))
    skip = 1 if compat_bos_cut else 3
    pos = F.instr(c, "<s>")
    c = F.when(pos > 0, c.substr(pos + F.lit(skip), F.length(c))).otherwise(c)
    end = F.instr(c, "</s>")
    c = F.when(end > 0, c.substr(F.lit(1), end - F.lit(1))).otherwise(c)
    def plain(v):
        shown = {L.NUMBER: "0", L.STRING: '""', L.NO_SUB_TEMPLATE: '""', L.WHITESPACE: " ",
                 L.SINGLE_LINE_COMMENT: "", L.MULTI_LINE_COMMENT: ""}
        return L.classify(v, lambda cls: F.lit(shown[cls]) if cls in shown else v)

    c = F.array_join(F.transform(L.token_values(c), plain), "")
    c = F.regexp_replace(c, "['\"`]<STR_LIT>['\"`]", '""')
    c = F.replace(c, F.lit("<NUM_LIT>"), F.lit("0"))
    c = F.regexp_replace(c, JS_SPACE + "+", " ")
    return js_trim(L.remove_comments(c))


def placeholder_cleanup(code: Column) -> Column:
    """Model-side placeholders back to code."""
    c = code
    for a, b in (("<string", "<STR_LIT"), ("<number", "<NUM_LIT"), ("<char", "<CHAR_LIT")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.replace(c, F.lit("<NUM_LIT>"), F.lit("0"))
    c = F.replace(c, F.lit("<STR_LIT>"), F.lit(""))
    c = F.replace(c, F.lit("<CHAR_LIT>"), F.lit(""))
    return F.regexp_replace(c, r"(?s)<(STR|NUM|CHAR)_LIT:(.*?)>", "$2")
