"""JavaScript/TypeScript tokenisation as a Column expression.

One Java regular expression (an ordered alternation of the lexical classes) is run
with ``regexp_extract_all``; each matched text is then classified by a ``CASE``
over its first characters.  Everything stays inside the JVM projection, so a
tokenised corpus costs one pass over the text and never shuffles.

Token classes are the names used by the ECMAScript lexical grammar (and by the
study's tokenizer), plus the synthetic ``TemplateString``: a template literal
with substitutions is one token, which is what grouping head/middle/tail tokens
would produce.  The expression alone matches them nested up to two levels; ``with_tokens``
and ``folded`` pass texts with nested substitutions through a stack automaton first, so that nesting
has no limit (see ``templates``).

Regular-expression literals are told apart from division by the last token before the
slash that is no blank and no comment: an operator, an opening bracket or a keyword.

Patterns use possessive quantifiers and unrolled comment loops so that very long
comments or strings never backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskforge.functions import templates

# --- fixed values: token class names ---------------------------------------
STRING = "StringLiteral"
NO_SUB_TEMPLATE = "NoSubstitutionTemplate"
TEMPLATE_HEAD = "TemplateHead"
TEMPLATE_MIDDLE = "TemplateMiddle"
TEMPLATE_TAIL = "TemplateTail"
TEMPLATE_STRING = "TemplateString"
REGEX = "RegularExpressionLiteral"
MULTI_LINE_COMMENT = "MultiLineComment"
SINGLE_LINE_COMMENT = "SingleLineComment"
IDENTIFIER = "IdentifierName"
PRIVATE_IDENTIFIER = "PrivateIdentifier"
NUMBER = "NumericLiteral"
PUNCTUATOR = "Punctuator"
WHITESPACE = "WhiteSpace"
LINE_TERMINATOR = "LineTerminatorSequence"
INVALID = "Invalid"
POTENTIAL_TYPE = "PotentialType"
# classes before which a marker may be placed
MASKABLE = (STRING, REGEX, IDENTIFIER, NUMBER, NO_SUB_TEMPLATE, PUNCTUATOR,
            PRIVATE_IDENTIFIER)
# ---------------------------------------------------------------------------

_WS_CLASS = r"\t\x0B\f\uFEFF\p{Zs}"
_ID_START = r"$_\p{L}\p{Nl}"
_ID_PART = r"$_\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\u200C\u200D"

_MLC = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|/\*[\s\S]*+"
_SLC = r"//[^\n\r\u2028\u2029]*+"
_STR = (r""""(?:[^"\\\n\r]++|\\(?:\r\n|[\s\S]))*+"?"""
        r"""|'(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+'?""")
_TCH = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))"
_T0 = r"`" + _TCH + r"*+`?"


def _sub(inner_template: str) -> str:
    body = r"""[^{}`"']++|""" + _STR + "|" + inner_template
    return r"\$\{(?:" + body + r"|\{(?:" + body + r")*+\})*+\}"


_T1 = r"`(?:" + _TCH + "|" + _sub(_T0) + r")*+`?"
_TEMPLATE = r"`(?:" + _TCH + "|" + _sub(_T1) + r")*+(?:`|\z)"
_TEMPLATE_HEAD = r"`" + _TCH + r"*+\$\{"
_RE = (r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[$_\p{L}\p{N}]*+")
_NUM = (r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*+|0[oO][0-7](?:_?[0-7])*+"
        r"|0[bB][01](?:_?[01])*+)n?"
        r"|(?:\d(?:_?\d)*+(?:\.(?:\d(?:_?\d)*+)?)?|\.\d(?:_?\d)*+)"
        r"(?:[eE][+-]?\d(?:_?\d)*+)?n?")
_PRIV = r"#[" + _ID_START + r"][" + _ID_PART + r"]*+"
_IDENT = r"[" + _ID_START + r"][" + _ID_PART + r"]*+"
_PUNCT_HEAD = (r"--|\+\+|=>|\.\.\.|\?\.(?!\d)|(?:&&|\|\||\?\?|[+\-%&|^]|\*\*?|<<?|>>?>?|!=?|==?)=?"
               r"|/=?|[?~,:;\[\]()")
_PUNCT = _PUNCT_HEAD + "{}.]"
_WS = r"[" + _WS_CLASS + r"]++"
_LT = r"\r\n|[\n\r\u2028\u2029]"

# A slash begins a regular expression when the last token before it that is no blank and no
# comment cannot end an operand.  That token, what lies between, and the expression are
# matched together, however far apart they are, and taken apart afterwards.
def _no_operand(signs: str) -> str:
    return (r"(?:(?!\+\+|--|[)\]}./])(?:" + signs + r")"
            r"|(?:return|typeof|case|do|else|in|of|new|delete|void|throw|yield|await|instanceof)(?![" + _ID_PART + "]))")


_BETWEEN = r"(?:" + _WS + "|" + _LT + r"|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|" + _SLC + ")*+"
_BEFORE_RE = "(?:" + _no_operand(_PUNCT) + _BETWEEN + r"|\A(?:" + _WS + "|" + _LT + ")*+)" + _RE

_PIECES = [_MLC, _SLC, _TEMPLATE, _TEMPLATE_HEAD, _STR, _NUM, _PRIV, _IDENT, _PUNCT, _WS, _LT, r"[\s\S]"]
# The commonest tokens in short form; none begins like a token of another piece, so they go first.
_COMMON = [r"[A-Za-z_$][A-Za-z0-9_$]*+[" + _ID_PART + r"]*+", r"[ \t][" + _WS_CLASS + r"]*+", r"[;:,()\[\]{}~]",
           r"=(?![=>])", r"\.(?![.\d])", r"\r\n|[\n\r]", r"[1-9]\d*+(?![.eEn_\d])", _SLC, _MLC, _STR]
#: tokens of a text in which no slash begins a regular expression
_PLAIN_PATTERN = "|".join([*_COMMON, *_PIECES])
TOKEN_PATTERN = "|".join([_BEFORE_RE, _PLAIN_PATTERN])
_PART_PATTERN = "|".join([_RE + r"\z", _MLC, _SLC, _IDENT, _PUNCT, _WS, _LT])

_NO_SUB_FULL = r"^`" + _TCH + r"*+`?$"


def classify(v: Column, of=F.lit) -> Column:
    """Token class of one matched token text, or what ``of`` makes of a class's name.

    The lexer already fixed token boundaries, so the first one or two characters decide the
    class.  Texts are compared by their bytes, so the ranges below are ranges of first characters
    and no character is cut out; only non-ASCII first characters need a Unicode-class regex.
    """
    def slash():
        return (F.when(v.startswith("/*"), of(MULTI_LINE_COMMENT)).when(v.startswith("//"), of(SINGLE_LINE_COMMENT))
                .when(F.length(v) > 2, of(REGEX)).otherwise(of(PUNCTUATOR)))

    template = (F.when(v.rlike(_NO_SUB_FULL), of(NO_SUB_TEMPLATE))
                .when(v.endswith("${") & ~v.rlike(r"\}"), of(TEMPLATE_HEAD)).otherwise(of(TEMPLATE_STRING)))
    other = (F.when(v.rlike("^[" + _WS_CLASS + "]"), of(WHITESPACE)).when(v.rlike("^[\u2028\u2029]"), of(LINE_TERMINATOR))
             .when(v.rlike("^[" + _ID_START + "]"), of(IDENTIFIER)).otherwise(of(INVALID)))
    low = (F.when(v >= " ", of(WHITESPACE)).when(v < "\t", of(INVALID)).when(v < "\n", of(WHITESPACE))
           .when((v < "\x0b") | ((v >= "\r") & (v < "\x0e")), of(LINE_TERMINATOR))
           .when(v < "\r", of(WHITESPACE)).otherwise(of(INVALID)))
    signs = (F.when(v >= ":", of(PUNCTUATOR)).when(v >= "0", of(NUMBER)).when(v >= "/", slash())
             .when(v >= ".", F.when((v >= ".0") & (v < ".:"), of(NUMBER)).otherwise(of(PUNCTUATOR)))
             .when(v >= "(", of(PUNCTUATOR)).when((v >= "'") | ((v >= '"') & (v < "#")), of(STRING))
             .when((v >= "%") | (v < '"'), of(PUNCTUATOR)).when(v >= "$", of(IDENTIFIER))
             .otherwise(F.when(F.length(v) > 1, of(PRIVATE_IDENTIFIER)).otherwise(of(INVALID))))
    middle = (F.when(v < "A", of(INVALID)).when(v < "[", of(IDENTIFIER))
              .when((v >= "\\") & (v < "]"), of(INVALID)).when(v < "_", of(PUNCTUATOR))
              .when(v < "`", of(IDENTIFIER)).otherwise(template))
    return (F.when(v >= "a", F.when(v < "{", of(IDENTIFIER)).when(v < "\x7f", of(PUNCTUATOR))
                   .when(v < "\x80", of(INVALID)).otherwise(other))
            .when(v < "!", low).when(v < "@", signs).otherwise(middle))


def _jumps() -> templates.Patterns:
    """The template automaton's patterns, from the same pieces."""
    signs = _PUNCT_HEAD + ".]"  # braces are places where the automaton stops
    return templates.Patterns(_no_operand(signs) + _BETWEEN + _RE, _BETWEEN, "(?:" + _WS + "|" + _LT + ")*+", _RE,
                              [_MLC, _SLC, _STR], [_NUM, _PRIV, _IDENT, signs, _WS, _LT])


_JUMPS = _jumps()


def _joined(v: Column) -> Column:
    """A regular expression with what stands before it: no other token that begins otherwise
    has a slash."""
    return v.contains("/") & ~F.substring(v, 1, 1).isin("/", '"', "'", "`")


def _parted(found: Column) -> Column:
    """Matches with regular expressions apart from what stands before them."""
    parts = F.flatten(F.transform(found, lambda v: F.when(
        _joined(v), F.regexp_extract_all(v, F.lit(_PART_PATTERN), 0)).otherwise(F.array(v))))
    return F.when(F.exists(found, _joined), parts).otherwise(found)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lexed(text: Column) -> Column:
    # up to the first plain slash both patterns find the same tokens, so a text without one is done;
    # the text stands beside its matches, as a lambda that reads another's variable keeps Spark from
    # finding the Python functions of a query
    def whole(x):
        slash = F.array_contains(x["found"], "/") | F.array_contains(x["found"], "/=")
        return F.when(slash, once(F.regexp_extract_all(x["text"], F.lit(TOKEN_PATTERN), 0), _parted)).otherwise(x["found"])

    plain = F.regexp_extract_all(text, F.lit(_PLAIN_PATTERN), 0)
    values = once(F.struct(text.alias("text"), plain.alias("found")), whole)
    return F.when(text.contains(templates.MARK), F.transform(values, templates.unfold)).otherwise(values)


def token_values(text: Column) -> Column:
    """ARRAY<STRING> of token texts; ``array_join(values, '')`` equals the input."""
    return once(F.coalesce(text, F.lit("")), _lexed)


def tokenize(text: Column) -> Column:
    """ARRAY<STRUCT<type STRING, value STRING>> in document order."""
    return F.transform(token_values(text),
                       lambda v: F.struct(classify(v).alias("type"), v.alias("value")))


def is_comment(v: Column) -> Column:
    """Whether a token text is a comment: no token of another class begins like one."""
    return v.startswith("//") | v.startswith("/*")


def held(df: DataFrame, out: str, value: Column) -> DataFrame:
    """``df`` with ``value`` in ``out``, evaluated once a row.  A column made by a projection is written
    into each expression that reads it, and into filters on those; what a generator makes is not."""
    return df.select(*[c for c in df.columns if c != out], F.explode(F.array(value)).alias(out))


def folded(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``text`` in ``out``, its nested templates folded for :func:`token_values`, which
    unfolds them."""
    return df.withColumn(out, templates.fold(F.col(text), _JUMPS))


def with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the tokens of ``text`` in ``out``, templates nested to any depth included."""
    return held(folded(df, text, "__folded"), out, tokenize(F.col("__folded"))).drop("__folded")


def with_token_values(df: DataFrame, text: str, out: str) -> DataFrame:
    """:func:`with_tokens` for readers that look at each token once: the texts alone."""
    return held(folded(df, text, "__folded"), out, token_values(F.col("__folded"))).drop("__folded")


def is_maskable(tok: Column) -> Column:
    return tok["type"].isin(*MASKABLE)


def join_values(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["value"]), "")


def remove_comments(text: Column) -> Column:
    """Drop single- and multi-line comments, keep everything else verbatim."""
    return F.array_join(F.filter(token_values(text), lambda v: ~is_comment(v)), "")
