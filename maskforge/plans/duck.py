"""SQL fragments for the DuckDB oracle twins of the Spark queries.

The oracle is an independent formulation: RE2 patterns (no look-around, no
possessive quantifiers) that agree with the Java lexer on the driver tables and
on the derived code corpus, and list lambdas in place of Spark's higher-order
functions.
"""

from __future__ import annotations

from maskforge import config as C


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS_CLASS = r"\t\x0B\f\x{FEFF}\p{Zs}"
ID_START = r"$_\pL\p{Nl}"
ID_PART = r"$_\pL\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\x{200C}\x{200D}"
NO_SUB = r"`(?:[^`\\$]|\\[\s\S]|\$[^{])*(?:\$)?`?"
PUNCT = (r"--|\+\+|=>|\.\.\.|(?:&&|\|\||\?\?|[+\-%&|^]|\*\*?|<<?|>>?>?|!=?|==?)=?"
         r"|/=?|\?\.|[?~,:;\[\](){}.]")
TOKEN_RE2 = "|".join([
    r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/\*[\s\S]*",
    r"//[^\n\r\x{2028}\x{2029}]*",
    r"`(?:[^`\\$]|\\[\s\S]|\$\{[^{}`]*\}|\$)*`?",
    r""""(?:[^"\\\n\r]|\\[\s\S])*"?|'(?:[^'\\\n\r]|\\[\s\S])*'?""",
    r"0[xX][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?n?",
    "#[" + ID_START + "][" + ID_PART + "]*",
    "[" + ID_START + "][" + ID_PART + "]*",
    PUNCT,
    "[" + WS_CLASS + "]+",
    r"\r\n|[\n\r\x{2028}\x{2029}]",
    r"[\s\S]",
])
JS_SPACE = (r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
            r"\x{205F}\x{3000}\x{FEFF}]")


def classify(v: str) -> str:
    return f"""(CASE WHEN starts_with({v}, '/*') THEN 'MultiLineComment'
 WHEN starts_with({v}, '//') THEN 'SingleLineComment'
 WHEN starts_with({v}, '`') THEN CASE WHEN regexp_full_match({v}, {q(NO_SUB)})
      THEN 'NoSubstitutionTemplate' ELSE 'TemplateString' END
 WHEN left({v}, 1) IN ('"', '''') THEN 'StringLiteral'
 WHEN left({v}, 1) = '/' AND length({v}) > 2 THEN 'RegularExpressionLiteral'
 WHEN regexp_matches({v}, '^[0-9]') OR regexp_matches({v}, '^\\.[0-9]') THEN 'NumericLiteral'
 WHEN left({v}, 1) = '#' AND length({v}) > 1 THEN 'PrivateIdentifier'
 WHEN left({v}, 1) IN (chr(10), chr(13), chr(8232), chr(8233)) THEN 'LineTerminatorSequence'
 WHEN regexp_matches({v}, {q('^[' + WS_CLASS + ']')}) THEN 'WhiteSpace'
 WHEN regexp_matches({v}, {q('^[' + ID_START + ']')}) THEN 'IdentifierName'
 WHEN regexp_full_match({v}, {q(PUNCT)}) THEN 'Punctuator'
 ELSE 'Invalid' END)"""


def token_values(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {q(TOKEN_RE2)})"


def tokenize(text: str) -> str:
    return (f"list_transform({token_values(text)}, lambda tv_: "
            f"{{'type': {classify('tv_')}, 'value': tv_}})")


def is_docblock(t: str) -> str:
    return (f"({t}.type = 'MultiLineComment' AND starts_with({t}.value, '/**') AND "
            f"len(list_filter(string_split({t}.value, chr(10))[2:], lambda ln_: NOT "
            f"regexp_matches(ln_, {q('^' + JS_SPACE + r'*\*')}))) = 0)")


def is_marker(t: str) -> str:
    return f"({t}.type = 'MultiLineComment' AND regexp_matches({t}.value, {q(C.MARKER_PATTERN)}))"


def keep_comment_class(t: str, preserved: str) -> str:
    """P6 with a SQL expression for the bitmask."""
    ml = f"({t}.type = 'MultiLineComment' AND NOT {is_docblock(t)})"
    return (f"(NOT {is_marker(t)}"
            f" AND NOT ((({preserved}) & {C.MULTI_LINE}) = 0 AND {ml})"
            f" AND NOT ((({preserved}) & {C.MULTI_LINE}) = 0 AND (({preserved}) & {C.DOCBLOCK}) = 0"
            f"          AND {is_docblock(t)})"
            f" AND NOT ((({preserved}) & {C.SINGLE_LINE}) = 0 AND {t}.type = 'SingleLineComment'))")


WS_MARK = r"\x{FDD0}"
LT_MARK = r"\x{FDD1}"
_LT_BODY = r"(?:<EOL>|\r\n|[\n\r\x{2028}\x{2029}])"
_WS_BODY = "[" + WS_CLASS + "]*"
P8 = ("(" + LT_MARK + _LT_BODY + "(?:" + WS_MARK + _WS_BODY + ")*)"
      "|(" + WS_MARK + _WS_BODY + ")(?:" + WS_MARK + _WS_BODY + ")+")
P9 = "(" + LT_MARK + _LT_BODY + ")(?:" + LT_MARK + _LT_BODY + ")+"


def render(t: str, replace_literals: bool) -> str:
    lt = "'<EOL>'" if replace_literals else f"{t}.value"
    lit = ""
    if replace_literals:
        lit = (f" WHEN {t}.type IN ('StringLiteral', 'NoSubstitutionTemplate') THEN "
               f"left({t}.value, 1) || '<STR_LIT>' || right({t}.value, 1)"
               f" WHEN {t}.type = 'MultiLineComment' THEN replace({t}.value, chr(10), '<EOL>')"
               f" WHEN {t}.type = 'NumericLiteral' THEN '<NUM_LIT>'")
    return (f"(CASE WHEN {t}.type = 'WhiteSpace' THEN chr(64976) || {t}.value"
            f" WHEN {t}.type = 'LineTerminatorSequence' THEN chr(64977) || {lt}{lit}"
            f" ELSE {t}.value END)")


def preprocess(text: str, preserved: str, replace_literals: bool) -> str:
    toks = (f"list_transform({tokenize(text)}, lambda tk_: CASE WHEN tk_.type = 'TemplateString' "
            f"THEN {{'type': 'NoSubstitutionTemplate', 'value': '``'}} ELSE tk_ END)")
    kept = f"list_filter({toks}, lambda tk_: {keep_comment_class('tk_', preserved)})"
    rendered = (f"array_to_string(list_transform({kept}, lambda tk_: "
                f"{render('tk_', replace_literals)}), '')")
    s = f"regexp_replace({rendered}, {q(P8)}, '\\1\\2', 'g')"
    s = f"regexp_replace({s}, {q(P9)}, '\\1', 'g')"
    return f"regexp_replace({s}, {q('[' + WS_MARK + LT_MARK + ']')}, '', 'g')"


def remove_comments(text: str) -> str:
    return (f"array_to_string(list_transform(list_filter({tokenize(text)}, lambda tk_: tk_.type "
            f"NOT IN ('SingleLineComment', 'MultiLineComment')), lambda tk_: tk_.value), '')")


def js_trim(s: str) -> str:
    return f"regexp_replace({s}, {q('^' + JS_SPACE + '+|' + JS_SPACE + '+$')}, '', 'g')"


def uniform(key_sql: str) -> str:
    """Hash-uniform in [0, 1): first 32 bits of md5 over 2^32."""
    return f"(('0x' || substr(md5({key_sql}), 1, 8))::BIGINT / 4294967296.0)"
