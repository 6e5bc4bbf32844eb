"""Token texts in Python: classes, comment kinds, renderings and the space rules of P8 and P9.

The lexer cuts a text in the JVM; what reads every token of an array (marker places, untyping, the
five comment classes) gets the texts through Arrow and finds the class of a token by one look-up
of its text or first character, as ``lexer.classify`` does by comparisons.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge import config as C
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N

_BLANK = r"\t\x0B\f\uFEFF \u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
_PLAIN_TEMPLATE = re.compile(L._NO_SUB_FULL[1:-1])
_OTHER_BLANK = re.compile(f"[{_BLANK}]")
_LETTER = regex.compile(r"[\p{L}\p{Nl}]")


def _first_classes() -> dict[str, str]:
    """Classes of the first characters that decide alone."""
    out = {chr(c): L.INVALID for c in range(128)}
    out |= dict.fromkeys("\t\x0b\x0c ", L.WHITESPACE) | dict.fromkeys("\n\r", L.LINE_TERMINATOR)
    out |= dict.fromkeys("0123456789", L.NUMBER) | dict.fromkeys("\"'", L.STRING)
    out |= dict.fromkeys("!%&()*+,-:;<=>?[]^{|}~", L.PUNCTUATOR)
    out |= {chr(c): L.IDENTIFIER for c in [*range(65, 91), *range(97, 123), ord("$"), ord("_")]}
    for c in "#./`":
        del out[c]
    return out


FIRST = _first_classes()


def token_class(v: str) -> str:
    """The class of a token text (see ``lexer.classify``)."""
    c = v[0]
    found = FIRST.get(c)
    if found is not None:
        return found
    if c == "/":
        if v.startswith("/*"):
            return L.MULTI_LINE_COMMENT
        if v.startswith("//"):
            return L.SINGLE_LINE_COMMENT
        return L.REGEX if len(v) > 2 else L.PUNCTUATOR
    if c == ".":
        return L.NUMBER if "0" <= v[1:2] <= "9" else L.PUNCTUATOR
    if c == "#":
        return L.PRIVATE_IDENTIFIER if len(v) > 1 else L.INVALID
    if c == "`":
        if _PLAIN_TEMPLATE.fullmatch(v):
            return L.NO_SUB_TEMPLATE
        return L.TEMPLATE_HEAD if v.endswith("${") and "}" not in v else L.TEMPLATE_STRING
    if _OTHER_BLANK.match(c):
        return L.WHITESPACE
    if c in "\u2028\u2029":
        return L.LINE_TERMINATOR
    return L.IDENTIFIER if _LETTER.match(c) else L.INVALID


class Codes:
    """One character for each token text: that of ``fixed`` texts, else that of its class."""

    def __init__(self, fixed: dict[str, str], classes: dict[str, str]):
        self.fixed, self.classes = fixed, classes
        self.first = {c: classes[name] for c, name in FIRST.items()}

    def of(self, values) -> str:
        fixed, first, classes = self.fixed.get, self.first.get, self.classes
        return "".join([fixed(v) or first(v[0]) or classes[token_class(v)] for v in values])


CLASSES = (L.STRING, L.NO_SUB_TEMPLATE, L.TEMPLATE_HEAD, L.TEMPLATE_MIDDLE, L.TEMPLATE_TAIL, L.TEMPLATE_STRING, L.REGEX,
           L.MULTI_LINE_COMMENT, L.SINGLE_LINE_COMMENT, L.IDENTIFIER, L.PRIVATE_IDENTIFIER, L.NUMBER, L.PUNCTUATOR,
           L.WHITESPACE, L.LINE_TERMINATOR, L.INVALID)

# what the space rules and the comment filter ask of a token, one character each
BLANK, LINE, SINGLE, MULTI, DOC, MARKER, OTHER = "wlsmdko"
_KINDS = Codes({}, dict.fromkeys(CLASSES, OTHER) | {
    L.WHITESPACE: BLANK, L.LINE_TERMINATOR: LINE, L.SINGLE_LINE_COMMENT: SINGLE, L.MULTI_LINE_COMMENT: MULTI,
    L.STRING: "q", L.NO_SUB_TEMPLATE: "q", L.NUMBER: "n", L.TEMPLATE_STRING: "t"})
_IS_MARKER = re.compile(r"/\*<marker:[0-9]+>\*/")
_DOC_LINE = re.compile(N.JS_SPACE + r"*\*")


def comment_kind(v: str) -> str:
    """The kind of a multi-line comment (P5)."""
    if _IS_MARKER.search(v):
        return MARKER
    return DOC if v.startswith("/**") and all(map(_DOC_LINE.match, v.split("\n")[1:])) else MULTI


def rendered(values, literals: bool) -> tuple[str, list[str]]:
    """Kinds and shown texts of the tokens."""
    kinds, shown = list(_KINDS.of(values)), list(values)
    for i, k in enumerate(kinds):
        if k == OTHER or k == BLANK or k == SINGLE:
            continue
        v = shown[i]
        if k == MULTI:
            kinds[i] = comment_kind(v)
            if literals and "\n" in v:
                shown[i] = v.replace("\n", "<EOL>")
        elif k == LINE:
            if literals:
                shown[i] = "<EOL>"
        else:
            kinds[i] = OTHER
            if k == "t":
                shown[i] = "`<STR_LIT>`" if literals else "``"
            elif literals:
                shown[i] = v[0] + "<STR_LIT>" + v[-1] if k == "q" else "<NUM_LIT>"
    return "".join(kinds), shown


def dropped_kinds(preserved: int) -> str:
    """Kinds of comments that go."""
    return (MARKER + ("" if preserved & C.SINGLE_LINE else SINGLE)
            + ("" if preserved & C.MULTI_LINE else MULTI if preserved & C.DOCBLOCK else MULTI + DOC))


def spaced(kinds: str, shown: list[str], dropped: str) -> list[str]:
    """``shown`` with what goes made empty.  A text depends on tokens before it alone, so
    the first ones of a text are the text of its first tokens.

    A blank right after another goes unless a line end and blanks alone stand before it; a line end
    right after another goes."""
    out = shown.copy()
    last = OTHER
    for i, k in enumerate(kinds):
        if k == OTHER:
            last = k
        elif k == BLANK:
            if last == BLANK:
                out[i] = ""
            elif last == OTHER:
                last = BLANK
            else:
                last = "i"  # indents its line
        elif k == LINE:
            if last == LINE:
                out[i] = ""
            last = LINE
        elif k in dropped:
            out[i] = ""
        else:
            last = OTHER
    return out


_BODY = f"[{_BLANK}]++"
_END = r"(?:<EOL>|\r\n|[\n\r\u2028\u2029])"
_P8 = re.compile(f"({N.LT_MARK}{_END}(?:{N.WS_MARK}{_BODY})*+)|({N.WS_MARK}{_BODY})(?:{N.WS_MARK}{_BODY})++")
_P9 = re.compile(f"({N.LT_MARK}{_END})(?:{N.LT_MARK}{_END})++")
_MARKS = re.compile(f"{N.WS_MARK}(?=[{_BLANK}])|{N.LT_MARK}(?={_END})")


def _by_marks(kinds: str, shown: list[str], dropped: str) -> str:
    """The rules by sentinels, as ``normalize.dedupe_space`` has them, for texts that hold these characters."""
    mark = {BLANK: N.WS_MARK, LINE: N.LT_MARK}
    s = "".join([mark.get(k, "") + v for k, v in zip(kinds, shown) if k not in dropped])
    s = _P8.sub(lambda m: m[1] or m[2], s)
    return _MARKS.sub("", _P9.sub(r"\1", s))


class ClassTexts:
    """Texts of a token array in several comment classes; classes that drop the same tokens share them."""

    def __init__(self, values, literals: bool, masks):
        self.kinds, self.shown = rendered(values, literals)
        here = set(self.kinds)
        self.drops = ["".join(k for k in dropped_kinds(mask) if k in here) for mask in masks]
        self.marked = any(N.WS_MARK in v or N.LT_MARK in v for v in self.shown)

    def whole(self) -> list[str]:
        """The text of every class."""
        return [texts[0] for texts in self.heads([len(self.shown)])]

    def heads(self, stops: list[int]) -> list[list[str]]:
        """For every class the texts of the first ``stop`` tokens."""
        made: dict[str, list[str]] = {}
        for dropped in self.drops:
            if dropped not in made:
                made[dropped] = self._heads(stops, dropped)
        return [made[dropped] for dropped in self.drops]

    def _heads(self, stops: list[int], dropped: str) -> list[str]:
        if self.marked:
            return [_by_marks(self.kinds[:n], self.shown[:n], dropped) for n in stops]
        kept, out, text, last = spaced(self.kinds, self.shown, dropped), {}, "", 0
        for n in sorted(set(stops)):
            text += "".join(kept[last:n])
            out[n], last = text, n
        return [out[n] for n in stops]


def class_texts(tokens: Column, literals: bool, masks) -> Column:
    """P11 of token texts for several comment classes, ARRAY<STRING> in the order of ``masks``."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([ClassTexts(list(v), literals, masks).whole() for v in rows], dtype=object)

    return run(tokens)
