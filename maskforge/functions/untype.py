"""The untyped variant - bracket-aware removal of type annotations on token codes.

A file's tokens become one character each (``syntax_code``).  An Arrow UDF reads that string once
and returns the token ranges to drop: types of declared variables and of catch variables, parameter
and return types of function declarations and arrow functions, and, where such a function has a
parameter or a return type, its type parameters.  Class members, function expressions, type
aliases, interfaces and casts keep their types.  The text is then joined from the token slices that
stay, so everything else keeps its place, blanks and comments included; a comment inside a dropped
type goes with it.

Brackets are paired beforehand, so a type, an initialiser or a parameter list is passed over in
steps of whole groups and the scan is linear in the tokens of a file.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge.functions import lexer as L
from maskforge.functions import values as V
from maskforge.session import small_batches

# --- fixed values: keywords and punctuators that decide, by their code ---------------------
WORDS = {
    "V": ("const", "let", "var"), "F": ("function",), "C": ("catch",), "K": ("class",), "X": ("extends",),
    "E": ("export", "default", "async", "declare"), "S": ("is",), "T": ("type",), "I": ("interface",),
    "Y": ("as", "satisfies"), "k": ("keyof", "readonly", "unique", "infer", "asserts", "abstract"),
    "t": ("typeof", "new"), "M": ("import",),
    "r": ("return", "case", "delete", "void", "throw", "in", "of", "instanceof", "yield", "await", "else", "do"),
}
SIGNS = {**{c: c for c in "()[]{}<>:,;=?.|&-!*@"}, "=>": "A", "...": "D", ">>": "2", ">>>": "3"}
# -------------------------------------------------------------------------------------------
NAMES = frozenset("ikSETIY")
_CLOSE = {")": "(", "]": "[", "}": "{"}
_BRACKET, _SPACE = re.compile(r"[()\[\]{}]"), re.compile("[wn]+")
#: codes at which a scan looks, and those at which a type that stays or goes may begin (or the end)
_DECIDES = frozenset("VCKITYF(:{}=<;")
_NEXT = re.compile(r"[VCKITYF(:{}=<;\0]")


def syntax_code(tok: Column) -> Column:
    """One character for a token: its keyword class or punctuator, ``i`` another name, ``l`` a
    literal, ``n`` a line end, ``w`` a blank or comment, ``o`` anything else."""
    kind, value = tok["type"], tok["value"]

    def named(codes, rest):
        """The code of ``value`` among ``codes``; one set tells whether it has any."""
        each = F.lit(rest)
        for code, values in codes.items():
            each = F.when(value.isin(*values), F.lit(code)).otherwise(each)
        return F.when(value.isin(*[x for values in codes.values() for x in values]), each).otherwise(F.lit(rest))

    same = [sign for sign, code in SIGNS.items() if sign == code]
    others = {code: (sign,) for sign, code in SIGNS.items() if sign != code}
    return (F.when(kind.isin(L.WHITESPACE, L.SINGLE_LINE_COMMENT, L.MULTI_LINE_COMMENT), F.lit("w"))
            .when(kind == L.IDENTIFIER, named(WORDS, "i"))
            .when(kind == L.PUNCTUATOR, F.when(value.isin(*same), value).otherwise(named(others, "o")))
            .when(kind == L.LINE_TERMINATOR, F.lit("n")).when(kind == L.PRIVATE_IDENTIFIER, F.lit("i"))
            .when(kind.isin(L.STRING, L.NUMBER, L.NO_SUB_TEMPLATE, L.TEMPLATE_STRING, L.REGEX), F.lit("l"))
            .otherwise(F.lit("o")))


class Scan:
    """Where types stand in a string of token codes."""

    def __init__(self, code: str):
        n = len(code)
        self.code = code + "\0"  # one past the end is no token
        self.pair = [-1] * (n + 1)
        open_: list[int] = []
        for m in _BRACKET.finditer(code):
            c, i = m[0], m.start()
            if c in "([{":
                open_.append(i)
            elif open_ and code[open_[-1]] == _CLOSE[c]:
                self.pair[open_.pop()] = i
        #: first token from a place on that is no blank (``line``), nor a line end (``next``)
        self.line, self.next = list(range(n + 2)), list(range(n + 2))
        self.line[n + 1] = self.next[n + 1] = n
        #: last token before a place that is neither
        self.before = list(range(-1, n))
        for m in _SPACE.finditer(code):
            s, e = m.span()
            self.next[s:e] = [e] * (e - s)
            self.before[s + 1:e + 1] = [s - 1] * (e - s)
            if "n" not in m[0]:
                self.line[s:e] = self.next[s:e]
                continue
            end = e
            for i in range(e - 1, s - 1, -1):
                end = end if code[i] == "w" else i
                self.line[i] = end
        self.n = n

    def past(self, i: int) -> int:
        """The place after token ``i``, or after the group it opens."""
        return self.pair[i] + 1 if self.pair[i] >= 0 else i + 1

    def generic_end(self, i: int) -> int | None:
        """The place after the ``>`` that closes the ``<`` at ``i``."""
        depth = 0
        while i < self.n:
            c = self.code[i]
            depth += {"<": 1, ">": -1, "2": -2, "3": -3}.get(c, 0)
            if depth <= 0:
                return i + 1 if depth == 0 else None
            if c in ";)]}":
                return None
            i = self.past(i)
        return None

    def is_parameter_list(self, i: int) -> bool:
        """Whether the round group at ``i`` of a type holds parameters and no type."""
        end, at = self.pair[i], self.next[i + 1]
        c = self.code[at]
        if at == end or c == "D":
            return True
        if c not in NAMES and c not in "[{":
            return False
        after = self.next[self.past(at)]
        return self.code[after] in ":,?=" or (after == end and self.code[self.line[end + 1]] == "A")

    def type_end(self, i: int) -> int | None:
        """The place after the type that begins at or after ``i``; None where none does."""
        code, end, conditions = self.code, None, 0
        while True:
            i = self.next[i]
            while code[i] in "|&":
                i = self.next[i + 1]
            c, function = code[i], False
            if c in "kt" and (code[self.line[i + 1]] in NAMES or code[self.line[i + 1]] in "trlM([{<"):
                i += 1
                continue
            if c in NAMES or c in "trl":
                end = i + 1
            elif c == "M" and code[self.line[i + 1]] == "(":
                end = self.past(self.line[i + 1])
            elif c == "-" and code[self.line[i + 1]] == "l":
                end = self.line[i + 1] + 1
            elif c in "([{" and self.pair[i] >= 0:
                end, function = self.pair[i] + 1, c == "(" and self.is_parameter_list(i)
            elif c == "<" and self.generic_end(i):
                i = self.generic_end(i)  # type parameters of a function type
                continue
            else:
                return end
            while True:
                at = self.line[end]
                if code[at] == "." and code[self.next[at + 1]] in NAMES | frozenset("tr"):
                    end, function = self.next[at + 1] + 1, False
                elif code[at] == "<" and self.generic_end(at):
                    end, function = self.generic_end(at), False
                elif code[at] == "[" and self.pair[at] >= 0:
                    end, function = self.pair[at] + 1, False
                else:
                    break
            at, later = self.line[end], self.next[end]
            if code[at] == "S" or (code[at] == "A" and function):
                i = at + 1
            elif code[at] == "X":
                i, conditions = at + 1, conditions + 1
            elif code[later] in "|&" or (conditions and code[later] == "?"):
                i = later + 1
            elif conditions and code[later] == ":":
                i, conditions = later + 1, conditions - 1
            else:
                return end

    def annotation(self, i: int, allowed: str) -> tuple[int, int] | None:
        """Range of the annotation after a binding that ends before ``i``; one of ``allowed``
        may stand before its colon."""
        i = self.next[i]
        if self.code[i] in allowed:
            i = self.next[i + 1]
        if self.code[i] != ":":
            return None
        end = self.type_end(i + 1)
        return (i, end) if end else None

    def binding_end(self, i: int) -> int | None:
        c = self.code[i]
        return self.past(i) if c in NAMES or (c in "[{" and self.pair[i] >= 0) else None

    def parameters(self, i: int) -> list[tuple[int, int]]:
        """Annotations of the parameters in the round group at ``i``."""
        out, end, at = [], self.pair[i], self.next[i + 1]
        while at < end:
            while self.code[at] == "@":  # a decorator: a name and perhaps its arguments
                at = self.next[at + 2]
                if self.code[at] == "(":
                    at = self.next[self.past(at)]
            if self.code[at] == "D":
                at = self.next[at + 1]
            bound = self.binding_end(at)
            found = self.annotation(bound, "?") if bound else None
            if found:
                out.append(found)
                at = found[1]
            while at < end and self.code[at] != ",":
                at = self.past(at)
            at = self.next[at + 1]
        return out

    def declared(self, i: int) -> list[tuple[int, int]]:
        """Annotations of the variables a declaration keyword at ``i`` declares."""
        out, at = [], self.next[i + 1]
        while True:
            bound = self.binding_end(at)
            if bound is None:
                return out
            found = self.annotation(bound, "!")
            at = bound
            if found:
                out.append(found)
                at = found[1]
            while self.code[at] not in ",;)]}VF\0":
                at = self.past(at)
            if self.code[at] != ",":
                return out
            at = self.next[at + 1]

    def is_declaration(self, i: int) -> bool:
        """Whether the ``function`` at ``i`` stands where a statement begins."""
        at = self.before[i]
        while at >= 0 and self.code[at] == "E":
            i, at = at, self.before[at]
        if at < 0 or self.code[at] in ";{}":
            return True
        if "n" not in self.code[at + 1:i]:
            return self.code[at] == ")"
        return self.code[at] in NAMES or self.code[at] in ")]l"

    def type_parameters(self, i: int) -> tuple[int, int] | None:
        """Range of the ``<...>`` that ends right before the round group at ``i``."""
        at = last = self.before[i]
        if self.code[last] not in ">23":
            return None
        depth = 0
        while at >= 0 and self.code[at] not in ";{}()":
            depth += {">": 1, "2": 2, "3": 3, "<": -1}.get(self.code[at], 0)
            if depth == 0:
                return at, last + 1
            at -= 1
        return None

    def dropped(self) -> list[tuple[int, int]]:
        """Token ranges of all types that go, in order."""
        code, out = self.code, []
        kept: dict[int, int] = {}   # types that stay: from, to
        bodies: set[int] = set()    # opening braces of class bodies
        inside: list[int] = []      # open braces around the present place
        i = 0

        def drop(ranges):
            for s, e in ranges:
                out.append((s, e))
                kept[s] = e

        while i < self.n:
            if i in kept:
                i = kept[i]
                continue
            c = code[i]
            if c not in _DECIDES:
                # nothing is opened, declared or kept before the next of these
                i = _NEXT.search(code, i).start()
                continue
            last = code[self.before[i]] if self.before[i] >= 0 else ";"
            if c == "V" and last != ".":
                drop(self.declared(i))
            elif c == "C" and code[self.next[i + 1]] == "(":
                drop(self.parameters(self.next[i + 1]))
            elif c == "K" and last != ".":
                at = self.next[i + 1]
                while code[at] not in "{;\0":
                    at = self.generic_end(at) or at + 1 if code[at] == "<" else self.past(at)
                bodies.add(at)
            elif c == "I" and code[self.line[i + 1]] in NAMES and last in ";{}E":
                at = i
                while code[at] not in "{;\0":
                    at += 1
                kept[at] = self.past(at)
            elif c == "T" and code[self.line[i + 1]] in NAMES and last in ";{}En":
                at = self.next[self.line[i + 1] + 1]
                if code[at] == "<":
                    at = self.next[self.generic_end(at) or at + 1]
                if code[at] == "=" and self.type_end(at + 1):
                    kept[at] = self.type_end(at + 1)
            elif c == "Y" and (last in NAMES or last in ")]}l") and self.type_end(i + 1):
                kept[i] = self.type_end(i + 1)
                i = kept[i]
                continue
            elif c == "F" and last != ".":
                self._function(i, drop, kept)
            elif c == "(" and self.pair[i] >= 0:
                self._group(i, drop, kept)
            elif c == ":" and inside and inside[-1] in bodies and self.type_end(i + 1):
                kept[i] = self.type_end(i + 1)  # a member of a class
                i = kept[i]
                continue
            elif c == "{":
                inside.append(i)
            elif c == "}" and inside:
                inside.pop()
            i += 1
        return sorted(set(out))

    def _function(self, i: int, drop, kept: dict[int, int]) -> None:
        at = self.next[i + 1]
        if self.code[at] == "*":
            at = self.next[at + 1]
        if self.code[at] in NAMES:
            at = self.next[at + 1]
        generic = None
        if self.code[at] == "<" and self.generic_end(at):
            generic = (at, self.generic_end(at))
            at = self.next[generic[1]]
        if self.code[at] != "(" or self.pair[at] < 0:
            return
        types = self.parameters(at)
        result = self.annotation(self.pair[at] + 1, "\1")
        some = self.next[at + 1] < self.pair[at] or result
        types += [result] if result else []
        if self.is_declaration(i):
            drop(types + ([generic] if generic and some else []))
        else:
            kept.update(types)

    def _group(self, i: int, drop, kept: dict[int, int]) -> None:
        """A round group in code: the parameters of an arrow function or method, or neither."""
        end, last = self.pair[i], self.before[i]
        c = self.code[last] if last >= 0 else ";"
        generic = self.type_parameters(i)
        if generic:
            last = self.before[generic[0]]
            c = self.code[last] if last >= 0 else ";"
        after = self.next[end + 1]
        result = self.annotation(end + 1, "\1") if c != "?" or generic else None
        then = self.line[result[1]] if result else self.line[end + 1]
        called = (c in NAMES and c != "E") or c in ")]l"
        if self.code[then] == "A" and not called:
            types = self.parameters(i) + ([result] if result else [])
            if self.next[i + 1] < end or result:
                drop(types + ([generic] if generic else []))
        elif called and (self.code[after] == "{" or (result and self.code[self.next[result[1]]] == "{")):
            kept.update(self.parameters(i) + ([result] if result else []))  # a method


def dropped_ranges(code: str) -> list[int]:
    """Flat ``[from, to, from, to, ...]`` of the token ranges that go; ranges inside others are left out."""
    out: list[int] = []
    for s, e in Scan(code).dropped():
        if not out or s >= out[-1]:
            out += (s, e)
    return out


def _codes() -> V.Codes:
    """:func:`syntax_code` of whole token arrays, in Python."""
    classes = dict.fromkeys(V.CLASSES, "o") | dict.fromkeys((L.WHITESPACE, L.SINGLE_LINE_COMMENT, L.MULTI_LINE_COMMENT), "w")
    classes |= dict.fromkeys((L.IDENTIFIER, L.PRIVATE_IDENTIFIER), "i") | {L.LINE_TERMINATOR: "n"}
    classes |= dict.fromkeys((L.STRING, L.NUMBER, L.NO_SUB_TEMPLATE, L.TEMPLATE_STRING, L.REGEX), "l")
    signs = {sign: code for sign, code in SIGNS.items() if V.token_class(sign) == L.PUNCTUATOR}
    return V.Codes(signs | {word: code for code, words in WORDS.items() for word in words}, classes)


_CODES = _codes()
_GLUED = (">=", ">>=", ">>>=")


def untyped_text(values) -> str:
    """The text of a token array without its types; the closing signs of a type stand apart from an equals
    sign that touches them."""
    values = list(values)
    if any(v in _GLUED for v in values):
        values = [p for v in values for p in ((v[:-1], "=") if v in _GLUED else (v,))]
    cut = dropped_ranges(_CODES.of(values))
    if not cut:
        return "".join(values)
    parts, last = [], 0
    for s, e in zip(cut[::2], cut[1::2]):
        parts += values[last:s]
        last = e
    parts += values[last:]
    return "".join(parts)


@F.pandas_udf(T.StringType())
def _untyped_udf(values: pd.Series) -> pd.Series:
    return pd.Series([untyped_text(v) for v in values], dtype=object)


def with_untyped(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the untyped form of ``text`` in ``out`` (null texts: empty)."""
    small_batches(df.sparkSession)
    df = L.with_token_values(df, text, "__values")
    return df.withColumn(out, _untyped_udf(F.col("__values"))).drop("__values")
