"""Template literals with substitutions, nested to any depth.

Whether a ``}`` ends a substitution or a block depends on what is open, so templates are found by a
stack automaton.  It reads a text in jumps: inside a template to its end or next ``${``, elsewhere
to the next backtick or brace, passing whole strings, comments and regular expressions with the
lexer's own patterns.  Only texts with a substitution that holds more than names and operators go
through it.  A slash begins a regular expression by what stands before it, so a text whose code has
no slash but those of comments needs no other tokens than strings and comments and is read
in longer jumps.  In every outermost template
that has a substitution it writes noncharacters for the backticks, dollar signs and backslashes
between its ends, so the lexer's expression matches it as one template; the tokens get their own
characters back.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: noncharacters, never part of interchanged text ---------------------------
MARK = "\uFDD2"  # for a dollar sign: every folded template has one
FOLDED, PLAIN = MARK + "\uFDD3\uFDD4", "$`\\"
# ---------------------------------------------------------------------------------------------

_TEXT = regex.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")


class Patterns:
    """Jump patterns made from the lexer's pieces; ``whole`` are those that may hold braces or
    backticks, comments and strings."""

    def __init__(self, before_regex: str, between: str, blank: str, regular: str, whole: list[str], others: list[str]):
        others = [*whole, *others]
        self.code = regex.compile("(?:" + "|".join([before_regex, *others, r"[^`{}]"]) + ")*+")
        self.opened = regex.compile("(?:" + between + regular + ")?+")
        self.begin = regex.compile("(?:" + blank + regular + ")?+")
        # for texts without plain slashes; a block without templates and blocks is one jump
        piece = "|".join([r"""[^`{}"'/]++""", *whole])
        block = r"\{(?:" + piece + r")*+\}"
        self.plain_code = re.compile("(?:" + piece + "|" + block + ")*+([`{}/])?")
        self.outer_text = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(`|\$\{)?")
        self.inner_text = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\$" + block + r")*+(`|\$\{)?")


def plain_templates(text: str, p: Patterns) -> list[tuple[int, int]] | None:
    """:func:`outer_templates` of a text without a plain slash in its code; None if it has one."""
    found, stack, n = [], [], len(text)
    code, outer, inner = p.plain_code.match, p.outer_text.match, p.inner_text.match
    at, begin, holds = 0, 0, False
    while at < n:
        if stack and stack[-1] == "`":
            m = (outer if len(stack) == 1 else inner)(text, at)
            at, c = m.end(), m[1]
            if c == "`":
                stack.pop()
                if not stack and holds:
                    found.append((begin, at))
            elif c:
                holds = True
                stack.append("$")
            else:
                break  # the text ends in an open template
            continue
        m = code(text, at)
        at, c = m.end(), m[1]
        if c == "`":
            if not stack:
                begin, holds = at - 1, False
            stack.append("`")
        elif c == "{":
            if stack:
                stack.append("{")
        elif c == "}":
            if stack:
                stack.pop()
        elif c:
            return None
    return found


def outer_templates(text: str, p: Patterns) -> list[tuple[int, int]]:
    """``(from, to)`` of closed outermost templates with a substitution."""
    found, stack, n = [], [], len(text)
    at = p.begin.match(text).end()
    begin, holds = 0, False
    while at < n:
        if stack and stack[-1] == "`":
            at = _TEXT.match(text, at).end()
            c = text[at:at + 1]
            if c == "$":
                holds = True
                stack.append("$")
                at = p.opened.match(text, at + 2).end()
                continue
            if c == "`":
                stack.pop()
                if not stack and holds:
                    found.append((begin, at + 1))
            at += 1
            continue
        at = p.code.match(text, at).end()
        c = text[at:at + 1]
        at += 1
        if c == "`":
            if not stack:
                begin, holds = at - 1, False
            stack.append("`")
        elif c == "{":
            if stack:
                stack.append("{")
            at = p.opened.match(text, at).end()
        elif c == "}" and stack:
            stack.pop()
    return found


def fold_text(text: str | None, p: Patterns) -> str | None:
    """The text with its outermost templates folded; None where there is none."""
    spans = [] if text is None else plain_templates(text, p)
    if spans is None:
        spans = outer_templates(text, p)
    if not spans:
        return None
    parts, last = [], 0
    for s, e in spans:
        inside = text[s + 1:e - 1]
        for c, mark in zip(PLAIN, FOLDED):
            inside = inside.replace(c, mark)
        parts += (text[last:s + 1], inside)
        last = e - 1
    return "".join(parts) + text[last:]


#: a substitution in which a template, block, string, comment or regular expression may begin
_NOT_PLAIN = r"""\$\{[^}]*[`{"'/]"""


def fold(text: Column, p: Patterns) -> Column:
    """Text with nested templates folded; texts with plain substitutions alone stay as they are."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fold_text(t, p) for t in texts], dtype=object)

    return F.coalesce(run(F.when(text.rlike(_NOT_PLAIN), text)), text)


def unfold(value: Column) -> Column:
    """A token's text with its own characters."""
    return F.when(value.startswith("`"), F.translate(value, FOLDED, PLAIN)).otherwise(value)
