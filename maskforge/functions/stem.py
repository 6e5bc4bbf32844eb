"""Suffix stripping for English words (Porter, 1980), from the published rules.

A word is read as ``[C](VC)^m[V]``; ``m`` is its measure.  Each step replaces the longest of its
suffixes that the word ends in, if the stem before it meets the step's condition.
"""

from __future__ import annotations

import re
from functools import lru_cache

# --- fixed values: suffixes and replacements of the published steps ---------------------------
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize")
# -----------------------------------------------------------------------------------------------
_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(stem: str) -> str:
    """The stem with ``v`` for each vowel and ``c`` for each consonant (a ``y`` after a consonant
    is a vowel)."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    suffix = _longest(word, rules)
    if suffix is None or measure(word[:-len(suffix)]) < least:
        return word
    return word[:-len(suffix)] + rules[suffix]


def _inflection(word: str) -> str:
    """Plurals, then past and present participles, then a final y."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        suffix = _longest(word, ("ed", "ing"))
        if suffix and "v" in _shape(word[:-len(suffix)]):
            word = word[:-len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-cased word; words of one or two letters, and those with other characters
    than a-z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _replaced(_replaced(_inflection(word), STEP_2, 1), STEP_3, 1)
    suffix = _longest(word, (*STEP_4, "ion"))
    if suffix and measure(word[:-len(suffix)]) > 1 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[:-len(suffix)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
