"""The stemmer published by M. F. Porter in 1980, written from the paper's rules.

A word is read as [C](VC)^m[V]; m is its measure. Each step replaces the longest
ending of its table that fits, if what stands before meets the condition.
"""

from __future__ import annotations

import re


def shape(word: str) -> str:
    """A v or c per letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c", shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


# The paper's tables of endings for steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and words with other letters than a to z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):  # 1a
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):  # 1b
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):  # 1c
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _longest(w, table)
        if end is not None and measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, STEP_4)
    if end is not None:
        rest = w[: -len(end)]
        if measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):  # 5a
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:  # 5b
        w = w[:-1]
    return w
