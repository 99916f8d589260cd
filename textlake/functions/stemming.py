"""Porter's stemming algorithm for English, from its published description (1980)."""

from __future__ import annotations

import re

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy](?:[aeiou])*"
_MEASURED = {k: re.compile(f"^(?:{_C})?(?:{_V}{_C}){{{k},}}") for k in (1, 2)}
_ONE = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_HAS_VOWEL = re.compile(f"^(?:{_C})?{_V}")
_SHORT = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")

#: Suffixes of the second, third and fourth steps.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    """The stem of a lower-case word; words of other letters or under three letters stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    more = lambda stem, k: bool(_MEASURED[k].match(stem))  # noqa: E731  stem has k vowel-consonant runs or more
    vowel = lambda stem: bool(_HAS_VOWEL.match(stem))
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if more(w[:-3], 1) else w
    elif (s := _longest(w, ("ed", "ing"))) and vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _SHORT.match(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := _longest(w, table)) and more(w[: -len(s)], 1):
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, STEP4)) and more(w[: -len(s)], 2) and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        stem = w[:-1]
        if more(stem, 2) or (_ONE.match(stem) and not _SHORT.match(stem)):
            w = stem
    if w.endswith("ll") and more(w, 2):
        w = w[:-1]
    return w
