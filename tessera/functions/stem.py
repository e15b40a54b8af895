"""English stems by the published Porter algorithm (1980), over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy][aeiou]*"
_MORE_THAN_0 = re.compile(f"^({_C})?{_V}{_C}")
_ONE = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_MORE_THAN_1 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^({_C})?{_V}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
# The published suffix lists of steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    if len(word) < 3:
        return word
    w = word.lower()
    initial_y = w[0] == "y"
    if initial_y:
        w = "Y" + w[1:]
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _MORE_THAN_0.match(w[:-3]) else w
    else:
        cut = _longest(w, ("ed", "ing"))
        if cut and _VOWEL.match(w[: -len(cut)]):
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")) or (_ONE.match(w) and _CVC.match(w)):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _MORE_THAN_0.match(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = _longest(w, (*_STEP4, "ion"))
    if s and _MORE_THAN_1.match(w[: -len(s)]) and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        stem = w[:-1]
        if _MORE_THAN_1.match(stem) or (_ONE.match(stem) and not _CVC.match(stem)):
            w = stem
    if w.endswith("ll") and _MORE_THAN_1.match(w):
        w = w[:-1]
    return "y" + w[1:] if initial_y else w


def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(lambda ts: None if ts is None else [porter(t) for t in ts])


def stem_terms(terms: Column) -> Column:
    """T8 for English: stems of an array of terms."""
    return F.pandas_udf(_stems, "array<string>")(terms)
