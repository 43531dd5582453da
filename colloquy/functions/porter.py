"""Tokens as a Porter-stemming full-text index has them: folded, split at non-alphanumerics, stemmed."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[^\W_]+")
VOWELS = "aeiou"

STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _forms(word: str) -> str:
    """c for a consonant and v for a vowel, letter by letter."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in VOWELS or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _forms(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _forms(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _forms(stem)[-1] == "c"


def _replace(word: str, endings: dict[str, str], least: int) -> str:
    for ending in sorted(endings, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + endings[ending] if _measure(stem) >= least else word
    return word


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """Porter's algorithm of 1980 with its later two rules (logi, bli)."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and "v" in _forms(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _forms(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2, 1), STEP3, 1)
    for ending in sorted(STEP4, key=len, reverse=True):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if _measure(base) > 1 and (ending != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def tokens(text: str | None) -> list[str]:
    text = text or ""
    folded = text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return [stem(t) for t in TOKEN.findall(folded)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(tokens)
