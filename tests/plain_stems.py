"""Stems word by word, for comparison with the column version."""

import re

from tripweave.functions.stemming import (
    DOUBLES, FOURTH, IRREGULAR, LONG_PREFIXES, SECOND, THIRD, UNCHANGED, UNCHANGED_AFTER_PLURAL)

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _past_and_gerund(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[:len(word) - len(suffix)]
    if suffix.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not suffix or not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT_END.match(base) else base


def stem_word(word: str) -> str:
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    prefix = next((p for p in LONG_PREFIXES if word.startswith(p)), "")
    found = _REGION.search(word)
    r1 = len(prefix) or (found.end() if found else len(word))
    found = _REGION.search(word, r1)
    r2 = found.end() if found else len(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in UNCHANGED_AFTER_PLURAL:
        return word
    word = _past_and_gerund(word, r1)
    if re.search(".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"

    suffix = _longest(word, SECOND)
    base = word[:len(word) - len(suffix)]
    needed = {"ogi": "l", "li": "cdeghkmnrt"}.get(suffix)
    if suffix and len(base) >= r1 and (needed is None or base[-1:] in tuple(needed)):
        word = base + SECOND[suffix]
    suffix = _longest(word, THIRD)
    base = word[:len(word) - len(suffix)]
    if suffix and len(base) >= (r2 if suffix == "ative" else r1):
        word = base + THIRD[suffix]
    suffix = _longest(word, FOURTH)
    base = word[:len(word) - len(suffix)]
    if suffix and len(base) >= r2 and (suffix != "ion" or base.endswith(("s", "t"))):
        word = base
    base = word[:-1]
    if word.endswith("e") and (len(base) >= r2 or len(base) >= r1 and not _SHORT_END.match(base)):
        word = base
    elif word.endswith("ll") and len(base) >= r2:
        word = base
    return word.lower()
