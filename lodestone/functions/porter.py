"""The stemming algorithm that M. F. Porter published in 1980, from the paper's rules: of driver strings, and of columns.

The column version marks each y that is a consonant as Y, once: what a letter is depends on those before it, and steps
change ends only. The paper's measure is then how often a vowel is followed by a consonant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import let

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def measure(stem: str) -> int:
    """How many times a consonant follows a vowel."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The paper's suffixes and what replaces them, in its order.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replaced(w: str, rules, least: int) -> str:
    """The longest suffix that fits decides, whether or not its condition holds."""
    fits = [(s, r) for s, r in rules if w.endswith(s)]
    if not fits:
        return w
    suffix, put = max(fits, key=lambda f: len(f[0]))
    stem = w[: len(w) - len(suffix)]
    if measure(stem) <= least or (suffix == "ion" and least == 1 and not stem.endswith(("s", "t"))):
        return w
    return stem + put


def stem(word: str) -> str:
    """The stem of a lower-case word. Words of up to two letters are their own."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, STEP_2, 0)
    w = _replaced(w, STEP_3, 0)
    w = _replaced(w, [(s, "") for s in STEP_4], 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _double(w) and w[-1] == "l" and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# --- columns -------------------------------------------------------------------------------

_PAIR = "[aeiouy][^aeiouy]"
_CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"


def _more_than(stem: Column, least: int) -> Column:
    """Whether the measure is over 0 or 1."""
    return stem.rlike(".*".join([_PAIR] * (least + 1)))


def _less(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _twice(w: Column) -> Column:
    """Whether w ends with a consonant twice."""
    return F.lower(w).rlike(r"(.)\1$") & w.rlike("[^aeiouy]$")


def _without_s(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("sses")) | F.endswith(w, F.lit("ies")), _less(w, 2)).when(w.rlike("(^|[^s])s$"), _less(w, 1)).otherwise(w)


def _without_ed(w: Column) -> Column:
    def restored(stem: Column) -> Column:
        short = ~_more_than(stem, 1) & _more_than(stem, 0) & stem.rlike(_CVC)
        return F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(_twice(stem) & ~stem.rlike("[lsz]$"), _less(stem, 1)).when(short, F.concat(stem, F.lit("e"))).otherwise(stem)

    out = F.when(F.endswith(w, F.lit("eed")), F.when(_more_than(_less(w, 3), 0), _less(w, 1)).otherwise(w))
    for suffix in ("ed", "ing"):
        n = len(suffix)
        out = out.when(F.endswith(w, F.lit(suffix)) & _less(w, n).rlike("[aeiouy]"), let(_less(w, n), restored))
    return out.otherwise(w)


def _with_i(w: Column) -> Column:
    return F.when(w.rlike("[aeiouy].*[yY]$"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)


def _suffixes(rules: list[tuple[str, str]], least: int) -> Callable[[Column], Column]:
    """The longest suffix that fits decides, whether or not its condition holds."""

    def step(w: Column) -> Column:
        out = F
        for suffix, put in sorted(rules, key=lambda r: -len(r[0])):
            stem = _less(w, len(suffix))
            holds = _more_than(stem, least) & (stem.rlike("[st]$") if suffix == "ion" else F.lit(True))
            out = out.when(F.endswith(w, F.lit(suffix)), F.when(holds, F.concat(stem, F.lit(put))).otherwise(w))
        return out.otherwise(w)

    return step


def _without_e(w: Column) -> Column:
    stem = _less(w, 1)
    return F.when(F.endswith(w, F.lit("e")) & (_more_than(stem, 1) | (_more_than(stem, 0) & ~stem.rlike(_CVC))), stem).otherwise(w)


def _without_l(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & _more_than(_less(w, 1), 1), _less(w, 1)).otherwise(w)


def stem_of(word: Column) -> Column:
    """The stem of a lower-case word, without a Python worker; it may stand in a lambda."""
    marked = F.replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), F.lit("yy"), F.lit("yY"))
    steps = [_without_s, _without_ed, _with_i, _suffixes(STEP_2, 0), _suffixes(STEP_3, 0), _suffixes([(s, "") for s in STEP_4], 1), _without_e, _without_l]
    whole = marked
    for step in steps:
        whole = let(whole, step)
    return F.when(F.length(word) <= 2, word).otherwise(F.lower(whole))
