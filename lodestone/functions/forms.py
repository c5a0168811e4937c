"""Forms of words: themselves, plurals, optional stems and lemmas, and the beginnings and ends of long words.

Two words are alike if their forms meet. Words of five letters and more that share any beginning
or end share the one of three letters, so a document's words need only those as match keys.
"""

from __future__ import annotations

from functools import cache, lru_cache

from pyspark.sql import Column, functions as F

from . import porter
from .text import let
from .vocab import CLUSTERS, PLURALS

_PARTNERS = {a: b for pair in PLURALS for a, b in (pair, pair[::-1])}


# --- one word, on the driver ---------------------------------------------------------------


def base_forms(word: str, stems: bool = False, lemmas: dict[str, list[str]] | None = None) -> list[str]:
    """Forms other than partial ones, sorted."""
    w = word.lower()
    if len(word) < 2:
        return [w]
    out = {w}
    if w in _PARTNERS:
        out.add(_PARTNERS[w])
    if stems and len(s := stem(w)) >= 2:
        out.add(s)
    out.update((lemmas or {}).get(w, ()))
    return sorted(out)


def partial_forms(word: str) -> list[str]:
    w = word.lower()
    n = len(w)
    if n <= 4:
        return []
    return [f"prefix_{w[:i]}" for i in range(3, n)] + [f"suffix_{w[i:]}" for i in range(1, n - 2)]


def all_forms(word: str, stems: bool = False, lemmas: dict[str, list[str]] | None = None) -> list[str]:
    return sorted({*base_forms(word, stems, lemmas), *partial_forms(word)})


def with_partners(words) -> list[str]:
    """words, and the singulars and plurals of them."""
    return sorted({*words, *(_PARTNERS[w] for w in words if w in _PARTNERS)})


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    return porter.stem(word)


@cache
def cluster_forms(stems: bool = False) -> dict[str, list[str]]:
    """All forms of each cluster's keywords."""
    return {name: sorted({f for k in keywords for f in all_forms(k, stems)}) for name, keywords in CLUSTERS.items()}


# --- columns -------------------------------------------------------------------------------


def stem_map(words: Column) -> Column:
    """Stems of a list of lower-case words and of all their base forms, as a map. A plan has it as a column of its own, worked out once for each row."""

    def of(ws: Column) -> Column:
        stems = F.transform(ws, porter.stem_of)
        return let(F.filter(F.array_distinct(F.concat(ws, stems)), lambda w: F.length(w) >= 2), lambda every: F.map_from_arrays(every, F.transform(every, porter.stem_of)))

    partnered = lambda ws: F.filter(F.concat(ws, F.filter(F.transform(ws, plural_partner), lambda p: p.isNotNull())), lambda w: F.length(w) >= 2)
    return let(let(F.array_distinct(words), partnered), of)


def plural_partner(word: Column) -> Column:
    """The other of singular and plural for words of the table, else null."""
    pairs = F.create_map(*(F.lit(x) for item in sorted(_PARTNERS.items()) for x in item))
    # Maps are searched key by key, sets by hash: few words get as far as the map.
    return F.when(word.isin(*_PARTNERS), F.element_at(pairs, word))


def base_forms_of(words: Column, stems: Column | None = None) -> Column:
    """Distinct base forms of a list of lower-cased words; stems is a map from stem_map."""

    def of(ws: Column) -> Column:
        parts = [ws, F.filter(F.transform(ws, plural_partner), lambda p: p.isNotNull())]
        if stems is not None:
            parts.append(F.filter(F.transform(ws, lambda w: F.try_element_at(stems, w)), lambda s: F.length(s) >= 2))
        return F.concat(*parts)

    return F.array_distinct(let(words, of))


def sorted_base_forms_of(word: Column, stems: Column | None = None) -> Column:
    """The sorted base forms of one lower-cased word."""
    if stems is not None:
        return F.sort_array(base_forms_of(F.array(word), stems))
    return F.when(word.isin(*_PARTNERS), F.sort_array(F.array(word, plural_partner(word)))).otherwise(F.array(word))


def joined_base_forms_of(word: Column) -> Column:
    """The sorted base forms of one lower-cased word without stems, with spaces between."""
    return F.when(word.isin(*_PARTNERS), F.array_join(sorted_base_forms_of(word), " ")).otherwise(word)


def alike(word: Column, wanted: list[str], stems: Column | None = None) -> Column:
    """Whether a match key of a lower-cased word is among wanted; null counts as no."""
    partnered = [w for w, p in _PARTNERS.items() if p in wanted]
    ends = F.concat(F.lit("prefix_"), F.substring(word, 1, 3)).isin(*wanted) | F.concat(F.lit("suffix_"), F.substring(word, F.length(word) - 2, F.lit(3))).isin(*wanted)
    found = word.isin(*wanted, *partnered) | ((F.length(word) > 4) & ends)
    if stems is not None:
        stem_of = F.try_element_at(stems, word)
        found = found | F.coalesce((F.length(stem_of) >= 2) & stem_of.isin(*wanted), F.lit(False))
    return found


def partials_of(word: Column) -> Column:
    n = F.length(word)
    prefixes = F.transform(F.sequence(F.lit(3), n - 1), lambda i: F.concat(F.lit("prefix_"), F.substring(word, 1, i)))
    suffixes = F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.concat(F.lit("suffix_"), F.substring(word, i + 1, n)))
    return F.when(n > 4, F.concat(prefixes, suffixes)).otherwise(F.array().cast("array<string>"))


def forms_of(words: Column, stems: Column | None = None) -> Column:
    """All distinct forms of a list of lower-cased words."""
    return F.array_distinct(let(words, lambda ws: F.concat(base_forms_of(ws, stems), F.flatten(F.transform(F.array_distinct(ws), partials_of)))))


def forms_of_one(word: Column) -> Column:
    """All forms of one lower-cased word without stems, sorted; they are distinct as they are."""
    return F.sort_array(F.concat(sorted_base_forms_of(word), partials_of(word)))


def _ends(words: Column) -> Column:
    long = F.filter(F.array_distinct(words), lambda w: F.length(w) > 4)
    both = lambda w: F.array(F.concat(F.lit("prefix_"), F.substring(w, 1, 3)), F.concat(F.lit("suffix_"), F.substring(w, F.length(w) - 2, F.lit(3))))
    return F.flatten(F.transform(long, both))


def keys_of(words: Column, stems: Column | None = None) -> Column:
    """Distinct match keys of a list of lower-cased words."""
    return F.array_distinct(let(words, lambda ws: F.concat(base_forms_of(ws, stems), _ends(ws))))


def literal(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def form_count(word: Column) -> Column:
    """How many forms a word has without stems."""
    n = F.length(word)
    partner = F.when((n >= 2) & plural_partner(word).isNotNull(), 1).otherwise(0)
    return 1 + partner + F.when(n > 4, 2 * (n - 3)).otherwise(0)
