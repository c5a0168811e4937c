"""What a query says: its words, forms, concepts, keywords and clusters, worked out once on the driver."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from .forms import all_forms, base_forms, cluster_forms
from .vocab import BOOSTED, CONCEPTS, OPERATORS, PATTERN_WORDS, STOP_WORDS

_CONCEPTS, _STOPS, _BOOSTED = set(CONCEPTS), set(STOP_WORDS), set(BOOSTED)


def word_list(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def identifier_list(text: str) -> list[str]:
    return [w for w in word_list(text) if re.fullmatch(r"[a-z_][a-z0-9_]*", w)]


def weigh(freq: float, total: float, word: str) -> float:
    """The weight of a keyword by its share of all forms."""
    if not total:
        return 0.0
    return freq / total * (3.0 if word in _BOOSTED else 1.0) * (0.5 if freq > total * 0.1 else 1.0)


@dataclass(frozen=True)
class Query:
    """A search text. stems adds stemmed forms; synonyms and lemmas are tables for those who have them."""

    text: str
    stems: bool = False
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    lemmas: dict[str, list[str]] = field(default_factory=dict)

    def _base(self, word: str) -> list[str]:
        return base_forms(word, self.stems, self.lemmas)

    def _all(self, word: str) -> list[str]:
        return all_forms(word, self.stems, self.lemmas)

    @property
    def blank(self) -> bool:
        return not self.text.strip()

    @cached_property
    def phrase(self) -> str:
        return self.text.lower().strip()

    @cached_property
    def content_words(self) -> list[str]:
        """Words without stop words, repeats and order kept."""
        return [w for w in word_list(self.text) if w not in _STOPS]

    @cached_property
    def forms(self) -> list[str]:
        return sorted({f for w in self.content_words for f in self._all(w)})

    @cached_property
    def bm25_terms(self) -> Counter:
        return Counter(w for w in identifier_list(self.text) if w not in _STOPS or len(w) <= 2)

    def concepts_of(self, text: str) -> list[str]:
        found: set[str] = set()
        for w in identifier_list(text):
            hits = _CONCEPTS.intersection(self._base(w))
            if hits:
                found |= {w, *hits}
        for k in PATTERN_WORDS:
            for match in re.findall(rf"\b{k}\s+\w+", text.lower()):
                found.update(match.split())
        return sorted(found)

    @cached_property
    def concepts(self) -> list[str]:
        return self.concepts_of(self.text)

    @cached_property
    def concept_forms(self) -> list[str]:
        """Forms of the concepts, or of the identifiers that aren't stop words where there is none."""
        seeds = self.concepts or [w for w in identifier_list(self.text) if w not in _STOPS]
        return sorted({f for w in seeds for f in self._all(w)})

    @cached_property
    def keywords(self) -> dict[str, float]:
        counts: Counter = Counter()
        for w in identifier_list(self.text):
            if w not in _STOPS and len(w) > 2:
                counts.update(self._all(w))
        total = sum(counts.values())
        return {w: weigh(n, total, w) for w, n in sorted(counts.items()) if not w.startswith(("prefix_", "suffix_"))}

    def keyword_forms(self, word: str) -> list[str]:
        return self._all(word)

    @cached_property
    def clusters(self) -> list[str]:
        mine = {f for w in set(word_list(self.text)) for f in self._all(w)}
        return [name for name, forms in cluster_forms(self.stems).items() if mine.intersection(forms)]

    # --- rewrites for retrieval ------------------------------------------------------------

    @cached_property
    def spelled(self) -> str:
        """Symbols apart from words, operators by name."""
        return verbalized(separated(self.text))

    def search_terms(self, text: str) -> list[str]:
        """Tokens longer than one, then all forms of those longer than two that aren't stop words."""
        plain = re.sub(r"[^\w\s]", " ", text.lower()).split()
        out = [t for t in text.lower().split() if len(t) > 1]
        for t in plain:
            if len(t) > 2 and t not in _STOPS:
                out += self._all(t)
        return out

    @cached_property
    def expanded(self) -> str:
        """The first strategy's text."""
        if not self.text:
            return ""
        parts = [self.text.lower(), self.spelled.lower()]
        if terms := " ".join(self.search_terms(self.spelled)):
            parts.append(terms)
        for c in self.concepts_of(self.spelled):
            parts += [c, *self._all(c), *[s for s in sorted(self.synonyms.get(c, ())) if len(s) > 2 and s != c][:2]]
        return " ".join(parts)

    @cached_property
    def concept_text(self) -> str:
        """The second strategy's text; empty without concepts."""
        return " ".join(sorted({f for c in self.concepts for f in (c, *self._all(c))}))

    @cached_property
    def lowered(self) -> str:
        """The third strategy's text."""
        return self.text.lower()


def verbalized(text: str) -> str:
    for symbol, name in OPERATORS:
        text = text.replace(symbol, f" {name} ")
    return text


# Symbols are set apart from words by these rewrites, one after the other.
_REWRITES = [
    (r"\*\*([^*]+)\*\*", r"** \1 **"),
    (r"\*([^*]+)\*", r"* \1 *"),
    (r"`([^`]+)`", r"` \1 `"),
    (r"_([^_]+)_", r"_ \1 _"),
    *((pattern, r"\1 \2") for pattern in (
        r"(\w)(\()", r"(\w)(\[)", r"(\w)(\.)", r"(\))(\w)", r"(\])(\w)", r"(\})(\w)", r"(\w)(=)", r"(\w)([+\-*/%])", r"([=+\-*/%])(\w)",
        r"(\w)([<>!]=?)", r"([<>!]=?)(\w)", r"(\w)([;,])", r"([;,])(\w)", r"(\w)(:)(?!:)", r"(?<!:)(:)(\w)",
    )),
]


def separated(text: str) -> str:
    """Symbols apart from words, on a driver string, rewrite by rewrite; columns do it in fewer passes."""
    for pattern, put in _REWRITES:
        text = re.sub(pattern, put, text)
    return re.sub(r"\s+", " ", text).strip()
