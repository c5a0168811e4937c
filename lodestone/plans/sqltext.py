"""DuckDB fragments for the text functions, written apart from the column versions they are held against."""

from __future__ import annotations

from lodestone.functions.porter import STEP_2, STEP_3, STEP_4
from lodestone.functions.vocab import BOOSTED, CLUSTERS, CONCEPTS, OPERATORS, PATTERN_WORDS, PLURALS, STOP_WORDS

W = r"[\p{L}\p{N}_]"
S = r"[\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    values = list(values)
    return "[" + ", ".join(map(q, values)) + "]" if values else "[]::VARCHAR[]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def unify(c: str) -> str:
    return rf"replace(replace(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def verbalize(c: str) -> str:
    for symbol, name in OPERATORS:
        c = f"replace({c}, {q(symbol)}, {q(f' {name} ')})"
    return c


def separate(c: str) -> str:
    rules = [
        (r"\*\*([^*]+)\*\*", r"** \1 **"), (r"\*([^*]+)\*", r"* \1 *"), (r"`([^`]+)`", r"` \1 `"), (r"_([^_]+)_", r"_ \1 _"),
        (rf"({W})(\()", r"\1 \2"), (rf"({W})(\[)", r"\1 \2"), (rf"({W})(\.)", r"\1 \2"),
        (rf"(\))({W})", r"\1 \2"), (rf"(\])({W})", r"\1 \2"), (rf"(\}})({W})", r"\1 \2"),
        (rf"({W})(=)", r"\1 \2"), (rf"({W})([+\-*/%])", r"\1 \2"), (rf"([=+\-*/%])({W})", r"\1 \2"),
        (rf"({W})([<>!]=?)", r"\1 \2"), (rf"([<>!]=?)({W})", r"\1 \2"), (rf"({W})([;,])", r"\1 \2"), (rf"([;,])({W})", r"\1 \2"),
        # Without lookaround a match takes in its context, so each is done twice.
        *[(rf"({W}):([^:]|$)", r"\1 :\2")] * 2, *[(rf"(^|[^:]):({W})", r"\1: \2")] * 2,
        (f"{S}+", " "),
    ]
    for pattern, put in rules:
        c = f"regexp_replace({c}, {q(pattern)}, {q(put)}, 'g')"
    return strip(c)


def split(c: str) -> str:
    return rf"regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_]+')"


def words(c: str) -> str:
    return f"list_filter({split(c)}, lambda w: w <> '')"


def identifiers(c: str) -> str:
    return f"list_filter({split(c)}, lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]*'))"


def unstopped(c: str) -> str:
    return f"list_filter({c}, lambda w: NOT list_contains({lst(STOP_WORDS)}, w))"


def bm25_tokens(c: str) -> str:
    return f"list_filter({identifiers(c)}, lambda w: NOT list_contains({lst(w for w in STOP_WORDS if len(w) > 2)}, w))"


def topic_words(c: str) -> str:
    return f"list_filter({unstopped(identifiers(c))}, lambda w: length(w) > 2)"


_PAIRS = [p for a, b in PLURALS for p in ((a, b), (b, a))]
PARTNERS = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in _PAIRS) + "}"


def base(w: str) -> str:
    return f"list_filter([{w}, {PARTNERS}[{w}]], lambda f: f IS NOT NULL)"


def partials(w: str) -> str:
    n = f"length({w})"
    return (
        f"CASE WHEN {n} > 4 THEN list_concat(list_transform(range(3, {n}), lambda i: 'prefix_' || {w}[1:i]), list_transform(range(1, {n} - 2), lambda i: 'suffix_' || {w}[i+1:])) ELSE []::VARCHAR[] END"
    )


def forms_of(c: str) -> str:
    """All distinct forms of a list of words."""
    return f"list_distinct(flatten(list_transform(list_distinct({c}), lambda w: list_concat({base('w')}, {partials('w')}))))"


def overlap(mine: str, theirs: str, jaccard: float, coverage: float) -> str:
    both = f"len(list_intersect({mine}, {theirs}))::DOUBLE"
    return f"({both} / (len({mine}) + len({theirs}) - {both}) * {jaccard}::DOUBLE + {both} / len({mine}) * {coverage}::DOUBLE)"


def concepts(c: str) -> str:
    own = f"flatten(list_transform({identifiers(c)}, lambda w: CASE WHEN list_has_any({base('w')}, {lst(CONCEPTS)}) THEN list_concat([w], list_intersect({base('w')}, {lst(CONCEPTS)})) ELSE []::VARCHAR[] END))"
    found = [own]
    for k in PATTERN_WORDS:
        # The character before a keyword is kept out of the result by the group.
        found.append(f"flatten(list_transform(regexp_extract_all(lower({c}), {q(f'(?:^|[^{W[1:-1]}])({k}{S}+{W}+)')}, 1), lambda m: regexp_split_to_array(m, '{S}+')))")
    return f"list_distinct(flatten([{', '.join(found)}]))"


def clusters(c: str) -> str:
    have = "own_forms"
    hits = ", ".join(f"CASE WHEN list_has_any({have}, {forms_of(lst(ks))}) THEN {q(name)} END" for name, ks in CLUSTERS.items())
    return f"list_filter([{hits}], lambda k: k IS NOT NULL)"


def weight(freq: str, total: str, word: str) -> str:
    return f"({freq}::DOUBLE / {total} * CASE WHEN list_contains({lst(BOOSTED)}, {word}) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {freq} > {total} * 0.1::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"


def _measured(stem: str, least: int) -> str:
    return f"regexp_matches({stem}, '{'.*'.join(['[aeiouy][^aeiouy]'] * (least + 1))}')"


def _cut(n: int) -> str:
    return f"left(w, -{n})"


def _doubled(w: str) -> str:
    return f"(length({w}) > 1 AND lower(right({w}, 1)) = lower({w}[-2]) AND regexp_matches({w}, '[^aeiouy]$'))"


def _suffix_case(rules, least: int) -> str:
    cases = []
    for suffix, put in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(len(suffix))
        more = f" AND regexp_matches({stem}, '[st]$')" if suffix == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_measured(stem, least)}{more} THEN {stem} || '{put}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_tables(src: str) -> str:
    """Common tables from src (word) to stems (word, stem), a step of the paper each."""
    cvc = "'[^aeiouy][aeiouy][^aeiouywxY]$'"
    vowel = lambda n: f"regexp_matches({_cut(n)}, '[aeiouy]')"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut(1)} ELSE w END",
        # What is left of a past form or a gerund gets a mark, so that the next step knows it.
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measured(_cut(3), 0)} THEN {_cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND {vowel(2)} THEN '>' || {_cut(2)} WHEN ends_with(w, 'ing') AND {vowel(3)} THEN '>' || {_cut(3)} ELSE w END",
        f"CASE WHEN starts_with(w, '>') THEN (SELECT CASE WHEN regexp_matches(u, '(at|bl|iz)$') THEN u || 'e' WHEN {_doubled('u')} AND NOT regexp_matches(u, '[lsz]$') THEN left(u, -1) WHEN {_measured('u', 0)} AND NOT {_measured('u', 1)} AND regexp_matches(u, {cvc}) THEN u || 'e' ELSE u END FROM (SELECT substr(w, 2) AS u)) ELSE w END",
        f"CASE WHEN regexp_matches(w, '[yY]$') AND {vowel(1)} THEN {_cut(1)} || 'i' ELSE w END",
        _suffix_case(STEP_2, 0),
        _suffix_case(STEP_3, 0),
        _suffix_case([(s, "") for s in STEP_4], 1),
        f"CASE WHEN ends_with(w, 'e') AND ({_measured(_cut(1), 1)} OR ({_measured(_cut(1), 0)} AND NOT regexp_matches({_cut(1)}, {cvc}))) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measured(_cut(1), 1)} THEN {_cut(1)} ELSE w END",
    ]
    out = [f"s0 AS (SELECT word, replace(regexp_replace(word, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY') AS w FROM {src})"]
    out += [f"s{i} AS (SELECT word, {step} AS w FROM s{i - 1})" for i, step in enumerate(steps, 1)]
    return ", ".join([*out, f"stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE lower(w) END AS stem FROM s{len(steps)})"])
