"""Text functions: column to column, without Python workers.

The word class is letters, numbers and underscore of all scripts, and white space is Unicode's.
Both are written out, as the short forms differ between engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .vocab import OPERATORS, PATTERN_WORDS, STOP_WORDS

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# What stands between two of a symbol is set apart from them, one rule after the other. Each comes with the
# symbol that a text must have, or the rule changes nothing.
PAIRED = [
    (r"\*\*([^*]+)\*\*", "** $1 **", "*"),
    (r"\*([^*]+)\*", "* $1 *", "*"),
    (r"`([^`]+)`", "` $1 `", "`"),
    (r"_([^_]+)_", "_ $1 _", "_"),
]
# Symbols that are set apart from a word before them, and from a word after them. So is a single colon.
AFTER_WORD, BEFORE_WORD = r"(\[.=+\-*/%<>!;,", r")\]}=+\-*/%<>!;,"
_SYMBOLS = r"!=.<>&|+\-*/%?:\^~{}\[\]();,#@$"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once and written once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def unify_lines(c: Column) -> Column:
    """Without control characters, and with LF for each line end."""
    return F.replace(F.replace(F.regexp_replace(c, CONTROLS, ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean(c: Column) -> Column:
    return strip(unify_lines(c))


def verbalize_operators(c: Column) -> Column:
    """Operators by name, longest first.

    Names have no symbols, so each run of symbols is replaced by itself, and the rest of the text isn't looked at. Most runs are a
    comma or a dot.
    """
    names = dict(OPERATORS)
    spelled = lambda run: reduce(lambda t, o: F.replace(t, F.lit(o[0]), F.lit(f" {o[1]} ")), OPERATORS, run)

    def of(run: Column) -> Column:
        out = F.when(run == ",", f" {names[',']} ").when(run == ".", f" {names['.']} ")
        return out.when(run.rlike(f"^[{_SYMBOLS}]"), spelled(run)).otherwise(run)

    runs = lambda t: F.regexp_extract_all(t, F.lit(f"[{_SYMBOLS}]+|[^{_SYMBOLS}]+"), 0)
    return let(c, lambda t: F.when(t.rlike(f"[{_SYMBOLS}]"), F.array_join(F.transform(runs(t), of), "")).otherwise(t))


def apart(c: Column) -> Column:
    """Symbols apart from words, with white space as it comes."""
    # Symbols are looked for first, as they are few, and what is beside them then.
    rules = [
        *PAIRED,
        (f"([{AFTER_WORD}])(?<={WORD}.)", " $1", None), (f"([{BEFORE_WORD}])(?={WORD})", "$1 ", None),
        (f"(:)(?<={WORD}.)(?!:)", " $1", ":"), (f"(:)(?={WORD})(?<!::)", "$1 ", ":"),
    ]
    rewrite = lambda rule: lambda t: F.regexp_replace(t, rule[0], rule[1]) if rule[2] is None else F.when(F.contains(t, F.lit(rule[2])), F.regexp_replace(t, rule[0], rule[1])).otherwise(t)
    return reduce(lambda t, rule: let(t, rewrite(rule)), rules, c)


def separate_symbols(c: Column) -> Column:
    return strip(F.regexp_replace(apart(c), f"{SPACE}+", " "))


def identifiers(c: Column) -> Column:
    """Lower-cased words that are ASCII identifiers as a whole."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w.rlike("^[a-z_][a-z0-9_]*$"))


def words(c: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def without_stops(c: Column) -> Column:
    """A list of words without stop words; repeats stay."""
    return F.filter(c, lambda w: ~w.isin(*STOP_WORDS))


def bm25_tokens(c: Column) -> Column:
    """Identifiers without the stop words of three letters and more."""
    stops = [w for w in STOP_WORDS if len(w) > 2]
    return F.filter(identifiers(c), lambda w: ~w.isin(*stops))


def counted(c: Column) -> Column:
    """array<struct(term, tf)>: how often each word of a list occurs, in order of words. No rows move."""

    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        told = lambda st: F.transform(st, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(st, j + 1), n) - at).cast("long").alias("tf")))
        return F.when(n > 0, let(starts, told))

    return let(F.sort_array(c), of)


def topic_words(c: Column) -> Column:
    """Identifiers of three letters and more that aren't stop words."""
    return F.filter(without_stops(identifiers(c)), lambda w: F.length(w) > 2)


def pattern_words(c: Column) -> Column:
    """Distinct words of 'keyword word' pairs, for the keywords that name concepts. Each keyword's pairs are found left to right.

    Patterns begin with the keyword, as it is found faster than what is not before it.
    """

    def of(low: Column) -> Column:
        pairs = lambda k: F.when(F.contains(low, F.lit(k)), F.regexp_extract_all(low, F.lit(f"{k}(?<!{WORD}{k}){SPACE}+{WORD}+"), 0)).otherwise(F.array().cast("array<string>"))
        return F.concat(*map(pairs, PATTERN_WORDS))

    return F.array_distinct(F.flatten(F.transform(let(F.lower(c), of), lambda m: F.split(m, f"{SPACE}+"))))


def contains_phrase(content: Column, query: Column) -> Column:
    return F.contains(strip(F.lower(content)), strip(F.lower(query)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(title: Column, content: Column) -> Column:
    """The name of an added document, before its time stamp."""
    named = F.replace(F.regexp_replace(title, "[^A-Za-z0-9 _-]", ""), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(title, F.lit("")) != "", named).otherwise(F.concat(F.lit("doc_"), F.substring(F.md5(content.cast("binary")), 1, 8)))


def titled(title: Column, content: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), content)).otherwise(content)


def percent_encode(c: Column) -> Column:
    """As in the query of a URL, with %20 for a space."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def json_string(c: Column) -> Column:
    """The inside of a JSON string."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substring(whole, 7, F.length(whole) - 8)
