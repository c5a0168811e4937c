"""Word lists and tables of the text model. All are fixed values: results depend on them."""

from __future__ import annotations

# Stop words.
STOP_WORDS = (
    "in on at to for of with by from up about into through during before after above below between among "
    "the a an and or but if then else when where how why what which who whom whose this that these those "
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves am is are was were be been being have has had "
    "having do does did doing will would should could can may might must shall ought"
).split()

# Operators and their names, in the order in which they are replaced.
OPERATORS = [
    ("!==", "not strictly equals"), ("===", "strictly equals"), ("...", "spread operator"),
    ("==", "equals"), ("!=", "not equals"), ("<=", "less than or equal to"), (">=", "greater than or equal to"),
    ("&&", "and"), ("||", "or"), ("+=", "plus equals"), ("-=", "minus equals"), ("*=", "multiply equals"),
    ("/=", "divide equals"), ("%=", "modulo equals"), ("++", "increment"), ("--", "decrement"), ("**", "power"),
    ("<<", "left shift"), (">>", "right shift"), ("=>", "arrow function"), ("->", "arrow pointer"),
    ("::", "scope resolution"), ("?.", "optional chaining"), ("??", "nullish coalescing"),
    ("<", "less than"), (">", "greater than"), ("!", "not"), ("=", "assign"), ("+", "plus"), ("-", "minus"),
    ("*", "multiply"), ("/", "divide"), ("%", "modulo"), ("&", "bitwise and"), ("|", "bitwise or"),
    ("^", "bitwise xor"), ("~", "bitwise not"), ("{", "open brace"), ("}", "close brace"),
    ("[", "open bracket"), ("]", "close bracket"), ("(", "open paren"), (")", "close paren"),
    (";", "semicolon"), (":", "colon"), (",", "comma"), (".", "dot"), ("?", "question mark"), ("#", "hash"),
    ("@", "at symbol"), ("$", "dollar"),
]

# Singular and plural forms that stand for one another.
PLURALS = [
    ("class", "classes"), ("function", "functions"), ("method", "methods"), ("variable", "variables"),
    ("array", "arrays"), ("object", "objects"), ("type", "types"), ("struct", "structs"),
    ("interface", "interfaces"), ("callback", "callbacks"), ("event", "events"), ("property", "properties"),
    ("parameter", "parameters"), ("argument", "arguments"),
]

# Concepts.
CONCEPTS = (
    "class classes object objects inheritance polymorphism function functions method methods variable variables "
    "array arrays list lists dictionary dictionaries loop loops condition conditions if else while for "
    "struct structs interface interfaces module modules import export package packages library libraries "
    "type types datatype datatypes string integer boolean callback callbacks event events handler handlers "
    "pattern patterns algorithm algorithms data structure pointer pointers reference references memory allocation "
    "constructor destructor getter setter property properties static dynamic public private protected abstract "
    "virtual override implement implements extend extends generic generics template templates namespace namespaces "
    "parameter parameters argument arguments return returns create creating creation define defining definition "
    "declare declaring declaration initialize initializing initialization equals assign compare comparison conditional"
).split()

# Words that name a concept together with the word after them.
PATTERN_WORDS = "class struct function def interface enum type var let const creating defining declaring equals assign compare".split()

# Keywords that count threefold.
BOOSTED = (
    "class classes object objects inheritance polymorphism function functions method methods variable variables "
    "array arrays struct structs interface interfaces type types callback callbacks event events "
    "create creating define defining declare declaring equals assign compare comparison"
).split()

# Clusters of topics.
CLUSTERS = {
    "classes_oop": (
        "class classes object objects inheritance polymorphism constructor destructor method methods property properties "
        "static public private protected abstract virtual create creating creation define defining definition"
    ).split(),
    "functions": (
        "function functions callback callbacks procedure procedures lambda closure higher-order functional "
        "parameter parameters argument arguments return returns"
    ).split(),
    "data_structures": (
        "array arrays list lists dictionary dictionaries map maps set sets tree trees graph graphs tuple tuples "
        "collection collections"
    ).split(),
    "types": (
        "type types datatype datatypes struct structs interface interfaces enum enums generic generics template templates"
    ).split(),
    "control_flow": "loop loops condition conditions if else while for switch case break continue return yield".split(),
    "memory": "pointer pointers reference references memory allocation garbage collection stack heap buffer address".split(),
    "operators": (
        "equals assign compare comparison condition conditional plus minus multiply divide modulo increment decrement"
    ).split(),
}

# Weights of the components of a score.
WEIGHTS = {
    "embedding": 0.12,
    "bm25": 0.18,
    "topic_relevance": 0.35,
    "semantic_distance": 0.20,
    "morphological_match": 0.10,
    "exact_matches": 0.05,
}

# Endings of the names of files that are read.
EXTENSIONS = (".txt", ".md", ".mdx", ".yaml", ".yml", ".json", ".py", ".js", ".html", ".css", ".yaka")
