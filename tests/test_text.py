import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.functions import forms, porter, text
from lodestone.functions.query import Query, separated, verbalized
from lodestone.functions.vocab import CLUSTERS, CONCEPTS, OPERATORS, PATTERN_WORDS, STOP_WORDS


# The examples of the paper.
PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "radically": "radic", "differently": "differ", "analogously": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formality": "formal", "sensitivity": "sensit", "sensibility": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electricity": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "homologous": "homolog", "communism": "commun", "activate": "activ",
    "angularity": "angular", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controlling": "control", "rolling": "roll", "language": "languag",
}


@pytest.mark.parametrize("word", PORTER)
def test_stems_of_the_paper(word):
    assert porter.stem(word) == PORTER[word]


WORDS_OF_PARTS = st.lists(st.sampled_from("y yy a e i o u s ss ed eed ing at bl iz ation ement ion l ll t b é w x z ies sses ous li ful ness 1".split()), max_size=6).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(WORDS_OF_PARTS, min_size=40, max_size=120))
def test_stems_of_columns(spark, values):
    assert column(spark, porter.stem_of, values) == [porter.stem(v) for v in values]


def test_stems_of_columns_of_the_paper(spark):
    assert column(spark, porter.stem_of, list(PORTER)) == list(PORTER.values())


def test_sizes_of_the_tables():
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) == 97
    assert len(set(CONCEPTS)) == 110 and len(OPERATORS) == 51 and len(PATTERN_WORDS) == 16 and len(CLUSTERS) == 7


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


SAMPLES = ["a::b", "a:b:c", "x==y +== z", "**bold** *it* `c` _d_e_", "a_b_c", "...", "f(a)[b].c{d}", "", " \t\n", "é:ü=ß", "a\x1fb\x85c\xa0d", "x\r\ny\rz\x00", "İstanbul ΣΑΣ", "q?.r??s->t=>u"]


def test_columns_agree_with_driver_functions(spark):
    assert column(spark, text.verbalize_operators, SAMPLES) == [verbalized(s) for s in SAMPLES]
    assert column(spark, text.separate_symbols, SAMPLES) == [separated(s) for s in SAMPLES]
    assert column(spark, text.words, SAMPLES) == [re.findall(r"\w+", s.lower()) for s in SAMPLES]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab :=*_`.(é\n<!;)]-?&", max_size=12), min_size=5, max_size=40))
def test_separation_of_any_text(spark, values):
    got = column(spark, text.separate_symbols, values)
    assert got == [separated(s) for s in values]
    assert column(spark, text.verbalize_operators, values) == [verbalized(s) for s in values]
    assert not any("  " in g for g in got)


def test_forms(spark):
    words = ["class", "callbacks", "if", "a", "property", "é", "ention", "prefix_abc"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", F.array_sort(forms.forms_of(F.array("w"))).alias("f"), forms.form_count(F.col("w")).alias("n"), forms.stem_map(F.array("w")).alias("m")).withColumn("s", F.array_sort(forms.forms_of(F.array("w"), F.col("m")))).collect()
    for r in rows:
        assert r.f == forms.all_forms(r.w) and r.n == len(r.f)
        assert r.s == forms.all_forms(r.w, stems=True)


def test_match_keys_find_the_same_pairs(spark):
    words = "function functions functional factory story storey class glass classes prop property fun ion nation".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    keys = {r.w: set(r.k) for r in df.select("w", forms.keys_of(F.array("w")).alias("k")).collect()}
    for a in words:
        for b in words:
            assert bool(keys[a] & set(forms.all_forms(b))) == bool(set(forms.all_forms(a)) & set(forms.all_forms(b))), (a, b)


def test_query_of_code():
    q = Query("create class Foo for callbacks")
    assert {"class", "classes", "foo", "create", "callback", "callbacks", "for"} <= set(q.concepts)
    assert "classes_oop" in q.clusters and "control_flow" in q.clusters
    assert Query("  ").blank and Query("").expanded == "" and Query("nothing here").concept_text == ""
    plain, told = Query("Array").expanded.split(), Query("Array", synonyms={"array": ["raiment", "align"]}).expanded.split()
    assert {"raiment", "align"} <= set(told) and set(plain) <= set(told) and not {"raiment", "align"} & set(plain)


def test_file_names(spark):
    rows = spark.createDataFrame([("A b/c!", "x"), (None, "x"), ("", "x")], "t string, c string")
    got = [r[0] for r in rows.select(text.safe_name(F.col("t"), F.col("c"))).collect()]
    assert got == ["A_bc", "doc_9dd4e461", "doc_9dd4e461"]
    assert column(spark, text.basename, ["/a/b.md", "c"]) == ["b.md", "c"]
    assert column(spark, text.percent_encode, ["a b&c/é*"]) == ["a%20b%26c%2F%C3%A9%2A"]
    assert column(spark, text.json_string, ['a"b\n']) == ['a\\"b\\n']
