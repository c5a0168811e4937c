import re

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return tuple(map(plain, v))
        return round(v, 6) if isinstance(v, float) else v

    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, con, name):
    got = catalog.queries()[name](spark, D).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_optional_folder():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lodestone\.llm|from \.+llm|import llm", p.read_text()), p
