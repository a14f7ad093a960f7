"""Every registered query against its DuckDB oracle text (sf0.001)."""

import pytest

import re

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.compare import duck_connect, same_result

# the optional subpackage tests its own queries
QUERIES, ORACLE = ({k: v for k, v in d.items() if not re.match(r"op\d+_|pipeline$", k)}
                   for d in (E.queries(), E.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


# Spark type -> the DuckDB type the oracle must produce for it
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]",
         "date": "DATE"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(ORACLE[name])
    ok, why = same_result(df.columns, [tuple(r) for r in df.collect()],
                          rel.columns, rel.fetchall())
    assert ok, why
    oracle_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString()) == oracle_types[f.name], \
            (f.name, f.dataType.simpleString(), oracle_types[f.name])


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 24
    assert df.columns == ["bucket", "messages", "errors"]
