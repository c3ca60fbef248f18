"""The corpus queries that have SQL against DuckDB, on a small fixture."""

import math

import duckdb
import pandas as pd
import pytest

from prefixlake.llm import queries
from tests.llm.test_operators import TALK, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    shared = "\n".join(f"line {k} of a passage in many texts" for k in range(5))
    rows = [(k, prose(k % 37, 30 + k % 90) + ("\n" + shared if k % 4 == 0 else ""), ["xx", "yy", None][k % 3], f"s{k % 5}", 0) for k in range(120)]
    rows += [(500, None, None, None, 0), (501, "", "xx", "s1", 0), (502, "a b", "xx", "s1", 0), (503, "word " * 50, "xx", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").write.parquet(str(top / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet/*.parquet'")
    return str(top), con


def value(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) and not v.is_integer() else int(v) if isinstance(v, float) else v


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([value(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, tables, name):
    top, con = tables
    assert plain(queries.QUERIES[name](spark, top).toPandas()) == plain(con.sql(queries.SQL[name]).df())
