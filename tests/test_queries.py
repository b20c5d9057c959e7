"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_point
from tests.conftest import TESTDATA

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="needs the star-schema tables")

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in os.listdir(TESTDATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{file}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    df = QUERIES[name](spark, TESTDATA)
    want = database.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, want.fetchall())


def ranges(rows, **limits):
    return all(low <= r[c] <= high for r in rows for c, (low, high) in limits.items())


MODELS = {"call_volume", "sentiment", "revenue"}
#: what must hold of results that SQL can't give; all others must have rows
HOLDS = {
    "train_forecasters": lambda rows: {r["name"] for r in rows} == MODELS and ranges(rows, mae=(0, 1e9), training_samples=(10, 10_000)),
    "model_report": lambda rows: {r["name"] for r in rows} == MODELS and ranges(rows, confidence=(0, 1), features_count=(1, 100)),
    "forecast": lambda rows: len(rows) == 7 and ranges(rows, call_volume=(0, 1e6), sentiment=(-1, 1), revenue=(0, 1e12)),
    "anomalous_days": lambda rows: ranges(rows, anomaly_score=(1e-9, 1)) and 0 < sum(r["is_anomaly"] for r in rows) <= 0.11 * len(rows)
    and min(r["anomaly_score"] for r in rows if r["is_anomaly"]) > max(r["anomaly_score"] for r in rows if not r["is_anomaly"]),
    "outlier_ratio": lambda rows: len(rows) == 1 and 0 < rows[0][0] <= 0.11,
    "train_topics": lambda rows: sorted(r["topic"] for r in rows) == list(range(10)) and all(len(r["terms"].split(",")) == 3 for r in rows),
    "top_terms": lambda rows: sorted((r["topic"], r["rank"]) for r in rows) == [(t, k) for t in range(10) for k in range(5)] and ranges(rows, weight=(0, 1)),
    "document_topics": lambda rows: len({r["call_id"] for r in rows}) == len(rows) and ranges(rows, dominant_topic_id=(0, 9), probability=(0, 1)),
    "topic_coherence": lambda rows: len(rows) <= 10 and ranges(rows, npmi=(-1, 1)),
    "per_call_topics": lambda rows: len({r["call_id"] for r in rows}) == len(rows) and all(r["dominant_topic"] for r in rows),
    "save_and_load_topics": lambda rows: len(rows) == 30,
    "intent_model": lambda rows: sum(r["calls"] for r in rows if r["quality"] == r["prediction"]) >= 0.5 * sum(r["calls"] for r in rows),
}


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql(spark, name):
    rows = QUERIES[name](spark, TESTDATA).collect()
    assert rows and HOLDS.get(name, bool)(rows)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
