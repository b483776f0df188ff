"""Every query of the engine with SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from argosec.operators.dependencies import ADVISORY
from argosec.plans import catalogue
from argosec.plans.scan import Options, scan
from argosec.sources.inputs import files_of_rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted(repr(tuple(one(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cur = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_full_scan_has_every_modality(spark):
    text = [("a.py", "eval(x)\npassword = 'p4x-Zq91!k'\n"), (".env", "DEBUG=true\nCORS_ORIGIN=*\n"), ("requirements.txt", "lib==1.0\n")]
    files = files_of_rows(spark.createDataFrame(text, "path string, content string"))
    advisories = spark.createDataFrame([("A-1", "PyPI", "lib", "0", "2.0", "HIGH", None, None)], ADVISORY)
    rows = scan(spark, files, Options(secrets=True, sca=True, config=True, allow=[{"id": "ZS-CFG-003"}]), advisories).collect()
    assert {r.kind for r in rows} == {"sast", "secret", "config", "sca"}
    assert not [r for r in rows if r.rule_id == "ZS-CFG-003"] and [r for r in rows if r.rule_id == "ZS-SEC-004"]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
