import os

import duckdb
import pytest

import __spark_entry__ as entry
from framelake.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["q05_fragment_counts", "q07_top_flows", "q19_flow_csv_lines", "q22_top_flows_large", "q24_pcap_roundtrip", "q31_capture_variants", "q32_capture_ends", "q33_capture_flows", "q34_report_summary", "q35_report_flows", "q36_report_gtpu", "q37_report_tunnels"])
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for table in ("events", "lineitem", "nation"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_points():
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_frames_are_decoded_once(spark):
    """Whatever a query needs of them, its plan has one Python node that decodes, or none."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    for name, nodes in {"q01_capture_totals": 0, "q05_fragment_counts": 1, "q06_flows": 1, "q11_gtpu_counters": 1, "q13_tunnels": 1, "q18_capture_span": 0}.items():
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert len({line[line.index("MapInArrow") :] for line in plan.splitlines() if "MapInArrow" in line}) == nodes, name  # a kept table's plan is shown wherever it is read
    spark.catalog.clearCache()
