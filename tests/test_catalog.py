import duckdb
import pytest

from framelake.plans import queries
from framelake.plans.catalog import ENTRIES, catalog_records, twins
from framelake.schema import CODE, STATUSES

SCHEMA = "event_id long, ts timestamp_ntz"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalog")
    n = 3 * len(ENTRIES) + 40  # the last round is not whole
    spark.range(n).selectExpr("id AS event_id", "timestampadd(MICROSECOND, id * 7, TIMESTAMP_NTZ '2024-01-02 03:04:05') AS ts").repartition(5).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if "catalog" in n])
def test_every_kind_of_frame_against_what_is_stated_of_it(spark, tables, name):
    got = queries.QUERIES[name](spark, tables).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    want = db.execute(queries.ORACLE[name]).df()
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    if name == "q26_catalog_counters":
        assert got.min(axis=1).item() > 0 and (got.iloc[0] > 0).all()
    spark.catalog.clearCache()


def test_catalog_is_complete(spark, tables):
    assert {e.status for e in ENTRIES} | {e.gtp for e in ENTRIES if e.gtp} == {n for n, _ in STATUSES} == set(CODE)
    assert len({e.name for e in ENTRIES}) == len(ENTRIES) and len(set(twins())) == 2
    assert catalog_records(spark.read.parquet(f"{tables}/events.parquet")).count() == 3 * len(ENTRIES) + 40
    lost, kept = (queries.QUERIES[n](spark, tables).count() for n in ("q28_catalog_flows", "q29_catalog_flows_lossless"))
    assert lost == kept + 1  # the fragment whose slot was taken is a flow of its own
    spark.catalog.clearCache()
