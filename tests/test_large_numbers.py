"""Users and hosts whose numbers need more than the bytes that addresses and ports have for them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.plans import queries, synth

BASES = (0, 32_760, 65_528, 886_499, 1 << 24, 1_500_000_000)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Fragments of a datagram keep their user; users of different bases have equal lowest 15, 16 or 24 bits."""
    root = str(tmp_path_factory.mktemp("large"))
    db = duckdb.connect()
    db.execute(f"""COPY (SELECT e AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(e * 1000003) AS ts, [{", ".join(map(str, BASES))}][e // 20 % {len(BASES)} + 1] + (e // 20 // {len(BASES)}) % 2 * 8 + e % 3 % 2 AS user_id,
        '{{"k": ' || e * 7 % 100 || '}}' AS props FROM range(960) r(e)) TO '{root}/events.parquet'""")
    db.execute(f"""COPY (SELECT e AS l_orderkey, [0, 65535, 65536, 119999, 1200000, 307445760][e % 6 + 1] + e // 6 % 3 AS l_partkey, [0, 59999, 65536, 131072][e % 4 + 1] + e // 4 % 3 AS l_suppkey, (e % 7)::INT AS l_linenumber,
        (e % 50 + 1)::DOUBLE AS l_quantity, ['N', 'A', 'R'][e % 5 % 3 + 1] AS l_returnflag, TIMESTAMP '1995-01-02' + to_days((e % 300)::INT) AS l_shipdate FROM range(3000) r(e)) TO '{root}/lineitem.parquet'""")
    return root


@pytest.mark.parametrize("name", ["q06_flows", "q13_tunnels", "q38_flow_lookup", "q07_top_flows", "q08_flow_first_sender", "q09_flow_tcp_flags", "q10_fragment_attribution_flows", "q19_flow_csv_lines", "q21_flows_large", "q22_top_flows_large", "q23_host_proto_counts", "q25_lossless_fragments", "q33_capture_flows", "q34_report_summary", "q35_report_flows"])
def test_against_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, tables).toPandas()
    db = duckdb.connect()
    for table in ("events", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    want = db.execute(queries.ORACLE[name]).df()
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_users_beyond_the_frames_are_refused(spark):
    events = spark.range(1).select(F.lit(0).cast("long").alias("event_id"), F.lit((1 << 31) - 1).cast("long").alias("user_id"), F.lit('{"k": 1}').alias("props"), F.current_timestamp().alias("ts"))
    with pytest.raises(Exception, match="room for 2"):
        synth.synth_frames(events).collect()
