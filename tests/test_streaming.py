from framelake.operators.decode import decode_frames
from framelake.operators.flows import KEY, flows
from framelake.schema import RECORDS
from framelake.streaming.flows import running_flows

from .builder import record, seeds


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [record(f, k, k) for k, f in enumerate(seeds() * 3)]
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_flows(spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        got = spark.table("running").select(*KEY, "packets", "bytes").collect()
    finally:
        query.stop()
    batch = flows(decode_frames(spark.createDataFrame(rows, RECORDS)))  # without borrowed ports
    assert sorted(map(str, got)) == sorted(map(str, batch.select(*KEY, "packets", "bytes").collect()))
