"""Streaming forms, run to completion over the same data as their batch twins."""
import uuid

from pyspark.sql import functions as F

from suites import SQL, check
from suites import logs  # noqa: F401  (registers the batch twins)
from voxelspark.operators import runs
from voxelspark.session import cut_lineage, shared_folder
from voxelspark.streaming.progress import run_progress_stream
from voxelspark.streaming.settle import settled_stream


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _run(fx, slices, build, name, empty_batches=True):
    """Append slice after slice to a folder, and let a query that starts again from its checkpoint read each.

    Timers on the clock ask for empty batches without end, so a query that has them and shall stop goes without."""
    base = f"{shared_folder(fx.spark)}/voxelspark-{name}-{uuid.uuid4().hex}"
    before = fx.spark.conf.get(EMPTY_BATCHES)
    fx.spark.conf.set(EMPTY_BATCHES, str(empty_batches).lower())
    try:
        for part in slices:
            part.write.mode("append").parquet(f"{base}/in")
            stream = build(fx.spark.readStream.schema(part.schema).parquet(f"{base}/in"))
            q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
                 .trigger(availableNow=True).outputMode("append").start(f"{base}/out"))
            q.awaitTermination()
    finally:
        fx.spark.conf.set(EMPTY_BATCHES, before)
    return fx.spark.read.schema(stream.schema).parquet(f"{base}/out")


@check("x05_run_progress_stream")
def _(fx):
    log = cut_lineage(fx.run_log.select("run_id", "seq", "line"))
    out = _run(fx, [log.filter("seq < 20"), log.filter("seq >= 20")], run_progress_stream, "progress", empty_batches=False)
    return out.withColumn("factor", F.round("factor", 6))


@check("x07_settled_stream")
def _(fx):
    c = fx.table("events").selectExpr("user_id AS key", "cast(ts AS timestamp) AS ts", "event_id AS seq",
                                      "cast(event_id % 101 AS double) AS value")
    end = c.agg(F.max("ts").alias("ts")).selectExpr(
        "cast(-1 AS long) AS key", "ts + interval 10 days AS ts", "cast(0 AS long) AS seq", "0D AS value")
    half = F.lit("2024-01-15").cast("timestamp")
    slices = [c.filter(F.col("ts") < half), c.filter(F.col("ts") >= half), end]
    settled = _run(fx, slices, lambda s: settled_stream(s, 3600.0), "settled").filter("key >= 0")
    return runs.applied_changes(settled).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SQL["x05_run_progress_stream"] = SQL["x05_run_progress"]
SQL["x07_settled_stream"] = SQL["x07_settled_value"]
