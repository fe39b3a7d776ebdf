"""Logs and runs in batch: progress, errors, settled values, numbering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.functions import progress as P
from voxelspark.plans.attach import attach
from voxelspark.plans.ordered import next_value, number_rows

# Fixed values.
SETTLE_SECONDS = 0.3
SAME_WITHIN = 0.05
DEFAULT_VALUE = 50.0


def run_progress(log: DataFrame, n_classes: int = P.N_CLASSES, teeth: bool = True,
                 bucket_rows: int = 65536) -> DataFrame:
    """``factor`` (0..1) and ``phase`` after every line of every run (run_id, seq, line).

    A block of lines is summed up as what it does to any run that comes to it: the stage it
    ends in, lines counted since the last stage opened, and the last factor, which before
    the block's first opening line depends on the stage it comes in with. Such summaries
    compose, so one scan over a run's blocks (a row each) gives every block its start, and
    lines are looked at within their block only: three shuffles, of lines once. Lines without
    a run belong to none: their blocks are taken each by itself.
    """
    end = P.MESH if teeth else P.MESH_ALONE
    event = P.event_of(F.col("line"))
    is_mesh = event.isin("mesh", "arch") & F.trim("line").rlike(P.MESH_LINE)
    rows = log.select("run_id", "seq", F.floor(F.col("seq") / bucket_rows).alias("block"), event.alias("event"), P.phase_of(event).alias("opens"),
                      F.coalesce(is_mesh, F.lit(False)).alias("is_mesh"), F.when(event == "tile", P.tile_share(F.col("line"))).alias("part"))
    rows = rows.repartition("run_id", "block")
    lines = Window.partitionBy("run_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    stage = Window.partitionBy("run_id", "block", "opened").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"opened": F.count("opens").over(lines), "phase": F.last("opens", ignorenulls=True).over(lines)})
    rows = rows.withColumns({"meshes": F.count_if("is_mesh").over(stage), "arches": F.count_if(F.coalesce(F.col("event") == "arch", F.lit(False))).over(stage)})

    def factor(phase: Column, meshes: Column, arches: Column) -> Column:
        """The factor a line sets, in a stage, with so many lines counted since the stage began."""
        e, part = F.col("event"), F.col("part")
        return (F.when(e == "reading", F.lit(P.START)).when(e.isin("resampled", "computing"), F.lit(P.READ))
                .when((e == "tile") & (phase == "net"), P.READ + (P.NET - P.READ) * part)
                .when(e == "surfaces", F.lit(P.NET))
                .when(F.col("is_mesh") & (phase == "mesh"), P.NET + (end - P.NET) * F.least(F.lit(1.0), meshes / max(1, n_classes)))
                .when(e == "separating", F.lit(P.MESH))
                .when((e == "arch") & (phase == "teeth"), P.MESH + (P.TEETH - P.MESH) * arches / 2)
                .when((e == "tile") & (phase == "teeth"), P.MESH + (P.TEETH - P.MESH) * (arches + part) / 2)
                .when(e == "done", F.lit(1.0)))

    def last(value: Column, where: Column) -> Column:
        return F.max(F.when(where, F.struct("seq", value.alias("v"))))

    before, e = F.col("opened") == 0, F.col("event")
    own = factor(F.col("phase"), F.col("meshes"), F.col("arches"))
    sums = rows.groupBy("run_id", "block").agg(
        last(F.col("phase"), ~before)["v"].alias("phase"), last(F.col("meshes"), F.lit(True))["v"].alias("meshes"), last(F.col("arches"), F.lit(True))["v"].alias("arches"),
        last(own, ~before & own.isNotNull())["v"].alias("factor"),
        last(own, before & e.isin("resampled", "done")).alias("any"), last(P.READ + (P.NET - P.READ) * F.col("part"), before & (e == "tile")).alias("net"),
        last(F.col("meshes").cast("double"), before & F.col("is_mesh")).alias("mesh"),
        last(F.col("arches") + F.coalesce("part", F.lit(0.0)), before & e.isin("arch", "tile")).alias("teeth"))
    run = Window.partitionBy("run_id").orderBy("block")
    done = run.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"from": F.last("phase", ignorenulls=True).over(done), "since": F.count("phase").over(run)})
    one = Window.partitionBy("run_id", "since").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"all_meshes": F.sum("meshes").over(one), "all_arches": F.sum("arches").over(one)})
    sums = sums.withColumns({f"from_{c}": F.coalesce(F.lag(f"all_{c}").over(run), F.lit(0)) for c in ("meshes", "arches")})
    # what the lines before the first opening one come to in the stage they are met in
    mesh = F.col("mesh.v") + F.col("from_meshes")
    by_stage = (F.when(F.col("from") == "net", F.col("net")).when(F.col("from") == "mesh", F.when(F.col("mesh").isNotNull(), F.struct(
        "mesh.seq", (P.NET + (end - P.NET) * F.least(F.lit(1.0), mesh / max(1, n_classes))).alias("v"))))
        .when(F.col("from") == "teeth", F.when(F.col("teeth").isNotNull(), F.struct(
            "teeth.seq", (P.MESH + (P.TEETH - P.MESH) * (F.col("from_arches") + F.col("teeth.v")) / 2).alias("v")))))
    sums = sums.withColumn("factor", F.coalesce("factor", F.greatest("any", by_stage)["v"]))
    sums = sums.select("run_id", "block", "from", "from_meshes", "from_arches", F.last("factor", ignorenulls=True).over(done).alias("from_factor"))
    both = rows.join(sums, ["run_id", "block"], "left")
    inside = F.when(before & F.col("run_id").isNotNull(), F.lit(1)).otherwise(0)
    both = both.na.fill(0, ["from_meshes", "from_arches"])
    both = both.withColumn("phase", F.coalesce("phase", "from"))
    both = both.withColumn("own", factor(F.col("phase"), F.col("meshes") + inside * F.col("from_meshes"), F.col("arches") + inside * F.col("from_arches")))
    return both.select("run_id", "seq", "phase", F.coalesce(F.last("own", ignorenulls=True).over(lines), F.col("from_factor")).alias("factor"))


def first_error(log: DataFrame) -> DataFrame:
    """Per run the first ``ERROR:`` line and the exit code, if logged."""
    line = F.col("line")
    error = F.min(F.when(line.startswith("ERROR:"), F.struct("seq", "line")))
    code = F.regexp_extract("line", r"^exit code (-?\d+)", 1).try_cast("int")
    return log.groupBy("run_id").agg(error.alias("e"), F.max_by(code, F.when(code.isNotNull(), F.col("seq"))).alias("exit_code")).select(
        "run_id", F.trim(F.substring("e.line", 7, 1 << 30)).alias("error"), "exit_code")


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def settled_value(changes: DataFrame, gap_seconds: float = SETTLE_SECONDS, first: float = DEFAULT_VALUE,
                  bucket: Column | None = None) -> DataFrame:
    """Values (key, ts, value) that stayed for ``gap_seconds`` and differ from the one applied before.

    Values count to one decimal, so "within 0.05 of the applied one" is "equal
    to the settled one before it".
    """
    bucket = F.date_trunc("day", "ts") if bucket is None else bucket
    pos = ["ts", "seq"] if "seq" in changes.columns else ["ts"]
    rows = changes.withColumn("value", F.bround(F.col("value").cast("double"), 1))
    rows = next_value(rows, ["key"], bucket, pos, {"next_ts": F.col("ts")})
    wait = _seconds("next_ts") - _seconds("ts")
    calm = rows.filter(F.col("next_ts").isNull() | (wait >= gap_seconds)).drop("next_ts")
    return applied_changes(calm, first, bucket)


def applied_changes(settled: DataFrame, first: float = DEFAULT_VALUE, bucket: Column | None = None) -> DataFrame:
    """Settled values (key, ts, value) without those equal to the one before them."""
    bucket = F.date_trunc("day", "ts") if bucket is None else bucket
    # the value before is the next one in reverse order
    rows = next_value(settled.withColumn("_order", -_seconds("ts")), ["key"],
                      -bucket.cast("timestamp").cast("double"), ["_order"], {"applied": F.col("value")})
    kept = F.abs(F.col("value") - F.coalesce("applied", F.lit(first))) >= SAME_WITHIN
    return rows.filter(kept).select("key", "ts", "value")


def number_runs(new: DataFrame, existing: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Numbers for new runs per group: after the highest so far, gaps kept."""
    top = existing.groupBy("group").agg(F.max("number").alias("top"))
    ranked = number_rows(new, ["group"], bucket, order, "rn")
    both = attach(ranked, top, on="group", how="left", salt_by=tuple(order))
    return both.withColumn("number", F.coalesce("top", F.lit(0)) + F.col("rn")).drop("top", "rn")
