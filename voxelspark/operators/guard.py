"""Checking lines and paths for data that must not be published."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions import guarding as P
from voxelspark.plans.ordered import carry_last


def guard_text(lines: DataFrame, private: Sequence[str] = ()) -> DataFrame:
    """Hits in ``lines`` (line_id, path, line): line_id, part (path or text), path, reason, snippet.

    Path and text are tested apart. Words of the private list win over the
    allow-list, and what they matched is never shown. One pass, no join: the
    list is a handful of patterns and travels inside the expression.
    """
    what = F.array(F.struct(F.lit("path").alias("part"), F.coalesce("path", F.lit("")).alias("text")),
                   F.struct(F.lit("text").alias("part"), F.coalesce("line", F.lit("")).alias("text")))
    rows = lines.select("line_id", "path", F.explode(what).alias("w"))
    text = F.col("w.text")
    secret = P.is_private(text, private)
    reason = F.when(secret, P.PRIVATE).otherwise(P.shape_of(text))
    snippet = F.when(secret, P.HIDDEN).otherwise(F.trim(text))
    return rows.select("line_id", "w.part", "path", reason.alias("reason"), snippet.alias("snippet")).filter(
        "reason is not null")


def guard_private(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Only the hits of the private list."""
    return guard_text(lines, patterns).filter(F.col("reason") == P.PRIVATE)


def added_lines(diff: DataFrame, keys: Sequence[str] = ("diff_id",), bucket_rows: int = 65536) -> DataFrame:
    """Added lines of unified diffs (keys, seq, line) with the file they were added to."""
    line = F.col("line")
    header, reset = line.startswith("+++ "), line.startswith("diff --git")
    name = F.when(line.startswith("+++ b/"), F.substring("line", 7, 1 << 30)).otherwise(F.substring("line", 5, 1 << 30))
    event = F.when(header, F.struct(name.alias("path"))).when(reset, F.struct(F.lit(None).cast("string").alias("path")))
    seen = carry_last(diff, keys, F.floor(F.col("seq") / bucket_rows), ["seq"], {"at": event})
    added = line.startswith("+") & ~line.startswith("+++")
    return seen.filter(added).select(*keys, "seq", F.col("at.path").alias("path"), F.substring("line", 2, 1 << 30).alias("line"))


def guard_report(hits: DataFrame) -> DataFrame:
    """Every hit, marked ``refused``; an empty result means nothing was found."""
    return hits.select("line_id", F.coalesce("path", F.lit("(commit message)")).alias("path"), "reason", "snippet",
                      F.lit(True).alias("refused"))
