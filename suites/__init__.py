"""Registered queries and the SQL they are checked against."""
from __future__ import annotations

import re
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from suites.fixtures import CTES, Fixtures
from voxelspark.session import tune

cloudpickle.register_pickle_by_value(sys.modules[__name__])    # the example scorers run on executors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query over the test tables and, where there is one, its SQL."""
    def register(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Fixtures(tune(spark), sf_dir))
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = with_fixtures(sql)
        return build
    return register


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture tables it mentions, directly or through others."""
    sql = sql.strip()
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    heads = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    recursive = ""
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if match:
        recursive = "RECURSIVE " if match.group(1) else ""
        sql = sql[match.end():]
        return f"WITH {recursive}" + ",\n".join(heads + [sql]) if heads else f"WITH {recursive}{sql}"
    return ("WITH " + ",\n".join(heads) + "\n" + sql) if heads else sql


def digest(df: DataFrame, value) -> DataFrame:
    """Per scan: rows, sum of ``value`` (an integer) and a position-weighted sum."""
    from pyspark.sql import functions as F
    at = F.col("z") * 10007 + F.col("y") * 101 + F.col("x")
    df = df.select("scan_id", F.expr(value).alias("_v") if isinstance(value, str) else value.alias("_v"),
                   at.alias("_at"))
    return df.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"),
        F.sum(F.col("_v") * F.col("_at")).alias("weighted"), F.sum("_at").alias("places"))


def digest_sql(table: str, value: str) -> str:
    return (f"SELECT scan_id, count(*) AS n, cast(sum({value}) AS BIGINT) AS total, "
            f"cast(sum(({value}) * (z*10007 + y*101 + x)) AS BIGINT) AS weighted, "
            f"cast(sum(z*10007 + y*101 + x) AS BIGINT) AS places FROM {table} GROUP BY scan_id")
