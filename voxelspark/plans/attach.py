"""Joining per-scan facts to voxel-sized tables without trusting sizes or keys."""
from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 16


_ROWS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def fits_broadcast(df: DataFrame, row_bytes: int = 256) -> bool:
    """True when ``df`` has at most ``BROADCAST_BYTES / row_bytes`` rows.

    Counted once per DataFrame; a plain count, combined in every task.
    """
    most = BROADCAST_BYTES // row_bytes
    rows = _ROWS.get(df)
    if rows is None:
        rows = _ROWS[df] = df.count()
    return rows <= most


def attach(rows: DataFrame, facts: DataFrame, on: str | Sequence[str] = "scan_id",
           sized_by: DataFrame | None = None, how: str = "inner",
           row_bytes: int = 256, salt_by: Sequence[str] = ("z", "y")) -> DataFrame:
    """Join few facts per key to many rows.

    ``sized_by`` is a cheap table with at least as many rows as ``facts`` (the
    scan headers, say); its row count is what decides. Small enough: broadcast.
    Otherwise a salted shuffle join, so that a scan holding a third of all
    voxels is still spread over ``SALTS`` tasks.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(facts if sized_by is None else sized_by, row_bytes):
        return rows.join(F.broadcast(facts), keys, how)
    return salted_join(rows, facts, keys, how, salt_by)


def salted_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner",
                salt_by: Sequence[str] = ("z", "y")) -> DataFrame:
    """Shuffle join in which every key of ``rows`` is spread over ``SALTS`` tasks."""
    spread = F.pmod(F.hash(*salt_by), F.lit(SALTS))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_salt", spread)
            .join(copies, [*keys, "_salt"], how).drop("_salt"))
