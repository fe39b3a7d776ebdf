"""What a worker's log line says about its progress."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the bar at the end of each stage.
READ, NET, MESH, TEETH = 0.05, 0.70, 0.90, 0.99
MESH_ALONE = 0.98
START = 0.01
TILE = r"^tile (\d+)/(\d+)"
MESH_LINE = r"^[A-Z][\w ]+: "
ARCH_LINE = r"^(upper|lower) arch"
N_CLASSES = 9


def event_of(line: Column) -> Column:
    """The kind of line, whatever the stage: marks first, then tile, mesh and arch lines."""
    s = F.trim(line)
    return (F.when(s.startswith("reading:"), "reading").when(s.startswith("resampled to"), "resampled")
            .when(s.startswith("computing on:"), "computing").when(s.rlike(TILE), "tile")
            .when(s.startswith("canal looks broken"), "canal").when(s.startswith("surfaces prepared"), "surfaces")
            .when(s.startswith("separating teeth"), "separating").when(s.startswith("done in"), "done")
            .when(s.rlike(ARCH_LINE), "arch").when(s.rlike(MESH_LINE), "mesh"))


def phase_of(event: Column) -> Column:
    """The stage a line opens; null if it opens none."""
    return (F.when(event == "reading", "read").when(event == "computing", "net")
            .when(event == "surfaces", "mesh").when(event == "separating", "teeth"))


def tile_share(line: Column) -> Column:
    s = F.trim(line)
    total = F.greatest(F.regexp_extract(s, TILE, 2).try_cast("int"), F.lit(1))
    return F.regexp_extract(s, TILE, 1).try_cast("int") / total
