"""Volumetric-scan analytics on Spark DataFrames.

Scans are rows of a header table, voxels and labels are long (sparse) tables
keyed by ``(scan_id, z, y, x)``; every operator takes and returns DataFrames.
"""
import sys

from pyspark import cloudpickle

from voxelspark.session import cut_lineage, shared_folder, tune

__all__ = ["cut_lineage", "shared_folder", "tune"]

# The few Python helpers travel to the executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
