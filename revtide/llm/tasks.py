"""Python code inside Spark tasks: shipping this package, and the two ways it is used."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import revtide


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application (as `--py-files` would)."""
    context = spark.sparkContext
    if getattr(context, "_revtide_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(revtide.__file__))
    folder = tempfile.mkdtemp(prefix="revtide-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"revtide_{context.applicationId.replace('-', '_')}.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for here, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    bundle.write(full, os.path.join("revtide", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._revtide_shipped = True


def _give_back() -> None:
    """Return freed memory to the system: workers are reused, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        return


def _mapped(function: Callable) -> Callable:
    def run(batches):
        yield from function(batches)
        _give_back()

    return run


def _grouped(function: Callable) -> Callable:
    def run(table):
        out = function(table)
        _give_back()
        return out

    return run


def _paired(function: Callable) -> Callable:
    def run(left, right):
        out = function(left, right)
        _give_back()
        return out

    return run


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """`mapInArrow` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(_mapped(function), schema)


def per_group(df: DataFrame, key: str, function: Callable, schema) -> DataFrame:
    """`applyInArrow` for each value of `key`: function(table) -> table."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(_grouped(function), schema)


def per_pair(left: DataFrame, left_key: str, right: DataFrame, right_key: str, function: Callable, schema) -> DataFrame:
    """`applyInArrow` on cogroups: function(left table, right table) -> table."""
    ship(left.sparkSession)
    return left.groupBy(left_key).cogroup(right.groupBy(right_key)).applyInArrow(_paired(function), schema)
