"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    base = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_src")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
    _SHIPPED.add(app)


def shipped(query):
    """``query`` with the package sent first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
