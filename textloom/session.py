"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset on one machine (a local
    master, as in tests) a temporary one is taken, elsewhere it is an error. Never a localCheckpoint: executors may be lost.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-checkpoint-"))
    return df.checkpoint()


def safe_div(num: Column, den: Column) -> Column:
    """NULL on a zero or missing denominator (missing is not zero)."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def round6(value: Column) -> Column:
    """Six digits; NaN becomes NULL."""
    return F.when(~F.isnan(value), F.round(value, 6))
