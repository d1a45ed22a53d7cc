"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space (a fixed set).
WHITE_SPACE = "".join(map(chr, (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column | str) -> Column:
    """The text without white space around it."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def id_key(c: Column | str) -> Column:
    """An id as it is compared: no white space around it, no regard to case; null if blank."""
    k = F.lower(strip(c))
    return F.when(F.length(k) > 0, k)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own setting, else (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(?:\[|$)", sc.master):  # a cluster, be it of local processes
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"quarryframe-{sc.applicationId}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept where every executor can read them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they were started; once a session."""
    sc = spark.sparkContext
    name = f"quarryframe-{sc.applicationId}.zip"
    if getattr(sc, "_quarryframe", None) == name:
        return
    base = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(SparkFiles.getRootDirectory(), "sent-" + name)  # the driver's own folder; Spark serves it from there
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(base):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(base)))
    sc.addPyFile(at)
    sc._quarryframe = name


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that AQE must not coalesce away."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
