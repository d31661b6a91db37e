"""Session helpers: defaults, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of text in them, up to which a side may be broadcast. Its other columns are numbers, so this bounds a broadcast at about 50 MB.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 32_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidegrid") -> SparkSession:
    """A session for tests and the benchmark. On a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "262144")  # else the few row groups of a small file are dealt to two or three cores
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEGRID_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    It is the session's spark.checkpoint.dir, which wins over one that the context has already. Only a local session without either gets a temporary folder; elsewhere one of them is required.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    at = sc.getCheckpointDir()
    plain = lambda path: re.sub("^file:/+", "/", path).rstrip("/")
    if at is None or folder is not None and not plain(at).startswith(plain(folder)):
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidegrid-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share, and read from there: lineage ends here and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """df with a broadcast hint if one job over it proves that it has at most max_rows rows and max_bytes bytes of text; else df, for a shuffled join that adaptive execution splits where keys are hot. A side with columns that are neither text nor of a fixed size is never broadcast."""
    max_rows, max_bytes = BROADCAST_ROWS if max_rows is None else max_rows, BROADCAST_BYTES if max_bytes is None else max_bytes
    if any(isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType)) for f in df.schema):
        return df
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    bytes_ = F.sum(reduce(lambda a, b: a + b, text, F.lit(0)).cast("long"))
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(bytes_, F.lit(0)).alias("b")).head()
    return F.broadcast(df) if size["n"] <= max_rows and size["b"] <= max_bytes else df
