"""Reading tables and laying out their partitions.

Every query takes ``(spark, folder)``; a table is ``<folder>/<name>.parquet``, a file or a folder of files.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once a session: their Python needs it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    sc._lodestone_shipped = True
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"  # the driver sends it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` under ``folder``."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores.

    A scan has one task per split; a table in one file of one row group would keep all Python work on one core.
    A scan that is wide enough is left as it is, so at scale nothing is shuffled, and so is what comes from a shuffle:
    adaptive plans choose its partitions, and asking for their number would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, rows with a null in a key left out.  Rows of one key are taken as copies of each other."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.dropDuplicates(list(keys))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: what ``spark.checkpoint.dir`` names; only a session on one machine may do without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that later steps read it instead of computing it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
