"""Session settings and the shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Uncompressed bytes that one shuffle partition should hold at most.
PARTITION_BYTES = 128 << 20


def local_session(cpus: int = 8, name: str = "tidemark", memory: str = "12g") -> SparkSession:
    """A session for one machine; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in spark.checkpoint.dir, or a temporary one on a single machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, so that what follows is computed once and survives a lost executor."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions so that none holds more than per_partition rows, and at least one for each core."""
    cores = spark.sparkContext.defaultParallelism
    return max(cores, math.ceil(rows / per_partition))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer partitions than there are cores (a small file has one); as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True
