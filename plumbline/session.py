"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    """Create a session with UTC time, adaptive execution and a RocksDB state store.

    Cluster sizing (executors, memory, shuffle partitions) stays with the submitter;
    adaptive execution coalesces or splits shuffle partitions from there.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


#: Bytes of rows that a Python worker gets at once; a longer row comes alone.
BATCH_BYTES = 4 << 20


def bounded_batches(df):
    """The same rows, handed to Python in batches bounded by bytes: a worker's memory does not follow the rows of its task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, as an archive of its source files, whatever folder it starts in."""
    if getattr(spark.sparkContext, "_plumbline_shipped", False):
        return
    spark.sparkContext._plumbline_shipped = True
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plumbline-package-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must see.

    Only in local mode, as in tests, an unset folder is replaced by an own one; on a cluster executors
    would each write to their own disk, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df):
    """Write a result once to the shared folder, compressed, and read it back.

    It is computed once, takes a fraction of a checkpoint's bytes, and leaves a fresh exchange before later joins,
    which adaptive execution can split.
    """
    path = f"{shared_folder(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, eager: bool = True):
    """Checkpoint to the shared folder, always: a plan's length never depends on a setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)
