"""Session defaults that the library's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "almanax", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, *tables: str):
    """The named tables of a data folder, one DataFrame each."""
    frames = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]
    return frames[0] if len(frames) == 1 else frames


def cores(spark: SparkSession) -> int:
    """Tasks that keep all cores busy, and as many as shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores by keys, for work that costs much per row: a table of few bytes is else a task or two, however many rows it has."""
    return rows.repartition(cores(rows.sparkSession), *keys)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it; only where that is unset and all is one machine, a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("executors on other machines need a shared folder: set spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="almanax-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is written there stays until drop_scratch() or clear_scratch()."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_scratch(path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    from pyarrow.fs import FileType

    from almanax.sources.files import filesystem

    files, name, _ = filesystem(path)
    if files.get_file_info(name).type == FileType.Directory:
        files.delete_dir(name)
    if path in _made:
        _made.remove(path)


def clear_scratch() -> int:
    """Remove all that this process left, once the results made of it are written or no longer needed; how many."""
    n = len(_made)
    for path in list(_made):
        drop_scratch(path)
    return n


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back, so that later uses neither recompute it nor depend on lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
