"""Session, shared scratch space and bounded side tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest side table, in rows, that may be held on the driver or broadcast.
SIDE_TABLE_ROWS = 10_000

_local_roots: dict[str, str] = {}


def local_session(cores: int | str = "*", memory: str = "16g", **conf: str) -> SparkSession:
    """Single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabwright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back on a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tabwright-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared root; two calls never return the same one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Give iterative learners a reliable checkpoint folder, keeping one already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared root and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_table(df: DataFrame, name: str = "side", limit: int = SIDE_TABLE_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a table that is expected to be small.

    Up to ``limit`` rows become a local relation whose size Catalyst knows, so joins with it
    are broadcast; anything larger goes to a written table and is joined by shuffle. The flag
    tells which of the two happened.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return written(df, name), False
