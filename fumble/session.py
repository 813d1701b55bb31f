"""Session helpers: a local session for tests and a shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fumble") -> SparkSession:
    """A local session configured like the tests and the benchmark expect.

    On a cluster, build the session with the cluster's own settings instead;
    nothing in the library depends on these values.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names this folder (a shared file system path). Only a local
    session, as in tests, may have none: it gets a temporary one here.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server side owns the checkpoint folder
        sc = None
    # a session of the same application, such as that of a stream, has the folder of the first
    current = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_fumble_checkpoint_dir", None)
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="fumble-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and getattr(sc, "_fumble_checkpoint_dir", None) != current:
        sc._fumble_checkpoint_dir = current
        sc.setCheckpointDir(current)  # makes a folder of its own there each time
    return current


def ship_package(spark: SparkSession) -> None:
    """Make ``fumble`` importable in Python workers (pandas UDFs), once per context.

    The equivalent of ``spark-submit --py-files fumble.zip``: the package is
    zipped on the driver and distributed by Spark to every executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship through the artifact API instead
        sc = None
    holder = sc if sc is not None else spark
    if getattr(holder, "_fumble_shipped", False):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="fumble-pkg-"), "fumble.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    holder._fumble_shipped = True


BATCH_ROWS = 512  # texts that a Python worker holds at a time


def session_with(spark: SparkSession, **conf: str) -> SparkSession:
    """Another session of the same application with the settings of ``spark`` but
    for ``conf`` (dots as double underscores); other queries do not see these."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def text_session(spark: SparkSession) -> SparkSession:
    """The session of ``spark`` for Python steps over texts: what a worker holds
    is ``BATCH_ROWS`` rows, however many rows a task has."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in range(1, BATCH_ROWS + 1):
        return spark
    if getattr(spark, "_fumble_texts", None) is None:
        spark._fumble_texts = session_with(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS))
    return spark._fumble_texts


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (noise, distances, alignment) one task per core.

    A small Parquet file with one row group arrives as one partition; a large
    input already has at least as many partitions as cores and is left as is
    (no shuffle). Use after a scan, not after a shuffle (see ``rebalance``).
    """
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # Spark Connect has no RDD view; leave the scan as planned
        return df
    if have < want:
        return df.repartition(want)
    return df


def rebalance(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a small, bounded result (e.g. a sample) over all cores.

    After a shuffle AQE coalesces small outputs into one partition; an
    explicit partition count is kept as given.
    """
    if min_partitions is None:
        try:
            min_partitions = df.sparkSession.sparkContext.defaultParallelism
        except Exception:
            min_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return df.repartition(min_partitions)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, e.g. for stream state."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
