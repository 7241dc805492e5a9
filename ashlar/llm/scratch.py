"""Shared working storage for multi-pass operators.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor never takes a result with it.  Where the session names no such
folder, a temporary one is made if everything runs on this machine (tests and
benches in local mode); anywhere else that is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: bytes of an Arrow batch; a worker holds some copies of one at a time
BATCH = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_made: list[tuple[SparkSession, str, str]] = []


def root(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ashlar-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH`` bytes, unless the session has chosen a bound of its own."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH))


def path(spark: SparkSession, what: str, table: str = "") -> str:
    """A fresh folder name below the shared root, removed when the driver ends."""
    out = f"{root(spark)}/ashlar/{what}-{uuid.uuid4().hex}"
    _made.append((spark, out, table))
    return out


def save(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in shared storage and return the reread table.

    This cuts the lineage: what follows restarts from replicated files, not
    from the executors that computed them.
    """
    spark = df.sparkSession
    small_batches(spark)
    out = path(spark, what)
    df.write.parquet(out)
    back = spark.read.schema(df.schema).parquet(out)
    back._ashlar_folder = out
    return back


def save_bucketed(df: DataFrame, what: str, *keys: str, dealt: bool = False) -> DataFrame:
    """``save`` as a table bucketed and sorted by ``keys``, one file a bucket.

    Joins and aggregates on the keys read it without an exchange, so a large
    table that meets several small ones is shuffled once.  ``dealt`` says that
    ``df`` comes partitioned by the keys, as from an aggregate or join on them.
    """
    spark = df.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"ashlar_{what}_{uuid.uuid4().hex}"
    out = path(spark, what, table)
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", out).saveAsTable(table)
    back = spark.table(table)
    back._ashlar_folder = out
    return back


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of ``tables`` is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        for k, (_, where, _) in enumerate(_made):
            if where and where == getattr(table, "_ashlar_folder", None):
                release(k, k + 1)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not at the driver's next collection.

    Worth it between the passes of an operator that shuffles as much as its input.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """At the end of a task: give a Python worker's free memory back, for workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mark() -> int:
    return len(_made)


def release(since: int = 0, until: int | None = None) -> None:
    """Delete folders made since a ``mark()``; their readers must be done."""
    until = len(_made) if until is None else until
    for k in range(since, until):
        spark, where, table = _made[k]
        if where:
            _delete(spark, where, table)
            _made[k] = (spark, "", "")


def _delete(spark: SparkSession, where: str, table: str) -> None:
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


atexit.register(release)
