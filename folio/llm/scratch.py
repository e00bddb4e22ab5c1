"""Tables that an operator writes once and reads again, in the folder all machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of a local application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, local runs (tests) get a temporary folder of their own; on a cluster
    that would lie on one machine only, so there it is an error.
    """
    conf, app = spark.sparkContext.getConf(), spark.sparkContext.applicationId
    if found := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-folio-")
    return _LOCAL[app]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash with none of ``taken``."""
    used = {c.lower() for c in taken}
    mark = "_"
    while any(mark + n in used for n in names):
        mark += "_"
    return [mark + n for n in names]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def tasks_for(rows: int, spark: SparkSession, each: int = 50_000) -> int:
    """How many tasks a step over so many rows is worth: from a few up to the session's shuffle partitions."""
    return max(6, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


def keep(df: DataFrame, name: str, compression: str = "zstd", tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``tasks`` limits the tasks of the last step, for tables known to be small."""
    spark = df.sparkSession
    df = df.coalesce(tasks) if tasks else df
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def keep_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """keep(), dealt by a column: later joins on it read a bucket in one task and shuffle the other side only."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"folio_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    out.schema  # found by now, so the catalog need not keep the name; the files stay
    spark.sql(f"DROP TABLE {table}")
    out._folio_path = path
    return out


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collectors find their frames unused; ask them now, after a large step."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by keep() that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._folio_path
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)
