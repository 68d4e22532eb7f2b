"""Places that every executor can reach: checkpoints and written intermediate tables.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only where that is unset and the session runs in
one process, as in tests, a folder below the local temporary directory is used instead; on a cluster it must be named.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of written tables by the identity that `written` gives their frames.
_PATH = "_millrace_path"


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets the session's checkpoint folder where the cluster has not."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back: no lineage, columns can be pruned.

    The table goes when the session's JVM ends, or with `discard` before that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, _PATH, None)
        if path:
            fs, p = _hadoop_path(df.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """One small text file, in any store that Spark writes to."""
    fs, p = _hadoop_path(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of one small text file; None if there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)
