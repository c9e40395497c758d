"""Session settings the jobs rely on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SQL_CONF = {
    # time stamps carry no zone
    "spark.sql.session.timeZone": "UTC",
    # malformed payload bytes decode to U+FFFD instead of failing the job
    "spark.sql.legacy.codingErrorAction": "true",
    # cp1251 is one of the accepted C-string charsets
    "spark.sql.legacy.javaCharsets": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the SQL options the package needs; cluster-level settings are left alone."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", name: str = "tidewire", **conf: str) -> SparkSession:
    """A session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables and stream state.

    It lies in the shared folder named by ``spark.checkpoint.dir`` and goes when the session ends. Only a
    local master, that is a test, gets a folder of this machine when none is configured.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewire-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cut_lineage(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    Used where several later steps must see the same rows of an expensive or sampled stage.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spread(spark.read.schema(df.schema).parquet(path))


def spread(df):
    """Use all cores for heavy per-row work when the input has fewer splits than cores.

    Large inputs have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
