"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  # folders of local applications without the setting


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (``local``
    masters, as in tests) a temporary folder is made and remembered; a cluster
    must name the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        # the setting is the context's, which takes no new value once it runs
        name = spark.sparkContext.applicationId
        folder = _made[name] = _made.get(name) or "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return folder.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written as Parquet into the shared folder and read back.

    Cuts the lineage with files that outlive a lost executor, and serves plans
    that read the rows several times.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows written once into the shared folder in buckets by ``key``, so that windows, joins and sums by it read them without a shuffle."""
    spark = rows.sparkSession
    made, buckets = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(buckets, key).write.option("path", f"{shared_folder(spark)}/tickloom/{made}").bucketBy(buckets, key).sortBy(key).saveAsTable(made)
    return spark.table(made)
