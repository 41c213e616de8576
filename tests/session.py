"""One local session for tests and checks."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fieldtide")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get(
            "FIELDTIDE_SCRATCH", tempfile.mkdtemp(prefix="fieldtide-")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
