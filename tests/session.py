"""One local session for tests and scripts."""

import os

from pyspark.sql import SparkSession


def session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("surveyloom")
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
