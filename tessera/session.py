"""A Spark session with the settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """Adaptive execution on; UTC; Arrow for Python exchange. master and shuffle_partitions are left to the cluster where None."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
