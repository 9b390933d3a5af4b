"""Session settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "vellumite", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Only on one machine (a local master) are partitions and memory set; on a
    cluster they stay what its defaults say."""
    b = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    if master:
        b = b.master(master)
    if (master or os.environ.get("MASTER", "")).startswith("local"):
        base |= {
            "spark.sql.shuffle.partitions": os.environ.get("VELLUMITE_SHUFFLE", "8"),
            "spark.driver.memory": os.environ.get("VELLUMITE_DRIVER_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
