"""Session settings the package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings above; ``conf`` entries win over them.

    Keys in ``conf`` use ``__`` for the dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**SETTINGS, **given}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
