"""Session builder: one place for the settings every plan assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps day boundaries equal on every machine; ANSI stays on, so every division in the library is a ``try_divide``.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "ledgersift", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Create or fetch the session. ``master=None`` leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
