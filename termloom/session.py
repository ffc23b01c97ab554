"""The session."""

from pyspark.sql import SparkSession


def session(app: str = "termloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
