"""A session with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # windows-1252 input
}


def get_session(app: str = "tabspark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**CONF, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
