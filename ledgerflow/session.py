"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors instead of silent nulls, strict stores, UTC, and plans that adapt to sizes and skew at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.storeAssignmentPolicy": "STRICT",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Files that Spark writes for itself hold the data as well; these encrypt them.
ENCRYPTION = {"spark.io.encryption.enabled": "true", "spark.io.encryption.keySizeBits": "256"}


def session(app: str = "ledgerflow", master: str | None = None, encrypt: bool = False, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map=SETTINGS | (ENCRYPTION if encrypt else {}) | settings)
    return (b.master(master) if master else b).getOrCreate()
