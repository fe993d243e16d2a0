"""Execution logs as a stream: error rate and latency by tumbling window, late lines within the watermark counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ouvidor.plans.registry import query
from ouvidor.sources.tables import exec_log

LINES = "timestamp timestamp, acao string, status string, duracao_ms double"


def windows(lines: DataFrame, every: str = "5 minutes") -> DataFrame:
    return lines.groupBy(F.window("timestamp", every).alias("w")).agg(F.count("*").alias("linhas"), F.count_if(F.col("status") == "erro").alias("erros"), F.sum("duracao_ms").alias("soma_ms")).select(F.col("w.start").alias("inicio"), "linhas", "erros", "soma_ms")


def stream(spark, folder: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return windows(spark.readStream.schema(LINES).json(folder).withWatermark("timestamp", late), every)


@query("Q_log_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS inicio, count(*) AS linhas, count(*) FILTER (WHERE event_type = 'error') AS erros FROM events GROUP BY 1")
def log_windows(spark, sf_dir):
    """The batch form, hourly, over the whole log."""
    lines = exec_log(spark, sf_dir).select(F.to_timestamp("timestamp").alias("timestamp"), "acao", "status", "duracao_ms")
    return windows(lines, "1 hour").select(F.col("inicio").cast("timestamp_ntz").alias("inicio"), "linhas", "erros")
