"""Files in and out: complaint CSV, log JSONL (strict, tolerant, many runs), JSON results, log append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLAINT = "id string, canal string, produto string, status string, texto_reclamacao string"
DETAILS = "modelo string, tentativa int, erro string, tokens_entrada long, tokens_saida long, tokens_total long, tokens_cache_leitura long, tokens_cache_escrita long, tamanho_lote int, stop_reason string, reclamacoes_ids array<string>, entrada_resumida string, saida_resumida string, total long, bloqueados long, falhas_pipeline long, criticos long, csv string, limite long, usar_llm boolean, workers int, batch_size int, cluster_id int, tamanho long, rotulo string, nome string, confirmado boolean"
LOG_LINE = f"timestamp string, execucao_id string, nivel string, acao string, tipo string, reclamacao_id string, status string, duracao_ms double, detalhes struct<{DETAILS.replace(' ', ':').replace(',:', ',')}>"
#: What common CSV readers take for a missing value.
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A"]


def complaint_csv(spark: SparkSession, path: str) -> DataFrame:
    """Complaints in file order (row_idx: increasing, with gaps); missing values are null. Columns are found by name."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    names = [c.split()[0] for c in COMPLAINT.split(", ")]
    rows = raw.select(*[F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in names])
    return rows.withColumn("row_idx", F.monotonically_increasing_id()).withColumnRenamed("texto_reclamacao", "texto")


def log_strict(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(LOG_LINE).option("mode", "FAILFAST").json(path)


def log_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Log lines without the malformed ones; ``arquivo`` is the run by its file's name."""
    read = spark.read.schema(LOG_LINE + ", __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    run = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""), "^execucao_", "")
    return read.withColumn("arquivo", run).where("__bad is null").drop("__bad")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    results.write.mode("overwrite").json(path)


def json_array(results: DataFrame) -> DataFrame:
    """All records as one JSON array, for small results."""
    return results.agg(F.to_json(F.collect_list(F.struct(*results.columns))).alias("json"))


def append_log(lines: DataFrame, path: str, run: str) -> None:
    """Append node logs of a run; one folder a run, so that runs never touch each other's files."""
    lines.withColumn("execucao_id", F.lit(run)).write.mode("append").partitionBy("execucao_id").json(path)


def run_id(prefix: str = "execucao") -> str:
    """Name of a run: prefix and local time."""
    from datetime import datetime

    return f"{prefix}_{datetime.now():%Y%m%d-%H%M%S}"


class Run:
    """The log of a run, opened by its first line. Lines are kept on the driver until ``flush`` or the end appends them to the run's folder;
    lines of tasks are DataFrames and go through ``append``."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "execucao", most: int = 1000):
        self.spark, self.path, self.prefix, self.most, self.id, self.lines = spark, path, prefix, most, None, []

    def start(self) -> str:
        """Open a run (the one before it ends); its id is the local time."""
        self.end()
        self.id = run_id(self.prefix).removeprefix(self.prefix + "_")
        return self.id

    def record(self, acao: str, status: str = "ok", duracao_ms: float | None = None, reclamacao_id: str | None = None, detalhes: dict | None = None, nivel: str = "INFO", tipo: str = "acao") -> None:
        """One line; ``tipo`` "resumo" is for totals of the run, which are no action's latency."""
        import json
        from datetime import datetime, timezone

        if self.id is None:
            self.start()
        self.lines.append((datetime.now(timezone.utc).isoformat(), nivel, acao, tipo, reclamacao_id, status, duracao_ms, json.dumps(detalhes or {}, ensure_ascii=False)))
        if len(self.lines) >= self.most:
            self.flush()

    def append(self, lines: DataFrame) -> None:
        if self.id is None:
            self.start()
        append_log(lines, self.path, self.id)

    def flush(self) -> None:
        if self.lines:
            rows = self.spark.createDataFrame(self.lines, "timestamp string, nivel string, acao string, tipo string, reclamacao_id string, status string, duracao_ms double, d string")
            details = "struct<" + ", ".join(f"{a}:{b}" for a, b in (x.split() for x in DETAILS.split(", "))) + ">"
            self.lines = []
            append_log(rows.withColumn("detalhes", F.from_json("d", details)).drop("d").coalesce(1), self.path, self.id)

    def end(self) -> None:
        """Write what is left and close the run; without an open run nothing happens."""
        if self.id is not None:
            self.flush()
        self.id = None

    @property
    def folder(self) -> str | None:
        return f"{self.path}/execucao_id={self.id}" if self.id else None

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.end()


def remove_named(names: list[str], prefix: str, remove=None) -> list[str]:
    """The names with a prefix, each given to ``remove`` if there is one (without it nothing is deleted). The service behind it isn't part of this."""
    found = [n for n in names if n.startswith(prefix)]
    if remove:
        for name in found:
            remove(name)
    return found


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of every PDF at ``path``; needs pypdf on the executors, which is not part of this image."""

    def run(frames):
        from io import BytesIO

        import pandas as pd
        from pypdf import PdfReader

        for pdf in frames:
            for raw in pdf["content"]:
                pages = PdfReader(BytesIO(raw)).pages
                yield pd.DataFrame({"page": range(1, len(pages) + 1), "text": [p.extract_text() or "" for p in pages]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "page int, text string")
