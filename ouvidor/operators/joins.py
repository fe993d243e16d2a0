"""Joins, sets, batches and validation around what a model returned for complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions.text import sql_lit
from ouvidor.operators.complaints import RESULT, guarded
from ouvidor.plans.registry import query
from ouvidor.sources.tables import BY_ID, by_id, complaints

c = F.col
ROWS = f"WITH {RESULT}, {BY_ID}, last AS (SELECT * FROM classif QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


def last_by_id(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row an id, the last; an aggregate, so copies are combined before the shuffle."""
    others = [x for x in rows.columns if x != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("r")).select("id", "r.*")


@query("Q_dedup_last", f"{ROWS} SELECT * FROM last")
def dedup_last(spark, sf_dir):
    return last_by_id(by_id(spark, sf_dir, "classif"))


@query("Q_join_classif", f"{ROWS} SELECT complaints.id, canal, categoria, sentimento, urgencia FROM complaints JOIN last ON complaints.id = last.id")
def join_classif(spark, sf_dir):
    return complaints(spark, sf_dir).join(last_by_id(by_id(spark, sf_dir, "classif")), "id").select("id", "canal", "categoria", "sentimento", "urgencia")


@query("Q_join_risk_left", f"{ROWS} SELECT result.id, coalesce(nivel, risco_nivel) AS nivel, CASE WHEN nivel IS NULL THEN risco_justificativa ELSE justificativa END AS justificativa FROM result LEFT JOIN risk ON result.id = risk.id WHERE motivo_bloqueio IS NULL")
def join_risk_left(spark, sf_dir):
    """Risk that a model gave, else the heuristic one."""
    from ouvidor.operators.complaints import results

    rows = results(spark, sf_dir).where("motivo_bloqueio is null").select("id", "risco_nivel", "risco_justificativa")
    both = rows.join(by_id(spark, sf_dir, "risk"), "id", "left")
    return both.select("id", F.coalesce("nivel", "risco_nivel").alias("nivel"), F.when(c("nivel").isNull(), c("risco_justificativa")).otherwise(c("justificativa")).alias("justificativa"))


@query("Q_semi_blocked", f"{ROWS} SELECT id FROM last SEMI JOIN (SELECT id FROM result WHERE bloqueado) b USING (id)")
def semi_blocked(spark, sf_dir):
    blocked = guarded(complaints(spark, sf_dir)).where("bloqueado").select("id")
    return last_by_id(by_id(spark, sf_dir, "classif")).select("id").join(blocked, "id", "left_semi")


@query("Q_anti_pending", f"{ROWS} SELECT id FROM result WHERE motivo_bloqueio IS NULL AND id NOT IN (SELECT id FROM last)")
def anti_pending(spark, sf_dir):
    pending = guarded(complaints(spark, sf_dir)).where("motivo_bloqueio is null").select("id")
    return pending.join(by_id(spark, sf_dir, "classif").select("id"), "id", "left_anti")


def batches(rows: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    """+ lote: number of the batch of ``size`` rows in input order (size <= 0: one batch).

    Row numbers over everything without one task for all rows: rows are counted by range of the order column, ranges by range of
    ranges, and the counts before a range are added to the number inside it. One task sees a row for each of the larger ranges,
    of 2 ** 28 numbers. What the rows come from is computed once: both uses read one exchange, which the optimizer shares only if
    both need all columns and the same filters, so the counts come with a hash of them, and no join key can be null (rows
    without an order come first).
    """
    if size <= 0:
        return rows.withColumn("lote", F.lit(0).cast("long"))
    step, steps = 12, 16  # bits
    ranged = rows.withColumn("faixa", F.coalesce(F.shiftright(c(order).cast("long"), step), F.lit(-(1 << 62)))).repartition("faixa")
    inside = ranged.withColumn("n", F.row_number().over(Window.partitionBy("faixa").orderBy(order)))
    before = lambda w: F.coalesce(F.sum("qtd").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("faixa").agg(F.count("*").alias("qtd"), F.max(F.xxhash64(*rows.columns)).alias("h")).where("h is not null").select("faixa", "qtd", F.shiftright("faixa", steps).alias("bloco"))
    blocks = counts.groupBy("bloco").agg(F.sum("qtd").alias("qtd")).select("bloco", before(Window.orderBy("bloco")).alias("antes_bloco"))
    starts = counts.select("faixa", "bloco", before(Window.partitionBy("bloco").orderBy("faixa")).alias("antes")).join(blocks, "bloco")
    numbered = inside.join(starts.select("faixa", (c("antes") + c("antes_bloco")).alias("antes")), "faixa")
    return numbered.withColumn("lote", F.floor((c("antes") + c("n") - 1) / size)).drop("faixa", "n", "antes")


_BATCHED = f"{ROWS}, b AS (SELECT id, (row_number() OVER (ORDER BY row_idx) - 1) // 15 AS lote FROM result WHERE motivo_bloqueio IS NULL)"


def pending_batches(spark, sf_dir, size: int = 15, also: tuple = ()) -> DataFrame:
    """(row_idx, id, *also, lote) of the accepted complaints."""
    return batches(guarded(complaints(spark, sf_dir)).where("motivo_bloqueio is null").select("row_idx", "id", *also), size)


@query("Q_batches", f"{_BATCHED} SELECT id, lote FROM b")
def batch_ids(spark, sf_dir):
    return pending_batches(spark, sf_dir).select("id", "lote")


@query("Q_missing_ids", f"{_BATCHED}, m AS (SELECT lote, count(*) AS esperados, count(*) FILTER (WHERE id NOT IN (SELECT id FROM last)) AS ausentes FROM b GROUP BY lote) SELECT * FROM m WHERE ausentes > 0")
def missing_ids(spark, sf_dir):
    """Batches whose answer lacks ids, with how many."""
    found = by_id(spark, sf_dir, "classif").select("id", F.lit(True).alias("veio")).distinct()
    rows = pending_batches(spark, sf_dir).join(found, "id", "left")
    return rows.groupBy("lote").agg(F.count("*").alias("esperados"), F.count_if(c("veio").isNull()).alias("ausentes")).where("ausentes > 0")


@query("Q_union_tasks", f"{ROWS} SELECT id, 'bloqueada' AS tarefa FROM result WHERE motivo_bloqueio IS NOT NULL UNION ALL SELECT id, 'pendente' FROM result WHERE motivo_bloqueio IS NULL")
def union_tasks(spark, sf_dir):
    """Every complaint with its task, in one pass: each is in one branch of the union."""
    return guarded(complaints(spark, sf_dir)).select("id", F.when(c("motivo_bloqueio").isNotNull(), "bloqueada").otherwise("pendente").alias("tarefa"))


def answers(spark, sf_dir) -> DataFrame:
    """What a model might have answered: JSON in prose, sometimes without any bracket."""
    rows = by_id(spark, sf_dir, "classif").join(complaints(spark, sf_dir).select("id", "row_idx"), "id")
    body = F.to_json(F.struct("id", "categoria", F.lit("Seguros").alias("produto"), "sentimento", "urgencia", F.concat(F.lit("resumo "), c("row_idx").cast("string")).alias("resumo")))
    return rows.select("id", "seq", F.when(c("row_idx") % 9 == 0, "sem json").otherwise(F.concat(F.lit("Segue: "), body, F.lit(" fim"))).alias("resposta"))


CLASSIF_SCHEMA = "id string, categoria string, produto string, sentimento string, urgencia string, resumo string, __bad string"


def extract_json(answer):
    """The answer from its first { to its last }, parsed; null with a reason in ``__bad`` where there is none or it is broken."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), CLASSIF_SCHEMA, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})


_ANSWERED = f"{ROWS}, answered AS (SELECT classif.*, complaints.row_idx, complaints.row_idx % 9 <> 0 AS tem FROM classif JOIN complaints USING (id))"


@query("Q_json_extract", f"{_ANSWERED} SELECT id, seq, CASE WHEN tem THEN categoria END AS categoria, CASE WHEN tem THEN 'resumo ' || row_idx END AS resumo, tem AS ok FROM answered")
def json_extract(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("j", extract_json(c("resposta")))
    return rows.select("id", "seq", "j.categoria", "j.resumo", (c("j").isNotNull() & c("j.__bad").isNull() & c("j.categoria").isNotNull()).alias("ok"))


def valid(j):
    """The enums and the length of the summary; other keys are ignored."""
    length = F.length(j["resumo"])
    checks = [j["categoria"].isin(fixed.CATEGORIES), j["produto"].isin(fixed.PRODUCTS), j["sentimento"].isin(fixed.SENTIMENTS), j["urgencia"].isin(fixed.URGENCIES), (length >= 1) & (length <= fixed.SUMMARY_MOST)]
    return F.coalesce(F.array_min(F.array(*[F.coalesce(x, F.lit(False)) for x in checks])), F.lit(False))


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN (" + ", ".join(map(sql_lit, values)) + ")"


@query("Q_validate_classif", f"{_ANSWERED} SELECT id, seq, tem AND {_in('categoria', fixed.CATEGORIES)} AND {_in('sentimento', fixed.SENTIMENTS)} AND {_in('urgencia', fixed.URGENCIES)} AS valida FROM answered")
def validate_classif(spark, sf_dir):
    return answers(spark, sf_dir).select("id", "seq", valid(extract_json(c("resposta"))).alias("valida"))
