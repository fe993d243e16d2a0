"""The row pipeline: guardrail, route, triage, risk, sources, action, masks, result and trace, as one lazy DataFrame.

Only the sources need shuffles: the terms of a text meet those of the policy. Without them a row never leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions import text as tx
from ouvidor.operators import retrieval
from ouvidor.plans.registry import query
from ouvidor.sources.tables import COMPLAINTS, complaints

c = F.col
BLOCKED_TRACE = ["guardrail_entrada", "resposta_bloqueio"]
ACCEPTED_TRACE = ["guardrail_entrada", "agente_triagem", "agente_risco", "agente_relatorio", "guardrail_saida"]


def guarded(df: DataFrame) -> DataFrame:
    """+ bloqueado, motivo_bloqueio. A null text is a failure, not a block.

    The match comes out of a generator: filters on it stay above, so the regex runs once a row.
    """
    matched = df.select("*", F.explode(F.array(tx.suspicious_match(c("texto")))).alias("m"))
    return matched.withColumns({"motivo_bloqueio": tx.block_reason(c("texto"), c("m")), "bloqueado": F.coalesce(c("m") != "", F.lit(False))}).drop("m")


def _open(value: Column) -> Column:
    """A value of rows that are neither blocked nor failed."""
    return F.when(c("motivo_bloqueio").isNull(), value)


def processed(df: DataFrame, policy: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All stages offline: triage defaults unless ``df`` brings a ``classificacao`` struct, heuristic risk, action, output masks.

    ``policy`` is an index (weights, idf) that sources are retrieved from, for rows that don't bring theirs as ``fontes``.
    """
    offline = F.struct(*[F.lit(v).alias(k) for k, v in fixed.OFFLINE.items()])
    given = F.coalesce(c("classificacao"), offline) if "classificacao" in df.columns else offline
    rows = guarded(df).withColumn("classificacao", _open(given)).withColumn("gatilho", tx.risk_trigger(c("texto")))
    rows = rows.withColumns({"risco_nivel": _open(tx.risk_level(c("canal"), c("gatilho"))), "risco_justificativa": _open(tx.mask_output(tx.risk_reason(c("canal"), c("gatilho"))))})
    if policy is not None:
        rows = retrieval.with_sources(rows, *policy)
    fontes = _open(c("fontes")) if "fontes" in rows.columns else F.lit(None).cast("array<string>")
    act = tx.mask_output(tx.action(c("classificacao.urgencia"), c("risco_nivel"), fontes))
    return rows.withColumns({
        "classificacao": c("classificacao").withField("resumo", tx.mask_output(c("classificacao.resumo"))),
        "acao_recomendada": F.when(c("bloqueado"), fixed.BLOCK_ANSWER).otherwise(_open(act)),
        "politica_contexto_disponivel": F.coalesce(F.size(fontes) > 0, F.lit(False)),
        "logs": trace(),
    }).drop("gatilho")


def trace() -> Column:
    """The stages a row went through, as node_log structs; a failed row stops in the guardrail."""
    entry = lambda name: F.struct(F.lit(name).alias("agente"), F.substring("texto", 1, 80).alias("entrada_resumida"), F.substring(F.coalesce("motivo_bloqueio", "risco_nivel"), 1, 160).alias("saida_resumida"))
    stages = lambda names: F.array(*map(entry, names))
    return F.when(c("bloqueado"), stages(BLOCKED_TRACE)).when(c("motivo_bloqueio").isNotNull(), stages(BLOCKED_TRACE[:1])).otherwise(stages(ACCEPTED_TRACE))


RESULT = f"""{COMPLAINTS}, matched AS (SELECT *, {tx.SQL_MATCH} AS m, {tx.SQL_TRIGGER} AS gatilho FROM complaints),
reasoned AS (SELECT *, coalesce(m <> '', false) AS bloqueado, {tx.SQL_REASON} AS motivo_bloqueio FROM matched),
result AS (
  SELECT row_idx, id, canal, produto AS produto_original, status, texto, bloqueado, motivo_bloqueio,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.sql_lit(fixed.OFFLINE["categoria"])} END AS categoria,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.sql_lit(fixed.OFFLINE["produto"])} END AS produto,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.sql_lit(fixed.OFFLINE["sentimento"])} END AS sentimento,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.sql_lit(fixed.OFFLINE["urgencia"])} END AS urgencia,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.sql_lit(fixed.OFFLINE["resumo"])} END AS resumo,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.SQL_LEVEL} END AS risco_nivel,
         CASE WHEN motivo_bloqueio IS NULL THEN {tx.SQL_JUST} END AS risco_justificativa,
         CASE WHEN bloqueado THEN {tx.sql_lit(fixed.BLOCK_ANSWER)} WHEN motivo_bloqueio IS NULL THEN {tx.sql_action(tx.sql_lit("Baixa"), "(" + tx.SQL_LEVEL + ")")} END AS acao_recomendada,
         CASE WHEN bloqueado THEN {len(BLOCKED_TRACE)} WHEN motivo_bloqueio IS NOT NULL THEN 1 ELSE {len(ACCEPTED_TRACE)} END AS n_logs
  FROM reasoned)"""


def results(spark, sf_dir, sources: bool = False) -> DataFrame:
    """The result record of every complaint, classification flattened; with ``sources`` from the policy if they are asked for."""
    done = processed(complaints(spark, sf_dir), retrieval.cached_index(spark, sf_dir) if sources else None)
    return done.select("row_idx", "id", "canal", c("produto").alias("produto_original"), "status", "texto", "bloqueado", "motivo_bloqueio", *[c(f"classificacao.{k}").alias(k) for k in fixed.OFFLINE], "risco_nivel", "risco_justificativa", "acao_recomendada", "politica_contexto_disponivel", "logs")


@query("Q_project_state", f"WITH {COMPLAINTS} SELECT id, canal, produto AS produto_original, status, texto AS texto_original, false AS usar_llm FROM complaints")
def project_state(spark, sf_dir):
    return complaints(spark, sf_dir).select("id", "canal", c("produto").alias("produto_original"), "status", c("texto").alias("texto_original"), F.lit(False).alias("usar_llm"))


@query("Q_limit_scan", f"WITH {COMPLAINTS} SELECT id, canal FROM complaints ORDER BY row_idx LIMIT 20")
def limit_scan(spark, sf_dir):
    """The first rows in input order, as a run with a limit takes them (0: all)."""
    return head(complaints(spark, sf_dir), 20).select("id", "canal")


def head(df: DataFrame, limit: int | None) -> DataFrame:
    return df.orderBy("row_idx").limit(limit) if limit else df


@query("Q_guardrail_flag", f"WITH {RESULT} SELECT id, bloqueado FROM result")
def guardrail_flag(spark, sf_dir):
    return guarded(complaints(spark, sf_dir)).select("id", "bloqueado")


@query("Q_guardrail_reason", f"WITH {RESULT} SELECT id, motivo_bloqueio FROM result WHERE motivo_bloqueio IS NOT NULL")
def guardrail_reason(spark, sf_dir):
    return guarded(complaints(spark, sf_dir)).where("motivo_bloqueio is not null").select("id", "motivo_bloqueio")


@query("Q_route", f"WITH {RESULT} SELECT id, CASE WHEN bloqueado THEN 'resposta_bloqueio' WHEN motivo_bloqueio IS NOT NULL THEN 'erro' ELSE 'agente_triagem' END AS rota FROM result")
def route(spark, sf_dir):
    rota = F.when(c("bloqueado"), "resposta_bloqueio").when(c("motivo_bloqueio").isNotNull(), "erro").otherwise("agente_triagem")
    return guarded(complaints(spark, sf_dir)).select("id", rota.alias("rota"))


@query("Q_triage_default", f"WITH {RESULT} SELECT id, categoria, produto, sentimento, urgencia, resumo FROM result WHERE motivo_bloqueio IS NULL")
def triage_default(spark, sf_dir):
    return results(spark, sf_dir).where("motivo_bloqueio is null").select("id", *fixed.OFFLINE)


@query("Q_risk_heuristic", f"WITH {RESULT} SELECT id, {tx.SQL_LEVEL} AS nivel, {tx.SQL_JUST} AS justificativa FROM reasoned")
def risk_heuristic(spark, sf_dir):
    rows = complaints(spark, sf_dir).withColumn("g", tx.risk_trigger(c("texto")))
    return rows.select("id", tx.risk_level(c("canal"), c("g")).alias("nivel"), tx.risk_reason(c("canal"), c("g")).alias("justificativa"))


@query("Q_action", f"WITH {RESULT} SELECT id, acao_recomendada FROM result")
def recommended_action(spark, sf_dir):
    return results(spark, sf_dir).select("id", "acao_recomendada")


@query("Q_mask_pii", f"WITH {COMPLAINTS} SELECT id, {tx.sql_mask_personal('texto')} AS texto FROM complaints")
def mask_pii(spark, sf_dir):
    return complaints(spark, sf_dir).select("id", tx.mask_personal(c("texto")).alias("texto"))


@query("Q_mask_profanity", f"WITH {COMPLAINTS} SELECT id, {tx.sql_mask_profanity('texto')} AS texto FROM complaints")
def mask_profanity(spark, sf_dir):
    return complaints(spark, sf_dir).select("id", tx.mask_profanity(c("texto")).alias("texto"))


@query("Q_mask_output", f"WITH {COMPLAINTS} SELECT id, {tx.sql_mask_profanity(tx.sql_mask_personal('texto'))} AS texto FROM complaints")
def mask_output(spark, sf_dir):
    return complaints(spark, sf_dir).select("id", tx.mask_output(c("texto")).alias("texto"))


_OFFLINE_SAID = "{" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.OFFLINE.items()) + "}"
SOURCED = f"""WITH {RESULT}, {retrieval.TFIDF},
qw AS (SELECT row_idx AS q, regexp_extract_all(lower(texto || ' ' || canal || ' ' || {tx.sql_lit(_OFFLINE_SAID)}), '{retrieval.TOKEN}') AS t FROM result WHERE motivo_bloqueio IS NULL),
{retrieval.RANKED},
found AS (SELECT q AS row_idx, string_agg('POL-' || item_id, ', ' ORDER BY rank) AS fontes FROM topk WHERE rank <= {fixed.TOP_K} AND score >= {fixed.RELEVANT} GROUP BY q),
sourced AS (SELECT result.* EXCLUDE (acao_recomendada), fontes, CASE WHEN bloqueado THEN acao_recomendada WHEN motivo_bloqueio IS NULL THEN {tx.sql_action(tx.sql_lit("Baixa"), "risco_nivel", "fontes")} END AS acao_recomendada
  FROM result LEFT JOIN found USING (row_idx))"""


@query("Q_action_sources", f"{SOURCED} SELECT id, acao_recomendada, coalesce(fontes, '') AS fontes FROM sourced")
def action_sources(spark, sf_dir):
    """Recommended actions with the policy chunks that they rest on."""
    done = processed(complaints(spark, sf_dir), retrieval.cached_index(spark, sf_dir))
    return done.select("id", "acao_recomendada", F.array_join("fontes", ", ").alias("fontes"))


@query("Q_result", f"{SOURCED} SELECT id, canal, produto_original, status, bloqueado, motivo_bloqueio, categoria, produto, sentimento, urgencia, resumo, risco_nivel, risco_justificativa, acao_recomendada, fontes IS NOT NULL AS politica_contexto_disponivel, n_logs FROM sourced")
def result(spark, sf_dir):
    return results(spark, sf_dir, sources=True).withColumn("n_logs", F.size("logs")).drop("row_idx", "texto", "logs")


@query("Q_trace", f"WITH {RESULT}, t AS (SELECT id, unnest(CASE n_logs WHEN 1 THEN {BLOCKED_TRACE[:1]} WHEN 2 THEN {BLOCKED_TRACE} ELSE {ACCEPTED_TRACE} END) AS agente FROM result) SELECT agente, count(*) AS n FROM t GROUP BY agente")
def trace_counts(spark, sf_dir):
    """How many rows each stage saw."""
    names = lambda x: F.array(*map(F.lit, x))
    rows = guarded(complaints(spark, sf_dir))
    path = F.when(c("bloqueado"), names(BLOCKED_TRACE)).when(c("motivo_bloqueio").isNotNull(), names(BLOCKED_TRACE[:1])).otherwise(names(ACCEPTED_TRACE))
    return rows.select(F.explode(path).alias("agente")).groupBy("agente").agg(F.count("*").alias("n"))
