"""Analytics over execution logs: status, latency, tokens, cost, history, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions.text import format_cost, sql_lit
from ouvidor.plans.registry import query
from ouvidor.sources.tables import EXEC_LOG, exec_log

c = F.col
LOG = f"WITH {EXEC_LOG}"
NOT_SUMMARY = "coalesce(tipo, 'acao') <> 'resumo'"
AGENT_SQL = "CASE acao " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MODEL_ACTIONS.items()) + " END"
_KEYS = ", ".join(f"({i}, '{k}', {a}, {b})" for i, (k, _, a, b) in enumerate(fixed.PRICES))
PRICED = f"""{LOG}, prices(ord, key, price_in, price_out) AS (VALUES {_KEYS}),
calls AS (SELECT *, {AGENT_SQL} AS agente FROM exec_log WHERE tokens_total IS NOT NULL AND {AGENT_SQL} IS NOT NULL),
priced AS (
  SELECT calls.*, p.price_in, p.price_out, tokens_entrada / 1e6 * p.price_in + tokens_saida / 1e6 * p.price_out AS custo
  FROM calls LEFT JOIN prices p ON contains(lower(modelo), p.key) AND p.ord = (SELECT min(q.ord) FROM prices q WHERE contains(lower(calls.modelo), q.key)))"""


def model_calls(log: DataFrame) -> DataFrame:
    """Model calls with a token count, by agent."""
    agents = F.create_map(*[F.lit(x) for kv in fixed.MODEL_ACTIONS.items() for x in kv])
    return log.where(c("tokens_total").isNotNull() & c("acao").isin(*fixed.MODEL_ACTIONS)).withColumn("agente", F.try_element_at(agents, c("acao")))


def priced(log: DataFrame) -> DataFrame:
    """+ price and cost. The four prices are matched by what the name contains, first in order; written as a map over
    the names in use, so no row is paired with every price."""
    calls = model_calls(log)
    lower = F.lower("modelo")
    entry = F.coalesce(*[F.when(F.contains(lower, F.lit(key)), F.struct(F.lit(float(a)).alias("price_in"), F.lit(float(b)).alias("price_out"))) for key, _, a, b in fixed.PRICES])
    rows = calls.withColumn("p", entry).select("*", "p.price_in", "p.price_out").drop("p")
    return rows.withColumn("custo", c("tokens_entrada") / 1e6 * c("price_in") + c("tokens_saida") / 1e6 * c("price_out"))


@query("Q_log_error_rate", f"{LOG} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'erro') AS erros, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE status = 'erro') * 100.0 / count(*) ELSE 0 END, 6) AS taxa FROM exec_log")
def error_rate(spark, sf_dir):
    erros = F.count_if(c("status") == "erro")
    return exec_log(spark, sf_dir).agg(F.count("*").alias("total"), erros.alias("erros"), F.round(F.when(F.count("*") > 0, erros * 100.0 / F.count("*")).otherwise(0.0), 6).alias("taxa"))


@query("Q_log_by_action", f"{LOG} SELECT acao, count(*) AS qtd, min(line_no) AS primeira FROM exec_log GROUP BY acao")
def by_action(spark, sf_dir):
    return exec_log(spark, sf_dir).groupBy("acao").agg(F.count("*").alias("qtd"), F.min("line_no").alias("primeira")).orderBy(F.desc("qtd"), "primeira")


@query("Q_latency_by_action", f"{LOG} SELECT acao, round(avg(duracao_ms), 1) AS media_ms, round(max(duracao_ms), 1) AS max_ms, count(duracao_ms) AS qtd FROM exec_log WHERE {NOT_SUMMARY} AND duracao_ms IS NOT NULL GROUP BY acao")
def latency(spark, sf_dir):
    rows = exec_log(spark, sf_dir).where(f"{NOT_SUMMARY} and duracao_ms is not null")
    return rows.groupBy("acao").agg(F.round(F.avg("duracao_ms"), 1).alias("media_ms"), F.round(F.max("duracao_ms"), 1).alias("max_ms"), F.count("duracao_ms").alias("qtd")).orderBy(F.desc("media_ms"), "acao")


_AGENTS = f"""{PRICED}, agents AS (
  SELECT agente, count(*) AS chamadas, CAST(sum(tokens_entrada) AS BIGINT) AS tokens_entrada, CAST(sum(tokens_saida) AS BIGINT) AS tokens_saida, CAST(sum(tokens_total) AS BIGINT) AS tokens_total,
         round(CASE WHEN bool_or(custo IS NULL) THEN NULL ELSE sum(custo) END, 6) AS custo_brl, bool_or(custo IS NULL) AS preco_indisponivel,
         coalesce(string_agg(DISTINCT modelo, ', ' ORDER BY modelo), '—') AS modelos
  FROM priced GROUP BY agente)"""


def agents(log: DataFrame) -> DataFrame:
    missing = F.bool_or(c("custo").isNull())
    return priced(log).groupBy("agente").agg(
        F.count("*").alias("chamadas"), *[F.sum(t).alias(t) for t in ("tokens_entrada", "tokens_saida", "tokens_total")],
        F.round(F.when(missing, None).otherwise(F.sum("custo")), 6).alias("custo_brl"), missing.alias("preco_indisponivel"),
        F.array_join(F.array_sort(F.collect_set("modelo")), ", ").alias("m"),
    ).withColumn("modelos", F.when(c("m") == "", "—").otherwise(c("m"))).drop("m")


@query("Q_tokens_by_agent", f"{_AGENTS} SELECT agente, chamadas, tokens_entrada, tokens_saida, tokens_total, custo_brl, preco_indisponivel, round(tokens_total * 1.0 / chamadas, 6) AS media_tokens_chamada FROM agents")
def tokens_by_agent(spark, sf_dir):
    rows = agents(exec_log(spark, sf_dir)).drop("modelos")
    return rows.withColumn("media_tokens_chamada", F.round(c("tokens_total") * 1.0 / c("chamadas"), 6)).orderBy(F.desc("tokens_total"))


@query("Q_models_by_agent", f"{_AGENTS} SELECT agente, modelos FROM agents")
def models_by_agent(spark, sf_dir):
    return agents(exec_log(spark, sf_dir)).select("agente", "modelos")


@query("Q_token_totals", f"{_AGENTS} SELECT CAST(sum(tokens_entrada) AS BIGINT) AS tokens_entrada, CAST(sum(tokens_saida) AS BIGINT) AS tokens_saida, CAST(sum(tokens_total) AS BIGINT) AS tokens_total, CAST(sum(chamadas) AS BIGINT) AS chamadas, bool_or(custo_brl IS NOT NULL) AS custo_disponivel, bool_or(custo_brl IS NULL) AS custo_parcial FROM agents")
def token_totals(spark, sf_dir):
    sums = [F.sum(t).alias(t) for t in ("tokens_entrada", "tokens_saida", "tokens_total", "chamadas")]
    return agents(exec_log(spark, sf_dir)).agg(*sums, F.bool_or(c("custo_brl").isNotNull()).alias("custo_disponivel"), F.bool_or(c("custo_brl").isNull()).alias("custo_parcial"))


@query("Q_price_theta", f"{PRICED} SELECT line_no, modelo, price_in, price_out, round(custo, 9) AS custo FROM priced")
def price_theta(spark, sf_dir):
    return priced(exec_log(spark, sf_dir)).select("line_no", "modelo", "price_in", "price_out", F.round("custo", 9).alias("custo"))


@query("Q_adhoc_cost", f"{LOG} SELECT execucao_id, CAST(sum(tokens_entrada) AS BIGINT) AS tokens_entrada, CAST(sum(tokens_saida) AS BIGINT) AS tokens_saida, round(sum(tokens_entrada) * {fixed.ADHOC_COST[0]} + sum(tokens_saida) * {fixed.ADHOC_COST[1]}, 6) AS custo FROM exec_log WHERE contains(lower(acao), 'bedrock') AND tokens_total IS NOT NULL GROUP BY execucao_id")
def adhoc_cost(spark, sf_dir):
    """Cost of each run at the flat prices per token of the history report, which are not those per million of the dashboard."""
    calls = exec_log(spark, sf_dir).where(F.contains(F.lower("acao"), F.lit("bedrock")) & c("tokens_total").isNotNull())
    sums = calls.groupBy("execucao_id").agg(F.sum("tokens_entrada").alias("tokens_entrada"), F.sum("tokens_saida").alias("tokens_saida"))
    return sums.withColumn("custo", F.round(c("tokens_entrada") * F.lit(fixed.ADHOC_COST[0]) + c("tokens_saida") * F.lit(fixed.ADHOC_COST[1]), 6))


@query("Q_cost_format", f"{PRICED} SELECT line_no, CASE WHEN custo <> 0 AND abs(custo) < 0.01 THEN printf('R$ %.4f', custo) ELSE printf('R$ %.2f', custo) END AS custo_fmt FROM (SELECT line_no, round(custo * 100, 2) AS custo FROM priced WHERE custo IS NOT NULL)")
def cost_format(spark, sf_dir):
    """Cost of a hundred such calls, as money."""
    rows = priced(exec_log(spark, sf_dir)).where("custo is not null").select("line_no", F.round(c("custo") * 100, 2).alias("custo"))
    return rows.select("line_no", format_cost(c("custo")).alias("custo_fmt"))


_SPREAD = f"""{PRICED}, ids AS (
  SELECT *, coalesce(reclamacoes_ids, CASE WHEN reclamacao_id IS NOT NULL THEN [reclamacao_id] ELSE [] END) AS alvo FROM priced),
spread AS (SELECT unnest(alvo) AS alvo_id, tokens_entrada / len(alvo) AS e, tokens_saida / len(alvo) AS s, tokens_total / len(alvo) AS t FROM ids WHERE len(alvo) > 0),
por_id AS (SELECT alvo_id AS reclamacao_id, count(*) AS chamadas, round(sum(e), 6) AS tokens_entrada, round(sum(s), 6) AS tokens_saida, round(sum(t), 6) AS tokens_total FROM spread GROUP BY alvo_id)"""


def by_complaint(log: DataFrame) -> DataFrame:
    """Tokens of a batch call are shared evenly by its ids; a call without any id counts nowhere."""
    single = F.when(c("reclamacao_id").isNotNull(), F.array("reclamacao_id"))
    ids = model_calls(log).withColumn("alvo", F.coalesce("reclamacoes_ids", single)).where("alvo is not null")
    each = ids.select(F.explode("alvo").alias("reclamacao_id"), *[(c(t) / F.size("alvo")).alias(t) for t in ("tokens_entrada", "tokens_saida", "tokens_total")])
    return each.groupBy("reclamacao_id").agg(F.count("*").alias("chamadas"), *[F.round(F.sum(t), 6).alias(t) for t in ("tokens_entrada", "tokens_saida", "tokens_total")])


@query("Q_tokens_by_complaint", f"{_SPREAD} SELECT * FROM por_id")
def tokens_by_complaint(spark, sf_dir):
    return by_complaint(exec_log(spark, sf_dir))


@query("Q_top20_tokens", f"{_SPREAD} SELECT * FROM por_id ORDER BY tokens_total DESC, reclamacao_id LIMIT 20")
def top20_tokens(spark, sf_dir):
    return by_complaint(exec_log(spark, sf_dir)).orderBy(F.desc("tokens_total"), "reclamacao_id").limit(20)


@query("Q_top20_slowest", f"{LOG} SELECT line_no, acao, duracao_ms FROM exec_log WHERE {NOT_SUMMARY} AND duracao_ms IS NOT NULL ORDER BY duracao_ms DESC, line_no LIMIT 20")
def top20_slowest(spark, sf_dir):
    return exec_log(spark, sf_dir).where(f"{NOT_SUMMARY} and duracao_ms is not null").orderBy(F.desc("duracao_ms"), "line_no").limit(20).select("line_no", "acao", "duracao_ms")


@query("Q_log_errors", f"{LOG} SELECT line_no, timestamp, acao, erro FROM exec_log WHERE status = 'erro'")
def log_errors(spark, sf_dir):
    return exec_log(spark, sf_dir).where(c("status") == "erro").select("line_no", "timestamp", "acao", "erro").orderBy("timestamp", "line_no")


@query("Q_log_summary", f"{LOG} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'erro') AS erros, arg_min(duracao_ms, line_no) FILTER (WHERE acao = 'execucao_cli_fim' AND duracao_ms IS NOT NULL) AS duracao_total_ms, min(execucao_id) AS primeira_execucao FROM exec_log")
def log_summary(spark, sf_dir):
    closing = (c("acao") == "execucao_cli_fim") & c("duracao_ms").isNotNull()
    return exec_log(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(c("status") == "erro").alias("erros"), F.min_by("duracao_ms", F.when(closing, c("line_no"))).alias("duracao_total_ms"), F.min("execucao_id").alias("primeira_execucao"))


_DIAG = " ".join(f"WHEN {w} THEN {sql_lit(d)}" for w, d in zip(["NOT usar_llm", "sso", "falha"], fixed.DIAGNOSES))
_DIAG_WHERE = "acao IN (" + ", ".join(f"'{a}'" for a in fixed.MODEL_ACTIONS) + ") AND tokens_total IS NOT NULL"


@query("Q_token_diagnostic", f"""{LOG}, runs AS (
  SELECT execucao_id, acao, coalesce(erro, '') AS erro, acao = 'erro_pipeline' AND status = 'erro' AS falhou, {_DIAG_WHERE} AS conta, user_llm FROM (SELECT *, line_no % 3 = 0 AS user_llm FROM exec_log)
), a AS (SELECT acao || '/' || execucao_id AS grupo, count(*) FILTER (WHERE conta) AS n, coalesce(bool_or(user_llm), false) AS usar_llm, bool_or(falhou AND contains(lower(erro), 'token from sso')) AS sso, bool_or(falhou) AS falha FROM runs GROUP BY 1)
SELECT grupo, CASE WHEN n > 0 THEN NULL {_DIAG} ELSE {sql_lit(fixed.DIAGNOSES[3])} END AS diagnostico FROM a""")
def token_diagnostic(spark, sf_dir):
    """Why a group of log lines shows no tokens: nothing to explain, no model, expired login, failures before, or unknown."""
    counts = c("acao").isin(*fixed.MODEL_ACTIONS) & c("tokens_total").isNotNull()
    rows = exec_log(spark, sf_dir).select(F.concat_ws("/", "acao", "execucao_id").alias("grupo"), counts.alias("conta"), (c("line_no") % 3 == 0).alias("usar_llm"), ((c("acao") == "erro_pipeline") & (c("status") == "erro")).alias("falhou"), "erro")
    return diagnose(rows)


def diagnose(rows: DataFrame) -> DataFrame:
    sso = c("falhou") & F.contains(F.lower(F.coalesce("erro", F.lit(""))), F.lit("token from sso"))
    a = rows.groupBy("grupo").agg(F.count_if("conta").alias("n"), F.bool_or("usar_llm").alias("usar_llm"), F.bool_or(sso).alias("sso"), F.bool_or("falhou").alias("falha"))
    d = fixed.DIAGNOSES
    return a.select("grupo", F.when(c("n") > 0, None).when(~c("usar_llm"), d[0]).when(c("sso"), d[1]).when(c("falha"), d[2]).otherwise(d[3]).alias("diagnostico"))


_HISTORY = f"""{LOG}, h AS (
  SELECT execucao_id, count(*) AS acoes, count(*) FILTER (WHERE status = 'erro') AS erros,
         CAST(coalesce(sum(tokens_entrada) FILTER (WHERE contains(lower(acao), 'bedrock')), 0) AS BIGINT) AS tokens_entrada,
         CAST(coalesce(sum(tokens_saida) FILTER (WHERE contains(lower(acao), 'bedrock')), 0) AS BIGINT) AS tokens_saida,
         max_by({{'t': total, 'b': bloqueados, 'd': duracao_ms}}, line_no) FILTER (WHERE tipo = 'resumo') AS r
  FROM exec_log GROUP BY execucao_id),
history AS (
  SELECT execucao_id, acoes, erros, tokens_entrada, tokens_saida, tokens_entrada + tokens_saida AS tokens_total, r.d / 1000 AS duracao_s, coalesce(r.t, 0) AS reclamacoes, coalesce(r.b, 0) AS bloqueados,
         round(erros * 100.0 / acoes, 6) AS taxa_erro, round(CASE WHEN coalesce(r.t, 0) > 0 THEN (r.t - r.b) * 100.0 / r.t ELSE 0 END, 6) AS taxa_sucesso,
         round(CASE WHEN r.d > 0 THEN coalesce(r.t, 0) / (r.d / 1000) ELSE 0 END, 6) AS throughput
  FROM h WHERE r.d IS NOT NULL)"""


def history(log: DataFrame) -> DataFrame:
    """One row a run; the last summary line gives its totals, runs without a duration in it drop out."""
    call = F.contains(F.lower("acao"), F.lit("bedrock"))
    tokens = lambda t: F.coalesce(F.sum(F.when(call, c(t))), F.lit(0)).alias(t)
    last = F.max_by(F.struct("total", "bloqueados", "duracao_ms"), F.when(c("tipo") == "resumo", c("line_no")))
    h = log.groupBy("execucao_id").agg(F.count("*").alias("acoes"), F.count_if(c("status") == "erro").alias("erros"), tokens("tokens_entrada"), tokens("tokens_saida"), last.alias("r")).where("r.duracao_ms is not null")
    total, seconds = F.coalesce("r.total", F.lit(0)), c("r.duracao_ms") / 1000
    return h.select(
        "execucao_id", "acoes", "erros", "tokens_entrada", "tokens_saida", (c("tokens_entrada") + c("tokens_saida")).alias("tokens_total"), seconds.alias("duracao_s"), total.alias("reclamacoes"), F.coalesce("r.bloqueados", F.lit(0)).alias("bloqueados"),
        F.round(c("erros") * 100.0 / c("acoes"), 6).alias("taxa_erro"), F.round(F.when(total > 0, (c("r.total") - c("r.bloqueados")) * 100.0 / c("r.total")).otherwise(0.0), 6).alias("taxa_sucesso"), F.round(F.when(seconds > 0, total / seconds).otherwise(0.0), 6).alias("throughput"),
    )


@query("Q_history", f"{_HISTORY} SELECT * FROM history")
def run_history(spark, sf_dir):
    return history(exec_log(spark, sf_dir))


@query("Q_history_last10", f"{_HISTORY} SELECT * FROM (SELECT * FROM history ORDER BY execucao_id DESC LIMIT 10) ORDER BY execucao_id")
def history_last10(spark, sf_dir):
    return history(exec_log(spark, sf_dir)).orderBy(F.desc("execucao_id")).limit(10).orderBy("execucao_id")


@query("Q_validate_by_model", f"{LOG} SELECT coalesce(modelo, 'unknown') AS modelo, count(*) AS chamadas, CAST(sum(coalesce(tokens_entrada, 0)) AS BIGINT) AS tokens_entrada, CAST(sum(coalesce(tokens_saida, 0)) AS BIGINT) AS tokens_saida FROM exec_log WHERE contains(lower(acao), 'bedrock') GROUP BY 1")
def validate_by_model(spark, sf_dir):
    rows = exec_log(spark, sf_dir).where(F.contains(F.lower("acao"), F.lit("bedrock")))
    return rows.groupBy(F.coalesce("modelo", F.lit("unknown")).alias("modelo")).agg(F.count("*").alias("chamadas"), *[F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in ("tokens_entrada", "tokens_saida")]).orderBy("modelo")


@query("Q_validate_by_action", f"{LOG} SELECT acao, count(*) AS qtd FROM exec_log GROUP BY acao")
def validate_by_action(spark, sf_dir):
    return exec_log(spark, sf_dir).groupBy("acao").agg(F.count("*").alias("qtd")).orderBy("acao")


@query("Q_token_percentiles", f"{LOG} SELECT acao, count(*) AS n, round(avg(tokens_saida), 6) AS media, round(quantile_cont(tokens_saida, 0.9), 6) AS p90, max(tokens_saida) AS maximo FROM exec_log WHERE {_DIAG_WHERE} GROUP BY acao")
def token_percentiles(spark, sf_dir):
    rows = model_calls(exec_log(spark, sf_dir))
    return rows.groupBy("acao").agg(F.count("*").alias("n"), F.round(F.avg("tokens_saida"), 6).alias("media"), F.round(F.percentile("tokens_saida", 0.9), 6).alias("p90"), F.max("tokens_saida").alias("maximo"))


@query("Q_progress_eta", f"""{LOG}, w AS (
  SELECT line_no, execucao_id, count(*) OVER p AS feitas, count(*) OVER t AS total, count(duracao_ms) OVER p AS n, coalesce(sum(CAST(round(duracao_ms * 100) AS BIGINT)) OVER p, 0) AS soma FROM exec_log
  WHERE {NOT_SUMMARY} WINDOW p AS (PARTITION BY execucao_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), t AS (PARTITION BY execucao_id))
SELECT line_no, round(feitas * 100.0 / total, 6) AS pct, CAST(CASE WHEN n > 0 THEN soma * (total - feitas) // n ELSE 0 END AS BIGINT) AS eta_centesimos FROM w""")
def progress_eta(spark, sf_dir):
    """Progress in percent and the time to the end of the run (in hundredths of a ms) at the mean so far, after every line."""
    rows = exec_log(spark, sf_dir).where(NOT_SUMMARY).withColumn("cents", F.round(c("duracao_ms") * 100).cast("long"))
    whole = Window.partitionBy("execucao_id")
    far = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    w = rows.select("line_no", F.count("*").over(far).alias("feitas"), F.count("*").over(whole).alias("total"), F.count("cents").over(far).alias("n"), F.coalesce(F.sum("cents").over(far), F.lit(0)).alias("soma"))
    return w.select("line_no", F.round(c("feitas") * 100.0 / c("total"), 6).alias("pct"), F.expr("case when n > 0 then soma * (total - feitas) div n else 0L end").alias("eta_centesimos"))
