"""What the dashboard of a run shows, from its result records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.operators.complaints import RESULT, results
from ouvidor.plans.registry import query

c = F.col
FAILED = f"coalesce(motivo_bloqueio LIKE '{fixed.ERROR_PREFIX}%', false)"
KPI_SQL = f"""SELECT count(*) AS total, count(categoria) AS classificadas, count(*) FILTER (WHERE bloqueado AND NOT {FAILED}) AS bloqueadas,
 count(*) FILTER (WHERE {FAILED}) AS falhas, count(*) FILTER (WHERE NOT bloqueado AND risco_nivel IN ('Alto', 'Crítico')) AS criticas FROM result"""


def failed():
    return F.coalesce(F.startswith("motivo_bloqueio", F.lit(fixed.ERROR_PREFIX)), F.lit(False))


def critical():
    return ~c("bloqueado") & c("risco_nivel").isin("Alto", "Crítico")


def _kpis(df):
    return df.agg(F.count("*").alias("total"), F.count("categoria").alias("classificadas"), F.count_if(c("bloqueado") & ~failed()).alias("bloqueadas"), F.count_if(failed()).alias("falhas"), F.count_if(critical()).alias("criticas"))


@query("Q_dash_kpis", f"WITH {RESULT} {KPI_SQL}")
def kpis(spark, sf_dir):
    return _kpis(results(spark, sf_dir))


@query("Q_run_totals", f"WITH {RESULT} SELECT count(*) AS total, count(*) FILTER (WHERE bloqueado) AS bloqueados, count(*) FILTER (WHERE {FAILED}) AS falhas_pipeline, count(*) FILTER (WHERE risco_nivel IN ('Alto', 'Crítico')) AS criticos FROM result")
def run_totals(spark, sf_dir):
    return results(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("bloqueado").alias("bloqueados"), F.count_if(failed()).alias("falhas_pipeline"), F.count_if(c("risco_nivel").isin("Alto", "Crítico")).alias("criticos"))


@query("Q_critical_list", f"WITH {RESULT} SELECT id, canal, risco_nivel, risco_justificativa FROM result WHERE NOT bloqueado AND risco_nivel IN ('Alto', 'Crítico')")
def critical_list(spark, sf_dir):
    return results(spark, sf_dir).where(critical()).select("id", "canal", "risco_nivel", "risco_justificativa")


@query("Q_blocked_list", f"WITH {RESULT} SELECT id, canal, motivo_bloqueio FROM result WHERE bloqueado AND NOT {FAILED}")
def blocked_list(spark, sf_dir):
    return results(spark, sf_dir).where(c("bloqueado") & ~failed()).select("id", "canal", "motivo_bloqueio")


@query("Q_failures_list", f"WITH {RESULT} SELECT id, motivo_bloqueio FROM result WHERE {FAILED}")
def failures_list(spark, sf_dir):
    return results(spark, sf_dir).where(failed()).select("id", "motivo_bloqueio")


PANELS = {"categoria": "categoria", "produto": "produto", "sentimento": "sentimento", "urgencia": "urgencia", "risco": "risco_nivel"}


def distribution(df, column: str):
    """Counts of a panel, the most frequent first, ties by first appearance."""
    rows = df.where(c("categoria").isNotNull() & c(column).isNotNull())
    return rows.groupBy(c(column).alias("valor")).agg(F.count("*").alias("qtd"), F.min("row_idx").alias("primeira")).orderBy(F.desc("qtd"), "primeira")


for _panel, _column in PANELS.items():
    query(f"Q_dash_dist_{_panel}", f"WITH {RESULT} SELECT {_column} AS valor, count(*) AS qtd, min(row_idx) AS primeira FROM result WHERE categoria IS NOT NULL AND {_column} IS NOT NULL GROUP BY {_column}")(
        lambda spark, sf_dir, column=_column: distribution(results(spark, sf_dir), column)
    )

_ALL = " UNION ALL ".join(f"SELECT '{p}' AS painel, {col} AS valor, row_idx FROM result WHERE categoria IS NOT NULL AND {col} IS NOT NULL" for p, col in PANELS.items())


def all_panels(df):
    """All panels in one pass: each row gives its value of each panel, combined before the one shuffle."""
    long = df.select("row_idx", F.explode(F.array(*[F.struct(F.lit(p).alias("painel"), c(col).alias("valor")) for p, col in PANELS.items()])).alias("x"))
    return long.select("row_idx", "x.*").where("valor is not null").groupBy("painel", "valor").agg(F.count("*").alias("qtd"), F.min("row_idx").alias("primeira"))


@query("Q_dash_dist_all", f"WITH {RESULT}, long AS ({_ALL}) SELECT painel, valor, count(*) AS qtd, min(row_idx) AS primeira FROM long GROUP BY painel, valor")
def dist_all(spark, sf_dir):
    return all_panels(results(spark, sf_dir))


@query("Q_dash_share", f"WITH {RESULT}, long AS ({_ALL}), n AS (SELECT count(categoria) AS n FROM result) SELECT painel, valor, count(*) AS qtd, round(CASE WHEN any_value(n) > 0 THEN count(*) * 100.0 / any_value(n) ELSE 0 END, 6) AS pct FROM long, n GROUP BY painel, valor")
def share(spark, sf_dir):
    """Bars in percent of the classified rows. Every classified row has a category, so that panel's sum is their number."""
    from pyspark.sql import Window

    total = F.sum(F.when(c("painel") == "categoria", c("qtd"))).over(Window.partitionBy())  # over a row for each value
    return all_panels(results(spark, sf_dir)).select("painel", "valor", "qtd", F.round(F.when(total > 0, c("qtd") * 100.0 / total).otherwise(0.0), 6).alias("pct"))


def render(df) -> str:
    """A small HTML page of the panels; only aggregated rows come to the driver."""
    from html import escape

    k = _kpis(df).first()
    cards = "".join(f"<li>{escape(name)}: {k[name]}</li>" for name in k.asDict())
    bars = "".join(f"<tr><td>{escape(r['painel'])}</td><td>{escape(r['valor'])}</td><td>{r['qtd']}</td></tr>" for r in all_panels(df).orderBy("painel", F.desc("qtd"), "primeira").collect())
    return f"<html><body><ul>{cards}</ul><table>{bars}</table></body></html>"


def report(df) -> str:
    """Console report of a run: totals, then each panel's values with their numbers."""
    k = _kpis(df).first().asDict()
    lines = [f"{name}: {value}" for name, value in k.items()]
    for r in all_panels(df).orderBy("painel", F.desc("qtd"), "primeira").collect():
        lines.append(f"  {r['painel']:<12} {r['valor']:<24} {r['qtd']}")
    return "\n".join(lines)


def render_log(log, top: int = 20) -> str:
    """HTML page of an execution log (the columns of exec_log): cards, actions, latency, tokens by agent or why there are none, slowest and
    most expensive calls, errors by time. Every table is an aggregate or a stated top."""
    from html import escape

    from ouvidor.operators import logs

    rows = log.where(logs.NOT_SUMMARY)
    total, errors = log.agg(F.count("*"), F.count_if(c("status") == "erro")).first()
    shown = lambda x: "—" if x is None else escape(f"{x:.1f}" if isinstance(x, float) else str(x))

    def table_(title: str, frame) -> str:
        found = frame.collect()
        head = "".join(f"<th>{escape(n)}</th>" for n in frame.columns)
        body = "".join("<tr>" + "".join(f"<td>{shown(x)}</td>" for x in r) + "</tr>" for r in found)
        return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>" if found else ""

    timed = rows.where("duracao_ms is not null")
    agents = logs.agents(log).drop("preco_indisponivel").orderBy(F.desc("tokens_total"))
    calls = logs.model_calls(log)
    parts = [
        f"<ul><li>linhas: {total}</li><li>erros: {errors}</li><li>taxa de erro: {errors * 100 / total if total else 0:.1f} %</li></ul>",
        table_("Ações", log.groupBy("acao").agg(F.count("*").alias("qtd")).orderBy(F.desc("qtd"), "acao")),
        table_("Latência", timed.groupBy("acao").agg(F.round(F.avg("duracao_ms"), 1).alias("media_ms"), F.round(F.max("duracao_ms"), 1).alias("max_ms"), F.count("*").alias("qtd")).orderBy(F.desc("media_ms"), "acao")),
        table_("Tokens por agente", agents),
        table_("Mais tokens", calls.select("line_no", "acao", "tokens_total").orderBy(F.desc("tokens_total"), "line_no").limit(top)),
        table_("Mais lentas", timed.select("line_no", "acao", "duracao_ms").orderBy(F.desc("duracao_ms"), "line_no").limit(top)),
        table_("Erros", log.where("status = 'erro'").select("timestamp", "acao", "erro").orderBy("timestamp").limit(top)),
    ]
    return "<html><body>" + "".join(parts) + "</body></html>"
