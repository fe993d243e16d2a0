"""Rules that exist as a specification only: alert kinds, product inference, regulatory mention, personal data kinds, final action, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions.text import sql_lit
from ouvidor.operators.complaints import RESULT, guarded, results
from ouvidor.plans.registry import query
from ouvidor.sources.tables import COMPLAINTS, complaints, table

c = F.col
#: Kind of manipulation by the patterns that show it.
ALERTS = {
    "extracao_prompt": fixed.SUSPICIOUS[:6], "jailbreak_roleplay": fixed.SUSPICIOUS[6:10], "impersonation_autoridade": fixed.SUSPICIOUS[10:13],
    "exfiltracao_dados": fixed.SUSPICIOUS[13:19], "coercao_ameaca": fixed.SUSPICIOUS[19:], "pentest_falso": [r"pentest|teste\s+autorizado|equipe\s+de\s+seguran[cç]a"],
}
_KIND_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(texto, ''), {sql_lit('|'.join(p))}, 'i') THEN '{k}' END" for k, p in ALERTS.items()) + "], lambda k: k IS NOT NULL)"


@query("Q_spec_alert", f"WITH {COMPLAINTS}, k AS (SELECT id, {_KIND_SQL} AS k FROM complaints) SELECT id, len(k) > 0 AS alerta_seguranca, k[1] AS tipo, CASE WHEN len(k) > 1 THEN 'alta' WHEN len(k) = 1 THEN 'media' ELSE 'baixa' END AS confianca FROM k")
def alert(spark, sf_dir):
    """Alert of every text: whether it tries to manipulate, the first kind that it shows, and the confidence: high with two kinds, middling with one."""
    found = F.array_compact(F.array(*[F.when(c("texto").rlike("(?iuUd)" + "|".join(p)), k) for k, p in ALERTS.items()]))
    rows = complaints(spark, sf_dir).select("id", F.explode(F.array(found)).alias("k"))  # out of a generator, so that each pattern runs once
    sure = F.when(F.size("k") > 1, "alta").when(F.size("k") == 1, "media").otherwise("baixa")
    return rows.select("id", (F.size("k") > 0).alias("alerta_seguranca"), F.get("k", F.lit(0)).alias("tipo"), sure.alias("confianca"))


@query("Q_spec_enums", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in fixed.SPEC_ENUMS.items() for v in vs) + ") AS t(campo, valor)")
def spec_enums(spark, sf_dir):
    """Allowed values of the specified classification, which are not those of the running one."""
    values = F.explode(F.create_map(*[x for k, vs in fixed.SPEC_ENUMS.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])).alias("campo", "vs")
    return spark.range(1).select(values).select("campo", F.explode("vs").alias("valor"))


PRODUCT_WORDS = [("Cartão de Crédito", "cartão|fatura"), ("Conta Corrente", "conta |agência"), ("Seguros", "seguro|apólice")]
_PRODUCT_SQL = "coalesce(produto_original, CASE " + " ".join(f"WHEN regexp_matches(lower(texto), '{w}') THEN {sql_lit(p)}" for p, w in PRODUCT_WORDS) + " END, 'Não Identificado')"


@query("Q_spec_product", f"WITH {RESULT} SELECT id, {_PRODUCT_SQL} AS produto_inferido FROM result")
def product(spark, sf_dir):
    guess = F.coalesce(*[F.when(F.lower("texto").rlike(w), p) for p, w in PRODUCT_WORDS])
    return results(spark, sf_dir).select("id", F.coalesce("produto_original", guess, F.lit("Não Identificado")).alias("produto_inferido"))


@query("Q_spec_regulatory", f"WITH {RESULT} SELECT id, coalesce(regexp_matches(texto, 'banco central|bacen|procon|reclame aqui|processo judicial', 'i'), false) OR canal IN ('Banco Central', 'Procon') AS risco_regulatorio FROM result")
def regulatory(spark, sf_dir):
    said = F.coalesce(c("texto").rlike("(?iuUd)banco central|bacen|procon|reclame aqui|processo judicial"), F.lit(False))
    return complaints(spark, sf_dir).select("id", (said | c("canal").isin(fixed.REGULATORS)).alias("risco_regulatorio"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NAME = r"([Mm]eu nome é|[Mm]e chamo|[Ss]ou [oa]) [A-ZÁÉÍÓÚÂÊÔÃÕÇ][a-zà-ÿ]+( [A-ZÁÉÍÓÚÂÊÔÃÕÇ][a-zà-ÿ]+)+"
ADDRESS = r"(Rua|Avenida|Av\.|Travessa|Alameda|Praça) [A-ZÁÉÍÓÚÂÊÔÃÕÇ][a-zà-ÿ]+( [A-Za-zÀ-ÿ]+){0,5}(, ?(nº ?)?[0-9]{1,5})?"
_KINDS = [("cpf", fixed.CPF, ""), ("conta", fixed.ACCOUNT, "i"), ("telefone", fixed.PHONE, ""), ("email", EMAIL, ""), ("nome", NAME, ""), ("endereco", ADDRESS, "")]
#: In this order, with the mark that takes the place of what is found; of a name, what leads to it stays.
_REDACTED = [(EMAIL, "[EMAIL]", ""), (NAME, r"\1 [NOME]", ""), (ADDRESS, "[ENDERECO]", ""), (fixed.CPF, "[CPF]", ""), (fixed.ACCOUNT, "[CONTA]", "i"), (fixed.PHONE, "[TELEFONE]", "")]
_KINDS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(texto, {sql_lit(p)}, '{f or 'c'}') THEN '{k}' END" for k, p, f in _KINDS) + ")"


@query("Q_spec_pii_kinds", f"WITH {RESULT} SELECT id, {_KINDS_SQL} AS tipos FROM result")
def pii_kinds(spark, sf_dir):
    found = [F.when(c("texto").rlike(f"(?{f}uUd)" + p), k) for k, p, f in _KINDS]
    return complaints(spark, sf_dir).select("id", F.concat_ws(",", *found).alias("tipos"))


@query("Q_spec_redact", f"WITH {COMPLAINTS} SELECT id, {reduce(lambda t, r: f"regexp_replace({t}, {sql_lit(r[0])}, {sql_lit(r[1])}, 'g{r[2]}')", _REDACTED, 'texto')} AS texto_redigido FROM complaints")
def redact(spark, sf_dir):
    """Texts with a mark in place of each personal datum; money stays."""
    text = reduce(lambda t, r: F.regexp_replace(t, f"(?{r[2]}uUd)" + r[0], r[1].replace("\\1", "$1")), _REDACTED, c("texto"))
    return complaints(spark, sf_dir).select("id", text.alias("texto_redigido"))


@query("Q_spec_outcome", f"WITH {RESULT} SELECT id, CASE WHEN motivo_bloqueio LIKE 'erro%' THEN 'revisao_manual' WHEN bloqueado THEN 'bloquear' WHEN risco_nivel = 'Crítico' THEN 'escalar_compliance' WHEN risco_nivel = 'Alto' THEN 'analista_dedicado' WHEN produto_original IS NULL THEN 'pedir_dados' ELSE 'fila_padrao' END AS desfecho FROM result")
def outcome(spark, sf_dir):
    first = F.when(F.startswith("motivo_bloqueio", F.lit("erro")), "revisao_manual").when(c("bloqueado"), "bloquear").when(c("risco_nivel") == "Crítico", "escalar_compliance").when(c("risco_nivel") == "Alto", "analista_dedicado").when(c("produto_original").isNull(), "pedir_dados").otherwise("fila_padrao")
    return results(spark, sf_dir).select("id", first.alias("desfecho"))


@query("Q_spec_confusion", f"WITH {RESULT} SELECT toxic AS esperado, CAST(bloqueado AS INTEGER) AS obtido, count(*) AS n FROM result JOIN labels ON row_idx = doc_id GROUP BY ALL")
def confusion(spark, sf_dir):
    """Confusion matrix of the guardrail against the labels, from which accuracy and F1 follow."""
    rows = guarded(complaints(spark, sf_dir)).select("row_idx", c("bloqueado").cast("int").alias("obtido"))
    return rows.join(table(spark, sf_dir, "labels"), c("row_idx") == c("doc_id")).groupBy(c("toxic").alias("esperado"), "obtido").agg(F.count("*").alias("n"))


_CELLS = "SELECT count(*) FILTER (WHERE toxic = 1 AND bloqueado) AS vp, count(*) FILTER (WHERE toxic = 0 AND bloqueado) AS fp, count(*) FILTER (WHERE toxic = 1 AND NOT bloqueado) AS fn, count(*) AS n FROM result JOIN labels ON row_idx = doc_id"


@query("Q_spec_metrics", f"WITH {RESULT}, m AS ({_CELLS}) SELECT n, round((n - fp - fn) * 1.0 / n, 6) AS acuracia, round(vp * 1.0 / nullif(vp + fp, 0), 6) AS precisao, round(vp * 1.0 / nullif(vp + fn, 0), 6) AS revocacao, round(2.0 * vp / nullif(2 * vp + fp + fn, 0), 6) AS f1 FROM m")
def metrics(spark, sf_dir):
    """Accuracy, precision, recall and F1 of the guardrail against the labels; null where nothing divides."""
    rows = guarded(complaints(spark, sf_dir)).select("row_idx", "bloqueado").join(table(spark, sf_dir, "labels"), c("row_idx") == c("doc_id"))
    hit = lambda toxic, blocked: F.count_if((c("toxic") == toxic) & (c("bloqueado") == blocked))
    m = rows.agg(hit(1, True).alias("vp"), hit(0, True).alias("fp"), hit(1, False).alias("fn"), F.count("*").alias("n"))
    share = lambda a, b: F.round(F.try_divide(a * F.lit(1.0), b * F.lit(1.0)), 6)
    return m.select("n", share(c("n") - c("fp") - c("fn"), c("n")).alias("acuracia"), share(c("vp"), c("vp") + c("fp")).alias("precisao"), share(c("vp"), c("vp") + c("fn")).alias("revocacao"), share(2 * c("vp"), 2 * c("vp") + c("fp") + c("fn")).alias("f1"))
