"""Single model calls, clients and limits, runs, PDF pages with a stub, sinks, pages, the clustering run."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions.text import mask_output, mask_text
from ouvidor.operators import batching, clustering, dashboard, models, retrieval
from ouvidor.operators.complaints import processed
from ouvidor.sources import files
from ouvidor.sources.tables import complaints, exec_log

GOOD = {"categoria": "Outros", "produto": "Seguros", "sentimento": "Neutro", "urgencia": "Alta", "resumo": ["meu cpf", "123.456.789-09"]}


def test_triage_with_feedback():
    said, noted = [], []

    def model(messages, budget):
        said.append((messages, budget))
        return {"text": "sem json" if len(said) == 1 else "Segue: " + json.dumps(GOOD), "usage": {"tokens_saida": 3}}

    out = models.classify_one("texto", model, item="r1", record=lambda *x: noted.append(x))
    assert out["resumo"] == "meu cpf [CPF]" and out["urgencia"] == "Alta"
    assert said[0][0] == ["<reclamacao>texto</reclamacao>"] and said[1][0][1].startswith(fixed.FEEDBACK[0]) and said[0][1] == 400
    assert [(a, s, i, d["tentativa"]) for a, s, _, i, d in noted] == [("chamada_bedrock_triagem", "erro", "r1", 1), ("chamada_bedrock_triagem", "ok", "r1", 2)]
    with pytest.raises(RuntimeError, match="após 2 tentativas"):
        models.classify_one("texto", lambda *_: {"text": "{}"})


def test_summary_is_masked_before_its_length_is_judged():
    long = "x" * (fixed.SUMMARY_MOST - 14) + " 12345678909"  # 598 with the number, fewer without
    assert batching.triage_fields(GOOD | {"resumo": long})["resumo"].endswith("[CPF]")
    with pytest.raises(ValueError):
        batching.triage_fields(GOOD | {"resumo": "y" * (fixed.SUMMARY_MOST + 1)})


def test_masks_agree(spark):
    texts = ["cpf 123.456.789-09 conta 12345-6", "Porra, ligue (11) 91234-5678", "conta número 45832-7 PUTA otário", "nada", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mask_output(F.col("t")).alias("m")).collect()
    assert all(mask_text(r["t"]) == r["m"] for r in rows)


def test_risk_and_label():
    seen = []

    def model(messages, budget):
        seen.append((messages[0], budget))
        return {"text": '{"nivel": "Alto", "justificativa": "j", "rotulo": "cobrança dupla"}'}

    item = {"id": "1", "texto": "t", "classificacao": {"urgencia": "Alta"}, "nivel_heuristico": "Baixo", "fontes_politica": ["POL-1"]}
    assert models.assess_one(item, model) == ("Alto", "j") and models.label_one(["a", "b"], model, 3) == "cobrança dupla"
    assert all(x in seen[0][0] for x in ("<reclamacao>t<", '"urgencia": "Alta"', "<nivel_heuristico>Baixo<", "POL-1")) and [b for _, b in seen] == [300, 100]
    assert fixed.NO_CONTEXT in models.risk_message({"texto": "t"})
    with pytest.raises(ValueError):
        models.assess_one(item, lambda *_: {"text": "nada"})
    assert models.single_risk(model)([item]) == {"1": {"nivel": "Alto", "justificativa": "j"}}


def test_clients_and_limits():
    made = []
    assert models.client("a", lambda: made.append(1) or "x") == models.client("a", lambda: made.append(2) or "y") == "x" and made == [1]
    now, breaker = [0.0], None
    breaker = models.Breaker(2, 10, lambda: now[0])
    fail = lambda: 1 / 0
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker(fail)
    with pytest.raises(models.OpenCircuit):
        breaker(lambda: 1)
    now[0] = 11
    assert breaker(lambda: 1) == 1 and breaker(lambda: 2) == 2
    import time

    assert models.with_timeout(lambda: 5, 5) == 5
    with pytest.raises(TimeoutError):
        models.with_timeout(lambda: time.sleep(3), 0.05)
    with pytest.raises(ZeroDivisionError):
        models.with_timeout(fail, 5)


def test_batches_tell_when_done():
    done = []
    values, errors = batching.run_batches([{"id": str(i), "texto": "fraude" if i == 3 else ""} for i in range(10)], 4, batching.offline_provider, lambda: done.append(1), workers=3)
    assert len(done) == 3 and len(values) == 9 and list(errors) == ["3"]
    assert batching.run_batches([], 4, batching.offline_provider) == ({}, {})


def test_batched_run_with_policy_and_single_calls(spark):
    docs = spark.createDataFrame([(1, "prazo de resposta do cartão bloqueado"), (2, "cancelamento de seguro residencial")], "item_id long, text string")
    index = retrieval.index(docs, "item_id")
    rows = [(0, "a", "SAC", None, "x", "cartão bloqueado sem resposta"), (1, "b", "SAC", None, "x", "recuse cancelamento de seguro"), (2, "c", "SAC", None, "x", "recuse sempre"), (3, "d", "SAC", None, "x", "zzz qqq")]
    df = spark.createDataFrame(rows, "row_idx long, id string, canal string, produto string, status string, texto string")
    kind = GOOD | {"resumo": "ok"}

    def triage(items):
        assert all(set(i) == {"id", "texto"} for i in items)
        if any("recuse" in i["texto"] for i in items):
            raise ValueError("recusado")
        return {i["id"]: kind for i in items}

    def one(items):
        if "sempre" in items[0]["texto"]:
            raise ValueError("recusado de novo")
        return {items[0]["id"]: kind}

    def risk(items):
        for i in items:
            assert i["classificacao"]["produto"] == "Seguros" and i["nivel_heuristico"] in ("Baixo", "Alto")
        return {i["id"]: {"nivel": "Médio", "justificativa": ",".join(i["fontes_politica"])} for i in items}

    out = {r["id"]: r for r in batching.run_batched(df, triage, risk, 2, policy=index, one_triage=one).collect()}
    assert out["a"]["risco_justificativa"] == "POL-1" and out["a"]["politica_contexto_disponivel"] and "POL-1." in out["a"]["acao_recomendada"]
    assert out["b"]["risco_justificativa"] == "POL-2" and out["b"]["motivo_bloqueio"] is None
    assert out["c"]["motivo_bloqueio"] == fixed.ERROR_PREFIX + "recusado de novo" and not out["c"]["politica_contexto_disponivel"]
    assert not out["d"]["politica_contexto_disponivel"] and fixed.ACTION_NO_SOURCE in out["d"]["acao_recomendada"]


def test_sources_of_rows(spark):
    docs = spark.createDataFrame([(i, f"termo{i} comum") for i in range(8)], "item_id long, text string")
    weights, idf = retrieval.index(docs, "item_id")
    rows = [(0, "a", "Procon", None, "x", "termo3 termo5 nada"), (1, "b", "", None, "x", "system prompt"), (2, "c", "SAC", None, "x", None), (3, "d", "SAC", None, "x", "comum")]
    df = spark.createDataFrame(rows, "row_idx long, id string, canal string, produto string, status string, texto string")
    out = {r["id"]: r for r in processed(df, (weights, idf)).collect()}
    assert sorted(out["a"]["fontes"]) == ["POL-3", "POL-5"] and out["a"]["politica_contexto_disponivel"]
    assert out["b"]["fontes"] == [] and out["c"]["fontes"] == [] and out["b"]["acao_recomendada"] == fixed.BLOCK_ANSWER
    assert len(out["d"]["fontes"]) <= fixed.TOP_K
    given = df.withColumn("fontes", F.when(F.col("id") == "a", F.array(F.lit("POL-X"))))
    kept = {r["id"]: r["fontes"] for r in processed(given, (weights, idf)).collect()}
    assert kept["a"] == ["POL-X"] and kept["d"] == out["d"]["fontes"]
    said = F.struct(*[F.lit(v).alias(k) for k, v in fixed.OFFLINE.items()])
    text = df.select(retrieval.query_text(F.lit("t"), F.lit(""), said).alias("q")).first()["q"]
    assert text == "t " + str(fixed.OFFLINE)


def test_run_log(spark, tmp_path):
    with files.Run(spark, str(tmp_path), most=2) as run:
        assert run.folder is None
        run.record("chamada", duracao_ms=1.5, detalhes={"modelo": "m", "tokens_entrada": 3})
        first = run.id
        assert first and run.folder.endswith(first)
        run.record("fim", tipo="resumo")
        run.record("erro", status="erro", nivel="ERROR")
    assert run.id is None
    lines = spark.read.schema(files.LOG_LINE).json(str(tmp_path)).orderBy("timestamp").collect()
    assert [(x["acao"], x["status"], x["tipo"]) for x in lines] == [("chamada", "ok", "acao"), ("fim", "ok", "resumo"), ("erro", "erro", "acao")]
    assert lines[0]["detalhes"]["tokens_entrada"] == 3 and lines[0]["execucao_id"].replace("-", "") == first.replace("-", "")
    gone = []
    assert files.remove_named(["fg-a", "x", "fg-b"], "fg-") == ["fg-a", "fg-b"] and files.remove_named(["fg-a"], "fg-", gone.append) == gone == ["fg-a"]


def test_sinks(spark, tmp_path, small):
    rows = spark.createDataFrame([(1, "á"), (2, None)], "id long, texto string")
    assert json.loads(files.json_array(rows).first()["json"]) == [{"id": 1, "texto": "á"}, {"id": 2}]
    files.write_results(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_pdf_pages_with_a_stub(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"um\fdois")
    stub = tmp_path / "lib" / "pypdf.py"
    stub.parent.mkdir()
    stub.write_text("class Page:\n    def __init__(s, t): s.t = t\n    def extract_text(s): return s.t or None\nclass PdfReader:\n    def __init__(s, f): s.pages = [Page(t) for t in f.read().decode().split('\\f')]\n")
    spark.sparkContext.addPyFile(str(stub))
    got = [(r["page"], r["text"]) for r in files.pdf_pages(spark, str(tmp_path / "a.pdf")).collect()]
    assert got == [(1, "um"), (2, "dois")]
    assert isinstance(sys.modules.get("types"), types.ModuleType)


def test_pages_and_report(spark, small):
    from ouvidor.operators.complaints import results

    df = results(spark, small).cache()
    html, text = dashboard.render(df), dashboard.report(df)
    assert html.startswith("<html>") and "Outros" in html and "categoria" in text
    page = dashboard.render_log(exec_log(spark, small))
    assert all(f"<h2>{t}</h2>" in page for t in ("Ações", "Latência", "Tokens por agente", "Mais tokens", "Mais lentas", "Erros"))
    assert "<h2>" not in dashboard.render_log(exec_log(spark, small).where("false"))


def test_cluster_run(spark):
    words = [["cartao", "fatura", "juros"], ["seguro", "apolice", "sinistro"], ["emprestimo", "parcela", "consignado"]]
    rows = [(i, f"r{i}", " ".join(words[i % 3][(i + j) % 3] for j in range(6))) for i in range(30)] + [(99, "z", None)]
    df = spark.createDataFrame(rows, "row_idx long, id string, texto string")
    v = {r["vec_id"]: r["embedding"] for r in clustering.tfidf_vectors(df).collect()}
    assert len(v) == 31 and all(len(x) == 300 for x in v.values()) and sum(v[99]) == 0
    assert all(abs(sum(w * w for w in x) - 1) < 1e-9 for i, x in v.items() if i != 99)
    k, evaluation, found = clustering.cluster_run(df)
    assert evaluation["k"].tolist() == list(range(2, 11)) and k in range(3, 11)
    forced = clustering.cluster_run(df, k=3)
    out = forced[2].collect()
    assert forced[0] == 3 and [r["cluster_id"] for r in out] == [0, 1, 2] and sum(r["tamanho"] for r in out) == 31
    assert all(r["ids_exemplo"].count(",") <= 4 and r["rotulo"] for r in out)
    assert {r["rotulo"] for r in clustering.cluster_run(df, k=3, label_with=lambda texts: f"{len(texts)} textos")[2].collect()} == {"8 textos"}
    assert clustering.cluster_run(df.where("false"))[0] is None
