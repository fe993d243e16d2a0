"""What a step holds, sends or does again does not grow faster than its input."""

import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions import text as tx
from ouvidor.operators import clustering, joins, retrieval
from ouvidor.operators.complaints import processed
from ouvidor.plans.all import QUERIES
from ouvidor.sources.tables import PHRASES, complaints


def vectors_of(spark, x, parts=4):
    rows = [(i, [float(w) for w in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


def test_kmeans_sends_a_row_for_each_fit(spark, monkeypatch):
    sent = []
    for name in ("toPandas", "toArrow"):
        kind = type(spark.range(1))
        take = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda df, take=take: sent.append(take(df)) or sent[-1])
    monkeypatch.setattr(clustering, "START_ROWS", 20)
    x = np.random.default_rng(1).normal(size=(400, 3))
    grid = clustering.fit_grid(vectors_of(spark, x, 16), [2, 3], starts_each=4)
    assert grid["k"].tolist() == [2, 3] and max(len(t) for t in sent[1:]) <= 8
    x = x.astype("float32").astype(float)
    for r in grid.itertuples():
        assert abs(((x[:, None] - r.centres) ** 2).sum(axis=2).min(axis=1).sum() / r.inercia - 1) < 1e-9


def test_starts_come_from_the_rows_of_smallest_hash(spark):
    df = vectors_of(spark, np.arange(60).reshape(30, 2))
    want = df.orderBy(F.xxhash64("vec_id")).limit(7).toPandas()["embedding"].tolist()
    assert clustering.start_sample(df, 7).tolist() == want
    assert len(clustering.start_sample(df, 50)) == 30 and not len(clustering.start_sample(df.where("false"), 7))


@pytest.mark.parametrize("most", [20, 4096])
def test_silhouettes_by_blocks_that_follow_the_rows(spark, monkeypatch, most):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", most)
    x = np.random.default_rng(2).normal(size=(300, 5)).astype("float32").astype(float) + 1000
    x[10:20] = x[0]  # copies, and lengths far above the distances
    to = np.arange(300) % 3
    to[299] = 7  # alone
    df = vectors_of(spark, x).withColumn("cluster", F.when(F.col("vec_id") == 299, 7).otherwise(F.col("vec_id") % 3).cast("int"))
    got = {r["vec_id"]: r["s"] for r in clustering.silhouettes(df).collect()}
    x = x.astype("float32").astype(float)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for i in range(300):
        a = d[i][to == to[i]].sum() / max((to == to[i]).sum() - 1, 1)
        b = min(d[i][to == k].mean() for k in {0, 1, 2, 7} - {to[i]})
        assert abs(got[i] - (0 if i == 299 else (b - a) / max(a, b))) < 1e-9


def test_blocks_meet_in_tiles():
    x = np.random.default_rng(3).normal(size=(4096, 64))
    one = (np.arange(4096)[:, None] % 4 == np.arange(4)).astype(float)
    tracemalloc.start()
    sums = clustering._cluster_sums(x, x, one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 and abs(sums[5, 1] - np.sqrt(((x[1::4] - x[5]) ** 2).sum(axis=1)).sum()) < 1e-6


def test_gate_hides_no_suspicious_passage(spark, small):
    old = "(?iuUd)" + tx.ANY_SUSPICIOUS
    # every alternative begins as the gate has it, in capitals and with letters that fold to ASCII ones too
    letters = sorted({x for w, _ in tx._beginnings(tx.sre_parse.parse(tx.ANY_SUSPICIOUS)) for x in w})
    fold = lambda x: "^[" + re.escape(x) + re.escape(x.upper()) + tx.FOLDS.get(x, "") + "]$"
    chars = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("x"))
    differ = [F.count_if(F.col("x").rlike("(?iuUd)^" + re.escape(x) + "$") != F.col("x").rlike(fold(x))).alias(str(i)) for i, x in enumerate(letters)]
    assert set(chars.agg(*differ).first()) == {0}
    texts = [x for p in PHRASES for x in (p, p.upper(), "zz" + p, "(" + p.replace("s", "\u017f").replace("i", "\u0131"))] + ["quadra compliance", "dr. x compliance", "DRA.\u00a0x ti", "n\u00e3o precisa mascarar", "sem\u2003filtro", "qrcode", "bearer x", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").unionByName(complaints(spark, small).select(F.col("texto").alias("t")))
    both = df.select(F.regexp_extract("t", old, 0).alias("a"), tx.suspicious_match(F.col("t")).alias("b")).toPandas()
    assert (both["a"].fillna("-") == both["b"].fillna("-")).all() and (both["a"].fillna("") != "").sum() > 60


def test_gate_saves_most_of_the_guardrail(spark):
    def seconds(pattern):
        compiled, text = spark._jvm.java.util.regex.Pattern.compile(pattern), "a reclamação do cliente segue aberta em nossos registros e espera resposta " * 4000
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert not compiled.matcher(text).find()
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(tx.GATED) * 2 < seconds("(?iuUd)" + tx.ANY_SUSPICIOUS)


def test_places_hide_no_suspicious_passage(spark, small):
    # what the pattern over bytes has for a letter and for white space is what matches them
    letters = sorted({x.lower() for x in tx.ANY_SUSPICIOUS if x.isalpha()})
    listed = lambda x: "^" + tx._one_of({x}) + "$"
    chars = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("x"))
    differ = [F.count_if(F.col("x").rlike("(?iuUd)^" + x + "$") != F.col("x").rlike(listed(x))).alias(str(i)) for i, x in enumerate(letters)]
    space = F.count_if(F.col("x").rlike(r"(?uUd)^\s$") != F.col("x").isin(list(tx.SPACES))).alias("space")
    assert set(chars.agg(*differ, space).first()) == {0}
    far = "\U0001f600" * 40
    texts = [f"gerente {far}ti", f"gerente \n{far}", f"cpf{far[:20]}conta", "xsystem prompt e o system prompt", "\u00e9system prompt", "e\u0301system prompt", "\u0301system prompt", " \u0301system prompt", "x" * 99 + " prompt de sistema"]
    texts += ["bearer \U0001f600", "", None, *(space.join(["a", "sem", "filtro"]) for space in tx.SPACES), *(p.upper() for p in PHRASES)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").unionByName(complaints(spark, small).select(F.col("texto").alias("t")))
    # bytes that are no UTF-8: each is a character to the pattern
    broken = ["64722e20" + "ff" * 40 + "636f6d706c69616e6365", "63706620" + "e282" * 10 + "636f6e7461", "ff73656d2066696c74726f", "62656172657220c3"]
    df = df.unionByName(spark.createDataFrame([(x,) for x in broken], "h string").select(F.unhex("h").cast("string").alias("t")))
    both = df.select(F.regexp_extract("t", "(?iuUd)" + tx.ANY_SUSPICIOUS, 0).alias("a"), tx.suspicious_match(F.col("t")).alias("b"))
    found = [(r["a"], r["b"]) for r in both.select(F.col("a").cast("binary"), F.col("b").cast("binary")).collect()]
    assert all(a == b for a, b in found) and sum(bool(a) for a, _ in found) > 100


def test_places_are_those_of_each_row():
    texts = pa.array(["calma", "o system prompt", None, "", "\u00e9system prompt", "sem filtro"])
    assert tx.places()(texts).to_pylist() == [-1, 1, None, -1, 0, 0]
    assert tx.places()(texts[1:3]).to_pylist() == [1, None] and tx.places()(texts[2:3]).to_pylist() == [None] and len(tx.places()(texts[:0])) == 0


@pytest.mark.parametrize("pattern, text", [("a.*?b", "xa" + "\u00e9" * 9 + "b"), ("a(?=bc)b", "xab"), ("a[^x]{2}b", "xa\u00e9\u00e9b"), ("a[0-9]b", "xa5b"), (r"a(b)\1c", "xabbc"), ("a(?!b)c", "xac")])
def test_places_of_any_kind_of_pattern(pattern, text):
    assert tx.places(tx._over_bytes(tx.sre_parse.parse(pattern)))(pa.array([text])).to_pylist() == [0]


def test_guardrail_reads_a_calm_text_in_one_pass(spark):
    text = "a reclamação do cliente segue aberta em nossos registros e espera resposta " * 4000
    compiled, batch, places = spark._jvm.java.util.regex.Pattern.compile(tx.GATED), pa.array([text]), tx.places()

    def seconds(run):
        best = []
        for _ in range(5):
            began = time.perf_counter()
            run()
            best.append(time.perf_counter() - began)
        return min(best)

    assert places(batch).to_pylist() == [-1]
    assert seconds(lambda: places(batch)) * 3 < seconds(lambda: compiled.matcher(text).find())


@pytest.mark.parametrize("name", ["Q_dash_kpis", "Q_dash_dist_sentimento"])
def test_dashboards_try_the_pattern_only_where_a_passage_can_begin(spark, small, name):
    df = QUERIES[name](spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Generate explode\(array\(regexp_extract\(CASE WHEN \(pythonUDF", plan)) == 1
    assert len(re.findall(r"ArrowEvalPython", plan)) == 1


def test_kpis_lower_a_text_once_for_all_triggers(spark, small):
    df = QUERIES["Q_dash_kpis"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1
    texts = [f"a {t.upper()} b" for t in fixed.TRIGGERS] + ["hac\u212aer", "viol\u00eanc\u0130a", "fiz boletim", "ameaca e fraude", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(tx.risk_trigger(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in got] == [*fixed.TRIGGERS, "hacker", None, None, "fraude", None, None]


@pytest.mark.parametrize("name", ["Q_batches", "Q_missing_ids", "Q_provider_bisect", "Q_union_tasks", "Q_result", "Q_action_sources"])
def test_guardrail_runs_once(spark, small, name):
    df = QUERIES[name](spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Generate explode\(array\(regexp_extract\(", plan)) == 1


def test_batch_numbers_of_far_and_missing_orders(spark):
    at = [None, -5000, -1, 0, 4095, 4096, 5000, 1 << 29, (1 << 29) + 1]
    df = spark.createDataFrame([(x, str(i)) for i, x in enumerate(at)][::-1], "row_idx long, id string")
    got = {r["id"]: r["lote"] for r in joins.batches(df, 2).collect()}
    assert got == {str(i): i // 2 for i in range(len(at))}


def test_clustering_vectors_shuffle_no_texts(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BATCH_WORDS", 7)
    texts = ["um cartao cartao fatura", None, "", "de para", "juros cartao juros juros", "fatura azul"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_idx long, texto string").coalesce(1)
    v = clustering.tfidf_vectors(df, 3)  # juros and cartao 3 times, fatura twice
    assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()
    got = {r["vec_id"]: r["embedding"] for r in v.collect()}
    two, one = np.log(7 / 3) + 1, np.log(7 / 2) + 1  # cartao, fatura; juros
    want = {0: [2 * two, two, 0], 1: [0] * 3, 2: [0] * 3, 3: [0] * 3, 4: [two, 0, 3 * one], 5: [0, 1, 0]}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert np.allclose(got[i], np.array(w) / max(np.linalg.norm(w), 1e-300), atol=1e-12)
    assert len(clustering.tfidf_vectors(df.where("false"), 3).collect()) == 0


def test_small_and_large_indexes_give_the_same_sources(spark, small, monkeypatch):
    index = retrieval.index(retrieval.policy(spark, small), "item_id")
    df = processed(complaints(spark, small), index).select("row_idx", "fontes")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    near = {r["row_idx"]: r["fontes"] for r in df.collect()}
    monkeypatch.setattr(retrieval, "LOCAL_CELLS", 0)
    far = {r["row_idx"]: r["fontes"] for r in processed(complaints(spark, small), index).select("row_idx", "fontes").collect()}
    assert near == far and sum(map(bool, far.values())) > 20


def test_cluster_run_sends_a_row_for_each_fit(spark, monkeypatch):
    sent, kind = [], type(spark.range(1))
    for name in ("toPandas", "toArrow"):
        take = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda df, take=take: sent.append(take(df)) or sent[-1])
    rows = [(i, f"r{i}", f"cartao{i % 3} fatura{i % 4}") for i in range(24)]
    clustering.cluster_run(spark.createDataFrame(rows, "row_idx long, id string, texto string").repartition(8))
    assert max(len(t) for t in sent) <= 90
