"""The pipeline against its stages done by hand, and the import guard."""

import subprocess
import sys
import zlib

import numpy as np

import corpus_pipeline
from ouvidor.llm import classifier, rules, simhash
from tests.llm.test_ops import brute_groups, brute_removals, brute_simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near duplicates", "suffix-array dedup", "packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = classifier.train(docs, labels)
    rows = {i: t for i, t in rows.items() if classifier.scores(net, [t.encode()])[0] >= classifier.THRESHOLD}
    judged = rules.judge(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).where("kept").collect()
    rows = {r["doc_id"]: rows[r["doc_id"]] for r in judged}
    ids = sorted(rows)
    groups = brute_groups([brute_simhash(rows[i]) for i in ids])
    first = {}
    for i, g in zip(ids, groups):
        first.setdefault(g, i)
    rows = {i: rows[i] for i in first.values()}
    kept_bytes = {i: n - gone for i, n, gone, *_ in brute_removals(list(rows.items()), 200)}

    staged, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, small)
        assert staged.columns == docs.columns
        seen.append(staged)
    got = {r["doc_id"]: r for r in staged.collect()}
    assert {i: len(r["text"].encode()) for i, r in got.items()} == kept_bytes
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    from tokenizers import Tokenizer
    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in got.items()}
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {p["doc_id"] for p in pieces} == set(want)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(np.array(want[p["doc_id"]][p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes())
    assert sum(p["length"] for p in pieces) == sum(map(len, want.values()))


def test_awkward_documents(spark, small, tmp_path):
    """Null, empty and repeated rows, a null id, further columns with the results' names, through run(); then no rows at all."""
    plain = spark.read.parquet(f"{small}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, "pt", "s", 0), (10**6 + 1, "", "pt", "s", 0), (None, "x " * 100, None, None, None), (10**6 + 2, "palavra outra " * 20_000, "pt", "s", 1)], plain.schema)
    copies = plain.orderBy("doc_id").limit(20)
    docs = plain.unionByName(copies).unionByName(more).selectExpr("*", "'a' AS score", "1 AS t", "2.0 AS spans", "'b' AS kept", "3 AS fp", "array(1) AS text_ids")
    for name, rows in (("full", docs), ("none", docs.where("false"))):
        d = str(tmp_path / name)
        rows.write.parquet(f"{d}/documents.parquet")
        spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{d}/labels.parquet")
        staged = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            staged = stage(spark, staged, d)
            assert staged.columns == docs.columns
        left = staged.groupBy("doc_id").count().where("count > 1").count()
        assert left == 0  # ids repeat with whole copies only here, and of those one stays
        pieces = corpus_pipeline.run(spark, d)
        assert pieces.columns[:3] == ["doc_id", "start", "length"]
        assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in staged.select("doc_id").collect()}
        assert (pieces.count() == 0) == (name == "none")


def test_rest_works_without_this_part():
    code = "import sys, importlib.util as u; f = u.find_spec; sys.modules['ouvidor.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') for x in q) and len(q) > 60"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True).returncode == 0


def test_simhash_of_groups_is_stable(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once, again = simhash.keep_one(docs), simhash.keep_one(simhash.keep_one(docs))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(r["doc_id"] for r in again.collect())
