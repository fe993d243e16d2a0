"""Each operator against brute force, and on the cases that its docstring defines."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from ouvidor.llm import bpe, chat, classifier, common, components, counts, lm, packing, rules, simhash, sketch, suffix  # noqa: E402
from ouvidor.llm.queries import QUERIES  # noqa: E402

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n\n", "a", "É", "漢字" * 50, "a<|endoftext|>b", "x" * 5000, " " * 3000 + "y", "it's we'll 'tis\n's", "tab\tnbsp\xa0em end", "\x00\x01\x1c\x85", "😀 👍🏽", "<|x|>"]


@pytest.fixture(scope="module")
def texts(small):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def awkward(spark, texts):
    """Null, empty, odd and long texts, copies, repeated rows and ids, a null id, and columns with the results' names."""
    rows = [(i, t) for i, t in enumerate([*ODD, None, *list(texts.values())[:30]])]
    rows += [(500, rows[20][1]), (501, rows[20][1]), rows[21], rows[21], (None, rows[22][1]), (600, "palavra outra " * 20_000)]
    data = [(i, t, 1, "x", 2.0, "y", "z", True) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, n_tokens int, ids string, score double, fingerprint string, n_words string, held_out boolean")
    return df.repartition(3), rows


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")


def words(text, lower=True):
    raw = (text or "").encode()
    return WORD.findall(bytes(b + 32 if lower and 65 <= b <= 90 else b for b in raw))


# 1
def test_bpe(spark, awkward):
    df, rows = awkward
    e = bpe.rank_encoding(RANKS, P.PATTERN)
    want = []
    for i, t in rows:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(int(x).to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(bpe.digest(df, RANKS, P.PATTERN)) == sorted(want, key=repr)
    assert bpe.digest(nothing(spark), RANKS, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN, to="own ids"), RANKS, P.PATTERN, "own ids").select("text", "bytes").collect()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)


def test_bpe_pieces():
    e = bpe.rank_encoding(RANKS, P.PATTERN)
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choices(["a", "b1", " ", "  ", "\n", "'s", "é", ".", " " * 400, "\t" * 300, "　"], k=60))
        assert bpe.encode_text(e, t, 20) == e.encode_ordinary(t)
    assert bpe.decode_ids(e, bpe.encode_text(e, "é")[:1])  # half a character is bytes too
    assert len(bpe.encode_text(e, " " * 2_000_000 + "x")) > 0


# 2
def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    df, rows = awkward
    t = Tokenizer.from_file(JSON)
    want = Counter()
    ids = {}
    for i, text in rows:
        ids[i] = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[i] += len(ids[i])
    pieces = packing.pack(df, JSON, P.PATTERN).collect()
    assert Counter({k: v for k, v in want.items()}) == sum((Counter({p["doc_id"]: p["length"]}) for p in pieces), Counter())
    windows = defaultdict(list)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    short = 0
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 1024
        short += end < 1024
        assert end & (end - 1) == 0  # full or a power of two: no padding
    assert short <= 10
    assert packing.pack(nothing(spark), JSON, P.PATTERN).count() == 0


def test_packer_keeps_few_windows():
    r = random.Random(2)
    p = packing.Packer(0, 64, 3)
    for d in range(300):
        p.document(d, np.full(r.randint(1, 200), d, dtype="<u4"))
        assert len(p.windows) <= 3
    left = p.merge()
    assert sum(len(x[2]) for x in left) < 64
    p.finish(left)


# 3
def runs_of(parts):
    out = []
    for a, e in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def brute_removals(rows, length):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        seen.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        runs = runs_of([(k, k + length) for k in range(len(raw) - length + 1) if seen[raw[k : k + length]] > 1])
        out.append((i, len(raw), sum(e - a for a, e in runs), len(runs), hashlib.sha256(suffix.without(raw, runs)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, awkward):
    df, rows = awkward
    want = brute_removals(rows, 200)  # the long text too
    assert any(0 < w[2] < w[1] for w in want) or any(w[2] for w in want)
    assert got(suffix.removals(df)) == want
    assert suffix.removals(nothing(spark)).count() == 0
    assert suffix.cut(nothing(spark)).count() == 0


@pytest.mark.parametrize("frequent, split", [(64, 512), (64, 1), (1, 1), (1, 512), (3, 4)])
def test_suffix_dedup_passages(spark, frequent, split):
    """Passages at all offsets, texts of few letters, copies; with small bounds the anchor strings take the way of frequent ones."""
    r = random.Random(5)
    passages = ["".join(r.choices("abcdefgh ", k=n)) for n in (200, 201, 350, 900)]
    rows = []
    for i in range(60):
        t = "".join(r.choices("abcdefgh ", k=r.randint(0, 300)))
        for p in r.sample(passages, r.randint(0, 2)):
            t += p[: r.randint(150, len(p))] + "".join(r.choices("xyz", k=r.randint(0, 30)))
        rows.append((i, t))
    rows += [(100, "ab" * 400), (101, "b" * 150), (102, "b" * 150), (103, "ba" * 120), (104, rows[3][1]), (105, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(suffix.removals(df, frequent=frequent, split=split)) == brute_removals(rows, 200)
    assert got(suffix.removals(df, frequent=frequent, split=split, piece_bytes=20)) == brute_removals(rows, 200)  # hundreds of pieces
    cut = {x["doc_id"]: x["text"] for x in suffix.cut(df, frequent=frequent, split=split).collect()}
    assert {i: len(t.encode()) for i, t in cut.items()} == {w[0]: w[1] - w[2] for w in brute_removals(rows, 200)}


def test_long_texts_go_in_stretches(spark, monkeypatch):
    r = random.Random(6)
    same = "".join(r.choices("abcdefgh", k=700))
    rows = [(1, "".join(r.choices("abcdefgh", k=5000)) + same + "q" * 50), (2, "z" + same + "".join(r.choices("abcdefgh", k=3000)))]
    rows += [(3, "".join(r.choices("abcdefgh ", k=150_000))), (4, "x"), (5, None)]
    rows += [(6, "y" * 70_001 + rows[2][1][60_000:70_000] + rows[2][1][:300]), (6, "é" * 40_000)]  # windows over the edges of stretches
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removals(rows, 200)
    assert got(suffix.removals(df)) == want
    assert {(x["doc_id"], len((x["text"] or "").encode())) for x in suffix.cut(df).collect()} == {(w[0], w[1] - w[2]) for w in want}


@pytest.mark.parametrize("buffer", [1000, 1 << 16])
def test_every_window_is_under_one_anchor(monkeypatch, buffer):
    r = random.Random(6)
    raw = bytes(r.choices(b"abcdefgh", k=9000))
    starts = []
    for at in range(0, len(raw) - 199, buffer):
        part = raw[at : at + buffer + 199]
        _, h, c, a, e = suffix.anchors(np.frombuffer(part, dtype=np.uint8), np.array([len(part)]))
        starts += [at + s for x, y in zip(a, e) for s in range(x, y - 199)]
    assert sorted(starts) == list(range(len(raw) - 199))


def test_repeat_groups_cover_what_is_removed(spark):
    """All removed bytes are in intervals of the suffix arrays, each with all its places."""
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh", k=500))
    rows = [(i, "".join(r.choices("abcdefgh", k=r.randint(0, 200))) + passage[r.randint(0, 100) : r.randint(300, 500)]) for i in range(30)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups, spans = defaultdict(list), defaultdict(list)
    for x in suffix.repeat_groups(df).collect():
        groups[x["grp"], x["length"]].append((x["doc_id"], x["offset"]))
        spans[x["doc_id"]].append((x["offset"], x["offset"] + x["length"]))
    by_id = defaultdict(set)
    for i, t in rows:
        by_id[i].add(t)
    for (_, n), at in groups.items():
        assert len(at) > 1 and n >= 200
        assert len({t[o : o + n] for i, o in at for t in by_id[i]}) == 1
    for i, _, gone, *_ in brute_removals(rows, 200):
        assert sum(e - a for a, e in runs_of(spans[i])) == gone


def test_maximal_repeats():
    r = random.Random(1)
    for _ in range(150):
        least = r.choice([3, 5, 9])
        texts = [bytes(r.choices(r.choice([b"ab", b"abcdefgh"]), k=r.randint(0, 40))) for _ in range(r.randint(1, 6))]
        texts += texts[:1] if r.random() < 0.5 else []
        places = defaultdict(list)
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for n in range(least, len(t) - i + 1):
                    places[t[i : i + n]].append((k, i))
        want = set()
        for s, at in places.items():
            left = {texts[k][i - 1 : i] if i else ("start", k) for k, i in at}
            right = {texts[k][i + len(s) : i + len(s) + 1] or ("end", k) for k, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(at))))
        assert {(n, tuple(sorted(at))) for n, at in suffix.maximal_repeats(texts, least)} >= want


# 4
def test_chat(spark):
    rows = [
        (0, 0, "user", "oi", 1), (0, 1, "assistant", "<|olá", 1), (1, 0, "user", "oi", 1), (1, 1, "assistant", "não", 1), (1, 2, "user", "x", 1),
        (2, 0, "user", "a", 1), (3, 0, "user", "a", 1), (3, 0, "user", "a", 1), (4, 0, None, None, 1), (4, None, "user", "first", 1), (None, 0, "user", "lost", 1), (7, 0, "user", "alone", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")
    r = {x["pair_id"]: x for x in chat.preference_pairs(df).collect()}
    assert sorted(r) == [0, 1, 2, 3]
    assert r[0]["prompt"] == "<|user|>\noi<|end|>\n" and r[0]["chosen"] == "<|assistant|>\n< |olá<|end|>\n"
    assert (r[0]["n_prompt_turns"], r[0]["n_chosen_turns"], r[0]["n_rejected_turns"]) == (1, 1, 2)
    assert r[0]["chosen_mask"] == "14:0,14:1" and r[0]["rejected_mask"].endswith("9:0,9:0")
    for x in r.values():
        for side in ("chosen", "rejected"):
            assert sum(int(m.split(":")[0]) for m in x[side + "_mask"].split(",") if m) == len(x[side])
    assert r[1]["chosen"] == r[1]["rejected"] == "" and r[2]["chosen"].startswith("<|user|>\nfirst") and r[3]["prompt"] == "" and r[3]["chosen"] == ""
    assert chat.preference_pairs(spark.createDataFrame([], df.schema)).count() == 0


def test_chat_long(spark):
    """A turn of a megabyte, conversations of thousands of turns."""
    big = "ç" * 500_000 + "<|"
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in (0, 1) for t in range(3000)]
    rows = [*turns, (1, 3000, "user", "more"), (2, 0, "user", big), (3, 0, "user", big), (3, 1, "assistant", big)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    r = {x["pair_id"]: x for x in chat.preference_pairs(df).collect()}
    assert (r[0]["n_prompt_turns"], r[0]["n_chosen_turns"], r[0]["n_rejected_turns"]) == (3000, 0, 1)
    assert (r[1]["n_prompt_turns"], r[1]["n_chosen_turns"], r[1]["n_rejected_turns"]) == (1, 0, 1)
    assert len(r[1]["prompt"]) == len(r[1]["rejected"]) - len("assistant") + len("user") > 500_000 and r[1]["chosen"] == ""
    assert sum(int(m.split(":")[0]) for m in r[1]["rejected_mask"].split(",")) == len(r[1]["rejected"])


def test_chat_oracle(spark, small):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = duck.sql(chat.ORACLE)
    assert got(QUERIES["op4_chat"](spark, small).select(*want.columns)) == sorted(want.fetchall(), key=repr)


# 5
def test_counts(spark, awkward):
    from tokenizers import Tokenizer

    df, rows = awkward
    t = Tokenizer.from_file(JSON)
    want = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 512))
    assert got(counts.token_counts(df, JSON, P.PATTERN)) == sorted(want, key=repr)
    assert counts.token_counts(nothing(spark), JSON, P.PATTERN).count() == 0


def test_transducers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    r = random.Random(3)
    parts = ["'", "'s", "'re", "'l", " ", "  ", "\n", "a", "Z", "é", "漢", "1", "٣", "!", "<|endoftext|>", "　", "\x1c", "\x85", "😀", "_", "the", " ing", "́", " "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(1500)]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    machine = counts.Merger(JSON, P.PATTERN, most=500)  # so small that it is dropped and compiled anew
    assert [int(counts.count_texts(machine, [x])[0]) for x in texts[:100]] == want[:100]
    assert counts.count_texts(machine, texts).tolist() == want
    symbol, _ = counts.symbols(texts)
    state, states = counts.FRESH, []
    for s in symbol.tolist():  # one symbol after the other gives what the scan gives
        states.append(state)
        state = counts._TO[s, state]
    assert counts.entry_states(symbol).tolist() == states


def test_counts_know_the_library_s_characters():
    """Letters of new Unicode versions, which another regex engine may class in another way."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    some = [*range(0xA0, 0x2100), *range(0xA700, 0xAC00), *range(0x10900, 0x11400, 3), *range(0x18C00, 0x19000, 3), *range(0x1E000, 0x1F000, 5)]
    texts = [f"{chr(c)}'s {chr(c)}1" for c in some]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.count_texts(counts.merger(JSON, P.PATTERN), texts).tolist() == want


# 6
def test_classifier(spark, awkward):
    df, rows = awkward
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = classifier.classify(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    for r in out:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert classifier.classify(nothing(spark), labels).count() == 0
    assert {r["score"] for r in classifier.classify(df, labels.where("false")).collect()} == {0.5}
    kept = classifier.keep(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in out)


def test_classifier_covers_whole_texts():
    net = classifier.Net(1)
    for size in (1, 5, 127, 128, 129, 255, 256, 257, 1000, 300_000):
        raw = bytes(np.random.default_rng(size).integers(32, 127, size, dtype=np.uint8))
        one = classifier._tops(net, [raw])
        many = classifier._tops(net, [b"abc", raw, b""])
        np.testing.assert_allclose(one[0], many[1], rtol=1e-4, atol=1e-5)
        # by hand: chunks of two blocks
        codes = np.full(-(-size // 128) * 128 + 8, 256)
        codes[:size] = np.frombuffer(raw, dtype=np.uint8)
        act = np.maximum(np.array([net.p["embed"][codes[i : i + 8]].ravel() for i in range(0, size, 2)]) @ net.p["filter"], 0)
        blocks = -(-size // 128)
        chunks = [act[64 * i : 64 * (i + 2)].mean(axis=0) for i in range(max(1, blocks - 1))]
        np.testing.assert_allclose(one[0], np.max(chunks, axis=0), rtol=1e-3, atol=1e-4)
        z = float(np.max(chunks, axis=0) @ net.p["out"] + net.p["bias"][0])
        assert abs(classifier.scores(net, [raw])[0] - 1 / (1 + np.exp(-z))) < 1e-4
        # the neighbours in a batch have no effect, whatever they are
        for beside in (b"", b"x" * 1000, raw):
            np.testing.assert_allclose(classifier._tops(net, [raw, beside])[0], one[0], rtol=1e-4, atol=1e-5)


def test_classifier_gradients():
    """Every gradient against the change of the loss."""
    r = np.random.default_rng(3)
    net = classifier.Net(2)
    texts = [bytes(r.integers(97, 110, n, dtype=np.uint8)) for n in (3, 100, 128, 700)]
    y = np.array([1, 0, 1, 0], dtype=np.float32)

    def loss():
        p = classifier.scores(net, texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = classifier._gradients(net, texts, y)
    for name in ("filter", "out", "shift", "bias"):
        flat, step = net.p[name].reshape(-1), 1e-2
        for at in r.choice(len(flat), min(6, len(flat)), replace=False):
            kept = flat[at]
            flat[at] = kept + step
            up = loss()
            flat[at] = kept - step
            down = loss()
            flat[at] = kept
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[at]) < 2e-2 * max(1, abs(grads[name]).max())


def test_classifier_learns_from_long_texts_in_parts(spark):
    room = classifier.PARTS * classifier.PART_CHARS
    rows = [(i, ("good words here " if i % 2 else "#$% bad!! ") * 20) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, quality int")
    long = "a" * room + "b" * room + "c" * room
    df = spark.createDataFrame([*rows, (40, "z" * room), (41, long)], "doc_id long, text string")
    parts = {r["doc_id"]: r["p"] for r in df.select("doc_id", classifier.parts_of(classifier.F.col("text")).alias("p")).collect()}
    assert parts[0] == [rows[0][1]] and parts[40] == ["z" * room]
    assert [len(p) for p in parts[41]] == [classifier.PART_CHARS] * classifier.PARTS and parts[41][0][0] == "a" and parts[41][-1][-1] == "c"
    net = classifier.train(df, labels)
    assert classifier.scores(net, [rows[1][1].encode()])[0] > 0.5 > classifier.scores(net, [rows[0][1].encode()])[0]
    plain, twice = (classifier.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows + rows))
    assert all((plain.p[k] == twice.p[k]).all() for k in plain.p)


def test_classifier_learns_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = QUERIES["op6_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in out if r["quality"]], [r["score"] for r in out if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert np.mean([g >= 0.3 for g in good]) > 0.97


# 7
def brute_simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in ids]


def test_simhash(spark, awkward):
    df, rows = awkward
    prints = [brute_simhash(t) for _, t in rows]
    groups = brute_groups(prints)
    least = {g: min((i for (i, _), h in zip(rows, groups) if h == g and i is not None), default=None) for g in groups}
    want = sorted(((i, "%016x" % p, least[g]) for (i, _), p, g in zip(rows, prints, groups)), key=repr)
    assert got(simhash.near_duplicates(df)) == want
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    group_of = {(i, t): g for (i, t), g in zip(rows, groups)}
    assert sorted(group_of[x] for x in kept) == sorted(set(groups))  # one row of each group
    assert {least[group_of[x]] for x in kept} == {x[0] for x in kept}


def test_keep_one_by_rows(spark):
    """Ids that repeat with other texts, rows without an id, whole copies."""
    long = [" ".join(f"w{r}x{i}" for i in range(60)) for r in range(6)]
    rows = [(1, long[0]), (1, long[1]), (2, long[1]), (2, long[2]), (2, long[2]), (None, long[3]), (None, long[3]), (None, long[0]), (7, None), (8, ""), (9, long[4])]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, fp string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, long[0]), (1, long[1]), (2, long[2]), (None, long[3]), (7, None), (9, long[4])], key=repr)
    assert simhash.keep_one(df).columns == df.columns


@pytest.mark.parametrize("long", [4096, 2])
def test_links_of_close_fingerprints(spark, long):
    """Chains and clouds of fingerprints; with ``long`` = 2 every posting is dealt again by a fifth byte."""
    r = random.Random(9)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(40):
            prints.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    roots = {r_["node"]: r_["root"] for r_ in components.components(simhash.links(df, long)).collect()}
    label = [roots.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    want = brute_groups(prints)
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_blocks_cover_three_errors():
    from itertools import combinations

    assert len(simhash.blocks()) == 14
    for wrong in combinations(range(8), 3):
        assert any(m & sum(0xFF << 8 * i for i in wrong) == 0 for m in simhash.blocks())


# 8
def brute_features(text):
    t = text or ""
    w = [x.decode() for x in words(t, lower=False)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_rules(spark, awkward):
    df, rows = awkward
    out = rules.judge(df)
    want = []
    for i, t in rows:
        f = brute_features(t)
        want.append((i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert got(out.select("doc_id", *rules.BASE, "base_failed")) == sorted(want, key=repr)
    assert out.where("kept and base_failed").count() == 0
    kept = rules.keep(df)
    assert kept.columns == df.columns and kept.count() == out.where("kept").count()
    assert rules.judge(nothing(spark)).count() == 0 and rules.keep(nothing(spark)).count() == 0


def test_rules_separate(spark):
    d = "/root/testdata/sf0.01"
    out = rules.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in out if r["quality"]], [r["kept"] for r in out if not r["quality"]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_em_finds_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.8
    votes = np.zeros((20_000, 4), dtype=int)
    for j, (hit, false) in enumerate([(0.6, 0.01), (0.5, 0.02), (0.7, 0.03), (0.4, 0.01)]):
        p = np.where(truth, false, hit)
        votes[:, j] = np.where(r.random(20_000) < 0.1, 0, np.where(r.random(20_000) < p, -1, 1))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, odds = rules.fit_votes(patterns, n.astype(float))
    assert abs(1 / (1 + np.exp(-prior)) - 0.8) < 0.05 and (odds[:, 0] < -1).all() and (odds[:, 2] >= 0).all()


# 9
def test_sketches(spark, awkward):
    df, rows = awkward
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    out = sketch.fingerprints(df)
    assert got(out.select("doc_id", "n_chars", "edited_sha256")) == sorted(want, key=repr)
    by_text = defaultdict(set)
    for r in out.join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        by_text[r["text"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert sketch.fingerprints(nothing(spark)).count() == 0
    one = spark.createDataFrame([(1, "só um texto")], "doc_id long, text string")
    assert sketch.fingerprints(one).first()["near_next"] == 1.0


def brute_sketch(text):
    """Kept hashes by the formulas of the docstrings, a word and a shingle at a time."""
    full = 2**64 - 1

    def spread(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    def word(w):
        if len(w) > 256:
            return xxhash.xxh64_intdigest(w, 9)
        parts = [int.from_bytes(w[i : i + 8], "little") for i in range(0, len(w), 8)]
        h = spread((parts[0] * 0x9E3779B97F4A7C15 + len(w) * 0xC2B2AE3D27D4EB4F) & full)
        for p in parts[1:]:
            h = spread((h * 0x9E3779B97F4A7C15 + p * 0x165667B19E3779F9) & full)
        return h

    w = [word(x) for x in words(text, lower=False)]
    k = min(5, len(w))
    total = lambda i: spread(sum(w[i + j] * int(sketch._TURN[j]) for j in range(k)) + k & full)
    return {h >> 14 for h in (total(i) for i in range(len(w) - k + 1 if w else 0)) if h < 2**62}


def test_sketches_by_hand(spark, texts):
    rows = sorted([*texts.items(), (10**6, ""), (10**6 + 1, "one two"), (10**6 + 2, "one two"), (2**60, "a b c d e " + "x" * 300), (2**60 + 1, "long text of many words " * 40_000)])
    out = {r["doc_id"]: r for r in sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(out) == len(rows)

    def like(a, b, same):
        return 1.0 if same else len(a & b) / min(len(a), len(b)) if a and b else 0.0

    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        r, changed = out[i], sketch.edited(t, u)
        a, e, n = (brute_sketch(x) for x in (t, changed, u))
        assert set(sketch.read_fingerprint(r["fingerprint"]).tolist()) == a and set(sketch.read_fingerprint(r["edited_fingerprint"]).tolist()) == e
        assert r["near_edited"] == like(a, e, (a == e and a) or (not a and not e and t == changed))
        assert r["near_next"] == like(a, n, (a == n and a) or (not a and not n and t == u))


def test_sketch_error_against_true_containment(texts):
    """Mean error of the estimate by the number of words; short texts have few kept hashes."""
    some = [t for t in texts.values() if len(t.split()) >= 100]
    wrong = []
    for t, u in zip(some, some[1:]):
        (_, _, _, _, _, near, _), sets = sketch.compare([(0, t), (1, u)])[0], []
        for x in (t, sketch.edited(t, u)):
            w = x.encode().split()
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
        wrong.append(abs(near - len(sets[0] & sets[1]) / min(map(len, sets))))
    assert np.mean(wrong) < 0.06 and np.quantile(wrong, 0.95) < 0.2


def test_sketch_estimates_containment():
    r = random.Random(4)
    w = [f"w{r.randint(0, 10**6)}" for _ in range(20_000)]
    whole, part = " ".join(w), " ".join(w[3000:4000])
    a, b = sketch.sketch(whole), sketch.sketch(part)
    assert sketch.likeness(a, b, False) > 0.99 and abs(len(b) / 996 - 1 / sketch.KEEP_ONE_IN) < 0.06
    assert np.array_equal(sketch.read_fingerprint(sketch.fingerprint(whole.encode(), a)), a)
    left, right = " ".join(w[:10_004]), " ".join(w[10_000:])
    assert np.array_equal(sketch.merge(sketch.sketch(left), sketch.sketch(right)), a)


# 10
def brute_lm(rows):
    """Scores with exact counts of words and pairs, quantised as the filter does, a token at a time."""
    texts = [[*words(t), b""] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for w, out in zip(texts, held):
        if not out:
            c.update(w)
            pairs.update(zip([b"", *w], w))
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    level = lambda x: int(lm.LogBloom.level(np.array([x]))[0])
    least = lambda x: float(lm.LogBloom.least(np.array([level(x)]))[0])
    unseen = (once + 0.5) / (n + 1)
    p1 = lambda x: (1 - unseen) * x / n if x > 0 else unseen / (once + 1)
    seen = defaultdict(list)
    for w, out in zip(texts, held):
        for a, b in zip([b"", *w], w):
            if not out and c[a] > 1:
                seen[level(c[a])].append(min(max(least(pairs[a, b]) - 1, 0) / (c[a] - 1), 1) / p1(c[b] - 1))
    shares, last = {0: 0.0}, 0.0
    for q in range(1, 60):
        if seen[q]:
            last, r = 0.5, np.array(seen[q])
            for _ in range(100):
                last = min(max(float(np.mean(last * r / (last * r + 1 - last))), 1e-6), 0.999)
        shares[q] = last
    out = []
    for (i, _), w in zip(rows, texts):
        total = 0.0
        for a, b in zip([b"", *w], w):
            share = shares[level(c[a])]
            total += np.log10(share * (min(least(pairs[a, b]) / c[a], 1) if c[a] else 0) + (1 - share) * p1(c[b]))
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), total))
    return out


@pytest.mark.parametrize("most", [0, lm.MOST_BROADCAST])
def test_lm(spark, awkward, most):
    """With and without a broadcast filter."""
    df, rows = awkward
    want, have = defaultdict(list), defaultdict(list)
    for x in brute_lm(rows):
        want[x[0]].append(x[1:])
    for r in lm.score(df, most_broadcast=most).collect():
        have[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert set(have) == set(want)
    for i in want:
        assert len(have[i]) == len(want[i])
        for x, y in zip(sorted(have[i]), sorted(want[i])):
            assert x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-6 * x[0]
            assert abs(x[4] - y[4]) < 0.005 * x[0] + 4  # the bins of the weights; a false positive, one in 3000 unseen pairs, gives about 3
            assert np.isfinite(x[4]) and x[4] < 0
    assert lm.score(nothing(spark)).count() == 0
    alone = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert np.isfinite(lm.score(alone).first()["score"])


def test_lm_beats_base_on_held_out(spark):
    out = QUERIES["op10_lm"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum() and np.corrcoef(out["score"], out["base_score"])[0, 1] > 0.95


def test_log_bloom():
    r = np.random.default_rng(1)
    keys, n = r.integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64), r.zipf(1.5, 20_000).clip(1, 10**6)
    f = lm.LogBloom(int(lm.LogBloom.level(n).sum()))
    f.add(keys, n)
    levels = f.levels(keys)
    assert (levels >= lm.LogBloom.level(n)).all() and (levels == lm.LogBloom.level(n)).mean() > 0.99
    assert (lm.LogBloom.least(lm.LogBloom.level(n)) <= n).all() and (lm.LogBloom.least(lm.LogBloom.level(n)) > n / 1.5 - 1).all()
    assert (f.levels(r.integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64)) > 0).mean() < 0.01
    assert (lm.LogBloom.of(f.bits.tobytes()).levels(keys) == levels).all()


def test_model_is_a_distribution():
    """Seen words and the mass of the unseen sum to 1; the pairs of one first word to 1 at most."""
    r = np.random.default_rng(2)
    counts = r.zipf(1.5, 500).clip(1, 10**5)
    totals = lm.Totals(int(counts.sum()), len(counts), int((counts == 1).sum()))
    assert abs(totals.p1(counts).sum() + totals.unseen - 1) < 1e-9
    after = r.multinomial(1000, np.full(300, 1 / 300))
    assert lm.p2(lm.LogBloom.least(lm.LogBloom.level(after)), np.full(300, 1000)).sum() <= 1


def test_lm_packs_what_it_sends():
    r = np.random.default_rng(5)
    tokens = r.integers(0, 50, 4000).astype(np.uint64)
    keys = np.unique(lm.pair_keys(tokens, 6))
    for piece, a, b in lm.pieces_of(keys, 6):
        assert (lm.lengthen(lm.shorten(keys[a:b], 6), piece, 6) == keys[a:b]).all()
    n = r.zipf(1.3, 5000)
    n[:3] = (0, 255, 10**12)
    assert (lm.large(*lm.small(n)) == n).all()
    share = lm.weights([(3, 0, 50), (3, 1 + int((1 + lm.SPREAD) / lm.STEP), 50), (7, 0, 10)])
    assert share[2] == 0 and 0.4 < share[3] < 0.5 and share[4] == share[3] and share[7] == 1e-6  # max of .5 log(1 - L) + .5 log(1 + 9 L) is at 4 / 9


def test_lm_pieces_follow_the_corpus(spark):
    """The number of pieces grows with the tokens, and scores don't depend on it but for false positives."""
    least = max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    assert [common.piece_bits(spark, n, 10) for n in (0, 1, 10 << least, (10 << least) + 1, 1000 * 10 << least)] == [least, least, least, least + 1, least + 10]
    assert common.piece_bits(spark, 1 << 60, 10) == common.MOST_BITS
    df = spark.createDataFrame([(i, f"palavra w{i % 9} x{i % 7} fim") for i in range(300)], "doc_id long, text string")
    few, many = ({x["doc_id"]: x["score"] for x in lm.score(df, most_broadcast=most, piece_tokens=n).collect()} for most, n in ((0, lm.PIECE_TOKENS), (0, 10)))
    assert few.keys() == many.keys() and sum(abs(few[i] - many[i]) < 1e-9 for i in few) >= 290


def test_lm_enters_all_words_and_pairs(spark):
    r = random.Random(3)
    follows = [f"w{i}" for i in range(4000)]
    r.shuffle(follows)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, " ".join(follows[at : at + 100])) for i in ids for at in [r.randrange(3900)]]
    chosen = follows[1000:1200]
    rows += [(held[0], " ".join(chosen)), (held[1], " ".join(r.sample(chosen, 200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near, dealt = ({x["doc_id"]: x["score"] for x in lm.score(df, most_broadcast=most).collect()} for most in (lm.MOST_BROADCAST, 0))
    assert near == dealt  # whether the filter is broadcast has no effect
    assert near[held[0]] > near[held[1]] + 150  # pairs of rare words are known
