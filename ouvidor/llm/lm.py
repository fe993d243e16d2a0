"""Operator 10, language-model scores from a log-frequency Bloom filter.

The filter holds n-grams with their counts on a logarithmic scale: an n-gram of level q is entered q times, with the
numbers 1 to q; a reader probes 1, 2, ... until a probe fails. Levels are one-sided: never too low, too high
with the small chance of a false positive.

The model: words (ASCII lower case) and one end of text, which also stands before the first word.

* p1(w) of a word that training has seen is its share of the counts times 1 - u; u, the share of the words seen once, is the mass
  of all words that it has not seen, each of which gets as much as if there were one more of them than of words seen once.
* p(w | v) = L p2(w | v) + (1 - L) p1(w). p2 is the least count of the level that the filter gives for the pair, over the count of
  v, so that the p2 of one v sum to 1 at most but for false positives. L depends on the level of v's count and is learned by
  expectation maximisation from all training tokens, each left out of the counts that predict it.

Every word and every pair of neighbouring words of the training texts is counted; all grows with the corpus. Words are 64-bit hashes, so
counts are exact but for their collisions; a pair is known by 40 bits within its piece of the filter.

Texts are read once, in flushes of about ``FLUSH`` tokens. A flush is stored as tokens and asks for its distinct words and pairs, dealt by
hash to pieces; the questions carry the flush's training counts, so that a piece sums them up, and answers. There are so many pieces that about
``PIECE_TOKENS`` tokens ask one, whatever the corpus; a flush asks for a word once, however frequent it is. The
pieces of the filter are broadcast where their proven bound, BITS_EACH bits for each training token, is at most
``MOST_BROADCAST``. Beyond that each piece is probed in the task that builds it, by the questions dealt to it, and levels go back to the flushes.
Both ways probe the same filter and give the same scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import drop_table, free_shuffles, materialise, piece_bits, strings, text_of
from ouvidor.llm.words import batches as grouped
from ouvidor.llm.words import hash_words, mix

GROWTH, HASHES, BITS_EACH, MOST_BROADCAST = 1.5, 6, 20, 64 << 20
FLUSH, BATCH_BYTES, CHUNK = 1 << 19, 1 << 16, 1 << 14  # tokens, bytes, and keys or tokens at a time in the processor's cache
KEY_BITS, PIECE_TOKENS = 40, 1 << 22  # tokens that ask one piece
STEP, SPREAD = 0.02, 10.0  # bins of the logarithm of p2 / p1, and how far they go
_U = np.uint64
END = _U(0xE4D0F7E47)  # stands for the end of a text; a word has this hash once in 2 ** 64


class LogBloom:
    """Log-frequency Bloom filter over 64-bit keys, for ``items`` entries (the sum of all levels)."""

    def __init__(self, items: int):
        self.bits = np.zeros(max(1024, int(items) * BITS_EACH + 7) // 8, dtype=np.uint8)

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        """1 for a count of 1, one more for each factor of GROWTH; 0 for none."""
        counts = np.asarray(counts, dtype=np.float64)
        return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(GROWTH) + 1e-9), 0).astype(np.int64)

    @staticmethod
    def least(levels: np.ndarray) -> np.ndarray:
        """The smallest count of a level; 0 for level 0."""
        return np.where(levels > 0, np.ceil(GROWTH ** (levels - 1.0) - 1e-9), 0.0)

    @classmethod
    def of(cls, bits: bytes) -> LogBloom:
        bloom = cls.__new__(cls)
        bloom.bits = np.frombuffer(bits, dtype=np.uint8)
        return bloom

    def _places(self, keys: np.ndarray, level: int):
        h = mix(keys + _U(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        size, step = _U(len(self.bits) * 8), (h >> _U(17)) | _U(1)
        for _ in range(HASHES):
            yield (h >> _U(32)) * size >> _U(32)
            h = (h + step) * _U(0xD6E8FEB86659FD93)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        flags = np.unpackbits(self.bits, bitorder="little")
        for i in range(0, len(keys), CHUNK):
            some, levels = keys[i : i + CHUNK], self.level(counts[i : i + CHUNK])
            for level in range(1, int(levels.max(initial=0)) + 1):
                for place in self._places(some[levels >= level] if level > 1 else some[levels > 0], level):
                    flags[place] = 1
        self.bits = np.packbits(flags, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([self._levels(keys[i : i + CHUNK]) for i in range(0, max(len(keys), 1), CHUNK)])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        levels, live, level = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys)), 1
        while len(live) and level < 255:
            kept = np.ones(len(live), dtype=bool)
            for place in self._places(keys[live], level):
                kept &= (self.bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8) & 1).view(bool)
            live = live[kept]
            levels[live] = level
            level += 1
        return levels


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, number of tokens of each): the words in ASCII lower case, then the end."""
    h, first = hash_words([t.encode("utf-8").lower() for t in texts])
    return np.insert(h, first[1:], END), np.diff(first) + 1


def pair_keys(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Of each token and the one before it (the end before the first): ``bits`` bits that name a piece, and KEY_BITS within it; the rest is 0."""
    rest = _U(64 - KEY_BITS - bits)
    return mix(mix(np.concatenate([[END], tokens[:-1]])) * _U(3) + tokens) >> rest << rest


def shorten(keys: np.ndarray, bits: int) -> bytes:
    """The KEY_BITS of each pair's key within its piece."""
    return (keys << _U(bits) >> _U(64 - KEY_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def lengthen(short: bytes, piece: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(short) // (KEY_BITS // 8), 8), dtype=np.uint8)
    wide[:, : KEY_BITS // 8] = np.frombuffer(short, dtype=np.uint8).reshape(-1, KEY_BITS // 8)
    return wide.view("<u8").ravel() << _U(64 - KEY_BITS - bits) | _U(piece << 64 - bits)


def small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, those of 255 and more apart."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes()


def large(counts: bytes, more: bytes) -> np.ndarray:
    out = np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(more, dtype="<i8")
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, number of each key's place among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def pieces_of(keys: np.ndarray, bits: int):
    """(piece, from, to) over sorted keys."""
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)).tolist() + [len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


_STORE = "f long, n long, docs binary, words binary, tokens binary"
_ASKED = "f long, piece int, keys binary, n binary, more binary"
WORDS, PAIRS = 1, 2
DOC = np.dtype([("id", "<i8"), ("has_id", "u1"), ("held", "u1"), ("n", "<i8")])


def batch_of(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    n = len(next(iter(columns.values())))
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(columns[k], type=kinds[t]) if k in columns else pa.nulls(n, kinds[t]) for k, t in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in fields])


def _store_rows(batches):
    """Texts (doc_id, held_out, text) -> a row for each flush: documents, distinct words (the most frequent first) and tokens (numbers of words)."""

    def flush(f: int, docs: list, parts: list) -> pa.RecordBatch:
        tokens, sizes = np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])
        words, at = distinct(tokens)
        order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype="<u4")
        rank[order] = np.arange(len(words))
        about = np.zeros(len(docs), dtype=DOC)
        about["id"], about["has_id"], about["held"], about["n"] = [d[0] or 0 for d in docs], [d[0] is not None for d in docs], [d[1] for d in docs], sizes
        planes = rank[at].view(np.uint8).reshape(-1, 4).T  # all lowest bytes, then all second ones, ...: the higher ones are mostly 0
        return batch_of(_STORE, f=[f], n=[len(tokens)], docs=[about.tobytes()], words=[words[order].tobytes()], tokens=[planes.tobytes()])

    base, flushes, docs, parts, count = TaskContext.get().partitionId() << 32, 0, [], [], 0
    rows = ((d, o, t) for b in batches for d, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2))))
    for some in grouped(rows, lambda r: len(r[2]) + 16, BATCH_BYTES):
        parts.append(token_hashes([t for _, _, t in some]))
        docs += [(d, o) for d, o, _ in some]
        count += len(parts[-1][0])
        if count >= FLUSH:
            yield flush(base + flushes, docs, parts)
            docs, parts, count, flushes = [], [], 0, flushes + 1
    if docs:
        yield flush(base + flushes, docs, parts)


def _open(docs: bytes, words: bytes, tokens: bytes):
    """(documents, hashes or counts of the distinct words, which of them each token is)."""
    docs = np.frombuffer(docs, dtype=DOC)
    at = np.ascontiguousarray(np.frombuffer(tokens, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return docs, np.frombuffer(words, dtype=np.uint64), at.astype(np.int64)


def _questions(kind: int, bits: int):
    """Flushes -> what each asks for, by piece, with its training counts."""

    def run(batches):
        for batch in batches:
            for f, _, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                docs, words, at = _open(*columns)
                train = np.repeat(docs["held"] == 0, docs["n"])
                if kind == WORDS:
                    order = np.argsort(words)
                    keys, counts = words[order], np.bincount(at[train], minlength=len(words))[order]
                else:
                    marked = np.sort(pair_keys(words[at], bits) | train)  # the last bit is free
                    keys = marked & ~_U(1)
                    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    keys, counts = keys[new], np.add.reduceat((marked & _U(1)).astype(np.int64), new)
                rows = [(p, keys[a:b].tobytes() if kind == WORDS else shorten(keys[a:b], bits), *small(counts[a:b])) for p, a, b in pieces_of(keys, bits)]
                piece, short, n, more = zip(*rows)
                yield batch_of(_ASKED, f=[f] * len(rows), piece=piece, keys=short, n=n, more=more)

    return run


_ANSWERS = "f long, kind int, piece int, answer binary, n long, v long, n1 long, n2 long, bits binary"


def _summed(keys: np.ndarray, counts: np.ndarray):
    """(sorted distinct keys, sums of their counts, order that sorts the keys, how often each distinct one stands there)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[new], np.add.reduceat(counts[order], new), order, np.diff(np.append(new, len(keys)))


def _replies(table: pa.Table, kind: int, size: int, found: np.ndarray, order: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    """What was found for each distinct key, dealt back to the questions (keys of ``size`` bytes) as they came."""
    replies = np.empty(len(order), dtype=found.dtype)
    replies[order] = np.repeat(found, often)
    ends = np.cumsum([len(b) // size for b in table["keys"].to_pylist()])
    return batch_of(_ANSWERS, f=table["f"].to_pylist(), kind=[kind] * len(ends), piece=table["piece"].to_pylist(), answer=[x.tobytes() for x in np.split(replies, ends[:-1])])


def _summary(piece: int, kind: int, counts: np.ndarray, bits: bytes | None) -> pa.RecordBatch:
    facts = {"n": counts.sum(), "v": len(counts), "n1": (counts == 1).sum(), "n2": (counts == 2).sum()}
    return batch_of(_ANSWERS, kind=[kind], piece=[piece], bits=[bits], **{k: [int(v)] for k, v in facts.items()})


def _count_words(table: pa.Table) -> pa.Table:
    """Questions of a piece -> the training count of each word asked for, by flush; sums over the piece."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=np.uint64)
    _, sums, order, often = _summed(keys, np.concatenate([large(n, m) for n, m in zip(table["n"].to_pylist(), table["more"].to_pylist())]))
    return pa.Table.from_batches([_replies(table, WORDS, 8, sums.astype("<i8"), order, often), _summary(table["piece"][0].as_py(), WORDS, sums[sums > 0], None)])


def _build(bits: int, answer: bool):
    """Questions of a piece -> its filter; where it isn't broadcast, the levels that its probes give for each question."""

    def run(table: pa.Table) -> pa.Table:
        piece = table["piece"][0].as_py()
        keys = lengthen(b"".join(table["keys"].to_pylist()), piece, bits)
        keys, sums, order, often = _summed(keys, np.concatenate([large(n, m) for n, m in zip(table["n"].to_pylist(), table["more"].to_pylist())]))
        known = sums > 0
        bloom = LogBloom(int(LogBloom.level(sums).sum()))
        bloom.add(keys[known], sums[known])
        out = [_summary(piece, PAIRS, sums[known], None if answer else bloom.bits.tobytes())]
        if answer:
            out.append(_replies(table, PAIRS, KEY_BITS // 8, bloom.levels(keys), order, often))
        return pa.Table.from_batches(out)

    return run


@dataclass
class Totals:
    """Tokens, distinct words, words seen once, of the training texts."""

    n: int
    v: int
    once: int

    @property
    def unseen(self) -> float:
        return (self.once + 0.5) / (self.n + 1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (1 - self.unseen) * counts / max(self.n, 1), self.unseen / (self.once + 1))


def p2(least: np.ndarray, before: np.ndarray) -> np.ndarray:
    """From the least counts of the pairs' levels and the counts of their first words."""
    return np.where(before > 0, np.minimum(least / np.maximum(before, 1), 1.0), 0.0)


_READY = "f long, docs binary, words binary, tokens binary, levels binary"


def _ready(bits: int, shared):
    """A flush and the answers to it -> its documents and tokens with the counts of its words and the level of each token's pair."""

    def run(flushes: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(flushes):
            return pa.Table.from_batches([batch_of(_READY, f=[])])
        row = flushes.to_pylist()[0]
        _, words, at = _open(row["docs"], row["words"], row["tokens"])
        counts = np.empty(len(words), dtype="<i8")
        said = sorted(zip(answers["kind"].to_pylist(), answers["piece"].to_pylist(), answers["answer"].to_pylist()), key=lambda x: x[:2])
        counts[np.argsort(words)] = np.frombuffer(b"".join(a for k, _, a in said if k == WORDS), dtype="<i8")  # in the order of the pieces
        keys, back = distinct(pair_keys(words[at], bits))
        if shared is None:
            levels = np.frombuffer(b"".join(a for k, _, a in said if k == PAIRS), dtype=np.uint8)
        else:
            levels = np.concatenate([LogBloom.of(shared.value[p]).levels(keys[a:b]) if p in shared.value else np.zeros(b - a, dtype=np.uint8) for p, a, b in pieces_of(keys, bits)])
        return pa.Table.from_batches([batch_of(_READY, f=[row["f"]], docs=[row["docs"]], words=[counts.tobytes()], tokens=[row["tokens"]], levels=[levels[back].tobytes()])])

    return run


def _opened(batch):
    """For each flush (counts of its words, [(documents, words of their tokens, words of the tokens before, pair levels)]), a few documents at a time."""
    for docs, words, tokens, levels in zip(*(batch.column(name).to_pylist() for name in ("docs", "words", "tokens", "levels"))):
        docs, counts, at = _open(docs, words, tokens)
        levels, ends = np.frombuffer(levels, dtype=np.uint8), np.cumsum(docs["n"])
        end = at[ends[0] - 1 : ends[0]]  # the word that is the end of a text, which also stands before its first one
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)), [len(docs)]])).tolist()

        def some(cuts=cuts, docs=docs, at=at, levels=levels, ends=ends, end=end):
            for i, j in zip(cuts, cuts[1:]):
                a, b = int(ends[i - 1]) if i else 0, int(ends[j - 1])
                yield docs[i:j], at[a:b], np.concatenate([end, at[a : b - 1]]), levels[a:b]

        yield counts.astype(np.int64), some()


_BINS = "level int, bin int, n long"


def _ratios(totals: Totals):
    """How p2 compares with p1 over the training tokens, each left out of the counts: numbers by level of the word before and bin."""
    width = int(2 * SPREAD / STEP) + 2
    least = np.maximum(LogBloom.least(np.arange(256)) - 1, 0)

    def run(batches):
        held = np.zeros((256, width), dtype=np.int64)
        for batch in batches:
            for counts, parts in _opened(batch):
                p1, level = totals.p1(counts - 1), LogBloom.level(counts)
                for docs, at, prior, levels in parts:
                    train = np.flatnonzero(np.repeat(docs["held"] == 0, docs["n"]) & (counts[prior] > 1))
                    at, prior, levels = at[train], prior[train], levels[train]
                    ratio = np.minimum(least[levels] / np.maximum(counts[prior] - 1, 1), 1) / p1[at]
                    bins = np.where(ratio > 0, np.round((np.log10(np.maximum(ratio, 1e-300)).clip(-SPREAD, SPREAD) + SPREAD) / STEP) + 1, 0).astype(np.int64)
                    held += np.bincount(level[prior] * width + bins, minlength=256 * width).reshape(256, width)
        level, bins = np.nonzero(held)
        yield batch_of(_BINS, level=level, bin=bins, n=held[level, bins])

    return run


def weights(rows, rounds: int = 100) -> np.ndarray:
    """L for each level of the word before, from (level, bin, n), by expectation maximisation; levels without tokens lean on the next lower one."""
    out, by_level = np.zeros(256), {}
    for level, bin_, n in rows:
        by_level.setdefault(level, []).append((0.0 if bin_ == 0 else 10 ** ((bin_ - 1) * STEP - SPREAD), n))
    for level in range(1, 256):
        out[level] = out[level - 1]
        if level in by_level:
            ratio, n = np.array(by_level[level], dtype=np.float64).T
            share = 0.5
            for _ in range(rounds):
                share = float((n * share * ratio / (share * ratio + 1 - share)).sum() / n.sum())
                share = min(max(share, 1e-6), 0.999)
            out[level] = share
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(totals: Totals, shares: np.ndarray):
    least = LogBloom.least(np.arange(256))

    def run(batches):
        for batch in batches:
            for counts, parts in _opened(batch):
                base, p1, share, known = totals.base(counts), totals.p1(counts), shares[LogBloom.level(counts)], (counts > 0).astype(np.int64)
                for docs, at, prior, levels in parts:
                    before, much = counts[prior], share[prior]
                    score = np.log10(much * p2(least[levels], before) + (1 - much) * p1[at])
                    first = np.cumsum(docs["n"]) - docs["n"]
                    ids = pa.array(docs["id"].tolist(), type=pa.int64(), mask=docs["has_id"] == 0)
                    sums = {"n_known": known[at], "base_score": base[at], "score": score}
                    yield batch_of(_SCORES, doc_id=ids, held_out=docs["held"] > 0, n_tokens=docs["n"].astype(np.int64), train_tokens=np.full(len(docs), totals.n), **{k: np.add.reduceat(x, first) for k, x in sums.items()})

    return run


def in_fold(id_col: str, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == fold


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end alone; a null id counts as the text '' for the fold; repeated rows are
    trained on and scored each. Without training texts every base term is log10(1), and every token has the probability 1/2.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), in_fold(id_col).alias("held_out"), text_of(text_col).alias("text"))
    store = materialise(texts.mapInArrow(_store_rows, _STORE), "store", "zstd")
    bits = piece_bits(spark, store.agg(F.sum("n")).first()[0] or 0, piece_tokens)
    asked = {kind: store.mapInArrow(_questions(kind, bits), _ASKED).groupBy("piece") for kind in (WORDS, PAIRS)}
    words = materialise(asked[WORDS].applyInArrow(_count_words, _ANSWERS), "words", "zstd")
    found = words.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in ("n", "v", "n1")]).first()
    totals = Totals(*found)
    shared, near = None, totals.n * BITS_EACH // 8 <= most_broadcast
    pairs = materialise(asked[PAIRS].applyInArrow(_build(bits, not near), _ANSWERS), "pairs", "zstd")
    if near:  # the levels of a pair are at most its count, so the filter has at most BITS_EACH bits for each training token
        shared = spark.sparkContext.broadcast({r["piece"]: bytes(r["bits"]) for r in pairs.select("piece", "bits").where("bits is not null").collect()})
    answers = words.unionByName(pairs).where("answer is not null").select("f", "kind", "piece", "answer")
    ready = materialise(store.groupBy("f").cogroup(answers.groupBy("f")).applyInArrow(_ready(bits, shared), _READY), "ready", "zstd")
    for table in (store, words, pairs):
        drop_table(table)
    if shared is not None:
        shared.unpersist()
    free_shuffles(spark)
    bins = ready.mapInArrow(_ratios(totals), _BINS).groupBy("level", "bin").agg(F.sum("n").alias("n")).collect()  # a few thousand, whatever the corpus
    return ready.mapInArrow(_scores(totals, weights(bins)), _SCORES)
