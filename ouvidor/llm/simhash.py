"""Operator 7, near-duplicates by SimHash with a byte-position index and count filtering.

Two fingerprints of 8 bytes that differ in at most 3 bits share at least 5 bytes in place. The index has no
postings of one byte, which a 256th of all fingerprints would share, but of four bytes at once: in the 14
blocks of the Steiner system S(3, 4, 8), any 3 differing byte positions leave a block untouched, so a pair
that shares 5 bytes meets in one posting at least. In a posting the shared bytes of a pair are tallied, pairs
with fewer than 5 go, the rest are verified bit by bit.

Only distinct fingerprints are indexed, so exact copies cost one entry. A posting gives the edges of a
spanning forest, at most one for each entry, never all pairs; a posting of more than ``LONG`` entries is dealt
again by each fifth byte, which 5 shared bytes allow too. Components come from alternating star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import free_shuffles, materialise, per_text, shuffle_partitions, text_of
from ouvidor.llm.components import components

SHINGLE, BITS, SHARED, LONG, SEED = 3, 3, 5, 4096, 42


def blocks() -> list[int]:
    """Masks of the 14 blocks: the words of weight 4 of the extended Hamming code of length 8."""
    rows = [0b11111111, 0b10101010, 0b11001100, 0b11110000]
    words = set()
    for pick in range(16):
        word = 0
        for i, row in enumerate(rows):
            word ^= row if pick >> i & 1 else 0
        words.add(word)
    return [sum(0xFF << 8 * i for i in range(8) if w >> i & 1) for w in sorted(words) if bin(w).count("1") == 4]


def simhash(text: str) -> int:
    """A bit is 1 if it is set in over half the hashes of the 3-word shingles, repeats included; no word: 0."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    k = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(begins), 1 << 15):
        h = np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at : at + (1 << 15)], ends[at : at + (1 << 15)])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begins)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_LOW = np.uint64(0x0101010101010101)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Bytes in place that are equal, from the xor of two fingerprints."""
    for shift in (4, 2, 1):
        x = x | (x >> np.uint64(shift))
    return 8 - np.bitwise_count(x & _LOW)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (uint64): each new one is compared with those not yet reached."""
    edges, rest = [], prints
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = rest ^ todo[-1]
            near = np.flatnonzero(shared_bytes(x) >= SHARED)
            near = near[np.bitwise_count(x[near]) <= BITS]
            one = todo.pop()
            if len(near):
                found = rest[near]
                edges += [(one, f) for f in found]
                todo += list(found)
                rest = np.delete(rest, near)
    return edges


def _forests(batches):
    """Edges of each posting; rows come sorted by (block, key)."""
    held, last = [], None

    def out(prints):
        edges = forest(np.array(prints, dtype=np.int64).view(np.uint64))
        both = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    for batch in batches:
        for block, key, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, key) != last:
                if len(held) > 1:
                    yield out(held)
                held, last = [], (block, key)
            held.append(value)
    if len(held) > 1:
        yield out(held)


def links(prints: DataFrame, long: int = LONG) -> DataFrame:
    """Distinct fingerprints (column fp, long) -> edges (u, v) that connect whatever the pairs within 3 bits connect."""
    masks = [signed(m) for m in blocks()]
    entries = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    sizes = entries.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(sizes, ["block", "key"])
    fifth = []
    for i, m in enumerate(blocks()):
        wider = [signed(m | 0xFF << 8 * b) for b in range(8) if not m >> 8 * b & 1]
        fifth.append(F.when(F.col("block") == i, F.array(*[F.struct(F.lit(100 + 8 * i + j).alias("block"), F.col("fp").bitwiseAND(F.lit(w)).alias("key")) for j, w in enumerate(wider)])))
    same = F.array(F.struct(F.col("block").cast("int").alias("block"), F.col("key")))
    goes = F.when(F.col("n") > long, F.coalesce(*fifth)).otherwise(same)
    dealt = met.select("fp", F.explode(goes).alias("g")).select("g.block", "g.key", "fp")
    dealt = dealt.repartition(shuffle_partitions(prints.sparkSession), "block", "key").sortWithinPartitions("block", "key", "fp")
    return dealt.mapInArrow(_forests, "u long, v long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text's hash), fp of every row."""
    udf = per_text(lambda t: (signed(simhash(t)),), "fp long")
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), udf(text)["fp"].alias("fp"))


def _rooted(docs: DataFrame, id_col: str, text_col: str, long: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, root of each distinct fingerprint that has a link: fp, root)."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(prints.select("fp").distinct(), "distinct")
    roots = components(links(distinct, long))
    return prints, roots.select(F.col("node").alias("fp"), "root")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id (smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows are kept; a null id is no
    candidate for component_id, which is null where a component has no id at all.
    """
    prints, roots = _rooted(docs, id_col, text_col, long)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = prints.join(rooted.join(first, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    free_shuffles(docs.sparkSession)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """groups() with the fingerprint as 16 lowercase hexadecimal digits."""
    g = groups(docs, id_col, text_col)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row of ``docs`` for each group of linked texts, all columns as they were: the one with the smallest id, of equal ids that
    whose text has the smallest hash, of whole copies any one. Rows without an id come last. Rows that repeat an id with different texts are
    documents of their own.
    """
    prints, roots = _rooted(docs, id_col, text_col, long)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    best = prints.groupBy("fp").agg(F.min(order).alias("r"))  # combined before the shuffle, however large a group is
    best = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("r").alias("r")).select("r.*")
    copies = prints.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1")
    best = best.join(copies, best["doc_id"].eqNullSafe(copies["doc_id"]) & (best["t"] == copies["t"]), "left").select(best["doc_id"].alias("__id"), best["t"].alias("__t"), F.coalesce("n", F.lit(1)).alias("__n"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("i"), F.xxhash64(text_of(text_col)).alias("h"))
    kept = keyed.join(best, keyed["i"].eqNullSafe(best["__id"]) & (keyed["h"] == best["__t"]))
    some = kept.where("__n > 1").groupBy("i", "h").agg(F.first("__row").alias("__row")).select("__row.*")
    return kept.where("__n = 1").select("__row.*").unionByName(some)
