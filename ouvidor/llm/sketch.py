"""Operator 9, threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range stays.

A sketch's size follows the text's, so sketches of very unequal documents can be compared: what they share
over the smaller one's size estimates how much of the smaller document the larger one contains. Sketches of
parts merge by union. Shingles are five words (a shorter text: its whole word sequence), words are runs of
anything but ASCII white space.

A fingerprint is the base64 of the sorted 6-byte hashes. A text too short to keep any hash has ``~`` and the
hash of the whole text instead, which is like its equals only.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import shuffle_partitions, strings, text_of
from ouvidor.llm.words import batches as grouped
from ouvidor.llm.words import hash_words, mix

WORDS, KEEP_ONE_IN = 5, 4
BATCH_BYTES, BATCH_TEXTS = 1 << 16, 1 << 12
_OWNER = np.uint64(48)  # a kept hash has 48 bits; the number of its text in a batch stands above them
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_hashes(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every shingle of ``k`` words; a text of fewer words has one of all its words, an empty one none."""
    h, first = hash_words(texts)
    n = np.diff(first)
    owners, hashes = [], []
    for size in range(1, k + 1):
        if size < k:
            owner = np.flatnonzero(n == size)
            at = first[owner]
        else:
            room = np.maximum(n - (k - 1), 0)
            owner = np.repeat(np.arange(len(texts)), room)
            at = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room)
        total = np.full(len(at), np.uint64(size))
        for j in range(size):
            total += h[at + j] * _TURN[j]
        owners.append(owner)
        hashes.append(mix(total))
    return np.concatenate(owners), np.concatenate(hashes)


def sketches(texts: list[bytes], one_in: int = KEEP_ONE_IN) -> np.ndarray:
    """Sorted distinct hashes below the fraction 1 / one_in of all texts (65,535 at most), each under the number of its text."""
    owner, h = shingle_hashes(texts)
    kept = np.flatnonzero(h < np.uint64(2**64 // one_in))
    marks = np.sort(h[kept] >> np.uint64(14) & np.uint64(2**48 - 1) | owner[kept].astype(np.uint64) << _OWNER)
    return marks[np.concatenate([[True], marks[1:] != marks[:-1]])] if len(marks) else marks


def sketch(text: str, one_in: int = KEEP_ONE_IN) -> np.ndarray:
    """Sorted distinct hashes (48 bits) below the fraction 1 / one_in."""
    return sketches([text.encode("utf-8")], one_in)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def fingerprint(raw: bytes, kept: np.ndarray) -> str:
    if not len(kept):
        return "~" + xxhash.xxh64_hexdigest(raw, 9)
    return base64.b64encode(packed(kept)).decode("ascii")


def packed(kept: np.ndarray) -> bytes:
    return kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def read_fingerprint(value: str) -> np.ndarray:
    if value.startswith("~"):
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(base64.b64decode(value), dtype=np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), dtype=np.uint8), raw]).view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Estimated share of the smaller sketch's document that is in the other; ``same``: equal fingerprints."""
    if same:
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(rows: list[tuple[int, str]]) -> list[tuple]:
    """Rows (id, text) in order, each against its edited text and the one after it; the last is only looked at."""
    texts = [t for _, t in rows]
    changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
    raws = [x.encode("utf-8") for pair in zip(texts, [*changed, ""]) for x in pair]  # text i is number 2i, its edited text 2i + 1
    marks = sketches(raws)
    owner = (marks >> _OWNER).astype(np.int64)
    ends = np.searchsorted(owner, np.arange(len(raws) + 1))
    sizes, line = np.diff(ends), packed(marks)

    def shared(step: int) -> np.ndarray:
        """How many hashes of each text are in the text ``step`` numbers on."""
        wanted = marks + (np.uint64(step) << _OWNER)
        at = np.minimum(np.searchsorted(marks, wanted), len(marks) - 1)
        return np.bincount(owner[marks[at] == wanted], minlength=len(raws)) if len(marks) else np.zeros(len(raws))

    def mark(i: int) -> str:
        return base64.b64encode(line[6 * ends[i] : 6 * ends[i + 1]]).decode("ascii") if sizes[i] else fingerprint(raws[i], marks[:0])

    prints = [mark(i) for i in range(len(raws))]
    near = {step: shared(step) for step in (1, 2)}

    def like(i: int, step: int) -> float:
        if prints[i] == prints[i + step]:
            return 1.0
        least = min(sizes[i], sizes[i + step])
        return float(near[step][i] / least) if least else 0.0

    return [
        (doc, len(text), hashlib.sha256(raws[2 * i + 1]).hexdigest(), prints[2 * i], prints[2 * i + 1], like(2 * i, 1), like(2 * i, 2))
        for i, (doc, text) in enumerate(rows[:-1])
    ]


def _in_order(batches):
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows():
        for batch in batches:
            for doc, text, extra in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist()):
                yield doc, text
                if extra:  # the first row of the next bucket closes this one
                    return

    before: list = []
    for some in grouped(rows(), lambda row: BATCH_BYTES // BATCH_TEXTS + len(row[1]), BATCH_BYTES):
        some = before + some
        out, before = compare(some), some[-1:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, which takes the head of the next text by id (after the last: the first).

    Ids are cut into as many ranges as there are shuffle partitions; each text goes to its range, and the rows of
    the id that starts a range go to the range before it too, so one shuffle of the texts finds every next text.
    Rows of one id are ordered by text, a null id comes first, an empty text has the fingerprint of no words.
    A single row is its own next.
    """
    lowest = -(2**63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    place = F.coalesce(F.col("doc_id"), F.lit(lowest))
    n = shuffle_partitions(docs.sparkSession)
    keyed = rows.select(place.alias("id"))
    marks = keyed.withColumn("id", F.col("id").cast("double")).approxQuantile("id", [i / n for i in range(n)], 0.1 / n)
    starts = sorted(set(marks)) or [0.0]
    # whole numbers beyond 2**53 share a double with their neighbours; all of them then start the range
    at = F.col("id").cast("double")
    from pyspark.ml.feature import Bucketizer

    own = Bucketizer(splits=[float("-inf"), *starts[1:], float("inf")], inputCol="at", outputCol="bucket") if len(starts) > 1 else None
    tagged = rows.withColumn("id", place).withColumn("at", at)
    tagged = own.transform(tagged) if own else tagged.withColumn("bucket", F.lit(0.0))
    bucket = F.col("bucket").cast("int")
    before = F.pmod(bucket - 1, F.lit(len(starts)))
    here = F.struct(bucket.alias("bucket"), F.lit(False).alias("extra"))
    there = F.struct(before.alias("bucket"), F.lit(True).alias("extra"))
    goes = F.when(F.col("at").isin(starts), F.array(here, there)).otherwise(F.array(here))
    dealt = tagged.select("doc_id", "text", "id", F.explode(goes).alias("g")).select("doc_id", "text", "id", "g.*")
    dealt = dealt.repartitionById(len(starts), "bucket").sortWithinPartitions("extra", "id", "text")
    return dealt.select("doc_id", "text", "extra").mapInArrow(_in_order, SCHEMA)
