"""Operator 6, a byte-level convolutional network in numpy.

Bytes are embedded, filters run over them, and the mean activation of each filter is taken over chunks of two
neighbouring blocks, so that chunks overlap by half and cover every byte. The maximum over a document's chunks
goes through one linear layer to a probability. Everything is learned: embedding, filters and output layer.

The network is fitted in one task from at most ``TRAIN_ROWS`` labelled documents, those with the smallest
hashes of their ids; the network is a few kilobytes. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import strings, text_of

TRAIN_ROWS, PARTS, PART_CHARS, EPOCHS, THRESHOLD = 2400, 4, 1 << 15, 14, 0.3
DIM, WIDTH, STRIDE, FILTERS, BLOCK = 4, 8, 2, 24, 128
SPOTS = BLOCK // STRIDE  # filter positions in a block
PHASES = WIDTH // STRIDE
PER_PHASE = SPOTS // PHASES
PAD = 256
GROUP_BYTES, TILE = 1 << 17, 128
_ONES = np.ones((1, PER_PHASE), dtype=np.float32)


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, DIM)).astype(np.float32),
            "filter": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, dtype=np.float32),
            "out": r.normal(0, 0.5, FILTERS).astype(np.float32),
            "bias": np.zeros(1, dtype=np.float32),
        }
        self.p["embed"][PAD] = 0


def lay_out(texts: list[bytes]):
    """Texts one after the other, each followed by padding to whole blocks, of at least what a filter looks ahead.

    (codes, blocks of each text, place of each block, filter positions in each block)
    """
    sizes = np.array([max(1, len(t)) for t in texts])
    blocks, laid = -(-sizes // BLOCK), -(-(sizes + WIDTH) // BLOCK)
    codes = np.full(int(laid.sum()) * BLOCK, PAD, dtype=np.int16)
    starts = np.cumsum(laid) - laid
    for text, at in zip(texts, (starts * BLOCK).tolist()):
        codes[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) + np.repeat(starts - first, blocks)
    spots = np.full(len(place), SPOTS, dtype=np.float32)
    spots[first + blocks - 1] = -(-(sizes - (blocks - 1) * BLOCK) // STRIDE)
    return codes, blocks, place, spots


def embedded(net: Net, codes: np.ndarray) -> np.ndarray:
    """DIM floats for each code; a row of the table is moved as one number."""
    return net.p["embed"].view(np.complex128).ravel().take(codes.astype(np.intp)).view(np.float32)


def block_sums(net: Net, codes: np.ndarray, place: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Activation of every filter summed over each block, in tiles that stay in the processor's cache.

    Positions whose windows don't overlap lie PHASES apart; their windows are the rows of a matrix as they stand in memory.
    """
    sums = np.zeros((len(place), FILTERS), dtype=np.float32)
    room = np.empty((TILE * PER_PHASE, FILTERS), dtype=np.float32)
    for at in range(0, len(place), TILE):
        here, n_spots = place[at : at + TILE], spots[at : at + TILE]
        n = int(here[-1] - here[0]) + 1  # the blocks between are padding, few and left out of the sums
        begin = int(here[0]) * BLOCK
        flat = embedded(net, codes[begin : begin + n * BLOCK + WIDTH])
        if len(flat) < (n * BLOCK + WIDTH) * DIM:  # the last text's padding ends here
            flat = np.concatenate([flat, np.zeros((n * BLOCK + WIDTH) * DIM - len(flat), dtype=np.float32)])
        if len(room) < n * PER_PHASE:
            room = np.empty((n * PER_PHASE, FILTERS), dtype=np.float32)
        short = np.flatnonzero(n_spots < SPOTS)
        for phase in range(PHASES):
            act, skip = room[: n * PER_PHASE], phase * STRIDE * DIM
            np.matmul(flat[skip : skip + n * BLOCK * DIM].reshape(-1, WIDTH * DIM), net.p["filter"], out=act)
            np.maximum(act, -net.p["shift"], out=act)  # max(x + shift, 0) = max(x, -shift) + shift
            by_block = act.reshape(n, PER_PHASE, FILTERS)
            some = np.matmul(_ONES, by_block)[here - here[0], 0]
            if len(short):
                inside = np.arange(phase, SPOTS, PHASES)[None, :] < n_spots[short, None]
                some[short] = (by_block[here[short] - here[0]] * inside[:, :, None]).sum(axis=1)
            sums[at : at + TILE] += some
    sums += spots[:, None] * net.p["shift"]
    return sums


def chunk_means(net: Net, codes, blocks, place, spots):
    """(mean activation by chunk and filter, first chunk of each text, filter positions by chunk)."""
    sums = block_sums(net, codes, place, spots)
    first = np.cumsum(blocks) - blocks
    # a chunk starts at each block and takes the next one in, but for the last block of a longer text
    pair = np.ones(len(sums), dtype=bool)
    pair[first + blocks - 1] = False
    both, n = sums.copy(), spots.copy()
    both[:-1] += sums[1:] * pair[:-1, None]
    n[:-1] += spots[1:] * pair[:-1]
    lone = ~pair & (np.repeat(blocks, blocks) > 1)
    means = both / n[:, None]
    means[lone] = -1  # covered by the chunk before it
    return means, first, n


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts))
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= GROUP_BYTES):
            size += len(texts[stop])
            stop += 1
        z = _tops(net, texts[start:stop]) @ net.p["out"] + net.p["bias"][0]
        out[start:stop] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
        start = stop
    return out


def _tops(net: Net, texts: list[bytes]) -> np.ndarray:
    means, first, _ = chunk_means(net, *lay_out(texts))
    return np.maximum.reduceat(means, first, axis=0)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam on the log-loss over whole texts; gradients reach the chunks that were the maximum.

    With no labelled text the probability is 1/2 for all; with labels of one class it leans to that class.
    """
    net = Net(seed)
    if not texts:
        net.p["out"][:] = 0
        return net
    rate = (labels.sum() + 1) / (len(labels) + 2)
    net.p["bias"][0] = np.log(rate / (1 - rate))
    r = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, size = 0, 32
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 5e-4
        for at in range(0, len(order), size):
            some = order[at : at + size]
            grads = _gradients(net, [texts[i] for i in some], labels[some])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.p["embed"][PAD] = 0
    return net


def _gradients(net: Net, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    codes, blocks, place, spots = lay_out(texts)
    means, first, n = chunk_means(net, codes, blocks, place, spots)
    tops = np.maximum.reduceat(means, first, axis=0)
    z = np.clip(tops @ net.p["out"] + net.p["bias"][0], -30, 30)
    dz = ((1 / (1 + np.exp(-z)) - y) / len(texts)).astype(np.float32)
    owner = np.repeat(np.arange(len(texts)), blocks)
    d_tops = dz[:, None] * net.p["out"][None, :]
    # the first chunk that reaches the maximum takes the gradient
    hit = means == tops[owner]
    rank = np.cumsum(hit, axis=0)
    base = rank[first] - hit[first]
    hit &= (rank - base[owner]) == 1
    d_chunk = np.where(hit, d_tops[owner] / n[:, None], 0).astype(np.float32)
    d_block = d_chunk.copy()
    goes = np.zeros(len(d_chunk), dtype=bool)
    goes[:-1] = True
    goes[first + blocks - 1] = False
    d_block[1:] += d_chunk[:-1] * goes[:-1, None]
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    codes = np.concatenate([codes, np.full(WIDTH, PAD, dtype=np.int16)])
    live = np.flatnonzero(np.abs(d_block).sum(axis=1))
    for at in range(0, len(live), TILE):
        some = live[at : at + TILE]
        mine = codes[place[some][:, None] * BLOCK + np.arange(BLOCK + WIDTH)]
        flat = embedded(net, mine.ravel()).reshape(len(some), -1)
        d_flat = np.zeros_like(flat)
        for phase in range(PHASES):
            skip = slice(phase * STRIDE * DIM, phase * STRIDE * DIM + BLOCK * DIM)
            rows = flat[:, skip].reshape(-1, WIDTH * DIM)
            live_act = (rows @ net.p["filter"] + net.p["shift"] > 0).reshape(len(some), PER_PHASE, FILTERS)
            inside = np.arange(phase, SPOTS, PHASES)[None, :] < spots[some, None]
            d_act = (d_block[some][:, None, :] * live_act * inside[:, :, None]).reshape(-1, FILTERS)
            grads["filter"] += rows.T @ d_act
            grads["shift"] += d_act.sum(axis=0)
            d_flat[:, skip] += (d_act @ net.p["filter"].T).reshape(len(some), -1)
        d_flat = d_flat.reshape(-1, DIM)
        for k in range(DIM):
            grads["embed"][:, k] += np.bincount(mine.ravel(), weights=d_flat[:, k], minlength=257)
    decay = 1e-4
    grads["embed"] += decay * net.p["embed"]
    grads["filter"] += decay * net.p["filter"]
    grads["out"] = tops.T @ dz + decay * net.p["out"]
    grads["bias"] = np.array([dz.sum()], dtype=np.float32)
    return grads


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def parts_of(text: Column, parts: int = PARTS, size: int = PART_CHARS) -> Column:
    """A text of at most ``parts * size`` characters, or that many of a longer one in parts spread evenly from its start to its end."""
    n = F.length(text)
    far = [F.substr(text, (F.lit(k) * (n - size) / F.lit(max(parts - 1, 1))).cast("int") + 1, F.lit(size)) for k in range(parts)]
    return F.when(n <= parts * size, F.array(text)).otherwise(F.array(*far))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Net:
    """Fit on the ``rows`` labelled documents outside the held-out fold whose ids have the smallest hashes.

    A text of more than PARTS * PART_CHARS characters is learned from in PARTS evenly spread parts, joined by a line end, so that the
    sample has a bound of bytes too; it is scored whole like any other. Null labels are left out; of several labels of one id the
    smallest counts, and so of several texts of one id. The fit runs in one task of the cluster; a few kilobytes come back.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(some), "id")
    texts = texts.select("id", "y", F.array_join(parts_of(F.col("text")), "\n").alias("text"))
    texts = texts.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    return fitted(texts.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", F.col("y").cast("float").alias("y")))


def fitted(sample: DataFrame) -> Net:
    """fit() on (text, y) in a task of the cluster; the sample is one partition."""

    def run(batches):
        texts, y = [], []
        for batch in batches:
            texts += [t.encode("utf-8") for t in strings(batch.column(0))]
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y, dtype=np.float32)).p)], type=pa.binary())], names=["net"])

    net, found = Net(), sample.mapInArrow(run, "net binary").first()
    net.p = pickle.loads(found["net"]) if found else fit([], np.zeros(0)).p
    return net


def score_column(net: Net, text_col: str = "text") -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scores(net, [t.encode("utf-8") for t in strings(texts)]), type=pa.float64())

    return F.arrow_udf(run, returnType="double")(text_of(text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (empty texts too), predicted; repeated rows score alike, a null id is not held out unless '' is."""
    net = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_column(net, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they were."""
    net = train(docs, labels, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return docs.select(row, score_column(net, text_col).alias("__s")).where(F.col("__s") >= THRESHOLD).select("__row.*")
