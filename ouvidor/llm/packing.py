"""Operator 2, packing: online best-fit with a fixed number of open windows.

Each partition keeps at most ``open_windows`` partly filled windows. Of a document, whole windows are
cut off first; what remains goes into the window that it leaves least room in. If it fits nowhere and
all windows are open, the fullest one is topped up by the head of the piece and emitted, and the tail
is placed anew. At the end of a partition the open windows are merged by filling the fullest from the
emptiest, which leaves one partial window at most; those of ``GROUP`` partitions are merged the same way
in a second small job, and the last partial window of a group is cut into powers of two, which need no padding.
Memory: ``open_windows + 1`` windows and one document. No text is shuffled; of the ids only partial
windows are, one for each partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.bpe import encode_with_added, json_encoding
from ouvidor.llm.common import materialise, strings, text_of

CAPACITY, OPEN_WINDOWS, GROUP, END_ID = 1024, 8, 64, 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Windows of one partition; finished pieces gather in ``out`` as tuples in PIECE's order."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS):
        self.next_id, self.capacity, self.most = first_id, capacity, open_windows
        self.windows: list[list] = []  # each [used, [(doc, start, ids, doc_tokens), ...]]
        self.out: list[tuple] = []

    def emit(self, window) -> None:
        offset = 0
        for doc, start, ids, total in window[1]:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def document(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.emit([self.capacity, [(doc, at, ids[at : at + self.capacity], len(ids))]])
        if whole < len(ids):
            self.place(doc, whole, ids[whole:], len(ids))

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            fits = [w for w in self.windows if w[0] + len(ids) <= self.capacity]
            if fits:
                self.add(max(fits, key=lambda w: w[0]), doc, start, ids, total)
                return
            if len(self.windows) < self.most:
                self.windows.append([len(ids), [(doc, start, ids, total)]])
                return
            fullest = max(self.windows, key=lambda w: w[0])
            room = self.capacity - fullest[0]
            self.add(fullest, doc, start, ids[:room], total)
            start, ids = start + room, ids[room:]

    def add(self, window, doc, start, ids, total) -> None:
        window[1].append((doc, start, ids, total))
        window[0] += len(ids)
        if window[0] == self.capacity:
            self.windows = [w for w in self.windows if w is not window]
            self.emit(window)

    def merge(self) -> list[tuple]:
        """Fill the fullest windows from the emptiest; returns the pieces of the one that stays partial."""
        while len(self.windows) > 1:
            self.windows.sort(key=lambda w: w[0])
            emptiest, fullest = self.windows[0], self.windows[-1]
            room = self.capacity - fullest[0]
            doc, start, ids, total = emptiest[1].pop()
            emptiest[0] -= len(ids)
            take = min(room, len(ids))
            if take < len(ids):
                emptiest[1].append((doc, start + take, ids[take:], total))
                emptiest[0] += len(ids) - take
            if not emptiest[1]:
                self.windows.remove(emptiest)
            self.add(fullest, doc, start, ids[:take], total)
        left = self.windows[0][1] if self.windows else []
        self.windows = []
        return left

    def finish(self, left: list[tuple]) -> None:
        """Cut what is left into sequences whose lengths are powers of two, the largest first."""
        rest, size = list(left), sum(len(p[2]) for p in left)
        while rest:
            room, window = 1 << (size.bit_length() - 1), []
            size -= room
            used = room
            while room:
                doc, start, ids, total = rest.pop(0)
                take = min(room, len(ids))
                window.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.insert(0, (doc, start + take, ids[take:], total))
                room -= take
            self.emit([used, window])


def _batch(rows: list[tuple], ids: list, names: list[str], partition: int) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], type=pa.int64()) for i in range(7)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([partition] * len(rows), type=pa.int64()), pa.array(ids, type=pa.binary())], names=names)


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack all documents of ``docs`` into sequences of at most ``capacity`` ids (a power of two); one row a piece, as PIECE.

    A document's ids are those of its text with added tokens by the JSON vocabulary at ``path``, then
    END_ID; a null or empty text has only the latter. Repeated rows are packed each on its own; a null
    id stays null. Extra columns are ignored. An empty table gives no rows.
    """
    names = [c.split()[0] for c in PIECE.split(", ")] + ["part", "ids"]

    def run(batches):
        part = TaskContext.get().partitionId()
        packer, encoding = Packer(part << 32, capacity, open_windows), json_encoding(path, pattern)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                packer.document(doc, np.asarray([*encode_with_added(encoding, text), END_ID], dtype="<u4"))
                if len(packer.out) >= 20_000:
                    rows, packer.out = packer.out, []
                    yield _batch(rows, [None] * len(rows), names, part)
        left = packer.merge()
        yield _batch(packer.out, [None] * len(packer.out), names, part)
        rows = [(doc, start, len(ids), None, total, None, None) for doc, start, ids, total in left]
        yield _batch(rows, [ids.tobytes() for _, _, ids, _ in left], names, part)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    placed = materialise(texts.mapInArrow(run, f"{PIECE}, part long, ids binary"), "packed")

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "doc_id", "start"], kind="stable")
        packer = Packer((1 << 62) + (int(pdf["part"].iloc[0]) // GROUP << 24), capacity, open_windows)
        for row in pdf.itertuples():
            packer.place(None if pd.isna(row.doc_id) else int(row.doc_id), row.start, np.frombuffer(row.ids, dtype="<u4"), row.doc_tokens)
        packer.finish(packer.merge())
        out = pd.DataFrame(packer.out, columns=names[:7])
        return out.astype({"doc_id": "Int64"})

    partial = placed.where("ids is not null").groupBy(F.expr(f"part div {GROUP}"))
    return placed.where("ids is null").select(*names[:7]).unionByName(partial.applyInPandas(rest, PIECE))
