"""Operator 3, suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

A suffix array of the whole corpus is never in one place. It is cut into buckets in such a way that suffixes
with a common prefix of LENGTH bytes are always in one bucket:

1. Every window of LENGTH bytes is filed under its anchor, the leftmost of its GRAM-byte strings with the
   smallest hash. Equal windows have equal anchors at equal offsets, so only windows under one anchor string
   can be equal. A text has an anchor about every (LENGTH - GRAM) / 2 bytes, with the stretch of text that the
   windows under it span (its context). Anchors are gathered in flushes of about ``COMBINE``, in which equal
   contexts (by the 64-bit hashes of anchor and of context) become one entry with its number and its places.
2. Entries meet by anchor string. Strings that occur once in the corpus are dropped. Of each distinct context one place
   is asked for its bytes; all other places only wait for what is found in it.
3. The distinct contexts of an anchor string go to an enhanced suffix array, each with its multiplicity: suffixes of fewer than
   LENGTH bytes or with a unique prefix of LENGTH bytes (by rolling hash) are left out, the others are sorted by their bytes,
   and a stack scan over the common prefixes gives the lcp intervals of at least LENGTH. An interval whose suffixes differ in the
   byte to their left is a maximal repeat with all its occurrences; others lie inside a longer one. A context of
   several places is an interval of its own.
4. What is found goes back to the entries, from there to their places, and in one join to the texts.

An anchor string with very many contexts (a passage that many documents share has them at its ends) is no single bucket: its
suffixes are dealt by the hash of their first LENGTH bytes, and each such group is an interval of depth LENGTH. A string is
taken for such a one where a flush holds more than ``FREQUENT`` contexts of it (the flush then deals its entries by context, so that they
don't meet in one task) or where more than ``SPLIT`` meet. Of equal suffixes in a batch one is dealt, so a passage in
a third of all texts is as many entries as there are batches.

Everything between these steps travels in packed arrays, a row for each flush and hash range. There are so many ranges (pieces) that
about ``PIECE_BYTES`` of text are anchored in one, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import drop_table, free_shuffles, materialise, piece_bits, strings, text_of
from ouvidor.llm.words import mix

LENGTH, GRAM, FREQUENT, SPLIT = 200, 48, 64, 512
BUFFER, COMBINE, SORTED, SLICE, PIECE_BYTES = 1 << 16, 100_000, 1 << 18, 1000, 1 << 25
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_LETTERS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    size = 1
    while size < n:  # double the table
        take = min(size, n - size)
        out[size : size + take] = out[:take] * _U(pow(base, size, 1 << 64))
        size += take
    return out


class Hasher:
    """Polynomial hashes (mod 2**64) of any stretch of a buffer, from prefix sums."""

    _tables: dict[int, tuple] = {}

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        room = 1 << max(12, (n - 1).bit_length())
        if room not in self._tables:
            for large in [k for k in self._tables if k > 1 << 19]:
                del self._tables[large]
            self._tables[room] = (_powers(_BASE, room), _powers(pow(_BASE, -1, 1 << 64), room))
        self.up, self.down = self._tables[room]
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_LETTERS[codes] * self.up[: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def each(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] of them, then those of the next one."""
    return np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)


def anchors(codes: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Texts one after the other -> arrays (text, anchor hash, context hash, context begin, context end), in the buffer's positions."""
    empty = tuple(np.zeros(0, dtype=k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(codes) < length:
        return empty
    hasher = Hasher(codes)
    grams = mix(hasher.grams(gram))
    places = np.arange(len(grams), dtype=np.uint64)
    smallest = sliding_min((grams & ~_U(0xFFFFFF)) | places, length - gram + 1) & _U(0xFFFFFF)
    ends = np.cumsum(sizes)
    windows = each(ends - sizes, np.maximum(sizes - length + 1, 0))
    if not len(windows):
        return empty
    spot = smallest[windows].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    last = np.concatenate([first[1:], [len(spot)]]) - 1
    begin, end, p = windows[first], windows[last] + length, spot[first]
    context = mix(hasher.of(begin, end) + mix((end - begin).astype(np.uint64) * _U(1 << 20) + (p - begin).astype(np.uint64)))
    return np.searchsorted(ends, begin, side="right"), mix(~grams[p]), context, begin, end  # the smallest hashes are no even deal


#: What travels. k: number of an entry in its flush (-1: only says that the string is frequent); src, m: piece and number in it of a distinct context.
ENTRY = np.dtype([("k", "<i4"), ("h", "<u8"), ("c", "<u8"), ("n", "<i4"), ("size", "<i4"), ("id", "<i8"), ("t", "<i8"), ("a", "<i4"), ("often", "u1")])
PLACE = np.dtype([("doc", "<i4"), ("a", "<i4"), ("k", "<i4")])
MEMBER = np.dtype([("k", "<i4"), ("m", "<i4")])
CONTEXT = np.dtype([("h", "<u8"), ("src", "<i4"), ("m", "<i4"), ("n", "<i4"), ("size", "<i4")])
WINDOW = np.dtype([("w", "<u8"), ("src", "<i4"), ("m", "<i4"), ("at", "<i4")])
FOUND = np.dtype([("m", "<i4"), ("b", "<i4"), ("e", "<i4"), ("g", "<i8")])
ANSWER = np.dtype([("k", "<i4"), ("b", "<i4"), ("e", "<i4"), ("g", "<i8")])
SPAN = np.dtype([("a", "<i4"), ("e", "<i4")])


def rows_of(kind: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(next(iter(columns.values()))), dtype=kind)
    for name, values in columns.items():
        out[name] = values
    return out


def read(column, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=kind)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def split_by(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, its values packed) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cut = runs(keys)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(keys[i]), values[i:j].tobytes()


def union(owner: np.ndarray, a: np.ndarray, e: np.ndarray):
    """Stretches [a, e) -> the maximal runs (owner, a, e) that they cover, in order."""
    order = np.lexsort((a, owner))
    owner, a, e = owner[order].astype(np.int64), a[order].astype(np.int64), e[order].astype(np.int64)
    base = owner << 40
    reach = np.maximum.accumulate(e + base) if len(e) else e
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(a)]])[: len(first)] - 1
    return owner[first], a[first], reach[last] - base[last]


def batch_of(schema: str, **columns) -> pa.RecordBatch:
    """A batch of a schema, null where a column isn't given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(columns[k], type=kinds[t]) if k in columns else pa.nulls(n, kinds[t]) for k, t in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in fields])


_MARKS = "f long, piece int, entries binary, ids binary, ts binary, places binary"


def _mark_rows(length: int, gram: int, bits: int, frequent: int):
    """Texts (id, t, text) -> for each flush a row with its documents and places, and one for each piece with its entries."""

    def flush(f: int, ids: list, ts: list, parts: list):
        doc, h, c, a, e = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, h))
        doc, h, c, a, e = doc[order], h[order], c[order], a[order], e[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first, k = np.flatnonzero(new), np.cumsum(new) - 1
        ids, ts = np.array(ids, dtype=np.int64), np.array(ts, dtype=np.int64)
        yield batch_of(_MARKS, f=[f], ids=[ids.tobytes()], ts=[ts.tobytes()], places=[rows_of(PLACE, doc=doc, a=a, k=k).tobytes()])
        n = np.diff(np.append(first, len(h)))
        cut = runs(h[first])
        many = np.diff(cut) > frequent
        often = np.repeat(many, np.diff(cut))
        d = doc[first]
        entries = rows_of(ENTRY, k=np.arange(len(first)), h=h[first], c=c[first], n=n, size=(e - a)[first], id=ids[d], t=ts[d], a=a[first], often=often)
        say = entries[cut[:-1][many]]
        say["k"] = -1
        piece = np.concatenate([np.where(often, mix(entries["h"] + entries["c"]), entries["h"]), say["h"]]) >> _U(64 - bits)
        dealt = list(split_by(piece, np.concatenate([entries, say])))
        yield batch_of(_MARKS, f=[f] * len(dealt), piece=[p for p, _ in dealt], entries=[x for _, x in dealt])

    def run(batches):
        base, flushes = TaskContext.get().partitionId() << 32, 0
        ids, ts, parts, count, held, size = [], [], [], 0, [], 0

        def tile():
            nonlocal held, size, count
            sizes = np.array([len(x[2]) for x in held], dtype=np.int64)
            text, h, c, a, e = anchors(np.frombuffer(b"".join(x[2] for x in held), dtype=np.uint8), sizes, length, gram)
            # positions in the text: less where it starts in the buffer, plus where the stretch starts in the text
            shift = np.array([x[1] for x in held], dtype=np.int64) - (np.cumsum(sizes) - sizes)
            parts.append((np.array([x[0] for x in held], dtype=np.int64)[text], h, c, a + shift[text], e + shift[text]))
            count += len(h)
            held, size = [], 0

        for batch in batches:
            for key, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
                raw = text.encode("utf-8")
                if len(raw) < length:
                    continue
                for at in range(0, len(raw) - length + 1, BUFFER):  # a long text in stretches; each window is in one
                    part = raw[at : at + BUFFER + length - 1]
                    held.append((len(ids), at, part))
                    size += len(part)
                    if size >= BUFFER:
                        tile()
                ids.append(key)
                ts.append(t)
                if count >= COMBINE:  # documents stay whole in a flush
                    if held:
                        tile()
                    yield from flush(base + flushes, ids, ts, parts)
                    ids, ts, parts, count, flushes = [], [], [], 0, flushes + 1
        if held:
            tile()
        if parts:
            yield from flush(base + flushes, ids, ts, parts)

    return run


_MET = "f long, piece int, members binary, id long, t long, m int, h long, a int, size int, n long, often int"


def _meet(split: int):
    """Entries of a piece -> by flush, which distinct context each is (those of strings that occur once are gone); of each distinct context one place."""

    def run(table: pa.Table) -> pa.Table:
        piece, blobs = table["piece"][0].as_py(), table["entries"].to_pylist()
        rows = np.frombuffer(b"".join(blobs), dtype=ENTRY)
        f = np.repeat(np.array(table["f"].to_pylist(), dtype=np.int64), [len(x) // ENTRY.itemsize for x in blobs])
        order = np.lexsort((f, rows["c"], rows["k"] < 0, rows["h"]))
        rows, f = rows[order], f[order]
        cut = runs(rows["h"])
        live = np.repeat((np.add.reduceat(rows["n"].astype(np.int64), cut[:-1]) > 1) | (np.maximum.reduceat(rows["often"], cut[:-1]) > 0), np.diff(cut)) if len(rows) else np.zeros(0, dtype=bool)
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1]) | (rows["k"][1:] < 0)
        if len(rows):
            often = np.repeat((np.maximum.reduceat(rows["often"], cut[:-1]) > 0) | (np.add.reduceat(new.astype(np.int64), cut[:-1]) > split), np.diff(cut))
            rows = rows.copy()
            rows["often"] = often
        live &= rows["k"] >= 0
        rows, f, new = rows[live], f[live], new[live]
        first = np.flatnonzero(new)
        m = np.cumsum(new) - 1
        dealt = list(split_by(f, rows_of(MEMBER, k=rows["k"], m=m)))
        members = batch_of(_MET, f=[x for x, _ in dealt], piece=[piece] * len(dealt), members=[x for _, x in dealt])
        n = np.add.reduceat(rows["n"].astype(np.int64), first) if len(first) else first
        one = rows[first]
        asked = batch_of(_MET, piece=np.full(len(one), piece), id=one["id"], t=one["t"], m=np.arange(len(one)), h=one["h"].astype(np.uint64).view(np.int64), a=one["a"], size=one["size"], n=n, often=one["often"].astype(np.int32))
        return pa.Table.from_batches([members, asked])

    return run


_CUT = "kind int, piece int, marks binary, bytes binary"


def _cut_rows(length: int, bits: int):
    """Texts (id, t, text, wanted) -> contexts by the piece of their anchor string (kind 0), or, of frequent strings,
    windows by the piece of their hash (kind 1) and what is already found in the batch (kind 2)."""

    def windows(contexts: np.ndarray, raw: bytes):
        codes, sizes = np.frombuffer(raw, dtype=np.uint8), contexts["size"].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        room = sizes - length + 1
        owner, at = np.repeat(np.arange(len(contexts)), room), each(starts, room)
        hasher = Hasher(codes)
        w = mix(hasher.of(at, at + length) ^ contexts["h"][owner])
        order = np.argsort(w, kind="stable")
        w, owner, at = w[order], owner[order], (at - starts[owner])[order]
        cut = runs(w)
        first, many = cut[:-1], np.diff(cut)
        known = np.add.reduceat(contexts["n"][owner].astype(np.int64), first) > 1
        here = np.repeat(known, many)
        yield 2, contexts["src"][owner[here]], rows_of(FOUND, m=contexts["m"][owner[here]], b=at[here], e=at[here] + length)
        out = rows_of(WINDOW, w=w[first], src=np.where(known, -1, contexts["src"][owner[first]]), m=contexts["m"][owner[first]], at=at[first])
        yield 1, out["w"] >> _U(64 - bits), out

    def run(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            seen, parts, raws = set(), [], []
            offsets, struct = batch.column(3).offsets.to_numpy(), batch.column(3).values
            fields = {k: struct.field(k).to_numpy(zero_copy_only=False) for k in ("piece", "m", "h", "a", "size", "n", "often")}
            for i, (key, text) in enumerate(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), strings(batch.column(2)))):
                if key in seen:
                    continue  # a repeated row
                seen.add(key)
                raw, mine = text.encode("utf-8"), slice(offsets[i], offsets[i + 1])
                parts.append(np.arange(offsets[i], offsets[i + 1]))
                raws += [raw[a : a + s] for a, s in zip(fields["a"][mine].tolist(), fields["size"][mine].tolist())]
            if not raws:
                continue
            at = np.concatenate(parts)
            contexts = rows_of(CONTEXT, h=fields["h"][at].astype(np.int64).view(np.uint64), src=fields["piece"][at], m=fields["m"][at], n=np.minimum(fields["n"][at], 2**31 - 1), size=fields["size"][at])
            often, rows = fields["often"][at] > 0, []
            few = np.flatnonzero(~often)
            few = few[np.argsort(contexts["h"][few], kind="stable")]
            cut = runs(contexts["h"][few] >> _U(64 - bits))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                mine = few[i:j]
                rows.append((0, int(contexts["h"][mine[0]] >> _U(64 - bits)), contexts[mine].tobytes(), b"".join(raws[x] for x in mine.tolist())))
            much = np.flatnonzero(often)
            step = max(1, SORTED // (2 * length))
            for i in range(0, len(much), step):
                for kind, keys, values in windows(contexts[much[i : i + step]], b"".join(raws[x] for x in much[i : i + step].tolist())):
                    rows += [(kind, piece, x, b"") for piece, x in split_by(keys, values)]
            kinds, pieces, marks, raw = zip(*rows)
            yield batch_of(_CUT, kind=kinds, piece=pieces, marks=marks, bytes=raw)

    return run


class SuffixArray:
    """Enhanced suffix array of byte strings that occur ``n`` times each: ``order``, the positions of the suffixes of at least ``least`` bytes
    that may begin a maximal repeat, sorted by their bytes; ``lcp`` with the suffix before; ``left``, the byte before (-1: the string's start)."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, least: int, n: np.ndarray | None = None):
        self.least, self.ends = least, np.cumsum(sizes)
        self.starts = self.ends - sizes
        owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - least + 1, 0))
        at = each(self.starts, np.maximum(sizes - least + 1, 0))
        n = np.ones(len(sizes), dtype=np.int64) if n is None else n
        key = Hasher(codes).grams(least)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        key, at, owner = key[order], at[order], owner[order]
        left = np.where(at > self.starts[owner], codes[at - 1].astype(np.int16), -1)
        cut = runs(key)
        first, many = cut[:-1], np.diff(cut)
        if len(at):
            low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
            # a group whose suffixes all follow the same byte lies inside the group one byte before
            wanted = np.repeat(((many > 1) & ((low < 0) | (low != high))) | ((many == 1) & (n[owner[first]] > 1) & (low < 0)), many)
            key, at, owner, left = key[wanted], at[wanted], owner[wanted], left[wanted]
        self.at, self.owner, self.left, self.n = at, owner, left, n[owner]
        self.rest = self.ends[owner] - at
        self.lcp = np.zeros(len(at), dtype=np.int64)
        self._sort(codes, key)

    def _sort(self, codes: np.ndarray, key: np.ndarray) -> None:
        """Order the suffixes of each group by their bytes, eight at a time, as long as there are ties."""
        padded = np.concatenate([codes, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        place = np.arange(len(self.at))  # which suffix stands where
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        live, done = np.arange(len(place)), 0
        live = live[np.bincount(group.astype(np.int64))[group.astype(np.int64)] > 1] if len(live) else live
        group = group[live].astype(np.int64)
        while len(live):
            who = place[live]
            rest = np.minimum(self.rest[who] - done, 8)
            word = eight[np.minimum(self.at[who] + done, len(codes))]
            word = (word & _MASKS[np.maximum(rest, 0)]).byteswap()
            same = np.zeros(len(live), dtype=bool)
            same[1:] = (group[1:] == group[:-1]) & (word[1:] == word[:-1]) & (rest[1:] == rest[:-1])
            if (same[1:] != (group[1:] == group[:-1])).any():
                order = np.lexsort((rest, word, group))
                place[live], word, rest = who[order], word[order], rest[order]
                same[1:] = (group[1:] == group[:-1]) & (word[1:] == word[:-1]) & (rest[1:] == rest[:-1])
            pair = np.flatnonzero((group[1:] == group[:-1]) & (~same[1:] | (rest[1:] < 8))) + 1
            differ, common = word[pair] ^ word[pair - 1], np.zeros(len(pair), dtype=np.int64)
            for b in range(8):
                common += differ >> _U(56 - 8 * b) == 0
            self.lcp[live[pair]] = done + np.minimum(common, np.maximum(np.minimum(rest[pair], rest[pair - 1]), 0))
            tied = same & (rest == 8)
            tied[:-1] |= tied[1:]
            group = np.cumsum(~same)[tied]
            live = live[tied]
            done += 8
        for name in ("at", "owner", "left", "n", "rest"):
            setattr(self, name, getattr(self, name)[place])

    def intervals(self, simple: bool = True) -> Iterator[tuple[int, int, int]]:
        """Maximal repeats (length, first, last): intervals of at least ``least`` whose suffixes differ to their left; strings of several places alone.

        Without ``simple``, those of one or two suffixes are left to spans(), which treats them all at once.
        """
        edge = np.append(np.flatnonzero(self.lcp < self.least), len(self.lcp)) if len(self.lcp) else np.zeros(1, dtype=np.int64)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo <= 2 and not simple:
                continue
            for i in range(lo, hi):  # a string of several places is an interval unless the one around it is as long
                around = max(int(self.lcp[i]) if i > lo else 0, int(self.lcp[i + 1]) if i + 1 < hi else 0)
                if self.n[i] > 1 and self.left[i] < 0 and self.rest[i] > around:
                    yield int(self.rest[i]), i, i
            stack: list[tuple[int, int]] = []
            for i, value in enumerate([*self.lcp[lo + 1 : hi].tolist(), -1], lo + 1):
                start = i - 1
                while stack and stack[-1][0] > value:
                    length, start = stack.pop()
                    seen = self.left[start:i]
                    if seen[0] < 0 or (seen != seen[0]).any():
                        yield length, start, i - 1
                if value >= self.least and (not stack or stack[-1][0] < value):
                    stack.append((value, start))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, begin, end) of everything that a maximal repeat covers: for each place its longest one."""
        reach = np.where((self.n > 1) & (self.left < 0), self.rest, 0)
        first = self.lcp < self.least
        follows = np.concatenate([~first[1:], [False]])[: len(first)]
        two = np.flatnonzero(first & follows & ~np.concatenate([follows[1:], [False]])[: len(first)])
        two = two[(self.left[two] != self.left[two + 1]) | (self.left[two] < 0)]
        for i in (two, two + 1):
            reach[i] = np.maximum(reach[i], self.lcp[two + 1])
        for length, a, b in self.intervals(simple=False):
            np.maximum(reach[a : b + 1], length, out=reach[a : b + 1])
        hit = np.flatnonzero(reach)
        begin = self.at[hit] - self.starts[self.owner[hit]]
        return self.owner[hit], begin, begin + reach[hit]


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (length, [(text, offset), ...]) of strings of at least ``least`` bytes that occur twice and can be made longer
    neither to the left nor to the right in all places. The start of a text counts as a byte of its own."""
    sa = SuffixArray(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64), least)
    return [(length, [(int(sa.owner[i]), int(sa.at[i] - sa.starts[sa.owner[i]])) for i in range(a, b + 1)]) for length, a, b in sa.intervals()]


_FOUND = "piece int, found binary"


def _look(length: int, groups: bool):
    """Contexts, windows or finds of one piece -> finds by the piece of their context."""

    def sorted_contexts(table):
        contexts, raw = read(table["marks"], CONTEXT), np.frombuffer(b"".join(table["bytes"].to_pylist()), dtype=np.uint8)
        sizes = contexts["size"].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((contexts["m"], contexts["src"], contexts["h"]))
        new = np.ones(len(order), dtype=bool)  # repeated rows of a text bring their contexts again
        new[1:] = (contexts["src"][order][1:] != contexts["src"][order][:-1]) | (contexts["m"][order][1:] != contexts["m"][order][:-1])
        order = order[new]
        cut, total, first = runs(contexts["h"][order]), 0, 0
        weight = np.cumsum(np.concatenate([[0], sizes[order]]))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            total = weight[j] - weight[first]
            if total >= SORTED or j == len(order):  # the contexts of an anchor string stay together
                mine = order[first:j]
                first = j
                some = contexts[mine]
                yield some, SuffixArray(raw[each(starts[mine], sizes[mine])], sizes[mine], length, some["n"].astype(np.int64))

    def run(table: pa.Table) -> pa.Table:
        kind, piece, out, number = table["kind"][0].as_py(), table["piece"][0].as_py(), [], 0
        if kind == 2:
            return pa.table({"piece": table["piece"], "found": table["marks"]})
        if kind == 1:
            rows = read(table["marks"], WINDOW)
            rows = rows[np.argsort(rows["w"], kind="stable")]
            cut = runs(rows["w"])
            twice = np.repeat((np.diff(cut) > 1) & (np.maximum.reduceat(rows["src"], cut[:-1]) >= 0), np.diff(cut)) & (rows["src"] >= 0)
            rows = rows[twice]
            out.append((rows["src"], rows_of(FOUND, m=rows["m"], b=rows["at"], e=rows["at"] + length)))
        else:
            for contexts, sa in sorted_contexts(table):
                if groups:
                    for size, a, b in sa.intervals():
                        owner = sa.owner[a : b + 1]
                        begin = sa.at[a : b + 1] - sa.starts[owner]
                        out.append((contexts["src"][owner], rows_of(FOUND, m=contexts["m"][owner], b=begin, e=begin + size, g=np.full(len(owner), piece << 40 | number))))
                        number += 1
                else:
                    owner, b, e = union(*sa.spans())
                    out.append((contexts["src"][owner], rows_of(FOUND, m=contexts["m"][owner], b=b, e=e)))
        if not out:
            return pa.Table.from_batches([batch_of(_FOUND, piece=[], found=[])])
        dealt = list(split_by(np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])))
        return pa.Table.from_batches([batch_of(_FOUND, piece=[p for p, _ in dealt], found=[x for _, x in dealt])])

    return run


_ANSWERS = "f long, answers binary"


def _answer(members: pa.Table, found: pa.Table) -> pa.Table:
    """Finds in the distinct contexts of a piece -> finds in the entries of each flush."""
    hits = read(found["found"], FOUND) if len(found) else np.zeros(0, dtype=FOUND)
    rows = []
    if len(hits):
        hits = hits[np.argsort(hits["m"], kind="stable")]
        for f, blob in zip(members["f"].to_pylist(), members["members"].to_pylist()):
            mine = np.frombuffer(blob, dtype=MEMBER)
            lo, hi = np.searchsorted(hits["m"], mine["m"]), np.searchsorted(hits["m"], mine["m"], side="right")
            at = each(lo, hi - lo)
            if len(at):
                rows.append((f, rows_of(ANSWER, k=np.repeat(mine["k"], hi - lo), b=hits["b"][at], e=hits["e"][at], g=hits["g"][at]).tobytes()))
    return pa.Table.from_batches([batch_of(_ANSWERS, f=[x for x, _ in rows], answers=[x for _, x in rows])])


_SPANS = "id long, t long, spans binary"
_GROUPS = "grp long, length int, id long, t long, offset int"


def _to_places(groups: bool):
    """Finds in the entries of a flush -> the maximal runs of each of its documents, or each place of each group."""

    def run(flushes: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([batch_of(_GROUPS, grp=[]) if groups else batch_of(_SPANS, id=[])])
        if not len(flushes) or not len(answers):
            return empty
        ids, ts, places = read(flushes["ids"], "<i8"), read(flushes["ts"], "<i8"), read(flushes["places"], PLACE)
        hits = read(answers["answers"], ANSWER)
        hits = hits[np.argsort(hits["k"], kind="stable")]
        lo, hi = np.searchsorted(hits["k"], places["k"]), np.searchsorted(hits["k"], places["k"], side="right")
        at, doc, a = each(lo, hi - lo), np.repeat(places["doc"], hi - lo), np.repeat(places["a"], hi - lo)
        if groups:
            return pa.Table.from_batches([batch_of(_GROUPS, grp=hits["g"][at], length=hits["e"][at] - hits["b"][at], id=ids[doc], t=ts[doc], offset=a + hits["b"][at])])
        doc, a, e = union(doc, a + hits["b"][at], a + hits["e"][at])
        dealt = list(split_by(doc, rows_of(SPAN, a=a, e=e)))
        which = np.array([d for d, _ in dealt], dtype=np.int64)
        return pa.Table.from_batches([batch_of(_SPANS, id=ids[which], t=ts[which], spans=[x for _, x in dealt])])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _find(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, frequent: int, split: int, groups: bool, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    bits = piece_bits(spark, total, piece_bytes)
    texts = keyed(docs, id_col, text_col)
    marks = materialise(texts.mapInArrow(_mark_rows(length, gram, bits, frequent), _MARKS), "marks")
    met = materialise(marks.where("piece is not null").select("f", "piece", "entries").groupBy("piece").applyInArrow(_meet(split), _MET), "met")
    flushes = materialise(marks.where("piece is null").select("f", "ids", "ts", "places"), "flushes")
    drop_table(marks)
    free_shuffles(spark)
    wanted = met.where("id is not null").groupBy("id", "t").agg(F.collect_list(F.struct("piece", "m", "h", "a", "size", "n", "often")).alias("wanted"))
    cut = texts.join(wanted.hint("shuffle_hash"), ["id", "t"]).select("id", "t", "text", "wanted").mapInArrow(_cut_rows(length, bits), _CUT)
    found = materialise(cut.groupBy("kind", "piece").applyInArrow(_look(length, groups), _FOUND), "found")
    free_shuffles(spark)
    members = met.where("members is not null").select("f", "piece", "members")
    answers = members.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(_answer, _ANSWERS)
    out = flushes.groupBy("f").cogroup(answers.groupBy("f")).applyInArrow(_to_places(groups), _GROUPS if groups else _SPANS)
    out = materialise(out, "repeats")
    for table in (flushes, met, found):
        drop_table(table)
    free_shuffles(spark)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT, split: int = SPLIT, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The maximal repeated runs of all texts of ``docs`` that have some: id, t (the text's hash), spans (packed SPAN)."""
    found = _find(docs, id_col, text_col, length, gram, frequent, split, False, piece_bytes)
    return found.groupBy("id", "t").agg(F.max("spans").alias("spans"))  # repeated rows have the same


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Repeat groups with all their occurrences: grp, length (bytes), doc_id, offset (in bytes). Each group is maximal within the contexts of its
    anchor string, so a passage of several anchors is a chain of groups that overlap. Null texts are empty; a null id stays null; repeated
    rows are occurrences each. Every anchor string is one bucket here, however many contexts it has."""
    found = _find(docs, id_col, text_col, length, gram, 1 << 40, 1 << 40, True)
    return found.select("grp", "length", F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "offset")


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, e in runs:
        kept.append(raw[at:a])
        at = e
    kept.append(raw[at:])
    return b"".join(kept)


def _joined(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Every row of ``docs`` as __row with its text and its repeated runs (null: none)."""
    found = spans(docs, id_col, text_col, **options).withColumnRenamed("spans", "__spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    text = text_of(text_col)
    rows = docs.select(row, text.alias("__text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("t"))
    return rows.join(found.hint("shuffle_hash"), ["id", "t"], "left")


def _apply(finish, schema: str) -> Column:
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for text, blob in zip(strings(texts), found.to_pylist()):
            raw, runs_ = text.encode("utf-8"), np.frombuffer(blob or b"", dtype=SPAN).tolist()
            rows.append(finish(raw, runs_, without(raw, runs_)))
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = [x.split() for x in schema.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], type=kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    return F.arrow_udf(run, returnType=schema)("__text", "__spans")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts, and texts shorter than LENGTH, lose nothing; of equal texts of LENGTH bytes or more
    all lose everything; repeated rows count as places elsewhere; extra columns are ignored.
    """

    def finish(raw, runs, kept):
        return len(raw), sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept).hexdigest()

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    done = _apply(finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _joined(plain, "doc_id", "text", **options).select("__row.doc_id", done.alias("r")).select("doc_id", "r.*")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the repeated bytes out of its texts, all rows and columns kept; ``size_col``, where it exists,
    follows the text. Bytes of a character that was cut in two go with it; a null text stays null."""

    def finish(raw, runs, kept):
        text = kept.decode("utf-8", errors="ignore")
        return text, len(text)

    joined = _joined(docs, id_col, text_col, **options).select("__row", _apply(finish, "text string, n long").alias("__new"))
    new = {text_col: F.when(F.col(f"__row.`{text_col}`").isNotNull(), F.col("__new.text")), size_col: F.col("__new.n")}
    return joined.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
