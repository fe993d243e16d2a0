"""Operator 5, token counts by finite-state transducers.

Two deterministic machines run one after the other over the bytes of a text.

* The *splitter* marks where matches of the vocabulary's pattern begin. It has 8 states and reads symbols (a
  character's class with what the pattern looks ahead for). Every stretch of CHUNK symbols is a map of states
  to states; the maps are composed by a parallel prefix scan, which gives each stretch its entry state.
* The *merger* reads the bytes of a match. Its state is the longest suffix read that still begins a token, with
  the last token and the relative token count of every prefix from there on; that decides the encoding of every longer
  prefix, so the machine is deterministic. A transition carries the change of the token count (it may be negative).
  States and transitions are compiled when a text first needs them, as far as the table has room; a full table is
  dropped and compiled anew. The state maps of matches are constant (a match starts at the initial state), so
  all matches run side by side, and a text's count is the sum of its transitions.

Why a state decides: a token sequence is the encoding of its bytes if and only if each two neighbours are the
encoding of theirs. So the last token of a prefix is the one suffix that is a token and fits the last token of the
prefix before it, and no suffix longer than what still begins a token can be one.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from ouvidor.llm.bpe import json_encoding, json_vocabulary
from ouvidor.llm.common import strings, text_of

LIMIT, BUFFER, CHUNK, MOST_STATES, MOST_PAIRS = 512, 1 << 20, 64, 400_000, 300_000

# symbols: letter, number, other, apostrophe that begins 's-like or 're-like, blank or other white space before a
# character that is none (n) or before white space or the end (w), rest of a character, start of a text
LET, NUM, OTH, AP1, AP2, SN, SW, WN, WW, CONT, RESET = range(11)
# states: fresh, one blank that what follows may take in, in letters, in numbers, in others, in white space, one or two more of a contraction
FRESH, BLANK, IN_LET, IN_NUM, IN_OTH, IN_WS, MORE1, MORE2 = range(8)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a match begins) by symbol and state."""
    to, begins = np.zeros((11, 8), dtype=np.uint8), np.zeros((11, 8), dtype=bool)
    runs = {LET: IN_LET, NUM: IN_NUM, OTH: IN_OTH}
    for s in range(8):
        for symbol, run in runs.items():
            to[symbol, s], begins[symbol, s] = run, s not in (BLANK, run)
        for symbol, rest in ((AP1, MORE1), (AP2, MORE2)):
            joins = s in (BLANK, IN_OTH)
            to[symbol, s], begins[symbol, s] = (IN_OTH, False) if joins else (rest, True)
        to[SN, s], begins[SN, s] = BLANK, True
        to[WN, s], begins[WN, s] = FRESH, True
        for symbol in (SW, WW):
            to[symbol, s], begins[symbol, s] = IN_WS, s != IN_WS
        to[CONT, s], to[RESET, s] = s, FRESH
    to[LET, MORE1], begins[LET, MORE1] = FRESH, False
    to[LET, MORE2], begins[LET, MORE2] = MORE1, False
    return to, begins


_TO, _BEGINS = splitter()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: LET, NUM, OTH, SW for the blank, WW for other white space.

    The tokenizer library's own regex engine is asked, since engines differ in the Unicode version they know.
    """
    text = "".join(map(chr, [*range(0xD800), *[0xFFFF] * 0x800, *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTH, dtype=np.uint8)
    for pattern, value in ((r"\p{L}+", LET), (r"\p{N}+", NUM), (r"\s+", WW)):
        # what is left when the matches are taken out
        rest = Split(Regex(pattern), "removed").pre_tokenize_str(text)
        inside = np.ones(0x110000, dtype=bool)
        for _, (a, e) in rest:
            inside[a:e] = False
        table[inside] = value
    table[0x20] = SW
    return table


def symbols(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other -> (symbol of every byte, bytes); RESET stands in front of each text, over a byte 0."""
    raw = np.frombuffer(("\x00" + "\x00".join(parts)).encode("utf-8"), dtype=np.uint8)
    points = np.frombuffer(("\x00" + "\x00".join(parts)).encode("utf-32-le"), dtype=np.uint32)
    kind = classes()[points]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    kind[starts] = RESET
    n = len(points)
    after = np.full(n + 2, RESET, dtype=np.uint8)
    after[:n] = kind
    white = (after == SW) | (after == WW)
    solid = ~white & (after != RESET)
    one = solid[1 : n + 1]
    symbol = kind.copy()
    symbol[(kind == SW) & one] = SN
    symbol[(kind == WW) & one] = WN
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        p = np.full(n + 2, 0, dtype=np.uint32)
        p[:n] = points
        p[starts] = 0
        a, b = p[quote + 1], p[quote + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        symbol[quote[short]] = AP1
        symbol[quote[long]] = AP2
    if len(raw) == n:
        return symbol, raw
    out = np.full(len(raw), CONT, dtype=np.uint8)
    out[(raw & 0xC0) != 0x80] = symbol
    return out, raw


def entry_states(symbol: np.ndarray) -> np.ndarray:
    """The splitter's state in front of every symbol, by composing the state maps of chunks in a prefix scan."""
    n = len(symbol)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, CONT, dtype=np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    flat = _TO.reshape(-1)
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = flat[(row.astype(np.uint16) * 8)[:, None] + maps]
    shift = 1
    while shift < chunks:  # maps[i] becomes the map of everything up to chunk i
        later = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), axis=1)
        maps = np.concatenate([maps[:shift], later])
        shift *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), dtype=np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = flat[row.astype(np.uint16) * 8 + state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def match_starts(symbol: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_BEGINS.reshape(-1)[symbol.astype(np.uint16) * 8 + entry_states(symbol)])


class Cells:
    """Open-addressing table of transitions: state * 256 + byte -> next state * 256 + change of the count + 128."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.values, self.used = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.int32), 0

    def _slot(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter keys that are new and differ."""
        self.used += len(keys)
        if self.used * 5 > len(self.keys) * 2:
            old = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = len(self.keys)
            while self.used * 5 > size:
                size *= 2
            self.keys, self.values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)


class Merger:
    """The transducer of the merges, compiled on demand."""

    def __init__(self, path: str, pattern: str, most: int = MOST_STATES):
        self.ids, self.added = json_vocabulary(path)
        self.encoding = json_encoding(path, pattern)
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.begins = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.most, self.compiled = most, 0
        self.fits_cache: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.cells = Cells()
        self.endings: dict[bytes, list[tuple[int, int]]] = {}
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.state(b"", [-1], [0])

    def state(self, suffix: bytes, lasts, counts) -> int:
        """Number of the state: suffix, and for its start and each of its bytes the last token there and the count relative to now."""
        key = suffix + array("i", lasts).tobytes() + array("h", counts).tobytes()
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        return found

    def unpack(self, state: int):
        key = self.states[state]
        n = (len(key) - 6) // 7
        return key[:n], array("i", key[n : 5 * n + 4]), array("h", key[5 * n + 4 :])

    def fits(self, first: int, second: int) -> bool:
        key = first << 20 | second
        found = self.fits_cache.get(key)
        if found is None:
            if len(self.fits_cache) >= MOST_PAIRS:
                self.fits_cache.clear()
            found = self.encoding._encode_single_piece(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
            self.fits_cache[key] = found
        return found

    def transition(self, state: int, byte: int) -> int:
        suffix, lasts, counts = self.unpack(state)
        longer = suffix + bytes([byte])
        while longer not in self.begins:
            longer = longer[1:]
        ends = self.endings.get(longer)
        if ends is None:
            ends = [(k, self.ids[longer[-k:]]) for k in range(len(longer), 0, -1) if longer[-k:] in self.ids]
            self.endings[longer] = ends
        for size, token in ends:
            before = lasts[len(lasts) - size]
            if before < 0 or self.fits(before, token):
                break
        change = counts[len(counts) - size] + 1
        keep = len(longer)
        new = self.state(longer, [*lasts[len(lasts) - keep :], token], [*(c - change for c in counts[len(counts) - keep :]), 0])
        self.compiled += 1
        return new * 256 + change + 128

    def counts(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token count of each match [begin, end) of ``raw``; all matches advance byte by byte together."""
        total = np.zeros(len(begin), dtype=np.int64)
        order = np.argsort(begin - end, kind="stable")  # the longest first
        sizes = (end - begin)[order]
        at, state, sums = begin[order], np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right").tolist() if len(sizes) else []
        for step, n in enumerate(live):
            keys = state[:n] << 8 | raw[at[:n] + step]
            cell = self.cells.get(keys)
            missing = np.flatnonzero(cell < 0)
            if len(missing):
                new, back = np.unique(keys[missing], return_inverse=True)
                made = np.array([self.transition(k >> 8, k & 255) for k in new.tolist()], dtype=np.int32)
                self.cells.put(new, made)
                cell[missing] = made[back]
            state[:n] = cell >> 8
            sums[:n] += (cell & 255) - 128
        total[order] = sums
        if len(self.states) > self.most:
            self.reset()
        return total


@lru_cache(maxsize=2)
def merger(path: str, pattern: str) -> Merger:
    return Merger(path, pattern)


def count_texts(machine: Merger, texts: list[str]) -> np.ndarray:
    """Tokens of each whole text; strings of added tokens inside a text count as one token each."""
    parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        for token in machine.added:
            if token in text:
                pieces = [x for p in pieces for x in p.split(token)]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    out = extra
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop]) <= BUFFER):
            size += len(parts[stop])
            stop += 1
        symbol, raw = symbols(parts[at:stop])
        begin = match_starts(symbol)
        resets = np.flatnonzero(symbol == RESET)
        if len(begin):
            end = np.append(begin[1:], len(raw))
            text = np.searchsorted(resets, begin, side="right") - 1
            # a match ends where its text does
            limit = np.append(resets[1:], len(raw))[text]
            per = np.bincount(text, weights=machine.counts(raw, begin, np.minimum(end, limit)), minlength=stop - at)
            np.add.at(out, np.array(owner[at:stop]), per.astype(np.int64))
        at = stop
    return out


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit. Null and empty texts have no tokens; repeated rows repeat."""

    def run(texts: pa.Array) -> pa.Array:
        whole = list(strings(texts))
        n = count_texts(merger(path, pattern), whole)
        sizes = [len(t.encode("utf-8")) for t in whole]
        return pa.StructArray.from_arrays([pa.array(sizes, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(n > limit, type=pa.bool_())], names=["n_bytes", "n_tokens", "over_limit"])

    udf = F.arrow_udf(run, returnType="n_bytes long, n_tokens long, over_limit boolean")
    return docs.select(F.col(id_col).alias("doc_id"), udf(text_of(text_col)).alias("r")).select("doc_id", "r.*")
