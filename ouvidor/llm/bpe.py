"""Operator 1, byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split beforehand at places where a match of the pattern always ends and another one
begins, so that no single call sees a whole book and no regex runs over millions of blanks:

* between an ASCII letter, digit or mark and a following space or line break;
* in a long run of white space, before its last character if a word follows (the pattern itself ends
  a match there).

A run of white space is then one match and goes to the merge loop directly.
Decoding joins the bytes of the ids; it never goes through text, so ids that cut a character in two
come back as the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import per_text, text_of

PIECE_CHARS = 1 << 16
LONG_BLANKS = 256
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?)])(?=[ \n])")
#: Unicode white space, as ``\s`` of the rank files' pattern has it (Python's ``\s`` has four more).
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BLANKS = re.compile(f"[{WHITE}]{{{LONG_BLANKS},}}")


@lru_cache(maxsize=8)
def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies written as JSON."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def json_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ids by token bytes, ids of added tokens) of a byte-level BPE file; its merges must be in id order."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    alphabet, vocab = byte_alphabet(), whole["model"]["vocab"]
    added = {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    if order != sorted(set(order)):
        raise ValueError(f"{path}: ids don't follow the order of the merges")
    return ranks, added


@lru_cache(maxsize=4)
def json_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a JSON file in the rank form; added tokens count as special."""
    ranks, added = json_vocabulary(path)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def pieces(text: str, limit: int = PIECE_CHARS):
    """Cut ``text`` at safe places: yields (piece, is one match of white space)."""
    if len(text) <= limit and not (len(text) > LONG_BLANKS and _BLANKS.search(text)):
        if text:
            yield text, False
        return
    at = 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from _words(text, at, run.start(), limit)
        yield text[run.start() : end], True
        at = end
    yield from _words(text, at, len(text), limit)


def _words(text: str, at: int, end: int, limit: int):
    while at < end:
        cut = _SAFE.search(text, at + limit, end) if end - at > limit else None
        stop = cut.start() if cut else end
        yield text[at:stop], False
        at = stop


def encode_text(encoding: tiktoken.Encoding, text: str, limit: int = PIECE_CHARS) -> list[int]:
    """Ids of the whole text, each match of the pattern on its own, special strings as ordinary text."""
    if len(text) <= LONG_BLANKS:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece, blank in pieces(text, limit):
        ids += encoding._encode_single_piece(piece) if blank else encoding.encode_ordinary(piece)
    return ids


def encode_with_added(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """As encode_text, but the strings of added tokens inside the text become their ids."""
    added = {s: encoding.encode_single_token(s) for s in encoding.special_tokens_set if s in text}
    if not added:
        return encode_text(encoding, text)
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
        ids += [added[part]] if part in added else encode_text(encoding, part)
    return ids


def decode_ids(encoding: tiktoken.Encoding, ids) -> bytes:
    return encoding.decode_bytes(list(ids))


def id_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with its text's ids as array<int> in column ``to`` (null text: empty array)."""
    udf = per_text(lambda t: (encode_text(rank_encoding(path, pattern), t),), "ids array<int>")
    return docs.withColumn(to, udf(text_of(text_col))["ids"])


def decode(frame: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """``frame`` with the raw bytes of its ids in ``to``; null ids give null, an unknown id fails the row's task."""
    def run(ids: pa.Array) -> pa.Array:
        e = rank_encoding(path, pattern)
        return pa.array([None if x.as_py() is None else decode_ids(e, x.as_py()) for x in ids], type=pa.binary())

    return frame.withColumn(to, F.arrow_udf(run, returnType="binary")(F.col(ids_col)))


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and give both digests: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts give 0 tokens and the digest of no bytes; repeated rows give repeated results.
    """

    def row(text: str):
        e = rank_encoding(path, pattern)
        ids = encode_text(e, text)
        return len(ids), hashlib.sha256(id_bytes(ids)).hexdigest(), hashlib.sha256(decode_ids(e, ids)).hexdigest()

    udf = per_text(row, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_col).alias("doc_id"), udf(text_of(text_col)).alias("r")).select("doc_id", "r.*")
