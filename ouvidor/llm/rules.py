"""Operator 8, quality rules by weak supervision.

Each rule votes good (+1) or bad (-1) on a document or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates each rule's accuracy and the share of good documents without labels;
a document is kept if its posterior probability of being good reaches ``KEEP_AT``. Counts cover all
documents. Only the table of vote patterns reaches the driver: at most 3 ** len(RULES) rows, however
many documents there are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import materialise, per_text, text_of

MIN_WORDS, KEEP_AT = 50, 0.5
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_TO_HASH = bytes.maketrans(_SYMBOLS, b"#" * len(_SYMBOLS))
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_letters long, n_bangs long, n_marked long"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first finds included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    n = len(number)
    if n < 2_000_000:
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # three numbers don't fit 63 bits: number the pairs first
        _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        windows = pairs[:-1] * n + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def features(text: str) -> tuple:
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    without = lambda marks: len(raw.translate(None, marks))
    symbols = len(raw) - without(_SYMBOLS)
    return (
        len(words),
        len(text) - (len(raw) - without(_SPACE)),
        symbols,
        dup,
        repeat_words(words),
        lines,
        len(set(words)),
        len(raw) - without(_UPPER),
        len(raw) - without(_LETTERS),
        raw.count(b"!"),
        sum(b"#" in w for w in raw.translate(_TO_HASH).split()) if symbols else 0,
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules, each a vote over the features; a document without words gets no good vote from ratios."""
    c = F.col
    words, lines, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    some = c("n_words") > 0
    symbols, upper = c("n_symbols") / words, c("n_upper") / letters
    repeats, distinct, length = c("n_repeat_words") / words, c("n_distinct") / words, c("word_chars") / words
    bangs, dups = c("n_bangs") / words, c("n_dup_lines") / lines
    return {
        "symbols": _vote(some & (symbols < 0.02), symbols > 0.1),
        "marked words": _vote(some & (c("n_marked") < 0.02 * words), c("n_marked") > 0.2 * words),
        "capitals": _vote(some & (upper < 0.1), upper > 0.3),
        "repeats": _vote(some & (repeats < 0.1), repeats > 0.3),
        "variety": _vote(some & (distinct > 0.35), some & (c("n_words") >= 100) & (distinct < 0.12)),
        # one repeated line, such as a head that is also the foot, says nothing
        "lines": _vote((c("n_lines") > 3) & (dups < 0.05), (c("n_dup_lines") > 2) & (dups > 0.3)),
        "bangs": _vote(some & (bangs < 0.02), bangs > 0.1),
        "word length": _vote((length >= 3) & (length <= 9), some & ((length < 2) | (length > 14))),
        "letters": _vote(some & (c("n_letters") > 0.85 * c("word_chars")), some & (c("n_letters") < 0.7 * c("word_chars"))),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM for two classes with rules that are independent within a class; whether a rule abstains says nothing of the class.

    ``votes``: pattern x rule of -1, 0, 1; ``counts``: documents of each pattern. Returns the log-odds of the
    prior and, by rule and vote (-1, 0, 1), the log-odds of good. One pseudo-document for each vote and class
    and a start at which complaints mark the bad class keep the classes named and every odds finite.
    An empty table gives the polarity alone.
    """
    total = counts.sum()
    # to start with, one complaint outweighs several rules without one
    good = 1 / (1 + np.exp(-(1 + np.where(votes < 0, -3.0, 0.25 * votes).sum(axis=1))))
    prior, odds = 0.0, np.zeros((votes.shape[1], 3))
    if not total:
        odds[:, 0], odds[:, 2] = -1.5, 1.5
        return prior, odds
    for _ in range(rounds):
        g = float((good * counts).sum())
        prior = np.log((g + 1) / (total - g + 1))
        voted = votes != 0
        n_good, n_bad = (good * counts) @ voted, ((1 - good) * counts) @ voted
        for vote in (-1, 1):
            p_good = ((good * counts) @ (votes == vote) + 1) / (n_good + 2)
            p_bad = (((1 - good) * counts) @ (votes == vote) + 1) / (n_bad + 2)
            odds[:, vote + 1] = np.log(p_good / p_bad)
        # a rule's word never turns against what it says
        odds[:, 0], odds[:, 2] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        score = prior + np.take_along_axis(odds.T, votes + 1, axis=0).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(prior), odds


def posterior(prior: float, odds: np.ndarray, votes: dict[str, Column]) -> Column:
    terms = [
        F.when(vote == -1, F.lit(float(o[0]))).when(vote == 1, F.lit(float(o[2]))).otherwise(F.lit(float(o[1])))
        for vote, o in zip(votes.values(), odds)
    ]
    score = reduce(lambda a, b: a + b, terms, F.lit(float(prior)))
    return 1 / (1 + F.exp(-score))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(featured: DataFrame) -> tuple[float, np.ndarray]:
    """Count vote patterns over all rows of ``featured`` and fit the accuracies."""
    votes = rule_votes()
    rows = featured.groupBy(*[v.alias(k) for k, v in votes.items()]).agg(F.count("*").alias("n")).collect()
    rows.sort()
    table = np.array([[r[k] for k in votes] for r in rows], dtype=np.int64).reshape(len(rows), len(votes))
    return fit_votes(table, np.array([r["n"] for r in rows], dtype=float))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the five base figures, base_failed, kept, and the posterior.

    Null and empty texts have no words, fail the base and are not kept; repeated rows are judged alike.
    """
    udf = per_text(features, FEATURES)
    featured = docs.select(F.col(id_col).alias("doc_id"), udf(text_of(text_col)).alias("f")).select("doc_id", "f.*")
    featured = materialise(featured, "features")
    p = posterior(*fit(featured), rule_votes())
    return featured.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & (p >= KEEP_AT)).alias("kept"), p.alias("posterior"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, all columns as they were.

    The votes are counted over all rows in a first pass and the features computed again in the second,
    which costs less than to write every text once more.
    """
    udf = per_text(features, FEATURES)
    p = posterior(*fit(docs.select(udf(text_of(text_col)).alias("f")).select("f.*")), rule_votes())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    judged = docs.select(row, udf(text_of(text_col)).alias("__f")).select("__row", "__f.*")
    return judged.where(~base_failed() & (p >= KEEP_AT)).select("__row.*")
