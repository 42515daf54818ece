"""Stretches of words that repeat with a period, found by recompression.

A run is a stretch of words with smallest period q, at least ``4 * q`` and at
least 6 words long, that no neighbouring word extends. Each whole text is searched
in the task that holds it:

* Candidates come from a harmonic grid. A run with period q has at least three
  places in a row, q apart, at which the word is that q places on; so it is enough to
  look at the places ``0, p, 2p, ...`` for every period p, n log n in all.
* The words of the texts with candidates are compressed to a run-length grammar:
  blocks of one symbol become one symbol, then the symbols are parted in two by a
  hash and each pair of a first-kind and a second-kind symbol becomes one, and so on
  until one symbol is left. Symbols are named by sorting, so equal names mean equal
  words. Equal stretches are parsed alike but for their ends.
* A candidate is extended to both sides by longest-common-extension queries that
  climb the grammar until the two places differ and then descend to the word that
  does; all queries of a batch take each level together. The extension to the left
  uses the grammar of the reversed words.

Nothing is hashed to compare words and no suffix array is built.

Defined cases: a null text has no words; rows are independent, hence repeated
rows, ties and empty tables need no rule; columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches

#: A run has at least so many words, and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Queries that climb the grammar together.
QUERIES_AT_ONCE = 100_000
#: Rounds in which a chain of grid places is queried at its first place only.
FIRST_ROUNDS = 8


class Grammar:
    """Levels of a sequence of symbols, compressed until one symbol is left.

    ``symbols[k]`` is the sequence at level k, ``sizes[k]`` what each symbol stands
    for in level-0 symbols, ``up[k]`` the place of its parent at level k + 1 and
    ``first[k]`` the place of each parent's first child, with the length at its end.
    Even levels are compressed by blocks, odd ones by pairs.
    """

    def __init__(self, words: np.ndarray):
        self.symbols, self.sizes, self.up, self.first = [words], [np.ones(len(words), np.int64)], [], []
        self.fresh = int(words.max()) + 1 if len(words) else 0
        while len(self.symbols[-1]) > 1:
            self._compress(self._blocks if len(self.up) % 2 == 0 else self._pairs)

    def _compress(self, kind) -> None:
        symbols, sizes = self.symbols[-1], self.sizes[-1]
        starts, named = kind(symbols)
        self.up.append(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)])))
        self.first.append(np.r_[starts, len(symbols)])
        self.symbols.append(named)
        self.sizes.append(np.add.reduceat(sizes, starts))

    def _names(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A new symbol for each distinct pair of numbers."""
        keys, which = np.unique(np.stack([left, right]), axis=1, return_inverse=True) if self.fresh >= 2**31 else np.unique((left << 32) | right, return_inverse=True)
        names = self.fresh + which.reshape(-1)
        self.fresh += keys.shape[-1]
        return names

    def _blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        lengths = np.diff(np.r_[starts, len(symbols)])
        named = symbols[starts]
        many = np.flatnonzero(lengths > 1)
        if len(many):
            named[many] = self._names(named[many], lengths[many])
        return starts, named

    def _pairs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (symbols.astype(np.uint64) + np.uint64(len(self.up))) * np.uint64(0x9E3779B97F4A7C15)
        opens = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 0
        pairs = np.flatnonzero(opens[:-1] & ~opens[1:])
        begins = np.ones(len(symbols), bool)
        begins[pairs + 1] = False
        starts = np.flatnonzero(begins)
        named = symbols[starts]
        if len(pairs):
            where = np.cumsum(begins)[pairs] - 1
            named[where] = self._names(symbols[pairs], symbols[pairs + 1])
        return starts, named

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from x on are those from y on; the places of each query differ, and their common stretch ends before the sequence."""
        return np.concatenate([self._common(x[i : i + QUERIES_AT_ONCE], y[i : i + QUERIES_AT_ONCE]) for i in range(0, len(x), QUERIES_AT_ONCE)]) if len(x) else np.zeros(0, np.int64)

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = len(x)
        same = np.zeros(n, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by level: queries that differ there, and where
        who = np.arange(n)
        for k in range(len(self.up)):
            who, x, y, stopped = self._climb(k, who, x, y, same)
            waiting.append(stopped)
        who, x, y = (np.zeros(0, np.int64),) * 3
        for k in range(len(self.up) - 1, -1, -1):
            if len(who):
                x, y = self.first[k][x], self.first[k][y]
                x, y = self._step(k, who, x, y, same)
            who, x, y = (np.concatenate(z) for z in zip((who, x, y), waiting[k], strict=True))
        return same

    def _climb(self, k: int, who, x, y, same):
        """Advance to where both places begin a parent, and go to the parents; queries that differ before stay behind."""
        symbols, up, first = self.symbols[k], self.up[k], self.first[k]
        inside = np.flatnonzero((first[up[x]] != x) | (first[up[y]] != y))
        equal = symbols[x[inside]] == symbols[y[inside]]
        differ, go = inside[~equal], inside[equal]
        if k % 2 == 0:  # the rest of a block at each place: equal or the queries end here
            rest_x, rest_y = first[up[x[go]] + 1] - x[go], first[up[y[go]] + 1] - y[go]
            least = np.minimum(rest_x, rest_y)
            differ = np.r_[differ, go[rest_x != rest_y]]
        else:
            least = np.ones(len(go), np.int64)
        same[who[go]] += least * self.sizes[k][x[go]]
        x, y = x.copy(), y.copy()
        x[go] += least
        y[go] += least
        stopped = who[differ], x[differ], y[differ]
        on = np.ones(len(x), bool)
        on[differ] = False
        return who[on], up[x[on]], up[y[on]], stopped

    def _step(self, k: int, who, x, y, same):
        """The first children of parents that differ: pass those that are equal."""
        symbols, up, first = self.symbols[k], self.up[k], self.first[k]
        go = np.flatnonzero(symbols[x] == symbols[y])
        if k % 2 == 0:
            least = np.minimum(first[up[x[go]] + 1] - x[go], first[up[y[go]] + 1] - y[go])
        else:
            least = np.ones(len(go), np.int64)
        same[who[go]] += least * self.sizes[k][x[go]]
        x[go] += least
        y[go] += least
        return x, y


def _grid(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the candidates, one of three in a row on the grid, by period and place.

    Texts lie behind one another with a mark before each, the longest first.
    """
    ends = np.cumsum(sizes + 1)
    places, periods = [], []
    for p in range(1, int(sizes[0]) // MIN_PERIODS + 1):
        long = int(np.searchsorted(-sizes, -MIN_PERIODS * p, "right"))
        at = np.arange(0, int(ends[long - 1]) - p, p)
        same = words[at] == words[at + p]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) if len(same) > 2 else np.zeros(0, np.int64)
        if len(three):
            hits = np.unique(np.r_[three, three + 1, three + 2])
            hits = hits[hits % 3 == 0]
            places.append(at[hits])
            periods.append(np.full(len(hits), p))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _extents(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows of start, end and period of the stretches around the candidates, each once.

    Candidates that lie in a stretch already found with their period are passed:
    at first only the first of each chain is extended, after some rounds all that are left.
    """
    forward, backward, last = Grammar(words), Grammar(words[::-1].copy()), len(words) - 1
    found = []
    for turn in range(FIRST_ROUNDS + 1):
        if not len(at):
            break
        first = np.r_[True, (period[1:] != period[:-1]) | (at[1:] - at[:-1] != 3 * period[1:])]
        ask = np.flatnonzero(first) if turn < FIRST_ROUNDS else np.arange(len(at))
        x, p = at[ask], period[ask]
        right = forward.common(x, x + p)
        left = backward.common(last - x + 1, last - (x + p) + 1)
        found.append(np.stack([x - left, x + p + right, p], axis=1))
        if turn == FIRST_ROUNDS:
            break
        until = np.repeat(x + right, np.diff(np.r_[ask, len(at)]))
        rest = at >= until
        rest[ask] = False
        at, period = at[rest], period[rest]
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(MIN_WORDS, MIN_PERIODS * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch found with several periods has the smallest
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows


def text_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of every run of every text, whose words are numbers, by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= MIN_WORDS), key=lambda i: -len(texts[i]))
    if not order:
        return out
    words, sizes, starts = _joined(texts, order)
    at, period = _grid(words, sizes)
    if not len(at):
        return out
    held = np.unique(np.searchsorted(starts, at, "right") - 1)
    if len(held) < len(order):  # only texts with candidates are compressed
        order = [order[i] for i in held.tolist()]
        words, sizes, starts = _joined(texts, order)
        at, period = _grid(words, sizes)
    rows = _extents(words, at, period)
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    for o, (a, b, p) in zip(owner.tolist(), rows.tolist(), strict=True):
        out[order[o]].append((a - int(starts[o]) - 1, b - a, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _joined(texts: list[list[int]], order: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts behind one another, a mark of its own before each and at the end; sizes; places of the marks."""
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    top = max(max(texts[i]) for i in order) + 1
    marks = iter(range(top, top + len(order) + 1))
    parts = [x for i in order for x in ((next(marks),), texts[i])]
    words = np.concatenate([np.array(x, np.int64) for x in (*parts, (next(marks),))])
    return words, sizes, np.cumsum(sizes + 1) - sizes - 1


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when of each run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _each(docs: DataFrame, id_col: str, text_col: str, made, schema: str) -> DataFrame:
    """One row for each text by ``made(doc ids, words, runs)``."""

    def search(batches):
        for b in text_batches(batches):
            words = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            number = defaultdict(count().__next__)
            found = text_runs([list(map(number.__getitem__, ws)) for ws in words])
            yield made(b.column("doc_id"), words, found)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search, schema)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words), collapsed (the text with one period of each run) of every text."""

    def made(ids, words, found):
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in rs] for rs in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        texts = [_collapsed(ws, rs).decode() for ws, rs in zip(words, found, strict=True)]
        return pa.record_batch({"doc_id": ids, "n_words": pa.array(map(len, words), pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array(texts, pa.string())})

    return _each(docs, id_col, text_col, made, RUNS)


NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent and the digests of all runs and of the collapsed text."""

    def made(ids, words, found):
        rows = {c: [] for c in NUMBERS}
        all_sha, text_sha = [], []
        for ws, rs in zip(words, found, strict=True):
            best = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rs else (None, None, None)
            for c, v in zip(NUMBERS, (len(rs), *best, 1000 * best[1] // best[2] if rs else None), strict=True):
                rows[c].append(v)
            all_sha.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rs).encode()).hexdigest())
            text_sha.append(hashlib.sha256(_collapsed(ws, rs)).hexdigest())
        return pa.record_batch({"doc_id": ids, **{c: pa.array(v, pa.int64()) for c, v in rows.items()}, "runs_sha256": pa.array(all_sha, pa.string()), "collapsed_sha256": pa.array(text_sha, pa.string())})

    return _each(docs, id_col, text_col, made, DIGESTS)


def with_repeated_ends(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, or for a tenth of the ids its words with an end that repeats, as the query's contract sets it; a null id repeats nothing."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, r"[ \t-\r]+"), lambda w: w != "")

    def repeated(parts: Column) -> Column:
        g, n = F.floor(h / 10), F.size(parts).cast("long")
        a = g % n
        p = 1 + F.call_function("div", n - a, 3 + g % 8)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(parts, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    made = F.array_join(F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise(ws)), 1), " ")
    return F.when(h % 10 == 0, made).otherwise(F.col(text_col))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, a tenth with ends that repeat: its runs, the greatest, and digests of runs and collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_digests(docs.select("doc_id", with_repeated_ends().alias("text")))
