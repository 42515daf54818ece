"""Quality classifier: a linear model on naive Bayes features.

Features are indicators of n-grams in ``SLOTS`` hashed slots: words and word
pairs, and single ones and triples of word shapes (classes of the first, second
and last two bytes, a length class, and whether the word equals the one before).
Each indicator is scaled by the log ratio of its smoothed frequencies in the two
classes, and a hinge-loss model with squared norm is fitted to the scaled,
length-normalised vectors by dual coordinate descent. A logistic curve fitted
to a part held back from the descent turns margins into scores.

Class counts cover all labelled training rows. The descent runs on the driver
over at most ``MAX_TRAIN`` labelled rows, drawn by a hash of the id. Scoring is
one pass over the texts with a model of fixed size.

Training rows are those whose crc32(doc_id as text) mod ``FOLDS`` is not 0.

Defined cases: null and empty texts have no features and take the score of the
bias; null ids are scored and never used for training; labels other than 0 and
1 are ignored; a label that is repeated counts each time; without labels of both
classes all scores are the share of label 1 (0.5 without any); an empty table
gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import stored
from .seeds import HASH_BYTES, mix, raw_texts, word_tokens

SLOTS = 1 << 17
FOLDS = 5
#: Bound on the labelled rows that the descent sees.
MAX_TRAIN = 8_000
THRESHOLD = 0.3
COST, ROUNDS, SMOOTH = 1.0, 12, 1.0

_CLASS = np.zeros(256, np.uint64)  # of a byte: lower, upper, digit, other ASCII by itself, beyond ASCII
for _b in range(256):
    _CLASS[_b] = 1 if 97 <= _b <= 122 else 2 if 65 <= _b <= 90 else 3 if 48 <= _b <= 57 else 4 if _b > 127 else 5 + _b


def _shapes(texts: list[bytes], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = ((flat >= 9) & (flat <= 13)) | (flat == 32)
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    last = np.flatnonzero(~blank & np.r_[blank[1:], True])
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    same[(np.cumsum(counts) - counts)[counts > 0]] = 0
    size = np.minimum(last - first, 3).astype(np.uint64)
    shape = np.zeros(len(words), np.uint64)
    for at in (first, np.minimum(first + 1, last), np.maximum(last - 1, first), last):
        shape = shape * np.uint64(300) + _CLASS[flat[at]]
    return mix((shape * np.uint64(4) + size) * np.uint64(2) + same)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text in one array, ordered by text, and how many each has."""
    words, counts = word_tokens(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    shapes = _shapes(texts, words, counts)
    parts = []
    for stream, n, kind in ((words, 1, 1), (words, 2, 2), (shapes, 1, 3), (shapes, 3, 4)):
        if len(stream) < n:
            continue
        grams = stream[: len(stream) - n + 1].copy()
        for k in range(1, n):
            grams = mix(grams) + stream[k : len(stream) - n + 1 + k]
        inside = doc[: len(grams)] == doc[n - 1 :]
        slot = (mix(grams + np.uint64(kind)) & np.uint64(SLOTS - 1)).astype(np.int64)
        parts.append((doc[: len(grams)] * SLOTS + slot)[inside])
    both = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return (both % SLOTS).astype(np.int32), np.bincount(both // SLOTS, minlength=len(texts))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    """margin = weights of the slots over the norm, plus bias; score = logistic(slope * margin + shift)."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        margin = np.full(len(counts), self.bias)
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            total = np.add.reduceat(self.weights[slots], starts)
            norm = np.sqrt(np.add.reduceat(self.scale[slots] ** 2, starts)) + 1e-9
            margin[some] += total / norm
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; a row is the slots and values of a vector, the bias is a value of 1 in each."""
    w, bias = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slots, values = rows[i]
            gradient = y[i] * (float(w[slots] @ values) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[slots] += step * values
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps on smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g, v = p - target, p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * margin).sum() + 1e-3 * a, g.sum() + 1e-3 * b]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    n = known.count()
    share = min(1.0, max_train / n) if n else 0.0
    drawn = F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known.withColumn("drawn", drawn).hint("shuffle_hash"), "label_id").select("label_id", "text", "label", "drawn")

    def count(batches):
        totals = np.zeros((2, SLOTS), np.int64)
        number = np.zeros(2, np.int64)
        for b in text_batches(batches, HASH_BYTES):
            slots, counts = features(raw_texts(b))
            label = b.column("label").to_numpy()
            of = np.repeat(label, counts)
            for c in (0, 1):
                totals[c] += np.bincount(slots[of == c], minlength=SLOTS)
                number[c] += int((label == c).sum())
            ends = np.cumsum(np.r_[0, counts])
            pick = np.flatnonzero(b.column("drawn").to_numpy(zero_copy_only=False))
            none = pa.nulls(len(pick), pa.int64())
            yield pa.record_batch({"slot": pa.nulls(len(pick), pa.int32()), "n0": none, "n1": none, "id": pa.array(b.column("label_id").to_numpy()[pick], pa.int64()), "label": pa.array(label[pick], pa.int32()), "slots": pa.array([slots[ends[i] : ends[i + 1]].tobytes() for i in pick], pa.binary())})
        at = np.flatnonzero(totals.sum(axis=0))
        size = len(at) + 1
        yield pa.record_batch({"slot": pa.array([*at, -1], pa.int32()), "n0": pa.array([*totals[0][at], number[0]], pa.int64()), "n1": pa.array([*totals[1][at], number[1]], pa.int64()), "id": pa.nulls(size, pa.int64()), "label": pa.nulls(size, pa.int32()), "slots": pa.nulls(size, pa.binary())})

    found = stored(rows.mapInArrow(count, "slot int, n0 long, n1 long, id long, label int, slots binary"), "quality-counts")
    sums = found.filter("slot IS NOT NULL").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, SLOTS))
    number = np.zeros(2)
    for c, name in enumerate(("n0", "n1")):
        inside = sums["slot"].to_numpy() >= 0
        counts[c][sums["slot"].to_numpy()[inside]] = sums[name].to_numpy()[inside]
        number[c] = sums[name].to_numpy()[~inside].sum()
    ratios = [(counts[c] + SMOOTH) / (counts[c] + SMOOTH).sum() for c in (0, 1)]
    scale = np.log(ratios[1] / ratios[0])
    sample = found.filter("slots IS NOT NULL").orderBy(F.xxhash64("id"), "id", "label").limit(max_train).select("label", "slots").toPandas()
    label = sample["label"].to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, np.int64)
    if len(set(label.tolist())) < 2:
        share = (number[1] + 1) / (number.sum() + 2)
        return Model(scale, np.zeros(SLOTS), 0.0, 0.0, float(np.log(share / (1 - share))))
    vectors = []
    for raw in sample["slots"]:
        slots = np.frombuffer(raw, np.int32)
        values = scale[slots]
        vectors.append((slots, values / (np.sqrt((values * values).sum()) + 1e-9)))
    y = np.where(label == 1, 1.0, -1.0)
    held = np.arange(len(y)) % 5 == 0
    held = held if len(set(label[held].tolist())) == 2 and len(set(label[~held].tolist())) == 2 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    w, bias = dual_descent([vectors[i] for i in train], y[train], COST, ROUNDS)
    check = np.flatnonzero(held) if held.any() else train
    margin = np.array([float(w[vectors[i][0]] @ vectors[i][1]) + bias for i in check])
    slope, shift = _logistic(margin, label[check])
    return Model(scale, w * scale, bias, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in text_batches(batches, HASH_BYTES):
            slots, counts = features(raw_texts(b))
            s = shared.value.scores(slots, counts)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_model(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by a model of ``labels``: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels))
