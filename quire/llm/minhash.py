"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

Shingles are ``SHINGLE`` consecutive words (one shorter shingle for a shorter
text) weighted by tf-idf: how often the shingle occurs in the text, times the
mean idf of its words. The idf of a *shingle* would say little, as nearly all
occur in one document, and would sink for shingles that copies share; that of
its words is as consistent and robust. It is scaled to 0.5 to 1, so that common words keep
half the weight of rare ones. Word document frequencies are counted over
all documents in ``IDF_SLOTS`` hashed slots, a table of fixed size.

1. ICWS draws ``BANDS * ROWS`` samples (shingle, level) per document; two
   documents agree on a sample with the probability of their weighted Jaccard
   similarity. Bands of ``ROWS`` samples are hashed to buckets.
2. Equal word sequences are one node. In each bucket that holds nodes of
   several components, the nodes outside its largest component are paired with
   one centre of it (a star), pruned by total weight (exact) and by the ``SAMPLES``
   samples cut to four bits (a pair at 0.8 fails that with probability below
   1e-5; ``exact`` leaves it out), and verified by weighted Jaccard on the
   shingles. Components are contracted; with more than one of the ``TURNS``
   each uses a fresh centre. A group of n copies costs n.
3. What is left, pairs of one bucket whose components still differ, is judged
   in tiles. A bucket that is too large for a task is cut into blocks by weight
   class and hash, a tile is two blocks. Members without a partner that passes
   the pruning go first; the others' shingles are sent to the tile, turned into
   posting lists, and all pairs judged exactly. Only links that join components
   become rows. No link of a bucket is lost, whatever its size. Many nodes of a
   bucket that are alike below the threshold stay single and still cost the
   square of their number, spread over tiles.

Classes are components; the class id is the smallest doc_id in it.

Defined cases: null and empty texts, which have no words, form one class;
null ids come last (a class of such rows alone has a null id); repeated rows
fall in one class; an empty table gives an empty table. Other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import NULL_ID, row_id, stored, unused
from .seeds import HASH_BYTES, gram_hashes, keyed, mix, raw_texts, word_tokens

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Of the SAMPLES 4-bit samples so many may differ: a pair at 0.8 differs in 12 on average, deviation 3.1.
MAX_APART = 28
#: Totals of weights are summed in another order than shares of pairs.
SLACK = 1e-6
PACKED = [f"s{k}" for k in range(SAMPLES // 16)]
#: Rounds of stars before all pairs that are left are judged.
TURNS = 1
#: Load of a tile's block: a node counts 1 and 1 more for each 250 of weight.
ROOM = 8192
#: Pairs and postings that a task holds at once.
PAIRS = 1 << 20
IDF_SLOTS = 1 << 16
#: Shingles whose draws are made at once: they stay near the processor.
BLOCK = 1 << 14
_DRAW = np.uint64(0x94D049BB133111EB)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64) & (IDF_SLOTS - 1)


def word_idf(docs: DataFrame) -> np.ndarray:
    """idf of each slot over all documents; ``IDF_SLOTS`` sums reach the driver."""

    def count(batches):
        total, n = np.zeros(IDF_SLOTS, np.int64), 0
        for b in text_batches(batches, HASH_BYTES):
            words, counts = word_tokens(raw_texts(b))
            n += b.num_rows
            doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
            pairs = np.sort(doc * IDF_SLOTS + _slots(words))
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
            total += np.bincount(pairs % IDF_SLOTS, minlength=IDF_SLOTS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"slot": pa.array([*at, -1], pa.int32()), "n": pa.array([*total[at], n], pa.int64())})

    sums = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(IDF_SLOTS)
    known = sums["slot"].to_numpy() >= 0
    df[sums["slot"].to_numpy()[known]] = sums["n"].to_numpy()[known]
    n = max(1, int(sums["n"].to_numpy()[~known].sum()))
    return (0.5 + 0.5 * np.log1p(n / (1.0 + df)) / np.log1p(n)).astype(np.float32)


def weighted_shingles(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts (hash, weight), ordered by text and hash, and how many each text has."""
    words, counts = word_tokens(texts)
    weight = idf[_slots(words)]
    starts = np.cumsum(np.r_[0, counts])
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = starts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    hashes, means = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.float32)
    full = counts[doc] >= SHINGLE
    if full.any():
        sums = np.convolve(weight.astype(np.float64), np.ones(SHINGLE), "valid")
        hashes[full] = gram_hashes(words, SHINGLE)[at[full]]
        means[full] = (sums[at[full]] / SHINGLE).astype(np.float32)
    for i in np.flatnonzero(~full):  # texts of one to four words
        d = doc[i]
        own = words[starts[d] : starts[d + 1]]
        hashes[i] = gram_hashes(own, len(own))[0] ^ np.uint64(len(own))
        means[i] = weight[starts[d] : starts[d + 1]].mean()
    order = np.lexsort((hashes, doc))
    hashes, means, doc = hashes[order], means[order], doc[order]
    turn = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.r_[turn, len(doc)])
    return hashes[turn], means[turn] * times.astype(np.float32), np.bincount(doc[turn], minlength=len(texts))


def _spread(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _DRAW
    x ^= x >> np.uint64(32)
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """Two uniforms of each 64-bit value, above 0 and below 1."""
    u = x.view(np.int32).astype(np.float32)
    np.abs(u, out=u)
    u += np.float32(0.5)
    u *= np.float32((1 - 2**-20) / 2**31)
    return u


def icws(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, first_sample: int = 0, n: int = SAMPLES) -> np.ndarray:
    """Samples of each text that has shingles: (texts, n) hashes of (shingle, level).

    r and c (Gamma(2, 1), as -log of a product of two uniforms) and beta of every
    (shingle, sample) come from 32 bits for each uniform, so that the shingles of
    a long text never share their draws.
    """
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    sizes = counts[some]
    log_w = np.log(weights)
    out = np.zeros((len(starts), n), np.uint64)
    a, level = np.empty(len(hashes), np.float32), np.empty(len(hashes), np.float32)
    odd = mix(np.arange(first_sample + 1, first_sample + n + 1, dtype=np.uint64)) | np.uint64(1)
    for s in range(n):
        for i in range(0, len(hashes), BLOCK):
            own = slice(i, i + BLOCK)
            x = _spread(hashes[own] * odd[s])
            y = _spread(x * _DRAW)
            u, v, beta = _uniform(x), _uniform(y), _uniform(y * _DRAW)[1::2]
            minus_r = np.log(u[::2] * u[1::2])
            log_c = np.log(-np.log(v[::2] * v[1::2]))
            level[own] = np.floor(beta - log_w[own] / minus_r)
            a[own] = log_c + (level[own] + np.float32(1) - beta) * minus_r
        lowest = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(lowest, sizes))
        first = at[np.searchsorted(at, starts)]
        out[:, s] = mix(hashes[first] + level[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _nibbles(samples: np.ndarray) -> np.ndarray:
    """4 bits of each sample, 16 samples in a long."""
    parts = (samples & np.uint64(15)).reshape(len(samples), samples.shape[1] // 16, 16)
    return (parts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def layout(similarity: float) -> tuple[int, int]:
    """Bands and rows of the first SAMPLES: a pair at this similarity shares a bucket as surely as one at SIMILARITY does.

    From SIMILARITY on they are BANDS and ROWS; below, bands have fewer rows.
    """
    for rows in range(ROWS, 0, -1):
        bands = SAMPLES // rows
        if similarity >= SIMILARITY or (1 - similarity**rows) ** bands <= (1 - SIMILARITY**ROWS) ** BANDS:
            return bands, rows
    raise ValueError(f"similarity {similarity}: {SAMPLES} samples do not find pairs below 0.13 with certainty")


def most_apart(similarity: float) -> int:
    """Of the 4-bit samples so many may differ: MAX_APART, as many deviations from the mean at a lower similarity."""
    if similarity >= SIMILARITY:
        return MAX_APART
    p, q = (1 - similarity) * 15 / 16, (1 - SIMILARITY) * 15 / 16
    return math.ceil(SAMPLES * p + (MAX_APART + 1 - SAMPLES * q) * math.sqrt(p * (1 - p) / (q * (1 - q))))


def signatures(docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row, node (digest of the words), total weight, bands, 4-bit samples; stored."""
    table = docs.sparkSession.sparkContext.broadcast(idf)
    n_bands, n_rows = layout(similarity)

    def sign(batches):
        seed = mix(np.arange(n_bands, dtype=np.uint64) + np.uint64(77))
        for b in text_batches(batches, HASH_BYTES):
            texts = raw_texts(b)
            hashes, weights, counts = weighted_shingles(texts, table.value)
            some = np.flatnonzero(counts)
            samples = icws(hashes, weights, counts)
            bands = np.zeros((len(some), n_bands), np.uint64)
            for k in range(n_rows):
                bands = mix(bands + samples[:, k : n_bands * n_rows : n_rows] + seed)
            packed = _nibbles(samples)
            total = np.zeros(len(texts))
            total[some] = np.add.reduceat(weights.astype(np.float64), (np.cumsum(counts) - counts)[some]) if len(some) else 0
            ends = np.zeros(len(texts) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(counts > 0, n_bands, 0))
            out = {"doc_id": b.column("doc_id"), "row": b.column("row"), "node": pa.array([hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts], pa.binary()), "weight": pa.array(total, pa.float64()), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))}
            for k in range(4):
                values = np.zeros(len(texts), np.int64)
                values[some] = packed[:, k] if len(some) else 0
                out[f"s{k}"] = pa.array(values)
            yield pa.record_batch(out)

    return stored(docs.mapInArrow(sign, "doc_id long, row long, node binary, weight double, bands array<long>, s0 long, s1 long, s2 long, s3 long"), "signatures")


def _apart(pairs: list[tuple[Column, Column]]) -> Column:
    """Samples in which two nodes' packed 4-bit samples differ."""
    apart = F.lit(0)
    for a, b in pairs:
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(x)
    return apart


def _prune(a: str, b: str, similarity: float, exact: bool) -> Column:
    """Pairs that can be alike: total weights within the ratio and, unless ``exact``, few 4-bit samples apart."""
    wa, wb = F.col(f"{a}.weight"), F.col(f"{b}.weight")
    near = F.least(wa, wb) >= (similarity - SLACK) * F.greatest(wa, wb)
    return near if exact else near & (_apart([(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in PACKED]) <= most_apart(similarity))


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger ones; a and b are sorted and distinct."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    low = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    union = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - low
    return low / union if union > 0 else 1.0


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, h and w (its shingles and weights) of the wanted nodes; stored."""
    table = docs.sparkSession.sparkContext.broadcast(idf)
    own = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("row").alias("own_row"), F.col("doc_id").alias("own_id"), "node")

    def shingle(batches):
        for b in text_batches(batches, HASH_BYTES):
            hashes, weights, counts = weighted_shingles(raw_texts(b), table.value)
            ends = np.cumsum(np.r_[0, counts])
            slices = [(i, j) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch({"node": b.column("node"), "h": pa.array([hashes[i:j].tobytes() for i, j in slices], pa.binary()), "w": pa.array([weights[i:j].tobytes() for i, j in slices], pa.binary())})

    found = docs.join(own.hint("shuffle_hash"), (F.col("row") == F.col("own_row")) & (F.col("doc_id") == F.col("own_id")))
    return stored(found.select("node", "text").mapInArrow(shingle, "node binary, h binary, w binary"), "shingles")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of candidate pairs (a, b) of nodes those that are alike, as stored links (a, b, similarity)."""
    one = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    two = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))

    def judge(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                columns = [b.column(c) for c in ("ha", "wa", "hb", "wb")]
                kinds = (np.uint64, np.float32, np.uint64, np.float32)
                scores = [weighted_jaccard(*(np.frombuffer(x.as_buffer(), t) for x, t in zip(row, kinds, strict=True))) for row in zip(*columns, strict=True)]
                keep = pa.array([s >= similarity for s in scores], pa.bool_())
                yield pa.record_batch({"a": b.column("a"), "b": b.column("b"), "similarity": pa.array(scores, pa.float64())}).filter(keep)

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "wa", "hb", "wb")
    return stored(both.mapInArrow(judge, "a binary, b binary, similarity double"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes with links: large-star and small-star rounds.

    Each round is one aggregation and one join per star over the links, stored;
    rounds grow with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.filter("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")


def labelled_members(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Memberships (node, band, bucket ...) with the node's component so far."""
    if classes is None:
        return members.withColumn("component", F.col("node"))
    return members.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_buckets(labelled: DataFrame, turn: int) -> DataFrame:
    """Stored band, bucket, top (the largest component) and a centre in it, of buckets in several components.

    Both are drawn by a hash of the node and the turn alone, so that the buckets
    of one group agree on their centres and pairs of several buckets are equal.
    """
    own = F.xxhash64("node", F.lit(turn))
    parts = labelled.groupBy("band", "bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(own.alias("draw"), "node")).alias("head"))
    ranked = F.struct("n", "head.draw", "component", F.col("head.node").alias("node"))
    found = parts.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(ranked).alias("top"))
    return stored(found.filter("parts > 1").select("band", "bucket", F.col("top.component").alias("top"), F.col("top.node").alias("center")), "open-buckets")


def star_links(labelled: DataFrame, buckets: DataFrame, info: DataFrame, sets: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """Verified links of each bucket's nodes outside its largest component with the bucket's centre."""
    outside = labelled.select("node", "band", "bucket", "component").join(buckets, ["band", "bucket"]).filter("component != top")
    pairs = outside.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    one, two = info.withColumnRenamed("node", "a").alias("m"), info.withColumnRenamed("node", "b").alias("c")
    near = pairs.join(one, "a").join(two, "b").filter(_prune("m", "c", similarity, exact))
    return verify(stored(near.select("a", "b"), "pairs"), sets, similarity)


TILE = ["band", "bucket", "c1", "p1", "c2", "p2"]


def tiles_of(labelled: DataFrame, buckets: DataFrame, info: DataFrame, similarity: float, room: int) -> DataFrame:
    """The members of open buckets, dealt to tiles: each pair that can be alike meets in one tile of its bucket.

    A bucket of more than ``room`` units of load is cut by weight class (nodes
    two classes apart differ too much in weight) and in a class by a hash, so
    that two blocks and not the bucket make a tile.
    """
    open_ = labelled.join(buckets.select("band", "bucket", "top"), ["band", "bucket"]).join(info.select("node", "weight"), "node")
    load = (F.lit(1.0) + F.col("weight") / 250).alias("load")
    step = -float(np.log(similarity - SLACK))
    open_ = open_.withColumn("cls", F.floor(F.log("weight") / step).cast("int"))
    loads = open_.groupBy("band", "bucket", "cls").agg(F.sum(load).alias("load"))
    plan = loads.groupBy("band", "bucket").agg(F.sum("load").alias("total"), F.map_from_entries(F.collect_list(F.struct("cls", F.ceil(F.col("load") / room).cast("int").alias("n")))).alias("salts"))
    plan = stored(plan.select("band", "bucket", F.when(F.col("total") > room, F.col("salts")).alias("salts")), "tile-plan")
    dealt = open_.join(plan, ["band", "bucket"])
    n = lambda c: F.coalesce(F.try_element_at("salts", c), F.lit(0))
    cls = F.col("cls")
    own = F.pmod(F.xxhash64("node", F.lit("tile")), F.greatest(F.lit(1), n(cls)).cast("long")).cast("int")
    key = lambda c1, p1, c2, p2, side: F.struct(c1.alias("c1"), p1.alias("p1"), c2.alias("c2"), p2.alias("p2"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)

    def each(c: Column, f) -> Column:
        return F.transform(F.filter(F.sequence(zero, n(c)), lambda q: q < n(c)), f)

    spread = F.concat(
        each(cls - 1, lambda q: key(cls - 1, q, cls, own, one)),
        each(cls, lambda q: key(cls, F.least(q, own), cls, F.greatest(q, own), F.when(own <= q, zero).otherwise(one))),
        each(cls + 1, lambda q: key(cls, own, cls + 1, q, zero)),
    )
    whole = F.array(key(zero, zero, zero, zero, zero))
    placed = dealt.withColumn("tile", F.explode(F.when(F.col("salts").isNull(), whole).otherwise(spread)))
    return placed.withColumn("outside", F.col("component") != F.col("top")).select("node", "component", "outside", "weight", "band", "bucket", "tile.*")


def whole_tiles(batches, keys: list[str]):
    """Tables of whole groups: record batches, sorted by the keys, are held back until their last group is complete."""
    held: list[pa.RecordBatch] = []

    def code(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        last, first = code(b, b.num_rows - 1), code(b, 0)
        if held and code(held[-1], held[-1].num_rows - 1) != first:
            yield pa.Table.from_batches(held)
            held = []
        if first == last:
            held.append(b)
            continue
        columns = np.stack([np.asarray(b.column(k)) for k in keys])
        cut = int(np.flatnonzero((columns != columns[:, -1:]).any(axis=0))[-1]) + 1
        yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of the group of each row of a sorted table."""
    columns = np.stack([table.column(k).to_numpy() for k in keys])
    turn = np.flatnonzero(np.r_[True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)])
    ends = np.r_[turn[1:], table.num_rows]
    return np.repeat(turn, ends - turn), np.repeat(ends, ends - turn)


def _blocks(rows: np.ndarray, sizes: np.ndarray, most: int):
    """Cut rows into runs whose sizes sum to about ``most``, at least one row each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield rows[at:to]
        at = to


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)[1]


def _pairs(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row with every row of its group: place of the row in ``rows``, row, other row."""
    times = (end - begin)[rows]
    which = np.repeat(np.arange(len(rows)), times)
    other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + begin[rows][which]
    return which, rows[which], other


def _meets(row: np.ndarray, other: np.ndarray, component: np.ndarray, outside: np.ndarray, side: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Pairs that a tile judges: components differ; blocks differ if the tile has two; of two rows outside, the earlier row leads."""
    return (component[row] != component[other]) & (~split[row] | (side[row] != side[other])) & (~outside[other] | (row < other))


def flag_members(similarity: float):
    """Task: of each tile the members with a partner that can be alike."""
    most = most_apart(similarity)

    def flag(batches):
        for t in whole_tiles(batches, TILE):
            begin, end = _runs(t, TILE)
            weight, packed = t.column("weight").to_numpy(), np.stack([t.column(k).to_numpy().view(np.uint64) for k in PACKED])
            bands = np.array(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
            band, component = t.column("band").to_numpy(), _codes(t.column("component"))
            outside, side = t.column("outside").to_numpy(), t.column("side").to_numpy()
            split = (t.column("c1").to_numpy() != t.column("c2").to_numpy()) | (t.column("p1").to_numpy() != t.column("p2").to_numpy())
            marked = np.zeros(t.num_rows, bool)
            rows = np.flatnonzero(outside)
            for block in _blocks(rows, (end - begin)[rows], PAIRS):
                _, row, other = _pairs(block, begin, end)
                low, high = np.minimum(weight[row], weight[other]), np.maximum(weight[row], weight[other])
                can = np.flatnonzero(_meets(row, other, component, outside, side, split) & (low >= (similarity - SLACK) * high))
                row, other = row[can], other[can]
                apart = np.zeros(len(row), np.int32)
                for k in packed:
                    x = k[row] ^ k[other]
                    x |= x >> np.uint64(1)
                    x |= x >> np.uint64(2)
                    apart += np.bitwise_count(x & np.uint64(0x1111111111111111))
                near = apart <= most
                row, other = row[near], other[near]
                # a pair that shares several buckets counts in the first
                first = (np.argmax(bands[row] == bands[other], axis=1) == band[row]) if len(row) else np.zeros(0, bool)
                marked[row[first]] = True
                marked[other[first]] = True
            yield from t.select(["node", "component", "outside", *TILE, "side"]).filter(pa.array(marked)).to_batches()

    return flag


def judge_tiles(similarity: float):
    """Task: links that join components of a tile, by the weighted Jaccard similarity of all its pairs.

    Shingles of a tile are turned into posting lists; each row outside the
    largest component gathers what it shares with all other rows at once.
    Components that a link joins are one from then on, so a tile gives fewer
    links than it has rows.
    """

    def judge(batches):
        for t in whole_tiles(batches, TILE):
            begin, end = _runs(t, TILE)
            component, outside, side = _codes(t.column("component")), t.column("outside").to_numpy(), t.column("side").to_numpy()
            split = (t.column("c1").to_numpy() != t.column("c2").to_numpy()) | (t.column("p1").to_numpy() != t.column("p2").to_numpy())
            nodes = t.column("node").to_pylist()
            raw = [x.as_py() for x in t.column("h")]
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            h, w = np.frombuffer(b"".join(raw), np.uint64), np.frombuffer(b"".join([x.as_py() for x in t.column("w")]), np.float32).astype(np.float64)
            owner = np.repeat(np.arange(t.num_rows), sizes)
            total = np.bincount(owner, w, minlength=t.num_rows)
            order = np.lexsort((owner, h, begin[owner]))  # postings: by tile, shingle and row
            h, w, owner = h[order], w[order], owner[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (begin[owner[1:]] != begin[owner[:-1]])] if len(h) else np.zeros(0, bool)
            turn = np.flatnonzero(new)
            ends = np.r_[turn[1:], len(h)]
            of = np.cumsum(new) - 1  # posting list of each entry
            by_row = np.argsort(owner, kind="stable")
            row_at = np.cumsum(np.r_[0, sizes])
            root = np.arange(int(component.max(initial=0)) + 1)

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            reach = np.bincount(owner, (ends - turn)[of], minlength=t.num_rows).astype(np.int64)
            out = {"a": [], "b": [], "similarity": []}
            rows = np.flatnonzero(outside)
            for block in _blocks(rows, reach[rows] + (end - begin)[rows], PAIRS):
                times = (end - begin)[block]
                base = np.cumsum(times) - times
                entries = by_row[np.concatenate([np.arange(row_at[r], row_at[r + 1]) for r in block])]
                which = np.repeat(np.arange(len(block)), sizes[block])
                n = (ends - turn)[of[entries]]
                post = np.repeat(turn[of[entries]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(base[which] - begin[block][which], n) + owner[post]
                shared = np.bincount(at, np.minimum(np.repeat(w[entries], n), w[post]), minlength=int(times.sum()))
                _, row, other = _pairs(block, begin, end)
                score = shared / np.maximum(total[row] + total[other] - shared, 1e-300)
                while (root[root] != root).any():
                    root[:] = root[root]
                label = root[component]
                alike = np.flatnonzero((score >= similarity) & _meets(row, other, label, outside, side, split))
                # one link for each row and component that it meets
                _, one = np.unique(row[alike] * len(root) + label[other[alike]], return_index=True)
                for i in alike[one]:
                    x, y = find(component[row[i]]), find(component[other[i]])
                    if x != y:
                        root[x] = y
                        a, b = sorted((nodes[row[i]], nodes[other[i]]))
                        for name, value in zip(out, (a, b, float(score[i])), strict=True):
                            out[name].append(value)
            yield pa.record_batch({"a": pa.array(out["a"], pa.binary()), "b": pa.array(out["b"], pa.binary()), "similarity": pa.array(out["similarity"], pa.float64())})

    return judge


def tile_links(labelled: DataFrame, buckets: DataFrame, info: DataFrame, sets: DataFrame, similarity: float, exact: bool, room: int) -> DataFrame:
    """Stored links of what the stars leave: all pairs of an open bucket whose components differ are judged."""
    placed = tiles_of(labelled, buckets, info, similarity, room)
    schema = "node binary, component binary, outside boolean, band int, bucket long, c1 int, p1 int, c2 int, p2 int, side int"
    left = placed.select(*[c.split()[0] for c in schema.split(", ")])
    if not exact:
        sampled = placed.join(info.drop("weight"), "node").repartition(*TILE).sortWithinPartitions(*TILE, "node")
        left = sampled.mapInArrow(flag_members(similarity), schema)
    left = stored(left, "tile-members")
    joined = left.join(sets, "node").repartition(*TILE).sortWithinPartitions(*TILE, "node")
    return stored(joined.mapInArrow(judge_tiles(similarity), "a binary, b binary, similarity double"), "links")


def near_links(nodes: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY, exact: bool = False, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """Verified links that hold each class together, and the nodes' components.

    Every pair of nodes that share a bucket is in one component if it is alike;
    ``exact`` leaves out the test on samples, the only one that can be wrong.
    """
    info = nodes.select("node", "weight", "bands", *PACKED)
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = stored(members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"), "buckets")
    members = stored(members.join(sizes, ["band", "bucket"]), "members")
    sets = shingle_sets(members, nodes, docs, idf)
    links, classes = None, None
    for turn in range(TURNS + 1):
        labelled = labelled_members(members, classes)
        buckets = open_buckets(labelled, turn)
        if links is not None and buckets.isEmpty():
            break
        found = star_links(labelled, buckets, info.drop("bands"), sets, similarity, exact) if turn < TURNS else tile_links(labelled, buckets, info, sets, similarity, exact, room)
        if links is not None and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        classes = components(links)
    return links, classes


def _linked(docs: DataFrame, id_col: str, text_col: str, similarity: float, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their nodes, nodes, verified links and the nodes' components."""
    own = keyed(docs, id_col, text_col)
    idf = word_idf(own)
    signed = signatures(own, idf, similarity)
    firsts = signed.groupBy("node").agg(F.min(F.struct("doc_id", "row", "weight", "bands", *PACKED)).alias("f"))
    nodes = stored(firsts.select("node", "f.*"), "nodes")
    return signed, nodes, *near_links(nodes, own, idf, similarity, exact)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, exact: bool = False, links: bool = False) -> DataFrame:
    """doc_id, row (hash of id and text), component (the class), class_id and class_size for every row.

    With ``links`` also n_links: the verified links between different texts that
    hold the class together, none for copies of one text.
    """
    signed, _, found, classes = _linked(docs, id_col, text_col, similarity, exact)
    labelled = signed.select("doc_id", "row", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled.select("doc_id", "row", "component"), "labelled")
    sizes = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    if links:
        pairs = found.select(F.col("a").alias("node"), "b").distinct()
        counts = pairs.join(classes, "node").groupBy("component").agg(F.count(F.lit(1)).alias("n_links"))
        sizes = sizes.join(counts, "component", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    # stored first: a class that holds a third of all rows is then split on the way to its join
    sizes = stored(sizes, "class-sizes")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return labelled.join(sizes, "component").select(back("doc_id"), "row", "component", back("class_id"), "class_size", *(["n_links"] if links else []))


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """a_id, b_id, similarity: the verified links between different texts, each text by its smallest doc_id."""
    _, nodes, found, _ = _linked(docs, id_col, text_col, similarity, exact)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    one, two = (nodes.select(F.col("node").alias(n), F.col("doc_id").alias(f"{n}_id")) for n in ("a", "b"))
    return found.dropDuplicates(["a", "b"]).join(one, "a").join(two, "b").select(back("a_id"), back("b_id"), "similarity")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of one document of each class, the one with the smallest id; all columns stay.

    Of equal rows (same id and text) one stays.
    """
    classes = near_duplicates(docs, id_col, text_col, similarity)
    row, first_id = unused(docs, "_keep_row"), unused(docs, "_first")
    firsts = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component", "row", "class_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = firsts.groupBy("component").agg(F.min(F.struct("row", "class_id", "n")).alias("f")).select(F.col("f.row").alias(row), F.coalesce("f.class_id", F.lit(NULL_ID)).alias(first_id), "f.n")
    firsts = stored(firsts, "firsts")
    own_row = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    same = (own_row == F.col(row)) & (row_id(id_col) == F.col(first_id))
    if firsts.filter("n > 1").isEmpty():
        return docs.join(firsts.drop("n").hint("shuffle_hash"), same, "left_semi")
    # some rows occur several times: those alone are made distinct
    again = firsts.filter("n > 1").drop("n")
    once = docs.join(firsts.filter("n = 1").drop("n").hint("shuffle_hash"), same, "left_semi")
    several = docs.join(again.hint("shuffle_hash"), same).dropDuplicates([row, first_id])
    return once.unionByName(several.select(*docs.columns))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: doc_id, class_id (smallest doc_id of its class), class_size, n_links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, links=True).select("doc_id", "class_id", "class_size", "n_links")
