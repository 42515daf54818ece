"""Removal of byte strings that an earlier document holds, by suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts in a document
with a smaller id; strings are judged on the input. Three steps:

1. Seeds (see ``seeds``) tell which places may repeat; the rest of the text is
   left alone from here on.
2. Each repeated seed, with the bytes of the windows it owns, goes to the bucket
   of its hash, so equal strings meet. Equal contexts are one from there on, with
   the list of their places; nothing is decided by that.
3. In a bucket, contexts arrive in the order of their smallest document, in
   batches. Each batch gets a suffix array: its window starts, sorted by all bytes
   that follow. The array is merge-scanned against every level of the index;
   where neighbours of the merged order agree in ``length`` bytes or more, the
   strings are equal, and the smallest document of the run is the earliest that
   holds them. Then the batch joins the index: equal-sized levels merge, so n
   strings are kept in about log n sorted levels and each is merged as often.
   Every removed byte is one of a window for which the index knows an earlier
   document.

A seed hash that occurs at over ``HEAVY`` places is dealt out window by window, and
of such a window each batch of documents sends its smallest document alone: the
earliest one comes back to the batch, which looks at its own places. A passage that
very many documents hold so brings a row for each batch to a task, not its places.
``StoredIndex`` keeps the family across batches that arrive over time: its levels
are tables of contexts with their suffix arrays, merged by jobs.

Within a bucket the seeds are taken in groups of ``GROUP_STRINGS`` windows, each
with an index of its own: windows of different seeds are never equal.

Defined cases: null and empty texts have nothing to remove; rows with equal ids
do not remove from each other; a null id counts as later than all others;
repeated rows each get the result; texts shorter than ``length`` stay whole;
an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, new_path, row_id, stored, unused
from .seeds import BEFORE, CONTEXT_ROWS, NEVER, SPAN_ROWS, VERDICT_ROWS, Contexts, Sizes, arrow_schema, batched, context_texts, judged, keyed, merged_spans, raw_texts, repeated_spans, send_contexts, settle, sizes_for, split_bytes, with_spans

LENGTH = 50
SEED = 20
#: Window starts in a batch of the index family, and in one index.
BATCH_STRINGS, GROUP_STRINGS = 1 << 16, 1 << 18


def suffixes(texts: list[bytes], n: np.ndarray, width: int) -> np.ndarray:
    """The first ``n`` suffixes of each text as strings of ``width`` bytes, with zeros after the text's end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + width
    begin = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    flat = np.frombuffer(bytes(width).join([*texts, b""]), np.uint8)
    if not len(begin):
        return np.zeros(0, f"S{width}")
    return np.lib.stride_tricks.sliding_window_view(flat, width)[begin].view(f"S{width}").ravel()


def suffix_array(texts: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``suffixes`` and their sorted order."""
    strings = suffixes(texts, n, width)
    return strings, np.argsort(strings, kind="stable")


def common_prefix(strings: np.ndarray) -> np.ndarray:
    """Bytes that each of some strings of equal width has in common with the one after it."""
    rows = strings.view(np.uint8).reshape(len(strings), -1)
    apart = rows[1:] != rows[:-1]
    return np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])


class IndexFamily:
    """Sorted levels of suffixes with the smallest document of each."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two sorted levels in one order, and where each element came from; a stable sort merges the two runs."""
        strings = np.concatenate([one[0], two[0]])
        order = np.argsort(strings, kind="stable")
        return strings[order], np.concatenate([one[1], two[1]])[order], order

    def scan_and_add(self, strings: np.ndarray, docs: np.ndarray, order: np.ndarray) -> np.ndarray:
        """For each suffix of a new batch the smallest document whose suffix agrees with it in ``length`` bytes, itself included."""
        batch, whose = strings[order], docs[order]
        number = np.arange(len(order))  # of each element the place in the batch, -1 if it comes from a level
        earliest = docs.copy()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        grows = True
        for level in self.levels[::-1] or [(strings[:0], docs[:0])]:  # from the smallest on
            both, docs_of, source = self.merged(level, (batch, whose))
            turn = np.flatnonzero(np.r_[True, common_prefix(both) < self.length]) if len(both) else np.zeros(0, np.int64)
            lowest = np.repeat(np.minimum.reduceat(docs_of, turn), np.diff(np.r_[turn, len(both)])) if len(both) else docs_of
            place = np.concatenate([np.full(len(level[0]), -1), number])[source]
            at = order[place[place >= 0]]
            earliest[at] = np.minimum(earliest[at], lowest[place >= 0])
            grows = grows and len(level[0]) <= 2 * len(batch)
            if grows:  # geometric merge: the merged order stands for both from here on
                batch, whose, number = both, docs_of, place
            else:
                kept.append(level)
        turn = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else np.zeros(0, np.int64)
        self.levels = [*kept[::-1], (batch[turn], np.minimum.reduceat(whose, turn) if len(turn) else whose)]
        return earliest


class Level:
    """A stored level of a bucket: contexts of earlier batches, and the numbers of their suffixes in sorted order."""

    def __init__(self, row: dict[str, bytes], length: int, k: int):
        self.key, self.at, self.texts = context_texts({c: [x] for c, x in row.items()})
        self.n = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) - length + 1
        self.order = np.frombuffer(row["suffixes"], np.uint32).astype(np.int64)
        self.width = 2 * length - k

    def part(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level of an index for some seeds: their suffixes, still sorted; all are earlier than any document to come."""
        own = np.isin(self.key, keys)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        inside = own[owner]
        number = np.cumsum(inside) - 1  # of a suffix among those of the seeds
        strings = suffixes([t for t, x in zip(self.texts, own, strict=True) if x], self.n[own], self.width)
        strings = strings[number[self.order[inside[self.order]]]]
        return strings, np.full(len(strings), BEFORE, np.int64)


def make_level(length: int, k: int):
    """Bucket: the contexts of a batch and of levels that join it as one level; the sorted runs are merged."""

    def make(sent: pa.Table, levels: pa.Table) -> pa.Table:
        texts: dict[tuple[int, int, bytes], int] = {}
        runs = []
        for table, own in ((levels, False), (sent, True)):
            for row in table.drop_columns(["bucket"]).to_pylist():
                key, at, parts = context_texts({c: [x] for c, x in row.items()})
                number = [texts.setdefault(x, len(texts)) for x in zip(key.tolist(), at.tolist(), parts, strict=True)]
                runs.append((number, None if own else np.frombuffer(row["suffixes"], np.uint32).astype(np.int64)))
        heads = list(texts)
        plain = [x[2] for x in heads]
        n = np.fromiter(map(len, plain), np.int64, len(plain)) - length + 1
        strings, offset = suffixes(plain, n, 2 * length - k), np.cumsum(n) - n
        order, seen = np.zeros(0, np.int64), np.zeros(len(plain), bool)
        for number, sorted_ in runs:
            fresh = np.array([x for x in dict.fromkeys(number) if not seen[x]], np.int64)
            seen[fresh] = True
            if sorted_ is None:
                run = np.concatenate([np.arange(offset[x], offset[x] + n[x]) for x in fresh]) if len(fresh) else order[:0]
                run = run[np.argsort(strings[run], kind="stable")]
            else:  # from the level's numbers to those of the whole
                own = np.array(number, np.int64)
                run = (np.repeat(offset[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum())))[sorted_]
                run = run[np.isin(np.repeat(own, n[own])[sorted_], fresh)]
            both = np.concatenate([order, run])
            order = both[np.argsort(strings[both], kind="stable")]
        numbers = lambda i, dtype: np.fromiter((x[i] for x in heads), dtype, len(heads)).tobytes()
        bucket = (sent if sent.num_rows else levels).column("bucket")[0].as_py()
        size = np.fromiter(map(len, plain), np.uint32, len(plain)).tobytes()
        row = {"bucket": pa.array([bucket], pa.int32()), "key": [numbers(0, np.uint64)], "at": [numbers(1, np.uint16)], "size": [size], "context": [pa.compress(b"".join(plain), codec="zstd", asbytes=True)], "suffixes": [order.astype(np.uint32).tobytes()]}
        return pa.table({c: x if c == "bucket" else pa.array(x, pa.binary()) for c, x in row.items()})

    return make


LEVEL_ROWS = "bucket int, key binary, at binary, size binary, context binary, suffixes binary"


class StoredIndex:
    """The index family over batches of documents that arrive one after the other.

    A level is a table in the shared folder, a row for each bucket of seeds, with
    the contexts of all seeds of its batches and their suffix array. A new batch
    is scanned against every level; then it becomes a level and is joined, by one
    job, with the levels that are not more than twice as large. ``levels`` (path
    and number of contexts, oldest first) is all that a later session needs.

    Unlike in ``earlier_spans`` no seed can be left out, as a batch to come may
    repeat it: the index holds a context of up to ``2 * length - k`` bytes for
    each seed. Take enough buckets that one holds a few megabytes of text.
    """

    def __init__(self, spark: SparkSession, buckets: int, length: int = LENGTH, k: int = SEED, levels: list[tuple[str, int]] | None = None):
        self.spark, self.buckets, self.length, self.k, self.levels = spark, buckets, length, k, list(levels or [])

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LEVEL_ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], LEVEL_ROWS)

    def scan_and_add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """row, doc_id, spans of the batch's documents that earlier batches, or smaller ids of the batch, hold; then the batch joins the index."""
        length, k, buckets = self.length, self.k, self.buckets
        own = keyed(docs, id_col, text_col)
        sizes = sizes_for(own)
        send = send_contexts(split_bytes, length, k, buckets)
        texts = batched(own, sizes).repartition(sizes.tasks, "batch").groupBy("batch")
        sent = stored(texts.applyInArrow(lambda t: send(t, None, 1), CONTEXT_ROWS), "batch-contexts")

        def scan(new: pa.Table, old: pa.Table) -> pa.Table:
            levels = [Level(row, length, k) for row in old.drop_columns(["bucket"]).to_pylist()]
            return judged(scan_contexts(length, k, levels), sizes.batches, buckets)(new) if new.num_rows else arrow_schema(VERDICT_ROWS).empty_table()

        dealt = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
        verdicts = dealt(sent).cogroup(dealt(self._read([p for p, _ in self.levels]))).applyInArrow(scan, VERDICT_ROWS)
        found = stored(verdicts.repartition(sizes.tasks, "batch").groupBy("batch").applyInArrow(settle(length), SPAN_ROWS), "spans")
        size = sent.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("n")).first()["n"] // 8
        joining = []
        while self.levels and self.levels[-1][1] <= 2 * size:  # geometric merge
            path, n = self.levels.pop()
            joining.append(path)
            size += n
        path = new_path(self.spark, "level")
        dealt(sent).cogroup(dealt(self._read(joining))).applyInArrow(make_level(length, k), LEVEL_ROWS).write.parquet(path)
        self.levels.append((path, size))
        return found


def first_documents(c: Contexts, first: np.ndarray, length: int, k: int, levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """For each context's windows, in one array, the smallest document that the index finds for them; and how many windows each has.

    All windows of a context go into the suffix arrays, as its neighbours may
    share some of them. A context that has its seed for itself can only match as
    a whole: of it one suffix goes in, whose match covers all its windows.
    """
    n = np.fromiter(map(len, c.texts), np.int64, len(c.texts)) - length + 1
    _, seed, times = np.unique(c.key, return_inverse=True, return_counts=True)
    alone = times[seed] == 1
    for level in levels:
        alone &= ~np.isin(c.key, level.key)
    sent = np.where(alone, 1, n)
    offset = np.cumsum(sent) - sent
    found = np.full(int(sent.sum()), NEVER, np.int64)
    by_seed = np.argsort(seed, kind="stable")
    # a seed belongs to the group in which it begins
    before = np.cumsum(sent[by_seed]) - sent[by_seed]
    group = (before[np.searchsorted(seed[by_seed], np.arange(len(times)))] // GROUP_STRINGS)[seed]
    order = np.lexsort((first, group))
    ends = np.searchsorted(group[order], group[order], "right")
    family, now, at = None, -1, 0
    while at < len(order):
        if group[order[at]] != now:
            family, now = IndexFamily(length), group[order[at]]
            family.levels = [x for x in (level.part(c.key[group == now]) for level in levels) if len(x[0])]
        size = np.cumsum(sent[order[at : ends[at]]])
        part = order[at : at + max(1, int(np.searchsorted(size, BATCH_STRINGS, "right")))]
        at += len(part)
        strings, sorted_ = suffix_array([c.texts[i] for i in part], sent[part], 2 * length - k)
        step = np.arange(len(strings)) - np.repeat(np.cumsum(sent[part]) - sent[part], sent[part])
        found[np.repeat(offset[part], sent[part]) + step] = family.scan_and_add(strings, np.repeat(first[part], sent[part]), sorted_)
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return found[offset[owner] + np.minimum(step, sent[owner] - 1)], n


def scan_contexts(length: int, k: int, levels: list[Level] = []):  # noqa: B006
    """Contexts: spans of places whose documents repeat strings of earlier ones, or of stored levels; each context's earliest document."""

    def scan(c: Contexts) -> tuple[np.ndarray, np.ndarray]:
        found, n = first_documents(c, c.first, length, k, levels)
        latest, earliest = (x.reduceat(found, np.cumsum(n) - n) for x in (np.maximum, np.minimum))
        # places of documents after all those found lose the whole context
        gone = np.flatnonzero(c.doc_id > latest[c.owner])
        spans = [c.spans(gone, np.zeros(len(gone), np.int64), n[c.owner[gone]] - 1 + length)]
        # the others are judged window by window
        rest = np.flatnonzero((c.doc_id <= latest[c.owner]) & (earliest[c.owner] < c.doc_id))
        times = n[c.owner[rest]]
        at = np.repeat((np.cumsum(n) - n)[c.owner[rest]], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        which, start, end = c.runs(found[at] < np.repeat(c.doc_id[rest], times), times, length, rest)
        return np.concatenate([*spans, c.spans(rest[which], start, end)]), earliest

    return scan


def scan_bucket(length: int, k: int):
    """Bucket: row, doc_id, start and end of the spans of one bucket's places."""
    scan = scan_contexts(length, k)
    return lambda table: pa.table(dict(zip(("row", "doc_id", "start", "end"), scan(Contexts(table))[0].T, strict=True)))


def earlier_spans(docs: DataFrame, length: int = LENGTH, k: int = SEED, sizes: Sizes | None = None) -> DataFrame:
    """row, doc_id, spans (start and end in bytes, maximal, packed) of a keyed table (see ``seeds.keyed``)."""
    return repeated_spans(docs, split_bytes, length, k, scan_contexts(length, k), "spans", sizes or sizes_for(docs))


def _cut(raw: bytes, packed) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, number of maximal removed runs."""
    if packed is None or not len(packed):
        return raw, 0, 0
    packed = np.asarray(packed, np.int64)
    start, end = merged_spans(packed >> 32, packed & 0xFFFFFFFF)
    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), int((end - start).sum()), len(start)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (bytes left, as binary), n_bytes, n_removed, n_spans for every row."""

    def cut(batches):
        for b in batches:
            found = [(raw, *_cut(raw, s.values.to_numpy() if s.is_valid else None)) for raw, s in zip(raw_texts(b), b.column("spans"), strict=True)]
            ids = [None if x == NULL_ID else x for x in b.column("doc_id").to_pylist()]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array([x[1] for x in found], pa.binary()), "n_bytes": pa.array([len(x[0]) for x in found], pa.int64()), "n_removed": pa.array([x[2] for x in found], pa.int64()), "n_spans": pa.array([x[3] for x in found], pa.int64())})

    own = keyed(docs, id_col, text_col)
    sizes = sizes_for(own)
    joined = with_spans(own, "row", "doc_id", earlier_spans(own, length, k, sizes), "spans", sizes)
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def cut_texts(docs: DataFrame, length: int = LENGTH, k: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with repeated strings cut from its texts; all columns and rows stay.

    A character of which only some bytes are left goes.
    """
    others = [c for c in docs.columns if c != text_col]
    row, order, found = unused(docs, "_row"), unused(docs, "_order"), unused(docs, "_spans")
    own = keyed(docs, id_col, text_col)
    sizes = sizes_for(own)
    spans = earlier_spans(own, length, k, sizes)
    text_hash = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    joined = with_spans(docs.withColumns({row: text_hash, order: row_id(id_col)}), row, order, spans, found, sizes)
    schema = docs.schema

    def cut(batches):
        for b in batches:
            raw = b.column(text_col).cast(pa.binary()).to_pylist()
            left = [x if x is None or not s.is_valid else _cut(x, s.values.to_numpy())[0].decode("utf-8", "ignore").encode() for x, s in zip(raw, b.column(found), strict=True)]
            arrays = {c: b.column(c) for c in others} | {text_col: pa.array(left, pa.binary()).cast(pa.string())}
            yield pa.record_batch([arrays[c] for c in schema.names], names=schema.names)

    return joined.select(*schema.names, found).mapInArrow(cut, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without the strings of earlier ones: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = suffix_dedup(docs)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

