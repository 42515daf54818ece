"""Winnowed seeds: where may a stretch of ``length`` tokens occur twice?

Every window of ``length`` tokens selects its lowest ``k``-token hash, the
leftmost of equal ones. The choice depends on the window's tokens alone, so
equal windows select the same place in them: documents that share a window
share the seed. A seed owns the windows that select it, a run of starts.

``repeated_seeds`` finds the seeds whose hash occurs at two places of the
corpus. Documents are dealt into batches of about ``BATCH_BYTES`` by a hash.
Each batch sends every hash once, with its count, to the hash's bucket, about 6
bytes a seed, and gets back those that occur elsewhere too: a passage that a
third of all documents hold costs one entry a batch. The 32-bit hashes within
a bucket are a filter: a false meeting costs work later but changes no result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import parts_for, release, stored, text_bytes, unused

#: Text bytes hashed at once: temporary arrays stay near the processor.
HASH_BYTES = 1_000_000
#: Text bytes whose seeds are sent together.
BATCH_BYTES = 8_000_000
#: Text bytes of the batches in a task.
TASK_BYTES = 32_000_000
#: Text bytes for a bucket of seed hashes, and for a bucket of contexts.
HASH_BUCKET_BYTES, BUCKET_BYTES = 64_000_000, 12_000_000
#: A seed hash at more places is heavy: its windows are dealt out one by one.
HEAVY = 4096

_PLACE = np.uint64((1 << 30) - 1)  # a run of texts has fewer tokens; the bits above are the hash
_MIX1, _MIX2, _MULT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in one array, and how many each has."""
    return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    inverse = pow(_MULT, -1, 1 << 64)
    for out, base in ((up, _MULT), (down, inverse)):
        out[0], size = 1, 1
        while size < n:
            step = min(size, n - size)
            out[size : size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
            size += step
    return up, down


_held: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and how many each text has."""
    return placed_words(texts)[:2]


def placed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than blanks; a word's hash is a polynomial of its bytes.

    With the words' hashes and counts come the bytes where they begin and end
    in the texts joined by a byte.
    """
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[flat]
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    last = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    if "p" not in _held or len(_held["p"][0]) < len(flat):
        _held["p"] = _powers(max(len(flat), 2 * HASH_BYTES))
    up, down = _held["p"]
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.diff(np.r_[0, np.searchsorted(first, ends)]), first, last


def split_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Token hashes and counts, the texts as one string, and where each token begins and ends in it."""
    tokens, counts = byte_tokens(texts)
    at = np.arange(len(tokens) + 1)
    return tokens, counts, b"".join(texts), at[:-1], at[1:]


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """``split_bytes`` for words; one space stands between them."""
    plain = [b" ".join(t.split()) for t in texts]
    words, counts, first, last = placed_words(plain)
    return words, counts, b"\n".join(plain), first, last


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive tokens, by doubling."""
    found, covered, part, size = None, 0, tokens, 1
    while True:
        if k & size:
            if found is None:
                found = part
            else:
                n = len(tokens) - covered - size + 1
                found = found[:n] * np.uint64(pow(_MULT, size, 1 << 64)) + part[covered : covered + n]
            covered += size
        if covered == k:
            return mix(found)
        part = part[:-size] * np.uint64(pow(_MULT, size, 1 << 64)) + part[size:]
        size *= 2


@dataclass
class Seeds:
    """Seeds of a run of texts: place, owned window starts [low, high], text, hash."""

    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    key: np.ndarray


def winnow(tokens: np.ndarray, counts: np.ndarray, length: int, k: int) -> Seeds:
    none = np.zeros(0, np.int64)
    starts = np.cumsum(np.r_[0, counts])
    n = len(tokens) - length + 1
    if n < 1 or counts.max(initial=0) < length:
        return Seeds(none, none, none, none, none.astype(np.uint64))
    hashes = gram_hashes(tokens, k)
    reach = length - k + 1
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[reach - size : reach - size + n])
    # a window that would run over its text's end is none
    bad = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(bad, np.maximum(starts[:-1], starts[1:] - length + 1), 1)
    np.add.at(bad, starts[1:], -1)
    at = np.flatnonzero(np.cumsum(bad)[:n] == 0)
    if not len(at):
        return Seeds(none, none, none, none, none.astype(np.uint64))
    chosen = (low[at] & _PLACE).astype(np.int64)
    turn = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    place = chosen[turn]
    return Seeds(place, at[turn], at[np.r_[turn[1:] - 1, len(at) - 1]], np.searchsorted(starts, place, "right") - 1, hashes[place])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null last), row (hash of id and text), text: null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    return docs.select(order.alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))


@dataclass
class Sizes:
    """Numbers of batches, of tasks that hold them, of buckets of hashes and of contexts, by the size of the text."""

    batches: int
    tasks: int
    hashes: int
    buckets: int


def sizes_for(docs: DataFrame) -> Sizes:
    n, spark = text_bytes(docs), docs.sparkSession
    return Sizes(max(1, -(-n // BATCH_BYTES)), parts_for(spark, n, TASK_BYTES), parts_for(spark, n, HASH_BUCKET_BYTES), parts_for(spark, n, BUCKET_BYTES))


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket, and (bucket, from, to) of those that have members."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    ordered = bucket[order]
    turn = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
    ends = np.r_[turn[1:], len(order)] if len(order) else turn
    return order, [(int(ordered[i]), int(i), int(j)) for i, j in zip(turn, ends, strict=True)]


def column(blobs: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


SEED_ROWS = "bucket int, batch long, key binary, n binary"
REPEATED_ROWS = "batch long, bucket int, key binary, heavy binary"


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def send_seeds(tokenize: Callable, length: int, k: int, buckets: int):
    """Batch: its distinct seed hashes and their counts, a row for each bucket."""

    def send(table: pa.Table) -> pa.Table:
        keys = []
        for b in text_batches(table.to_batches(), HASH_BYTES):
            tokens, counts = tokenize(raw_texts(b))
            keys.append(winnow(tokens, counts, length, k).key)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        bucket = bucket_of(key, buckets)
        order, runs = by_bucket(bucket, buckets)
        low, n = key[order].astype(np.uint32), np.minimum(n[order], 65535).astype(np.uint16)
        batch = table.column("batch")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _, _ in runs], pa.int32()), "batch": pa.array([batch] * len(runs), pa.int64()), "key": pa.array([low[i:j].tobytes() for _, i, j in runs], pa.binary()), "n": pa.array([n[i:j].tobytes() for _, i, j in runs], pa.binary())})

    return send


def meet(most: int):
    """Bucket: for each batch those of its hashes that occur more than once, and whether they do at over ``most`` places."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = table.column("key").to_pylist(), table.column("n").to_pylist()
        key, n = column(keys, np.uint32), column(counts, np.uint16).astype(np.int64)
        order = np.argsort(key)
        turn = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], turn), np.diff(np.r_[turn, len(key)]))
        out, at = {"batch": [], "bucket": [], "key": [], "heavy": []}, 0
        for raw, batch, bucket in zip(keys, table.column("batch").to_pylist(), table.column("bucket").to_pylist(), strict=True):
            own = slice(at, at + len(raw) // 4)
            at = own.stop
            hot = total[own] > 1
            if hot.any():
                for name, x in zip(out, (batch, bucket, key[own][hot].tobytes(), (total[own][hot] > most).tobytes()), strict=True):
                    out[name].append(x)
        return pa.table({"batch": pa.array(out["batch"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "key": pa.array(out["key"], pa.binary()), "heavy": pa.array(out["heavy"], pa.binary())})

    return run


def batched(docs: DataFrame, sizes: Sizes) -> DataFrame:
    return docs.withColumn("batch", F.pmod(F.col("row"), F.lit(sizes.batches)).cast("long"))


def repeated_seeds(docs: DataFrame, tokenize: Callable, length: int, k: int, sizes: Sizes) -> DataFrame:
    """Stored rows by batch and bucket: seed hashes of the batch that occur elsewhere, too."""
    sent = batched(docs, sizes).select("batch", "text").repartition(sizes.tasks, "batch").groupBy("batch").applyInArrow(send_seeds(tokenize, length, k, sizes.hashes), SEED_ROWS)
    met = sent.repartition(sizes.hashes, "bucket").groupBy("bucket").applyInArrow(meet(HEAVY), REPEATED_ROWS)
    return stored(met, "seeds")


CONTEXT_ROWS = "bucket int, batch long, key binary, at binary, size binary, context binary, times binary, first binary, start binary, doc binary, docs binary"
VERDICT_ROWS = "batch long, bucket int, spans binary, verdict binary, times binary, start binary, doc binary, docs binary"
SPAN_ROWS = "row long, doc_id long, spans array<long>"
#: A heavy window goes from places of documents after its verdict: all are after the first of these, none after the second.
BEFORE, NEVER = -(2**63), 2**63 - 1


def arrow_schema(rows: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c, kinds[kind]) for c, kind in (x.split() for x in rows.split(", "))])


def send_contexts(split: Callable, length: int, k: int, buckets: int):
    """Task: repeated seeds with the text of the windows they own, dealt to the buckets of their hashes.

    Places with equal seed and text are one context with a list of places. A
    heavy seed's windows go one by one, under a hash of the window, with their
    count and smallest document alone. Their places stay with the batch, in one
    row that a bucket of the batch's own passes on; they are in the order of the
    buckets that judge them.
    """

    def send(own: pa.Table, found: pa.Table | None, hashes: int) -> pa.Table:
        repeated = Repeated(found, hashes) if found is not None else None  # None: all seeds are sent
        light: dict[tuple[int, int, bytes], list[int]] = {}
        hot_windows: dict[tuple[int, int, bytes], list[int]] = {}
        ids, rows, base = [], [], 0
        for b in text_batches(own.to_batches(), HASH_BYTES):
            tokens, counts, flat, first, last = split(raw_texts(b))
            s = winnow(tokens, counts, length, k)
            hot, heavy = repeated.marks(s.key) if repeated else (np.ones(len(s.key), bool), np.zeros(len(s.key), bool))
            place, low, high, doc, key, heavy = (x[hot] for x in (s.place, s.low, s.high, s.doc, s.key, heavy))
            times = np.where(heavy, high - low + 1, 1)
            pick = np.repeat(np.arange(len(place)), times)
            step = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            place, doc, key, heavy = place[pick], doc[pick], key[pick], heavy[pick]
            low, high = np.where(heavy, low[pick] + step, low[pick]), np.where(heavy, low[pick] + step, high[pick])
            if heavy.any():
                key[heavy] = mix(key[heavy] + gram_hashes(tokens, length)[low[heavy]])
            start = low - np.cumsum(np.r_[0, counts])[doc]
            for x, at, i, j, d, o, h in zip(key.tolist(), (place - low).tolist(), first[low].tolist(), last[high + length - 1].tolist(), (doc + base).tolist(), start.tolist(), heavy.tolist(), strict=True):
                (hot_windows if h else light).setdefault((x, at, flat[i:j]), []).extend((d, o))
            ids.append(b.column("doc_id").to_numpy())
            rows.append(b.column("row").to_numpy())
            base += b.num_rows
        doc_id, row = np.concatenate(ids), np.concatenate(rows)
        batch = own.column("batch")[0].as_py() if "batch" in own.column_names else 0
        out: list[dict] = []

        def placed(members: list[list[int]]) -> dict:
            places = np.array([v for x in members for v in x], np.int64).reshape(-1, 2)
            docs, index = np.unique(places[:, 0], return_inverse=True)
            return {"start": places[:, 1].astype(np.uint32).tobytes(), "doc": index.astype(np.uint32).tobytes(), "docs": np.stack([row[docs], doc_id[docs]], 1).tobytes()}

        for groups, heavy in ((light, False), (hot_windows, True)):
            key = np.fromiter((g[0] for g in groups), np.uint64, len(groups))
            bucket = bucket_of(key, buckets)
            order = np.lexsort((key, bucket))
            _, runs = by_bucket(bucket[order], buckets)
            heads, members = list(groups), list(groups.values())
            for b, i, j in runs:
                at = order[i:j].tolist()
                texts = [heads[x][2] for x in at]
                numbers = lambda values, dtype: np.fromiter(values, dtype, len(at)).tobytes()
                sent = {"bucket": b, "batch": batch, "key": key[at].tobytes(), "at": numbers((heads[x][1] for x in at), np.uint16), "size": numbers(map(len, texts), np.uint32), "context": pa.compress(b"".join(texts), codec="zstd", asbytes=True), "times": numbers((len(members[x]) // 2 for x in at), np.uint32)}
                out.append(sent | ({"first": numbers((doc_id[members[x][::2]].min() for x in at), np.int64)} if heavy else placed([members[x] for x in at])))
            if heavy and groups:
                ordered = [members[x] for x in order.tolist()]
                out.append({"bucket": buckets + batch, "batch": batch, "times": np.fromiter((len(x) // 2 for x in ordered), np.uint32, len(ordered)).tobytes()} | placed(ordered))
        return pa.Table.from_pylist(out, arrow_schema(CONTEXT_ROWS))

    return send


def context_texts(blobs: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Seed hash, place of the seed and text of all contexts of some rows."""
    key, at, size = column(blobs["key"], np.uint64), column(blobs["at"], np.uint16), column(blobs["size"], np.uint32).astype(np.int64)
    parts, begin = [], 0
    for raw, head in zip(blobs["context"], blobs["key"], strict=True):
        own = size[begin : begin + len(head) // 8]
        begin += len(own)
        text, ends = pa.decompress(raw, int(own.sum()), codec="zstd", asbytes=True), np.cumsum(np.r_[0, own]).tolist()
        parts += [text[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return key, at, parts


def place_documents(blobs: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and document of all places of some rows."""
    docs, base = column(blobs["docs"], np.int64).reshape(-1, 2), np.cumsum([0, *(len(x) // 16 for x in blobs["docs"])])[:-1]
    doc = column(blobs["doc"], np.uint32) + np.repeat(base, [len(x) // 4 for x in blobs["doc"]])
    return docs[doc, 0], docs[doc, 1]


class Contexts:
    """What a bucket receives: contexts that are equal are one again, whoever sent them.

    Of each context its seed's hash, where the seed stands in it, its text, the
    number of its places and the smallest document; of each place of those that
    are not heavy its context, row, document and start. ``heavy`` holds batch,
    bucket and contexts of each row of heavy windows.
    """

    def __init__(self, table: pa.Table):
        blobs = {c: [x or b"" for x in table.column(c).to_pylist()] for c in table.column_names if c not in ("bucket", "batch")}
        key, at, parts = context_texts(blobs)
        number: dict[tuple[int, int, bytes], int] = {}
        of = np.fromiter((number.setdefault(x, len(number)) for x in zip(key.tolist(), at.tolist(), parts, strict=True)), np.int64, len(parts))
        heads = list(number)
        self.key = np.fromiter((x[0] for x in heads), np.uint64, len(heads))
        self.at = np.fromiter((x[1] for x in heads), np.int64, len(heads))
        self.texts = [x[2] for x in heads]
        ends = np.cumsum([len(x) // 8 for x in blobs["key"]])
        own = [of[i:j] for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        dealt = zip(table.column("batch").to_pylist(), table.column("bucket").to_pylist(), own, blobs["first"], strict=True)
        self.heavy = [(batch, bucket, x) for batch, bucket, x, first in dealt if first]
        hot = np.repeat([len(x) > 0 for x in blobs["first"]], [len(x) for x in own])
        times = column(blobs["times"], np.uint32).astype(np.int64)
        self.owner = np.repeat(of, np.where(hot, 0, times))
        self.times = np.zeros(len(heads), np.int64)
        np.add.at(self.times, of, times)
        self.start = column(blobs["start"], np.uint32).astype(np.int64)
        self.row, self.doc_id = place_documents(blobs)
        self.first = np.full(len(heads), NEVER, np.int64)
        np.minimum.at(self.first, self.owner, self.doc_id)
        np.minimum.at(self.first, of[hot], column(blobs["first"], np.int64))

    def spans(self, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """row, document, start and end of spans of given places, counted from where the place's context starts."""
        return np.stack([self.row[place], self.doc_id[place], self.start[place] + start, self.start[place] + end], 1)

    def runs(self, verdict: np.ndarray, n: np.ndarray, length: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of windows with a verdict, window by window of the given contexts: number of the context in the list, start, end."""
        owner = np.repeat(np.arange(len(contexts)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = np.flatnonzero(verdict)
        owner, step = owner[at], step[at]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else new
        return owner[new], step[new], step[last] + length


def judged(judge: Callable, batches: int, buckets: int):
    """Bucket: spans and verdicts, dealt to the batches that the documents came from.

    ``judge`` maps contexts to spans of their places and to a verdict for each
    context, of which only those of heavy windows are used.
    """

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:  # a batch's places pass
            return pa.Table.from_pylist(table.select(["batch", "times", "start", "doc", "docs"]).to_pylist(), arrow_schema(VERDICT_ROWS))
        c = Contexts(table)
        spans, verdict = judge(c)
        batch = spans[:, 0] % batches
        order = np.argsort(batch, kind="stable")
        turn = np.flatnonzero(np.diff(batch[order], prepend=-1))
        out = [{"batch": int(batch[order[i]]), "spans": spans[order[i:j]].tobytes()} for i, j in zip(turn, np.r_[turn[1:], len(order)], strict=True)] if len(order) else []
        out += [{"batch": own, "bucket": bucket, "verdict": verdict[x].tobytes()} for own, bucket, x in c.heavy]
        return pa.Table.from_pylist(out, arrow_schema(VERDICT_ROWS))

    return run


def settle(length: int):
    """Batch: verdicts meet the places of heavy windows; the spans of each document as maximal ones, in one row."""

    def run(table: pa.Table) -> pa.Table:
        blobs = {c: [x or b"" for x in table.column(c).to_pylist()] for c in ("spans", "times", "start", "doc", "docs")}
        spans = column(blobs["spans"], np.int64).reshape(-1, 4)
        verdicts = sorted((b, v) for b, v in zip(table.column("bucket").to_pylist(), table.column("verdict").to_pylist(), strict=True) if v)
        if verdicts:
            (row, doc_id), start = place_documents(blobs), column(blobs["start"], np.uint32).astype(np.int64)
            gone = np.repeat(column([v for _, v in verdicts], np.int64), column(blobs["times"], np.uint32)) < doc_id
            spans = np.concatenate([spans, np.stack([row, doc_id, start, start + length], 1)[gone]])
        if not len(spans):
            return arrow_schema(SPAN_ROWS).empty_table()
        docs, whose = np.unique(spans[:, :2], axis=0, return_inverse=True)
        base = whose.ravel() << 33  # documents follow one another at a distance that no span bridges
        start, end = merged_spans(base + spans[:, 2], base + spans[:, 3])
        offset, inside = np.searchsorted(start >> 33, np.arange(len(docs) + 1)), (1 << 33) - 1
        packed = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array((start & inside) << 32 | end & inside))
        return pa.table({"row": docs[:, 0], "doc_id": docs[:, 1], "spans": packed})

    return run


def settled(sent: DataFrame, judge: Callable, length: int, sizes: Sizes, buckets: int, name: str) -> DataFrame:
    """row, doc_id, spans (packed start and end) from contexts; stored."""
    verdicts = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judged(judge, sizes.batches, buckets), VERDICT_ROWS)
    return stored(verdicts.repartition(sizes.tasks, "batch").groupBy("batch").applyInArrow(settle(length), SPAN_ROWS), name)


def repeated_spans(docs: DataFrame, split: Callable, length: int, k: int, judge: Callable, name: str, sizes: Sizes) -> DataFrame:
    """row, doc_id, spans (packed start and end, maximal; stored) of a keyed table, by ``judge`` (see ``judged``).

    All exchanges are cut by the size of the text, not by the session's setting.
    """
    if not 0 < k <= length < 1 << 15:
        raise ValueError(f"length {length}, seed {k}: the seed is at most as long, the length under {1 << 15}")
    seeds = repeated_seeds(docs, lambda texts: split(texts)[:2], length, k, sizes)
    release(docs.sparkSession)  # the seeds' shuffle
    task, hashes = send_contexts(split, length, k, sizes.buckets), sizes.hashes
    empty = arrow_schema(CONTEXT_ROWS).empty_table()

    def send(own: pa.Table, found: pa.Table) -> pa.Table:
        return task(own, found, hashes) if own.num_rows and found.num_rows else empty

    texts = batched(docs, sizes).repartition(sizes.tasks, "batch")
    sent = texts.groupBy("batch").cogroup(seeds.repartition(sizes.tasks, "batch").groupBy("batch")).applyInArrow(send, CONTEXT_ROWS)
    found = settled(sent, judge, length, sizes, sizes.buckets, name)
    del texts, sent
    release(docs.sparkSession)  # the texts' and the contexts' shuffles
    return found


def with_spans(docs: DataFrame, row: str, doc_id: str, spans: DataFrame, name: str, sizes: Sizes) -> DataFrame:
    """The table with a column of packed spans, null where there are none.

    Both sides are cut by the size of the text, so that what a task hashes, the
    spans of ``TASK_BYTES`` of text, does not grow with the table.
    """
    a, b = unused(docs, "_span_row"), unused(docs, "_span_doc")
    found = spans.select(F.col("row").alias(a), F.col("doc_id").alias(b), F.col("spans").alias(name)).repartition(sizes.tasks, a, b)
    same = (F.col(row) == F.col(a)) & (F.col(doc_id) == F.col(b))
    return docs.repartition(sizes.tasks, row, doc_id).join(found.hint("shuffle_hash"), same, "left").drop(a, b)


class Repeated:
    """A batch's repeated seed hashes."""

    def __init__(self, found: pa.Table, buckets: int):
        self.buckets = buckets
        raw = found.column("key").to_pylist()
        bucket = np.repeat(found.column("bucket").to_numpy().astype(np.uint64), [len(x) // 4 for x in raw])
        both = (bucket << np.uint64(32)) | column(raw, np.uint32).astype(np.uint64)
        order = np.argsort(both)
        self.known, self.heavy = both[order], column(found.column("heavy").to_pylist(), np.bool_)[order]

    def marks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which seeds occur elsewhere, and which are heavy."""
        both = (bucket_of(key, self.buckets).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        at = np.searchsorted(self.known, both)
        at[at == len(self.known)] = 0
        hot = self.known[at] == both
        return hot, hot & self.heavy[at]


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal ones, in order; touching spans join."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    turn = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else np.zeros(0, np.int64)
    return start[turn], end[np.r_[turn[1:] - 1, len(start) - 1]] if len(start) else end
