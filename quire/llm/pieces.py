"""SentencePiece encoding and decoding by a table of distinct marked words.

The model file (BPE with byte fallback) is a parameter and is read here. Blanks
become markers, and where no piece holds a marker behind another character, no
merge can cross the beginning of a run of markers: a text is a row of marked
words, each of which has its ids whatever stands around it. The same holds for a
line break if no longer piece has one. So a batch of texts is cut into marked
words, each distinct one that the worker has not met is segmented once, and ids
are joined back in the order of the words. The table holds at most ``CACHE_WORDS``
words, in two generations, so memory is bounded; a worker keeps it from task to
task. Models for which the cuts are not safe, or that normalise texts, are refused.

Defined cases: a null text is an empty one, which has the end id only; a marker
written in a text is a blank, as in the library; rows are independent, hence
repeated rows, ties and empty tables need no rule; columns other than id and text
are ignored. Long words are merged by a heap, in the order of the library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches

#: The library's sign for a blank (fixed value of the format).
MARK = "▁"
#: Stands before what follows a line break; no Arrow string holds it.
BREAK = "\ud801"
#: Words kept by a worker, some 200 bytes each, and the longest that is kept.
CACHE_WORDS = 1_000_000
CACHE_CHARS = 64
#: Longer words are merged by a heap.
LONG_WORD = 100
#: Fixed values of the model format: kinds of pieces, and the kind of model that merges pairs.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("quire.one_each", _one_each)


class PieceModel:
    """Pieces, their ranks and ids of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = list(_fields(f.read()))
        trainer = dict(x for n, v in spec if n == 2 for x in _fields(v))
        normalizer = dict(x for n, v in spec if n == 3 for x in _fields(v))
        pieces, scores, kinds = [], [], []
        for own in (dict(_fields(v)) for n, v in spec if n == 1):
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        bad = ["kind of model"] * (trainer.get(3, 1) != BPE) + ["no byte fallback"] * (not trainer.get(35)) + ["suffix markers"] * bool(trainer.get(24))
        bad += ["normalizer"] * bool(normalizer.get(2)) + ["blanks removed"] * bool(normalizer.get(4, 1)) + ["no markers"] * (not normalizer.get(5, 1)) + ["no first marker"] * (not normalizer.get(3, 1))
        bad += ["kinds of pieces"] * bool(set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE})
        bad += ["pieces across words"] * any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p, k in zip(pieces, kinds, strict=True) if k == NORMAL)
        if bad:
            raise ValueError(f"words of this model cannot be told apart: {', '.join(bad)}")
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.ids = {pieces[i]: i for i in normal}
        self.rank = {pieces[i]: order[scores[i]] for i in normal}
        self.none = len(order)
        self.of_byte = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.end_id = int(trainer.get(42, 2))
        self.shown = [p.replace(MARK, " ").encode() for p in pieces]
        unknown = trainer.get(44, " ⁇ ".encode())
        for i, k in enumerate(kinds):
            if k != NORMAL:
                self.shown[i] = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: unknown}[k](pieces[i])
        #: adjacent characters of a piece: other neighbours never merge
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(pieces, kinds, strict=True)])

    def segment(self, word: str) -> list[int]:
        """Ids of a word: the adjacent pair of the best piece, the leftmost of ties, is merged until none is left."""
        symbols = self._by_heap(word) if len(word) > LONG_WORD else self._by_scan(word)
        ids: list[int] = []
        for s in symbols:
            own = self.ids.get(s)
            if own is None:
                ids.extend(self.of_byte[b] for b in s.encode())
            else:
                ids.append(own)
        return ids

    def _by_scan(self, word: str) -> list[str]:
        rank, none, symbols = self.rank, self.none, list(word)
        ranks = [rank.get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(symbols[i] + symbols[i + 1], none)
        return symbols

    def _by_heap(self, word: str) -> list[str]:
        rank, none, n = self.rank, self.none, len(word)
        symbols: list[str] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2], none)) != none]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get(symbols[a] + symbols[b], none)) != none:
                    heapq.heappush(heap, (r, a, len(symbols[a]) + len(symbols[b])))
        return [s for s in symbols if s]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: without the marker of its first piece; bytes that are no UTF-8 are shown one by one."""
        raw = b"".join(map(self.shown.__getitem__, ids))
        first = next((i for i in ids if self.shown[i]), None)
        if first is not None and self.marked[first]:
            raw = raw[1:]
        return raw.decode("utf-8", "quire.one_each")


class WordTable:
    """Texts to little-endian 32-bit ids by the table of distinct marked words.

    A key is a word without its one marker, a word with its several markers, or
    ``BREAK`` and what follows a line break.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before; what is met again moves on
        self.careful = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")

    def _keys(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.replace("\n", " " + BREAK).split(" ")
        marked = self.careful.findall(MARK + text.replace(" ", MARK))
        return [BREAK + w[1:] if w[0] == "\n" else w if w[1:2] == MARK else w[1:] for w in marked]

    def _segment(self, key: str) -> bytes:
        """Ids of a key; a last character that no piece joins to the one before it stands apart."""
        if len(key) > 2 and key[-2:] not in self.model.pairs and key[-2] not in (MARK, BREAK):
            start = self.known.get(key[:-1])
            return (self._whole(key[:-1]) if start is None else start) + self._ids(key[-1])
        return self._whole(key)

    def _whole(self, key: str) -> bytes:
        if key[:1] == BREAK:
            return self._ids("\n") + self._ids(key[1:])
        return self._ids(key if key[:1] == MARK else MARK + key)

    def _ids(self, word: str) -> bytes:
        return np.array(self.model.segment(word), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = list(map(self._keys, texts))
        if len(self.known) > CACHE_WORDS // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = set().union(*keys).difference(known)
        for k in new:
            found = old.get(k)
            known[k] = self._segment(k) if found is None else found
        out = [b"".join(map(known.__getitem__, ks)) for ks in keys]
        for k in new:
            if len(k) > CACHE_CHARS:
                del known[k]
        return out


@lru_cache(maxsize=2)
def table_for(path: str) -> WordTable:
    """The worker process's table of a model; later tasks find it filled."""
    return WordTable(PieceModel(path))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def piece_encode(docs: DataFrame, model: str | None = None, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array of int) of every whole text, with the end id if ``end``."""
    path = model or default_model()

    def encode(batches):
        table = table_for(path)
        last = np.array([table.model.end_id] if end else [], "<u4").tobytes()
        for b in text_batches(batches):
            found = [x + last for x in table.encode([t or "" for t in b.column("text").to_pylist()])]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": b.column("text"), "ids": ids})

    return _texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, text string, ids array<int>")


def piece_decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, text: texts from their ids."""
    path = model or default_model()

    def decode(batches):
        own = table_for(path).model
        for b in batches:
            texts = [own.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": b.column("ids"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, ids array<int>, text string")


def piece_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, in one pass over the texts."""
    path = model or default_model()

    def digest(batches):
        table = table_for(path)
        own, end = table.model, table.model.end_id
        decimal = [str(i) for i in range(len(own.shown))]
        for b in text_batches(batches):
            n, ids_sha, text_sha = [], [], []
            for raw in table.encode([t or "" for t in b.column("text").to_pylist()]):
                ids = [*np.frombuffer(raw, "<u4").tolist(), end]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return _texts(docs, id_col, text_col).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_pieces(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded with an end id and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
