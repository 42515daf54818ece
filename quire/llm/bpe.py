"""Byte-pair encoding and decoding with batched numpy merge rounds.

The vocabulary file is a tokenizer JSON (byte-level BPE); its path is a
parameter. A text is cut at every change from non-blank to blank, which is
always a piece boundary of the byte-level pattern, so that most chunks are one
word with its leading space. Chunks that a task has not met yet are split by
the pattern, and the pieces of a whole batch are merged at once: the symbols of
all pieces lie in one flat array, the rank of each adjacent pair is found by
binary search over the sorted pair keys, and each round merges, in every piece,
all occurrences of the piece's lowest-ranked pair. Results are kept per chunk in
a table of at most ``CACHE_CHUNKS`` entries, so memory is bounded; a worker
process keeps it from task to task.

Defined cases: a null text is encoded as an empty one; special tokens that
occur in a text become their ids, as the tokenizers library does. Rows are
independent, hence repeated rows, ties and empty tables need no rule. Columns
of the input other than id and text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks kept by a worker; about 200 bytes each.
CACHE_CHUNKS = 1_000_000
#: Chunks longer than this are not kept.
CACHE_CHARS = 64
#: Text bytes that a task holds at once.
BATCH_BYTES = 4_000_000
#: The same where the ids themselves go back, which take about as much again.
IDS_BATCH_BYTES = 1_000_000
#: Pieces of more bytes are merged apart.
LONG_PIECE = 2048
#: The byte-level split pattern (fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Merge table and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._refuse_others(spec)
        ids: dict[str, int] = spec["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(of_char[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.array([ids[c] for c in byte_chars()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    @staticmethod
    def _refuse_others(spec: dict) -> None:
        """Only plain byte-level BPE is read: settings that would change pieces or merges are errors."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        bad = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        bad += ["model"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
        bad += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True))
        bad += ["added_tokens"] * any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if bad:
            raise ValueError(f"not plain byte-level BPE: {', '.join(bad)}")

    def _ranks(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each given position, ``len(made)`` where there is none."""
        none = len(self.made)
        last = len(sym) - 1
        nxt = np.minimum(at + 1, last)
        keys = (sym[at] << 32) | sym[nxt]
        place = np.searchsorted(self.pair_keys, keys)
        place[place == len(self.pair_keys)] = 0
        known = (self.pair_keys[place] == keys) & (owner[at] == owner[nxt]) & (at < last)
        return np.where(known, self.pair_ranks[place], none)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each has.

        All pieces are merged together, a round at a time; after a round only
        the pairs beside a merged symbol are looked up again. A piece of over
        ``LONG_PIECE`` bytes has rounds of its own.
        """
        n, none = len(pieces), len(self.made)
        long = [i for i, p in enumerate(pieces) if len(p) > LONG_PIECE]
        if long:
            rest = dict(zip(long, (self.merge_long(pieces[i]) for i in long), strict=True))
            flat, counts = self.merge([b"" if i in rest else p for i, p in enumerate(pieces)])
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in rest.items():
                parts[i], counts[i] = ids, len(ids)
            return np.concatenate(parts), counts
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(n, dtype=np.int32), np.fromiter(map(len, pieces), np.int64, n))
        rank = self._ranks(sym, owner, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            finished = lowest == none
            if finished.any():
                done.append((sym[finished], owner[finished]))
                live = ~finished
                sym, owner, rank, lowest = sym[live], owner[live], rank[live], lowest[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == lowest)
            # overlapping hits ("aaa"): of a run of adjacent ones, every other, from the left
            fresh = np.r_[True, np.diff(at) > 1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged symbols are now
            beside = np.zeros(len(sym), bool)
            beside[at] = True
            beside[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(beside)
            rank[changed] = self._ranks(sym, owner, changed)
        if not done:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        sym, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: rounds in rank order that touch only the places of their rank.

        Symbols are linked both ways. Places wait under the rank of their pair;
        a round takes the lowest rank, drops places whose pair has changed since
        and merges the others at once, so the work grows with the merges and
        not with rounds times length.
        """
        n, none = len(piece), len(self.made)
        sym = self.of_byte[np.frombuffer(piece, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        live, rank = np.ones(n, bool), np.full(n, none, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(at: np.ndarray) -> None:
            inside = after[at] < n
            rank[at] = none
            at = at[inside]
            keys = (sym[at] << 32) | sym[after[at]]
            place = np.searchsorted(self.pair_keys, keys)
            place[place == len(self.pair_keys)] = 0
            known = self.pair_keys[place] == keys
            at, own = at[known], self.pair_ranks[place[known]]
            rank[at] = own
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            turn = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            for i, j in zip(turn.tolist(), [*turn[1:].tolist(), len(own)], strict=False):
                r = int(own[i])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(at[i:j])

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if not len(at):
                continue
            # overlapping hits: of a run of linked ones, every other, from the left
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            sym[at] = self.made[r]
            live[gone] = False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            left = before[at]
            look_up(np.unique(np.r_[at, left[left >= 0]]))
        return sym[live]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def merge_pieces(vocabulary: Vocabulary):
    """Piece encoder by the merge rounds above."""

    def encode(pieces: list[str]) -> list[bytes]:
        flat, counts = vocabulary.merge([p.encode() for p in pieces])
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905

    return encode


class ChunkEncoder:
    """Texts to little-endian 32-bit ids, with a bounded table of known chunks.

    ``encode_pieces`` maps pieces (matches of the split pattern) to their ids.
    """

    def __init__(self, vocabulary: Vocabulary, encode_pieces):
        self.vocabulary, self.encode_pieces = vocabulary, encode_pieces
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the half before; what is met again moves on
        self.bare: dict[str, bytes] = {}  # pieces without a leading space
        self.careful = regex.compile(r"\s*\S+|\s+")

    def _pieces(self, chunk: str) -> list[str]:
        """The pattern's matches; plain words, also with a stop, need no regex."""
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        if chunk[-1:] in ".," and chunk[1:-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk[:-1], chunk[-1]]
        return self.vocabulary.pattern.findall(chunk)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks (with their leading blanks)."""
        cut = list(map(self._pieces, chunks))
        of: dict[str, bytes] = {}
        pieces = [ps[0] for ps in cut if len(ps) == 1]
        for p in set().union(*[ps for ps in cut if len(ps) > 1]).difference(pieces):  # a piece may be known as a chunk of its own
            found = self.known.get(p[1:]) if p[0] == " " else self.bare.get(p)
            if found is not None:
                of[p] = found
            else:
                pieces.append(p)
        new = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        of |= new
        if len(self.bare) < CACHE_CHUNKS // 10:
            self.bare.update((p, x) for p, x in new.items() if p[0] != " " and len(p) <= CACHE_CHARS)
        return [of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps]) for ps in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens.

        A space that follows a non-blank is a piece boundary, and so is a line
        feed. If no part between them is empty or has a blank at an end, the feed
        before a part aside, all the cuts are such; the first part may be empty.
        Arrow cuts and counts off the distinct parts and puts their ids together;
        only they are looked up.
        """
        if not texts:
            return []
        parts = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        offsets, values = parts.offsets.to_numpy(), parts.values
        inner = np.ones(len(values), bool)
        inner[offsets[:-1]] = False
        coded = values.filter(pa.array(inner)).dictionary_encode()
        heads, names = values.take(pa.array(offsets[:-1])).to_pylist(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.empty(len(values), np.int64)
        at[inner] = coded.indices.to_numpy()
        at[~inner] = np.arange(len(names), len(names) + len(heads))
        ids = pa.array(self._looked_up(names) + self._heads(heads), pa.large_binary()).take(pa.array(at))
        out: list[bytes | None] = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()
        left = [i for i, x in enumerate(out) if x is None]  # texts with a part that is not safe
        cut = [self.careful.findall(texts[i]) for i in left]
        chunks = list(set().union(*cut))
        learnt = dict(zip(chunks, self._learn(chunks), strict=True))
        for i, cs in zip(left, cut, strict=True):
            out[i] = b"".join([learnt[c] for c in cs])
        return out

    def _looked_up(self, names: list[str]) -> list[bytes | None]:
        """Ids of distinct parts that follow a space or begin with a line feed; null if a cut beside one is not safe."""
        if len(self.known) > CACHE_CHUNKS // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        ids = list(map(known.get, names))
        missed = [i for i, x in enumerate(ids) if x is None]
        fresh = []
        for i in missed:
            p = names[i]
            found = old.get(p)
            if found is not None:
                ids[i] = known[p] = found
            elif p and not p[-1].isspace() and (not p[0].isspace() or p[0] == "\n" and not p[1].isspace()):
                fresh.append(i)
        for i, x in zip(fresh, self._learn([p if p[0] == "\n" else " " + p for p in map(names.__getitem__, fresh)]), strict=True):
            ids[i] = x
            if len(names[i]) <= CACHE_CHARS:
                known[names[i]] = x
        return ids

    def _heads(self, heads: list[str]) -> list[bytes | None]:
        """Ids of the first parts of texts, which have nothing before them; null if the cut after one is not safe."""
        chunks = list({p for p in heads if p and not p[0].isspace() and not p[-1].isspace()})
        learnt = dict(zip(chunks, self._learn(chunks), strict=True))
        learnt[""] = b""
        return list(map(learnt.get, heads))

    def encode(self, texts: list[str]) -> list[bytes]:
        # nothing here makes cycles, and the collector would walk through millions of short lists
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        marks = self.vocabulary.special_pattern
        if not marks or not any(marks.search(t) for t in texts):
            return self._plain(texts)
        split = [(marks.split(t), marks.findall(t)) for t in texts]
        flat = iter(self._plain([p for ps, _ in split for p in ps]))
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.vocabulary.special.items()}
        return [b"".join(x for k in range(len(ps)) for x in (next(flat), special[ms[k]] if k < len(ms) else b"")) for ps, ms in split]


@lru_cache(maxsize=2)
def encoder_for(path: str) -> ChunkEncoder:
    """The worker process's encoder of a vocabulary; later tasks find its table filled."""
    table = Vocabulary(path)
    return ChunkEncoder(table, merge_pieces(table))


def text_batches(batches: Iterator[pa.RecordBatch], n_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about so many text bytes (at least a row)."""
    for batch in batches:
        at = 0
        sizes = np.array(pc.binary_length(batch.column("text")).fill_null(0), np.int64) if batch.num_rows else np.zeros(0)
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + n_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array of int), round_trip (decoding gives the text): every whole text."""
    path = vocabulary or default_vocabulary()

    def encode(batches):
        encoder = encoder_for(path)
        table = encoder.vocabulary
        for b in text_batches(batches, IDS_BATCH_BYTES):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = encoder.encode(texts)
            flat = np.frombuffer(b"".join(found), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            same = [table.decode(np.frombuffer(x, "<u4").tolist()) == t for x, t in zip(found, texts, strict=True)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": b.column("text"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), "round_trip": pa.array(same, pa.bool_())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, text string, ids array<int>, round_trip boolean")


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, text: texts from their ids; special tokens stay as written."""
    path = vocabulary or default_vocabulary()

    def decode(batches):
        table = encoder_for(path).vocabulary
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.flatten().to_pylist(), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
            texts = [table.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": ids, "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, text string")


def bpe_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, in one pass over the texts."""
    path = vocabulary or default_vocabulary()

    def digest(batches):
        encoder = encoder_for(path)
        table = encoder.vocabulary
        decimal = [str(i) for i in range(len(table.token_bytes))]
        for b in text_batches(batches):
            found = encoder.encode([t or "" for t in b.column("text").to_pylist()])
            n, ids_sha, text_sha = [], [], []
            for raw in found:
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
