"""Token ids in Arrow stream-file format with fixed-size-list batches.

Documents are range-partitioned by id and sorted; each partition packs its ids,
an end id after each document, into sequences of ``seq_len`` and writes one
file whose record batches hold ``ids`` (fixed-size list of 16- or 32-bit ids,
by vocabulary size) and ``mask`` (fixed-size list of bytes of 8 bits, lowest first:
0 on the padding of a file's last sequence and 1 elsewhere). All sequences are
equally long, so the n-th one of a file is at a known batch and row and, in a
memory-mapped file, its ids and the bytes of its mask are read without a copy. An index table (document, part, file,
offset, tokens) is kept beside the files.

Files go to the shared folder. Each attempt of a task writes under a name of its
own and moves the finished file to another; the index names the files of the
attempts that succeeded, so what a lost executor leaves is never read.

The library's model is called on pieces cut by this package; a vocabulary file
whose normalizer or pre-tokenizer is another one is refused (``bpe.Vocabulary``).

Defined cases: null and empty texts give the end id alone; null ids come last;
rows with equal ids are ordered by a hash of the text, equal rows follow each
other; an empty table gives no documents. Columns of the input other than id and
text are ignored.
"""

from __future__ import annotations

import codecs
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import ChunkEncoder, Vocabulary, byte_chars, default_vocabulary, text_batches
from .common import new_path, parts_for, row_id, stored, text_bytes

SEQ_LEN = 2048
END_ID = 0
#: Sequences in a record batch.
BATCH_SEQS = 256
#: Text bytes for a file.
FILE_BYTES = 64_000_000
#: Pieces that a call of the library's model takes.
PIECES_AT_ONCE = 32


def library_pieces(path: str):
    """Piece encoder by the tokenizers library: its model on the byte characters of pieces.

    The library's pre-tokenizer would cut a piece no further, so its model is
    called on pieces directly, on several at once: the byte 255, which no text in
    UTF-8 holds, stands between them, and no token but its own holds it, so that no merge
    crosses it. Where a vocabulary has another such token, a call takes one piece.
    """
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    model, chars = found.model, "".join(byte_chars())
    gap = chars[255]
    gap_id = found.token_to_id(gap)
    at_once = 1 if any(gap in t for t in found.get_vocab() if t != gap) else PIECES_AT_ONCE

    def encode(pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        shown = codecs.charmap_decode(b"\xff".join(map(str.encode, pieces)), "strict", chars)[0].split(gap)
        ids: list[int] = []
        for i in range(0, len(shown), at_once):
            ids += [t.id for t in model.tokenize(gap.join(shown[i : i + at_once]))]
            ids.append(gap_id)
        flat = np.array(ids, "<u4")
        raw, ends = flat.tobytes(), (4 * np.flatnonzero(flat == gap_id)).tolist()
        return [raw[i:j] for i, j in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    return encode


@lru_cache(maxsize=2)
def library_encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder, by the tokenizers library."""
    return ChunkEncoder(Vocabulary(path), library_pieces(path))


class SequenceWriter:
    """Packs ids into equal sequences and writes full record batches."""

    def __init__(self, sink, seq_len: int, dtype):
        self.seq_len, self.dtype = seq_len, np.dtype(dtype)
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(self.dtype), seq_len), "mask": pa.list_(pa.uint8(), -(-seq_len // 8))})
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.room = BATCH_SEQS * seq_len
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(flat[at : at + self.room], self.room)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = np.packbits((np.arange(len(ids)) < n).reshape(-1, self.seq_len), axis=1, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), size) for x, size in ((ids, self.seq_len), (mask.ravel(), mask.shape[1]))]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to a file of equal sequences; no copy if it is memory-mapped."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.at != k:
            self.at, self.batch = k, self.reader.get_batch(k)
        return self.batch

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (packed, see ``unpacked``) of the n-th sequence: views of the file."""
        batch, row = self._batch(n // BATCH_SEQS), n % BATCH_SEQS
        return tuple(x.values.to_numpy()[row * x.type.list_size : (row + 1) * x.type.list_size] for x in (batch.column("ids"), batch.column("mask")))

    def unpacked(self, mask: np.ndarray) -> np.ndarray:
        """A boolean for each id of a sequence."""
        return np.unpackbits(mask, count=self.seq_len, bitorder="little").view(bool)

    def span(self, start: int, n: int):
        """Parts of the ids from start to start + n, batch by batch."""
        room = BATCH_SEQS * self.seq_len
        while n > 0:
            ids = self._batch(start // room).column("ids").values.to_numpy()
            part = ids[start % room : start % room + n]
            yield part
            start, n = start + len(part), n - len(part)

    def close(self) -> None:
        self.source.close()


def write_token_files(docs: DataFrame, out_dir: str, vocabulary: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files and return their stored index: doc_id, part (orders the files), file, offset, n_tokens."""
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_id(id_col).alias("order_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("draw", F.xxhash64("text"))
    parts = parts_for(spark, text_bytes(rows), file_bytes)
    rows = rows.repartitionByRange(parts, "order_id", "draw").sortWithinPartitions("order_id", "draw")

    def write(batches):
        encoder = library_encoder(path)
        dtype = np.uint16 if len(encoder.vocabulary.token_bytes) <= 1 << 16 else np.uint32
        store, folder = fs.FileSystem.from_uri(out_dir)
        part = TaskContext.get().partitionId()
        store.create_dir(folder, recursive=True)
        attempt = uuid.uuid4().hex
        name, draft = f"part-{part:06d}-{attempt}.arrow", f"{folder}/.draft-{attempt}"
        end, offset = np.array([end_id], "<u4").tobytes(), 0
        with store.open_output_stream(draft) as sink:
            writer = SequenceWriter(sink, seq_len, dtype)
            for b in text_batches(batches):
                found = encoder.encode(b.column("text").to_pylist())
                writer.add(np.frombuffer(end.join([*found, b""]), "<u4"))
                counts = [len(raw) // 4 + 1 for raw in found]
                ends = offset + np.cumsum(counts)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "part": pa.array([part] * len(counts), pa.int64()), "file": pa.array([name] * len(counts), pa.string()), "offset": pa.array(ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
                offset = int(ends[-1])
            writer.close()
        store.move(draft, f"{folder}/{name}")

    return stored(rows.drop("order_id", "draw").mapInArrow(write, "doc_id long, part long, file string, offset long, n_tokens long"), "token-index")


def read_token_files(index: DataFrame, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: every document's ids, read from the files.

    ``start`` counts the ids of all documents before it: the files' totals are
    summed in the order of parts (one row per file), the offsets in a file are known.
    """
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    placed = index.join(bases, "part").repartition("part").sortWithinPartitions("part", "offset")

    def read(batches):
        open_file, uri = None, None
        for b in batches:
            sums = []
            for name, at, n in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if uri != name:
                    if open_file:
                        open_file.close()
                    open_file, uri = SequenceFile(f"{out_dir}/{name}"), name
                crc = 0
                for ids in open_file.span(at, n):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                sums.append(crc)
            start = pa.array(b.column("base").to_numpy() + b.column("offset").to_numpy(), pa.int64())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": start, "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())})
        if open_file:
            open_file.close()

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out_dir = new_path(spark, "tokens")
    return read_token_files(write_token_files(docs, out_dir), out_dir)
