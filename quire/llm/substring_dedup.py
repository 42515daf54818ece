"""Removal of word passages that occur more than once, by seed and extend.

A word goes if a window of ``length`` words that covers it also starts anywhere
else, in the same document or another; windows are judged on the input, and
every occurrence goes.

Seeds (see ``seeds``) are winnowed ``k``-word anchors. Documents meet on the
hash of an anchor, each with the words of the windows that own the anchor. There
all members of the anchor are extended at once, word by word to the right and to
the left: members stay in one class as long as their words agree, byte for byte
(hashes only bring them together). A window with
``o`` words to the left of its anchor is a repeat if its left class at ``o`` and
its right class at the rest have another member, or one that occurs twice.
Adjacent windows make maximal repeats, which join across anchors in a document.
No pairs of members are made, so a group of n copies costs n.

Equal members are sent once with the list of their places; an anchor that
occurs at over ``HEAVY`` places is dealt out window by window, each with its
count in a batch of documents; whether it is a repeat comes back to the batch.

Defined cases: null and empty texts have no words; texts under ``length`` words
stay whole; repeated rows are two occurrences, so all their windows go; an
empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID
from .seeds import BEFORE, NEVER, Contexts, Sizes, keyed, merged_spans, raw_texts, repeated_spans, sizes_for, split_words, with_spans

LENGTH = 35
SEED = 8


def _refined(classes: np.ndarray, words: np.ndarray, n_words: int) -> np.ndarray:
    """Classes cut by the next word of each member."""
    return np.unique(classes * n_words + words, return_inverse=True)[1]


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of all texts as numbers, equal for equal bytes; how many each text has; how many numbers there are."""
    number = defaultdict(count().__next__)
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((number[w] for own in words for w in own), np.int64, int(counts.sum())), counts, max(1, len(number))


def repeated_windows(c: Contexts, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context's windows whether they are repeats, in one array, and how many windows each has."""
    word, counts, n_words = numbered_words(c.texts)
    begin = np.cumsum(counts) - counts
    anchor, n = begin + c.at, counts - length + 1
    out, offset = np.zeros(int(n.sum()), bool), np.cumsum(n) - n

    together = np.unique(c.key, return_inverse=True)[1]
    for j in range(k):
        together = _refined(together, word[anchor + j], n_words)
    alone = np.bincount(together, c.times)[together] < 2
    on = np.flatnonzero(~alone)  # members with company
    right, who = {0: together[on]}, {0: on}
    for j in range(1, length - k + 1):  # words after the anchor
        has = c.at[who[j - 1]] + k + j <= counts[who[j - 1]]
        who[j] = who[j - 1][has]
        right[j] = _refined(right[j - 1][has], word[anchor[who[j]] + k - 1 + j], n_words)
    left = together[on]
    for o in range(length - k + 1):  # words before it
        if o:
            has = c.at[on] >= o
            on, left = on[has], left[has]
            left = _refined(left, word[anchor[on] - o], n_words)
        rest = length - k - o
        first = c.at[on] - o
        own = np.flatnonzero(np.isin(on, who[rest], assume_unique=True) & (first < n[on]))
        member = on[own]
        place = np.searchsorted(who[rest], member)
        both = left[own] * (len(c.times) + 1) + right[rest][place]
        _, group = np.unique(both, return_inverse=True)
        twin = np.bincount(group, c.times[member])[group] > 1 if len(member) else np.zeros(0, bool)
        out[(offset[member] + first[own])[twin]] = True
    return out, n


def extend_contexts(length: int, k: int):
    """Contexts: maximal runs of repeated windows of every place; of each context whether its first window goes."""

    def extend(c: Contexts) -> tuple[np.ndarray, np.ndarray]:
        verdict, n = repeated_windows(c, length, k)
        owner, start, end = c.runs(verdict, n, length, np.arange(len(n)))
        # every place of a context has its runs
        runs = np.bincount(owner, minlength=len(n))
        times = runs[c.owner]
        place = np.repeat(np.arange(len(c.owner)), times)
        run = np.repeat((np.cumsum(runs) - runs)[c.owner], times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        return c.spans(place, start[run], end[run]), np.where(verdict[np.cumsum(n) - n], BEFORE, NEVER)

    return extend


def repeated_passages(docs: DataFrame, length: int = LENGTH, k: int = SEED, sizes: Sizes | None = None) -> DataFrame:
    """row, doc_id, spans (start and end in words, maximal, packed) of a keyed table (see ``seeds.keyed``)."""
    return repeated_spans(docs, split_words, length, k, extend_contexts(length, k), "passages", sizes or sizes_for(docs))


def substring_dedup(docs: DataFrame, length: int = LENGTH, k: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (words left, joined by spaces), n_words, n_removed, passages (maximal, as word spans) for every row."""
    own = keyed(docs, id_col, text_col)
    sizes = sizes_for(own)
    joined = with_spans(own, "row", "doc_id", repeated_passages(own, length, k, sizes), "spans", sizes)

    def cut(batches):
        for b in batches:
            kept, n_words, n_removed, passages = [], [], [], []
            for raw, packed in zip(raw_texts(b), b.column("spans"), strict=True):
                words = raw.split()
                found: list[list[int]] = []
                left = words
                if packed.is_valid:
                    values = packed.values.to_numpy()
                    start, end = merged_spans(values >> 32, values & 0xFFFFFFFF)
                    found = np.stack([start, end], 1).tolist()
                    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(words)]
                    left = [w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]
                kept.append(b" ".join(left))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                passages.append(found)
            ids = [None if x == NULL_ID else x for x in b.column("doc_id").to_pylist()]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "passages": pa.array(passages, pa.list_(pa.list_(pa.int32())))})

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long, passages array<array<int>>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without its repeated passages: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = substring_dedup(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
