"""A passage at very many places meets as a row for each batch, not with its places."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from quire.llm import seeds, substring_dedup, suffix_dedup


def _own(rows, batch):
    return pa.table({"doc_id": [i for i, _ in rows], "row": [i + 1000 for i, _ in rows], "batch": [batch] * len(rows), "text": [t for _, t in rows]})


def _found(split, rows, length, k, heavy):
    key = np.unique(seeds.winnow(*split([t.encode() for _, t in rows])[:2], length, k).key)
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({"bucket": pa.array([0] * len(low), pa.int32()), "key": pa.array([x.tobytes() for x in low], pa.binary()), "heavy": pa.array([bytes([heavy])] * len(low), pa.binary())})


def _settled(judge, split, length, k, dealt, heavy, batches):
    """Spans by document, through the functions that Spark maps over groups; and the rows that buckets receive."""
    sent = [seeds.send_contexts(split, length, k, 3)(_own(rows, b), _found(split, rows, length, k, heavy), 1) for b, rows in enumerate(dealt)]
    table = pa.concat_tables(sent)
    by = lambda t, c, x: t.filter(pa.compute.equal(t.column(c), x))
    verdicts = pa.concat_tables([seeds.judged(judge, batches, 3)(by(table, "bucket", b)) for b in set(table.column("bucket").to_pylist())])
    spans = pa.concat_tables([seeds.settle(length)(by(verdicts, "batch", b)) for b in set(verdicts.column("batch").to_pylist())])
    return {r["doc_id"]: [(x >> 32, x & 0xFFFFFFFF) for x in r["spans"]] for r in spans.to_pylist()}, table


@pytest.mark.parametrize("judge, split, length, k", [(suffix_dedup.scan_contexts(50, 20), seeds.split_bytes, 50, 20), (substring_dedup.extend_contexts(35, 8), seeds.split_words, 35, 8)])
def test_heavy_windows_give_the_same_spans_without_place_lists(judge, split, length, k):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(i % 7)] + shared[i % 3 :] + [word() for _ in range(9)])) for i in range(240)]
    dealt = [[r for r in rows if (r[0] + 1000) % 4 == b] for b in range(4)]
    light, _ = _settled(judge, split, length, k, dealt, 0, 4)
    heavy, sent = _settled(judge, split, length, k, dealt, 1, 4)
    assert heavy == light and len(light) >= 230
    for r in sent.to_pylist():
        if r["bucket"] < 3:
            assert r["start"] is None and r["docs"] is None  # a window's places do not travel
            assert len(r["first"]) == len(r["key"])
        else:
            assert r["key"] is None and r["bucket"] == 3 + r["batch"]


@pytest.mark.parametrize("most", [seeds.HEAVY, 1])
def test_hot_passage_over_many_batches(spark, monkeypatch, most):
    monkeypatch.setattr(seeds, "HEAVY", most)
    monkeypatch.setattr(seeds, "BATCH_BYTES", 2000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(50))
    rows = [(i, " ".join([*(word() for _ in range(4)), *([passage] if i % 3 == 0 else []), *(word() for _ in range(4))])) for i in range(90)]
    rows += [(None, passage), (None, None), (90, passage + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).filter("doc_id IS NOT NULL").collect()}
    fixed = [(i, t.encode()) for i, t in rows if i is not None]
    first: dict[bytes, int] = {}
    for i, t in fixed:
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    gone = {i: set().union(*(range(j, j + 50) for j in range(len(t) - 49) if first[t[j : j + 50]] < i)) for i, t in fixed}
    assert got == {i: len(x) for i, x in gone.items()}
    words = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).filter("doc_id IS NOT NULL").collect()}
    assert words == {i: 0 if i % 3 else 50 if i < 90 else 100 for i in range(91)}
    last = suffix_dedup.suffix_dedup(docs).filter("doc_id IS NULL AND n_bytes > 0").first()
    assert last.n_removed == last.n_bytes == len(passage)


def test_table_of_short_texts_has_no_seeds(spark):
    docs = spark.createDataFrame([(i, "few words") for i in range(5)], "doc_id long, text string")
    assert {(r.doc_id, bytes(r.kept), r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()} == {(i, b"few words", 0) for i in range(5)}
    assert {(r.doc_id, r.kept, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()} == {(i, "few words", 0) for i in range(5)}
