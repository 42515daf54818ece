"""Page, image, scalar and stream operators: DuckDB's answers, properties and hand-made cases."""

import os
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import grid as G
from quire.operators import pages as P
from quire.plans import fixtures as X
from quire.plans import queries as Q
from quire.sources import files
from quire.streaming import events as E


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return c


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_is_duckdbs(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    want = duck.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _bag(df.columns, df.collect()) == _bag(columns, want.fetchall())


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


SIZES = [(0, "0 B"), (512, "512 B"), (1024, "1.0 KB"), (2048, "2.0 KB"), (1048576, "1.0 MB"), (5242880, "5.0 MB"), (None, "0 B"), (-1, "0 B"), (1280, "1.3 KB"), (1048575, "1024.0 KB"), (5497558138880, "5120.0 GB")]
TITLES = [("/path/to/Report.pdf", "Report.pdf"), ("C:\\docs\\My File.pdf", "My File.pdf"), ("/tmp/intent_1234567_resume.pdf", "resume.pdf"), ("/tmp/opened.pdf", "View PDF"), ("Untitled.pdf", "Untitled.pdf"), ("/a/", "View PDF"), ("intent_x.pdf", "View PDF"), ("intent_12_", "View PDF"), ("intent_1_intent_2_x.pdf", "intent_2_x.pdf")]


def test_sizes_and_titles(spark):
    got = spark.createDataFrame(SIZES, "n long, want string").select(S.format_file_size(F.col("n")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    sizes = spark.createDataFrame([(100.0, 2000.0), (595.4, 841.5)], "w double, h double").select(S.preview_size(F.col("w"), F.col("h")).alias("a"), S.preview_size(F.col("w"), F.col("h"), "list").alias("b")).collect()
    assert [(tuple(r.a), tuple(r.b)) for r in sizes] == [((350, 1700), (280, 1500)), ((595, 842), (595, 842))]
    got = spark.createDataFrame(TITLES, "p string, want string").select(S.display_title(F.col("p")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_split_then_merge_gives_the_original(spark, sf):
    pages = X.pages_conv(spark, sf)
    single = P.split_all(pages)
    manifest = single.select(F.col("doc_id").alias("batch_id"), F.col("page_no").alias("position"), F.col("out_id").alias("doc_id"))
    parts = single.select(F.col("out_id").alias("doc_id"), F.col("out_page_no").alias("page_no"), "content")
    merged = P.merge_documents(manifest, parts).select(F.col("batch_id").alias("doc_id"), F.col("out_page_no").alias("page_no"), "content")
    several = pages.join(P.mergeable_batches(manifest).select(F.col("batch_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, several.collect()))


def test_covering_ranges_and_select_all_are_identities(spark, sf):
    pages, counts = X.pages_conv(spark, sf), X.counts_conv(spark, sf)
    whole = counts.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("range_ord"), F.lit(1).alias("start"), F.lit(1).alias("end")), F.struct(F.lit(2).alias("range_ord"), F.lit(2).alias("start"), F.col("page_count").cast("int").alias("end")))).alias("r")).select("doc_id", "r.*")
    got = P.split_ranges(pages, whole, counts).select("doc_id", "page_no", "content")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, pages.collect()))
    every = P.extract_pages(pages, P.select_all(counts), counts)
    assert every.filter("page_no != out_page_no").count() == 0 and every.count() == pages.count()


def test_accepted_and_rejected_are_all(spark, sf):
    counts = X.counts_conv(spark, sf)
    ranges, manifest, selection = X.ranges(spark, sf), X.manifest(spark, sf), X.selection(spark, sf)
    report = P.reject_report(manifest, ranges, selection, counts)
    assert P.valid_ranges(ranges, counts).count() + report.filter("op = 'split_range'").count() == ranges.count()
    assert P.valid_selection(selection, counts).select("doc_id").distinct().count() + report.filter("op = 'extract'").count() == counts.count()
    none = spark.createDataFrame([(7, 1, 1, 1)], "doc_id long, range_ord int, start int, `end` int")
    empty = P.reject_report(manifest.limit(0), none, selection.limit(0), spark.createDataFrame([(7, 0)], "doc_id long, page_count long"))
    assert [r.reason for r in empty.collect()] == ["empty_document"]


def test_a_merge_succeeds_as_a_whole_or_not_at_all(spark):
    manifest = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 10), (2, 1, 99), (3, 0, 11), (4, 0, 10), (4, 1, 12)], "batch_id long, position int, doc_id long")
    pages = spark.createDataFrame([(10, 1, "a"), (10, 2, None), (11, 1, "b")], "doc_id long, page_no int, content string")
    merged = P.merge_documents(manifest, pages).collect()
    assert sorted((r.batch_id, r.out_page_no, r.content) for r in merged) == [(1, 1, "a"), (1, 2, None), (1, 3, "b")]
    assert {(r.batch_id, r.ordinal) for r in P.merge_batches(manifest, pages).collect()} == {(1, 1)}
    counts = spark.createDataFrame([(10, 2), (11, 1), (12, 0)], "doc_id long, page_count long")
    nothing = spark.createDataFrame([], "doc_id long, range_ord int, start int, `end` int"), spark.createDataFrame([], "doc_id long, sel_ord int, page_idx int")
    report = P.reject_report(manifest, *nothing, counts).collect()
    assert {(r.op, r.request, r.reason) for r in report} == {("merge", "2", "missing_doc"), ("merge", "3", "too_few_inputs"), ("merge", "4", "empty_document")}


def test_page_marks_are_taken_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a|b.c"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.page_no, r.content) for r in P.paginate(docs, mark="|").collect()) == [(1, 1, "a"), (1, 2, "b.c"), (3, 1, "")]


def test_images_that_cannot_be_decoded_keep_their_page(spark):
    manifest = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7)], "doc_id long, position int, image_id long")
    images = spark.createDataFrame([(5, True), (6, False)], "image_id long, decoded boolean")
    got = sorted((r.page_no, r.image_id, r.quality, r.decoded) for r in P.images_to_document(manifest, images, 70).collect())
    assert got == [(1, 5, 70, True), (2, 6, None, False), (3, 7, None, False)]


def test_tables_of_colours():
    """Entries computed by hand: ((v/255 - 0.5) * (level/100)^2 + 0.5) * 255, and 255 * min(1, v/255 * brightness)^gamma."""
    table = G.contrast_table(140)
    assert (table[0], table[63], table[127], table[128], table[192], table[255]) == (0, 1, 126, 128, 253, 255)
    bright = G.brightness_table(1.05)
    assert (bright[0], bright[100], bright[200], bright[243], bright[255]) == (0, 105, 210, 255, 255)
    assert (G.brightness_table(1.08, 0.9)[0], G.brightness_table(1.08, 0.9)[255]) == (0, 255)


def _grid(spark, rows):
    return spark.createDataFrame([(i, y, x, v, v, v) for i, g in enumerate(rows) for y, line in enumerate(g) for x, v in enumerate(line)], "image_id int, y int, x int, r int, g int, b int")


FLAT, LEVELS = [[77] * 3] * 3, [[40, 40, 200, 200]] * 4


def test_hand_made_grids(spark):
    grid = _grid(spark, [FLAT, LEVELS, [[5]], [[1, 90, 250]], [[1], [90], [250]]])
    at = {r.image_id: r.threshold for r in G.otsu_threshold(G.image_histogram(grid)).collect()}
    assert at[0] == 115 and at[1] == 36
    same = G.img_normalize(grid).filter("image_id = 0").select("r").distinct().collect()
    assert [r.r for r in same] == [77]
    bw = {(r.image_id, r.r) for r in G.img_black_white(grid).filter("image_id = 1").collect()}
    assert bw == {(1, 127), (1, 255)}
    size = Counter((r.image_id,) for r in grid.collect())
    for name, f in {**G.PIPELINES, "sharpen": lambda g: G.img_sharpen(g, 50, 10)}.items():
        got = f(grid)
        assert Counter((r.image_id,) for r in got.collect()) == size, name
        assert got.filter("least(r, g, b) < 0 OR greatest(r, g, b) > 255").count() == 0
    stats = G.local_stats(grid, 15, 3).filter("image_id = 2").first()
    assert (stats.total, stats.low, stats.high) == (121 * 5, 5, 5)


def _png(rows):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(v for p in line for v in p) for line in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_files_and_images(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    got = {r["name"]: r.file_size for r in files.catalog_scan(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.pdf": 5, "b.PDF": 5}
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "a.png").write_bytes(_png([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)]]))
    (folder / "junk.png").write_bytes(b"junk")
    images = files.image_scan(spark, f"file://{folder}")
    assert sorted(r.decoded for r in images.collect()) == [False, True]
    grid = files.image_grid(images).drop("image_id")
    assert {tuple(r) for r in grid.collect()} == {(0, 0, 1, 2, 3), (0, 1, 4, 5, 6), (1, 0, 7, 8, 9), (1, 1, 250, 251, 252)}


def test_partitioned_outputs(spark, sf, tmp_path):
    out = P.split_all(X.pages_conv(spark, sf)).withColumn("op", F.lit("split_all"))
    P.write_outputs(out, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").filter("op = 'split_all'").count() == out.count()


def _streamed(spark, frame, transform, folder, name):
    cuts = frame.select(F.expr("percentile(unix_micros(cast(ts AS timestamp)), array(0.33, 0.66))").alias("p")).first()["p"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for part in (at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1]):  # files in order of time
        frame.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}-state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    events = X.table(spark, sf, "events")
    requests = X.as_requests(events)
    got = _streamed(spark, requests, E.route_requests, f"file://{tmp_path}", "routed")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, E.route_requests(requests).collect()))
    gap = 6 * 3600
    got = _streamed(spark, events, lambda s: E.throttle_stream(s, gap_s=gap), f"file://{tmp_path}", "throttled")
    want = E.throttle_events(events, gap_s=gap)
    assert want.schema["ts"] == events.schema["ts"]
    assert {(r.user_id, r.event_id, r.n) for r in got.collect()} == {(r.user_id, r.event_id, r.n) for r in want.collect()}
    free = F.col("event_id") % 4 != 1
    got = _streamed(spark, events, lambda s: E.throttle_stream(s, gap_s=gap, available=free), f"file://{tmp_path}", "available")
    want = E.throttle_events(events, gap_s=gap, available=free)
    assert {(r.user_id, r.event_id, r.n) for r in got.collect()} == {(r.user_id, r.event_id, r.n) for r in want.collect()}


def test_throttle_counts_from_the_last_shown(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long").select("event_id", F.to_timestamp("t").alias("ts"), "user_id")
    assert [r.event_id for r in E.throttle_events(events, gap_s=240).orderBy("event_id").collect()] == [2, 8]
    assert [r.event_id for r in E.throttle_events(events, gap_s=0, available=F.col("event_id") != 5).orderBy("event_id").collect()] == [2, 8, 11]


def _noise(seed, shapes):
    import numpy as np

    rng = np.random.default_rng(seed)
    out = []
    for h, w in shapes:
        base = rng.integers(0, 256, (h, w, 3)) if rng.random() < 0.5 else np.clip(rng.normal(190, 30, (h, w, 3)) - 150 * (rng.random((h, w, 1)) < 0.1), 0, 255).astype(int)
        out.append(base.tolist())
    return out


def test_packed_filters_are_those_of_pixel_rows(spark, monkeypatch):
    from quire.operators import raster as R

    monkeypatch.setattr(R, "BAND", 7)
    shapes = [(1, 1), (1, 9), (9, 1), (40, 37), (40, 37), (33, 5), (5, 50), (64, 20)]
    images = [*_noise(5, shapes), [[(77, 77, 77)] * 3] * 3, [[(40, 40, 40), (200, 200, 200)] * 2] * 4]
    grid = spark.createDataFrame([(i, y, x, *p) for i, g in enumerate(images) for y, line in enumerate(g) for x, p in enumerate(line)], "image_id int, y int, x int, r int, g int, b int").repartition(3)
    bag = lambda df: Counter(map(tuple, df.select("image_id", "y", "x", "r", "g", "b").collect()))
    for name, by_pixel in G.PIPELINES.items():
        assert bag(R.apply_filter(grid, name)) == bag(by_pixel(grid)), name
    assert bag(R.unpack(R.pack(grid))) == bag(grid) == bag(R.apply_filter(grid, "unknown"))
    names = ["auto", "document", "magicColor", "blackWhite", "grayscale", None, "other"]
    manifest = spark.createDataFrame([(i, names[i % 7]) for i in range(9)] + [(0, "auto"), (99, "auto")], "image_id int, filter string")
    want = bag(G.apply_filters(grid, manifest))
    assert bag(R.apply_filters(grid, manifest)) == want
    lines = R.apply_filters(R.pack(grid), manifest)
    assert bag(R.unpack(lines)) == want and lines.columns == ["image_id", "y", "r", "g", "b"]
    two = R.apply_filters(grid.filter("image_id = 3"), spark.createDataFrame([(3, "auto"), (3, "grayscale")], "image_id int, filter string"))
    assert bag(two) == bag(G.img_auto(grid.filter("image_id = 3"))) + bag(G.img_grayscale_clean(grid.filter("image_id = 3")))
    for block, step in ((15, 3), (3, 1), (4, 3), (20, 5)):
        got, own = R.local_stats(grid, block, step), G.local_stats(grid, block, step)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, own.select(*got.columns).collect()))
    assert R.apply_filters(grid.limit(0), manifest).count() == 0 and R.pack(grid.limit(0)).count() == 0
    with pytest.raises(Exception, match="full rectangle"):
        R.pack(grid.filter("NOT (image_id = 3 AND y = 4 AND x = 4)")).count()


def test_packed_filters_need_two_exchanges(spark, sf):
    from quire.operators import raster as R

    lines = spark.createDataFrame([(1, 0, b"a", b"b", b"c")], "image_id long, y int, r binary, g binary, b binary")
    plan = R.apply_filters(lines, X.image_manifest(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan


def test_lines_of_image_files(spark, tmp_path):
    from quire.operators import raster as R

    (tmp_path / "a.png").write_bytes(_png([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)]]))
    (tmp_path / "junk.png").write_bytes(b"junk")
    images = files.image_scan(spark, f"file://{tmp_path}")
    pixels = R.unpack(R.image_lines(images))
    assert Counter(map(tuple, pixels.collect())) == Counter(map(tuple, files.image_grid(images).collect()))


def _book(spark, seed, docs=12, most=30):
    import random

    rng = random.Random(seed)
    sizes = {i: rng.choice([0, 1, 2, rng.randint(1, most)]) for i in range(docs)} | {100: 90}
    pages = [(i, k, rng.choice([None, "", "é" * rng.randint(0, 9), "some text "])) for i, n in sizes.items() for k in range(1, n + 1)]
    return rng, sizes, pages, spark.createDataFrame(pages, "doc_id long, page_no int, content string").repartition(5)


@pytest.mark.parametrize("block", [2, 4096])
def test_offsets_are_those_of_a_running_count(spark, monkeypatch, block):
    """Batches of many inputs, repeats, ties, gaps and nulls among positions; blocks of any size."""
    monkeypatch.setattr(P, "SUM_BLOCK", block)
    monkeypatch.setattr(P, "RANK_BITS", 3)
    rng, sizes, pages, df = _book(spark, block)
    full = [i for i, n in sizes.items() if n]
    manifest = [(b * 7 - 40, k * rng.choice([1, 3]), rng.choice(full)) for b in range(30) for k in range(rng.randint(0, 12))]
    manifest += [(1000, k, 100) for k in range(40)] + [(2000, 0, full[0]), (2000, 1, 12345), (3000, 0, full[0]), (4000, None, full[0]), (4000, -2, full[1]), (1 << 40, 0, 100), (1 << 40, 1, 100)]
    text = {(i, k): c for i, k, c in pages}
    want, done = Counter(), []
    for b in sorted({m[0] for m in manifest}):
        rows = sorted((m for m in manifest if m[0] == b), key=lambda m: (m[1] is not None, m[1] or 0, m[2]))
        if len(rows) < 2 or not all(sizes.get(m[2]) for m in rows):
            continue
        done.append(b)
        at = 0
        for _, position, doc in rows:
            for k in range(1, sizes[doc] + 1):
                at += 1
                want[(b, position, doc, k, text[doc, k], at)] += 1
    table = spark.createDataFrame(manifest, "batch_id long, position int, doc_id long").repartition(3)
    merged = P.merge_documents(table, df)
    assert Counter(map(tuple, merged.collect())) == want
    numbered = {(r.batch_id, r.ordinal) for r in P.merge_batches(table, df).select("batch_id", "ordinal").distinct().collect()}
    assert numbered == {(b, i + 1) for i, b in enumerate(done)}
    fixed = spark.createDataFrame(merged.collect(), merged.schema).repartition(4)
    for chars in (1, 7) if block == 2 else (10_000,):
        parts = P.assemble_parts(fixed, part_chars=chars).collect()
        for b in done[:4] + [1000]:
            own = sorted((k[-1], k[4] or "") for k in want.elements() if k[0] == b)
            artifact, starts, at = "\f".join(c for _, c in own), [], 0
            for n, c in own:
                starts.append((at, n))
                at += len(c) + 1
            got = sorted((r.part, r.first_page, r.n_bytes, r.content) for r in parts if r.batch_id == b)
            cut = [artifact[i : i + chars] for i in range(0, max(len(artifact), 1), chars)]
            first = [max(n for a, n in starts if a <= max(min(i * chars, len(artifact) - 1), 0)) if artifact else 1 for i in range(len(cut))]
            assert [(g[0], g[2], g[3]) for g in got] == [(i, len(c.encode()), c) for i, c in enumerate(cut)]
            if all(c for _, c in own):
                assert [g[1] for g in got] == first
    assert {r.batch_id: r.artifact for r in P.assemble(fixed).collect()}[1000] == "\f".join((k[4] or "") for k in sorted((k for k in want.elements() if k[0] == 1000), key=lambda k: k[-1]))


def test_contents_are_in_no_window(spark):
    manifest = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "batch_id long, position int, doc_id long")
    pages = spark.createDataFrame([(10, 1, "a"), (11, 1, "b")], "doc_id long, page_no int, content string")
    for merged in (P.merge_documents(manifest, pages), P.merge_batches(manifest, pages)):
        lines = merged._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not any("Window" in x and "content" in x for x in lines)
    counts = spark.createDataFrame([(10, 1)], "doc_id long, page_count long")
    ranges = spark.createDataFrame([(10, 1, 1, 1)], "doc_id long, range_ord int, start int, `end` int")
    selection = spark.createDataFrame([(10, 0, 0)], "doc_id long, sel_ord int, page_idx int")
    plan = P.output_stats(manifest, ranges, selection, counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 6 and "content" not in plan


@pytest.mark.parametrize("block", [1, 3, 64])
def test_ranges_by_blocks_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "RANGE_BLOCK", block)
    rng, sizes, pages, df = _book(spark, 20 + block)
    counts = [(i, n) for i, n in sizes.items()]
    ranges = [(i, k, rng.randint(-1, 12), rng.randint(-1, 35)) for i in [*sizes, 777] for k in range(6)] + [(100, k, 1 + k, 90 - k) for k in range(40)] + [(100, 99, None, 3)]
    text = {(i, k): c for i, k, c in pages}
    want = Counter((i, o, k, text[i, k], k - a + 1) for i, o, a, b in ranges if i in sizes and a is not None and 1 <= a <= b <= sizes[i] for k in range(a, b + 1))
    got = P.split_ranges(df, spark.createDataFrame(ranges, "doc_id long, range_ord int, start int, `end` int"), spark.createDataFrame(counts, "doc_id long, page_count long"))
    assert Counter(map(tuple, got.collect())) == want


def test_counts_from_requests_are_those_of_outputs(spark):
    rng, sizes, pages, df = _book(spark, 3)
    counts = spark.createDataFrame(list(sizes.items()), "doc_id long, page_count long")
    manifest = spark.createDataFrame([(b, k, rng.choice([*sizes, 5555])) for b in range(25) for k in range(rng.randint(1, 4))], "batch_id long, position int, doc_id long")
    rows = [(i, rng.randint(1, 2), rng.randint(0, 3), rng.randint(0, 9)) for i in sizes for _ in range(4)]
    ranges = spark.createDataFrame(rows + rows[:3], "doc_id long, range_ord int, start int, `end` int")
    selection = spark.createDataFrame([(i, k, rng.randint(0, max(n, 1) - rng.choice([0, 1, 1, 1]))) for i, n in sizes.items() for k in range(3)], "doc_id long, sel_ord int, page_idx int")
    got = {r.op: (r.outputs, r.pages, r.told) for r in P.output_stats(manifest, ranges, selection, counts).collect()}
    merged, picked, cut = P.merge_documents(manifest, df), P.extract_pages(df, selection, counts), P.split_ranges(df, ranges, counts)
    told = manifest.join(counts, "doc_id").agg(F.sum("page_count")).first()[0]
    assert got["merge"] == (merged.select("batch_id").distinct().count(), merged.count(), told)
    assert got["extract"] == (picked.select("doc_id").distinct().count(), picked.count(), picked.count())
    valid = P.valid_ranges(ranges, counts).count()
    assert got["split_range"] == (valid, cut.count(), valid)
    assert got["split_all"] == (len(pages),) * 3


def test_pages_with_gaps_are_numbered_anew(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 7, "c"), (2, 1, "a")], "doc_id long, page_no int, content string")
    manifest = spark.createDataFrame([(9, 0, 1), (9, 1, 2)], "batch_id long, position int, doc_id long")
    merged = P.merge_documents(manifest, P.renumber_pages(pages))
    assert sorted((r.out_page_no, r.content) for r in merged.collect()) == [(1, "b"), (2, "c"), (3, "a")]


def _folded(rows, every, gap_s):
    """Emitted events by a plain loop over (user, event, micros or None, free)."""
    out, state = set(), {}
    for user, event, at, free in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        n, last = state.get(user, (0, None))
        n += 1
        if n > 1 and n % every == 0 and free and (last is None or at - last >= gap_s * 1_000_000):
            out.add((user, event, at, n))
            last = at
        state[user] = (n, last)
    return out


@pytest.mark.parametrize("gap_s", [0, 1, 40, 3000])
def test_throttle_of_a_hot_key_is_the_fold(spark, gap_s):
    """A key cut into many pieces: dense and empty stretches, ties of time, null times and keys, times before 1970."""
    import random

    rng = random.Random(gap_s)
    at, rows = -5_000_000_000, []
    for i in range(6000):
        at += rng.choice([0, 1000, 900_000, 2_000_000, 2_000_000, 400_000_000 if rng.random() < 0.02 else 0])
        rows.append((rng.choice([7, 7, 7, 7, None, 8, 9 + i % 50]), i, None if rng.random() < 0.02 else at, rng.random() < 0.9))
    events = spark.createDataFrame(rows, "user_id long, event_id long, at long, free boolean").repartition(4)
    events = events.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "free")
    for every, hot, piece in ((3, 500, 40), (3, 500, 400), (3, 1 << 20, 1 << 18), (1, 300, 7)):
        got = E.throttle_events(events, every, gap_s, F.col("free"), hot, piece)
        assert {(r.user_id, r.event_id, r.at, r.n) for r in got.withColumn("at", F.unix_micros("ts")).collect()} == _folded(rows, every, gap_s)
    pieces = E._with_pieces(events.select("user_id", "event_id", F.unix_micros("ts").alias("at")).filter("at IS NOT NULL"), 500, 40).groupBy("user_id", "piece").count()
    assert pieces.filter("user_id = 7").count() > 30 and E.throttle_events(events.limit(0)).count() == 0


def test_throttle_of_early_and_missing_times(spark, tmp_path):
    rows = [(i, f"1960-01-01 00:00:0{i}" if i < 9 else None) for i in range(11)]
    events = spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"), F.lit(1).cast("long").alias("user_id"))
    assert [r.event_id for r in E.throttle_events(events).collect()] == [2]
    got = _streamed(spark, events.filter("ts IS NOT NULL"), E.throttle_stream, f"file://{tmp_path}", "early")
    assert [r.event_id for r in got.collect()] == [2]


def test_paths_and_numbers_of_any_size(spark):
    uris = [("file:///d/My%20File.pdf", "/d/My File.pdf"), ("file:///a+b%2Bc.pdf", "/a+b+c.pdf"), ("file:///%C3%A9.pdf", "/é.pdf"), ("file:///50%.pdf", "/50%.pdf"), ("file:/x%zz", "/x%zz"), ("http://h/x.pdf", None), (None, None)]
    got = spark.createDataFrame(uris, "uri string, want string").select(S.resolve_uri(F.col("uri"), F.lit("n"), F.lit(0)).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    texts = [("99999999999", "", 10, (10, 10), None), ("1", "3000000000", 10, (1, 10), None), ("-5000000000", "4", 10, (1, 4), None), ("9" * 30, "4", 10, (1, 4), (1, 4)), ("2", "3", 10, (2, 3), (2, 3)), ("1", "1", 0, None, None)]
    rows = spark.createDataFrame([t[:3] for t in texts], "a string, b string, total int")
    got = rows.select(S.parse_range_lenient(F.col("a"), F.col("b"), F.col("total")).alias("x"), S.parse_range_strict(F.col("a"), F.col("b"), F.col("total")).alias("y")).collect()
    assert [(r.x and tuple(r.x), r.y and tuple(r.y)) for r in got] == [t[3:] for t in texts]


def test_the_sessions_folder_is_cleared(spark, sf):
    import pathlib

    assert Q.QUERIES["catalog_scan"](spark, sf).count() > 0
    folder = pathlib.Path(files.session_folder(spark).removeprefix("file://"))
    assert any(folder.iterdir())
    files.clear_shared(spark)
    assert not folder.exists()


def test_a_stream_out_of_order_equals_the_table(spark, tmp_path):
    """Files whose rows overlap in time by less than the delay, ties, a key without new rows, and one file that moves the watermark on."""
    import random

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, 3]), i, 1_700_000_000 + rng.choice([i * 5, i * 5, i * 5 - i * 5 % 20]), rng.random() < 0.8) for i in range(600)]
    rows += [(4, 1000 + i, 1_700_000_000 + i * 40, True) for i in range(7)]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 250))
    schema = "user_id long, event_id long, s long, free boolean"
    as_events = lambda part: spark.createDataFrame(part, schema).select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "free")
    for i in range(0, len(rows), 100):
        as_events(rows[i : i + 100]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for s in (100_000, 200_000):
        as_events([(99, s, 1_700_000_000 + s, False)]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    frame = as_events(rows)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = E.throttle_stream(stream, gap_s=60, available=F.col("free"), delay="5 minutes")
    query = out.writeStream.format("memory").queryName("unordered").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = {(r.user_id, r.event_id, r.n) for r in E.throttle_events(frame, gap_s=60, available=F.col("free")).collect()}
    got = [(r.user_id, r.event_id, r.n) for r in spark.table("unordered").collect()]
    assert set(got) == want and len(got) == len(want) > 40
