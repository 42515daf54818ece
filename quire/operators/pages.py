"""Page-sequence operators: a document is an ordered set of page rows.

``pages`` has doc_id, page_no and content; a page is known by its position, so
page numbers run from 1 without gaps (``renumber_pages`` makes them so). Requests
are tables: ``manifest`` (batch_id, position, doc_id), ``ranges`` (doc_id,
range_ord, start, end), ``selection`` (doc_id, sel_ord, page_idx from 0). Every
operator handles all documents at once, carries explicit ordinals and joins on
document ids; what a request leaves out is told by ``reject_report``.

Positions in an output are sums of counts, taken over the request tables and never
over page contents; contents are moved once, by document, and a document or batch
with a large share of all pages is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Page box of an image.
PAGE_BOX = (595.0, 842.0)
#: Entry points and their actions.
ACTIONS = [("View", "view"), ("Merge", "merge"), ("Split", "split")]
#: Inputs of a batch, or pages of an output, whose sizes are summed in one group.
SUM_BLOCK = 4096
#: Page numbers that a range is joined by at once.
RANGE_BLOCK = 64
#: Characters of a part of an assembled output.
PART_CHARS = 1 << 20
#: Bits of a key that are ranked at once.
RANK_BITS = 20


def paginate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "\n") -> DataFrame:
    """Cut texts into pages at a mark, taken as it is; blank pages stay."""
    plain = "\\Q" + mark.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, plain)).alias("at", "content"))
    return cut.select("doc_id", (F.col("at") + 1).alias("page_no"), "content")


def page_count(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each catalogued document; 0 where there are none."""
    counted = pages.groupBy("doc_id").agg(F.count("page_no").alias("n"))
    return catalog.select("doc_id").distinct().join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("page_count"))


def first_page(pages: DataFrame) -> DataFrame:
    return pages.filter("page_no = 1")


def mergeable_batches(manifest: DataFrame) -> DataFrame:
    """Rows of batches that have at least two inputs."""
    enough = manifest.groupBy("batch_id").count().filter("count >= 2").select("batch_id")
    return manifest.join(enough, "batch_id", "left_semi")


def _renumber(by: list[str], order: list[str]) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def _div(c: Column, n: int) -> Column:
    return F.call_function("div", c.cast("long"), F.lit(n).cast("long"))


def _before(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of a column over the rows before, in a group."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def renumber_pages(pages: DataFrame) -> DataFrame:
    """Pages numbered from 1 without gaps, in the order of their numbers: for tables that lost pages."""
    return pages.withColumn("page_no", _renumber(["doc_id"], ["page_no"]))


def _inputs(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Inputs of batches with their pages n, null where there are none, and their block of positions; null positions come first."""
    has = counts.filter("page_count > 0").select("doc_id", F.col("page_count").alias("n"))
    block = F.coalesce(_div(F.col("position"), SUM_BLOCK), F.lit(-(2**62)))
    return manifest.select("batch_id", "position", "doc_id").join(has, "doc_id", "left").withColumn("block", block)


def _complete_blocks(inputs: DataFrame) -> DataFrame:
    """batch_id, block, blocks_before (pages of the blocks before) of complete batches."""
    blocks = inputs.groupBy("batch_id", "block").agg(F.sum("n").alias("block_n"), F.count(F.lit(1)).alias("inputs"), F.count("n").alias("there"))
    whole = W.partitionBy("batch_id")
    judged = blocks.select("batch_id", "block", _before("block_n", ["batch_id"], ["block"]).alias("blocks_before"), F.sum("inputs").over(whole).alias("inputs"), F.sum("there").over(whole).alias("there"))
    return judged.filter("inputs >= 2 AND inputs = there").drop("inputs", "there")


def input_offsets(manifest: DataFrame, counts: DataFrame, ordinals: bool = False) -> DataFrame:
    """batch_id, position, doc_id, page_offset of the inputs of complete batches: the pages that come before each in its output.

    A batch is complete if it has at least two inputs, all of which have pages: a
    merge succeeds as a whole or not at all. Sums are taken in blocks of positions
    and then over blocks, so a batch with very many inputs is no single group.
    With ``ordinals`` there is the batch's ordinal, from 1, among the complete ones.
    """
    inputs = _inputs(manifest, counts)
    complete = _complete_blocks(inputs)
    more = ["ordinal"] if ordinals else []
    if ordinals:
        complete = complete.join(dense_ordinals(complete.select("batch_id"), "batch_id"), "batch_id")
    within = _before("n", ["batch_id", "block"], ["position", "doc_id"])
    return inputs.join(complete, ["batch_id", "block"]).select("batch_id", *more, "position", "doc_id", (F.col("blocks_before") + within).alias("page_offset"))


def _counted(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("page_no").alias("page_count"))


def merge_documents(manifest: DataFrame, pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Pages of each complete batch's documents in (position, page_no) order, renumbered.

    A page's number is its own and the pages of the inputs before; ``counts``
    (doc_id, page_count) is taken from the page numbers if it is not given.
    """
    offsets = input_offsets(manifest, _counted(pages) if counts is None else counts)
    out_page_no = (F.col("page_offset") + F.col("page_no")).cast("int")
    return offsets.join(pages, "doc_id").select("batch_id", "position", "doc_id", "page_no", "content", out_page_no.alias("out_page_no"))


def dense_ordinals(ids: DataFrame, key: str) -> DataFrame:
    """Distinct whole-number keys with their ordinal from 1, without sorting them in one task.

    A key's ordinal is its rank among the keys that differ in the last bits only,
    and the keys below in the groups before, which are ranked alike, twice.
    Groups have at most 2 ** RANK_BITS members (the last, of the highest bits, 16
    times as many), whatever the keys are; nothing is sampled or collected.
    """
    low, high = F.shiftright(F.col(key).cast("long"), RANK_BITS), F.shiftright(F.col(key).cast("long"), 2 * RANK_BITS)
    group = W.partitionBy("_low")
    ranked = ids.select(key, low.alias("_low"), high.alias("_high")).distinct().select(key, "_low", "_high", F.row_number().over(group.orderBy(key)).alias("_own"), F.count(F.lit(1)).over(group).alias("_n"))
    lows = ranked.filter("_own = 1").select("_low", "_high", "_n", _before("_n", ["_high"], ["_low"]).alias("_lows_before"))
    highs = lows.groupBy("_high").agg(F.sum("_n").alias("_n")).select("_high", F.coalesce(F.sum("_n").over(W.orderBy("_high").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_highs_before"))
    before = lows.join(highs, "_high").select("_low", (F.col("_lows_before") + F.col("_highs_before")).alias("_before"))
    return ranked.join(before, "_low").select(key, (F.col("_own") + F.col("_before")).cast("int").alias("ordinal"))


def merge_batches(manifest: DataFrame, pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``merge_documents`` with an ordinal, from 1, over the batches that succeed."""
    offsets = input_offsets(manifest, _counted(pages) if counts is None else counts, ordinals=True)
    out_page_no = (F.col("page_offset") + F.col("page_no")).cast("int")
    return offsets.join(pages, "doc_id").select("batch_id", "ordinal", out_page_no.alias("out_page_no"), "doc_id", "page_no", "content")


def assemble_parts(merged: DataFrame, out_col: str = "batch_id", part_chars: int = PART_CHARS) -> DataFrame:
    """Artifacts in parts: out_col, part (from 0), first_page, n_bytes, content.

    An artifact is its pages' contents in order, joined by form feeds; a null
    content is empty. Part k holds its characters from ``k * part_chars`` on, so
    no row is longer, and a page longer than a part is cut. Places are summed in
    blocks of pages, so an output with very many pages is no single group; an
    output without characters has one empty part.
    """
    rows = merged.select(out_col, "out_page_no", F.coalesce("content", F.lit("")).alias("text"), _div(F.col("out_page_no"), SUM_BLOCK).alias("block"))
    rows = rows.withColumn("n", (F.char_length("text") + 1).cast("long"))
    blocks = rows.groupBy(out_col, "block").agg(F.sum("n").alias("block_n"))
    placed = blocks.select(out_col, "block", _before("block_n", [out_col], ["block"]).alias("blocks_before"), F.sum("block_n").over(W.partitionBy(out_col)).alias("all_n"))
    at = F.col("blocks_before") + _before("n", [out_col, "block"], ["out_page_no"])
    pages = rows.join(placed, [out_col, "block"]).select(out_col, "out_page_no", "text", at.alias("at"), "n", "all_n")
    # the last page has no form feed behind it
    ended = pages.withColumn("text", F.when(F.col("at") + F.col("n") == F.col("all_n"), F.col("text")).otherwise(F.concat("text", F.lit("\f"))))
    last = F.greatest(F.col("at") + F.char_length("text") - 1, F.col("at"))
    slices = ended.withColumn("part", F.explode(F.sequence(_div(F.col("at"), part_chars), _div(last, part_chars))))
    start = F.greatest(F.col("part") * part_chars - F.col("at"), F.lit(0).cast("long"))
    room = (F.col("part") + 1) * part_chars - F.greatest(F.col("at"), F.col("part") * part_chars)
    slices = slices.select(out_col, "part", "out_page_no", F.col("at").alias("_at"), F.substring("text", (start + 1).cast("int"), room.cast("int")).alias("piece"))
    slices = slices.filter("piece <> '' OR (part = 0 AND out_page_no = 1)")
    parts = slices.groupBy(out_col, "part").agg(F.array_sort(F.collect_list(F.struct("out_page_no", "piece"))).alias("p"))
    content = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return parts.select(out_col, "part", F.element_at("p", 1)["out_page_no"].alias("first_page"), F.octet_length(content).cast("long").alias("n_bytes"), content.alias("content"))


def assemble(merged: DataFrame, out_col: str = "batch_id") -> DataFrame:
    """One artifact per output in one row, for outputs that fit in a row; others are taken by ``assemble_parts``."""
    rows = merged.groupBy(out_col).agg(F.array_sort(F.collect_list(F.struct("out_page_no", "content"))).alias("p"))
    return rows.select(out_col, F.size("p").alias("n_pages"), F.array_join(F.transform("p", lambda x: F.coalesce(x["content"], F.lit(""))), "\f").alias("artifact"))


def write_outputs(outputs: DataFrame, path: str, by: str = "op") -> None:
    outputs.write.mode("overwrite").partitionBy(by).parquet(path)


def valid_ranges(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """Ranges inside their document; others are dropped one by one."""
    return ranges.join(counts, "doc_id").filter("start >= 1 AND `end` <= page_count AND start <= `end`").select(*ranges.columns)


def split_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Pages start to end of every document that has them all, renumbered."""
    whole = pages.groupBy("doc_id").agg(F.max("page_no").alias("n")).filter(F.lit(start >= 1 and start <= end) & (F.col("n") >= end)).select("doc_id")
    kept = pages.filter(F.col("page_no").between(start, end)).join(whole, "doc_id", "left_semi")
    return kept.select("doc_id", "page_no", "content", (F.col("page_no") - (start - 1)).alias("out_page_no"))


def split_ranges(pages: DataFrame, ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """One output per valid range.

    Ranges are cut at blocks of page numbers and joined by document and block, so
    at most a block at each end of a range is met in vain, and the pages of a
    document with many ranges are spread over tasks.
    """
    good = valid_ranges(ranges, counts).select("doc_id", "range_ord", F.col("start").alias("first"), F.col("end").alias("last"))
    cut = good.withColumn("block", F.explode(F.sequence(_div(F.col("first"), RANGE_BLOCK), _div(F.col("last"), RANGE_BLOCK))))
    inside = cut.join(pages.withColumn("block", _div(F.col("page_no"), RANGE_BLOCK)), ["doc_id", "block"]).filter("page_no BETWEEN first AND last")
    return inside.select("doc_id", "range_ord", "page_no", "content", (F.col("page_no") - F.col("first") + 1).alias("out_page_no"))


def valid_selection(selection: DataFrame, counts: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All-or-nothing: one index outside the document rejects its whole selection.

    ``by`` names the columns that make a selection, the document among them, so that
    a document may have several.
    """
    judged = selection.join(counts, "doc_id", "left")
    bad = judged.filter(F.col("page_count").isNull() | (F.col("page_idx") < 0) | (F.col("page_idx") >= F.col("page_count")) | F.col("page_idx").isNull())
    return selection.join(bad.select(*by).distinct(), list(by), "left_anti")


def extract_pages(pages: DataFrame, selection: DataFrame, counts: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chosen pages in the order given, repeats kept; one output for each selection."""
    more = [c for c in by if c != "doc_id"]
    good = valid_selection(selection, counts, by).select("doc_id", *more, "sel_ord", (F.col("page_idx") + 1).alias("page_no"))
    return good.join(pages, ["doc_id", "page_no"]).select("doc_id", *more, "page_no", "content", _renumber(list(by), ["sel_ord"]).alias("out_page_no"))


def extract_selected(pages: DataFrame, selection: DataFrame, counts: DataFrame) -> DataFrame:
    """Chosen pages as a set, ascending."""
    distinct = selection.select("doc_id", "page_idx").distinct()
    return extract_pages(pages, distinct.withColumn("sel_ord", F.col("page_idx")), counts)


def select_all(counts: DataFrame) -> DataFrame:
    """Every page index of every document."""
    every = counts.filter("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1)).alias("page_idx"))
    return every.select("doc_id", F.col("page_idx").alias("sel_ord"), "page_idx")


def split_all(pages: DataFrame) -> DataFrame:
    """Each page as a document of its own: a projection, no shuffle."""
    return pages.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("page_no").cast("string")).alias("out_id"), F.concat(F.lit("page_"), F.col("page_no").cast("string")).alias("name"), F.lit(1).alias("out_page_no"), "doc_id", "page_no", "content")


def images_to_document(image_manifest: DataFrame, images: DataFrame, quality: int = 85) -> DataFrame:
    """One page per image in position order, with the page box and target quality.

    An image that can't be decoded is passed on as it is: it has a page, but no
    quality. ``images`` has image_id and decoded; images that it lacks are not decoded.
    """
    known = image_manifest.join(images.select("image_id", "decoded"), "image_id", "left").withColumn("decoded", F.coalesce("decoded", F.lit(False)))
    return known.select("doc_id", "image_id", _renumber(["doc_id"], ["position"]).alias("page_no"), F.lit(PAGE_BOX[0]).alias("width"), F.lit(PAGE_BOX[1]).alias("height"), F.when(F.col("decoded"), quality).alias("quality"), "decoded")


def action_lookup(requests: DataFrame) -> DataFrame:
    """Requests with the action of their entry point; unknown ones view. The lookup has three rows."""
    known = requests.sparkSession.createDataFrame(ACTIONS, "alias string, known_action string")
    return requests.join(F.broadcast(known), "alias", "left").withColumn("action", F.coalesce("known_action", F.lit("view"))).drop("known_action")


def batch_stats(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: batches that can merge, pages and files over all batches, loading files."""
    rows = manifest.join(catalog.select("doc_id", "page_count", "is_loading"), "doc_id", "left")
    each = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"), F.count_if(F.coalesce("is_loading", F.lit(False))).alias("loading"))
    return each.agg(
        F.count_if(F.col("files") >= 2).alias("mergeable"),
        F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("total_pages"),
        F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("total_files"),
        F.coalesce(F.sum("loading"), F.lit(0)).cast("long").alias("loading_files"),
        F.coalesce(F.bool_and(F.col("loading") == 0), F.lit(True)).alias("all_loaded"),
        F.count(F.lit(1)).alias("non_empty"),
    )


def output_stats(manifest: DataFrame, ranges: DataFrame, selection: DataFrame, counts: DataFrame) -> DataFrame:
    """op, outputs, pages, told: outputs and pages by operation, as a completion message tells them.

    All is counted from the requests and the page counts (doc_id, page_count), in
    one pass over tagged rows: by request, then by operation. ``told`` is the number
    in the message: for merges the pages of all batches, also of those too small
    to merge; for extraction the selected pages; for other splits the number of
    outputs.
    """
    none = F.lit(None).cast("long")

    def tagged(df: DataFrame, op: str, request: Column, doc: Column, first: Column = none, last: Column = none) -> DataFrame:
        return df.select(F.lit(op).alias("op"), request.cast("string").alias("request"), doc.cast("long").alias("doc_id"), first.cast("long").alias("first"), last.cast("long").alias("last"))

    doc = F.col("doc_id")
    asked = tagged(manifest, "merge", F.col("batch_id"), doc)
    asked = asked.unionByName(tagged(ranges, "split_range", F.concat_ws("/", doc.cast("string"), F.col("range_ord").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")), doc, F.col("start"), F.col("end")))
    asked = asked.unionByName(tagged(selection, "extract", doc, doc, F.col("page_idx") + 1, F.col("page_idx") + 1))
    known = counts.select(F.col("doc_id").cast("long").alias("doc_id"), "page_count")
    rows = asked.join(known, "doc_id", "left")
    n = F.col("page_count")
    fits = F.when(F.col("op") == "merge", n > 0).otherwise((F.col("first") >= 1) & (F.col("last") <= n) & (F.col("first") <= F.col("last")))
    pages = F.when(F.col("op") == "merge", n).otherwise(F.col("last") - F.col("first") + 1)
    requests = rows.groupBy("op", "request").agg(F.count(F.lit(1)).alias("inputs"), F.bool_and(F.coalesce(fits, F.lit(False))).alias("good"), F.sum(pages).alias("pages"))
    # equal ranges are requests of their own; a selection or a batch is one
    outputs = F.when(F.col("op") == "split_range", F.col("inputs")).otherwise(F.lit(1))
    good = F.col("good") & ((F.col("op") != "merge") | (F.col("inputs") >= 2))
    zero = F.lit(0).cast("long")
    by_op = requests.groupBy("op").agg(F.sum(F.when(good, outputs).otherwise(zero)).alias("outputs"), F.sum(F.when(good, F.col("pages")).otherwise(zero)).alias("pages"), F.coalesce(F.sum("pages"), zero).alias("every"))
    told = F.when(F.col("op") == "merge", F.col("every")).when(F.col("op") == "extract", F.col("pages")).otherwise(F.col("outputs"))
    exploded = known.agg(F.coalesce(F.sum("page_count"), zero).alias("n")).select(F.lit("split_all").alias("op"), F.col("n").alias("outputs"), F.col("n").alias("pages"), F.col("n").alias("told"))
    return by_op.select("op", "outputs", "pages", told.alias("told")).unionByName(exploded)


def reject_report(manifest: DataFrame, ranges: DataFrame, selection: DataFrame, counts: DataFrame) -> DataFrame:
    """op, request, reason of every request that gives no output."""
    inputs = manifest.join(counts, "doc_id", "left").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_count").isNull()).alias("missing"), F.count_if(F.col("page_count") == 0).alias("empty"))
    wrong = F.when(F.col("n") < 2, "too_few_inputs").when(F.col("missing") > 0, "missing_doc").when(F.col("empty") > 0, "empty_document")
    few = inputs.select(F.lit("merge").alias("op"), F.col("batch_id").cast("string").alias("request"), wrong.alias("reason")).filter("reason IS NOT NULL")

    def why(bad: Column, told: str) -> Column:
        return F.when(F.col("page_count").isNull(), "missing_doc").when(F.col("page_count") == 0, "empty_document").when(bad, told)

    judged = ranges.join(counts, "doc_id", "left")
    outside = ~((F.col("start") >= 1) & (F.col("end") <= F.col("page_count")) & (F.col("start") <= F.col("end")))
    bad_ranges = judged.select(F.lit("split_range").alias("op"), F.concat_ws("/", F.col("doc_id").cast("string"), F.col("range_ord").cast("string")).alias("request"), why(outside, "bad_range").alias("reason"))
    chosen = selection.join(counts, "doc_id", "left")
    beyond = (F.col("page_idx") < 0) | (F.col("page_idx") >= F.col("page_count"))
    bad_picks = chosen.select(F.lit("extract").alias("op"), F.col("doc_id").cast("string").alias("request"), why(beyond, "index_out_of_range").alias("reason"))
    return few.unionByName(bad_ranges.filter("reason IS NOT NULL")).unionByName(bad_picks.filter("reason IS NOT NULL").distinct())
