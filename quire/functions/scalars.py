"""Column functions on file names, sizes, locations and page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quality levels and their image quality.
QUALITY = {"Low": 50, "Medium": 70, "High": 85, "Maximum": 100}
DEFAULT_QUALITY = 85
#: Fixed value: documents with fewer pages offer single pages to pick.
PICK_BELOW = 30
#: Bounds of width and height of a page's picture.
PREVIEWS = {"page": ((350, 1500), (350, 1700)), "list": ((280, 1100), (280, 1500)), "pick": ((280, 1600), (280, 1700))}
UNITS = [("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)]


def base_name(path: Column) -> Column:
    """Last part after ``/`` or ``\\``."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def display_title(path: Column) -> Column:
    """Base name without a staging prefix; ``View PDF`` where nothing telling is left."""
    name = base_name(path)
    bare = F.regexp_replace(name, r"^intent_[0-9]+_", "")
    untold = (bare == "") | ((bare == name) & name.startswith("intent_")) | (bare == "opened.pdf")
    return F.when(untold, "View PDF").otherwise(bare)


def format_file_size(size: Column) -> Column:
    """``0 B`` for null and below 1; tenths are rounded half up in integers."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, n in reversed(UNITS):
        tenths = F.call_function("div", 20 * size + n, F.lit(2 * n).cast("long"))
        shown = F.concat(F.call_function("div", tenths, F.lit(10).cast("long")).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= n, shown).otherwise(out)
    return F.when(size.isNull() | (size <= 0), "0 B").otherwise(out)


def quality_to_jpeg(quality: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, quality), F.lit(DEFAULT_QUALITY))


def is_pdf_uri(uri: Column) -> Column:
    lower = F.lower(uri)
    return F.coalesce(lower.contains(".pdf") | lower.startswith("content://") | lower.startswith("file://"), F.lit(False))


def ensure_pdf_name(name: Column) -> Column:
    """Null names become ``opened.pdf``; other endings get ``.pdf``."""
    named = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.coalesce(named, F.lit("opened.pdf"))


def uri_scheme(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)


def resolve_uri(uri: Column, name: Column, stamp: Column) -> Column:
    """A file's path with its percent codes decoded, the staged name of shared content, or null for other schemes.

    A plus sign is one; a path whose codes are no text stays as it is.
    """
    coded = F.regexp_extract(uri, r"^file:(?://[^/?#]*)?([^?#]*)", 1)
    path = F.coalesce(F.try_url_decode(F.replace(coded, F.lit("+"), F.lit("%2B"))), coded)
    staged = F.concat(F.lit("intent_"), stamp.cast("string"), F.lit("_"), ensure_pdf_name(name))
    return F.when(uri_scheme(uri) == "file", path).when(uri_scheme(uri) == "content", staged)


def _number(text: Column) -> Column:
    """A whole number of up to 64 bits, else null."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.try_cast("int").alias("start"), end.try_cast("int").alias("end"))


def parse_range_lenient(first: Column, last: Column, total: Column) -> Column:
    """struct(start, end), both clamped to the document; null if reversed or the document is empty."""
    start = F.greatest(F.lit(1), F.least(F.coalesce(_number(first), F.lit(1)), total))
    end = F.greatest(F.lit(1), F.least(F.coalesce(_number(last), total), total))
    return F.when((total >= 1) & (start <= end), _range(start, end))


def parse_range_strict(first: Column, last: Column, total: Column) -> Column:
    """struct(start, end); null if it leaves the document or is reversed."""
    start, end = F.coalesce(_number(first), F.lit(1)), F.coalesce(_number(last), total)
    return F.when((start >= 1) & (end <= total) & (start <= end), _range(start, end))


def split_mode(page_count: Column, chosen: Column) -> Column:
    """``pick`` for 1 to 29 pages, else the chosen mode, by default ``range``."""
    return F.when((page_count > 0) & (page_count < PICK_BELOW), "pick").otherwise(F.coalesce(chosen, F.lit("range")))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.try_divide(width, height)


def preview_size(width: Column, height: Column, kind: str = "page") -> Column:
    """struct(width, height) in pixels of the picture of a page: alone, in a list, or where pages are picked."""
    widths, heights = PREVIEWS[kind]
    bounded = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c + 0.5))).cast("int")
    return F.struct(bounded(width, *widths).alias("width"), bounded(height, *heights).alias("height"))


def shown_ratio(ratio: Column) -> Column:
    return F.coalesce(F.greatest(F.least(ratio, F.lit(1.5)), F.lit(0.5)), F.lit(0.7))


def save_path(root: str, location: Column, prefix: Column, stamp: Column, auto_save: Column) -> Column:
    """Destination of an output; null if it is not saved by itself."""
    folder = F.when(location == "Documents", "Documents").otherwise("Downloads")
    return F.when(auto_save, F.concat(F.lit(f"{root}/"), folder, F.lit("/"), prefix, F.lit("_"), stamp.cast("string"), F.lit(".pdf")))


def output_prefix(op: Column, ordinal: Column) -> Column:
    """Name prefix of an output by operation; ordinals start at 1."""
    i = ordinal.cast("string")
    return F.when(op == "merge", F.concat(F.lit("merged_"), i)).when(op == "scan", "scanned").when(op == "split_range", F.concat(F.lit("split_"), i)).when(op == "split_all", F.concat(F.lit("page_"), i)).when(op == "extract", "extracted")
