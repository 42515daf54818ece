"""Page-image filters on packed images: numpy kernels over whole images, many at a time.

The same filters as on pixel rows, and equal to them, for images of real size. An
image is a set of *lines* (image_id, y and three binary columns r, g, b with a byte
for each pixel), or of pixel rows (image_id, y, x, r, g, b). Spark deals either out
by image and sorts it; a task takes image after image from the sorted stream, holds
the bytes of one image (or of a batch of small images of one shape) and works on
bands of ``BAND`` lines with the neighbouring lines that a filter reads, so that
what it needs beside the image's bytes is bounded. Levels and thresholds are
found in the same pass: a chain of filters is one exchange.

Square samples are taken by running sums and running extremes of each residue of the
step, so the work for a pixel does not depend on the size of the square.

Defined cases: an image that no manifest row names, or with an unknown filter, stays
as it is; an image named with several filters gives the result of each; null ids are
one image. Lines are full rectangles from (0, 0), and an image of lines that is not
raises an error, also one to be packed. Pixel rows may have gaps: then an image's
rectangle reaches to its greatest y and x, samples at places without a pixel are left
out, a missing neighbour is the next pixel in its direction, and only the pixels that
are there come out, as in SQL. Such an image is taken at once, not in bands; one with
two pixels at a place or with places below 0 raises an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.grid import CONTRAST, RGB, SHARPEN, brightness_table, contrast_table

#: Lines that a kernel takes at once, and pixels of small images that are taken together.
BAND = 128
STACK = 1 << 19
LINES = "y int, r binary, g binary, b binary"
PIXELS = "y int, x int, r int, g int, b int"
ORIGINAL = "original"


# kernels: arrays have the shape (images, channels, lines, columns)


def luma(rgb: np.ndarray) -> np.ndarray:
    wide = rgb.astype(np.int32)
    return (299 * wide[:, 0] + 587 * wide[:, 1] + 114 * wide[:, 2]) // 1000


def _stretched(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Values between an image's extremes from 0 to 255; flat images stay."""
    shape = (-1,) + (1,) * (values.ndim - 1)
    low, high = low.reshape(shape).astype(np.int32), high.reshape(shape).astype(np.int32)
    return np.where(high > low, (values.astype(np.int32) - low) * 255 // np.maximum(high - low, 1), values)


def _before(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The value at the last place before each one, along the last axis, that is there; its own if there is none."""
    n = there.shape[-1]
    own = np.arange(n)
    last = np.maximum.accumulate(np.where(there, own, -1), axis=-1)
    last = np.concatenate([np.full((*there.shape[:-1], 1), -1), last[..., :-1]], axis=-1)
    return np.take_along_axis(values, np.broadcast_to(np.where(last < 0, own, last)[:, None], values.shape), axis=-1)


def _around(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Sum of the next values that are there on the four sides."""
    flip = lambda x: x[..., ::-1]
    turn = lambda x: np.swapaxes(x, -1, -2)
    both = lambda v, t: _before(v, t) + flip(_before(flip(v), flip(t)))
    return both(values, there) + turn(both(turn(values), turn(there)))


def _sharpened(values: np.ndarray, center: int, side: int, there: np.ndarray | None = None) -> np.ndarray:
    """Cross kernel in tenths; at the edges a pixel stands in for its missing neighbour."""
    if there is not None:
        v = values.astype(np.int32)
        return np.clip((center * v - side * _around(v, there)) // 10, 0, 255)
    v = np.pad(values.astype(np.int32), ((0, 0), (0, 0), (1, 1), (1, 1)), "edge")
    around = v[..., :-2, 1:-1] + v[..., 2:, 1:-1] + v[..., 1:-1, :-2] + v[..., 1:-1, 2:]
    return np.clip((center * v[..., 1:-1, 1:-1] - side * around) // 10, 0, 255)


def _saturated(rgb: np.ndarray, tenths: int = 12) -> np.ndarray:
    gray = luma(rgb)[:, None]
    apart = (rgb - gray) * tenths
    return np.clip(gray + np.sign(apart) * (np.abs(apart) // 10), 0, 255)


def _runs_of(values: np.ndarray, block: int, step: int) -> tuple[np.ndarray, int]:
    """The last axis with its edges repeated, as (places, residue of the step); samples of a window."""
    n = len(range(-block, block + 1, step))
    padded = np.pad(values, [(0, 0)] * (values.ndim - 1) + [(block, block)], "edge")
    more = -padded.shape[-1] % (step * n)
    padded = np.pad(padded, [(0, 0)] * (values.ndim - 1) + [(0, more)], "edge")
    return padded.reshape(*padded.shape[:-1], -1, step), n


def _window_sum(values: np.ndarray, block: int, step: int) -> np.ndarray:
    runs, n = _runs_of(values, block, step)
    total = np.cumsum(runs, axis=-2, dtype=np.int64)
    total[..., n:, :] -= total[..., :-n, :].copy()
    return total.reshape(*total.shape[:-2], -1)[..., (n - 1) * step :][..., : values.shape[-1]]


def _window_extreme(values: np.ndarray, block: int, step: int, least: bool) -> np.ndarray:
    """Extremes of windows by those of the blocks' ends that they reach into."""
    f = np.minimum if least else np.maximum
    runs, n = _runs_of(values, block, step)
    blocks = runs.reshape(*runs.shape[:-2], -1, n, step)
    before = f.accumulate(blocks, axis=-2).reshape(runs.shape)
    after = f.accumulate(blocks[..., ::-1, :], axis=-2)[..., ::-1, :].reshape(runs.shape)
    found = f(after[..., : runs.shape[-2] - n + 1, :], before[..., n - 1 :, :])
    return found.reshape(*found.shape[:-2], -1)[..., : values.shape[-1]]


def sampled(gray: np.ndarray, block: int = 15, step: int = 3, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total, least and greatest of the square sample around each pixel of (images, lines, columns).

    Of a sample without a pixel that is ``there`` the least is over the greatest.
    """

    def both(f, none, *more):
        along = f(gray if there is None else np.where(there, gray, none), block, step, *more)
        return np.swapaxes(f(np.ascontiguousarray(np.swapaxes(along, -1, -2)), block, step, *more), -1, -2)

    return both(_window_sum, 0), both(_window_extreme, 256, True), both(_window_extreme, -1, False)


def _whitened(rgb: np.ndarray, block: int, step: int, there: np.ndarray | None = None) -> np.ndarray:
    """Paper and ink by local contrast and threshold, in the order of operations of the pixel form."""
    # fixed values: the shares, bounds and offsets below
    n = len(range(-block, block + 1, step)) ** 2
    gray = luma(rgb)
    total, low, high = sampled(gray, block, step, there)
    lum, v = gray.astype(np.float64)[:, None], rgb.astype(np.float64)
    threshold = (total.astype(np.float64) / float(n) * 0.85 - 8.0)[:, None]
    flat = ((high - low).astype(np.float64) / 255.0)[:, None] < 0.15
    ink = np.clip(v * (0.3 + lum / 255.0 * 0.4), 0.0, 80.0).astype(np.int32)
    share = 0.3 + (lum - threshold) / (255.0 - threshold) * 0.7
    paper = np.clip(255.0 - (255.0 - v) * (1.0 - share), 240.0, 255.0).astype(np.int32)
    return np.where(flat, 255, np.where(lum < threshold, ink, paper))


def otsu(histogram: np.ndarray) -> np.ndarray:
    """Threshold of each row of 256 counts: 0.9 of the first level with the largest variance, of 128 where there is none."""
    level = np.arange(256)
    below, weighed = np.cumsum(histogram, axis=1), np.cumsum(histogram * level, axis=1)
    above = below[:, -1:] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = weighed / below - (weighed[:, -1:] - weighed) / above
        variance = np.where((below > 0) & (above > 0), (below * above).astype(np.float64) * apart * apart, 0.0)
    best = np.where(variance.max(axis=1) > 0, variance.argmax(axis=1), 128)
    return (best.astype(np.float64) * 0.9).astype(np.int32)


class Levels:
    """What a filter must know of whole images: extremes of their values or of their luma, and a threshold."""

    def __init__(self, rgb: np.ndarray, name: str):
        n = len(rgb)
        self.low = self.high = self.threshold = np.zeros(n, np.int32)
        if name in ("auto", "magicColor"):
            self.low, self.high = rgb.reshape(n, -1).min(axis=1), rgb.reshape(n, -1).max(axis=1)
        elif name in ("blackWhite", "grayscale"):
            counts = np.zeros((n, 256), np.int64)
            for y in range(0, rgb.shape[2], BAND):
                gray = luma(rgb[:, :, y : y + BAND]).reshape(n, -1)
                counts += np.bincount((np.arange(n)[:, None] * 256 + gray).reshape(-1), minlength=256 * n).reshape(n, 256)
            self.low, self.high = (counts > 0).argmax(axis=1), 255 - (counts[:, ::-1] > 0).argmax(axis=1)
            if name == "blackWhite":
                moved = _stretched(np.broadcast_to(np.arange(256), (n, 256)), self.low, self.high)
                inside = np.clip(moved, 0, 255) + np.arange(n)[:, None] * 256
                self.threshold = otsu(np.bincount(inside.reshape(-1), counts.reshape(-1), 256 * n).reshape(n, 256).astype(np.int64))


def _table(values: np.ndarray, table: list[int]) -> np.ndarray:
    return np.array(table, np.int32)[values]


def _band(rgb: np.ndarray, name: str, levels: Levels, block: int, step: int, there: np.ndarray | None = None) -> np.ndarray:
    if name == "document":
        return _sharpened(_whitened(rgb, block, step), *SHARPEN["document"])
    if name in ("auto", "magicColor"):
        v = _stretched(rgb, levels.low, levels.high)
        if name == "auto":
            return _sharpened(_table(v, contrast_table(CONTRAST["auto"])), *SHARPEN["auto"], there)
        v = _table(_table(_saturated(v), contrast_table(CONTRAST["magic"])), brightness_table(1.08, 0.9))
        return _sharpened(v, *SHARPEN["magic"], there)
    gray = np.repeat(_stretched(luma(rgb), levels.low, levels.high)[:, None], 3, axis=1)
    if name == "grayscale":
        return _sharpened(_table(_table(gray, contrast_table(CONTRAST["grayscale"])), brightness_table(1.05)), *SHARPEN["grayscale"], there)
    cut = levels.threshold.reshape(-1, 1, 1, 1)
    return np.where(gray < cut - 20, 0, np.where(gray > cut + 20, 255, np.clip((gray - (cut - 20)) * 255 // 40, 0, 255)))


#: Lines beyond a band that each filter reads, besides those of the square sample.
REACH = {"document": 1, "auto": 1, "magicColor": 1, "grayscale": 1, "blackWhite": 0}


def filtered(rgb: np.ndarray, name: str | None, block: int = 15, step: int = 3) -> np.ndarray:
    """Images of one shape (images, 3, lines, columns) by a filter, band by band; unknown filters leave them."""
    if name not in REACH:
        return rgb
    levels, height = Levels(rgb, name), rgb.shape[2]
    reach = REACH[name] + (block if name == "document" else 0)
    out = np.empty_like(rgb)
    for y in range(0, height, BAND):
        above, end = min(y, reach), min(y + BAND, height)
        out[:, :, y:end] = _band(rgb[:, :, y - above : min(end + reach, height)], name, levels, block, step)[:, :, above : above + end - y]
    return out


def filtered_with_gaps(rgb: np.ndarray, there: np.ndarray, name: str | None, block: int = 15, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The same of one image (1, 3, lines, columns) with the pixels that are ``there``; a pixel without a sample goes."""
    if name not in REACH:
        return rgb, there
    levels = Levels(rgb[:, :, there[0]][:, :, None], name)
    if name == "document":
        _, low, high = sampled(luma(rgb), block, step, there)
        whitened, there = _whitened(rgb, block, step, there), there & (low <= high)
        return _sharpened(whitened, *SHARPEN["document"], there), there
    return _band(rgb, name, levels, block, step, there), there


# images of a sorted stream


def _image(parts: list[pa.RecordBatch], lines: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes (3, lines, columns) of an image whose rows, in order, are the parts, and the places that are there, None for all."""
    table = pa.Table.from_batches(parts)
    y = table.column("y").to_numpy()
    if lines:
        rows = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in RGB]
        width = len(rows[0]) // max(len(y), 1)
        whole = (y == np.arange(len(y))).all() and all(len(x) == width for c in RGB for x in table.column(c).to_pylist())
    else:
        x = table.column("x").to_numpy()
        rows, width = [table.column(c).to_numpy().astype(np.uint8) for c in RGB], int(x.max()) + 1
        whole = len(x) % width == 0 and (y * width + x == np.arange(len(x))).all()
    if not whole:
        at = None if lines else y.astype(np.int64) * width + x
        if at is None or min(y.min(), x.min()) < 0 or (at[1:] <= at[:-1]).any():
            raise ValueError("an image is not a full rectangle from (0, 0)")
        # gaps hold the first pixel, so that they lie between the image's extremes
        there = np.zeros((int(y.max()) + 1) * width, bool)
        rgb = np.repeat(np.stack(rows)[:, :1], len(there), axis=1)
        rgb[:, at], there[at] = rows, True
        return rgb.reshape(3, -1, width), there.reshape(-1, width)
    return np.stack(rows).reshape(3, -1, width), None


def _sorted_images(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[list[tuple[object, list[str | None], np.ndarray, np.ndarray | None]]]:
    """(id, filters, bytes, places that are there) of the images of a stream sorted by image, some at a time."""
    held: list[pa.RecordBatch] = []
    ready, pixels = [], 0

    def done():
        own = held[0].column("filters")[0].as_py() if "filters" in held[0].schema.names else None
        return held[0].column("image_id")[0], own or [ORIGINAL], *_image(held, lines)

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("image_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = b.slice(i, j - i)
            if held and not held[0].column("image_id")[0].equals(part.column("image_id")[0]):
                ready.append(done())
                pixels += ready[-1][2][0].size
                held = []
                if pixels > STACK:
                    yield ready
                    ready, pixels = [], 0
            held.append(part)
    if held:
        ready.append(done())
    yield ready


def _ids(ids: list[pa.Scalar], times: int) -> pa.Array:
    return pa.array([i.as_py() for i in ids], ids[0].type).take(pa.array(np.repeat(np.arange(len(ids)), times)))


def as_lines(ids: list[pa.Scalar], rgb: np.ndarray) -> pa.RecordBatch:
    n, _, height, width = rgb.shape
    ends = pa.py_buffer(np.arange(0, n * height * width + 1, width, dtype=np.int32) if width else np.zeros(n * height + 1, np.int32))
    planes = [pa.Array.from_buffers(pa.binary(), n * height, [None, ends, pa.py_buffer(np.ascontiguousarray(rgb[:, c]).astype(np.uint8))]) for c in range(3)]
    return pa.record_batch([_ids(ids, height), pa.array(np.tile(np.arange(height, dtype=np.int32), n)), *planes], names=["image_id", "y", *RGB])


def as_pixels(ids: list[pa.Scalar], rgb: np.ndarray) -> pa.RecordBatch:
    n, _, height, width = rgb.shape
    y, x = np.divmod(np.tile(np.arange(height * width, dtype=np.int32), n), width)
    return pa.record_batch([_ids(ids, height * width), pa.array(y), pa.array(x), *(pa.array(rgb[:, c].reshape(-1).astype(np.int32)) for c in range(3))], names=["image_id", "y", "x", *RGB])


def _there(pixels: pa.RecordBatch, there: np.ndarray) -> pa.RecordBatch:
    """The pixels of an image that are there."""
    return pixels.filter(pa.array(there.reshape(-1)))


def is_lines(images: DataFrame) -> bool:
    return "x" not in images.columns


def _ordered(images: DataFrame) -> DataFrame:
    return images.sortWithinPartitions("image_id", "y", *([] if is_lines(images) else ["x"]))


def _by_image(images: DataFrame, schema: str, work: Callable, with_gaps: Callable | None = None) -> DataFrame:
    """``work(ids, filters, images of one shape)`` gives record batches; rows are already dealt out by image.

    ``with_gaps(id, filter, image, places that are there)`` does so for an image with gaps; without it one raises an error.
    """
    lines = is_lines(images)

    def run(batches):
        for some in _sorted_images(batches, lines):
            alike = defaultdict(list)
            for image_id, filters, rgb, there in some:
                if there is not None and not with_gaps:
                    raise ValueError("an image is not a full rectangle from (0, 0)")
                for name in filters:
                    if there is None:
                        alike[name, rgb.shape].append((image_id, rgb))
                    else:
                        yield with_gaps(image_id, name, rgb[None], there[None])
            for (name, _), own in alike.items():
                yield from work([i for i, _ in own], name, np.stack([rgb for _, rgb in own]))

    kind = StructType([images.schema["image_id"]]).simpleString()[len("struct<") : -1].replace("image_id:", "image_id ")
    return _ordered(images).mapInArrow(run, f"{kind}, {schema}")


def pack(grid: DataFrame) -> DataFrame:
    """Lines of a grid of pixel rows."""
    return _by_image(grid.repartition("image_id"), LINES, lambda ids, _, rgb: [as_lines(ids, rgb)])


def unpack(lines: DataFrame) -> DataFrame:
    """Pixel rows of lines: each line apart, no exchange."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(x) for x in b.column("r").to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            x = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            planes = [pa.array(np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).astype(np.int32)) for c in RGB]
            yield pa.record_batch([b.column("image_id").take(pa.array(row)), b.column("y").take(pa.array(row)), pa.array(x.astype(np.int32)), *planes], names=["image_id", "y", "x", *RGB])

    kind = StructType([lines.schema["image_id"]]).simpleString()[len("struct<") : -1].replace("image_id:", "image_id ")
    return lines.select("image_id", "y", *RGB).mapInArrow(run, f"{kind}, {PIXELS}")


def image_lines(images: DataFrame) -> DataFrame:
    """Lines of decoded images (``image_scan``): bytes are in blue, green, red order, a single channel is gray."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                order = (0, 0, 0) if row["nChannels"] == 1 else (2, 1, 0)
                yield as_lines([b.column("image_id")[i]], np.stack([pixels[:, :, c] for c in order])[None])

    named = images.filter("decoded").select(F.col("origin").alias("image_id"), "height", "width", "nChannels", "data")
    return named.mapInArrow(run, f"image_id string, {LINES}")


def _gaps(block: int, step: int) -> Callable:
    def work(image_id, name, rgb, there):
        done, kept = filtered_with_gaps(rgb, there, name, block, step)
        return _there(as_pixels([image_id], done), kept)

    return work


def apply_filter(images: DataFrame, name: str, block: int = 15, step: int = 3) -> DataFrame:
    """All images by one filter; lines give lines, pixel rows give pixel rows."""
    made, schema = (as_lines, LINES) if is_lines(images) else (as_pixels, PIXELS)
    return _by_image(images.repartition("image_id"), schema, lambda ids, _, rgb: [made(ids, filtered(rgb, name, block, step))], lambda i, _, *image: _gaps(block, step)(i, name, *image))


def apply_filters(images: DataFrame, image_manifest: DataFrame, block: int = 15, step: int = 3) -> DataFrame:
    """Each image by the filters that its manifest rows name, from its original pixels; others unchanged.

    Two exchanges: the images and the manifest, both by image.
    """
    made, schema = (as_lines, LINES) if is_lines(images) else (as_pixels, PIXELS)
    wanted = image_manifest.groupBy("image_id").agg(F.sort_array(F.collect_set(F.coalesce("filter", F.lit(ORIGINAL)))).alias("filters"))
    named = images.hint("merge").join(wanted, "image_id", "left")
    return _by_image(named, schema, lambda ids, name, rgb: [made(ids, filtered(rgb, name, block, step))], _gaps(block, step))


def local_stats(images: DataFrame, block: int = 15, step: int = 3) -> DataFrame:
    """image_id, y, x, r, g, b, l and total, low, high of the square sample around each pixel, band by band."""

    def work(ids, _, rgb):
        height = rgb.shape[2]
        for y in range(0, height, BAND):
            above, end = min(y, block), min(y + BAND, height)
            gray = luma(rgb[:, :, y - above : min(end + block, height)])
            own = slice(above, above + end - y)
            yield rows(ids, rgb[:, :, y:end], y, [s[:, own] for s in (gray, *sampled(gray, block, step))])

    def rows(ids, rgb, y, stats):
        pixels = as_pixels(ids, rgb)
        places = pa.array(pixels.column("y").to_numpy() + np.int32(y))
        columns = [pixels.column("image_id"), places, *(pixels.column(c) for c in ("x", *RGB))]
        return pa.record_batch([*columns, *(pa.array(s.reshape(-1).astype(t)) for s, t in zip(stats, (np.int32, np.int64, np.int32, np.int32), strict=True))], names=["image_id", "y", "x", *RGB, "l", "total", "low", "high"])

    def with_gaps(image_id, _, rgb, there):
        gray = luma(rgb)
        total, low, high = sampled(gray, block, step, there)
        return _there(rows([image_id], rgb, 0, [gray, total, low, high]), there & (low <= high))

    return _by_image(images.repartition("image_id"), f"{PIXELS}, l int, total long, low int, high int", work, with_gaps)
