"""Page-image operators on a pixel grid: image_id, y, x, r, g, b (0 to 255).

Every operator works on all images at once. ``by_image`` deals the grid out by
image; windows over an image's rows and columns then reuse that partitioning,
so a chain of filters shuffles its pixels once. All steps store whole numbers,
truncated and clamped. Grids are full rectangles from (0, 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
#: Sharpening kernels in tenths (centre, side).
SHARPEN = {"auto": (30, 5), "grayscale": (30, 5), "document": (42, 8), "magic": (50, 10)}
#: Contrast levels.
CONTRAST = {"auto": 115, "magic": 140, "grayscale": 125}
#: Aspect presets, width over height.
PRESETS = {"A4": (210, 297), "Letter": (85, 110), "Legal": (85, 140), "A5": (148, 210), "1:1": (1, 1), "4:3": (4, 3), "3:2": (3, 2)}
FILTERS = ("auto", "document", "magicColor", "blackWhite", "grayscale")


def _div(a: Column, b: int | Column) -> Column:
    """Whole quotient, truncated."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")


def by_image(grid: DataFrame) -> DataFrame:
    return grid.repartition("image_id")


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return _div(299 * F.col(r) + 587 * F.col(g) + 114 * F.col(b), 1000).cast("int")


def contrast_table(level: int) -> list[int]:
    k = (level / 100) ** 2
    return [int(min(255.0, max(0.0, ((v / 255 - 0.5) * k + 0.5) * 255))) for v in range(256)]


def brightness_table(brightness: float, gamma: float = 1.0) -> list[int]:
    return [int(255 * min(1.0, v / 255 * brightness) ** gamma) for v in range(256)]


def _looked_up(grid: DataFrame, table: list[int]) -> DataFrame:
    values = F.array(*[F.lit(v) for v in table])
    return grid.withColumns({c: F.get(values, F.col(c)) for c in RGB})


def img_grayscale(grid: DataFrame) -> DataFrame:
    return grid.select("image_id", "y", "x", luma().alias("r"), luma().alias("g"), luma().alias("b"))


def image_minmax(grid: DataFrame) -> DataFrame:
    return grid.groupBy("image_id").agg(F.min(F.least(*RGB)).alias("mn"), F.max(F.greatest(*RGB)).alias("mx"))


def _stretched(c: Column, mn: Column, mx: Column) -> Column:
    """The value between the extremes, from 0 to 255; flat images stay."""
    return F.when(mx > mn, _div((c - mn) * 255, F.greatest(F.lit(1), mx - mn)).cast("int")).otherwise(c)


def img_normalize(grid: DataFrame) -> DataFrame:
    """Stretch each image's values to 0..255; flat images stay.

    The extremes are summed on the map side, one row each task and image, and
    joined back; where the grid is dealt by image neither shuffles again.
    """
    ranged = grid.join(image_minmax(grid), "image_id")
    return ranged.select("image_id", "y", "x", *[_stretched(F.col(c), F.col("mn"), F.col("mx")).alias(c) for c in RGB])


def img_contrast(grid: DataFrame, level: int) -> DataFrame:
    return _looked_up(grid, contrast_table(level))


def _saturated(c: str, tenths: int = 12) -> Column:
    return _byte(F.col("l") + _div((F.col(c) - F.col("l")) * tenths, 10))


def img_saturation(grid: DataFrame, tenths: int = 12) -> DataFrame:
    return grid.withColumn("l", luma()).select("image_id", "y", "x", *[_saturated(c, tenths).alias(c) for c in RGB])


def img_brightness(grid: DataFrame, brightness: float, gamma: float = 1.0) -> DataFrame:
    return _looked_up(grid, brightness_table(brightness, gamma))


def img_color(grid: DataFrame) -> DataFrame:
    """Saturation 1.2, then brightness 1.08 with gamma 0.9."""
    return img_brightness(img_saturation(grid), 1.08, 0.9)


def _row():
    return W.partitionBy("image_id", "y").orderBy("x")


def _column():
    return W.partitionBy("image_id", "x").orderBy("y")


def img_sharpen(grid: DataFrame, center: int | Column, side: int | Column) -> DataFrame:
    """3 x 3 cross in tenths; at the edges a pixel stands in for its missing neighbour."""
    around = {}
    for c in RGB:
        around[f"{c}_row"] = F.lag(c).over(_row()), F.lead(c).over(_row())
        around[f"{c}_col"] = F.lag(c).over(_column()), F.lead(c).over(_column())
    summed = grid.withColumns({f"{c}_row": sum(F.coalesce(x, F.col(c)) for x in around[f"{c}_row"]) for c in RGB})
    summed = summed.withColumns({f"{c}_col": sum(F.coalesce(x, F.col(c)) for x in around[f"{c}_col"]) for c in RGB})
    return summed.select("image_id", "y", "x", *[_byte(_div(center * F.col(c) - side * (F.col(f"{c}_row") + F.col(f"{c}_col")), 10)).alias(c) for c in RGB])


def local_stats(grid: DataFrame, block: int = 15, step: int = 3) -> DataFrame:
    """luma, and total, least and greatest luma of a square sample around each pixel.

    Offsets run from -block to block by step, coordinates are clamped to the
    image. Clamping acts on x and y apart, so rows are combined first and then
    columns: 2 n samples rather than n * n.
    """
    offsets = range(-block, block + 1, step)

    def shifted(c: str, along, o: int) -> Column:
        whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        if o == 0:
            return F.col(c)
        return F.coalesce(F.lag(c, -o).over(along), F.first(c).over(whole)) if o < 0 else F.coalesce(F.lead(c, o).over(along), F.last(c).over(whole))

    def combined(c: tuple[str, str, str], along) -> list[Column]:
        total, low, high = ([shifted(x, along, o) for o in offsets] for x in c)
        return [sum(total[1:], total[0]), F.least(*low), F.greatest(*high)]

    lum = grid.withColumn("l", luma())
    total, low, high = combined(("l", "l", "l"), _row())
    rows = lum.withColumns({"rt": total, "rl": low, "rh": high})
    total, low, high = combined(("rt", "rl", "rh"), _column())
    return rows.select("image_id", "y", "x", *RGB, "l", total.alias("total"), low.alias("low"), high.alias("high"))


def img_document(grid: DataFrame, block: int = 15, step: int = 3) -> DataFrame:
    """Whiten paper and keep ink by local contrast and threshold, then sharpen."""
    # fixed values: the shares, bounds and offsets below
    n = len(range(-block, block + 1, step)) ** 2
    stats = local_stats(grid, block, step)
    lum = F.col("l").cast("double")
    mean = F.col("total").cast("double") / F.lit(float(n))
    contrast = (F.col("high") - F.col("low")).cast("double") / F.lit(255.0)
    stats = stats.withColumns({"lum": lum, "threshold": mean * F.lit(0.85) - F.lit(8.0), "contrast": contrast})
    lum, threshold = F.col("lum"), F.col("threshold")

    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        ink = v * (F.lit(0.3) + lum / F.lit(255.0) * F.lit(0.4))
        paper_f = F.lit(0.3) + (lum - threshold) / (F.lit(255.0) - threshold) * F.lit(0.7)
        paper = F.lit(255.0) - (F.lit(255.0) - v) * (F.lit(1.0) - paper_f)
        ink = F.least(F.lit(80.0), F.greatest(F.lit(0.0), ink)).cast("int")
        paper = F.least(F.lit(255.0), F.greatest(F.lit(240.0), paper)).cast("int")
        return F.when(F.col("contrast") < 0.15, 255).when(lum < threshold, ink).otherwise(paper)

    return img_sharpen(stats.select("image_id", "y", "x", *[value(c).alias(c) for c in RGB]), *SHARPEN["document"])


def image_histogram(grid: DataFrame) -> DataFrame:
    """image_id, level, n: luma levels that occur."""
    return grid.groupBy("image_id", luma().alias("level")).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(histogram: DataFrame) -> DataFrame:
    """Level of the largest between-class variance, the first of equal ones; 128 if there is no split; then 0.9 of it."""
    below = W.partitionBy("image_id").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy("image_id")
    weighed = F.col("n") * F.col("level")
    h = histogram.select("image_id", "level", F.sum("n").over(below).alias("wb"), F.sum(weighed).over(below).alias("sb"), F.sum("n").over(own).alias("all_n"), F.sum(weighed).over(own).alias("all_s"))
    wf = F.col("all_n") - F.col("wb")
    apart = F.col("sb").cast("double") / F.col("wb") - (F.col("all_s") - F.col("sb")).cast("double") / F.nullif(wf, F.lit(0))
    h = h.withColumn("v", F.when(wf > 0, (F.col("wb") * wf).cast("double") * apart * apart))
    best = h.groupBy("image_id").agg(F.max(F.when(F.col("v") > 0, F.struct("v", (-F.col("level")).alias("lower")))).alias("top"))
    return best.select("image_id", (F.coalesce(-F.col("top.lower"), F.lit(128)).cast("double") * F.lit(0.9)).cast("int").alias("threshold"))


def black_white_levels(grid: DataFrame) -> DataFrame:
    """image_id, mn, mx, threshold: the extremes of luma and Otsu's threshold of the stretched luma, all from one histogram."""
    levels = image_histogram(grid)
    ends = levels.groupBy("image_id").agg(F.min("level").alias("mn"), F.max("level").alias("mx"))
    stretched = levels.join(ends, "image_id").groupBy("image_id", "mn", "mx", _stretched(F.col("level"), F.col("mn"), F.col("mx")).alias("level")).agg(F.sum("n").alias("n"))
    return ends.join(otsu_threshold(stretched), "image_id")


def _soft_step(g: Column, t: Column) -> Column:
    """Black below, white above, and 20 levels to each side between them."""
    return F.when(g < t - 20, 0).when(g > t + 20, 255).otherwise(_byte(_div((g - (t - 20)) * 255, 40))).cast("int")


def img_black_white(grid: DataFrame) -> DataFrame:
    """Grayscale, stretch, Otsu's threshold, then a soft step of 20 levels to each side."""
    v = _soft_step(_stretched(luma(), F.col("mn"), F.col("mx")), F.col("threshold"))
    return grid.join(black_white_levels(grid), "image_id").select("image_id", "y", "x", *[v.alias(c) for c in RGB])


def img_grayscale_clean(grid: DataFrame) -> DataFrame:
    gray = img_contrast(img_normalize(img_grayscale(grid)), CONTRAST["grayscale"])
    return img_sharpen(img_brightness(gray, 1.05), *SHARPEN["grayscale"])


def img_auto(grid: DataFrame) -> DataFrame:
    return img_sharpen(img_contrast(img_normalize(grid), CONTRAST["auto"]), *SHARPEN["auto"])


def img_magic_color(grid: DataFrame) -> DataFrame:
    vivid = img_contrast(img_saturation(img_normalize(grid)), CONTRAST["magic"])
    return img_sharpen(img_brightness(vivid, 1.08, 0.9), *SHARPEN["magic"])


PIPELINES = {"auto": img_auto, "document": img_document, "magicColor": img_magic_color, "blackWhite": img_black_white, "grayscale": img_grayscale_clean}


def _tables(levels: list[tuple[str, list[int]]], name: Column, c: Column) -> Column:
    """The value by the table of the row's filter, as it is for others."""
    out = c
    for own, table in levels:
        out = F.when(name == own, F.get(F.array(*[F.lit(v) for v in table]), c)).otherwise(out)
    return out


def apply_filters(grid: DataFrame, image_manifest: DataFrame) -> DataFrame:
    """Each image by the filter its manifest row names, from its original pixels; others unchanged.

    The grid is dealt by image once. All filters but the document one are one
    chain, in which each step takes the filter from a column: levels (one row an
    image) are joined, colours mapped, and the cross sharpens by factors of the
    filter. The document filter has windows of its own.
    """
    named = by_image(grid).join(image_manifest.select("image_id", "filter").distinct(), "image_id", "left")
    name = F.col("filter")
    rest = named.filter(name.isNull() | (name != "document"))
    gray = name.isin("blackWhite", "grayscale")
    based = rest.select("image_id", "y", "x", F.when(name.isin(*FILTERS), name).alias("filter"), *[F.when(gray, luma()).otherwise(F.col(c)).alias(c) for c in RGB])
    cuts = black_white_levels(rest.filter(name == "blackWhite")).select("image_id", "threshold")
    levels = image_minmax(based.filter("filter IS NOT NULL")).join(cuts, "image_id", "left")
    ranged = based.join(levels, "image_id", "left")
    ranged = ranged.select("image_id", "y", "x", "filter", "threshold", *[F.when(name.isNull(), F.col(c)).otherwise(_stretched(F.col(c), F.col("mn"), F.col("mx"))).alias(c) for c in RGB])
    vivid = ranged.withColumn("l", luma())
    vivid = vivid.withColumns({c: F.when(name == "magicColor", _saturated(c)).otherwise(F.col(c)) for c in RGB})
    contrast = [("auto", contrast_table(CONTRAST["auto"])), ("magicColor", contrast_table(CONTRAST["magic"])), ("grayscale", contrast_table(CONTRAST["grayscale"]))]
    bright = [("magicColor", brightness_table(1.08, 0.9)), ("grayscale", brightness_table(1.05))]
    mapped = vivid.withColumns({c: _tables(contrast, name, F.col(c)) for c in RGB}).withColumns({c: _tables(bright, name, F.col(c)) for c in RGB})
    mapped = mapped.withColumns({c: F.when(name == "blackWhite", _soft_step(F.col(c), F.col("threshold"))).otherwise(F.col(c)) for c in RGB})
    factor = lambda k: F.when(name == "auto", SHARPEN["auto"][k]).when(name == "magicColor", SHARPEN["magic"][k]).when(name == "grayscale", SHARPEN["grayscale"][k]).otherwise((10, 0)[k])
    done = img_sharpen(mapped.withColumns({"center": factor(0), "side": factor(1)}), F.col("center"), F.col("side"))
    return done.unionByName(img_document(named.filter(name == "document").select(*grid.columns)))


def preset_boxes(grid: DataFrame, presets: DataFrame) -> DataFrame:
    """Largest centred box of a preset's shape; ``presets`` has image_id and preset ('Free': the whole image)."""
    size = grid.groupBy("image_id").agg((F.max("x") + 1).alias("iw"), (F.max("y") + 1).alias("ih"))
    known = F.create_map(*[y for k, (w, h) in PRESETS.items() for y in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))])
    shaped = size.join(presets, "image_id").withColumn("p", F.try_element_at(known, F.col("preset")))
    wide = F.col("iw") * F.col("p.h") > F.col("ih") * F.col("p.w")
    w = F.when(F.col("p").isNull() | ~wide, F.col("iw")).otherwise(_div(F.col("ih") * F.col("p.w"), F.col("p.h")))
    h = F.when(F.col("p").isNull() | wide, F.col("ih")).otherwise(_div(F.col("iw") * F.col("p.h"), F.col("p.w")))
    boxed = shaped.withColumns({"w": F.greatest(F.lit(1), w).cast("int"), "h": F.greatest(F.lit(1), h).cast("int")})
    return boxed.select("image_id", _div(F.col("iw") - F.col("w"), 2).cast("int").alias("x0"), _div(F.col("ih") - F.col("h"), 2).cast("int").alias("y0"), "w", "h")


def crop(grid: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keep each image's box, rebased to (0, 0)."""
    inside = grid.join(boxes, "image_id").filter("x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h")
    return inside.select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *RGB)
