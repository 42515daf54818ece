"""Tables that the registered queries derive from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTER_NAMES = ["original", "auto", "document", "magicColor", "blackWhite", "grayscale"]
RANGE_TEXTS = [("", ""), ("2", ""), ("0", "99"), ("x", "3"), ("5", "2"), ("1", "1"), ("99999999999", ""), ("1", "3000000000"), ("-3000000000", "2"), ("99999999999999999999", "2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_conv(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), F.col("text").alias("content"))


def counts_conv(spark, d) -> DataFrame:
    return pages_conv(spark, d).groupBy("doc_id").agg(F.count("page_no").alias("page_count"))


def manifest(spark, d) -> DataFrame:
    """Three documents a batch; each eleventh batch also names one that does not exist."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    known = ids.select(F.floor(F.col("conv_id") / 3).alias("batch_id"), (F.col("conv_id") % 3).cast("int").alias("position"), F.col("conv_id").alias("doc_id"))
    return known.unionByName(ids.filter("conv_id % 33 = 0").select(F.floor(F.col("conv_id") / 3).alias("batch_id"), F.lit(3).alias("position"), (-1 - F.col("conv_id")).alias("doc_id")))


def ranges(spark, d) -> DataFrame:
    n = F.col("page_count").cast("int")
    each = F.array(*[F.struct(F.lit(i).alias("range_ord"), a.alias("start"), b.alias("end")) for i, (a, b) in enumerate([(F.lit(1), F.lit(2)), (F.lit(2), n), (n, n + 1)], 1)])
    return counts_conv(spark, d).select("doc_id", F.explode(each).alias("r")).select("doc_id", "r.*")


def range_text(spark, d) -> DataFrame:
    k = F.col("doc_id") % len(RANGE_TEXTS)
    pick = lambda j: F.get(F.array(*[F.lit(t[j]) for t in RANGE_TEXTS]), k.cast("int"))
    return counts_conv(spark, d).select("doc_id", F.col("page_count").cast("int").alias("page_count"), pick(0).alias("from_txt"), pick(1).alias("to_txt"))


def selection(spark, d) -> DataFrame:
    n = F.col("page_count").cast("int")
    back = F.transform(F.sequence(F.lit(1), n), lambda i: n - i)
    picks = F.concat(back, F.array(F.lit(0)), F.when(F.col("doc_id") % 10 == 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    return counts_conv(spark, d).select("doc_id", F.posexplode(picks).alias("sel_ord", "page_idx"))


def catalog(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return t.select("doc_id", path.alias("path"), F.col("n_chars").alias("file_size"), (F.col("doc_id") % 97 == 0).alias("is_loading"), (F.col("doc_id") % 40).alias("page_count"))


def page_dims(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return t.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("page_no"), F.col("l_quantity").alias("width"), (F.col("l_extendedprice") / 1000).alias("height"))


def grid(spark, d) -> DataFrame:
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") + 1) * 127.5))).cast("int")
    side = F.lit(8)
    t = t.withColumn("v", v)
    return t.select("image_id", F.call_function("div", F.col("i"), side).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").alias("r"), (255 - F.col("v")).alias("g"), ((F.col("v") + 85) % 256).alias("b"))


def wide_grid(spark, d) -> DataFrame:
    """Sixteen of the grids side by side: 32 pixels in a row, more than a local block reaches."""
    k, many = F.col("image_id"), F.lit(16).cast("long")
    return grid(spark, d).select(F.call_function("div", k, many).alias("image_id"), (F.call_function("div", k % 16, F.lit(4).cast("long")) * 8 + F.col("y")).cast("int").alias("y"), (k % 4 * 8 + F.col("x")).cast("int").alias("x"), "r", "g", "b")


def images(spark, d) -> DataFrame:
    """Images by id; each seventh can't be decoded, each thirteenth is missing."""
    return table(spark, d, "embeddings").filter("vec_id % 13 <> 0").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 7 != 0).alias("decoded"))


def image_manifest(spark, d) -> DataFrame:
    t = table(spark, d, "embeddings")
    names = F.array(*[F.lit(x) for x in FILTER_NAMES])
    return t.select(F.floor(F.col("vec_id") / 5).alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("position"), F.col("vec_id").alias("image_id"), F.get(names, (F.col("vec_id") % 6).cast("int")).alias("filter"))


def requests(spark, d) -> DataFrame:
    return as_requests(table(spark, d, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    i = F.col("event_id").cast("string")
    named = F.when(F.col("event_id") % 10 == 0, "My%20File+%C3%A9").otherwise("")
    uris = [F.concat(F.lit("file:///d/"), named, i, F.lit(".pdf")), F.concat(F.lit("content://p/"), i), F.concat(F.lit("https://h/"), i, F.lit(".PDF")), F.concat(F.lit("https://h/"), i, F.lit(".html"))]
    uri = F.get(F.array(*uris, F.lit(None).cast("string")), (F.col("event_id") % 5).cast("int"))
    alias = F.get(F.array(F.lit("View"), F.lit("Merge"), F.lit("Split"), F.lit("Other")), (F.col("event_id") % 4).cast("int"))
    return events.select(F.col("event_id").alias("request_id"), "ts", "user_id", uri.alias("uri"), alias.alias("alias"))


def _case(k: str, values: list[str]) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: name: SQL of the same tables
SQL = {
    "pages_conv": "SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, text AS content FROM conversations",
    "counts_conv": "SELECT doc_id, count(page_no) AS page_count FROM pages_conv GROUP BY doc_id",
    "manifest": "SELECT DISTINCT conv_id // 3 AS batch_id, (conv_id % 3)::INT AS position, conv_id AS doc_id FROM conversations UNION ALL SELECT DISTINCT conv_id // 3, 3, -1 - conv_id FROM conversations WHERE conv_id % 33 = 0",
    "ranges": "SELECT doc_id, 1 AS range_ord, 1 AS \"start\", 2 AS \"end\" FROM counts_conv UNION ALL SELECT doc_id, 2, 2, page_count::INT FROM counts_conv UNION ALL SELECT doc_id, 3, page_count::INT, page_count::INT + 1 FROM counts_conv",
    "range_text": f"SELECT doc_id, page_count::INT AS page_count, {_case(f'doc_id % {len(RANGE_TEXTS)}', [a for a, _ in RANGE_TEXTS])} AS from_txt, {_case(f'doc_id % {len(RANGE_TEXTS)}', [b for _, b in RANGE_TEXTS])} AS to_txt FROM counts_conv",
    "selection": "SELECT doc_id, (u.i - 1)::INT AS sel_ord, u.v AS page_idx FROM (SELECT doc_id, list_concat([page_count::INT - i::INT for i in range(1, page_count + 1)], [0], CASE WHEN doc_id % 10 = 0 THEN [page_count::INT] ELSE [] END) AS picks FROM counts_conv), LATERAL (SELECT unnest(picks) AS v, generate_subscripts(picks, 1) AS i) AS u",
    "catalog": "SELECT doc_id, '/corpus/' || source || '/doc_' || doc_id || '.pdf' AS path, n_chars AS file_size, doc_id % 97 = 0 AS is_loading, doc_id % 40 AS page_count FROM documents",
    "page_dims": "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity)::INT AS page_no, l_quantity AS width, l_extendedprice / 1000 AS height FROM lineitem",
    "grid": "SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, v AS r, 255 - v AS g, (v + 85) % 256 AS b FROM (SELECT vec_id, i, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (e::DOUBLE + 1) * 127.5::DOUBLE)))::INT AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))",
    "wide_grid": "SELECT image_id // 16 AS image_id, (image_id % 16 // 4 * 8 + y)::INT AS y, (image_id % 4 * 8 + x)::INT AS x, r, g, b FROM grid",
    "images": "SELECT vec_id AS image_id, vec_id % 7 <> 0 AS decoded FROM embeddings WHERE vec_id % 13 <> 0",
    "image_manifest": f"SELECT vec_id // 5 AS doc_id, (vec_id % 5)::INT AS position, vec_id AS image_id, {_case('vec_id % 6', FILTER_NAMES)} AS filter FROM embeddings",
    "requests": "SELECT event_id AS request_id, ts, user_id, CASE event_id % 5 WHEN 0 THEN 'file:///d/' || CASE WHEN event_id % 10 = 0 THEN 'My%20File+%C3%A9' ELSE '' END || event_id || '.pdf' WHEN 1 THEN 'content://p/' || event_id WHEN 2 THEN 'https://h/' || event_id || '.PDF' WHEN 3 THEN 'https://h/' || event_id || '.html' END AS uri, " + _case("event_id % 4", ["View", "Merge", "Split", "Other"]) + " AS alias FROM events",
}
