"""The registered page, image, scalar and stream queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import grid as G
from quire.operators import pages as P
from quire.operators import raster as R
from quire.plans import fixtures as X
from quire.sources.files import catalog_scan as scan_catalog
from quire.sources.files import shared_folder
from quire.streaming import events as E

QUERIES, ORACLE_SQL = {}, {}


def _with(sql: str, names: str = "", **more: str) -> str:
    """SQL over fixtures by name, and over further named parts."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in X.SQL:
            if other != name and other in X.SQL[name]:
                add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({X.SQL[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# sources and sinks


@query("SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, false AS loading FROM documents GROUP BY source")
def catalog_scan(spark, d):
    """The catalogue of a folder of files, into which Spark has written each source's texts: bytes by source.

    The files lie in the session's folder, which ``clear_shared`` deletes.
    """
    folder = shared_folder(spark, "texts")
    X.table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(folder)
    found = scan_catalog(spark, folder, "*.txt")
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("file_size").alias("n_bytes"), F.bool_or("is_loading").alias("loading"))


@query("SELECT doc_id, u.i::INT AS page_no, u.c AS content FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i) AS u")
def paginate(spark, d):
    return P.paginate(X.table(spark, d, "documents"))


MERGED = """SELECT m.batch_id, m.position, m.doc_id, p.page_no, p.content, row_number() OVER (PARTITION BY m.batch_id ORDER BY m.position, p.page_no)::INT AS out_page_no
FROM manifest m JOIN pages_conv p USING (doc_id) WHERE m.batch_id IN (SELECT batch_id FROM manifest GROUP BY batch_id HAVING count(*) >= 2 AND bool_and(doc_id IN (SELECT doc_id FROM pages_conv)))"""


@query(_with("SELECT batch_id, count(*)::INT AS n_pages, string_agg(coalesce(content, ''), chr(12) ORDER BY out_page_no) AS artifact FROM merged GROUP BY batch_id", "manifest pages_conv", merged=MERGED))
def assemble(spark, d):
    return P.assemble(P.merge_documents(X.manifest(spark, d), X.pages_conv(spark, d)))


@query(
    _with(
        """SELECT o.batch_id, k AS part, (SELECT max(out_page_no) FROM placed p WHERE p.batch_id = o.batch_id AND p.at <= k * 300) AS first_page, octet_length(encode(substr(artifact, (k * 300 + 1)::BIGINT, 300))) AS n_bytes, substr(artifact, (k * 300 + 1)::BIGINT, 300) AS content
FROM (SELECT *, unnest(range(0, (length(artifact) + 299) // 300)) AS k FROM whole) o""",
        "manifest pages_conv",
        merged=MERGED,
        placed="SELECT batch_id, out_page_no, coalesce(sum(length(coalesce(content, '')) + 1) OVER (PARTITION BY batch_id ORDER BY out_page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM merged",
        whole="SELECT batch_id, string_agg(coalesce(content, ''), chr(12) ORDER BY out_page_no) AS artifact FROM merged GROUP BY batch_id",
    )
)
def assemble_parts(spark, d):
    return P.assemble_parts(P.merge_documents(X.manifest(spark, d), X.pages_conv(spark, d)), part_chars=300)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN '/out/' || CASE WHEN source = 'src0' THEN 'Documents' ELSE 'Downloads' END || '/'
       || CASE doc_id % 5 WHEN 0 THEN 'merged_' || (doc_id % 9 + 1) WHEN 1 THEN 'scanned' WHEN 2 THEN 'split_' || (doc_id % 9 + 1) WHEN 3 THEN 'page_' || (doc_id % 9 + 1) ELSE 'extracted' END
       || '_1700000000000.pdf' END AS path FROM documents"""
)
def output_path(spark, d):
    t = X.table(spark, d, "documents")
    op = F.get(F.array(*[F.lit(x) for x in ("merge", "scan", "split_range", "split_all", "extract")]), (F.col("doc_id") % 5).cast("int"))
    location = F.when(F.col("source") == "src0", "Documents").otherwise("documents")
    path = S.save_path("/out", location, S.output_prefix(op, F.col("doc_id") % 9 + 1), F.lit(1700000000000), F.col("doc_id") % 7 != 0)
    return t.select("doc_id", path.alias("path"))


@query(
    _with(
        """SELECT 'merge' AS op, batch_id::VARCHAR AS request, CASE WHEN count(*) < 2 THEN 'too_few_inputs' ELSE 'missing_doc' END AS reason FROM manifest
GROUP BY batch_id HAVING count(*) < 2 OR NOT bool_and(doc_id IN (SELECT doc_id FROM counts_conv))
UNION ALL SELECT 'split_range', doc_id || '/' || range_ord, 'bad_range' FROM ranges JOIN counts_conv USING (doc_id) WHERE NOT ("start" >= 1 AND "end" <= page_count AND "start" <= "end")
UNION ALL SELECT DISTINCT 'extract', doc_id::VARCHAR, 'index_out_of_range' FROM selection JOIN counts_conv USING (doc_id) WHERE page_idx < 0 OR page_idx >= page_count""",
        "manifest ranges selection",
    )
)
def reject_report(spark, d):
    return P.reject_report(X.manifest(spark, d), X.ranges(spark, d), X.selection(spark, d), X.counts_conv(spark, d))


# scalar functions


@query("SELECT page_id, list_extract(regexp_split_to_array(url, '[/\\\\]'), -1) AS name FROM pages")
def base_name(spark, d):
    return X.table(spark, d, "pages").select("page_id", S.base_name(F.col("url")).alias("name"))


TITLE = """CASE WHEN bare = '' OR (bare = name AND starts_with(name, 'intent_')) OR bare = 'opened.pdf' THEN 'View PDF' ELSE bare END"""


@query(
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[^/]*$', 'intent_' || page_id || '_\\0.pdf') WHEN page_id % 3 = 1 THEN url ELSE regexp_replace(url, '[^/]*$', 'intent_\\0') END AS path FROM pages),
n AS (SELECT page_id, list_extract(regexp_split_to_array(path, '[/\\\\]'), -1) AS name FROM p),
b AS (SELECT page_id, name, regexp_replace(name, '^intent_[0-9]+_', '') AS bare FROM n) SELECT page_id, {TITLE} AS title FROM b"""
)
def display_title(spark, d):
    t, i = X.table(spark, d, "pages"), F.col("page_id")
    last, base = F.regexp_extract("url", "([^/]*)$", 1), F.regexp_extract("url", "^(?s)(.*?)[^/]*$", 1)
    staged = F.concat(base, F.lit("intent_"), i.cast("string"), F.lit("_"), last, F.lit(".pdf"))
    path = F.when(i % 3 == 0, staged).when(i % 3 == 1, F.col("url")).otherwise(F.concat(base, F.lit("intent_"), last))
    return t.select("page_id", S.display_title(path).alias("title"))


def _tenths(n: int, unit: str) -> str:
    t = f"((20 * s + {n}) // {2 * n})"
    return f"({t} // 10)::VARCHAR || '.' || ({t} % 10)::VARCHAR || ' {unit}'"


@query(
    f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (n_chars - 20) * (doc_id % 13) * (doc_id % 13) * (doc_id % 17) * (doc_id % 17) END AS s FROM documents)
SELECT doc_id, CASE WHEN s IS NULL OR s <= 0 THEN '0 B' WHEN s >= {1024**3} THEN {_tenths(1024**3, "GB")} WHEN s >= {1024**2} THEN {_tenths(1024**2, "MB")} WHEN s >= 1024 THEN {_tenths(1024, "KB")} ELSE s::VARCHAR || ' B' END AS size FROM f"""
)
def format_file_size(spark, d):
    m, k = F.col("doc_id") % 13, F.col("doc_id") % 17
    size = F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") - 20) * m * m * k * k)
    return X.table(spark, d, "documents").select("doc_id", S.format_file_size(size).alias("size"))


@query(
    """WITH l AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, CASE p_size % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Maximum' END AS level FROM part)
SELECT p_partkey, CASE level WHEN 'Low' THEN 50 WHEN 'Medium' THEN 70 WHEN 'Maximum' THEN 100 ELSE 85 END AS quality FROM (SELECT p_partkey, coalesce(level, a) AS level FROM l)"""
)
def quality_to_jpeg(spark, d):
    known = F.get(F.array(*[F.lit(x) for x in S.QUALITY]), (F.col("p_size") % 5).cast("int"))
    level = F.coalesce(known, F.get(F.split("p_name", " "), F.lit(0)))
    return X.table(spark, d, "part").select("p_partkey", S.quality_to_jpeg(level).alias("quality"))


PDF_URI = "coalesce(contains(lower(uri), '.pdf') OR starts_with(lower(uri), 'content://') OR starts_with(lower(uri), 'file://'), false)"


@query(_with(f"SELECT request_id, {PDF_URI} AS is_pdf FROM requests", "requests"))
def is_pdf_uri(spark, d):
    return X.requests(spark, d).select("request_id", S.is_pdf_uri(F.col("uri")).alias("is_pdf"))


RESOLVED = """CASE WHEN starts_with(uri, 'file:') THEN url_decode(replace(regexp_extract(uri, '^file:(?://[^/?#]*)?([^?#]*)', 1), '+', '%2B'))
WHEN starts_with(uri, 'content:') THEN 'intent_0_' || CASE WHEN suffix(lower(regexp_extract(uri, '([^/]*)$', 1)), '.pdf') THEN regexp_extract(uri, '([^/]*)$', 1) ELSE regexp_extract(uri, '([^/]*)$', 1) || '.pdf' END END"""


@query(_with(f"SELECT request_id, {RESOLVED} AS path FROM requests", "requests"))
def resolve_uri(spark, d):
    name = F.regexp_extract("uri", r"([^/]*)$", 1)
    return X.requests(spark, d).select("request_id", S.resolve_uri(F.col("uri"), name, F.lit(0)).alias("path"))


@query(
    """WITH n AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN name || '.PDF' WHEN page_id % 4 = 1 THEN name || '.pdf' WHEN page_id % 4 = 2 THEN name END AS name
FROM (SELECT page_id, list_extract(regexp_split_to_array(url, '[/\\\\]'), -1) AS name FROM pages))
SELECT page_id, CASE WHEN name IS NULL THEN 'opened.pdf' WHEN suffix(lower(name), '.pdf') THEN name ELSE name || '.pdf' END AS name FROM n"""
)
def ensure_pdf_name(spark, d):
    k, name = F.col("page_id") % 4, S.base_name(F.col("url"))
    shown = F.when(k == 0, F.concat(name, F.lit(".PDF"))).when(k == 1, F.concat(name, F.lit(".pdf"))).when(k == 2, name)
    return X.table(spark, d, "pages").select("page_id", S.ensure_pdf_name(shown).alias("name"))


FROM, TO = "coalesce(try_cast(from_txt AS BIGINT), 1)", "coalesce(try_cast(to_txt AS BIGINT), page_count)"


@query(_with("SELECT doc_id, a::INT AS \"start\", b::INT AS \"end\" FROM r WHERE a <= b", "range_text", r=f"SELECT doc_id, greatest(1, least({FROM}, page_count)) AS a, greatest(1, least({TO}, page_count)) AS b FROM range_text"))
def parse_range_lenient(spark, d):
    r = S.parse_range_lenient(F.col("from_txt"), F.col("to_txt"), F.col("page_count"))
    return X.range_text(spark, d).select("doc_id", r.alias("r")).filter("r IS NOT NULL").select("doc_id", "r.*")


@query(_with("SELECT doc_id, a::INT AS \"start\", b::INT AS \"end\" FROM r WHERE a >= 1 AND b <= page_count AND a <= b", "range_text", r=f"SELECT doc_id, page_count, {FROM} AS a, {TO} AS b FROM range_text"))
def parse_range_strict(spark, d):
    r = S.parse_range_strict(F.col("from_txt"), F.col("to_txt"), F.col("page_count"))
    return X.range_text(spark, d).select("doc_id", r.alias("r")).filter("r IS NOT NULL").select("doc_id", "r.*")


@query("SELECT doc_id, CASE WHEN n < 30 THEN 'pick' ELSE coalesce(CASE WHEN doc_id % 2 = 0 THEN 'all' END, 'range') END AS mode FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def split_mode(spark, d):
    n = F.size(F.split("text", "\n"))
    return X.table(spark, d, "documents").select("doc_id", S.split_mode(n, F.when(F.col("doc_id") % 2 == 0, "all")).alias("mode"))


@query(
    _with(
        "SELECT doc_id, page_no, greatest(350, least(1500, floor(width * 20 + 0.5)))::INT AS w, greatest(350, least(1700, floor(height * 30 + 0.5)))::INT AS h, greatest(280, least(1100, floor(width * 20 + 0.5)))::INT AS small_w, greatest(280, least(1500, floor(height * 30 + 0.5)))::INT AS small_h, greatest(280, least(1600, floor(width * 20 + 0.5)))::INT AS pick_w, greatest(280, least(1700, floor(height * 30 + 0.5)))::INT AS pick_h FROM page_dims",
        "page_dims",
    )
)
def preview_size(spark, d):
    w, h = F.col("width") * 20, F.col("height") * 30
    each = X.page_dims(spark, d).select("doc_id", "page_no", *[S.preview_size(w, h, k).alias(k) for k in S.PREVIEWS])
    names = [("page", ""), ("list", "small_"), ("pick", "pick_")]
    return each.select("doc_id", "page_no", *[F.col(f"{k}.{side}").alias(f"{p}{side[0]}") for k, p in names for side in ("width", "height")])


@query(_with("SELECT doc_id, width / height AS ratio, coalesce(greatest(least(width / height, 1.5), 0.5), 0.7) AS shown FROM page_dims WHERE page_no = 1", "page_dims"))
def aspect_ratio(spark, d):
    ratio = S.aspect_ratio(F.col("width"), F.col("height"))
    return P.first_page(X.page_dims(spark, d)).select("doc_id", ratio.alias("ratio"), S.shown_ratio(ratio).alias("shown"))


# filters


@query(_with('SELECT r.* FROM ranges r JOIN counts_conv USING (doc_id) WHERE "start" >= 1 AND "end" <= page_count AND "start" <= "end"', "ranges"))
def valid_ranges(spark, d):
    return P.valid_ranges(X.ranges(spark, d), X.counts_conv(spark, d))


@query(_with("SELECT * FROM manifest WHERE batch_id IN (SELECT batch_id FROM manifest GROUP BY batch_id HAVING count(*) >= 2)", "manifest"))
def mergeable_batches(spark, d):
    return P.mergeable_batches(X.manifest(spark, d))


GOOD_SELECTION = "SELECT * FROM selection WHERE doc_id NOT IN (SELECT doc_id FROM selection JOIN counts_conv USING (doc_id) WHERE page_idx < 0 OR page_idx >= page_count)"


@query(_with(GOOD_SELECTION, "selection"))
def valid_selection(spark, d):
    return P.valid_selection(X.selection(spark, d), X.counts_conv(spark, d))


# page sequences


@query(_with("SELECT * FROM merged", "manifest pages_conv", merged=MERGED))
def merge_documents(spark, d):
    return P.merge_documents(X.manifest(spark, d), X.pages_conv(spark, d))


@query(_with("SELECT batch_id, dense_rank() OVER (ORDER BY batch_id)::INT AS ordinal, out_page_no, doc_id, page_no, content FROM merged", "manifest pages_conv", merged=MERGED))
def merge_batches(spark, d):
    return P.merge_batches(X.manifest(spark, d), X.pages_conv(spark, d))


@query(_with("SELECT doc_id, page_no, content, page_no - 1 AS out_page_no FROM pages_conv JOIN counts_conv USING (doc_id) WHERE page_no BETWEEN 2 AND 3 AND page_count >= 3", "counts_conv"))
def split_range(spark, d):
    return P.split_range(X.pages_conv(spark, d), 2, 3)


@query(_with('SELECT r.doc_id, range_ord, page_no, content, (page_no - "start" + 1)::INT AS out_page_no FROM ranges r JOIN counts_conv c ON r.doc_id = c.doc_id JOIN pages_conv p ON p.doc_id = r.doc_id WHERE "start" >= 1 AND "end" <= page_count AND "start" <= "end" AND page_no BETWEEN "start" AND "end"', "ranges"))
def split_ranges(spark, d):
    return P.split_ranges(X.pages_conv(spark, d), X.ranges(spark, d), X.counts_conv(spark, d))


@query(_with("SELECT p.doc_id, p.page_no, p.content, row_number() OVER (PARTITION BY p.doc_id ORDER BY sel_ord)::INT AS out_page_no FROM good g JOIN pages_conv p ON p.doc_id = g.doc_id AND p.page_no = g.page_idx + 1", "selection", good=GOOD_SELECTION))
def extract_pages(spark, d):
    return P.extract_pages(X.pages_conv(spark, d), X.selection(spark, d), X.counts_conv(spark, d))


@query(_with("SELECT p.doc_id, p.page_no, p.content, row_number() OVER (PARTITION BY p.doc_id ORDER BY page_idx)::INT AS out_page_no FROM (SELECT DISTINCT doc_id, page_idx FROM good) g JOIN pages_conv p ON p.doc_id = g.doc_id AND p.page_no = g.page_idx + 1", "selection", good=GOOD_SELECTION))
def extract_selected(spark, d):
    return P.extract_selected(X.pages_conv(spark, d), X.selection(spark, d), X.counts_conv(spark, d))


@query(
    _with(
        "SELECT p.doc_id, g.request, p.page_no, p.content, row_number() OVER (PARTITION BY g.request, p.doc_id ORDER BY sel_ord)::INT AS out_page_no FROM good g JOIN pages_conv p ON p.doc_id = g.doc_id AND p.page_no = g.page_idx + 1",
        "selection",
        requested="SELECT *, sel_ord % 2 AS request FROM selection",
        good="SELECT * FROM requested WHERE (doc_id, request) NOT IN (SELECT (doc_id, request) FROM requested JOIN counts_conv USING (doc_id) WHERE page_idx < 0 OR page_idx >= page_count)",
    )
)
def extract_requests(spark, d):
    """Two selections of each document, each good or bad for itself."""
    selection = X.selection(spark, d).withColumn("request", F.col("sel_ord") % 2)
    return P.extract_pages(X.pages_conv(spark, d), selection, X.counts_conv(spark, d), by=["doc_id", "request"])


@query(_with("SELECT doc_id, i AS sel_ord, i AS page_idx FROM (SELECT doc_id, unnest(range(0, page_count)) AS i FROM counts_conv)", "counts_conv"))
def select_all(spark, d):
    return P.select_all(X.counts_conv(spark, d))


@query(_with("SELECT doc_id || '#' || page_no AS out_id, 'page_' || page_no AS name, 1 AS out_page_no, doc_id, page_no, content FROM pages_conv", "pages_conv"))
def split_all(spark, d):
    return P.split_all(X.pages_conv(spark, d))


@query(
    _with(
        "SELECT m.doc_id, m.image_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY position)::INT AS page_no, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, CASE WHEN decoded THEN 85 ELSE 0 END AS quality, coalesce(decoded, false) AS decoded FROM image_manifest m LEFT JOIN images i ON i.image_id = m.image_id",
        "image_manifest images",
    )
)
def images_to_document(spark, d):
    return P.images_to_document(X.image_manifest(spark, d), X.images(spark, d)).withColumn("quality", F.coalesce("quality", F.lit(0)))


ACTION = "CASE alias WHEN 'Merge' THEN 'merge' WHEN 'Split' THEN 'split' ELSE 'view' END"


@query(_with(f"SELECT alias, request_id, ts, user_id, uri, {ACTION} AS action FROM requests", "requests"))
def action_lookup(spark, d):
    return P.action_lookup(X.requests(spark, d))


# aggregations


@query(_with("SELECT c.doc_id, count(p.page_no) AS page_count FROM catalog c LEFT JOIN pages_conv p ON p.doc_id = c.doc_id GROUP BY c.doc_id", "catalog pages_conv"))
def page_count(spark, d):
    return P.page_count(X.catalog(spark, d), X.pages_conv(spark, d))


@query(
    _with(
        "SELECT count(*) FILTER (files >= 2) AS mergeable, sum(pages)::BIGINT AS total_pages, sum(files)::BIGINT AS total_files, sum(loading)::BIGINT AS loading_files, bool_and(loading = 0) AS all_loaded, count(*) AS non_empty FROM e",
        "manifest catalog",
        e="SELECT batch_id, count(*) AS files, sum(coalesce(page_count, 0)) AS pages, count(*) FILTER (is_loading) AS loading FROM manifest LEFT JOIN catalog USING (doc_id) GROUP BY batch_id",
    )
)
def batch_stats(spark, d):
    return P.batch_stats(X.manifest(spark, d), X.catalog(spark, d))


@query(
    _with(
        """SELECT 'merge' AS op, count(DISTINCT batch_id) AS outputs, count(*) AS pages, (SELECT sum(page_count) FROM manifest LEFT JOIN counts_conv USING (doc_id))::BIGINT AS told FROM merged
UNION ALL SELECT 'extract', count(DISTINCT g.doc_id), count(*), count(*) FROM good g
UNION ALL SELECT 'split_range', count(DISTINCT (doc_id, range_ord)), sum("end" - "start" + 1)::BIGINT, count(DISTINCT (doc_id, range_ord)) FROM ranges JOIN counts_conv USING (doc_id) WHERE "start" >= 1 AND "end" <= page_count AND "start" <= "end"
UNION ALL SELECT 'split_all', count(*), count(*), count(*) FROM pages_conv""",
        "manifest pages_conv ranges selection",
        merged=MERGED,
        good=GOOD_SELECTION,
    )
)
def output_stats(spark, d):
    return P.output_stats(X.manifest(spark, d), X.ranges(spark, d), X.selection(spark, d), X.counts_conv(spark, d))


@query(_with("SELECT * FROM page_dims WHERE page_no = 1", "page_dims"))
def first_page(spark, d):
    return P.first_page(X.page_dims(spark, d))


# page images: each function gives the SQL of one step over a named grid

LUMA = "((299 * r + 587 * g + 114 * b) // 1000)::INT"


def _clamp(x: str) -> str:
    return f"greatest(0, least(255, {x}))::INT"


def _each(f, extra: str = "", source: str = "") -> str:
    return f"SELECT image_id, y, x, {', '.join(f'{f(c)} AS {c}' for c in G.RGB)}{extra} FROM {source}"


def sql_gray(t: str) -> str:
    return _each(lambda c: LUMA, source=t)


def sql_normalize(t: str) -> str:
    return f"SELECT image_id, y, x, {', '.join(f'CASE WHEN mx > mn THEN ((({c} - mn) * 255) // (mx - mn))::INT ELSE {c} END AS {c}' for c in G.RGB)} FROM {t} JOIN (SELECT image_id, min(least(r, g, b)) AS mn, max(greatest(r, g, b)) AS mx FROM {t} GROUP BY image_id) USING (image_id)"


def sql_table(t: str, table: list[int]) -> str:
    return _each(lambda c: f"({table})[{c} + 1]", source=t)


def sql_saturation(t: str) -> str:
    return _each(lambda c: _clamp(f"l + trunc(({c} - l) * 12 / 10.0)"), source=f"(SELECT *, {LUMA} AS l FROM {t})")


def sql_sharpen(t: str, center: int, side: int) -> str:
    near = lambda c: " + ".join(f"coalesce({f}({c}) OVER {w}, {c})" for w in ("rw", "cl") for f in ("lag", "lead"))
    return f"SELECT image_id, y, x, {', '.join(_clamp(f'trunc(({center} * {c} - {side} * ({near(c)})) / 10.0)') + f' AS {c}' for c in G.RGB)} FROM {t} WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cl AS (PARTITION BY image_id, x ORDER BY y)"


def sql_stats(t: str, block: int, step: int) -> str:
    """The direct form: every sample of the square, by a join on clamped coordinates."""
    o = f"range({-block}, {block + 1}, {step})"
    sized = f"SELECT *, {LUMA} AS l, max(x) OVER (PARTITION BY image_id) AS mx, max(y) OVER (PARTITION BY image_id) AS my FROM {t}"
    spots = f"SELECT *, greatest(0, least(mx, x + dx)) AS qx, greatest(0, least(my, y + dy)) AS qy FROM (SELECT *, unnest({o}) AS dy FROM (SELECT *, unnest({o}) AS dx FROM ({sized})))"
    return f"""SELECT p.image_id, p.y, p.x, p.r, p.g, p.b, any_value(p.l) AS l, sum(q.l) AS total, min(q.l) AS low, max(q.l) AS high
FROM ({spots}) p JOIN (SELECT image_id, x, y, {LUMA} AS l FROM {t}) q ON q.image_id = p.image_id AND q.x = p.qx AND q.y = p.qy GROUP BY ALL"""


def sql_document(t: str, block: int, step: int) -> str:
    n = float(len(range(-block, block + 1, step)) ** 2)
    s = f"SELECT *, l::DOUBLE AS lum, (total::DOUBLE / {n}::DOUBLE) * 0.85::DOUBLE - 8.0::DOUBLE AS th, (high - low)::DOUBLE / 255.0::DOUBLE AS con FROM ({sql_stats(t, block, step)})"
    D = "::DOUBLE"
    ink = lambda c: f"trunc(least(80.0{D}, greatest(0.0{D}, {c}{D} * (0.3{D} + lum / 255.0{D} * 0.4{D}))))"
    paper = lambda c: f"trunc(least(255.0{D}, greatest(240.0{D}, 255.0{D} - (255.0{D} - {c}{D}) * (1.0{D} - (0.3{D} + (lum - th) / (255.0{D} - th) * 0.7{D})))))"
    whitened = _each(lambda c: f"(CASE WHEN con < 0.15{D} THEN 255 WHEN lum < th THEN {ink(c)} ELSE {paper(c)} END)::INT", source=f"({s})")
    return sql_sharpen(f"({whitened})", *G.SHARPEN["document"])


def sql_otsu(t: str) -> str:
    return f"""SELECT image_id, trunc(coalesce(-max(CASE WHEN v > 0 THEN {{'v': v, 'l': -level}} END).l, 128)::DOUBLE * 0.9::DOUBLE)::INT AS threshold FROM (
SELECT image_id, level, CASE WHEN an > wb THEN (wb * (an - wb))::DOUBLE * (sb::DOUBLE / wb - (s_all - sb)::DOUBLE / (an - wb)) * (sb::DOUBLE / wb - (s_all - sb)::DOUBLE / (an - wb)) END AS v FROM (
SELECT image_id, level, (sum(n) OVER w)::BIGINT AS wb, (sum(n * level) OVER w)::BIGINT AS sb, (sum(n) OVER (PARTITION BY image_id))::BIGINT AS an, (sum(n * level) OVER (PARTITION BY image_id))::BIGINT AS s_all
FROM (SELECT image_id, {LUMA} AS level, count(*) AS n FROM {t} GROUP BY ALL) WINDOW w AS (PARTITION BY image_id ORDER BY level ROWS UNBOUNDED PRECEDING))) GROUP BY image_id"""


def sql_black_white(t: str) -> str:
    gray = f"({sql_normalize(f'({sql_gray(t)})')})"
    return _each(lambda c: "(CASE WHEN r < threshold - 20 THEN 0 WHEN r > threshold + 20 THEN 255 ELSE greatest(0, least(255, trunc((r - (threshold - 20)) * 255 / 40.0))) END)::INT", source=f"{gray} JOIN ({sql_otsu(gray)}) USING (image_id)")


def _nested(t: str, *steps) -> str:
    for f in steps:
        t = f"({f(t)})"
    return t[1:-1]


def sql_auto(t: str) -> str:
    return _nested(t, sql_normalize, lambda s: sql_table(s, G.contrast_table(115)), lambda s: sql_sharpen(s, *G.SHARPEN["auto"]))


def sql_clean(t: str) -> str:
    return _nested(t, sql_gray, sql_normalize, lambda s: sql_table(s, G.contrast_table(125)), lambda s: sql_table(s, G.brightness_table(1.05)), lambda s: sql_sharpen(s, *G.SHARPEN["grayscale"]))


def sql_magic(t: str) -> str:
    return _nested(t, sql_normalize, sql_saturation, lambda s: sql_table(s, G.contrast_table(140)), lambda s: sql_table(s, G.brightness_table(1.08, 0.9)), lambda s: sql_sharpen(s, *G.SHARPEN["magic"]))


def _grid(spark, d):
    return G.by_image(X.grid(spark, d))


@query(_with(sql_gray("grid"), "grid"))
def img_grayscale(spark, d):
    return G.img_grayscale(X.grid(spark, d))


@query(_with("SELECT image_id, min(least(r, g, b)) AS mn, max(greatest(r, g, b)) AS mx FROM grid GROUP BY image_id", "grid"))
def image_minmax(spark, d):
    return G.image_minmax(X.grid(spark, d))


@query(_with(f"SELECT image_id, {LUMA} AS level, count(*) AS n FROM grid GROUP BY ALL", "grid"))
def image_histogram(spark, d):
    return G.image_histogram(X.grid(spark, d))


@query(_with(sql_otsu("grid"), "grid"))
def otsu_threshold(spark, d):
    return G.otsu_threshold(G.image_histogram(X.grid(spark, d)))


@query(_with(sql_normalize("grid"), "grid"))
def img_normalize(spark, d):
    return G.img_normalize(_grid(spark, d))


@query(_with(sql_table("grid", G.contrast_table(140)), "grid"))
def img_contrast(spark, d):
    return G.img_contrast(X.grid(spark, d), G.CONTRAST["magic"])


@query(_with(_nested("grid", sql_saturation, lambda s: sql_table(s, G.brightness_table(1.08, 0.9))), "grid"))
def img_color(spark, d):
    return G.img_color(X.grid(spark, d))


@query(_with(sql_sharpen("grid", 50, 10), "grid"))
def img_sharpen(spark, d):
    return G.img_sharpen(_grid(spark, d), *G.SHARPEN["magic"])


STATS = _with(f"SELECT image_id, y, x, l, total::BIGINT AS total, low, high FROM ({sql_stats('wide_grid', 15, 3)})", "wide_grid")


@query(STATS)
def local_stats(spark, d):
    return R.local_stats(X.wide_grid(spark, d), 15, 3).drop(*G.RGB)


@query(STATS)
def local_stats_by_pixel(spark, d):
    """The same by windows over pixel rows."""
    return G.local_stats(G.by_image(X.wide_grid(spark, d)), 15, 3).select("image_id", "y", "x", "l", F.col("total").cast("long").alias("total"), "low", "high")


@query(_with(sql_document("wide_grid", 15, 3), "wide_grid"))
def img_document(spark, d):
    return R.apply_filter(X.wide_grid(spark, d), "document")


@query(ORACLE_SQL["img_document"])
def img_document_by_pixel(spark, d):
    """The same by windows over pixel rows."""
    return G.img_document(G.by_image(X.wide_grid(spark, d)), 15, 3)


@query(_with(sql_black_white("grid"), "grid"))
def img_black_white(spark, d):
    return G.img_black_white(_grid(spark, d))


@query(_with(sql_clean("grid"), "grid"))
def img_grayscale_clean(spark, d):
    return G.img_grayscale_clean(_grid(spark, d))


@query(_with(sql_auto("grid"), "grid"))
def img_auto(spark, d):
    return G.img_auto(_grid(spark, d))


@query(_with(sql_magic("grid"), "grid"))
def img_magic_color(spark, d):
    return G.img_magic_color(_grid(spark, d))


def _named(name: str) -> str:
    return f"(SELECT g.* FROM grid g JOIN image_manifest USING (image_id) WHERE filter = '{name}')"


@query(_with(" UNION ALL ".join(f"SELECT * FROM ({q})" for q in ("SELECT * FROM " + _named("original"), sql_auto(_named("auto")), sql_document(_named("document"), 15, 3), sql_magic(_named("magicColor")), sql_black_white(_named("blackWhite")), sql_clean(_named("grayscale")))), "grid image_manifest"))
def apply_filters(spark, d):
    return R.apply_filters(X.grid(spark, d), X.image_manifest(spark, d))


@query(ORACLE_SQL["apply_filters"])
def apply_filters_by_pixel(spark, d):
    """The same by expressions and windows over pixel rows."""
    return G.apply_filters(X.grid(spark, d), X.image_manifest(spark, d))


EVERY_FILTER = {"auto": sql_auto, "magicColor": sql_magic, "blackWhite": sql_black_white, "grayscale": sql_clean, "document": lambda t: sql_document(t, 15, 3), "original": lambda t: f"SELECT * FROM {t}"}


@query(_with(" UNION ALL ".join(f"SELECT * FROM ({q('wide_grid')})" for q in EVERY_FILTER.values()), "wide_grid"))
def every_filter(spark, d):
    """All filters at once, each image from its original pixels; the last image may have gaps."""
    ids = X.wide_grid(spark, d).select("image_id").distinct()
    wanted = ids.select("image_id", F.explode(F.array(*[F.lit(x) for x in EVERY_FILTER])).alias("filter"))
    return R.apply_filters(X.wide_grid(spark, d), wanted)


@query(
    _with(
        "SELECT image_id, y - y0 AS y, x - x0 AS x, r, g, b FROM grid JOIN boxes USING (image_id) WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h",
        "grid",
        boxes="SELECT image_id, w, h, (8 - w) // 2 AS x0, (8 - h) // 2 AS y0 FROM (SELECT vec_id AS image_id, CASE vec_id % 4 WHEN 0 THEN 5 ELSE 8 END AS w, CASE vec_id % 4 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 8 END AS h FROM embeddings)",
    )
)
def crop(spark, d):
    names = F.array(*[F.lit(x) for x in ("A4", "4:3", "3:2", "Free")])
    presets = X.image_manifest(spark, d).select("image_id", F.get(names, (F.col("image_id") % 4).cast("int")).alias("preset"))
    grid = _grid(spark, d)
    return G.crop(grid, G.preset_boxes(grid, presets))


# streams, in their batch form


@query(_with(f"SELECT request_id, ts, user_id, path, {TITLE} AS title, {ACTION} AS action, CASE alias WHEN 'Merge' THEN 'tab 0' WHEN 'Split' THEN 'tab 2' ELSE 'viewer' END AS target FROM b", "requests", p=f"SELECT *, {RESOLVED} AS path FROM requests WHERE {PDF_URI}", b="SELECT *, list_extract(string_split(path, '/'), -1) AS name, regexp_replace(list_extract(string_split(path, '/'), -1), '^intent_[0-9]+_', '') AS bare FROM p WHERE path IS NOT NULL"))
def route_requests(spark, d):
    return E.route_requests(X.requests(spark, d))


@query(
    _with(
        "SELECT user_id, event_id, ts, n FROM w WHERE emit",
        n="SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
        c="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM n WHERE n > 1 AND n % 3 = 0",
        w="SELECT user_id, event_id, ts, n, k, true AS emit, ts AS last FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.event_id, c.ts, c.n, c.k, c.ts - w.last >= INTERVAL 12 HOUR, CASE WHEN c.ts - w.last >= INTERVAL 12 HOUR THEN c.ts ELSE w.last END FROM w JOIN c ON c.user_id = w.user_id AND c.k = w.k + 1",
    )
)
def throttle_events(spark, d):
    return E.throttle_events(X.table(spark, d, "events"), gap_s=12 * 3600)


def entry(spark, d):
    """The flagship query: merged and assembled documents."""
    return assemble(spark, d)
