"""Quality rules with host-level verdicts.

Each document gets exact base counts. A document fails the base rules if it
has under ``MIN_WORDS`` words or if over ``MAX_REPEAT_PCT`` percent of its words
lie in a 5-word window that the text holds twice or more. Failures are summed
by host (the ``source`` column), the failure rates are shrunk towards a beta
prior fitted to all hosts by the method of moments, and hosts whose shrunk rate
exceeds ``max_rate`` have all their documents rejected.

Only DataFrame functions are used. Texts are read once: the base counts go to a
narrow table in the shared folder, which the host sums and the join back read.

Defined cases: null and empty texts have no words, hence fail. A null host is a
host of its own. Repeated rows count each. An empty table gives an empty table.
Columns of the input other than id, text and host are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Where hosts do not differ beyond noise the fitted prior has no bound: it counts for so many documents.
MAX_PRIOR_WEIGHT = 1000.0

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more, from the windows' hashes by position.

    Windows are sorted by (hash, position) and compared with their neighbours;
    the positions of equal ones, sorted again, cover up to five words each.
    """
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice(ordered, 1, F.size(windows) - 1))
    after = F.concat(F.slice(ordered, 2, F.size(windows)), none)
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    left = F.zip_with(ordered, before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), same(a, b).alias("twin")))
    marked = F.zip_with(left, after, lambda a, b: F.when(a["twin"] | same(a, b), a["i"]))
    at = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    nexts = F.concat(F.slice(at, 2, F.size(windows)), F.array(F.lit(2**31 - 1)))
    runs = F.zip_with(at, nexts, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, n: total + n)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, the five counts and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), _words(text).alias("words"))
    # words are hashed once, windows from the words' hashes
    hashed = worded.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windowed = hashed.withColumn(
        "windows",
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get("hashes", i + (k - 1)) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    solid = F.translate("text", BLANKS, "")
    counted = windowed.withColumn("lines", lines).select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(solid).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("windows"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(base: DataFrame, max_rate: float = MAX_HOST_RATE, max_prior_weight: float = MAX_PRIOR_WEIGHT) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The prior comes from the hosts themselves: its mean is the overall failure
    rate, its weight follows from the spread of host rates beyond binomial
    noise. Three sums reach the driver.
    """
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    sums = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failed").alias("f"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("ff"),
    ).first()
    n, f = sums["n"] or 0, sums["f"] or 0
    mean = f / n if n else 0.0
    noise = mean * (1 - mean)
    spread = max(0.0, (sums["ff"] or 0.0) / n - mean * mean - noise * sums["hosts"] / n) if n else 0.0
    weight = min(max_prior_weight, max(1.0, noise / spread - 1)) if spread > 0 else max_prior_weight
    rate = (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", rate <= max_rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE, max_prior_weight: float = MAX_PRIOR_WEIGHT) -> DataFrame:
    """Base counts, host rate and ``kept`` for every document.

    Every host's rate and verdict, one row a host, is joined back to the stored
    base counts. Spark sends the hosts to all tasks where they are few, and else
    sorts both sides; a hot host is then split by adaptive skew handling.
    """
    base = stored(base_counts(docs, id_col, text_col, host_col), "quality-base")
    hosts = host_verdicts(base, max_rate, max_prior_weight).withColumnRenamed("host", "host_key")
    joined = base.join(hosts, F.col("host").eqNullSafe(F.col("host_key")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("host_key")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: doc_id, the five counts, base_failed, its source's documents, failures and rate in millionths, and kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rate = F.round(F.col("host_rate") * 1e6).cast("long").alias("host_rate_ppm")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs", "host_failed", rate, "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
base AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source),
sums AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS r FROM hosts),
prior AS (SELECT m, greatest(0.0, q - m * m - m * (1 - m) * r) AS s FROM sums),
weight AS (SELECT m, CASE WHEN s > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / s - 1)) ELSE 1000.0 END AS k FROM prior),
verdict AS (SELECT source, n, f, (f + m * k) / (n + k) AS rate, (f + m * k) / (n + k) <= 0.5 AS ok FROM hosts, weight)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       n::BIGINT AS host_docs, f::BIGINT AS host_failed, round(rate * 1000000)::BIGINT AS host_rate_ppm,
       NOT base_failed AND v.ok AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""
