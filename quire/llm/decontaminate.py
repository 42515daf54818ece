"""Benchmark decontamination by a distributed positional inverted index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered. A test item
gives windows of ``n`` consecutive words (one shorter window if it has fewer).

1. Texts are cut into words once. Their test terms are stored in place (other
   words are nulls), so the place in the array is the position.
2. The frequency of every test term is counted over the whole corpus. Each window
   orders its terms from the rarest on.
3. The postings (term, document, position) of all terms that are among a window's
   two rarest are inverted: dealt by term and document, sorted by term and stored.
4. For each pair of two rarest terms and their distance the shifted lists are
   intersected; what stands in both is a possible start of the pair's windows.
5. The lists of the other terms are needed at possible starts only. They are read
   from the places stored in step 1, each term at its own offset, and a start stays
   if all of them hold it. Neither step looks at the terms of the other: a window
   is found only if all lists agree.

Only DataFrame functions are used. What is shuffled are postings of rare test terms
and possible starts; the stored places meet the starts where they lie if the starts
fit in ``MAX_BROADCAST``, else by document. Sets of test terms are literals when they
have at most ``MAX_TERMS`` members (counted first); beyond that all words are stored
and postings are joined with the terms.

Defined cases: null and empty texts have no words and no hits; items without
words have no windows; a repeated row gets its result each time; hits of rows
that share a doc_id but not the text are kept apart; empty tables give no hits.
Columns of the input other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_for, row_hash, stored

WINDOW = 13
#: Above so many test terms the lookup is a join, not a literal set.
MAX_TERMS = 50_000
#: Windows, and possible starts, are sent to all tasks up to so many bytes (measured first); beyond that they are dealt out.
MAX_BROADCAST = 32_000_000
#: A term's list is dealt over at least so many slots, and a part of the index takes so many bytes.
LIST_SLOTS, PART_BYTES = 64, 64_000_000
#: Hit words that make a document contaminated: one in so many.
CONTAMINATED_ONE_IN = 20

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    # the split leaves an empty first or last part where the text begins or ends without a word
    raw = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.filter(raw, lambda w: w != "")


def item_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, window (its words): one row per item and distinct window."""
    worded = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1)))
    return worded.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("window")).distinct()


def _term_set(terms: DataFrame) -> list[str] | None:
    """The terms if they are at most MAX_TERMS, else None."""
    found = [r[0] for r in terms.limit(MAX_TERMS + 1).collect()]
    return found if len(found) <= MAX_TERMS else None


def placed_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_words, words: each text's words in place, null where they are no test term."""
    few = _term_set(terms)
    worded = docs.select(F.col(id_col).alias("doc_id"), row_hash(text_col).alias("h"), words_of(F.col(text_col)).alias("words"))
    kept = F.col("words") if few is None else F.transform("words", lambda w: F.when(w.isin(few), w))
    return worded.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), kept.alias("words"))


def _postings(placed: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, h, pos, term: one row for each place of a given term."""
    few = _term_set(terms)
    listed = placed.select("doc_id", "h", F.posexplode("words").alias("pos", "term"))
    return listed.filter(F.col("term").isin(few)) if few is not None else listed.join(terms, "term", "left_semi")


def term_frequencies(placed: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: occurrences over the whole corpus of the given terms."""
    return _postings(placed, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def positional_index(placed: DataFrame, terms: DataFrame, n_postings: int) -> DataFrame:
    """term, doc_id, h, pos: the inverted lists of the given terms.

    A list is cut by document into slots, at least ``LIST_SLOTS`` and as many as
    there are parts, so that a frequent term is spread; each slot of a list lies in
    one file, sorted by document and position.
    """
    n_parts = parts_for(placed.sparkSession, 64 * n_postings, PART_BYTES)
    slot = F.pmod("h", F.lit(max(LIST_SLOTS, n_parts)))
    return _postings(placed, terms).select("term", "doc_id", "h", "pos").repartition(n_parts, "term", slot).sortWithinPartitions("term", "doc_id", "h", "pos")


def rarest_terms(windows: DataFrame, df: DataFrame) -> DataFrame:
    """w (a number), window, term1, offset1, term2, step, others: each window with its two rarest terms.

    ``step`` leads from the rarest term to the next one, ``others`` are (term,
    offset) of the rest. Windows with a term that no document has go. A window of
    one word has itself as its second term.
    """
    distinct = windows.select("window").distinct()
    terms = distinct.select("window", F.posexplode("window").alias("offset", "term")).join(df, "term", "left")
    ranked = terms.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset"))).alias("by_df"))
    ranked = ranked.filter(F.get("by_df", 0)["df"] > 0)
    first, second = F.get("by_df", 0), F.coalesce(F.get("by_df", 1), F.get("by_df", 0))
    others = F.transform(F.slice("by_df", 3, F.greatest(F.size("by_df") - 2, F.lit(0))), lambda x: F.struct(x["term"].alias("term"), x["offset"].alias("offset")))
    named = (first["term"].alias("term1"), first["offset"].alias("offset1"), second["term"].alias("term2"), (second["offset"] - first["offset"]).alias("step"))
    return ranked.select(F.monotonically_increasing_id().alias("w"), "window", *named, others.alias("others"))


def _same_text(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def _sized(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= MAX_BROADCAST else df


def possible_starts(index: DataFrame, rare: DataFrame, rare_bytes: int) -> DataFrame:
    """doc_id, h, start, w: where the shifted lists of a window's two rarest terms meet."""
    pairs = rare.select("term1", "term2", "step").distinct()
    first = index.join(_sized(pairs, rare_bytes), F.col("term") == F.col("term1"))
    first = first.select("doc_id", "h", "pos", "term1", "term2", "step", (F.col("pos") + F.col("step")).alias("pos2")).filter("pos2 >= 0")
    second = index.join(_sized(pairs.select("term2").distinct(), rare_bytes), F.col("term") == F.col("term2"), "left_semi")
    meet = _same_text("a", "b") & (F.col("a.pos2") == F.col("b.pos")) & (F.col("a.term2") == F.col("b.term"))
    met = first.alias("a").join(second.alias("b"), meet, "left_semi").distinct()
    starts = met.join(_sized(rare.select("w", "term1", "term2", "step", "offset1"), rare_bytes), ["term1", "term2", "step"])
    return starts.select("doc_id", "h", (F.col("pos") - F.col("offset1")).alias("start"), "w").filter("start >= 0")


def phrase_matches(placed: DataFrame, index: DataFrame, rare: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, h, start, window: every exact occurrence of every window, the lists intersected from the rarest on."""
    # a window is held once and once again in its terms and offsets
    rare_bytes = rare.agg(F.coalesce(F.sum(128 + F.size("window") * 64 + F.octet_length(F.array_join("window", " ")) * 2), F.lit(0)).alias("n")).first()["n"]
    starts = stored(possible_starts(index, rare, rare_bytes), "possible-starts")
    starts_bytes = 64 * starts.count()
    lists = rare.select("w", "window", "others")
    if rare_bytes > MAX_BROADCAST:
        # the terms travel with the starts, not with the texts' places
        starts, starts_bytes = starts.join(lists, "w"), MAX_BROADCAST + 1
    at = placed.select("doc_id", "h", "words").alias("p").join(_sized(starts, starts_bytes).alias("s"), _same_text("p", "s")).drop(F.col("p.doc_id"), F.col("p.h"))
    if rare_bytes <= MAX_BROADCAST:
        at = at.join(F.broadcast(lists), "w")
    # one comparison for each list: the condition is compiled with the join, and no text is copied for a start
    agree = F.lit(True)
    for i in range(n - 2):
        other = F.get("others", F.lit(i))
        agree = agree & ((F.size("others") <= i) | F.coalesce(F.get("words", F.col("start") + other["offset"]) == other["term"], F.lit(False)))
    return at.filter(agree).select("doc_id", "h", "start", "window").distinct()


def proximity_matches(docs: DataFrame, phrase: list[str], slop: int) -> DataFrame:
    """doc_id, first, last: places where all words of a phrase stand within ``slop`` words.

    Starts from the phrase's rarest word; the other words are looked up in the
    stored places around it, ``slop`` to both sides. Words
    are in any order; a repeated one counts once. A text shorter than ``slop`` is
    one place. Null and empty texts have none, equal rows and ids give equal places
    once, and an empty phrase is an error.
    """
    if not phrase:
        raise ValueError("a phrase has words")
    spark = docs.sparkSession
    terms = spark.createDataFrame([(w,) for w in dict.fromkeys(phrase)], "term string")
    placed = stored(placed_terms(docs, terms), "phrase-terms")
    df = {r["term"]: r["df"] for r in term_frequencies(placed, terms).collect()}
    if any(w not in df for w in phrase):
        return placed.select("doc_id", F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    rarest = min(df, key=lambda w: (df[w], w))
    places = F.filter(F.transform("words", lambda w, i: F.when(w == rarest, i)), lambda i: i.isNotNull())
    before = lambda i: F.least(i, F.lit(slop - 1))
    near = F.transform(places, lambda i: F.struct(i.alias("pos"), before(i).alias("before"), F.slice("words", i - before(i) + 1, before(i) + slop).alias("context")))
    at = placed.select("doc_id", F.explode(near).alias("p")).select("doc_id", "p.*")
    lowest = F.col("pos") - F.col("before")
    spans = F.transform(F.sequence(F.lit(0), F.col("before")), lambda s: F.struct((lowest + s).alias("first"), F.least(lowest + s + (slop - 1), lowest + F.size("context") - 1).alias("last"), F.slice("context", s + 1, slop).alias("words")))
    found = at.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")
    wanted = F.array(*[F.lit(w) for w in dict.fromkeys(phrase)])
    return found.filter(F.size(F.array_except(wanted, F.col("words"))) == 0).select("doc_id", "first", "last").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_hit, items (sorted ids as strings), contaminated."""
    windows = stored(item_windows(items, n, item_id_col, item_text_col), "test-windows")
    test_terms = windows.select(F.explode("window").alias("term")).distinct()
    placed = stored(placed_terms(docs, test_terms, id_col, text_col), "placed-terms")
    df = stored(term_frequencies(placed, test_terms), "term-frequencies")
    rare = stored(rarest_terms(windows, df), "test-rarest")
    anchors = rare.select(F.explode(F.array("term1", "term2")).alias("term")).distinct()
    n_postings = df.join(anchors, "term", "left_semi").agg(F.sum("df").alias("n")).first()["n"] or 0
    index = stored(positional_index(placed, anchors, n_postings), "postings")
    matches = stored(phrase_matches(placed, index, rare, n), "matches")
    order = W.partitionBy("doc_id", "h").orderBy("start", "end")
    spans = matches.select("doc_id", "h", "start", (F.col("start") + F.size("window")).alias("end")).distinct()
    fresh = spans.withColumn("seen", F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    hit = fresh.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    found = matches.join(windows, "window").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias("items"))
    hits = hit.join(found, (hit["doc_id"].eqNullSafe(found["doc_id"])) & (hit["h"].eqNullSafe(found["h"]))).select(hit["doc_id"].alias("hit_id"), hit["h"].alias("hit_h"), "n_hit", "items")
    base = placed.select("doc_id", "h", "n_words")
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("h").eqNullSafe(F.col("hit_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (CONTAMINATED_ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` against all windows of ``benchmark``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
