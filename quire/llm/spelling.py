"""Spelling variants by an index of variable-length grams.

Words are runs of letters with their counts over all texts. Two words are near if
one inserted, deleted or replaced letter makes them equal; of a word's near words
the most frequent, if it is frequent enough, is its form, and forms lead to roots.

* Gram dictionary: grams of 2 to ``LONGEST`` letters of the words between an opening
  and a closing sign, counted by Spark. A gram is kept if it has two letters or if
  what it extends is frequent, so rare grams have no extension. What is frequent
  is a share of all gram places (one in ``FREQUENT``), so the number of frequent
  grams, and with it the dictionary that tasks read, is bounded whatever the
  number of words.
* Decomposition: at each place of a word the longest gram of the dictionary. It
  depends on its own letters and on the one that ended it, no others.
* Affected grams: an edit can change only the grams that depend on its place, so a
  word has a greatest number of grams that one edit can affect. A word of 6
  letters has 7 grams, of which an edit affects ``LONGEST + 1`` = 6 at most, so near
  words always share a gram.
* List merging: near words share all but the affected grams. If a word's grams
  are ordered by frequency, the least frequent one that it shares with a near
  word stands behind affected ones only; so a word is posted, and looked up, under the
  rarest ones up to that number and one more, with all places of those grams. Lists
  are by gram, word length and place: an unaffected gram of a longer word stands at
  the same place or one behind.
* Verification: one edit leaves the first or the second half of a word as it is;
  words that meet and agree in a half are compared by edit distance, all inside the
  join.

Defined cases: a null text has no words, a null id deletes no letter; repeated rows
count each; ties of counts go to the smallest word in code-point order; an empty table
has no words; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import parts_for, stored

#: Words of fewer letters or occurrences are left out.
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form has at least so many times the word's count.
FORM_RATIO = 5
#: Letters of the longest gram; with MIN_LETTERS = 6 near words share a gram up to 5.
SHORTEST, LONGEST = 2, 5
#: A gram is frequent, and has extensions, if it has more than one of so many gram places, and more than FEW.
FREQUENT, FEW = 8192, 8
#: Signs before and behind a word; no word holds them.
OPEN, CLOSE = "^", "$"
#: Postings that a task of the join takes.
LIST_ROWS = 200_000
#: Letters by their code, and how often the query's contract deletes one.
LETTERS = re.compile(rb"[a-z\xc0-\xff]+")
DELETE_ONE_IN = 199
WORDS = "word string, n long"


def _runs(text: str) -> list[bytes]:
    """Runs of letters, A to Z in lower case; a letter is a byte, its code point."""
    return LETTERS.findall(text.encode("latin-1", "replace").lower())


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def _misspelt(doc_id: int | None, runs: Counter) -> Counter:
    """The runs of a document, some without a letter, as the query's contract sets it."""
    if doc_id is None:
        return runs
    seed = zlib.crc32(f"{doc_id}:".encode())
    hits = [(r, h) for r in runs if (h := zlib.crc32(_utf8(r), seed)) % DELETE_ONE_IN == 0]
    # all are taken out first: what a deletion leaves may be another hit, and loses no second letter
    taken = [(r, h, runs.pop(r)) for r, h in hits]
    for r, h, n in taken:
        at = h % len(r)
        runs[r[:at] + r[at + 1 :]] += n
    return runs


def letter_runs(docs: DataFrame, change=None, least: int = MIN_LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n over all texts, of words of ``least`` letters; ``change`` maps a document's id and runs to others.

    A task counts each batch before it sends the words.
    """

    def counted(batches):
        for b in text_batches(batches):
            total: Counter = Counter()
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t:
                    runs = Counter(_runs(t))
                    total.update(change(i, runs) if change else runs)
            rows = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= least]
            yield pa.record_batch({"word": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})

    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, WORDS)
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """gram and n (its places) of the pruned dictionary."""
    signed = F.concat(F.lit(OPEN), F.col("word"), F.lit(CLOSE))
    size = F.char_length("word") + 2

    def each(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), size - q + 1), lambda i: F.substring(signed, i, F.lit(q)))

    all_grams = F.concat(*[each(q) for q in range(SHORTEST, longest + 1)])
    grams = stored(words.select(F.explode(all_grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    places = grams.filter(F.char_length("gram") == SHORTEST).agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(FEW, places // frequent)
    # what is frequent is bounded: at most `frequent` grams of each length
    stems = F.broadcast(grams.filter((F.col("n") > least) & (F.char_length("gram") < longest)).select(F.col("gram").alias("stem")))
    stem = F.substring("gram", F.lit(1), F.char_length("gram") - 1)
    longer = grams.filter(F.char_length("gram") > SHORTEST).join(stems, stem == F.col("stem"), "left_semi")
    return grams.filter(F.char_length("gram") == SHORTEST).unionByName(longer)


def grams_of(word: str, dictionary: dict[str, int], longest: int = LONGEST) -> tuple[list[str], int]:
    """The longest gram at each place of the signed word, and how many of them one edit can affect."""
    signed = OPEN + word + CLOSE
    n = len(signed)
    grams, touched = [], np.zeros(n + 1, np.int64)
    for a in range(n - 1):
        size = SHORTEST
        while size < longest and a + size < n and signed[a : a + size + 1] in dictionary:
            size += 1
        grams.append(signed[a : a + size])
        touched[a] += 1  # the gram depends on its letters, and on the one after them unless it is of full length
        touched[min(a + size + (size < longest), n)] -= 1
    return grams, int(np.cumsum(touched)[1:n].max())


POSTED = "gram string, size int, at int, word string, n long"


def posted_words(words: DataFrame, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """gram, size, at, word, n: each word under the rarest of its grams, one more than an edit can affect."""
    known = words.sparkSession.sparkContext.broadcast({r.gram: r.n for r in dictionary.toLocalIterator()})

    def post(batches):
        table = known.value
        for b in batches:
            gram, size, at, row = [], [], [], []
            for i, w in enumerate(b.column("word").to_pylist()):
                grams, affected = grams_of(w, table, longest)
                order = sorted(grams, key=lambda g: (table.get(g, 0), g))
                rarest = set(order[: affected + 1])
                for k, g in enumerate(grams):
                    if g in rarest:
                        gram.append(g)
                        size.append(len(w))
                        at.append(k)
                        row.append(i)
            row = pa.array(row, pa.int64())
            yield pa.record_batch({"gram": pa.array(gram, pa.string()), "size": pa.array(size, pa.int32()), "at": pa.array(at, pa.int32()), "word": pc.take(b.column("word"), row), "n": pc.take(b.column("n"), row)})

    return words.select("word", "n").mapInArrow(post, POSTED)


def near_words(words: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """word, n, other, other_n: every ordered pair of words that one inserted, deleted or replaced letter makes equal.

    ``words`` has word and n, each word once, of at least ``longest + 1`` letters.
    """
    spark, key = words.sparkSession, ["gram", "size", "at"]
    posted = stored(posted_words(words, gram_dictionary(words, frequent, longest), longest), "postings")
    parts = parts_for(spark, posted.count(), LIST_ROWS)
    shifts = F.array(*[F.struct(F.lit(s).alias("longer"), F.lit(k).alias("on")) for s, k in ((0, 0), (1, 0), (1, 1))])
    asked = posted.withColumn("s", F.explode(shifts))
    asked = asked.select("gram", (F.col("size") + F.col("s.longer")).alias("size"), (F.col("at") + F.col("s.on")).alias("at"), F.col("s.longer").alias("longer"), F.col("word").alias("one"), F.col("n").alias("one_n"))
    # words of one length meet twice, those of two lengths once
    once = (F.col("longer") == 1) | (F.col("one") < F.col("word"))
    half = F.call_function("div", F.col("size") - F.col("longer"), F.lit(2)).cast("int")
    rest = F.col("size") - F.col("longer") - half
    start = F.substring("one", F.lit(1), half) == F.substring("word", F.lit(1), half)
    end = F.right(F.col("one"), rest) == F.right(F.col("word"), rest)
    near = once & (start | end) & (F.levenshtein("one", "word", 1) == 1)
    meeting = asked.repartition(parts, *key).hint("merge").join(posted.repartition(parts, *key), key)
    pairs = meeting.filter(near).select("one", "one_n", "word", "n").distinct()
    both = F.array(F.struct(F.col("one").alias("word"), F.col("one_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")), F.struct("word", "n", F.col("one").alias("other"), F.col("one_n").alias("other_n")))
    return pairs.select(F.explode(both).alias("b")).select("b.*")


def spelling_forms(words: DataFrame, ratio: int = FORM_RATIO, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word.

    Each form has ``ratio`` times its word's count, so chains are as short as the
    logarithm of the greatest count; they are followed by doubling.
    """
    found = near_words(words, frequent, longest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    judged = words.select("word", "n").join(found, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    judged = stored(judged.select("word", "n", F.when(good, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    links = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = links.join(judged.select(F.col("word").alias("root"), F.col("n").alias("root_n")), "root").agg(F.max("root_n").alias("n")).first()["n"] or 0
    steps, reach = 1, 1
    while ratio**steps <= most:
        steps += 1
    while reach < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return judged.join(links, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` of 6 letters and 5 occurrences, some misspelt: word, n, form, root, n_near, form_n."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = stored(letter_runs(docs, _misspelt).filter(F.col("n") >= MIN_COUNT), "words")
    return spelling_forms(words)
