"""Posting lists decide what is contaminated; rules of a host and its parents are linked, not copied."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, url_filters

PHRASE = "rare1 rare2 c d e f g h i j k l m".split()


def _swapped(at):
    return " ".join("zz" if i == at else w for i, w in enumerate(PHRASE))


@pytest.fixture(scope="module")
def one_word_off(spark):
    """The phrase; the phrase with one word changed; each word often enough that rare1 and rare2 stay the rarest."""
    texts = [" ".join(PHRASE), *[_swapped(i) for i in range(13)], *["c d e f g h i j k l m"] * 20]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _hits(docs, items):
    return {r.doc_id for r in decontaminate.decontaminate(docs, items).filter("n_hit > 0").collect()}


def test_only_the_whole_phrase_is_hit(spark, one_word_off):
    items = spark.createDataFrame([(1, " ".join(PHRASE))], "item_id long, text string")
    assert _hits(one_word_off, items) == {0}


def test_the_second_list_decides(spark, one_word_off, monkeypatch):
    """Without the intersection of the two rarest lists a text without the second term passes, as no later step looks at it."""

    def first_list_only(index, rare, rare_bytes):
        met = index.join(rare, F.col("term") == F.col("term1"))
        return met.select("doc_id", "h", (F.col("pos") - F.col("offset1")).alias("start"), "w").filter("start >= 0")

    items = spark.createDataFrame([(1, " ".join(PHRASE))], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "possible_starts", first_list_only)
    assert _hits(one_word_off, items) == {0, 2}


def test_lists_of_repeated_words_and_short_items(spark):
    texts = ["a a a a", "a", "b a", "a b", "b " * 30, None, "x a b y", "a b"]
    docs = spark.createDataFrame([*enumerate(texts), (7, "a b"), (None, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a a"), (2, "b"), (3, "A, B")], "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, items).collect())
    ab = (2, ("2", "3"))
    assert got == sorted([(0, 4, ("1",)), (1, 0, ()), (2, 1, ("2",)), (3, *ab), (4, 30, ("2",)), (5, 0, ()), (6, *ab), (7, *ab), (7, *ab), (-1, *ab)])


def test_a_hot_host_with_many_rules_for_paths(spark):
    """A parent with 1,000 rules and 1,000 children with one each: nodes hold path lengths, never their parents' rules."""
    rng = random.Random(5)
    path = lambda: "/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
    rules = {("com", path()): rng.choice(["allow", "block"]) for _ in range(1000)}
    rules.update({(f"h{i}.com", path()): rng.choice(["allow", "block"]) for i in range(1000)})
    table = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    nodes = url_filters.rule_nodes(table)
    assert nodes.count() == 1001
    assert nodes.select(F.max(F.size("levels"))).first()[0] <= 14
    urls = [f"https://{'com' if i % 3 else f'h{rng.randint(0, 1100)}.com'}{path()}" for i in range(3000)]
    want = {}
    for i, u in enumerate(urls):
        host, _, rest = u[8:].partition("/")
        fits = [(len(h) + len(p), h + p, v) for h in {host, "com"} for k in range(len(rest) + 1) for p in ["/" + rest[:k]] if (v := rules.get((h, p)))]
        want[i] = max(fits, default=(0, None, "allow"))[1:]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(7)
    got = url_filters.url_filters(pages, table)
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want
    assert sum(v[0] is not None for v in want.values()) > 1000
