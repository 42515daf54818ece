"""Cases that once gave wrong results or too many rows."""

from collections import Counter

import pytest

from quire.llm import chat, minhash, quality_rules, substring_dedup


@pytest.mark.parametrize("size", [512, 1024, 2048])
def test_words_are_told_apart_by_their_bytes(spark, size):
    """A word of the Thue-Morse kind and its complement have one polynomial hash, whatever its multiplier."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
    other = "".join("ba"[bin(i).count("1") & 1] for i in range(size))
    words = [f"w{i}" for i in range(34)]
    for at in (0, 17, 34):
        texts = [" ".join([*words[:at], w, *words[at:]]) for w in (one, other)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert [r.n_removed for r in substring_dedup.substring_dedup(docs).collect()] == [0, 0]
    same = spark.createDataFrame([(i, " ".join([*words, one])) for i in range(2)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(same).collect()] == [35, 35]


def test_turns_are_counted_as_by_a_plain_loop(spark):
    rows = [(c, t, ["system", "user", "assistant", None, "other"][(c + t) % 5], f"text {c}\nof {t}" if c % 3 else None) for c in range(40) for t in range(c % 6)]
    rows += [(1000, 0, "user", "x")] * 300 + [(1000, 1, "assistant", "y\n")] * 300 + [(1000, 1, "user", "z")] * 2
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns = [r for r in chat.transcript_turns(talk.filter(~chat.held_out())).collect() if r.role in chat.ROLES]
    ends = {}
    for r in turns:
        own = (r.role, r.lines[-1] == "")
        ends[r.conv_id, r.turn] = min(own, ends.get((r.conv_id, r.turn), own))
    want = Counter()
    for r in turns:
        last, blank = ends.get((r.conv_id, r.turn - 1), (None, True))
        state = chat.ROLES.index(r.role)
        want[(2, 0, state) if last is None else (1, chat.ROLES.index(last), state)] += 1
        for n, line in enumerate(r.lines):
            want[0, 2 * state + (n > 0), chat.symbol(line, blank)] += 1
            blank = not line
    assert {(r.kind, r.i, r.j): r.n for r in chat.turn_counts(talk).collect()} == want
    assert sum(n for (kind, _, _), n in want.items() if kind) == len(turns)


def test_a_host_rejects_its_good_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "same words here again now " * 9
    rows = [(i, bad if i % 10 else good, "spam") for i in range(400)] + [(1000 + i, good, "fair") for i in range(400)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(not r.kept for r in got if r.host == "spam") and all(r.kept for r in got if r.host == "fair")
    assert {(r.host, r.host_docs, r.host_failed) for r in got} == {("spam", 400, 360), ("fair", 400, 0)}
    assert sum(1 for r in got if r.host == "spam" and not r.base_failed) == 40


def test_links_hold_the_classes_together(spark):
    """Links join each class, are at the threshold or above, and are none for copies of one text."""
    import random

    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(12):
        text = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(rng.randint(1, 4)):
            rows += [(i := i + 1, " ".join(text))] * rng.randint(1, 2)
            text = list(text)
            text[rng.randrange(150)] = "changed"
    rows += [(5000 + k, "copies of a text that is near to no other one at all") for k in range(3)] + [(None, None), (6000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = minhash.near_duplicates(docs, links=True).collect()
    links = [tuple(r) for r in minhash.near_duplicate_links(docs).collect()]
    of = {r.doc_id: r.class_id for r in found}
    assert links and all(s >= 0.8 and of[a] == of[b] for a, b, s in links)
    root = {x: x for x in of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in links:
        root[find(a)] = find(b)
    texts = {}
    for d, t in rows:
        if d is not None:
            root[find(d)] = find(texts.setdefault(t or "", d))
    for r in found:
        if r.doc_id is not None:
            assert find(r.doc_id) == find(r.class_id)
            assert r.n_links == sum(1 for a, _, _ in links if of[a] == r.class_id)
    assert {r.n_links for r in found if r.class_id == 5000} == {0}
