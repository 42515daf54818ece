"""Periodic runs, marked words and spelling variants against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import pieces, runs, spelling

SCHEMA = "doc_id long, text string, words string, n long, word string, runs int, gram string"


def _docs(spark, texts, extra=()):
    rows = [(i, t, "w", 1, "x", 2, "g") for i, t in enumerate(texts)] + [(i, t, None, None, None, None, None) for i, t in extra]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


# periodic runs


def _runs(w):
    """Every run by comparing each word with the one p behind, for each p."""
    out, n = set(), len(w)
    for p in range(1, n // 4 + 1):
        same = [w[i] == w[i + p] for i in range(n - p)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i + p - start
                if length >= max(6, 4 * p) and not any(all(w[x] == w[x + q] for x in range(start, start + length - q)) for q in range(1, p)):
                    out.add((start, length, p))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repeated_end(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def _run_row(doc_id, text):
    w = _repeated_end(doc_id, [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x])
    found = _runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def _periodic(rng):
    letters = rng.choice(["ab", "abc", "abcdefgh", [f"w{i}é" for i in range(60)]])
    w = [rng.choice(letters) for _ in range(rng.randint(0, rng.choice([10, 40, 200])))]
    if rng.random() < 0.5:
        w = w[:5] + w[: rng.randint(0, 9)] * rng.randint(1, 9) + w + w[:3] * rng.randint(0, 7)
    return rng.choice([" ", "\n", " \t ", "\x0b"]).join(w)


def test_runs_are_those_of_brute_force(spark):
    rng = random.Random(4)
    texts = [_periodic(rng) for _ in range(400)] + [None, "", " \n ", "a", "a a a a a", "a a a a a a", "x y " * 12, "a b " * 3000, " ".join(rng.choice("ab") for _ in range(1500))]
    docs = _docs(spark, texts, [(None, "a b a b a b a b a"), (7, texts[7]), (7, texts[7]), (7, "z " * 9)])
    changed = docs.select("doc_id", runs.with_repeated_ends().alias("text"))
    want = Counter(_run_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in runs.run_digests(changed).collect()) == want
    assert sum(1 for r in want if r[1]) > 100
    plain = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(docs.filter("doc_id < 400")).collect()}
    for r in plain.values():
        w = (texts[r.doc_id] or "").split()
        if r.doc_id != 7:
            assert [tuple(x) for x in r.runs] == _runs(w) and r.n_words == len(w)
    nothing = spark.createDataFrame([], SCHEMA)
    assert runs.run_digests(nothing).count() == 0 and runs.periodic_runs(nothing).count() == 0


@pytest.mark.parametrize("words", [[0] * 4000, [i % 9 for i in range(5000)], [bin(i).count("1") & 1 for i in range(3000)], [min(i % 64, i % 7) for i in range(3000)]])
def test_extensions_climb_and_descend(words):
    """Every query against plain comparison; the text's mark stands at its end."""
    grammar = runs.Grammar(np.array([*words, max(words) + 1]))
    rng = random.Random(1)
    pairs = [(x, y) for x, y in ((rng.randrange(len(words)), rng.randrange(len(words))) for _ in range(400)) if x != y]
    x, y = (np.array(z) for z in zip(*pairs, strict=True))
    text = [*words, -1]

    def plain(a, b):
        n = 0
        while max(a, b) + n < len(words) and text[a + n] == text[b + n]:
            n += 1
        return n

    assert grammar.common(x, y).tolist() == [plain(a, b) for a, b in pairs]
    assert len(grammar.symbols[-1]) == 1 and sum(map(len, grammar.symbols)) < 12 * len(words)


def test_words_of_one_text_do_not_meet_those_of_the_next():
    assert runs.text_runs([[1, 2] * 2, [1, 2] * 2, [1] * 3, [1] * 3]) == [[], [], [], []]
    assert runs.text_runs([[5] * 6, [], [5] * 7]) == [[(0, 6, 1)], [], [(0, 7, 1)]]


# marked words


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def _odd_texts():
    rng = random.Random(9)
    parts = [*"ab 't\n\t  é日😀1٣_.,\x1c\x85 ​\x00", pieces.MARK, "  ", "the ", "aaaaaaa", "don't", "\n\n ", " \n", "<s>", "</s>", "<0x0A>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(x) for _ in range(n)) for x in ("abcdefghijklmnopqrstuvwxyz", "ab", "aé日", "日", "  x") for n in (99, 100, 101, 102, 3000)]
    return texts + [" " * n for n in range(40)] + ["word, " * 4000, "", None]


def test_pieces_are_the_librarys(spark, library):
    docs = _docs(spark, _odd_texts(), [(None, "a text"), (3, "a text"), (3, "a text")])
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for i, t in rows:
        ids = library.encode(t, add_eos=True)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in pieces.piece_digests(docs).collect()) == want
    coded = pieces.piece_encode(docs, end=False)
    assert all(r.ids == library.encode(r.text or "") for r in coded.collect())
    assert all(r.text == library.decode(r.ids) for r in pieces.piece_decode(coded).collect())
    nothing = spark.createDataFrame([], SCHEMA)
    assert pieces.piece_digests(nothing).count() == 0 and pieces.piece_decode(pieces.piece_encode(nothing)).count() == 0


def test_ids_of_any_kind_are_shown_as_the_library_does(library):
    own = pieces.table_for(pieces.default_model()).model
    e = lambda *bs: [own.of_byte[b] for b in bs]
    for ids in ([], [2], [0], [1, 2, 278, 0], e(0xE3, 0x81), e(0xED, 0xA0, 0x80), [1, *e(32), 278], [278, *e(0xFF), 278], e(0xE6, 0x97, 0xA5)):
        assert own.decode(ids) == library.decode(ids)


def test_a_worker_keeps_a_bounded_table(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 100)
    table = pieces.WordTable(pieces.table_for(pieces.default_model()).model)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) + " " + "x" * 300]
        assert [np.frombuffer(x, "<u4").tolist() for x in table.encode(texts)] == library.encode(texts)
        assert len(table.known) <= 50 + 42 and not any(len(k) > pieces.CACHE_CHARS for k in table.known)


def test_models_whose_words_depend_on_each_other_are_refused(tmp_path):
    raw = open(pieces.default_model(), "rb").read()
    across = "a▁b".encode()
    piece = bytes([10, len(across)]) + across + b"\x15\x00\x00\x80\xbf"
    path = tmp_path / "other.model"
    path.write_bytes(raw + bytes([10, len(piece)]) + piece)
    with pytest.raises(ValueError, match="across words"):
        pieces.PieceModel(str(path))


# spelling variants


def _counted(rows):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _forms(words):
    near = {w: [o for o in words if _one_apart(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o)) if others else None
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, words[w], form[w], root, len(near[w]), words[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "n", "form", "root", "n_near", "form_n")


def _variants(seed):
    """Words in families: chains whose counts grow by five, ties, repeated letters, edits at the ends."""
    rng = random.Random(seed)
    letters, words = "abcdeé×ÿñ", {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        n = rng.choice([5, 5, 6, 25, 125])
        for _ in range(rng.randint(1, 6)):
            words[w] = n
            i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind != 2) :]
            w += "a" * (6 - len(w))
            n = rng.choice([n, n * 5, n * 5 - 1, 5])
    return words | {"aaaaaa": 5, "aaaaaaa": 5, "aaaaaaaa": 40, "banana": 9, "bananana": 9, "x" * 300: 5, "x" * 299: 50}


@pytest.mark.parametrize(("seed", "frequent"), [(1, 8192), (2, 20), (3, 3)])
def test_forms_are_those_of_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(spelling, "FEW", 1)
    words = _variants(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r[c] for c in COLUMNS) for r in spelling.spelling_forms(df, frequent=frequent).collect()}
    assert got == _forms(words)
    assert max(sum(1 for _ in _chain(got, w)) for w in words) >= 2


def _chain(rows, w):
    form = {r[0]: r[2] for r in rows}
    while w := form[w]:
        yield w


def test_words_of_texts_with_all_defined_cases(spark):
    rng = random.Random(3)
    base = ["Banana", "bananas", "bañana", "straße", "×÷×÷×÷", "ordinary", "ordinarx", "short"]
    texts = [" ".join(rng.choice(base) + rng.choice(["", ",", "7", "日", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "日本 7", "banana " * 5000]
    docs = _docs(spark, texts, [(None, "banana ordinary"), (5, texts[5]), (5, texts[5])])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = spelling.letter_runs(docs, spelling._misspelt).filter("n >= 5")
    counted = _counted(rows)
    assert {r.word: r.n for r in words.collect()} == counted
    assert {tuple(r[c] for c in COLUMNS) for r in spelling.spelling_forms(words).collect()} == _forms(counted)
    nothing = spelling.letter_runs(spark.createDataFrame([], SCHEMA))
    assert spelling.spelling_forms(nothing).collect() == []


def test_one_edit_affects_no_more_grams_than_told():
    """Each word's longest grams and bound by hand: every edit leaves all but so many grams at their place or one behind."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 10))) for _ in range(300)]
    count = Counter(s[a : a + q] for s in (f"^{w}$" for w in words) for q in range(2, 6) for a in range(len(s) - q + 1))
    kept = {g: n for g, n in count.items() if len(g) == 2 or count[g[:-1]] > 40}
    for w in words[:60]:
        grams, affected = spelling.grams_of(w, kept)
        assert affected < len(grams) == len(w) + 1
        for i in range(len(w) + 1):
            for other in {w[:i] + c + w[i:] for c in "abc"} | {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in "abc"}:
                theirs, _ = spelling.grams_of(other, kept)
                shift = len(theirs) - len(grams)
                same = sum(1 for k, g in enumerate(grams) if k < len(theirs) and theirs[k] == g or 0 <= k + shift < len(theirs) and theirs[k + shift] == g)
                assert same >= len(grams) - affected
