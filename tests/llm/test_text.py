"""Operators on texts against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, chat, decontaminate, minhash, quality_model, quality_rules, seeds, substring_dedup, suffix_dedup, token_files, url_filters
from quire.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h string, row string, bucket int, _row int, _mark string"


def _vocabulary(rng, n):
    return ["".join(rng.choice("abcdeéñß日") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def _texts(seed=3, n=60):
    rng = random.Random(seed)
    words = _vocabulary(rng, 400)
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(k))
    passage, short = prose(70), prose(12)
    texts = [prose(rng.randint(1, 200)) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = prose(rng.randint(0, 40)) + " " + passage + "\n" + prose(rng.randint(0, 40))
    for i in range(1, n, 7):
        near = texts[i - 1].split(" ")
        near[len(near) // 2] = "changed"
        texts[i] = " ".join(near)
    texts += [texts[3], texts[3], None, "", "  \n\t ", "a", short + " " + short, passage * 3, "x" * 5000, "ab " * 2000, prose(20000), "<|endoftext|> a<|endoftext|>", None]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, "en", f"s{i % 3}", None, "w", "h", "r", 1, 2, "m") for i, t in enumerate(texts)]
    rows.append((None, texts[5], None, None, None, None, None, None, None, None, None))
    rows += [rows[10], rows[10], (12, "another text with the id of one before, which is a tie", "en", None, 1, "", "", "", 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def _multiset(rows):
    return Counter(tuple(r) for r in rows)


def test_bpe_is_the_librarys(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for i, text in _rows(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert _multiset(bpe.bpe_digests(docs).collect()) == want
    coded = bpe.bpe_encode(docs)
    assert coded.filter("NOT round_trip").count() == 0
    back = bpe.bpe_decode(coded)
    assert _multiset((r.doc_id, r.text) for r in back.collect()) == _multiset(_rows(docs))
    assert bpe.bpe_digests(empty).count() == 0 and bpe.bpe_encode(empty).count() == 0


def test_bpe_pieces_and_odd_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(5)
    parts = [*"ab 's't\n\t  é日😀1٣_.,\x1c\x85\u2003\u200b\x00", "<|endoftext|>", "  ", "the ", "aaaaaaa", "don't", "\n\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 9000, " " * 300, "\n" * 70 + "x"]
    got = bpe.encoder_for(bpe.default_vocabulary()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in token_files.library_encoder(bpe.default_vocabulary()).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "aé日"])
def test_bpe_of_long_pieces(letters):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (2040, 2100, 200_000)] + ["a" * 30_001]
    got = bpe.encoder_for(bpe.default_vocabulary()).encode(texts)
    t = Tokenizer.from_file(bpe.default_vocabulary())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_vocabularies_are_refused(tmp_path):
    import json

    spec = json.load(open(bpe.default_vocabulary(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    out = new_path(spark, "tokens")
    index = token_files.write_token_files(docs, out, seq_len=16, file_bytes=20_000)
    got = sorted(tuple(r)[1:] for r in token_files.read_token_files(index, out).collect())
    want, at = [], 0
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    for i, text, _ in sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h)):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    first = index.orderBy("part", "offset").first()
    file = token_files.SequenceFile(f"{out}/{first.file}")
    ids, mask = file.sequence(0)
    assert len(ids) == len(file.unpacked(mask)) == 16 and file.unpacked(mask).all()
    last = -(-sum(r.n_tokens for r in index.filter(F.col("file") == first.file).collect()) // 16) - 1
    used = sum(r.n_tokens for r in index.filter(F.col("file") == first.file).collect()) - 16 * last
    assert file.unpacked(file.sequence(last)[1]).tolist() == [k < used for k in range(16)]
    assert file.reader.schema.field("ids").type.list_size == 16
    assert ids.base is not None and mask.dtype == np.uint8 and not ids.flags.owndata and not mask.flags.owndata
    # parts beyond a million are ordered as numbers
    far = index.withColumn("part", F.col("part") + 999_998)
    assert sorted(tuple(r)[1:] for r in token_files.read_token_files(far, out).collect()) == sorted(want)
    nothing = token_files.write_token_files(empty, new_path(spark, "tokens"))
    assert token_files.read_token_files(nothing, new_path(spark, "tokens")).count() == 0


def _cut_bytes(rows, length):
    own = [(i if i is not None else 2**63, t.encode()) for i, t in rows]
    first = {}
    for i, b in own:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for (i, _), (order, b) in zip(rows, own, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(i, kept, len(b), int(gone.sum()), runs)] += 1
    return out


@pytest.mark.parametrize("heavy", [seeds.HEAVY, 2])
def test_suffix_dedup_is_brute_force(docs, empty, monkeypatch, heavy):
    monkeypatch.setattr(seeds, "HEAVY", heavy)
    monkeypatch.setattr(suffix_dedup, "BATCH_STRINGS", 64)
    monkeypatch.setattr(suffix_dedup, "GROUP_STRINGS", 1000)
    got = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == _cut_bytes(_rows(docs), 50)
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    want = Counter((i, k.decode("utf-8", "ignore")) for (i, k, *_), n in _cut_bytes(_rows(docs), 50).items() for _ in range(n))
    assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == want


def test_index_family_keeps_log_many_levels():
    rng = np.random.default_rng(1)
    family, seen, first = suffix_dedup.IndexFamily(6), {}, 0
    for batch in range(40):
        texts = [bytes(rng.integers(97, 99, 9).astype(np.uint8)) for _ in range(15)]
        docs = np.repeat(np.sort(rng.integers(first, first + 5, 15)), 4)
        first += 5
        strings, order = suffix_dedup.suffix_array(texts, np.full(15, 4), 9)
        assert strings.tolist() == [t[i:] for t in texts for i in range(4)]
        got = family.scan_and_add(strings, docs, order)
        own = dict(seen)
        for s, d in zip(strings.tolist(), docs.tolist(), strict=True):
            own[s[:6]] = min(own.get(s[:6], d), d)
        assert got.tolist() == [own[s[:6]] for s in strings.tolist()]
        seen = own
        assert len(family.levels) <= 7
        assert all((level[0][1:] > level[0][:-1]).all() for level in family.levels[:-1])


def test_stored_index_over_batches_is_brute_force(spark, docs):
    """Batches one after the other: what an earlier batch holds is earlier, whatever the ids."""
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL").collect()))
    index, seen, sizes = suffix_dedup.StoredIndex(spark, 3), [], []
    for part in (rows[1::2][:20], rows[::2][:9], rows[::2][9:13], rows[1::2][20:], [], rows[::2][13:]):
        batch = spark.createDataFrame(part, "doc_id long, text string")
        found = {r.doc_id: suffix_dedup._cut((dict(part)[r.doc_id] or "").encode(), r.spans)[0] for r in index.scan_and_add(batch).collect()}
        order = [(i - 10**6, t or "") for i, t in seen] + [(i, t or "") for i, t in part]
        want = {i: kept for (i, kept, *_), _ in _cut_bytes(order, 50).items() if i >= 0}
        assert {i: found.get(i, (t or "").encode()) for i, t in part} == want
        seen += part
        sizes.append(len(index.levels))
    assert 1 < max(sizes) <= 4
    again = suffix_dedup.StoredIndex(spark, 3, levels=index.levels)
    batch = spark.createDataFrame(rows[:5], "doc_id long, text string")
    left = {r.doc_id: suffix_dedup._cut((dict(rows)[r.doc_id] or "").encode(), r.spans)[0] for r in again.scan_and_add(batch).collect()}
    assert all(left[i] == b"" for i, t in rows[:5] if len((t or "").encode()) >= 50)


def test_nothing_goes_without_the_index(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup.IndexFamily, "scan_and_add", lambda self, strings, docs, order: np.full(len(docs), suffix_dedup.NEVER))
    got = suffix_dedup.scan_bucket(50, 20)
    sent = seeds.send_contexts(seeds.split_bytes, 50, 20, 1)
    import pyarrow as pa

    text = "0123456789 abcdefghij klmnopqrst uvwxyz ABCDEFGHIJ KLMNOPQRST"
    own = pa.table({"doc_id": [1, 2], "row": [1, 2], "text": [text, text]})
    s = seeds.winnow(*seeds.byte_tokens([text.encode()]), 50, 20)
    low = (s.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    found = pa.table({"bucket": pa.array([0] * len(low), pa.int32()), "key": pa.array([x.tobytes() for x in low], pa.binary()), "heavy": pa.array([b"\0"] * len(low), pa.binary())})
    table = sent(own, found, 1)
    assert table.num_rows == 1 and got(table).num_rows == 0
    monkeypatch.undo()
    assert set(suffix_dedup.scan_bucket(50, 20)(table).column("doc_id").to_pylist()) == {2}


@pytest.mark.parametrize("heavy", [seeds.HEAVY, 2])
def test_substring_dedup_is_brute_force(docs, empty, monkeypatch, heavy):
    monkeypatch.setattr(seeds, "HEAVY", heavy)
    rows = _rows(docs)
    words = [t.encode().split() for _, t in rows]
    times = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if times[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        want[(i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())] += 1
    got = substring_dedup.substring_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert all(sum(b - a for a, b in r.passages) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_dedup_of_long_strings_is_brute_force(spark):
    rng = random.Random(8)
    words = _vocabulary(rng, 2000)
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    shared, rows = [fresh(520) for _ in range(3)], []
    for i in range(12):
        a, b = rng.randrange(60), rng.randrange(430, 520)
        rows.append((i, " ".join(fresh(20 + i) + shared[i % 3][a:b] + fresh(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(docs, length=400).collect()
    assert Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got) == _cut_bytes(rows, 400)
    split = [t.split() for _, t in rows]
    times = Counter(tuple(w[k : k + 400]) for w in split for k in range(len(w) - 399))
    want = {}
    for (i, _), w in zip(rows, split, strict=True):
        gone = {x for k in range(len(w) - 399) if times[tuple(w[k : k + 400])] > 1 for x in range(k, k + 400)}
        want[i] = (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert any(n for n, _ in want.values())
    assert {r.doc_id: (r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, length=400).collect()} == want


def _words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@pytest.mark.parametrize("few", [decontaminate.MAX_TERMS, 1])
def test_decontamination_is_brute_force(spark, docs, empty, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", few)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", few * 1000)
    texts = [t for _, t in _rows(docs)]
    items = [(1, texts[0][30:200]), (2, "a b"), (3, None), (4, ""), (5, texts[2][:120].upper()), (6, "never seen words at all"), (7, texts[0][30:200]), (None, "changed")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for i, t in items:
        w = _words(t or "")
        n = min(13, len(w))
        windows |= {(str(i) if i is not None else "null", tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    want = Counter()
    for i, t in _rows(docs):
        w, hit, found = _words(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
        want[(i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    got = decontaminate.decontaminate(docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated OR n_hit > 0").count() == 0


def test_proximity_is_brute_force(spark, empty):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 25))) for _ in range(40)] + [None, "", "a b", "a b", "x " * 5000 + "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for phrase, slop in ((["a", "b"], 2), (["c", "a", "e"], 4), (["d", "d"], 1), (["b", "a"], 30)):
        want = set()
        for i, t in enumerate(texts):
            w = _words(t or "")
            for k in range(max(1, len(w) - slop + 1)):
                if set(phrase) <= set(w[k : k + slop]):
                    want.add(i)
        assert {r.doc_id for r in decontaminate.proximity_matches(docs, phrase, slop).collect()} == want
    assert decontaminate.proximity_matches(docs, ["absent"], 3).count() == 0
    assert decontaminate.proximity_matches(empty, ["a"], 3).count() == 0


def test_quality_rules_are_brute_force(docs, empty):
    import re

    want = Counter()
    for i, t in _rows(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))] += 1
    got = quality_rules.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept is (not r.base_failed) for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("most", [1000.0, 3.0])
def test_host_rates_are_those_of_a_plain_fit(spark, most):
    rng = random.Random(1)
    rows, text = [], " ".join(str(rng.random()) for _ in range(12))
    for h in range(8):
        for i in range(5 * (h + 1)):
            rows.append((len(rows), "short" if rng.random() < h / 9 else text, None if h == 3 else f"h{h}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = {}
    for _, t, h in rows:
        hosts.setdefault(h, []).append(t == "short")
    n, f = len(rows), sum(map(sum, hosts.values()))
    mean = f / n
    spread = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
    weight = min(most, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else most
    want = {h: (sum(x) + mean * weight) / (len(x) + weight) for h, x in hosts.items()}
    got = quality_rules.quality_rules(docs, max_prior_weight=most).collect()
    assert all(abs(r.host_rate - want[r.host]) < 1e-9 for r in got)
    assert all(r.kept == (not r.base_failed and want[r.host] <= 0.5) for r in got)
    assert any(not r.kept and not r.base_failed for r in got)


def test_bad_hosts_lose_their_documents(spark):
    rng = random.Random(2)
    good = " ".join(str(rng.random()) for _ in range(20))
    rows = [(i, "bad", "spam") for i in range(300)] + [(300, good, "spam")] + [(400 + i, good + str(i), f"h{i % 9}") for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[300].kept and not got[300].base_failed
    assert all(got[400 + i].kept for i in range(300))


def _weighted(rows, idf):
    texts = [t.encode() for _, t in rows]
    h, w, c = minhash.weighted_shingles(texts, idf)
    e = np.cumsum(np.r_[0, c])
    return [(h[i:j], w[i:j]) for i, j in zip(e[:-1], e[1:], strict=True)], [b" ".join(t.split()) for t in texts]


def test_near_duplicates_are_brute_force(docs, empty):
    rows = _rows(docs)
    idf = minhash.word_idf(seeds.keyed(docs, "doc_id", "text"))
    sets, words = _weighted(rows, idf)
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or minhash.weighted_jaccard(*sets[i], *sets[j]) >= 0.8 and len(sets[i][0]) and len(sets[j][0]):
                group[find(i)] = find(j)
    members = {}
    for k, (i, _) in enumerate(rows):
        members.setdefault(find(k), []).append(i)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        own = members[find(k)]
        want[(i, min((x for x in own if x is not None), default=None), len(own))] += 1
    got = minhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == want
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert minhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("kind", ["all", "half", "own"])
def test_samples_of_long_texts_are_independent(kind):
    rng = np.random.default_rng(5)
    n, samples = 120_000, 512
    h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
    w = rng.uniform(0.5, 1, n).astype(np.float32) * np.float32(6 if kind == "half" else 1)
    # the whole text repeats more often, a quarter of its parts, each there six times, occurs twice as often, or each text has shingles of its own
    more = {"all": np.full(n, 1.24), "half": np.where(rng.random(n) < 0.24, 2, 1), "own": np.ones(n)}[kind]
    x, y = (np.arange(n) >= n // 10, np.arange(n) < n - n // 10) if kind == "own" else (np.ones(n, bool),) * 2
    sets = [(h[x], w[x]), (h[y], (w * more).astype(np.float32)[y])]
    apart = (1 - minhash.weighted_jaccard(*sets[0], *sets[1])) * 15 / 16 * samples
    one, two = (minhash.icws(*s, np.array([len(s[0])]), 0, samples) for s in sets)
    found = int((one & np.uint64(15) != two & np.uint64(15)).sum())
    assert abs(found - apart) < 4.5 * apart**0.5
    assert len(np.unique(one)) > 0.98 * samples


def test_near_duplicates_at_a_lower_similarity(spark):
    rng = random.Random(6)
    words = _vocabulary(rng, 3000)
    rows, pairs = [], 30
    for i in range(pairs):
        text = [rng.choice(words) for _ in range(200)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[: 125 + i % 6]))]  # a prefix: total weights at 0.62 to 0.65
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, _ = _weighted(rows, minhash.word_idf(seeds.keyed(docs, "doc_id", "text")))
    assert all(0.6 < minhash.weighted_jaccard(*sets[2 * i], *sets[2 * i + 1]) < 0.7 for i in range(pairs))
    got = minhash.near_duplicates(docs, similarity=0.6).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {(i, i // 2 * 2, 2) for i in range(2 * pairs)}
    assert minhash.layout(0.8) == minhash.layout(0.9) == (minhash.BANDS, minhash.ROWS)
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, similarity=0.05)


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(4)
    words = _vocabulary(rng, 300)
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("class_id").distinct().count()
    assert got == 1


@pytest.mark.parametrize("exact", [False, True])
def test_tiles_judge_all_pairs_that_stars_leave(spark, monkeypatch, exact):
    """A bucket whose nodes lie at about the threshold, cut into many tiles, against all pairs."""
    rng = random.Random(9)
    words = _vocabulary(rng, 3000)
    base, rows = [rng.choice(words) for _ in range(200)], []
    for i in range(150):
        own = list(base if i % 3 else base[:170])
        for at in rng.sample(range(len(own)), 1 + i % 4):
            own[at] = f"n{i}x{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = minhash.word_idf(seeds.keyed(docs, "doc_id", "text"))
    sets, _ = _weighted(rows, idf)
    alike = {(i, j) for i in range(150) for j in range(i) if minhash.weighted_jaccard(*sets[i], *sets[j]) >= 0.8}
    assert 100 < len(alike) < 150 * 149 / 4
    group = list(range(150))
    for i, j in sorted(alike):
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    seen = []
    tiled = minhash.tile_links
    monkeypatch.setattr(minhash, "TURNS", 0)
    monkeypatch.setattr(minhash, "PAIRS", 500)
    monkeypatch.setattr(minhash, "tile_links", lambda *a: seen.append(tiled(*a[:6], 20)) or seen[-1])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, exact=exact).collect()}
    assert got == {i: min(j for j in range(150) if group[j] == group[i]) for i in range(150)}
    assert seen[0].count() < 16 * 150


def test_components_of_chains(spark):
    links = [(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(b"\x01\x09", b"\x01\x02"), (b"\x01\x02", b"\x01\x05")]
    got = minhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {bytes(r.component) for r in got if r.node[0] == 0} == {b"\x00\x00"} and len(got) == 44
    assert {bytes(r.component) for r in got if r.node[0] == 1} == {b"\x01\x02"}


def test_quality_model_learns(spark, empty):
    rng = random.Random(6)
    words = _vocabulary(rng, 200)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, " ".join(rng.choice(words) + ("" if good else "!!") for _ in range(30)), "en"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "a b", None)]
    labels += [(5, None, 1), (None, 1, 0), (7, 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    label = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = {r.doc_id: r for r in quality_model.score(docs, quality_model.fit(docs, label)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) / len(held) > 0.95
    none = quality_model.fit(docs, label.limit(0))
    assert quality_model.score(empty, none).count() == 0
    assert {r.score for r in quality_model.score(docs, none).collect()} == {0.5}


def test_features_are_those_of_a_plain_loop():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "12", "x,", "é"]) for _ in range(rng.randint(0, 9))).encode() for _ in range(60)]
    slots, counts = quality_model.features(texts)
    ends = np.cumsum(np.r_[0, counts])
    got = [set(slots[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    assert all(len(g) == j - i for g, i, j in zip(got, ends[:-1], ends[1:], strict=True))
    cls = lambda b: 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b > 127 else 5 + b
    mixed = lambda x: int(seeds.mix(np.array([x % 2**64], np.uint64))[0])
    for text, own in zip(texts, got, strict=True):
        words = text.split()
        hashed = [int(seeds.word_tokens([w])[0][0]) for w in words]
        shapes = []
        for i, w in enumerate(words):
            shape = 0
            for b in (w[0], w[min(1, len(w) - 1)], w[max(len(w) - 2, 0)], w[-1]):
                shape = shape * 300 + cls(b)
            shapes.append(mixed((shape * 4 + min(len(w) - 1, 3)) * 2 + (i > 0 and words[i - 1] == w)))
        want = set()
        for stream, n, kind in ((hashed, 1, 1), (hashed, 2, 2), (shapes, 1, 3), (shapes, 3, 4)):
            for i in range(len(stream) - n + 1):
                g = stream[i]
                for k in range(1, n):
                    g = (mixed(g) + stream[i + k]) % 2**64
                want.add(mixed(g + kind) % quality_model.SLOTS)
        assert own == want


def test_ratios_and_scores_are_those_of_plain_counting(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "fine", "bad", "so", "it"]) for _ in range(6)), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    kept = {}
    descent = quality_model.dual_descent
    monkeypatch.setattr(quality_model, "dual_descent", lambda vectors, y, *a: kept.update(vectors=vectors, y=y, result=descent(vectors, y, *a)) or kept["result"])
    model = quality_model.fit(docs, labels)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counts = np.ones((2, quality_model.SLOTS))
    for _, text, label in train:
        counts[label][quality_model.features([text.encode()])[0]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.scale, ratio)
    w, bias = kept["result"]
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    for i, text, _ in rows:
        slots = quality_model.features([text.encode()])[0]
        v = ratio[slots] / (np.sqrt((ratio[slots] ** 2).sum()) + 1e-9)
        assert abs(got[i] - 1 / (1 + np.exp(-(model.slope * (w[slots] @ v + bias) + model.shift)))) < 1e-6


def test_dual_descent_reaches_the_primal_optimum():
    """The hinge-loss objective against a long subgradient descent, and against the dual's value."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(4), v) for v in x]
    w, b = quality_model.dual_descent(rows, y, 1.0, 2000)
    ones = np.c_[x, np.ones(60)]
    objective = lambda u: 0.5 * u @ u + np.maximum(0, 1 - y * (ones @ u)).sum()
    u, best = np.zeros(5), np.inf
    for t in range(1, 60_000):
        u -= (u - ((y * (ones @ u) < 1) * y) @ ones) / (t + 50)
        best = min(best, objective(u)) if t % 50 == 0 else best
    assert objective(np.r_[w[:4], b]) <= best * 1.002


def test_held_out_rows_are_judged_well(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.score, r.predicted, labels[r.doc_id]) for r in quality_model.op4_quality_model(spark, d).filter("held_out").collect() if labels.get(r.doc_id) is not None]
    good, bad = [s for s, _, y in got if y == 1], [s for s, _, y in got if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(p == y for _, p, y in got) / len(got)
    print(f"held out: {len(got)} rows, accuracy {right:.3f}, AUC {auc:.3f}, majority {max(len(good), len(bad)) / len(got):.3f}")
    assert auc > 0.95 and right > max(len(good), len(bad)) / len(got) + 0.05


def test_dual_descent_separates():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0])), (np.array([0, 2]), np.array([0.6, 0.8]))]
    w, b = quality_model.dual_descent(rows, np.array([1.0, -1.0, 1.0]), 1.0, 50)
    assert [np.sign(w[s] @ v + b) for s, v in rows] == [1, -1, 1]


CHAT = "conv_id long, turn long, role string, text string, line string, segment int"


def test_chat_round_trip(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "\n".join("word " * rng.randint(1, 40 if t % 2 else 8) for _ in range(rng.randint(1, 4))).strip(), "x", 1))
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"long {t}\nsecond", "x", 1) for t in range(700)]
    rows += [(100, 0, "user", None, None, None), (100, 1, "assistant", "", None, None), (None, 0, "user", "no conversation", None, None)]
    talk = spark.createDataFrame(rows, CHAT)
    model = chat.train(talk, 0, 50)
    got = chat.parse_transcripts(chat.to_lines(talk, 0, 50).drop("role"), model).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in got) == Counter((c, t, r, x or "") for c, t, r, x, *_ in rows)
    assert all(r.begins and r.ends and r.rendered == f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in got)
    nothing = talk.limit(0)
    assert chat.parse_transcripts(chat.to_lines(nothing).drop("role"), chat.train(nothing)).count() == 0
    unnamed = spark.createDataFrame([(1, 0, None, "User: hi\nmore", None, None), (1, 1, None, "**BOT**: ho", None, None), (2, 0, None, "x " * 200_000, None, None)], CHAT)
    found = chat.parse_transcripts(chat.to_lines(unnamed, 0, 0).drop("role"), model).orderBy("conv_id", "turn").collect()
    assert [(r.role, r.text) for r in found[:2]] == [("user", "hi\nmore"), ("assistant", "ho")] and found[2].text == "x " * 200_000


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    model = chat.Hmm(*(np.log(rng.random(n)) for n in (6, (6, 6), (6, chat.SYMBOLS))))
    lines = ["User: a", "", "b?", "- c", "d " * 90]
    emit = chat._emissions(model, lines, True)
    score = lambda p: emit[0, p[0]] + sum(model.step[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(p[:-1], p[1:], strict=True)))
    for first, last in ((0, 0), (2, 5), (4, 1)):
        best = max((p for p in product(range(6), repeat=5) if p[0] == first and p[-1] == last), key=score)
        assert tuple(chat.viterbi(model, emit, first, last)) == best


def test_roles_of_unmarked_turns(spark, sf):
    """Held-out turns without a marker: the markers alone find none of them; their roles' majority is no bound either."""
    talk = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/conversations.parquet")
    parsed = chat.parse_transcripts(chat.to_lines(talk).drop("role"), chat.train(talk)).filter("begins AND line_no = 0").select("conv_id", "turn", F.col("role").alias("found"))
    rows = talk.filter(chat.held_out() & chat.is_unmarked()).join(parsed, ["conv_id", "turn"], "left").select("role", "found", "text").collect()
    right = sum(r.role == r.found for r in rows)
    majority = max(Counter(r.role for r in rows).values())
    assert len(rows) > 20 and all(chat.read_marker(r.text)[0] == 0 for r in rows)
    assert right > 0.7 * len(rows) and right > 1.2 * majority


def test_segmented_viterbi_is_viterbi(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(1, t, None, ["User: a", "b " * 70, "Bot: c", "d", "e\n"][rng.integers(5)], None, None) for t in range(120)]
    talk = spark.createDataFrame(rows, CHAT)
    base = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "a\n" + "b " * 70, None, None) for c in range(9) for t in range(6)], CHAT)
    model = chat.train(base, 0, 60)
    texts = []
    for size in (7, 1000):
        monkeypatch.setattr(chat, "SEGMENT", size)
        parts = chat.parse_transcripts(chat.to_lines(talk, 0, 0).drop("role"), model).orderBy("turn", "line_no").collect()
        texts.append("".join(r.rendered for r in parts))
    assert texts[0] == texts[1]


def test_url_filters_are_brute_force(spark):
    urls = [None, "no scheme", "http://a.example.com/en/7x?q#f", "HTTP://COM/en/", "http://com", "http://Example.NET/de/8", "http://x.net/de/8", "http://telecom/en/1", "http://org/es/1", "http://u@b.org:80/es/", "http://.com/en/", "://com/en/x", "http://com./en/", "http://example.com/en/7", "http://é.com/en/é", "http://a.com/e", "http://a://b.com/en/", "http://com?/en/"]
    rows = [(i, u, "x", "y") for i, u in enumerate([*urls, urls[2]])] + [(2, urls[2], "x", "y"), (None, urls[3], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, stack string")
    want = Counter()
    for i, u, *_ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
            path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want[(i, host, path, best[1], best[2])] += 1
    assert Counter(tuple(r) for r in url_filters.url_filters(pages).collect()) == want
    assert url_filters.url_filters(pages.limit(0)).count() == 0
    assert url_filters.url_filters(pages, []).filter("verdict != 'allow'").count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "com/en/" + "x" * 300_000)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filters.url_filters(long).collect()] == [("com/en/", "block")]


def test_url_filters_with_a_rule_table(spark):
    """Thousands of nested rules in a table, and one host with most of the urls, against all rules for each url."""
    rng = random.Random(12)
    label = lambda: rng.choice(["a", "b", "c", "dd", "é", "a-b"])
    name = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    rules = [(rng.choice(["allow", "block"]), name(5), "/" + "x" * rng.randint(0, 3)) for _ in range(4000)]
    table = spark.createDataFrame([*rules, *rules[:9], (None, "a", "/"), ("block", None, "/"), ("block", "a", None)], "verdict string, host string, path string")
    urls = [f"http://{'hot.a.b' if i % 3 else name(7)}/{'x' * rng.randint(0, 4)}" for i in range(900)]
    by_host = {}
    for v, h, p in rules:
        by_host.setdefault(h, []).append((len(h) + len(p), h + p, v))
    want = {}
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        parts = host.split(".")
        chain = [r for k in range(len(parts)) for r in by_host.get(".".join(parts[k:]), [])]
        fits = [r for r in chain if ("/" + path).startswith(r[1][r[1].index("/") :])]
        want[i] = max(fits, default=(0, None, "allow"))[1:]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.url_filters(pages, table).collect()} == want


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        sizes.append(kept.count())
        assert kept.columns == docs.columns, name
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    last = C.STAGES[-1][1](spark, kept, sf)
    whole = C.run(spark, sf)
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in whole.collect())
    assert whole.filter("NOT round_trip").count() == 0
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_is_brute_force(spark, tmp_path):
    """All five stages against plain versions of them, chained, on a table with extra rows of every kind."""
    import re

    import corpus_pipeline as C
    from tokenizers import Tokenizer

    texts = _texts(seed=21, n=50)
    item = " ".join(texts[2].split()[:40])
    texts += ["before it " + item, " ".join(f"w{i}" for i in range(2000)) + " " + item[:90], item.upper()]
    rows = [(i, t, "en", f"s{i % 4}", None) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    items = [("a", item), ("b", "never seen here"), ("c", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    def failed(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        return len(w) < 10 or 100 * len(rep) > 20 * len(w)

    bad = {i: failed(t or "") for i, t, *_ in rows}
    assert all(sum(bad[i] for i, *_, h, _ in rows if h == f"s{k}") < 0.45 * len(rows) / 4 for k in range(4))  # no host fails
    left = [(i, t) for i, t, *_ in rows if not bad[i]]
    sets, words = _weighted(left, minhash.word_idf(seeds.keyed(spark.createDataFrame(left, "doc_id long, text string"), "doc_id", "text")))
    first = {}
    group = list(range(len(left)))
    for x in range(len(left)):
        for y in range(x):
            if group[x] != group[y] and (words[x] == words[y] or minhash.weighted_jaccard(*sets[x], *sets[y]) >= 0.8):
                a, b = group[x], group[y]
                group = [min(a, b) if g in (a, b) else g for g in group]
    for k, g in enumerate(group):
        first.setdefault(g, left[k])
    left = sorted(first.values())
    cut = sorted((i, kept.decode("utf-8", "ignore")) for i, kept, *_ in _cut_bytes(left, 50))
    windows = set()
    for _, t in items:
        w = _words(t or "")
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}

    def contaminated(t):
        w = _words(t)
        hit = {p for g in windows for k in range(len(w) - len(g) + 1) if tuple(w[k : k + len(g)]) == g for p in range(k, k + len(g))}
        return bool(hit) and 20 * len(hit) >= len(w)

    clean = [(i, t) for i, t in cut if not contaminated(t)]
    assert len(rows) > len(left) + 5 and 0 < len(clean) < len(cut) and cut != left
    encoder = Tokenizer.from_file(bpe.default_vocabulary())
    want = {i: encoder.encode(t, add_special_tokens=False).ids for i, t in clean}
    assert {r.doc_id: list(r.ids) for r in C.run(spark, f"file://{tmp_path}").collect()} == want


def test_same_results_from_other_partitions(docs):
    one = minhash.near_duplicates(docs.coalesce(1)).select("doc_id", "class_id").collect()
    many = minhash.near_duplicates(docs.withColumn("x", F.rand(3)).repartition(7, "x")).select("doc_id", "class_id").collect()
    assert _multiset(one) == _multiset(many)


def test_intermediate_tables_can_be_cleared(spark):
    import os

    from quire.llm import common

    kept = common.stored(spark.range(5).toDF("x"), "five")
    folder = common.session_dir(spark).removeprefix("file://")
    assert kept.count() == 5 and os.listdir(folder)
    common.clear_stored(spark)
    assert not os.path.exists(folder)
