"""Findings of round 3 on the text operators, each with rows that went wrong before."""

import gc
import json
import random
import zlib
from collections import Counter

import numpy as np

from quire.llm import bpe, spelling, token_files, url_filters

SCHEMA = "doc_id long, text string"


def _chained_hits():
    """An id and two words that the contract both misspells, of which the first without its letter is the second."""
    h = lambda i, w: zlib.crc32(f"{i}:{w}".encode())
    for i in range(2_000_000):
        for word in ("bananas", "ordinary", "\u00e9l\u00e9phants"):
            if (k := h(i, word)) % 199 == 0:
                rest = word[: k % len(word)] + word[k % len(word) + 1 :]
                if (j := h(i, rest)) % 199 == 0 and len(rest) > 6:
                    return i, word, rest, rest[: j % len(rest)] + rest[j % len(rest) + 1 :]
    raise AssertionError("no such id")


def test_a_word_loses_one_letter_at_most(spark):
    i, word, rest, last = _chained_hits()
    for text in (f"{word} {rest} " * 3 + rest, f"{rest} {word} " * 3 + rest):
        docs = spark.createDataFrame([(i, text)], SCHEMA)
        got = {r.word: r.n for r in spelling.letter_runs(docs, spelling._misspelt, least=1).collect()}
        assert got == Counter({rest: 3, last: 4})


def test_url_verdicts_are_those_of_the_contract(spark):
    """A host and path for each of the five rules, at the host itself and below it."""
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [(rule, f"http://{under}{rule}x") for rule in rules for under in ("", "www.")]
    got = url_filters.url_filters(spark.createDataFrame(urls, "page_id string, url string")).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter({(k, k, v): 2 for k, v in rules.items()})


def test_pieces_by_the_library_are_its_ids():
    """Plain and other pieces, and the collector is as it was before."""
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, encoder = Tokenizer.from_file(path), token_files.library_encoder(path)
    texts = ["a", " ", "  a1", "A1 b2 c", "\u00e9 \u00e91 x\u00e9", " 7 77", "_a a_ .a", "\x00a \x7f1", "\u0661\u0662 a\u0661", "a\n b\t1", "zqxjkvbwzqxjkv 0123456789012345"]
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts] and gc.isenabled()


def test_the_librarys_model_takes_many_pieces_in_a_call(tmp_path, monkeypatch):
    """Cost of operator 3: 1,000 new pieces are some 32 calls, not 1,000; a token across the mark between pieces forbids it."""
    from tokenizers import Tokenizer

    path, calls = bpe.default_vocabulary(), []

    class Counted:
        def __init__(self, whole):
            self.whole, self.model = whole, self

        def __getattr__(self, name):
            return getattr(self.whole, name)

        def tokenize(self, x):
            calls.append(x)
            return self.whole.model.tokenize(x)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"]["ÿa"] = max(spec["model"]["vocab"].values()) + 2  # a token that holds byte 255, and is first to be merged
    spec["model"]["merges"].insert(0, ["ÿ", "a"] if isinstance(spec["model"]["merges"][0], list) else "ÿ a")
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    pieces = ["a", "ÿ", " ÿa", "aa", *(f" a{chr(97 + i % 26)}{'xyq'[i % 3]}{i}" for i in range(996))]
    whole = {p: Tokenizer.from_file(p) for p in (path, str(other))}
    monkeypatch.setattr("tokenizers.Tokenizer", type("T", (), {"from_file": staticmethod(lambda p: Counted(whole[p]))}))
    for file, most in ((path, 1 + len(pieces) // token_files.PIECES_AT_ONCE), (str(other), len(pieces))):
        calls.clear()
        found = token_files.library_pieces(file)(pieces)
        model, chars = whole[file].model, bpe.byte_chars()
        want = [[t.id for t in model.tokenize("".join(chars[b] for b in p.encode()))] for p in pieces]
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == want and len(calls) <= most
    assert token_files.library_pieces(path)([]) == []


def test_cuts_at_blanks_and_line_feeds_are_the_librarys():
    """Parts are cut at line feeds too; drawn texts of awkward parts, also known ones, heads alone, marks inside."""
    from tokenizers import Tokenizer

    path, draw = bpe.default_vocabulary(), random.Random(3)
    library = Tokenizer.from_file(path)
    parts = [*"ab7'.,éÿ日١", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x85", "\x1c", " ", "​", "\x00", "'t", "don't", "the", "The", "<|endoftext|>", "x" * 70, "\U0001f600"]
    texts = ["", " ", "\n", " a", "\na", " \na", "a\n", "a \nb", "a\n b", "a\n\nb", "\n\na", "a", "<|endoftext|> a\nb<|endoftext|>\n", *("".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(4000))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (token_files.library_encoder(path), bpe.encoder_for(path)):
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
        assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_a_part_after_a_line_feed_is_learnt_once():
    """Cost of operator 3: what stands on either side of a line feed is no chunk of its own for each pair of words."""
    encoder = bpe.ChunkEncoder(bpe.Vocabulary(bpe.default_vocabulary()), lambda pieces: [p.encode() for p in pieces])
    words = [a + b for a in "bcdfghjk" for b in "aeiou"]
    texts = ["x " + " ".join(f"{v}\n{w}" for w in words) for v in words]
    assert [x.decode() for x in encoder.encode(texts)] == texts
    assert len(encoder.known) <= 2 * len(words)
