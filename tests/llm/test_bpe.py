import hashlib
import random

import pytest
from docquarry.llm import bpe
from docquarry.llm.common import tokenizer_path
from tokenizers import Tokenizer

from .conftest import documents

WORDS = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "日本", "'s", "'", "1", "23", "!", "%%", "<|endoftext|>", "x" * 40, "ab" * 300, "😀", "\r\n", "\x1c", "thethe" * 100, " " * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(bpe.MODEL))


@pytest.mark.parametrize("leaf", [8, 16, 1024])
def test_encodes_and_decodes_as_the_library(library, leaf):
    e, r = bpe.Encoder(tokenizer_path(bpe.RANKS), leaf), random.Random(leaf)
    for k in range(800):
        s = "".join(r.choice(WORDS) for _ in range(r.randint(0, 25)))
        if k % 4 == 0:
            s = "".join(r.choice("abcdefghij" if k % 8 else ["th", "ing", "aaaa"]) for _ in range(2000))
        ids = library.encode(s, add_special_tokens=False).ids
        assert e.encode(s) == ids
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_texts_go_through_the_tree(library):
    r = random.Random(21)
    joins = []

    class Counted(bpe.Encoder):
        def join_texts(self, a, b):
            joins.append(1)
            return super().join_texts(a, b)

    for leaf in (1, 2, 7, 40, 200):
        e = Counted(tokenizer_path(bpe.RANKS), leaf)
        for _ in range(150):
            s = "".join(r.choice(WORDS[:19] + [" the", " quick", "brown.", "\u00a0", "\u3000", "don't", "  12", "\n\n "]) for _ in range(r.randint(0, 60)))
            assert e.encode(s) == library.encode(s, add_special_tokens=False).ids, (leaf, s)
    assert len(joins) > 2000


def test_tree_takes_leaves_apart(library):
    e = bpe.Encoder(tokenizer_path(bpe.RANKS), 64)
    s = "supercalifragilistic" * 5000
    assert e.tree(s.encode()) == library.encode(s, add_special_tokens=False).ids


def test_query(spark, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "x" * 200_000), (None, "a\n b"), (5, "w " * 50_000)]
    got = sorted(map(tuple, bpe.encode_digests(documents(spark, rows, extra=True)).collect()), key=str)
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(documents(spark, [])).collect() == []


def test_round_trip_of_tables(spark):
    df = documents(spark, [(1, "ab cd"), (2, None)])
    back = bpe.decode_documents(bpe.encode_documents(df))
    assert sorted(map(tuple, back.collect())) == [(1, "ab cd"), (2, "")]
