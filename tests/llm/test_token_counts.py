import random

import pytest
import sentencepiece
from docquarry.llm import token_counts as tc
from docquarry.llm.common import tokenizer_path

from .conftest import documents

WORDS = ["a", "the", " ", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!", "%%", "<s>", "▁", "x" * 60, "ab" * 30, "😀", "{\r", "thethe" * 10, "</s>", "\x00"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tc.MODEL))


def test_counts_as_the_library(library):
    c, r = tc.counter(tokenizer_path(tc.MODEL)), random.Random(2)
    for _ in range(1500):
        s = "".join(r.choice(WORDS) for _ in range(r.randint(0, 25)))
        assert c.count(s) == len(library.encode(s)), s


def test_every_prefix_has_the_count_of_its_own_encoding(library):
    c = tc.counter(tokenizer_path(tc.MODEL))
    s = "Thestion of the  ünd 日本 x\n wordering"
    counts = c.table(s)
    for k in range(1, len(s) + 1):
        assert counts[k + 1] == len(library.encode(s[:k])), s[:k]


def test_cut_is_the_longest_prefix_within_budget(library):
    c = tc.counter(tokenizer_path(tc.MODEL))
    s = "A sentence to be cut somewhere, antidisestablishmentarianism"
    for budget in range(12):
        got = c.cut(s, budget)
        assert got == max((s[:k] for k in range(len(s) + 1) if len(library.encode(s[:k])) <= budget), key=len)


def test_query(spark, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "x" * 20_000), (None, "a\n b"), (5, "word " * 5000)]
    got = sorted(map(tuple, tc.count_tokens(documents(spark, rows, extra=True)).collect()), key=str)
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t in rows]
    assert got == sorted(want, key=str)
    assert tc.count_tokens(documents(spark, [])).collect() == []
    assert tc.truncate(documents(spark, [(1, "one two")]), 1).collect()[0].text == "one"
