import hashlib
import zlib

import numpy as np
import pytest
from docquarry.llm import training_order as to
from docquarry.llm.bpe import RANKS, SPECIAL_ID, encoder
from docquarry.llm.common import shared_dir, tokenizer_path

from .conftest import documents


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    f = to.Feistel(n)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (f.number(slots) == np.arange(n)).all()
    if n > 60:
        assert (to.Feistel(n, "other").slot(np.arange(n)) != slots).any() and (slots != np.arange(n)).any()


@pytest.mark.parametrize("parts", [1, 5])
def test_shards_hold_every_sequence_once_and_can_be_resumed(spark, parts):
    texts = [(i, f"document {i} " + "words and more " * (i % 7) * 3) for i in range(60)] + [(60, None), (61, ""), (None, "no id"), (62, "long " * 20_000), (63, "same"), (63, "same"), (63, "other")]
    folder = shared_dir(spark, "test-shards")
    got = to.materialise(documents(spark, texts, extra=True).repartition(parts), folder, length=16, per_shard=100).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    e = encoder(tokenizer_path(RANKS))
    sequences = to.read_from(spark, folder, 0, n, 16, 100)
    assert sequences.shape == (n, 16)
    by_doc = {}
    for r in got:
        assert r.shard == r.slot // 100 and r.offset == (r.slot % 100) * 32
        by_doc.setdefault(r.doc_id, []).append((r.seq_no, sequences[r.slot], r.n_tokens))
    for i, t in texts:
        if i == 63:
            continue
        ids = [int(x) for _, s, k in sorted(by_doc[i], key=lambda x: x[0]) for x in s[:k]]
        assert ids == [*e.encode(t), SPECIAL_ID]
        assert all((s[k:] == SPECIAL_ID).all() for _, s, k in by_doc[i])
    assert len(by_doc[63]) == 3
    assert (to.read_from(spark, folder, 95, 30, 16, 100) == sequences[95:125]).all()
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.seq_no))
    numbers = to.Feistel(n).number(np.array([r.slot for r in order if r.doc_id != 63]))
    assert (np.diff(numbers) > 0).all()


def plain_slot(number, n, key):
    """Four rounds on halves of the smallest even number of bits, again while the result is n or more; in Python's own integers."""
    half = max(1, -(-(max(1, n - 1).bit_length()) // 2))
    full, mask = 2**64 - 1, 2**half - 1
    keys = [int.from_bytes(hashlib.blake2b(f"{key}:{n}:{i}".encode(), digest_size=8).digest(), "little") for i in range(4)]
    while True:
        a, b = number >> half, number & mask
        for k in keys:
            x = (b + k) * 0x9E3779B97F4A7C15 & full
            x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & full
            a, b = b, a ^ ((x ^ (x >> 32)) & mask)
        number = (b << half) | a
        if number < n:
            return number


def test_shards_equal_those_written_by_hand(spark):
    texts = [(i, f"text {i} " + "some words of it " * (i % 5 * 4)) for i in range(40)] + [(None, "first of all"), (50, None)]
    folder = shared_dir(spark, "test-shards")
    got = to.materialise(documents(spark, texts).repartition(3), folder, length=8, per_shard=37, key="k").collect()
    e, sequences = encoder(tokenizer_path(RANKS)), []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*e.encode(t), SPECIAL_ID]
        sequences += [(i, k, ids[8 * k : 8 * k + 8]) for k in range(-(-len(ids) // 8))]
    n = len(sequences)
    want = {plain_slot(number, n, "k"): s for number, s in enumerate(sequences)}
    assert {(r.slot, r.doc_id, r.seq_no, r.n_tokens) for r in got} == {(slot, i, k, len(ids)) for slot, (i, k, ids) in want.items()}
    rows = to.read_from(spark, folder, 0, n, 8, 37)
    for slot, (_, _, ids) in want.items():
        assert rows[slot].tolist() == ids + [SPECIAL_ID] * (8 - len(ids))
    assert all(r.crc32 == zlib.crc32(rows[r.slot].astype("<u2").tobytes()) for r in got)


def test_empty_table(spark):
    assert to.materialise(documents(spark, []), shared_dir(spark, "none")).collect() == []
