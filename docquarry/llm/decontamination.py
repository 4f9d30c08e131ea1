"""Operator 6: training passages that hold test items, found by BM25 with block-max WAND and verified by overlap.

The test items are the indexed side: an inverted index with BM25 impacts, each divided by its item's own full score, so that an item within a
passage scores about 1 whatever its length. Every passage (overlapping windows of words, twice as wide as an item: ``step_of`` its own length alone, items of
other steps are indexed apart) is a query that retrieves all items scoring at least ``min_score``. A passage in which the terms that few items have can't
make up what the others may lack for any item is passed over, the rest goes through block-max WAND, which skips blocks of postings by their largest impact.
An item retrieved counts if its question and its answer are each in the passage: of the 5-word shingles of either, ``min_overlap`` at least. A part of fewer
than 5 words is one shingle of all its words; an item without an answer counts by its question alone, and the other way round.
The question and answer are the item's columns of those names if it has them, else its text up to its last sentence and that sentence.

Words are what lies between white space, lower-cased and without punctuation at their ends; what is punctuation only is no word. A large test set is searched in
blocks of items; the number of items, their mean length and how many have a term are those of all items, so neither scores nor windows depend on the blocks.

Null and empty texts hold nothing, items without words are never found; empty tables give no rows. Texts of any length are searched whole. Items with a null
id are found like others. ``contaminated`` gives repeated rows of documents once for each (doc_id, item_id), null ids too; ``clean`` keeps or drops each row by its own text.
Other columns aren't read, whatever their names, and stay as they are in ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, slices, table, task, written

MIN_SCORE, MIN_OVERLAP, SHINGLE = 0.5, 0.75, 5
K1, B = 1.2, 0.75
#: Items of one index; larger test sets are searched in blocks of about so many, each small enough to broadcast.
BLOCK_ITEMS = 20_000
#: Postings of a block with a largest impact of its own.
POSTINGS = 32
REMEMBER = 300_000

_ends = re.compile(r"^[\W_]+|[\W_]+$")
_sentence = re.compile(r"(?<=[.!?])\s+|\n+")


def normal(word: str) -> str:
    return _ends.sub("", word).lower()


def words_of(text: str | None) -> list[str]:
    return [x for w in (text or "").split() if (x := normal(w))]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_and_answer(text: str | None) -> tuple[str, str]:
    parts = [x for x in _sentence.split((text or "").strip()) if x]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


def step_of(size: int) -> int:
    """Words from a passage's begin to the next's for items of so many words: the next power of two, 64 at least."""
    return max(64, 1 << (size - 1).bit_length()) if size else 64


def statistics(items: list[tuple[int | None, str, str]]) -> tuple[int, float, dict[str, int]]:
    """The number of items with words, their mean length, and how many have a term."""
    bags = [w for _, q, a in items if (w := words_of(q) + words_of(a))]
    return len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(t for w in bags for t in set(w))


class Index:
    """Postings of items that share a step: (item_id, question, answer). ``corpus`` has the number, mean length and document frequencies of all items, if there are others."""

    def __init__(self, items: list[tuple[int | None, str, str]], min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, corpus: tuple[int, float, dict[str, int]] | None = None):
        self.min_score, self.min_overlap = min_score, min_overlap
        kept = [(i, q, a) for i, q, a in ((i, words_of(q), words_of(a)) for i, q, a in items) if q or a]
        self.ids = [i for i, _, _ in kept]
        #: Of each item the words of it all, of its question and of its answer.
        self.parts = [(q + a, q, a) for _, q, a in kept]
        bags = [Counter(q + a) for _, q, a in kept]
        n, mean, df = corpus or statistics(items)
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for bag in bags for t in bag}), 1)}
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(self.vocabulary) + 1)]
        #: Items' shares of their own score by terms that over ``often`` items have.
        often, shared = max(2, n // 50), [0.0] * len(bags)
        for i, bag in enumerate(bags):
            size = bag.total()
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in bag.items()}
            full = sum(impact.values())
            for t, x in impact.items():
                postings[self.vocabulary[t]].append((i, x / full))
                shared[i] += x / full * (df[t] > often)
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.most = [max(p, default=0.0) for p in self.impacts]
        self.blocks = [[max(p[k : k + POSTINGS]) for k in range(0, len(p), POSTINGS)] for p in self.impacts]
        #: Postings of the terms that few items have, term after term, and what these must add to each item's score, whatever the others add.
        few = [[], *[postings[k] if df[t] <= often else [] for t, k in self.vocabulary.items()]]
        self.count = np.array([len(p) for p in few])
        self.first = np.cumsum(self.count) - self.count
        self.item = np.array([i for p in few for i, _ in p], np.int64)
        self.impact = np.array([x for p in few for _, x in p])
        self.needed = min_score - np.array(shared) - 1e-9
        self.step = max((step_of(b.total()) for b in bags), default=64)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items that score ``min_score`` at least for distinct terms, by block-max WAND."""
        least, out = self.min_score - 1e-9, []
        at = {t: 0 for t in terms if self.items[t]}
        order = sorted(at, key=lambda t: self.items[t][0])
        while order:
            bound, pivot = 0.0, None
            for k, t in enumerate(order):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = self.items[order[pivot]][at[order[pivot]]]
            while pivot + 1 < len(order) and self.items[order[pivot + 1]][at[order[pivot + 1]]] == item:
                pivot += 1
            near, bound, until = order[: pivot + 1], 0.0, math.inf
            for t in near:  # the block of each list in which the item would be
                p, k = self.items[t], at[t] // POSTINGS
                while k < len(self.blocks[t]) and p[min(len(p), (k + 1) * POSTINGS) - 1] < item:
                    k += 1
                if k < len(self.blocks[t]):
                    bound += self.blocks[t][k]
                    until = min(until, p[min(len(p), (k + 1) * POSTINGS) - 1] + 1)
            if bound >= least:
                score = 0.0
                for t in near:
                    p, k = self.items[t], at[t]
                    while k < len(p) and p[k] < item:
                        k += 1
                    if k < len(p) and p[k] == item:
                        score += self.impacts[t][k]
                        k += 1
                    at[t] = k
                if score >= least:
                    out.append((item, score))
            else:  # no item before the next end of a block, or before the next list's item, can score enough
                to = min(until, self.items[order[pivot + 1]][at[order[pivot + 1]]] if pivot + 1 < len(order) else math.inf)
                to = max(to, item + 1)
                for t in near:
                    p, k = self.items[t], at[t]
                    while k < len(p) and p[k] < to:
                        k += 1
                    at[t] = k
            order = sorted((t for t in order if at[t] < len(self.items[t])), key=lambda t: self.items[t][at[t]])
        return out

    def passages(self, n: int) -> list[tuple[int, int]]:
        return [(i, min(n, i + 2 * self.step)) for i in range(0, max(1, n - self.step), self.step)]

    def promising(self, ids: np.ndarray, passages: int) -> list[int] | range:
        """The passages in which terms that few items have can bring some item to the least score."""
        if self.needed.min(initial=1.0) <= 0:
            return range(passages)
        where = np.flatnonzero(self.count[ids])
        n = self.count[ids[where]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[ids[where]], n)
        half, item, impact = np.repeat(where // self.step, n), self.item[at], self.impact[at]
        key = np.concatenate([half, half - 1]) * len(self.ids) + np.concatenate([item, item])
        found, which = np.unique(key, return_inverse=True)
        enough = np.bincount(which, np.concatenate([impact, impact]), len(found)) >= self.needed[found % len(self.ids)]
        return [k for k in np.unique(found[enough] // len(self.ids)).tolist() if 0 <= k < passages]

    def verify(self, item: int, words: list[str]) -> tuple[float, float, float] | None:
        """Parts of the item's, its question's and its answer's shingles that are in a passage of these words; None if the question's or the answer's are too few."""
        there: dict[int, set] = {}
        out = []
        for part in self.parts[item]:
            n = min(SHINGLE, len(part))
            if n and n not in there:
                there[n] = shingles(words, n)
            own_ = shingles(part, max(1, n))
            out.append(len(own_ & there[n]) / len(own_) if n else 0.0)
        return tuple(out) if all(x >= self.min_overlap for x, part in zip(out[1:], self.parts[item][1:]) if part) else None

    def find(self, words: list[str], ids: np.ndarray) -> list[tuple]:
        """(item_id, score, overlap, question_overlap, answer_overlap) of the items within a text of these words, each from the passage that holds most of it."""
        best: dict[int, tuple] = {}
        spans = self.passages(len(words))
        for k in self.promising(ids, len(spans)):
            a, b = spans[k]
            terms = {int(x) for x in ids[a:b]} - {0}
            for item, score in self.search(sorted(terms)):
                found = self.verify(item, [normal(w) for w in words[a:b]])
                if found and (item not in best or found[0] > best[item][2]):
                    best[item] = (self.ids[item], round(score, 9), *(round(x, 9) for x in found))
        return [best[i] for i in sorted(best)]


class Reader:
    """Finds an index's items in texts; a worker remembers a bounded number of words."""

    def __init__(self, index: Index):
        self.index = index

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= REMEMBER:
                    self.clear()
                plain = normal(word)
                n = self[word] = index.vocabulary.get(plain, 0) if plain else -1
                return n

        self.known = Words()

    def find(self, text: str | None) -> list[tuple]:
        words = (text or "").split()
        if not words or not self.index.ids:
            return []
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if (ids < 0).any():
            words = [w for w, i in zip(words, ids.tolist()) if i >= 0]
            ids = ids[ids >= 0]
        return self.index.find(words, ids) if words else []


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


_WORDS = "size bigint, block int, words array<string>"


def _item_words(split: bool):
    def run(batches):
        for b in slices(batches):
            rows = zip(*[c.to_pylist() for c in b.columns])
            out = [(words_of(q) if split else words_of(q) + words_of(a), block) for q, a, block in rows]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int32()), pa.array([sorted(set(w)) for w, _ in out], pa.list_(pa.string()))], ["size", "block", "words"])

    return run


def indexes(benchmark: DataFrame, min_score: float, min_overlap: float, block_items: int):
    """An index for each step of each block of about ``block_items`` items, which is what the driver holds at a time."""
    split = not {"question", "answer"} <= set(benchmark.columns)
    items = own(benchmark, "item_id", *(["text"] if split else ["question", "answer"])).toDF("item_id", "question", *([] if split else ["answer"]))
    if split:
        items = items.withColumn("answer", F.lit(None).cast("string"))
    blocks = max(1, -(-items.count() // block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(blocks)).cast("int"))
    if blocks > 1:
        words = written(items.select("question", "answer", "block").mapInArrow(_item_words(split), _WORDS), "item-words").where("size > 0")
        n, mean = words.agg(F.count("*"), F.avg("size")).first()
        each = words.select("block", F.explode("words").alias("word"))
        df = written(each.groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()  # about block_items rows
        corpus = None
        if blocks > 1:
            corpus = (n, float(mean or 0), dict(df.join(each.where(F.col("block") == block).select("word").distinct(), "word").collect()))  # the terms of these rows
        triples = sorted(((r.item_id, *(question_and_answer(r.question) if split else (r.question, r.answer))) for r in rows), key=lambda x: (x[0] is None, *map(str, x)))
        corpus = corpus or statistics(triples)
        by_step = defaultdict(list)
        for x in triples:
            by_step[step_of(len(words_of(x[1]) + words_of(x[2])))].append(x)
        for step in sorted(by_step) or [64]:
            yield Index(by_step[step], min_score, min_overlap, corpus)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) for each document and the items found in it."""
    found = None
    for index in indexes(benchmark, min_score, min_overlap, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = own(docs, "doc_id", "text").mapInArrow(task(_finder(shared)), "doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")])


def _finder(shared):
    def run(batches):
        reader = Reader(shared.value)
        for b in slices(batches):
            out = defaultdict(list)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in reader.find(text):
                    for f, x in zip(_OUT, (doc, *row)):
                        out[f.name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _OUT], schema=_OUT)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no test item. Rows stay where they are."""
    text = docs.columns.index("text")

    def without(shared):
        def run(batches):
            reader = Reader(shared.value)
            for b in slices(batches):
                yield b.filter(pa.array([not reader.find(x) for x in b.column(text).to_pylist()], pa.bool_()))

        return run

    schema = docs.schema
    for index in indexes(benchmark, min_score, min_overlap, block_items):
        docs = docs.mapInArrow(task(without(docs.sparkSession.sparkContext.broadcast(index))), schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
