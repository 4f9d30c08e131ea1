"""Operator 2: language identification by a linear-chain conditional random field over the words of a text.

A word's features are its prefixes and suffixes of up to three letters, its letter n-grams with its ends marked, and the word itself (the lexicon),
hashed to ``BUCKETS`` weights for each language; transitions between the languages of neighbouring words are learned with them. Training takes
whole texts of a bounded sample of labelled documents and joins runs of words from texts of several languages, so that switches occur.
Labels come by forward-backward: each word gets its probabilities given all of its text, and a text the language with the highest mean over its words.

The gradient is that of the log-likelihood: counts of words' languages and of neighbours' pairs of languages, less what forward-backward expects of them.

A text that is null or has no letter is ``und`` with score 0. Rows with a null language are labelled like others but not learned from. With no
labelled rows at all every text is ``und``; an empty table gives an empty one. Texts are labelled whole, however long; a worker remembers a bounded number of
words' features. Repeated rows give repeated rows; of languages that score the same the first by name is told. Other columns of the input aren't read
by ``label``, whatever their names, and stay as they are in ``told``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, own, slices, table, task

#: Training documents of a language (in expectation; ``MOST`` bounds all of them), and of their words, at most so many for a language.
PER_LANGUAGE, MOST, WORDS = 250, 20_000, 150_000
BUCKETS, EPOCHS, RATE, RUN, BATCH = 1 << 17, 3, 0.3, 64, 128
#: Words whose emissions a worker remembers; words of one lane when a batch of texts is labelled; texts of a batch.
REMEMBER, LANE, TEXTS = 100_000, 128, 128
UNKNOWN = "und"


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join([c for c in token.lower() if c.isalpha()])


def _bucket(kind: int, *codes: np.ndarray) -> np.ndarray:
    """The bucket of letters of one kind of feature, given as one array for each place."""
    x = np.full(len(codes[0]), (kind + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in codes:
        x = (x ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the words' features: the word and its affixes, a row of seven a word; and its n-grams, word after word, with how many each has."""
    size = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    first, last = end - size + 1, end - 2  # of the word's own letters
    place = (np.arange(len(codes)) - np.repeat(end - size, size)).astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * (place ^ np.uint64(0x9E3779B97F4A7C15)), end - size)
    fixed = [_bucket(0, whole)]
    for way, at in ((1, first), (-1, last)):  # prefixes and suffixes of up to three letters
        reach = [codes[np.clip(at + way * k, first, last)] for k in range(3)]
        for k in (1, 2, 3):
            n = np.minimum(k, size - 2)
            fixed.append(np.select([n == 1, n == 2], [_bucket(1 + (way < 0), *reach[:1]), _bucket(3 + (way < 0), *reach[:2])], _bucket(5 + (way < 0), *reach)))
    two = _bucket(7, codes[:-1], codes[1:])
    three = _bucket(8, codes[:-2], codes[1:-1], codes[2:])
    inside = np.ones(len(codes), bool)
    inside[end - 1] = False
    pairs = np.flatnonzero(inside)  # where a pair of letters begins, and a triple but for the last pair
    inside[end - 2] = False
    triples = np.flatnonzero(inside)
    owner = np.concatenate([np.repeat(np.arange(len(words)), size - 1), np.repeat(np.arange(len(words)), size - 2)])
    grams = np.concatenate([two[pairs], three[triples]])[np.argsort(owner, kind="stable")]
    return np.stack(fixed, 1), grams, 2 * size - 3


def features(word: str) -> list[int]:
    """The buckets of a word's features."""
    fixed, grams, _ = word_features([word])
    return [*fixed[0].tolist(), *grams.tolist()]


def _chain(step: np.ndarray, start: np.ndarray, first: np.ndarray, trans: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Probabilities of each word's languages, as ``_marginals`` gives them."""
    return _marginals(step, start, first, trans, lane)[0]


def _marginals(step: np.ndarray, start: np.ndarray, first: np.ndarray, trans: np.ndarray, lane: int = LANE, edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's languages by forward-backward over a row of texts, and, if ``edges``, those of neighbours' pairs of languages added up.

    ``step`` are the words' factors, ``first`` is True where a text begins (the chain starts anew there). The row is cut into lanes that
    are done side by side: first each lane's product of step matrices, then what comes into each from both ends, then the words.
    """
    n, size = step.shape
    lanes = -(-n // lane)
    pad = lanes * lane - n
    e = np.concatenate([step, np.ones((pad, size))]).reshape(lanes, lane, size)
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(lanes, lane)
    prod = np.broadcast_to(np.eye(size), (lanes, size, size)).copy()
    for t in range(lane):
        nxt = prod @ trans
        r = new[:, t]
        if r.any():
            nxt[r] = prod[r].sum(2, keepdims=True) * start
        nxt *= e[:, t, None, :]
        prod = nxt / nxt.sum((1, 2), keepdims=True)
    into, back = np.empty((lanes, size)), np.empty((lanes, size))
    a = np.full(size, 1 / size)
    for k in range(lanes):
        into[k] = a
        a = a @ prod[k]
        a = a / a.sum()
    b = np.ones(size)
    for k in range(lanes - 1, -1, -1):
        back[k] = b
        b = prod[k] @ b
        b = b / b.sum()
    out = np.empty((lanes, lane, size))
    a = into
    before = np.empty((lanes, lane, size)) if edges else None
    for t in range(lane):
        if edges:
            before[:, t] = a
        nxt = a @ trans
        r = new[:, t]
        if r.any():
            nxt[r] = a[r].sum(1, keepdims=True) * start
        nxt *= e[:, t]
        a = out[:, t] = nxt / nxt.sum(1, keepdims=True)
    b, pairs = back, np.zeros((size, size))
    for t in range(lane - 1, -1, -1):
        out[:, t] *= b
        eb = e[:, t] * b
        nxt = eb @ trans.T
        r = new[:, t]
        if edges and not r.all():  # forward up to the word before, the transition, and all from this word on
            pair = before[~r, t, :, None] * trans * eb[~r, None, :]
            pairs += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        if r.any():
            nxt[r] = (eb[r] @ start)[:, None]
        b = nxt / nxt.sum(1, keepdims=True)
    out = out.reshape(-1, size)[:n]
    return out / out.sum(1, keepdims=True), pairs


class Model:
    """Weights of a trained field."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.langs, self.weights, self.trans, self.start = langs, weights, trans, start


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """From (text, language) pairs, by stochastic gradient with a rate for each weight."""
    r = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in texts})
    size = len(langs)
    known: dict[str, int] = {}
    runs: list[list[tuple[int, int]]] = [[] for _ in langs]
    stream: list[int] = []
    for text, lang in texts:
        k = langs.index(lang)
        words = [w for t in text.split() if (w := letters(t))]
        at = 0
        while at < len(words):
            n = int(r.integers(6, RUN))
            runs[k].append((len(stream), min(n, len(words) - at)))
            stream += [known.setdefault(w, len(known)) for w in words[at : at + n]]
            at += n
    if not size or not stream:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    fixed, grams, many = word_features([*known])
    begin = np.concatenate([[0], np.cumsum(many + fixed.shape[1])])
    flat = np.concatenate([fixed.ravel(), grams])[np.argsort(np.concatenate([np.repeat(np.arange(len(many)), fixed.shape[1]), np.repeat(np.arange(len(many)), many)]), kind="stable")]
    ids = np.array(stream)
    order: list[tuple[int, int, int]] = []
    for k, own_runs in enumerate(runs):
        r.shuffle(own_runs)
        used = 0
        for a, n in own_runs:
            if used < WORDS:
                order.append((a, n, k))
                used += n
    weights, trans, start = np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size)
    sq_w, sq_t, sq_s = np.full((BUCKETS, size), 1e-6), np.full((size, size), 1e-6), np.full(size, 1e-6)
    for _ in range(epochs):
        r.shuffle(order)
        i = 0
        while i < len(order):
            words, labels, first = [], [], []
            for _ in range(BATCH):  # a text of one to four runs of any languages
                for j in range(int(r.integers(1, 5))):
                    if i < len(order):
                        a, n, k = order[i]
                        words.append(ids[a : a + n])
                        labels.append(np.full(n, k))
                        first.append(np.arange(n) == (0 if j == 0 else -1))
                        i += 1
            w, y, new = np.concatenate(words), np.concatenate(labels), np.concatenate(first)
            uniq, inv = np.unique(w, return_inverse=True)
            count = begin[uniq + 1] - begin[uniq]
            take = np.repeat(begin[uniq], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            cols = flat[take]
            owner = np.repeat(np.arange(len(uniq)), count)
            score = np.stack([np.bincount(owner, weights[cols, k] / count[owner] * 8, len(uniq)) for k in range(size)], 1)[inv]
            step = np.exp(score - score.max(1, keepdims=True))
            t_p = np.exp(trans - trans.max())
            s_p = np.exp(start - start.max())
            p, pairs = _marginals(step, s_p, new, t_p, edges=True)
            g = p.copy()
            g[np.arange(len(y)), y] -= 1
            per_word = np.stack([np.bincount(inv, g[:, k], len(uniq)) for k in range(size)], 1)
            cell, where = np.unique(cols, return_inverse=True)
            grad = np.stack([np.bincount(where, (per_word[:, k] / count * 8)[owner], len(cell)) for k in range(size)], 1) / len(y) * 100
            sq_w[cell] += grad**2
            weights[cell] -= RATE * grad / np.sqrt(sq_w[cell])
            prev = np.flatnonzero(~new)
            want = np.zeros((size, size))
            np.add.at(want, (y[prev - 1], y[prev]), 1)
            gt = (pairs - want) / max(1, len(prev)) * 10
            sq_t += gt**2
            trans -= RATE * gt / np.sqrt(sq_t)
            gs = (p[new].sum(0) - np.bincount(y[new], minlength=size)) / max(1, new.sum())
            sq_s += gs**2
            start -= RATE * gs / np.sqrt(sq_s)
    return Model(langs, weights, np.exp(trans - trans.max()), np.exp(start - start.max()))


class Labeller:
    """Labels texts with a model; one for each task."""

    def __init__(self, model: Model):
        self.model = model
        outer = self
        self.rows = np.ones((1, len(model.langs)))

        class Words(dict):
            def __missing__(self, token):
                w = letters(token)
                if not w:
                    at = 0
                else:
                    at = len(outer.new) + len(outer.rows)
                    outer.new.append(w)
                self[token] = at
                return at

        self.words, self.new = Words(), []

    def factors(self, words: list[str]) -> np.ndarray:
        fixed, grams, many = word_features(words)
        s = self.model.weights[fixed].sum(1) + np.add.reduceat(self.model.weights[grams], np.cumsum(many) - many)
        s = s / (many + fixed.shape[1])[:, None] * 8
        return np.exp(s - s.max(1, keepdims=True))

    def probabilities(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray]]:
        """For each text its tokens, their languages' probabilities, and which tokens have letters."""
        if len(self.words) > REMEMBER:
            self.words.clear()
            self.rows = self.rows[:1]
        tokens = [(t or "").split() for t in texts]
        get = self.words.__getitem__
        ids = [np.fromiter(map(get, x), np.int64, len(x)) for x in tokens]
        if self.new and self.model.langs:
            self.rows = np.concatenate([self.rows, self.factors(self.new)])
        self.new = []
        size = [len(x) for x in ids]
        every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if not len(every) or not self.model.langs:
            return tokens, [np.zeros((n, len(self.model.langs))) for n in size], [x > 0 for x in ids]
        ends = np.cumsum(size)
        first = np.zeros(len(every), bool)
        first[(ends - size)[np.array(size) > 0]] = True
        p = _chain(self.rows[every], self.model.start, first, self.model.trans)
        return tokens, np.split(p, ends[:-1]), [x > 0 for x in ids]

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for _, p, real in zip(*self.probabilities(texts)):
            if not self.model.langs or not real.any():
                out.append((UNKNOWN, 0.0))
                continue
            mean = p[real].mean(0)
            k = int(mean.argmax())
            out.append((self.model.langs[k], min(1.0, float(mean[k]))))
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text (start, end, language) of its runs of words of one language; tokens without letters go with the run before."""
        out = []
        for text, tokens, p, real in zip(texts, *self.probabilities(texts)):
            at, runs = 0, []
            for token, q, ok in zip(tokens, p, real):
                a = text.index(token, at)
                at = a + len(token)
                lang = self.model.langs[int(q.argmax())] if ok and self.model.langs else (runs[-1][2] if runs else UNKNOWN)
                if runs and runs[-1][2] == lang:
                    runs[-1] = (runs[-1][0], at, lang)
                else:
                    runs.append((a, at, lang))
            out.append(runs)
        return out


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """A model from a sample of about ``per_language`` labelled documents of each language, ``most`` in all; documents are drawn by a hash of their ids."""
    rows = own(docs, "doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null").where(~held_out())
    counts = rows.groupBy("lang").count()
    share = F.broadcast(counts.orderBy(F.desc("count"), "lang").limit(10_000).select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")).alias("share")))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)).alias("draw")
    some = rows.join(share, "lang").withColumn("draw", draw).where(F.col("draw") < F.col("share") * (1 << 30))
    sample = some.orderBy("draw", "doc_id", F.xxhash64("text")).limit(most).collect()  # bounded by the two parameters
    return train([(r.text, r.lang) for r in sample])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: Labeller(shared.value).languages, "lang_pred string, score double", rows=TEXTS)


def told(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``min_score``, with it as ``lang`` where that is null. Rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        f = Labeller(shared.value).languages
        for b in slices(batches, TEXTS):
            found = f(b.column(at).to_pylist())
            filled = pa.array([x if x is not None else y for x, (y, _) in zip(b.column(lang).to_pylist(), found)], b.schema.field(lang).type)
            b = b.set_column(lang, b.schema.field(lang), filled)
            yield b.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(task(run), docs.schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, runs) for each row: start, end and language of each run of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = Labeller(shared.value).spans
        return lambda texts: [([{"start": a, "end": b, "lang": x} for a, b, x in runs],) for runs in f(texts)]

    return map_texts(docs, make, "runs array<struct<start: bigint, end: bigint, lang: string>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
