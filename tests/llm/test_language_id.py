import itertools
import zlib

import numpy as np
import pytest
from docquarry.llm import language_id as li

from .conftest import documents

EN = "the quick brown fox jumps over a lazy dog while thinking that these things are nothing with which other animals ought to bother".split()
DE = "der schnelle braune fuchs springt über einen faulen hund und denkt dass diese dinge nichts sind womit sich andere tiere beschäftigen".split()


def text(words, seed, n=40):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words, n)) + "."


@pytest.fixture(scope="module")
def model():
    return li.train([(text(w, i), lang) for i in range(40) for w, lang in ((EN, "en"), (DE, "de"))])


def plain(step, start, first, trans):
    """Forward-backward, word by word."""
    n, out, begin = len(step), np.zeros_like(step), [*np.flatnonzero(first), len(step)]
    for a, b in zip(begin, begin[1:]):
        f, g = np.zeros((b - a, step.shape[1])), np.ones((b - a, step.shape[1]))
        for t in range(b - a):
            f[t] = (start if t == 0 else f[t - 1] @ trans) * step[a + t]
            f[t] /= f[t].sum()
        for t in range(b - a - 2, -1, -1):
            g[t] = trans @ (step[a + t + 1] * g[t + 1])
            g[t] /= g[t].sum()
        out[a:b] = f * g
    return out / out.sum(1, keepdims=True) if n else out


def test_lanes_give_what_plain_forward_backward_gives():
    r = np.random.default_rng(4)
    for n in (1, 5, 64, 500):
        step, trans, start = r.random((n, 3)) + 0.01, r.random((3, 3)) + 0.01, r.random(3) + 0.01
        first = r.random(n) < 0.1
        first[0] = True
        assert np.allclose(li._chain(step, start, first, trans, lane=16), plain(step, start, first, trans))


def weight(step, start, first, trans, y):
    """What a sequence of languages weighs."""
    out = 1.0
    for t, k in enumerate(y):
        out *= (start[k] if first[t] else trans[y[t - 1], k]) * step[t, k]
    return out


def test_marginals_are_those_of_all_sequences_and_the_gradient():
    r = np.random.default_rng(5)
    for n, lane in ((1, 4), (6, 2), (7, 3), (7, 16)):
        step, trans, start = r.random((n, 3)) + 0.05, r.random((3, 3)) + 0.05, r.random(3) + 0.05
        first = np.arange(n) % 4 == 0
        every = list(itertools.product(range(3), repeat=n))
        z = lambda tr: sum(weight(step, start, first, tr, y) for y in every)
        words, pairs = li._marginals(step, start, first, trans, lane, edges=True)
        w = np.array([weight(step, start, first, trans, y) for y in every]) / z(trans)
        want_words = np.array([[sum(p for p, y in zip(w, every) if y[t] == k) for k in range(3)] for t in range(n)])
        want = np.zeros((3, 3))
        for p, y in zip(w, every):
            for t in range(1, n):
                if not first[t]:
                    want[y[t - 1], y[t]] += p
        assert np.allclose(words, want_words) and np.allclose(pairs, want)
        for i, k in ((0, 1), (2, 2)):  # the expected count is the slope of log Z in the logarithm of the transition's factor
            up, down = trans.copy(), trans.copy()
            up[i, k] *= np.exp(1e-5)
            down[i, k] *= np.exp(-1e-5)
            assert np.isclose((np.log(z(up)) - np.log(z(down))) / 2e-5, pairs[i, k], atol=1e-6)


def test_texts_are_labelled_as_by_the_plain_model(model):
    """Whole texts with a plain forward-backward over plain features."""
    for text_ in (text(EN, 900), text(DE, 901, 300), " ".join(EN[:8] + DE[:9]), "12 the, 34 der"):
        tokens = text_.split()
        words = [li.letters(t) for t in tokens]
        rows = []
        for w in words:
            s = np.mean([model.weights[f] for f in li.features(w)], 0) * 8 if w else np.zeros(len(model.langs))
            rows.append(np.exp(s - s.max()))
        p = plain(np.array(rows), model.start, np.arange(len(rows)) == 0, model.trans)[[bool(w) for w in words]].mean(0)
        lang, score = li.Labeller(model).languages([text_])[0]
        assert lang == model.langs[int(p.argmax())] and np.isclose(score, p.max())


def test_labels_words_of_code_switched_text(model):
    s = " ".join(EN[:10] + DE[:10] + EN[10:20])
    runs = li.Labeller(model).spans([s])[0]
    assert [x for _, _, x in runs] == ["en", "de", "en"]
    assert s[runs[1][0] : runs[1][1]].split()[0] in DE[:2] + EN[9:10]


def test_held_out_accuracy_and_edges(spark, model):
    rows = [(i, text(EN if i % 2 else DE, 100 + i), "en" if i % 2 else "de") for i in range(200)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !!", None), (503, "word " * 100_000, "en"), (None, text(EN, 1), "en"), (504, text(DE, 5), None), (504, text(DE, 5), None)]
    docs = documents(spark, rows, extra=True)
    m = li.fit(docs, per_language=50)
    got = li.label(docs, m).select("doc_id", li.held_out().alias("held_out"), "lang_pred", "score").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:200])
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert [(by[i].lang_pred, by[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "en" and by[504].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert li.label(documents(spark, []), m).collect() == []
    assert [r.lang_pred for r in li.label(docs, li.fit(docs.where("false"))).where("doc_id = 1").collect()] == ["und"]
    runs = {r.doc_id: r.runs for r in li.label_words(docs.where("doc_id in (1, 501)"), m).collect()}
    assert runs[501] == [] and runs[1][0].lang == "en"
