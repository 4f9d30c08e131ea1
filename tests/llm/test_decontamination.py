import math
import random
from collections import Counter

from docquarry.llm import decontamination as dc

from .conftest import documents


def brute_scores(items, terms, k1=1.2, b=0.75):
    """BM25 of each item for the terms, over its own full score."""
    bags = [Counter(dc.words_of(t)) for t in items]
    n, mean = len(bags), sum(x.total() for x in bags) / len(bags)
    df = Counter(t for x in bags for t in x)
    one = lambda bag, t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * bag.total() / mean))
    return [sum(one(x, t) for t in terms if t in x) / sum(one(x, t) for t in x) for x in bags]


def test_block_max_wand_finds_all_items_above_the_threshold():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)]
    for often in (5, 60):
        items = [" ".join(r.choice(vocabulary[: r.choice([often, 120])]) for _ in range(r.randint(3, 25))) for _ in range(300)]
        index = dc.Index([(i, t, "") for i, t in enumerate(items)], min_score=0.4)
        for _ in range(60):
            terms = set(r.sample(vocabulary, r.randint(1, 60)))
            want = {i: s for i, s in enumerate(brute_scores(items, terms)) if s >= 0.4 - 1e-9}
            got = dict(index.search(sorted(index.vocabulary[t] for t in terms if t in index.vocabulary)))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_items_are_found_in_documents(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = [word() for _ in range(20)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else word() for _ in range(n))
    items = [(i, text(r.randint(12, 60)) + ". " + text(6) + ".") for i in range(60)]
    docs = [(i, text(r.randint(0, 900))) for i in range(80)]
    want = set()
    for d in range(0, 80, 3):
        i = r.randrange(60)
        t = items[i][1]
        if d % 2:
            t = t.upper().replace(". ", " ,, ")
        docs[d] = (d, text(r.randint(0, 300)) + " " + t + " " + text(300))
        want.add((d, i))
    half = " ".join(items[7][1].split()[: len(items[7][1].split()) // 2])
    docs += [(100, half), (101, None), (102, ""), (103, "x " * 50_000 + items[3][1]), (103, "x " * 50_000 + items[3][1])]
    want.add((103, 3))
    docs += [(104, "x | y"), (None, text(10) + " a b " + text(10))]
    bench = spark.createDataFrame([*items, (900, None), (901, " "), (None, "zyx wvu")], "item_id bigint, text string")
    got = dc.contaminated(documents(spark, docs, extra=True), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert all(x.overlap >= 0.75 and x.score >= 0.5 for x in got)
    assert sorted(map(str, dc.contaminated(documents(spark, docs), bench, block_items=10).collect())) == sorted(map(str, got))
    assert {x.doc_id for x in dc.clean(documents(spark, docs), bench, block_items=10).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert dc.contaminated(documents(spark, []), bench).collect() == []
    assert dc.contaminated(documents(spark, docs), bench.where("item_id < 0")).collect() == []


def test_short_items_and_short_answers(spark):
    items = [(1, "zebra"), (2, "blue zebra runs"), (3, "which animal of the plains has stripes? the zebra."), (4, "one two three four")]
    filler = "some words that stand around it and say nothing at all "
    docs = [(10, filler + "Zebra, " + filler), (11, filler + "a blue zebra runs! " + filler), (12, filler + items[2][1] + " " + filler), (13, "one two three four"), (14, filler), (15, "four three two one"), (16, "blue runs " + filler)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in dc.contaminated(documents(spark, docs), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (11, 2), (12, 1), (12, 3), (13, 4)}
    assert all(x.overlap == 1 for x in got.values())
    assert (got[12, 3].question_overlap, got[12, 3].answer_overlap) == (1, 1)
    assert {x.doc_id for x in dc.clean(documents(spark, docs), bench).collect()} == {14, 15, 16}


def test_question_and_answer_are_verified_each(spark):
    r = random.Random(16)
    question, answer, filler = [[f"{k}{r.randrange(1000)}" for _ in range(n)] for k, n in (("q", 60), ("a", 6), ("f", 30))]
    item = " ".join(question) + "? " + " ".join(answer) + "."
    docs = [(1, " ".join(question + filler)), (2, " ".join(question) + "? " + " ".join(answer)), (3, " ".join([*question, *filler[:9], *answer])), (4, " ".join(answer)), (5, " ".join(question[:20] + answer))]
    bench = spark.createDataFrame([(1, item), (None, " ".join(filler[:12]))], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in dc.contaminated(documents(spark, docs), bench).collect()} == {(2, 1), (3, 1), (1, None)}
    assert {x.doc_id for x in dc.clean(documents(spark, [*docs, (None, docs[1][1]), (None, "clean"), (4, item)], extra=True), bench).collect()} == {4, 5, None}


def test_punctuation_between_words_takes_no_room():
    r = random.Random(17)
    item = [f"w{r.randrange(10**6)}" for _ in range(70)]
    index = dc.Index([(1, " ".join(item), "")])
    for marks in (" ", " | ", " | - ", " .. | -- "):
        for at in range(0, 300, 7):
            reader = dc.Reader(index)
            assert [x[0] for x in reader.find(" ".join(["out"] * at) + " " + marks.join(item) + " end")] == [1], (marks, at)


def test_items_of_other_lengths_change_nothing(spark):
    """A question and answer 250 words apart: whether they are found doesn't depend on what else is tested, or in which block."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    q, a, near, long = text(20), text(6), text(18), text(400)
    docs = documents(spark, [(1, f"{text(100)} {q} {text(250)} {a} {text(100)}"), (2, f"{text(90)} {near} {text(30)}"), (3, f"{text(700)} {long} {text(200)}")])
    schema = "item_id bigint, question string, answer string"
    one = [(1, q, a), (2, near, None)]
    alone = {(x.doc_id, x.item_id) for x in dc.contaminated(docs, spark.createDataFrame(one, schema)).collect()}
    for block_items in (dc.BLOCK_ITEMS, 1):
        got = {(x.doc_id, x.item_id) for x in dc.contaminated(docs, spark.createDataFrame([*one, (3, long, None)], schema), block_items=block_items).collect()}
        assert got == alone | {(3, 3)} == {(2, 2), (3, 3)}
    assert {dc.step_of(n) for n in (0, 1, 64)} == {64} and dc.step_of(65) == dc.step_of(128) == 128
