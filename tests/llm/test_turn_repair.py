import hashlib
import random
import zlib

from docquarry.llm import turn_repair as tr

SPACE = " \t\n\x0b\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def broken(rows):
    """The contract's damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def searched(rows):
    """All edits of one conversation, tried one after the other."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(i, state, cost, audit, done, inserted):
        if cost > best[0][0]:
            return
        if i == len(rows) and state in ("", "a"):
            best[0] = min(best[0], (cost, audit, done))
        if inserted < 2:
            for x, name in (("u", "user"), ("a", "assistant")):
                if (state, x) in NEXT:
                    go(i, x, cost + 2, audit + "I", [*done, f"{name}:"], inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, state, cost + 3, audit + "D", done, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (state, role[:1]) in NEXT:
                    go(i + 1, role[:1], cost + more, audit + "K", [*done, f"{role}:{text}"], 0)
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in NEXT:
                        go(i + 1, x, cost + 2 + more, audit + "R", [*done, f"{name}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    cost, audit, done = best[0]
    at = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()), done


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as c", "1 as copies", "2 as digest", "true as first", "0 as t").repartition(5)


def made(n, seed, long=6):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for _ in range(r.randint(1, long)):
            text = r.choice(["One.", "Two!", "three", "Four? ", " ", "", None, "Fünf.\n", "\x0b", "end. ", "Six. seven"])
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["user", "assistant", "system", "u", "USER", "", None, "assistant", "user"]), text))
    return rows


def test_equals_search_of_all_edits(spark):
    rows = made(400, 1) + [(None, 1, "user", "Null."), (None, None, None, None), (None, 2, "assistant", "Yes.")]
    got = {r[0]: tuple(r[1:]) for r in tr.reports(tr.damaged(tr.turns(table(spark, rows)))).collect()}
    want = {conv: searched(mine)[0] for conv, mine in broken(rows).items()}
    assert got == want
    assert any(len(set(w[6])) == 4 for w in want.values()) or {x for w in want.values() for x in w[6]} == set("DIKR")


def test_repaired_turns_are_those_that_the_digest_is_of(spark):
    rows = made(120, 2)
    x = tr.damaged(tr.turns(table(spark, rows)))
    by = {}
    for r in sorted(tr.repaired(x).collect(), key=lambda r: (r.conv_id, r.position)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, mine in broken(rows).items():
        assert by.get(conv, []) == searched(mine)[1]


def test_conversations_without_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    x = table(spark, [(dropped, 0, "user", "Hello.")])
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in tr.reports(tr.damaged(tr.turns(x))).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]
    assert tr.reports(tr.damaged(tr.turns(x.where("false")))).collect() == []


def test_long_conversation(spark):
    """Thousands of turns and many copies in one conversation; costs as a plain program over prefixes gives them."""
    r = random.Random(3)
    rows = [(7, i, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Same.", f"Text {i}.", f"cut {i}", "x" * 50_000 + "."]) if i % 500 else " ") for i in range(3000)]
    got = tr.reports(tr.turns(table(spark, rows))).first()
    seen, cost = set(), {"": 0}
    for _, _, role, text in rows:
        gone = not text.strip() or (role, text) in seen
        seen.add((role, text))
        more, new = text[-1] not in ".!?", {}
        grown = dict(cost)
        for _ in range(2):
            for s, c in list(grown.items()):
                for x in "ua":
                    if (s, x) in NEXT:
                        grown[x] = min(grown.get(x, 1 << 60), c + 2)
        for s, c in cost.items():
            new[s] = c + 3
        for s, c in grown.items():
            for x in "sua":
                if not gone and (s, x) in NEXT and (x != "s" or role[0] == "s"):
                    new[x] = min(new.get(x, 1 << 60), c + more + (0 if role[0] == x else 2))
        cost = new
    assert got.cost == min(cost.get("", 1 << 60), cost.get("a", 1 << 60), cost.get("u", 1 << 60) + 2, cost.get("s", 1 << 60) + 4)
    assert len(got.audit.replace("I", "")) == 3000 and got.duplicate == len(rows) - len({x[2:] for x in rows if x[3].strip()}) - got.blank


def test_a_column_of_integers_gives_its_type(spark):
    x = spark.createDataFrame([(1, 0, "user", "A.")], "conv_id int, turn int, role string, text string")
    assert tr.reports(tr.turns(x)).dtypes[0] == ("conv_id", "int")
