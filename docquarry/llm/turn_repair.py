"""Operator 11: repair of conversations' structure by a dynamic program over retained subsequences.

Turns are kept, given the role user or assistant, or deleted, and turns without text are inserted, so that initials of roles read ``(s?(ua)+)?`` at the
least cost: keep 0, rerole 2, delete 3, insert 2, and 1 for a truncated turn that stays. Blank and duplicate turns must go. The program runs over the
turns that stay. Its states are the initial of the last one: none yet, s, u or a. What a gap costs is the difference of two prefix sums of
deletions, so a state needs only the least of its cost less the prefix sum so far, a running minimum; which turns are inserted between two that stay
follows from their two initials. The audit is the edits' initials (D, I, K, R): of equal costs the least by ASCII. All states' audits stand at the same turn
and end in a letter of it, so none is a beginning of another and their order so far decides; it is carried along as ranks. Within a gap deletions go first.

Order: by turn, nulls first, then role, then text, each by its bytes. Rows that are equal in all four columns are collapsed with their number before the
shuffle. A duplicate is told by a join on (conversation, turn, digest), a key that no two rows share: the first turn of each (conversation, digest) comes from an
aggregation. Conversations are shuffled once more and stream through a task in order. A task holds four bytes a turn of one conversation, from which the audit is
read, and a SHA-256 state for each state of the program: a hash of the whole repaired text can't be made in parts, so this is one pass even of the longest conversation.

Nulls: role and text count as one space, as do a null conv_id and turn in the key of ``damaged``; rows with a null conv_id are one conversation. A role
whose first character is not s, u or a can't be kept, nor can an s after the first place. Texts are whole, of any length. An empty table gives no rows.
Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, own, table, task

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: White space as the contract lists it, U+0009 to U+000D and the space.
SPACE = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
STATES = " sua"  # none yet, and the initial of the last turn that stays
#: Inserted before a turn with the second initial where the first came last; pairs that aren't here can't follow each other.
BETWEEN = {" s": "", " u": "", " a": "u", "su": "", "sa": "u", "ua": "", "uu": "a", "au": "", "aa": "u"}
#: Inserted at the end.
AFTER = {" ": "", "s": "ua", "u": "a", "a": ""}
INFINITE = 1 << 62


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) with one space for null roles and texts."""
    x = own(df, conv, turn, role, text).toDF("conv_id", "turn", "role", "text")
    return x.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" ")), "copies": F.lit(1)})


def damaged(x: DataFrame) -> DataFrame:
    """Rows of ``turns`` after damage by the CRC-32 of ``conv_id:turn``: ``copies`` is 0 for dropped rows and 2 for repeated ones."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return x.withColumns({
        "copies": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(F.col("copies")),
        "text": F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(kind == 4, "user").otherwise(F.col("role")),
    })


def _marked(x: DataFrame) -> DataFrame:
    """Distinct rows with their number, in each task by conversation and in order: blank, first (or a duplicate), truncated. A conversation without rows has one of copies 0."""
    there = F.col("copies") > 0
    key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    x = x.select("conv_id", F.when(there, F.col("turn")).alias("turn"), "copies", *[F.when(there, F.col(c)).alias(c) for c in ("role", "text")], F.when(there, digest).alias("digest"))
    x = x.withColumns({"c": key("conv_id"), "t": key("turn"), "digest": F.coalesce("digest", F.unhex(F.lit("")))})
    one = x.groupBy("c", "t", "digest").agg(F.min(F.struct("conv_id", "turn", "role", "text")).alias("x"), F.sum("copies").alias("copies"))
    firsts = x.where(there).groupBy("c", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn", "t")).alias("x")).select("c", F.col("x.t").alias("t"), "digest", F.lit(True).alias("first"))
    stem = F.rtrim(F.col("x.text"), F.lit(SPACE))
    out = one.join(firsts, ["c", "t", "digest"], "left")
    return out.select("c", "x.*", "copies", F.coalesce("first", F.lit(False)).alias("first"), (stem == "").alias("blank"), (~F.right(stem, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


class Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.cost = [0, INFINITE, INFINITE, INFINITE]  # by state, less the prefix sum of deletions
        self.rank = [0, 0, 0, 0]
        self.hash = [hashlib.sha256(), None, None, None]
        self.path = bytearray()  # of each turn by state: the state before, and 4 for kept, 8 for reroled
        self.deleted = 0  # the prefix sum
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.least, self.most, self.last, self.before = 0, None, None, None, None

    def add(self, turn, role: str, text: str, copies: int, first: bool, blank: bool, truncated: bool) -> None:
        """Equal rows, the first of which may stay."""
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        self.illegal += copies - (self.before is None)
        if self.before is not None and self.before + initial in ("su", "ua", "au"):
            self.illegal -= 1
        self.before, self.rows = initial, self.rows + copies
        gone = copies
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - first
            if first:
                self.truncated += truncated
                self._step(initial, role, text, TRUNCATED if truncated else 0)
                gone -= 1
        self.deleted += DELETE * gone
        self.path += b"\0\1\2\3" * gone

    def _step(self, initial: str, role: str, text: str, extra: int) -> None:
        """A turn that may stay: each state goes on without it, or comes from another with it, whichever is the least."""
        before = self.deleted
        after = before + DELETE
        best = [(c, r, "D", i, 0) for i, (c, r) in enumerate(zip(self.cost, self.rank))]
        for n in (1, 2, 3):
            to = STATES[n]
            if initial != to and to == "s":
                continue
            letter, price, code = ("K", extra, 4) if initial == to else ("R", extra + REROLE, 8)
            for i in (0, 1, 2, 3):
                between = BETWEEN.get(STATES[i] + to)
                if between is not None and self.cost[i] < INFINITE:
                    best[n] = min(best[n], (self.cost[i] + before + price + INSERT * len(between) - after, self.rank[i], "I" * len(between) + letter, i, code))
        hashes, line = [], None
        for n, (_, _, _, i, code) in enumerate(best):
            if not code:
                hashes.append(self.hash[n])
                continue
            if line is None:
                line = text.encode("utf-8", "surrogatepass")
            h = self.hash[i].copy()
            said = "".join(f"{ROLES[x]}:\n" for x in BETWEEN[STATES[i] + STATES[n]])
            h.update((("\n" if i else "") + said + (role if code == 4 else ROLES[STATES[n]]) + ":").encode("utf-8", "surrogatepass"))
            h.update(line)
            hashes.append(h)
        order = {x: k for k, x in enumerate(sorted({(b[1], b[2]) for b in best}))}
        self.cost, self.rank, self.hash = [min(b[0], INFINITE) for b in best], [order[b[1], b[2]] for b in best], hashes
        self.path += bytes(b[3] + b[4] for b in best)
        self.deleted = after

    def ended(self) -> dict:
        ends = [(c + INSERT * len(AFTER[s]), r, "I" * len(AFTER[s]), n) for n, (c, r, s) in enumerate(zip(self.cost, self.rank, STATES)) if c < INFINITE]
        cost, _, tail, state = min(ends)
        h = self.hash[state]
        h.update("".join(f"\n{ROLES[x]}:" for x in AFTER[STATES[state]]).encode())
        audit, at = [tail], state
        for k in range(len(self.path) - 4, -1, -4):
            step = self.path[k + at]
            if step < 4:
                audit.append("D")
                continue
            audit.append("K" if step < 8 else "R")
            i = step % 4
            audit.append("I" * len(BETWEEN[STATES[i] + STATES[at]]))
            at = i
        return {
            "gaps": 0 if self.most is None else self.most - self.least + 1 - self.turns, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": cost + self.deleted, "audit": "".join(reversed(audit)), "repaired_sha256": h.hexdigest(),
        }


_FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _reporter(schema: pa.Schema):
    def run(batches):
        here, conv, now = None, None, None
        for b in batches:
            done = []
            for c, conv_id, turn, role, text, copies, first, blank, truncated in zip(*[x.to_pylist() for x in b.columns]):
                if c != here:
                    if now is not None:
                        done.append({"c": here, "conv_id": conv} | now.ended())
                    here, conv, now = c, conv_id, Repair()
                if copies:
                    now.add(turn, role, text, copies, first, blank, truncated)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"c": here, "conv_id": conv} | now.ended()], schema=schema)

    return run


def _sorted(marked: DataFrame) -> DataFrame:
    """Each conversation's rows in one task, in order; rows of copies 0 last."""
    return marked.repartition("c").sortWithinPartitions("c", F.col("copies") == 0, F.col("turn").asc_nulls_first(), "role", "text")


def _reports(marked: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"c string, conv_id {marked.schema['conv_id'].dataType.simpleString()}, {_FOUND}"
    cols = _sorted(marked).select("c", "conv_id", "turn", "role", "text", "copies", "first", "blank", "truncated")
    return cols.mapInArrow(task(_reporter(to_arrow_schema(_parse_datatype_string(ddl)))), ddl)


def reports(x: DataFrame) -> DataFrame:
    """What is wrong with each conversation, and the cost, audit and digest of its repair; rows as ``turns`` or ``damaged`` give them."""
    bounded_batches(x.sparkSession)
    return _reports(_marked(x)).drop("c")


def _writer(schema: pa.Schema):
    def run(batches):
        here, conv, audit, at, n, last = None, None, "", 0, 0, " "
        for b in batches:
            out: list[dict] = []

            def put(role, text, edit):
                out.append({"conv_id": conv, "position": n, "role": role, "text": text, "edit": edit})

            for c, conv_id, role, text, copies, plan in zip(*[x.to_pylist() for x in b.columns]):
                if plan is not None:
                    here, conv, audit, at, n, last = c, conv_id, plan, 0, 0, " "
                for k in range(copies if plan is None else 0):
                    inserts = at
                    while audit[at] == "I":
                        at += 1
                    kept = audit[at]
                    at += 1
                    if kept == "D":
                        continue
                    to = role[:1]
                    if kept == "R":  # the initial that the inserted turns lead to
                        to = next(x for x in "ua" if len(BETWEEN.get(last + x, "---")) == at - 1 - inserts)
                    for x in BETWEEN[last + to]:
                        put(ROLES[x], "", "insert")
                        n += 1
                    put(role if kept == "K" else ROLES[to], text, "keep" if kept == "K" else "rerole")
                    n, last = n + 1, to
                if at < len(audit) and set(audit[at:]) == {"I"}:
                    for x in AFTER[last]:
                        put(ROLES[x], "", "insert")
                        n += 1
                    at = len(audit)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repaired(x: DataFrame) -> DataFrame:
    """The repaired conversations, (conv_id, position, role, text, edit), a row for each turn that is kept, reroled or inserted."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(x.sparkSession)
    marked = _marked(x)
    plan = _reports(marked).select("c", "conv_id", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("bigint").alias("copies"), "audit", F.lit(None).cast(marked.schema["turn"].dataType).alias("turn"))
    rows = marked.select("c", "conv_id", "role", "text", "copies", F.lit(None).cast("string").alias("audit"), "turn").unionByName(plan)
    rows = rows.repartition("c").sortWithinPartitions("c", F.col("audit").isNull(), F.col("copies") == 0, F.col("turn").asc_nulls_first(), "role", "text").drop("turn")
    ddl = f"conv_id {x.schema['conv_id'].dataType.simpleString()}, position bigint, role string, text string, edit string"
    return rows.mapInArrow(task(_writer(to_arrow_schema(_parse_datatype_string(ddl)))), ddl)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(turns(table(spark, sf_dir, "conversations"))))
