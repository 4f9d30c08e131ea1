"""Operator 8: exact Jaccard join of documents on word shingles with signature trees.

Documents with equal sets are one class from the start. Two sets with Jaccard similarity of 0.75 or more share one of their first
n - ceil(0.75 n) + 1 shingles in any order that is the same for all sets; the order takes shingles that many documents hold last (by a counting
sketch of fixed size over all documents), then goes by hash. So each class files itself under these shingles only, and only where two meet
there is more to do:

1. Each meeting has a leader, the class that meets most others; each class is compared with the leader it meets most. Most copies of a text
   find their group so.
2. What remains are meetings of classes that aren't in one group yet. In each meeting these form a signature tree: a leaf has the
   class's size, its set as a bitmap of four times as many bits and its group; a node the OR and the AND of its children's bitmaps, their range of sizes,
   and their group if they share one. Trees' nodes are traversed in pairs; a pair of nodes goes if both are of one group, if sizes are too far apart,
   or if bits that all classes of one node have and none of the other's (members that must be lacking) leave no room for the overlap that is asked for.
   Pairs of leaves that are left and meet in a shingle are counted, and compared if they meet as often as similar sets of their sizes must.

Comparisons are of whole sets. Links then join groups into components. A meeting of many classes never gives all of its pairs: those of one group
are passed over, and the rest of a large meeting is dealt in blocks over several tasks, each pair of classes to one of them.

Null and empty texts have empty sets and link with nothing, their component is their own doc_id; an empty table gives an empty one. Texts of any
length are taken whole; memory grows with the longest. Rows with a null doc_id link with nothing and have a null component. Rows with the same
doc_id are one document for components, and one row each in the result. Other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, discard, join_unique, own, scratch, slices, small, table, task, written
from .shingles import common, fingerprint, shingle_sets

#: Similarity in hundredths; slots of the sketch; filed shingles of one part, and those of open meetings; words of 64 bits of the shortest bitmap; children of a node.
SIMILARITY, SLOTS, PART, OPEN, WORDS64, FAN = 75, 1 << 20, 500_000, 250_000, 16, 8
#: Bits of a bitmap for each member: with one, two sets that share passages (0.43 of their union) look similar; with four only those from about 0.69 on.
SPARSE = 4
#: Slots of the sketch in a row; classes of one meeting that one task takes; classes of a meeting whose pairs are listed at once; pairs of nodes looked at together.
STRIP, MEETING, FEW, CHUNK = 1 << 14, 2_048, 24, 50_000
#: Bytes of a list of shingles up to which it is broadcast: none, as they grow with the corpus. Texts whose fingerprints a task remembers, to file copies once.
LIMIT, REMEMBER = 0, 100_000


def prefix(n: int, similarity: int = SIMILARITY) -> int:
    """How many first members of a set of ``n`` any set as similar must meet one of."""
    return n - -(-similarity * n // 100) + 1 if n else 0


def linked(inter: int, n: int, m: int, similarity: int = SIMILARITY) -> bool:
    return inter > 0 and 100 * inter >= similarity * (n + m - inter)


def _add(batches):
    total: dict[int, np.ndarray] = {}
    filed = 0
    for b in batches:
        for k, x, n in zip(*[c.to_pylist() for c in b.columns]):
            total[k] = total.get(k, 0) + np.frombuffer(x, "<i8")
            filed += n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array([filed] + [0] * (len(total) - 1), pa.int64())], ["strip", "counts", "filed"])


def levels(strips: DataFrame) -> tuple[np.ndarray, int]:
    """For each slot a level, 0 unless many documents hold shingles of it, and the number of shingles to file. Its size is the same for any corpus."""
    rows = strips.repartition(16, "strip").mapInArrow(task(_add), "strip int, counts binary, filed bigint").collect()  # SLOTS numbers
    counts = np.zeros(SLOTS, np.int64)
    for r in rows:
        counts[r.strip * STRIP : (r.strip + 1) * STRIP] = np.frombuffer(r.counts, "<i8")
    usual = np.median(counts)
    extra = counts - usual - 6 * np.sqrt(usual + 1)
    return np.where(extra > 4, np.log2(np.maximum(extra, 1)).astype(np.int64), 0).astype(np.uint8), sum(r.filed for r in rows)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """As words of 64 bits; a power of two of bits, ``SPARSE`` times as many as members at least."""
    n = 64 * WORDS64
    while n < SPARSE * len(shingles):
        n *= 2
    out = np.zeros(n, np.uint8)
    out[((shingles >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has in fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


_CLASSES = "doc_id bigint, n bigint, a bigint, b bigint, bits binary, strip int, counts binary, filed bigint"
_CLASSES_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bits", pa.binary()), ("strip", pa.int32()), ("counts", pa.binary()), ("filed", pa.int64())])


def _classes(batches):
    """A row for each document; and a task's sketch of all shingles in strips, with how many shingles will be filed."""
    counts, filed = np.zeros(SLOTS, np.int64), 0
    for b in slices(batches, 256):
        sets = shingle_sets(b.column(1).to_pylist())
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        counts += np.bincount((every >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        filed += sum(prefix(len(s)) for s in sets)
        prints = [fingerprint(s) for s in sets]
        none = pa.nulls(len(sets))
        columns = [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *[none.cast(_CLASSES_ARROW.field(i).type) for i in (5, 6, 7)]], schema=_CLASSES_ARROW)
    strips = [counts[i : i + STRIP].astype("<i8").tobytes() for i in range(0, SLOTS, STRIP)]
    none = pa.nulls(len(strips))
    yield pa.RecordBatch.from_arrays([*[none.cast(_CLASSES_ARROW.field(i).type) for i in range(5)], pa.array(range(len(strips)), pa.int32()), pa.array(strips, pa.binary()), pa.array([filed] + [0] * (len(strips) - 1), pa.int64())], schema=_CLASSES_ARROW)


def _file(level, parts: int):
    """Rows of (part, shingles, classes): what one part of the shingles gets from some hundreds of documents.

    A shingle that more classes hold than a part should take is dealt by class over parts of its own, as many as the sketch calls for, from ``parts`` on.
    """

    def rows(tokens, owners):
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        part = (tokens % np.uint64(parts)).astype(np.int64)
        split = (1 << level.value[(tokens >> np.uint64(44)).astype(np.int64)].astype(np.int64)) * 8 // PART
        part += np.where(split > 0, parts * (1 + owners % np.maximum(split, 1)), 0)
        order = np.lexsort((tokens, part))
        tokens, owners, part = tokens[order], owners[order], part[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        first = np.concatenate([[0], cut])
        return pa.RecordBatch.from_arrays(
            [pa.array(part[first]), pa.array([x.tobytes() for x in np.split(tokens, cut)], pa.binary()), pa.array([x.tobytes() for x in np.split(owners, cut)], pa.binary())],
            ["part", "tokens", "owners"],
        )

    def run(batches):
        levels, tokens, owners, held, seen = level.value, [], [], 0, set()
        for b in slices(batches, 256):
            for s in shingle_sets(b.column(0).to_pylist()):
                if not len(s):
                    continue
                if (who := fingerprint(s)) in seen:  # a copy files the same
                    continue
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(who)
                k = prefix(len(s))
                lv = levels[(s >> np.uint64(44)).astype(np.int64)]
                first = s[np.argsort(lv, kind="stable")[:k]] if lv.any() else s[:k]
                tokens.append(first)
                owners.append(np.full(k, who[0], np.int64))
                held += k
            if held > 250_000:
                yield rows(tokens, owners)
                tokens, owners, held = [], [], 0
        if held:
            yield rows(tokens, owners)

    return run


_MET = "token bigint, a bigint, others bigint"


def _meet(parts: int):
    def run(t: pa.Table) -> pa.Table:
        """Of a part: each class in each meeting of two or more, and how many others are there; of a shingle dealt over several parts, each class."""
        tokens = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("tokens").to_pylist()])
        owners = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("owners").to_pylist()])
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])  # copies of a text file the same
        tokens, owners = tokens[new], owners[new]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(first, len(tokens)))
        many = np.repeat(size > 1, size) | (t.column("part")[0].as_py() >= parts)
        return pa.table({"token": tokens[many], "a": owners[many], "others": np.repeat(size - 1, size)[many]})

    return run


_SETS = "a bigint, b bigint, n bigint, members binary"


def _sets(thin: bool):
    """Whole sets, or their members' upper halves, of which two sets share as many at least but for those that fall together in one."""

    def run(batches):
        for b in slices(batches, 128):
            sets = shingle_sets(b.column(0).to_pylist())
            prints = [fingerprint(s) for s in sets]
            members = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets] if thin else sets
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in members], pa.binary())], ["a", "b", "n", "members"])

    return run


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, thin: bool) -> DataFrame:
    """(x, n, members) of the classes in pairs (x, y), each from its smallest document."""
    wanted = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).distinct()
    ids = written(classes.join(wanted, "x", "left_semi").select("x", "doc_id"), "candidates")
    texts = own(docs, "doc_id", "text").join(small(ids.select("doc_id")), "doc_id", "left_semi").select("text").where("text is not null")
    sets = texts.mapInArrow(task(_sets(thin)), _SETS).select(F.struct("a", "b").alias("x"), "n", "members")
    out = written(sets.join(small(ids.select("x")), "x", "left_semi").dropDuplicates(["x"]), "members")
    discard(ids)
    return out


def _compare(similarity: int, thin: bool):
    """Pairs whose whole sets are similar; with ``thin`` ones, pairs that may be."""
    kind = np.uint32 if thin else np.uint64

    def run(batches):
        for b in slices(batches, 512):
            keep = []
            for s, n, t, m in zip(*[b.column(c).to_pylist() for c in ("members", "n", "members_y", "m")]):
                s, t = np.frombuffer(s, kind), np.frombuffer(t, kind)
                keep.append(linked(common(s, t) + min(n - len(s), m - len(t)), n, m, similarity))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


_KIND = "struct<a: bigint, b: bigint>"


def compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: int, name: str, thin: bool = False) -> DataFrame:
    """Those of the pairs (x, y) that are similar, by their whole sets (or may be, by ``thin`` ones); a written table."""
    sets = sets_of(docs, classes, pairs, thin)
    two = pairs.join(sets, "x").join(sets.select(F.col("x").alias("y"), F.col("n").alias("m"), F.col("members").alias("members_y")), "y")
    out = written(two.select("x", "y", "n", "m", "members", "members_y").mapInArrow(task(_compare(similarity, thin)), f"x {_KIND}, y {_KIND}"), name)
    discard(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(x, c): for each end of the edges (x, y) the smallest one that it reaches; a written table. Each round takes labels over edges and then labels' labels."""
    both = written(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    old = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("d")).select("x", F.lit(None).cast(_KIND).alias("c"), "d"), "labels")
    while True:
        labels = old.select("x", F.col("d").alias("c"))
        near = both.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("d"))
        step = labels.join(near, "x").select("x", "c", F.least("c", "d").alias("d"))
        jump = step.join(labels.select(F.col("x").alias("d"), F.col("c").alias("e")), "d", "left").select("x", "c", F.least(F.col("d"), F.coalesce("e", "d")).alias("d"))
        new = written(jump, "labels")
        discard(old)
        if new.where("c <> d").isEmpty():
            discard(both)
            return new.select("x", "c")
        old = new


def overlap(n: np.ndarray, m: np.ndarray, lack: np.ndarray, lack_m: np.ndarray, similarity: int) -> np.ndarray:
    """Whether sets of at most ``n`` and ``m`` members can be similar, of which so many at least aren't in the other."""
    most = np.minimum(n - lack, m - lack_m)
    return (most > 0) & (100 * most >= similarity * (n + m - most))


class Tree:
    """A signature tree over classes given in order of group and size; group -1 is no group. Bitmaps are folded to the shortest width."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, group: np.ndarray):
        self.levels = [(n, n, bits, bits, group)]
        while len(self.levels[-1][0]) > 1:
            low, high, any_, all_, g = self.levels[-1]
            cut = range(0, len(low), FAN)
            same = np.array([g[i] if (g[i : i + FAN] == g[i]).all() else -1 for i in cut])
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(any_, cut, 0), np.bitwise_and.reduceat(all_, cut, 0), same))

    def room(self, other: Tree, up: int, x: np.ndarray, y: np.ndarray, similarity: int) -> np.ndarray:
        """Whether classes of nodes ``x`` here and ``y`` there, at level ``up``, can be similar and of different groups."""
        (low, high, any_, all_, group), (low_y, high_y, any_y, all_y, group_y) = self.levels[up], other.levels[up]
        ok = ((group[x] < 0) | (group[x] != group_y[y])) & (high[x] * 100 >= low_y[y] * similarity) & (high_y[y] * 100 >= low[x] * similarity)
        at = np.flatnonzero(ok)
        x, y = x[at], y[at]
        lack = np.bitwise_count(all_[x] & ~any_y[y]).sum(1, dtype=np.int64)
        lack_y = np.bitwise_count(all_y[y] & ~any_[x]).sum(1, dtype=np.int64)
        # the overlap is at most the size less what must be lacking, and the union at least the smallest size that can stand against it
        big, big_y, small_, small_y = high[x], high_y[y], low[x], low_y[y]
        ok[at] = (big > lack) & (big_y > lack_y) & (100 * (big - lack) >= similarity * (small_y + lack)) & (100 * (big_y - lack_y) >= similarity * (small_ + lack_y))
        return ok

    def pairs(self, other: Tree | None = None, similarity: int = SIMILARITY):
        """Pairs of leaves that no bound rules out, in arrays of bounded size: of this tree, the first before the second, or with one of another. Depth first."""
        there = self if other is None else other
        top = max(len(self.levels), len(there.levels)) - 1
        for tree in (self, there):
            while len(tree.levels) <= top:
                tree.levels.append(tree.levels[-1])
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            up, x, y = work.pop()
            if len(x) > CHUNK:
                work += [(up, x[i : i + CHUNK], y[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
                continue
            keep = self.room(there, up, x, y, similarity)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if up == 0:
                if other is None:
                    x, y = x[x < y], y[x < y]
                yield x, y
                continue
            down, down_y = self._children(up), there._children(up)
            for i in range(0, len(x), max(1, CHUNK // (FAN * FAN))):
                a, b = x[i : i + max(1, CHUNK // (FAN * FAN))], y[i : i + max(1, CHUNK // (FAN * FAN))]
                a, b = np.repeat(a, down * down_y) * down + np.tile(np.repeat(np.arange(down), down_y), len(a)), np.repeat(b, down * down_y) * down_y + np.tile(np.arange(down_y), len(b) * down)
                ok = (a < len(self.levels[up - 1][0])) & (b < len(there.levels[up - 1][0]))
                if other is None:
                    ok &= a <= b
                work.append((up - 1, a[ok], b[ok]))

    def _children(self, up: int) -> int:
        return 1 if self.levels[up] is self.levels[up - 1] else FAN


class Signatures:
    """Sizes and bitmaps of a part's classes, for bounds on pairs at the width of the narrower one.

    Bitmaps stay in one buffer, whatever their widths, and those of some pairs at a time are folded; only the shortest width is kept for all.
    ``order`` has the place in ``bits`` of each class's bitmap.
    """

    def __init__(self, n: np.ndarray, bits: list[bytes] | pa.Array, order: np.ndarray | None = None):
        self.n = n
        bits = (pa.array(bits, pa.binary()) if isinstance(bits, list) else bits).cast(pa.large_binary())
        ends = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1] if len(bits) else np.zeros(1, np.int64)
        self.flat = np.frombuffer(bits.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64) if len(bits) else np.zeros(0, np.uint64)
        order = np.arange(len(bits)) if order is None else order
        self.start, self.words = (ends[:-1] - ends[0])[order] // 8, np.diff(ends)[order] // 8
        self.short = np.empty((len(order), WORDS64), np.uint64)
        for i in range(0, len(order), CHUNK):
            self.short[i : i + CHUNK] = self.rows(np.arange(i, min(i + CHUNK, len(order))), WORDS64)

    def rows(self, at: np.ndarray, words: int) -> np.ndarray:
        """The bitmaps of the classes ``at``, folded to so many words, a row each."""
        out = np.empty((len(at), words), np.uint64)
        width = self.words[at]
        for w in np.unique(width).tolist():
            where = np.flatnonzero(width == w)
            for i in range(0, len(where), max(1, CHUNK // w)):
                some = where[i : i + max(1, CHUNK // w)]
                bits = self.flat[self.start[at[some], None] + np.arange(w)]
                while bits.shape[1] > words:
                    bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
                out[some] = bits
        return out

    def room(self, x: np.ndarray, y: np.ndarray, similarity: int) -> np.ndarray:
        """Whether classes ``x`` and ``y`` can be similar."""
        ok = (self.n[x] * 100 >= self.n[y] * similarity) & (self.n[y] * 100 >= self.n[x] * similarity)
        width = np.minimum(self.words[x], self.words[y])
        for w in np.unique(width[ok]).tolist():
            every = np.flatnonzero(ok & (width == w))
            step = max(1, CHUNK * WORDS64 // w)
            for i in range(0, len(every), step):
                at = every[i : i + step]
                a, b = (self.short[z[at]] if w == WORDS64 else self.rows(z[at], w) for z in (x, y))
                ok[at] = overlap(self.n[x[at]], self.n[y[at]], np.bitwise_count(a & ~b).sum(1, dtype=np.int64), np.bitwise_count(b & ~a).sum(1, dtype=np.int64), similarity)
        return ok


def _roomy(similarity: int):
    """Pairs (x, y) of rows with sizes n and m and bitmaps, but for those that can't be similar."""

    def run(batches):
        for b in slices(batches, 4096):
            k = b.num_rows
            n = np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m")])
            both = Signatures(n, pa.concat_arrays([b.column("bits"), b.column("bits_y")]))
            ok = both.room(np.arange(k), np.arange(k, 2 * k), similarity)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


_PAIRS = "xa bigint, xb bigint, ya bigint, yb bigint, n bigint, m bigint, shared bigint"


def _trees(similarity: int):
    def run(seats: pa.Table, t: pa.Table) -> pa.Table:
        """The pairs of one part of the open meetings that no bound rules out, and how many meetings of the part they share. ``t`` has the classes."""
        by_a = np.argsort(t.column("a").to_numpy(), kind="stable")
        a, b, n, group = (t.column(c).to_numpy()[by_a] for c in ("a", "b", "n", "g"))
        known = Signatures(n, t.column("bits").combine_chunks(), by_a)
        token, slice_, side, who = (seats.column(c).to_numpy() for c in ("token", "slice", "side", "a"))
        first, last = np.searchsorted(a, who, "left"), np.searchsorted(a, who, "right")  # more than one where sets share the filed half of their hash
        row = np.repeat(np.arange(len(who)), last - first)
        who = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[row]
        token, slice_, side = token[row], slice_[row], side[row]
        order = np.lexsort((n[who], group[who], side, slice_, token))
        token, slice_, side, who = token[order], slice_[order], side[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (slice_[1:] != slice_[:-1])]))
        size = np.diff(np.append(first, len(token)))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []  # as x * classes + y, and how often
        held = 0

        def add(x: np.ndarray, y: np.ndarray, times: int = 1) -> None:
            nonlocal held
            other = (group[x] < 0) | (group[x] != group[y])
            code, count = np.unique((np.minimum(x, y) * len(n) + np.maximum(x, y))[other], return_counts=True)
            pairs.append((code, count * times))
            held += len(code)
            if held > 2_000_000:
                merge()

        def merge() -> None:
            nonlocal pairs, held
            code, at = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
            pairs = [(code, np.bincount(at, np.concatenate([k for _, k in pairs]), len(code)).astype(np.int64))]
            held = 0

        plain = side[first] == 0
        for k in np.unique(size[plain & (size <= FEW)]).tolist():  # all pairs of small meetings at once
            at = first[plain & (size == k)]
            left, right = np.triu_indices(k, 1)
            step = max(1, 500_000 // max(1, len(left)))
            for i in range(0, len(at), step):
                rows = who[at[i : i + step][:, None] + np.arange(k)]
                add(rows[:, left].ravel(), rows[:, right].ravel())
        same: dict[tuple[bytes, int], int] = {}  # many large meetings are of the same classes
        for f, k in zip(first[~plain | (size > FEW)].tolist(), size[~plain | (size > FEW)].tolist()):
            key = (who[f : f + k].tobytes(), 0 if side[f] == 0 else int((side[f : f + k] == 1).sum()) or -1)
            same[key] = same.get(key, 0) + 1
        tree = lambda i: Tree(n[i], known.short[i], group[i])
        for (raw, cut), times in same.items():
            m = np.frombuffer(raw, np.int64)
            if cut == 0:
                for x, y in tree(m).pairs(None, similarity):
                    add(m[x], m[y], times)
            elif 0 < cut < len(m):  # two blocks; pairs within one sit in another slice
                for x, y in tree(m[:cut]).pairs(tree(m[cut:]), similarity):
                    add(m[:cut][x], m[cut:][y], times)
        if pairs:
            merge()
        code, times = pairs[0] if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        x, y = code // max(1, len(n)), code % max(1, len(n))
        ok = known.room(x, y, similarity)
        x, y, times = x[ok], y[ok], times[ok]
        return pa.table({"xa": a[x], "xb": b[x], "ya": a[y], "yb": b[y], "n": n[x], "m": n[y], "shared": times.astype(np.int64)})

    return run


def dealt(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    """``seen`` (token, a, g) with the ``slice`` of its meeting that a class sits in, and its ``side`` there.

    A small meeting is one slice in which all sit on side 0. The classes of a larger one's largest group, and the others, are each cut into
    blocks by hash; a slice has a block of the one on side 1 and a block of the other on side 2, or two blocks of the others, or one on side 0.
    So any two classes that aren't both of that group share one slice.
    """
    large = sizes.where(F.col("size") > MEETING)
    out = seen.where(F.col("size") <= MEETING).select("token", "a", "g", F.lit(0).cast("bigint").alias("slice"), F.lit(0).alias("side"))
    if large.isEmpty():
        return out
    rows = seen.where(F.col("size") > MEETING).drop("size")
    each = rows.groupBy("token", "g").agg(F.count("*").alias("n"))
    most = each.groupBy("token").agg(F.max(F.when(F.col("g") >= 0, F.struct("n", "g"))).alias("m"), F.sum("n").alias("k")).select("token", F.col("m.g").alias("lead"), F.coalesce("m.n", F.lit(0)).alias("n"), "k")
    most = most.select("token", "lead", F.ceil(F.col("n") / MEETING).alias("p"), F.ceil((F.col("k") - F.col("n")) / MEETING).alias("q")).where("q > 0")
    x = rows.join(small(written(most, "large")), "token").withColumn("own", F.coalesce(F.col("g") == F.col("lead"), F.lit(False)))
    x = x.withColumn("home", F.pmod(F.xxhash64("a"), F.when(F.col("own"), F.col("p")).otherwise(F.col("q"))))
    lead_seats = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1), lambda j: F.struct((F.col("home") * F.col("q") + j).alias("slice"), F.lit(1).alias("side")))
    with_lead = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1), lambda i: F.struct((i * F.col("q") + F.col("home")).alias("slice"), F.lit(2).alias("side")))
    pair = lambda j: F.col("p") * F.col("q") + F.least(j, F.col("home")) * F.col("q") + F.greatest(j, F.col("home"))
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1), lambda j: F.struct(pair(j).alias("slice"), F.when(j == F.col("home"), 0).when(F.col("home") < j, 1).otherwise(2).alias("side")))
    x = x.withColumn("seat", F.explode(F.when(F.col("own"), lead_seats).when(F.col("p") > 0, F.concat(with_lead, others)).otherwise(others)))
    return out.unionByName(x.select("token", "a", "g", "seat.slice", "seat.side"))


def open_pairs(met: DataFrame, classes: DataFrame, groups: DataFrame, similarity: int) -> DataFrame:
    """The pairs (x, y) of classes of different groups that meet, whose bounds leave room, and that meet as often as similar sets must."""
    known = classes.join(groups, "x", "left").select(F.col("x.a").alias("a"), F.xxhash64(F.coalesce("c", "x")).bitwiseAND((1 << 63) - 1).alias("g"))
    known = known.groupBy("a").agg(F.when(F.count("*") == 1, F.min("g")).otherwise(-1).alias("g"))  # sets that share the filed half of their hash are taken as of no group
    rows = written(met.select("token", "a").join(known, "a").select("token", "a", "g"), "met_groups")
    sizes = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high or low = -1")
    sizes = written(sizes.select("token", "size"), "open")
    seen = join_unique(rows, sizes, "token", sizes.select("token", F.col("size").alias("n")), rows.count(), "inner", limit=LIMIT)
    seats = written(dealt(seen, sizes), "seats")
    part = F.pmod(F.xxhash64("token", "slice"), F.lit(max(8, -(-seats.count() // OPEN)))).alias("part")  # a class of a large meeting has many seats
    sitting = again(seats).select(part, "a", "g").distinct().join(classes.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), "n", "bits"), "a")
    found = seats.select(part, "token", "slice", "side", "a").groupBy("part").cogroup(sitting.groupBy("part")).applyInArrow(_trees(similarity), _PAIRS)
    pairs = found.groupBy("xa", "xb", "ya", "yb").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("shared").alias("shared"))
    # of a and b with n and m members at least c are common, so of the filed ones of that which files the shorter way c - (n - filed)
    filed = lambda k: F.col(k) - F.ceil(F.col(k) * similarity / 100) + 1
    both = F.ceil((F.col("n") + F.col("m")) * similarity / (100 + similarity))
    enough = F.least(both - F.col("n") + filed("n"), both - F.col("m") + filed("m"))
    pairs = pairs.where(F.col("shared") >= enough).select(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")).alias("x"), F.struct(F.col("ya").alias("a"), F.col("yb").alias("b")).alias("y"))
    out = written(pairs, "pairs")
    discard(rows, sizes, seats)
    return out


def similar_groups(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    with scratch() as keep:
        return _similar_groups(docs, similarity, keep)


def _similar_groups(docs: DataFrame, similarity: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    every = written(own(docs, "doc_id", "text").mapInArrow(task(_classes), _CLASSES), "classes")
    keep(every)
    level, filed = levels(every.where("strip is not null").select("strip", "counts", "filed"))
    every = every.where("strip is null").select("doc_id", "n", F.struct("a", "b").alias("x"), "bits")
    rows = every.select("doc_id", "n", "x")
    classes = written(every.where("n > 0 and doc_id is not null").groupBy("x").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"), F.any_value("bits").alias("bits")), "sets")
    parts = max(8, -(-filed // PART))
    files = own(docs, "text").where("text is not null").mapInArrow(task(_file(spark.sparkContext.broadcast(level), parts)), "part bigint, tokens binary, owners binary")
    met = written(files.groupBy("part").applyInArrow(_meet(parts), _MET), "met")
    # leaders, and the classes that follow them
    twins = classes.groupBy(F.col("x.a").alias("a")).agg(F.count("*").alias("k"), F.min("x").alias("y")).where("k > 1")  # different sets, equal in the half of the hash that is filed
    by_a = classes.select("x", "n", F.col("x.a").alias("a"), "bits")
    degree = met.groupBy("a").agg(F.sum("others").alias("degree"))
    led = met.select("token", "a").join(degree, "a").groupBy("token").agg(F.max(F.struct("degree", "a")).alias("lead"), F.count("*").alias("n"))
    led = written(led.select("token", F.col("lead.a").alias("leader"), "n"), "leaders")
    follow = join_unique(met.select("token", "a"), led.drop("n"), "token", led.select("token", "n"), met.count(), "inner", limit=LIMIT).where("a <> leader")
    best = follow.groupBy("a", "leader").agg(F.count("*").alias("k")).groupBy("a").agg(F.max(F.struct("k", "leader")).alias("best")).select("a", F.col("best.leader").alias("leader"), F.col("best.k").alias("k"))
    stars = best.join(by_a, "a").where("k * 25 > n").drop("a")  # those that meet little are left to the trees
    stars = stars.join(by_a.select(F.col("x").alias("y"), F.col("a").alias("leader"), F.col("n").alias("m"), F.col("bits").alias("bits_y")), "leader").select("x", "y", "n", "m", "bits", "bits_y")
    stars = stars.mapInArrow(task(_roomy(similarity)), f"x {_KIND}, y {_KIND}")
    stars = written(stars.unionByName(by_a.join(twins, "a").where("x <> y").select("x", "y")), "stars")
    links = compared(docs, classes, stars, similarity, "links")
    groups = components(links)
    discard(led, stars, links)
    # the rest
    pairs = open_pairs(met, classes, groups, similarity)
    discard(met)
    more = compared(docs, classes, compared(docs, classes, pairs, similarity, "likely", thin=True), similarity, "more")
    merged = more.join(groups.select("x", "c"), "x", "left").select("y", F.coalesce("c", "x").alias("x"))
    merged = merged.join(groups.select(F.col("x").alias("y"), "c"), "y", "left").select("x", F.coalesce("c", "y").alias("y"))
    same = classes.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("x").alias("y")).where("k > 1").select("doc_id", "y")  # one document with several texts
    same = classes.join(same, "doc_id").where("x <> y").join(groups, "x", "left").select(F.coalesce("c", "x").alias("x"), "y").join(groups.select(F.col("x").alias("y"), "c"), "y", "left").select("x", F.coalesce("c", "y").alias("y"))
    top = components(merged.unionByName(same)).select(F.col("x").alias("c"), F.col("c").alias("top"))
    final = classes.join(groups, "x", "left").withColumn("c", F.coalesce("c", "x")).join(top, "c", "left").select("x", "doc_id", "copies", F.coalesce("top", "c").alias("c"))
    final = written(final, "final")
    discard(classes, pairs, more)
    least = written(final.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "components")
    named = join_unique(final, least.select("c", "component_id"), "c", least.select("c", "n"), final.count(), "inner")
    named = keep(written(named.select("x", "component_id", "copies"), "named"))
    discard(final, least)
    out = join_unique(rows, named.select("x", "component_id"), "x", named.select("x", F.col("copies").alias("n")), rows.count(), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's; rows with the same doc_id are one document and all stay, as do those with a null one."""
    others = similar_groups(docs, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(written(others, "others")), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as materialized (
    select doc_id, unnest(list_distinct(case when len(words) between 1 and 4 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) end)) as shingle from w
), n as materialized (
    select doc_id, count(*) as n from s group by 1
), links as materialized (
    select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach as (
    select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b
)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id from documents d left join n on n.doc_id = d.doc_id join reach r on r.a = d.doc_id group by d.doc_id
"""
