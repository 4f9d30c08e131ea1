"""Operator 13: vector codes by product quantisation, with codebooks from Elkan's form of Lloyd's rounds.

Vectors become whole numbers and are cut into ``PARTS`` equal consecutive parts, each with a codebook of its own. A table written after each round
keeps, for each vector, its entries, for each part an upper bound of the distance to its entry, and a lower bound for each entry of the codebook. In
the next round bounds are shifted by how far the entries have moved, and an entry is compared only if neither its lower bound nor half its distance
from the part's own entry lies strictly above the upper bound. Distances are compared as whole squares, so that ties are exact. Bounds are kept in half
precision on one scale for all, rounded outward; a bound that doesn't fit tells nothing. Each task writes the sums of its parts by entry beside its last row.

Rows take part whose vector is not null and holds neither null nor non-finite components, all of the length that most rows have (the longest of
such); a row of another length is dropped as well. Codebooks start with the rows of smallest vec_id, ties by vector, null ids last; with fewer rows than
``ENTRIES`` they have as many entries as there are rows. A length that ``PARTS`` doesn't divide is filled up with zeros. Repeated rows count each; an
empty table gives no rows. Components are exact at any size: where one is ``WIDE`` or more, whole numbers of Python take the place of 64 bits.
``error`` and ``label_error`` are null where they don't fit 64 bits. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_unique, own, scratch, table, task, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Components from here on are held as whole numbers of Python: squares and sums of smaller ones fit 64 bits.
WIDE = 2**27
#: Rows that are compared at a time, and tables of sums that are merged at once by a task's successor.
ROWS, MERGED = 1_024, 16

_STATE = "vec_id bigint, label string, x binary, code binary, upper binary, lower binary, error bigint, sums string"


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; ``label`` as text that tells null from all others."""
    big = F.lit(float("inf"))
    x = own(df, key, vector, label).where(F.col(f"`{vector}`").isNotNull())
    x = x.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.when(F.col(f"`{label}`").isNotNull(), F.concat(F.lit("="), F.col(f"`{label}`").cast("string"))).otherwise("").alias("label"), F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double")).alias("v"))
    x = x.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < big), F.lit(False))))
    most = x.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return x.where(F.size("v") == (most.n if most else 0))


def whole(v: np.ndarray, wide: bool) -> np.ndarray:
    """Components times ``SCALE``, downward, as rows of parts."""
    if wide:
        x = np.array([[math.floor(c) * int(SCALE) if abs(c) >= 2**53 else math.floor(c * SCALE) for c in row] for row in v.tolist()], dtype=object).reshape(v.shape)
    else:
        x = np.floor(v * SCALE).astype(np.int64)
    fill = -v.shape[1] % PARTS
    if fill:
        x = np.hstack([x, np.zeros((len(x), fill), x.dtype)])
    return x.reshape(len(x), PARTS, -1)


class Codebooks:
    """Entries of all parts, (part, entry, component) whole numbers, with how far each has moved in the last round."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.zeros(entries.shape[:2]) if moved is None else moved
        between = squares(entries[:, :, None, :], entries[:, None, :, :])
        self.half = np.nextafter(0.5 * low(between), -np.inf)

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The next round's: means of the parts of each entry, downward; an entry without any stays."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries.astype(object))
        if self.entries.dtype != object:
            new = new.astype(np.int64)
        return Codebooks(new, high(squares(new, self.entries)))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers."""
    d = a - b
    return (d * d).sum(-1) if d.shape[-1] else np.zeros(d.shape[:-1], d.dtype)


def _root(square: np.ndarray, beyond: float) -> np.ndarray:
    """About the root; ``beyond`` for roots that no double can hold."""
    if square.dtype != object:
        return np.sqrt(square.astype(float))
    roots = [math.isqrt(x) for x in square.ravel().tolist()]
    return np.array([float(r) + (beyond > 1e308 and r > 0) if r < 2**1000 else beyond for r in roots]).reshape(square.shape)


def high(square: np.ndarray) -> np.ndarray:
    """A distance not below the root of a square."""
    return _root(square, math.inf) * (1 + 1e-14)


def low(square: np.ndarray) -> np.ndarray:
    """A distance not above it."""
    return _root(square, 2.0**1000) * (1 - 1e-14)


def packed(bound: np.ndarray, scale: float, up: bool) -> np.ndarray:
    """Bounds in half precision, rounded away from the distance; infinite upper and zero lower ones tell nothing."""
    with np.errstate(over="ignore"):
        half = (bound / scale).astype(np.float16)
    wrong = half.astype(float) * scale < bound if up else half.astype(float) * scale > bound
    return np.where(wrong, np.nextafter(half, np.float16(np.inf if up else -np.inf)), half)


class Round:
    """Assigns parts to entries; ``compared`` counts distances that were worked out."""

    def __init__(self, books: Codebooks, scale: float):
        self.books, self.scale, self.compared = books, scale, 0

    def first(self, x: np.ndarray):
        """The state before any round: nothing is known."""
        n, p, e = len(x), *self.books.entries.shape[:2]
        return np.zeros((n, p), np.int64), np.full((n, p), np.inf), np.zeros((n, p, e))

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(code, upper, lower, squares) for rows of parts, their last entries and bounds; the squares are of the parts' own entries."""
        entries, (n, p) = self.books.entries, code.shape
        parts = np.arange(p)[None, :]
        upper = upper + self.books.moved[parts, code]
        lower = np.maximum(lower - self.books.moved[None], 0.0) * (1 - 1e-14)
        half = self.books.half[parts, code]  # of each entry from the part's own
        own_entry = np.zeros(lower.shape, bool)
        np.put_along_axis(own_entry, code[:, :, None], True, 2)
        open_ = ~own_entry & (lower <= upper[:, :, None]) & (half <= upper[:, :, None])
        square = squares(x, entries[parts, code])  # makes the upper bound tight, and is the error in the end
        self.compared += code.size
        upper = high(square)
        open_ &= (lower <= upper[:, :, None]) & (half <= upper[:, :, None])
        np.put_along_axis(lower, code[:, :, None], low(square)[:, :, None], 2)
        i, j, e = np.nonzero(open_)
        self.compared += len(i)
        if len(i):
            found = squares(x[i, j], entries[j, e])
            lower[i, j, e] = low(found)
            if found.dtype == object:
                best: dict = {}
                for a, b, c, d in zip(i.tolist(), j.tolist(), e.tolist(), found.tolist()):
                    best[a, b] = min(best.get((a, b), (square[a, b], int(code[a, b]))), (d, c))
                code, square = code.copy(), square.copy()
                for (a, b), (d, c) in best.items():
                    square[a, b], code[a, b] = d, c
            else:
                all_ = np.full(lower.shape, np.iinfo(np.int64).max)
                all_[i, j, e] = found
                np.put_along_axis(all_, code[:, :, None], square[:, :, None], 2)
                code = all_.argmin(2)  # of equal squares the lower index
                square = np.take_along_axis(all_, code[:, :, None], 2)[:, :, 0]
            upper = high(square)
        return code, upper, lower, square


def _summed(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (part, entry, component) and counts of the parts of each entry, as whole numbers of any size."""
    p, d = x.shape[1:]
    sums, counts = np.zeros((p, entries, d), x.dtype), np.zeros((p, entries), np.int64)
    for j in range(p):
        np.add.at(sums[j], code[:, j], x[:, j])
        counts[j] = np.bincount(code[:, j], minlength=entries)
    return sums.astype(object), counts.astype(object)


def _text(sums: np.ndarray, counts: np.ndarray) -> str:
    return ",".join(map(str, sums.ravel().tolist())) + ";" + ",".join(map(str, counts.ravel().tolist()))


def _numbers(text: str, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = ([int(y) for y in x.split(",") if y] for x in text.split(";"))
    return np.array(sums, dtype=object).reshape(shape), np.array(counts, dtype=object).reshape(shape[:2])


def _blobs(a: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    flat = np.ascontiguousarray(a).reshape(len(a), -1)
    width = flat.shape[1] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(flat.tobytes() or b"\0")])


def _rows(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _passes(shared, schema: pa.Schema, last: bool):
    """One round over the rows of a task: from (vec_id, label, v) in the first, from the state after."""

    def run(batches):
        books, scale, wide, dims = shared.value
        p, e = books.entries.shape[:2]
        now, pending, total = Round(books, scale), None, None
        kind, width = (None, None) if wide else (np.int32, -(-dims // PARTS))
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                rows = b.slice(a, ROWS)
                n = rows.num_rows
                if "v" in rows.schema.names:
                    v = np.asarray(rows.column("v").flatten(), dtype=float).reshape(n, dims)
                    x = whole(v, wide)
                    code, upper, lower = now.first(x)
                    kept = _blobs(v) if wide else _blobs(x.astype(np.int32))
                else:
                    kept = rows.column("x")
                    x = whole(_rows(kept, np.float64, (dims,)), True) if wide else _rows(kept, kind, (p, width)).astype(np.int64)
                    code = _rows(rows.column("code"), np.uint8, (p,)).astype(np.int64)
                    upper = _rows(rows.column("upper"), np.float16, (p,)).astype(float) * scale
                    lower = _rows(rows.column("lower"), np.float16, (p, e)).astype(float) * scale
                code, upper, lower, square = now.assign(x, code, upper, lower)
                none = pa.nulls(n, pa.binary())
                if last:
                    error = pa.array([s if (s := sum(r)) < 2**63 else None for r in square.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), none, _blobs(code.astype(np.uint8)), none, none, error, pa.nulls(n, pa.string())], schema=schema)
                    continue
                sums = _summed(x, code, e)
                total = sums if total is None else tuple(s + t for s, t in zip(total, sums))
                if pending is not None:
                    yield pa.RecordBatch.from_arrays([*pending, pa.nulls(len(pending[0]), pa.string())], schema=schema)
                pending = [rows.column("vec_id"), rows.column("label"), kept, _blobs(code.astype(np.uint8)), _blobs(packed(upper, scale, True)), _blobs(packed(lower, scale, False)), pa.nulls(n, pa.int64())]
        if pending is not None:
            yield pa.RecordBatch.from_arrays([*pending, pa.array([None] * (len(pending[0]) - 1) + [_text(*total)], pa.string())], schema=schema)

    return run


def _merger(shape: tuple[int, int, int]):
    """Adds up the sums of many tasks, one after the other."""

    def run(batches):
        total = None
        for b in batches:
            for t in b.column(0).to_pylist():
                x = _numbers(t, shape)
                total = x if total is None else tuple(s + t for s, t in zip(total, x))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [_text(*total)]})

    return run


def fitted(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks | None]:
    """The final state, (vec_id, label, code, error), and codebooks; rows as ``usable`` gives them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark, schema = rows.sparkSession, to_arrow_schema(_parse_datatype_string(_STATE))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not start:
        return spark.createDataFrame([], "vec_id bigint, label string, code binary, error bigint"), None
    top = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    dims, wide = len(start[0].v), top * SCALE >= WIDE
    books = Codebooks(whole(np.array([r.v for r in start], float).reshape(len(start), dims), wide).transpose(1, 0, 2))
    scale = min(1e290, max(1.0, 2 * (top * SCALE + 1) * math.sqrt(-(-dims // PARTS)) / 60_000))  # no distance is longer than 60,000 of these
    shape = books.entries.shape
    state = rows
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, scale, wide, dims))
        new = written(state.mapInArrow(task(_passes(shared, schema, n == rounds)), _STATE), f"codes-{n}")
        if n:
            discard(state)
        state = new
        if n < rounds:
            parts = state.where("sums is not null").select("sums").repartition(MERGED).mapInArrow(_merger(shape), "sums string").collect()  # MERGED rows at most
            total = [_numbers(r.sums, shape) for r in parts]
            books = books.after(sum(t[0] for t in total), sum(t[1] for t in total))
    return state.select("vec_id", "label", "code", "error"), books


def codes(df: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows of a table (vec_id, embedding, label) that take part."""
    with scratch() as keep:
        state, books = fitted(usable(df), rounds, entries)
        by_label = written(state.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint").alias("label_error"), F.count("*").alias("n")), "labels")
        out = join_unique(state, by_label.drop("n"), "label", by_label, state.count())
        out = out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))
        return keep(written(out, "codes"))


def op13_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def _round_sql(r: int) -> str:
    near = f"""
assigned{r} as materialized (
    select n, p, arg_min(e, (d, e)) as e, min(d) as d from (
        select x.n, x.p, c.e, list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d from parts x join books{r} c on x.p = c.p
    ) group by all
)"""
    books = f""",
means{r} as (
    select p, e, list(m order by j) as c from (
        select a.p, a.e, j, floor(sum(x.x[j])::decimal(38, 0) / count(*))::bigint as m from assigned{r} a join parts x on a.n = x.n and a.p = x.p, range(1, 1 + len(x.x)) t(j) group by all
    ) group by all
), books{r + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from books{r} b left join means{r} m on b.p = m.p and b.e = m.e),"""
    return near + (books if r < ROUNDS else "")


OP13_SQL = f"""
with whole as (
    select row_number() over (order by vec_id, embedding) - 1 as n, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::double)::bigint) as x
    from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)
), parts as materialized (
    select n, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] as x from whole, range({PARTS}) t(p)
), books0 as materialized (select p, n as e, x as c from parts where n < {ENTRIES}),
{"".join(_round_sql(r) for r in range(ROUNDS + 1))}, coded as (
    select n, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from assigned{ROUNDS} group by n
), digest as (
    select sha256(string_agg(c[j]::varchar, ',' order by p, e, j)) as codebooks_sha256 from books{ROUNDS}, range(1, 1 + len(c)) t(j)
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join whole using (n), digest
"""
