"""Operator 7: token sequences in training order, as fixed-stride binary shards.

Documents are tokenised once; each ends with the special id and is cut into sequences of ``length`` ids, the last filled up with that id in its
shard. Task by task the ids go to staging files in the shared folder. Sequences are numbered by (doc_id, position), a keyed Feistel network over the
smallest even number of bits that holds all numbers, walked along its cycle until it falls among them, maps each number to its slot, one to
one, and shard s holds slots s * per_shard and on, ``2 * length`` bytes each (little-endian 16-bit ids). A reader finds slot n at a known byte of
a known file and resumes from there; a shard depends on nothing but the key and the corpus, so any can be written again by itself.

A shard's writer reads its sequences from staging by ranges, a few sequences at a time, forward in each file. Reading each file once and
shuffling all ids to their writers would need no ranges, but about once the input more of disk.

Null and empty texts are one sequence with the special id alone. Rows with a null doc_id take part, first of all. Rows with the same id follow each
other by their text's hash, equal rows by their place in staging. An empty table gives no shards. Texts of any length are tokenised whole. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import RANKS, SPECIAL_ID, encoder
from .common import own, remove, shared_dir, slices, table, task, tokenizer_path, written

#: Characters up to which a text is encoded in one go here: many texts keep a task busy, so parts of one needn't be joined.
WHOLE = 1 << 16
#: Sequences of a document that are compressed together in staging files.
TOGETHER = 8
LENGTH, PER_SHARD, KEY, ROUNDS = 256, 32_768, "training-order", 4


class Feistel:
    """A keyed permutation of 0 .. n-1, for arrays of numbers."""

    def __init__(self, n: int, key: str = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, -(-max(1, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{n}:{i}".encode(), digest_size=8).digest(), "little")) for i in range(rounds)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _network(self, x: np.ndarray, keys: list) -> np.ndarray:
        a, b = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            a, b = b, a ^ self._round(b, key)
        return (b << np.uint64(self.half)) | a

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._network(np.asarray(x, np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._network(x[out], keys)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


_STAGED = "doc_id bigint, mark bigint, n_tokens bigint, n_seqs bigint, file string, at bigint, starts array<bigint>"


def _stage(folder: str, ranks: str, length: int):
    """Writes a task's ids to one file; a row for each document says where. A task that runs again writes another file, and only the one whose rows are kept counts."""

    def run(batches):
        e = encoder(ranks, WHOLE)
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name, at, out = f"staged-{uuid.uuid4().hex}.bin", 0, None
        try:
            for b in slices(batches):
                rows = []
                for doc, mark, text in zip(*[c.to_pylist() for c in b.columns]):
                    ids = [*e.encode(text), SPECIAL_ID]
                    size = len(ids)
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}")
                    raw, starts = np.array(ids, "<u2").tobytes(), [at]
                    for i in range(0, len(raw), 2 * length * TOGETHER):
                        body = zlib.compress(raw[i : i + 2 * length * TOGETHER], 1)
                        out.write(body)
                        starts.append(starts[-1] + len(body))
                    rows.append((doc, mark, size, -(-size // length), name, at, starts))
                    at = starts[-1]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "mark", "n_tokens", "n_seqs", "file", "at", "starts"])
        finally:
            if out is not None:
                out.close()

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with ``first``, the number of their first sequence, in order of (doc_id, mark, n_seqs)."""
    spark = docs.sparkSession
    keys = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("n_seqs"), F.col("file"), F.col("at")]
    part = written(docs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "numbered")
    sums, total = {}, 0
    for r in sorted(part.groupBy("part").agg(F.sum("n_seqs").alias("n")).collect()):  # one row for each partition
        sums[r.part], total = total, total + r.n
    base = F.broadcast(spark.createDataFrame([*sums.items()], "part int, base bigint"))
    w = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return part.join(base, "part").withColumn("first", F.col("base") + F.coalesce(F.sum("n_seqs").over(w), F.lit(0))).drop("part", "base")


def _slots(n: int, key: str, per_shard: int):
    def run(batches):
        f = Feistel(n, key)
        for b in batches:
            slot = f.slot(b.column("number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), *[b.column(c) for c in ("doc_id", "seq_no", "n_tokens", "file", "at", "size")]], ["slot", "shard", "doc_id", "seq_no", "n_tokens", "file", "at", "size"])

    return run


def _write(staged: str, folder: str, length: int, per_shard: int):
    """Writes whole shards from rows sorted by shard and slot, and gives a row for each sequence written."""
    stride = 2 * length

    def run(batches):
        store, target = _open(folder)
        source, staging = _open(staged)
        store.create_dir(target, recursive=True)
        open_files: dict = {}

        def flush(shard, rows):
            body = bytearray(np.full(len(rows) * length, SPECIAL_ID, "<u2").tobytes())
            begin, last, ids = shard * per_shard, None, b""
            for file, begin_at, slot, _, seq_no, n_tokens, size in sorted(rows):  # a file's reads go forward
                if file not in open_files:
                    if len(open_files) >= 64:
                        open_files.pop(next(iter(open_files))).close()
                    open_files[file] = source.open_input_file(f"{staging}/{file}")
                if last != (file, begin_at):
                    last, ids = (file, begin_at), zlib.decompress(open_files[file].read_at(size, begin_at))
                from_, at = seq_no % TOGETHER * stride, (slot - begin) * stride
                body[at : at + 2 * n_tokens] = ids[from_ : from_ + 2 * n_tokens]
            name = f"shard-{shard:06d}.bin"
            part = f"{target}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(body)
            store.move(part, f"{target}/{name}")  # whole or not at all; a task that runs again writes the same bytes
            sums = [zlib.crc32(memoryview(body)[i * stride : (i + 1) * stride]) for i in range(len(rows))]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows]), pa.array([shard] * len(rows)), *[pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)], pa.array([name] * len(rows)), pa.array([(r[2] - begin) * stride for r in rows]), pa.array(sums)],
                ["slot", "shard", "doc_id", "seq_no", "n_tokens", "file", "offset", "crc32"],
            )

        shard, rows = None, []
        for b in batches:
            shards = b.column("shard").to_pylist()
            for s, r in zip(shards, zip(*[b.column(c).to_pylist() for c in ("file", "at", "slot", "doc_id", "seq_no", "n_tokens", "size")])):
                if s != shard:
                    if rows:
                        yield flush(shard, rows)
                    shard, rows = s, []
                rows.append(r)
        if rows:
            yield flush(shard, rows)

    return run


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, ranks_file: str | None = None) -> DataFrame:
    """Writes the shards into ``folder`` and returns a row for each sequence: slot, shard, doc_id, seq_no, n_tokens (ids before filling), file, offset, crc32."""
    spark = docs.sparkSession
    staging = shared_dir(spark, "staging")
    texts = own(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text")
    staged = written(texts.mapInArrow(task(_stage(staging, ranks_file or tokenizer_path(RANKS), length)), _STAGED), "staged")
    docs_at = numbered(staged)
    n = staged.agg(F.coalesce(F.sum("n_seqs"), F.lit(0))).first()[0]
    one = docs_at.select("doc_id", F.col("n_tokens").alias("all"), "file", "starts", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_seqs") - 1)).alias("seq_no"))
    one = one.select("doc_id", "seq_no", (F.col("first") + F.col("seq_no")).alias("number"), F.least(F.lit(length).cast("bigint"), F.col("all") - F.col("seq_no") * length).alias("n_tokens"), "file", F.expr(f"starts[int(seq_no div {TOGETHER})]").alias("at"), F.expr(f"int(starts[int(seq_no div {TOGETHER}) + 1] - starts[int(seq_no div {TOGETHER})])").alias("size"))
    slots = one.mapInArrow(_slots(max(1, n), key, per_shard), "slot bigint, shard bigint, doc_id bigint, seq_no bigint, n_tokens bigint, file string, at bigint, size int")
    shards = max(1, -(-n // per_shard))
    dealt = slots.repartitionByRange(min(shards, 100_000), "shard").sortWithinPartitions("shard", "slot")
    out = written(dealt.mapInArrow(task(_write(staging, folder, length, per_shard)), "slot bigint, shard bigint, doc_id bigint, seq_no bigint, n_tokens bigint, file string, offset bigint, crc32 bigint"), "manifest")
    out.count()
    remove(spark, staging)
    return out


def read_from(spark: SparkSession, folder: str, slot: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The ``n`` sequences from ``slot`` on, as a trainer that resumes there reads them."""
    store, path = _open(folder)
    out, stride = [], 2 * length
    while n > 0:
        shard, at = divmod(slot, per_shard)
        take = min(n, per_shard - at)
        with store.open_input_file(f"{path}/shard-{shard:06d}.bin") as f:
            got = f.read_at(take * stride, at * stride)
        out.append(np.frombuffer(got, "<u2").reshape(-1, length))
        if len(got) < take * stride:
            break
        slot, n = slot + take, n - take
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))
