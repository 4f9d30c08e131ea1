"""Persisted indexes of texts: logs of small sorted segments, so that a search reads its own tokens' postings and an update writes in proportion to the change.

A segment holds the postings of some items, and as those of the empty token the items' lengths. Its files are of other items each and sorted by token; a row has a token's
postings in some hundreds of items, so that nothing is shuffled and few rows are sorted. An update adds a segment with the changed items and a table of
the keys that it replaces or drops, which hide those keys in all earlier segments; nothing else is written. Segments are of tiers by their number of
items, powers of ``fanout``: as soon as a tier has ``fanout`` segments they are merged into one without what is hidden, so that an
item is written again about once a tier, and a search reads few segments. A manifest names the live segments; it is switched once
all files of a commit are there, and what a broken commit leaves is never read (``vacuum`` deletes it).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spaced, spread
from ..sources.versions import Versions
from ..sources.versions import scratch as _scratch
from .filters import has_wildcard
from .search import phrase_tokens, scored_by

FANOUT = 4
#: Keys up to which a table of hidden ones is broadcast.
BROADCAST = 4_000_000
GRAM = 3
#: Bytes of text whose postings are made at once; items of a file at least, if there are fewer of them than cores call for.
PIECE, FILE = 8_000_000, 2_000


def scratch(spark: SparkSession) -> str:
    return _scratch(spark, "index")


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, cut so that ``sizes`` sum up to about ``most`` in each."""
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
    for i, j in zip(first, np.append(first[1:], batch.num_rows)):
        yield batch.slice(i, j - i)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _blocks(tokens: pa.Array, first: np.ndarray, entries: pa.StructArray) -> pa.RecordBatch:
    """Rows (token, postings): those of each token begin at ``first``."""
    return pa.RecordBatch.from_arrays([tokens, pa.ListArray.from_arrays(pa.array(np.append(first, len(entries)), pa.int32()), entries)], ["token", "postings"])


def _raw(c: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a column of UTF-8, and where its rows end, from 0 on."""
    c = c.cast(pa.large_binary())
    ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return (c.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if ends[-1] > ends[0] else b""), ends - ends[0]


#: Bytes that tokens have in ``spaced`` texts.
WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _tokens(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of a column of ``spaced`` texts, and how many each row has."""
    raw, ends = _raw(c)
    data = np.frombuffer(raw, np.uint8)
    word = WORD[data]
    new = word.copy()
    new[1:] &= ~word[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    new[at] = word[at]  # a row's token doesn't go on in the next
    begins = np.flatnonzero(new)
    offsets = np.append(np.cumsum(word) - word, word.sum())[np.append(begins, len(data))].astype(np.int32)
    before = np.append(0, np.cumsum(new))
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[word])), np.diff(before[ends])


def _bytes(b: pa.RecordBatch) -> np.ndarray:
    return sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[1:])


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a key and ``spaced`` texts the blocks of postings, and as those of the empty token all items with their number of tokens."""
    for whole in batches:
        for b in pieces(whole, 1 + _bytes(whole)):
            key, n = b.column(0), b.num_rows
            found = [_tokens(c) for c in b.columns[1:]]
            sizes = [k for _, k in found]
            dl = np.sum(sizes, 0).astype(np.int32)
            row = np.concatenate([np.repeat(np.arange(n), k) for k in sizes])
            col = np.repeat(np.arange(len(sizes), dtype=np.int32), [k.sum() for k in sizes])
            pos = np.concatenate([np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) for k in sizes]).astype(np.int32)
            coded = pa.concat_arrays([t for t, _ in found]).dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            order = np.argsort(code * n + row, kind="stable")  # by token and item; columns and positions are in order
            code, row, col, pos = code[order], row[order], col[order], pos[order]
            first = _runs((code * n + row) * len(sizes) + col)
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)), pa.int32()), pa.array(pos))
            names = ["key", "col", "dl", "positions"]
            if len(first):
                begins = _runs(code[first])
                yield _blocks(coded.dictionary.take(pa.array(code[first][begins])), begins, pa.StructArray.from_arrays([key.take(pa.array(row[first])), pa.array(col[first]), pa.array(dl[row[first]]), at], names))
            none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
            yield _blocks(pa.array([""]), np.zeros(1, np.int64), pa.StructArray.from_arrays([key, pa.array(np.zeros(n, np.int32)), pa.array(dl), none], names))


def _characters(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a column of UTF-8, and how many each row has."""
    raw, ends = _raw(c)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.diff(before[ends])


def _gram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a key and texts the blocks of their runs of three characters, A-Z in lower case; all items as those of the empty run."""
    for whole in batches:
        work = [*pieces(whole, 1 + _bytes(whole))][::-1]
        while work:
            b = work.pop()
            key, n = b.column(0), b.num_rows
            texts = [_characters(c) for c in b.columns[1:]]
            every = np.concatenate([t for t, _ in texts])
            every = np.where((every >= 65) & (every <= 90), every + 32, every)
            there = np.zeros(0x110000, bool)
            there[every] = True
            alphabet = np.flatnonzero(there)
            k = max(1, len(alphabet))
            if k**GRAM * n >= 1 << 63:  # never of one item
                work += [b.slice(n // 2), b.slice(0, n // 2)]
                continue
            yield _blocks(pa.array([""]), np.zeros(1, np.int64), pa.StructArray.from_arrays([key], ["key"]))
            place = np.concatenate([[0], np.cumsum(there)])[every]
            text = np.repeat(np.arange(n * len(texts)), np.concatenate([c for _, c in texts]))
            starts = np.flatnonzero(text[: 1 - GRAM] == text[GRAM - 1 :]) if len(text) >= GRAM else np.zeros(0, np.int64)
            if not len(starts):
                continue
            gram = sum(place[starts + i] * k ** (GRAM - 1 - i) for i in range(GRAM))
            found = np.sort(gram * n + text[starts] % n)
            found = found[_runs(found)]
            gram, row = np.divmod(found, n)
            first = _runs(gram)
            letters = alphabet[np.stack([gram[first] // k ** (GRAM - 1 - i) % k for i in range(GRAM)], 1)]
            ends = np.append(0, np.cumsum((1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)).sum(1))).astype(np.int32)
            tokens = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.astype("<u4").tobytes().decode("utf-32-le").encode()))
            yield _blocks(tokens, first, pa.StructArray.from_arrays([key.take(pa.array(row))], ["key"]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of single postings that come in order of their tokens."""
    for b in batches:
        if b.num_rows:
            first = _runs(b.column(0).dictionary_encode().indices.to_numpy())
            yield _blocks(b.column(0).take(pa.array(first)), first, pa.StructArray.from_arrays(b.columns[1:], b.schema.names[1:]))


def _type(entry: str, key: str, df: DataFrame) -> str:
    return f"token string, postings array<{entry.format(key=df.schema[key].dataType.simpleString())}>"


def _valid(items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key and the columns as valid UTF-8, dealt over all cores."""
    return spread(items.select(key, *columns)).select(key, *[F.make_valid_utf8(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])


def text_blocks(items: DataFrame, columns: list[str], key: str = "item_id") -> DataFrame:
    """(token, postings) of the columns: of some hundreds of items at once, the postings of each token in one row. Nothing is shuffled but few input partitions."""
    x = _valid(items, key, columns)
    return x.select(key, *[spaced(F.col(c)).cast("binary").alias(c) for c in x.columns[1:]]).mapInArrow(_text_blocks, _type(TextIndex.entry, key, items))


def postings(items: DataFrame, columns: list[str], key: str = "item_id") -> DataFrame:
    """(token, key, col, positions, dl) of all tokens of the columns, one row for each token of an item's column; ``dl`` is the item's number of tokens. Keys are unique."""
    return text_blocks(items, columns, key).where("token <> ''").select("token", F.inline("postings")).select("token", F.col("key").alias(key), "col", "positions", "dl")


class Segments:
    """What indexes share: segments, hidden keys, merges. A search before the first ``build`` finds nothing."""

    entry = ""

    def __init__(self, spark: SparkSession, folder: str, columns: list[str], key: str = "item_id", fanout: int = FANOUT):
        self.spark, self.folder, self.columns, self.key, self.fanout = spark, folder.rstrip("/"), columns, key, fanout
        self.versions = Versions(spark, self.folder)

    def _blocks(self, items: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _few(self, blocks: DataFrame, docs: int) -> DataFrame:
        """Blocks of few items in few partitions; those of many stay where they are."""
        files = 1 + docs // FILE
        return blocks.repartition(files) if files < self.spark.sparkContext.defaultParallelism else blocks

    def _write(self, blocks: DataFrame, seq: int, clean: int) -> dict:
        """A segment of blocks in order of their tokens within partitions."""
        name, seen, item = f"{seq}-{uuid.uuid4().hex[:8]}", Observation(), F.col("token") == ""
        size = F.aggregate("postings", F.lit(0).cast("bigint"), lambda a, p: a + p["dl"]) if "dl" in self.entry else F.lit(0)
        total = lambda x, name: F.coalesce(F.sum(F.when(item, x)), F.lit(0)).alias(name)
        blocks.observe(seen, total(F.size("postings"), "n"), total(size, "size")).write.parquet(f"{self.folder}/segments/{name}/postings")
        return {"name": name, "seq": seq, "clean": clean, "docs": seen.get["n"], "size": seen.get["size"]}

    def _new(self, items: DataFrame, seq: int, docs: int) -> dict:
        return self._write(self._few(self._blocks(items), docs).sortWithinPartitions("token"), seq, seq)

    def build(self, items: DataFrame) -> Segments:
        """An index of these items alone."""
        version, now = self.versions.current()
        seq = now.get("seq", 0) + 1
        one = self._new(items, seq, items.select(self.key).count())
        self.versions.commit(version, {"seq": seq, "segments": [one], "hidden": [], "n": one["docs"], "size": one["size"]})
        return self

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> Segments:
        """Takes changed items instead of those with their keys, and drops those in ``gone`` (key). Keys are unique in each."""
        version, now = self.versions.current()
        if not version:
            return self.build(changed)
        seq, seen = now["seq"] + 1, Observation()
        keys = changed.select(self.key) if gone is None else changed.select(self.key).unionByName(gone.select(self.key))
        name = f"{seq}-{uuid.uuid4().hex[:8]}"
        keys.distinct().observe(seen, F.count("*").alias("n")).write.parquet(f"{self.folder}/hidden/{name}")
        hidden = {"name": name, "seq": seq, "n": seen.get["n"]}
        size = F.sum("dl") if "dl" in self.entry else F.lit(0)
        left = self._live(now, F.col("token") == "").join(self._keys([hidden]), self.key, "left_semi").agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
        one = self._new(changed, seq, hidden["n"])
        now = {"seq": seq, "segments": [*now["segments"], one], "hidden": [*now["hidden"], hidden], "n": now["n"] - left[0] + one["docs"], "size": now["size"] - left[1] + one["size"]}
        version = self.versions.commit(version, now)
        while (many := self._crowded(now)) is not None:
            version, now = self._merged(version, now, many)
        return self

    def _tier(self, segment: dict) -> int:
        tier, docs = 0, segment["docs"]
        while docs >= self.fanout:
            tier, docs = tier + 1, docs // self.fanout
        return tier

    def _crowded(self, now: dict) -> list[dict] | None:
        """The segments of the lowest tier that has ``fanout`` of them."""
        tiers: dict[int, list[dict]] = {}
        for s in now["segments"]:
            tiers.setdefault(self._tier(s), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)

    def merge(self) -> Segments:
        """Merges all segments into one."""
        version, now = self.versions.current()
        if len(now.get("segments", ())) > 1 or now.get("hidden"):
            self._merged(version, now, now["segments"])
        return self

    def _merged(self, version: int, now: dict, some: list[dict]) -> tuple[int, dict]:
        part = now | {"segments": some}
        x = self._live(part, docs=sum(s["docs"] for s in some)).withColumnRenamed(self.key, "key").drop("seq")
        x = x.select("token", *[c for c in x.columns if c != "token"])
        one = self._write(x.mapInArrow(_joined, _type(self.entry, "key", x)), max(s["seq"] for s in some), now["seq"])
        names = {s["name"] for s in some}
        left = sorted([*[s for s in now["segments"] if s["name"] not in names], one], key=lambda s: s["seq"])
        needed = [h for h in now["hidden"] if any(s["seq"] < h["seq"] and s["clean"] < h["seq"] for s in left)]
        now = now | {"segments": left, "hidden": needed}
        return self.versions.commit(version, now), now

    def vacuum(self) -> None:
        """Deletes what no manifest's current version names: call it when no search runs."""
        _, now = self.versions.current()
        for kind in ("segments", "hidden"):
            live = {x["name"] for x in now.get(kind, ())}
            for name in self.versions.names(kind):
                if name not in live:
                    self.versions.remove(kind, name)

    def _keys(self, hidden: list[dict]) -> DataFrame:
        """(key, before): the keys of some tables of hidden ones, each with the last segment that may hold it."""
        out = None
        for h in hidden:
            x = self.spark.read.parquet(f"{self.folder}/hidden/{h['name']}").withColumn("before", F.lit(h["seq"]))
            out = x if out is None else out.unionByName(x)
        out = out.groupBy(self.key).agg(F.max("before").alias("before")) if len(hidden) > 1 else out
        return F.broadcast(out) if self._light(hidden) else out

    def _light(self, hidden: list[dict]) -> bool:
        return sum(h["n"] for h in hidden) <= BROADCAST

    def _live(self, now: dict, test: Column | None = None, docs: int | None = None) -> DataFrame:
        """The segments' postings that aren't hidden, a row each. ``test`` goes to the files, each sorted by token; with ``docs``, about how many items these are, they come by token within partitions."""
        out = None
        for s in now["segments"]:
            x = self.spark.read.parquet(f"{self.folder}/segments/{s['name']}/postings")
            x = (x if test is None else x.where(test)).withColumn("seq", F.lit(s["seq"]))
            out = x if out is None else out.unionByName(x)
        out = out if docs is None else self._few(out, docs).sortWithinPartitions("token")  # by blocks, not by single postings
        out = out.select("token", "seq", F.inline("postings")).withColumnRenamed("key", self.key)
        if now["hidden"]:
            out = out.join(self._keys(now["hidden"]), self.key, "left").where(F.col("before").isNull() | (F.col("seq") >= F.col("before"))).drop("before")
            out = out if docs is None or self._light(now["hidden"]) else out.sortWithinPartitions("token")
        return out

    def _found(self, tokens: list[str]) -> tuple[dict, DataFrame]:
        """The manifest, and the live postings of some tokens."""
        version, now = self.versions.current()
        if not version:
            x = self.spark.createDataFrame([], f"token string, seq int, postings array<{self.entry.format(key='bigint')}>")
            return {"n": 0, "size": 0}, x.select("token", "seq", F.inline("postings")).withColumnRenamed("key", self.key)
        return now, self._live(now, F.col("token").isin(tokens))


class TextIndex(Segments):
    """Postings with positions, for ranked phrases."""

    entry = "struct<key: {key}, col: int, dl: int, positions: array<int>>"

    def _blocks(self, items: DataFrame) -> DataFrame:
        return text_blocks(items, self.columns, self.key)

    def bm25(self, q: str) -> DataFrame:
        """(key, tf, score) as ``search.bm25`` gives them over the indexed items; the number of items and their mean length are in the manifest."""
        words = phrase_tokens(self.spark.range(1), q)
        now, read = self._found(words)
        each = [read.where(F.col("token") == w).select(self.key, "dl", "col", F.explode("positions").alias("pos")).select(self.key, "dl", "col", (F.col("pos") - k).alias("start")) for k, w in enumerate(words)]
        if not words or not now["n"]:
            return read.select(self.key, F.lit(0).alias("tf"), F.lit(0.0).alias("score")).where("false")
        found = each[0]
        for x in each[1:]:
            found = found.unionByName(x)
        whole = found.groupBy(self.key, "col", "start").agg(F.count("*").alias("m"), F.max("dl").alias("dl")).where(F.col("m") == len(words))
        tf = whole.groupBy(self.key).agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"))
        with_df = tf.crossJoin(F.broadcast(tf.agg(F.count("*").alias("df"))))  # one row
        return with_df.select(self.key, "tf", scored_by(F.lit(now["n"]), F.col("df"), F.col("tf"), F.col("dl"), F.lit(now["size"] / now["n"])).alias("score"))


def literal_grams(pattern: str, glob: bool) -> list[str]:
    """Runs of three characters that every value matching a LIKE or GLOB pattern holds, A-Z in lower case; none where its literal parts are shorter."""
    pattern = re.sub(r"\[\^?.[^\]]*\]", "*", pattern, flags=re.S) if glob else pattern
    parts = re.split(r"[*?\[]" if glob else r"[%_]", pattern)
    low = [p.translate({c: c + 32 for c in range(65, 91)}) for p in parts]
    return sorted({p[i : i + GRAM] for p in low for i in range(len(p) - GRAM + 1)})


class GramIndex(Segments):
    """Runs of three characters of columns, for LIKE and GLOB: the items that hold all runs of a pattern are candidates, and are compared with the pattern itself.

    Patterns without three literal characters in a row have no candidates to narrow: all items are compared.
    """

    entry = "struct<key: {key}>"

    def _blocks(self, items: DataFrame) -> DataFrame:
        x = _valid(items, self.key, self.columns)
        return x.select(self.key, *[F.col(c).cast("binary") for c in x.columns[1:]]).mapInArrow(_gram_blocks, _type(self.entry, self.key, items))

    def candidates(self, pattern: str, glob: bool) -> DataFrame | None:
        """Keys of the items that may match; None if all may."""
        runs = literal_grams(pattern, glob)
        if not runs:
            return None
        _, read = self._found(runs)
        return read.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col("n") == len(runs)).select(self.key)

    def narrowed(self, items: DataFrame, q: str, glob: bool) -> DataFrame:
        """Items that may match a search's text as ``search.glob_search`` or ``search.like_search`` reads it."""
        keys = self.candidates((q if has_wildcard(q) else f"*{q}*") if glob else f"%{q}%", glob)
        return items if keys is None else items.join(keys, self.key, "left_semi")
