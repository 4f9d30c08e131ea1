"""The merge-on-read store, its ledger, and ingestion into it."""

import random
import struct
import zlib

import numpy as np
import pytest
from docquarry.functions import phash
from docquarry.sources import files as src
from docquarry.streaming import ingest
from docquarry.streaming.store import Store
from pyspark.sql import functions as F

SCHEMA = "full_path string, size bigint, created_ts bigint, is_deleted int"


def rows(spark, part):
    return spark.createDataFrame(part, SCHEMA)


def plain(state, put, gone=()):
    for k, *v in put:
        old = state.get(k)
        state[k] = (v[0], old[1] if old and old[1] is not None else v[1], 0)
    for k in gone:
        if k in state and k not in {p[0] for p in put}:
            state[k] = (*state[k][:2], 1)


def shown(store):
    return {r[0]: tuple(r[1:]) for r in store.current().collect()}


@pytest.mark.parametrize("ratio", [0.0, 0.5, 99.0])
def test_equals_plain_upserts(spark, tmp_path, ratio):
    """Whether each batch is compacted, some are, or none."""
    r = random.Random(1)
    store, state = Store(spark, f"file://{tmp_path}/s", buckets=5, ratio=ratio), {}
    assert store.current() is None
    for n in range(6):
        part = [(f"/p{i}", r.randint(0, 99), r.choice([None, n]), 0) for i in r.sample(range(40), 12)]
        gone = [f"/p{i}" for i in r.sample(range(45), 5)] if n else []
        counts = store.put(rows(spark, part), "job", n, spark.createDataFrame([(g,) for g in gone], "full_path string") if gone else None)
        assert counts == {"indexed_count": 12, "error_count": 0, "skipped_count": 0}
        plain(state, part, gone)
        assert shown(store) == state
    _, now = store.versions.current()
    assert now["base"] and (ratio == 0.5 or (now["log"] == []) == (ratio == 0.0))
    store.compact()
    store.vacuum()
    assert shown(store) == state and store.versions.current()[1]["base_rows"] == len(state) and store.versions.names("log") == []
    assert store.put(rows(spark, []), "job", 9) == {"indexed_count": 0, "error_count": 0, "skipped_count": 0} and shown(store) == state


def test_a_batch_applied_twice_is_in_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    bad = lambda x: x.where("size > 5").select("full_path", F.lit("extract").alias("stage"), F.lit("too large").alias("error_message"))
    first = store.put(rows(spark, [("/a", 1, 1, 0), ("/b", 9, 1, 0)]), "j", 0, errors=bad)
    assert first == store.put(rows(spark, [("/a", 1, 1, 0), ("/b", 9, 1, 0)]), "j", 0, errors=bad) == {"indexed_count": 1, "error_count": 1, "skipped_count": 0}
    store.put(rows(spark, [("/c", 7, 1, 0)]), "other", 0, errors=bad)  # another job's batches have numbers of their own
    assert store.table("errors").count() == 2 and sorted((r.job_id, r.batch_id) for r in store.table("jobs").collect()) == [("j", 0), ("other", 0)]
    # a batch whose files are written but whose commit is lost is written again, and nothing of the first attempt is seen
    commit = store.versions.commit
    store.versions.commit = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.put(rows(spark, [("/a", 2, 2, 0)]), "j", 1, errors=bad)
    store.versions.commit = commit
    assert shown(store)["/a"] == (1, 1, 0) and store.progress("j")["indexed"] == 1
    store.put(rows(spark, [("/a", 2, 2, 0)]), "j", 1, errors=bad)
    assert shown(store)["/a"] == (2, 1, 0) and store.table("jobs").count() == 3
    store.begin("j")
    assert store.progress("j") | {"updated_ts": 0} == {"status": "running", "scanned": 3, "queued": 2, "indexed": 2, "skipped": 0, "errors": 1, "pending": 0, "scan_complete": 0, "current_file": "", "updated_ts": 0}
    assert store.resumable() == ["j", "other"]


def test_bytes_of_a_batch_do_not_grow_with_the_table(spark, tmp_path):
    wrote = []
    for n in (500, 20_000):
        store = Store(spark, f"file://{tmp_path}/{n}", buckets=8, ratio=0.5)
        store.put(spark.range(n).select(F.concat(F.lit("/p"), "id").alias("full_path"), F.col("id").alias("size"), F.col("id").alias("created_ts"), F.lit(0).alias("is_deleted")))
        before = {k: store.bytes_of(k) for k in ("log", "base")}
        store.put(rows(spark, [(f"/p{i}", 1, 1, 0) for i in range(50)]))
        after = {k: store.bytes_of(k) for k in ("log", "base")}
        assert after["base"] == before["base"]
        wrote.append(sum(v for k, v in after["log"].items() if k not in before["log"]))
    assert wrote[0] == wrote[1]


def test_only_touched_buckets_are_compacted(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=16, ratio=9)
    store.put(rows(spark, [(f"/p{i}", i, i, 0) for i in range(200)]))
    store.compact()
    old = store.versions.current()[1]["base"]
    store.put(rows(spark, [("/p1", 5, 5, 0)]))
    store.compact()
    new = store.versions.current()[1]["base"]
    assert sum(old[b] != new[b] for b in old) == 1 and len(old) == 16 and shown(store)["/p1"] == (5, 1, 0) and len(shown(store)) == 200


def png(pixels, kind=0):
    """A PNG of grey values whose lines use one kind of filter."""
    h, w = pixels.shape
    lines, above = [], np.zeros(w, int)
    for row in pixels.astype(int):
        left = np.concatenate([[0], row[:-1]])
        corner = np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.select([(abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), abs(p - above) <= abs(p - corner)], [left, above], corner)
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def picture(seed, noise=0):
    r = np.random.default_rng(seed)
    wide = np.kron(r.integers(20, 230, (8, 8)), np.ones((10, 12)))
    return np.clip(wide + noise * np.random.default_rng(99).normal(size=wide.shape), 0, 255).astype(np.uint8)


def test_png_lines_of_all_filters():
    for kind in range(5):
        assert (phash.png_grey(png(picture(1), kind)) == np.repeat(picture(1)[:, :, None], 1, 2)[:, :, 0]).all(), kind
    assert phash.png_grey(b"GIF89a") is None
    a = np.arange(96.0 * 64).reshape(96, 64)
    assert np.allclose(phash.shrunk(a), a.reshape(32, 3, 32, 2).mean((1, 3)))


def test_images_are_hashed_and_grouped(spark, tmp_path):
    """Similar pictures make a group by way of the whole ingestion; a broken one has no hash and is an error."""
    root = tmp_path / "root"
    root.mkdir()
    for name, data in {"a.png": png(picture(1)), "b.png": png(picture(1, 3), 4), "c.png": png(picture(2)), "broken.png": b"\x89PNG\r\n\x1a\nxx", "t.txt": b"not an image"}.items():
        (root / name).write_bytes(data)
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    seen = []
    ingest.stream(spark, f"file://{root}", store, f"{tmp_path}/check", 2, lambda _: seen.append(store.progress(ingest.job_of(f"{tmp_path}/check")))).awaitTermination()
    assert len(seen) > 1 and all(list(x) == ["status", "scanned", "queued", "indexed", "skipped", "errors", "pending", "scan_complete", "current_file", "updated_ts"] and x["status"] == "running" for x in seen)
    assert [x["scanned"] for x in seen] == sorted({x["scanned"] for x in seen}) and seen[-1]["current_file"].startswith(str(root))
    hashes = {r.file_name: r.phash for r in store.current().collect()}
    assert hashes["a.png"] and hashes["broken.png"] is None and hashes["t.txt"] is None
    groups = {}
    for r in ingest.ingest(spark, f"file://{root}", store, f"{tmp_path}/check").join(store.current().select("item_id", "file_name"), "item_id").collect():
        groups.setdefault(r.group_type, set()).add(r.file_name)
    assert groups["similar_image"] == {"a.png", "b.png"}
    done = store.progress(ingest.job_of(f"{tmp_path}/check"))
    assert done["status"] == "done" and done["scan_complete"] == 1 and done["scanned"] == 5 and store.resumable() == []


def test_a_retried_micro_batch_and_a_reindexed_root(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    for name in ("a.txt", "b.docx", "sub/c.txt"):
        (root / name).write_bytes(b"some text of " + name.encode())
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    files = src.scan(spark, f"file://{root}")
    first = store.merge(files, job_id="j", batch_id=4)
    assert first == store.merge(files, job_id="j", batch_id=4) and first["error_count"] == 1
    assert store.table("errors").count() == 1 and store.table("jobs").count() == 1
    (root / "sub" / "c.txt").unlink()
    counts = store.reindex(f"file://{root}/sub", job_id="again")
    assert counts["indexed_count"] == 0 and {r.file_name for r in store.current().where("is_deleted = 1").collect()} == {"c.txt"}
    assert store.reindex(f"file://{root}")["indexed_count"] == 1 and store.error_log().count() == 2
