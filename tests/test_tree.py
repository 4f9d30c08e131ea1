"""The file data source: empty files in batches and streams."""

import hashlib
import os
import time

from docquarry.sources import files as src
from docquarry.sources import tree
from docquarry.streaming import ingest

NONE = hashlib.sha256(b"").hexdigest()


def made(root, names, age=100):
    for name, data in names.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
        os.utime(p, (time.time() - age, time.time() - age))


def test_lists_what_sparks_reader_lists_and_empty_files(spark, tmp_path):
    made(tmp_path, {"a.txt": b"text", "empty.txt": b"", "s/b.bin": bytes(range(256)), "s/t/none.md": b"", "s/t/u/c.txt": b"deep"})
    spark.dataSource.register(tree.FileTree)
    root = f"file://{tmp_path}"
    own = {r.path: (r.length, bytes(r.content), r.modificationTime) for r in spark.read.format("filetree").option("depth", "2").load(root).collect()}
    others = {r.path: (r.length, bytes(r.content), r.modificationTime) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).collect()}
    assert {p: v[:2] for p, v in own.items() if v[0]} == {p: v[:2] for p, v in others.items()} and {os.path.basename(p) for p, v in own.items() if not v[0]} == {"empty.txt", "none.md"}
    assert all(abs((own[p][2] - v[2]).total_seconds()) < 0.001 for p, v in others.items())
    x = {r.relative: r.sha256 for r in src.extracted(src.scan(spark, root, empty=True)).collect()}
    assert x.keys() == {"a.txt", "empty.txt", "s/b.bin", "s/t/none.md", "s/t/u/c.txt"} and x["empty.txt"] == x["s/t/none.md"] == NONE
    assert {r.relative for r in src.scan(spark, root, pattern="*.md", empty=True).collect()} == {"s/t/none.md"}
    assert tree.empty_files(spark, f"{root}/none").collect() == []


def test_streams_resume_from_their_offset(spark, tmp_path):
    root = tmp_path / "root"
    made(root, {"a.txt": b"some text", "empty.txt": b"", "s/none.txt": b""})
    store, check, seen = ingest.Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/check", []

    def run():
        seen.clear()
        ingest.stream(spark, f"file://{root}", store, check, empty=True, after=lambda df: seen.append(df.count())).awaitTermination()
        return {r.file_name: r.sha256 for r in store.current().collect()}

    assert run() == {"a.txt": hashlib.sha256(b"some text").hexdigest(), "empty.txt": NONE, "none.txt": NONE}
    jobs = store.table("jobs").count()
    assert run().keys() == {"a.txt", "empty.txt", "none.txt"} and seen == [] and store.table("jobs").count() == jobs
    made(root, {"s/later.txt": b""}, age=50)
    made(root, {"fresh.txt": b""}, age=-1000)  # hasn't rested yet
    assert run().keys() == {"a.txt", "empty.txt", "none.txt", "later.txt"} and store.progress(ingest.job_of(check))["scanned"] == 4
