"""The items table as merge-on-read snapshots: a base in hash buckets and a log of changes, with a ledger of the batches that are in.

A batch writes what it changes to the log and nothing else; a read puts the log's rows over the base's by key, and joins only keys that the log
holds. Once the log has ``ratio`` of the base's rows, the buckets it touches are written anew and the others stay where they are. One manifest
names base, log, error and job rows and, for each job, the last batch that is in: all of a batch is seen at once or not at all, and a batch
that a stream applies again, with the same job and batch id, changes nothing. Counts of a batch are observed while it is written.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.versions import Versions

#: Columns whose first value stays: when an item was first seen and made, and its text's language once it is known.
KEEP = ("first_seen_ts", "created_ts", "content_language")
#: Log rows up to which their keys are broadcast.
BROADCAST = 1_000_000
#: The counters of a job beside its status, in the order of ``progress``.
COUNTERS = ("scanned", "queued", "indexed", "skipped", "errors", "pending")


class Store:
    """Rows by ``key`` in ``folder``. More ``buckets`` make a compaction of few keys cheaper."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "full_path", keep: tuple[str, ...] = KEEP, buckets: int = 64, ratio: float = 0.25):
        self.spark, self.folder, self.key, self.keep, self.buckets, self.ratio = spark, folder.rstrip("/"), key, keep, buckets, ratio
        self.versions = Versions(spark, self.folder)

    # Reads

    def current(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows as they are now, of some buckets or all; None before the first batch."""
        version, now = self.versions.current()
        return self._merged(now, buckets) if version and now["schema"] else None

    def _schema(self, now: dict) -> StructType:
        return StructType.fromJson(json.loads(now["schema"]))

    def _bucket(self, now: dict) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(now["buckets"])).cast("int")

    def _base(self, now: dict, buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.folder}/base/{name}/bucket={b}" for b, name in now["base"].items() if buckets is None or int(b) in buckets]
        schema = self._schema(now)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self, now: dict) -> DataFrame | None:
        """The log's rows with the number of their batch, ``_seq``, and whether they delete, ``_gone``."""
        out = None
        for x in now["log"]:
            rows = self.spark.read.schema(StructType.fromJson(json.loads(x["schema"]))).parquet(f"{self.folder}/log/{x['name']}").withColumn("_seq", F.lit(x["seq"]))
            if x["side"]:  # columns that are worked out from the others
                rows = rows.join(self.spark.read.parquet(f"{self.folder}/side/{x['name']}"), self.key, "left")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _merged(self, now: dict, buckets: list[int] | None) -> DataFrame:
        base, log = self._base(now, buckets), self._log(now)
        if log is None:
            return base
        if buckets is not None:
            log = log.where(self._bucket(now).isin(buckets))
        schema = self._schema(now)
        for c in schema.names:
            log = log if c in log.columns else log.withColumn(c, F.lit(None).cast(schema[c].dataType))
        keys = log.select(self.key).distinct()
        keys = F.broadcast(keys) if now["log_rows"] <= BROADCAST else keys
        old = base.join(keys, self.key, "left_semi").withColumns({"_seq": F.lit(0), "_gone": F.lit(False)})
        put = ~F.col("_gone")
        others = [c for c in schema.names if c != self.key]
        last = F.max_by(F.struct(*others), F.when(put, F.col("_seq"))).alias("_row")
        firsts = [F.min_by(c, F.when(put & F.col(c).isNotNull(), F.col("_seq"))).alias(f"_{c}") for c in self.keep if c in others]
        each = old.unionByName(log.select(*old.columns)).groupBy(self.key).agg(last, *firsts, F.max(F.when(put, F.col("_seq"))).alias("_put"), F.max(F.when(~put, F.col("_seq"))).alias("_deleted"))
        after = F.coalesce(F.col("_deleted") > F.col("_put"), F.lit(False))
        value = {c: F.col(f"_{c}") if c in self.keep else F.col(f"_row.{c}") for c in others}
        if "is_deleted" in value:
            value["is_deleted"] = F.when(after, F.lit(1)).otherwise(value["is_deleted"])
        else:
            each = each.where(~after)
        each = each.where("_put is not null").select(*[(F.col(c) if c == self.key else value[c]).cast(schema[c].dataType).alias(c) for c in schema.names])
        return base.join(keys, self.key, "left_anti").select(*schema.names).unionByName(each)

    def table(self, name: str) -> DataFrame | None:
        """Rows that are only added to (``errors``, ``jobs``), or None before the first."""
        _, now = self.versions.current()
        names = now.get("tables", {}).get(name, [])
        return self.spark.read.parquet(*[f"{self.folder}/{name}/{x}" for x in names]) if names else None

    def error_log(self, limit: int = 200) -> DataFrame | None:
        """The latest errors first."""
        x = self.table("errors")
        return None if x is None else x.orderBy(F.desc("created_ts"), "full_path").limit(limit)

    def progress(self, job_id: str) -> dict:
        """A job's ten fields as they are now, while it runs or after; empty for an unknown one."""
        _, now = self.versions.current()
        job = now.get("jobs", {}).get(job_id)
        return {k: job[k] for k in ("status", *COUNTERS, "scan_complete", "current_file", "updated_ts")} if job else {}

    def resumable(self) -> list[str]:
        """Jobs that were cut off."""
        _, now = self.versions.current()
        return sorted(j for j, x in now.get("jobs", {}).items() if x["status"] in ("running", "pending", "finalizing"))

    def bytes_of(self, kind: str) -> dict[str, int]:
        """Bytes of what lies in ``log``, ``base`` and so on, by name."""
        store = self.versions._store()
        return {n: store.getContentSummary(self.versions._path(kind, n)).getLength() for n in self.versions.names(kind)}

    # Writes

    def begin(self, job_id: str) -> None:
        """A job starts, or goes on where it was: its counters restart at what is indexed."""
        version, now = self.versions.current()
        old = now.get("jobs", {}).get(job_id, {"batch": -1, "indexed": 0, "skipped": 0, "errors": 0, "scanned": 0, "counts": {}})
        job = old | {"status": "running", "queued": old["indexed"], "pending": 0, "scan_complete": 0, "current_file": "", "updated_ts": int(time.time())}
        self.versions.commit(version, self._with_job(now, job_id, job))

    def mark(self, job_id: str, status: str) -> None:
        """The job's status from now on; ``finalizing`` and ``done`` say that its scan is complete."""
        version, now = self.versions.current()
        job = now["jobs"][job_id] | {"status": status, "updated_ts": int(time.time())}
        self.versions.commit(version, self._with_job(now, job_id, job | ({"scan_complete": 1, "pending": 0} if status in ("finalizing", "done") else {})))

    def _with_job(self, now: dict, job_id: str, job: dict) -> dict:
        empty = {"seq": 0, "buckets": self.buckets, "schema": None, "base": {}, "base_rows": 0, "log": [], "log_rows": 0, "tables": {}, "jobs": {}}
        now = empty | now
        return now | {"jobs": now["jobs"] | {job_id: job}}

    def _done(self, now: dict, job_id: str, batch_id: int | None) -> dict | None:
        """What a batch that is in already has counted."""
        job = now.get("jobs", {}).get(job_id)
        return job["counts"] if job and batch_id is not None and job["batch"] >= batch_id else None

    def fill(self, rows: DataFrame) -> None:
        """The rows as the whole base of an empty store, written once."""
        version, now = self.versions.current()
        if now.get("schema"):
            raise ValueError("the store isn't empty")
        now = self._with_job(now, "", {}) | {"schema": rows.schema.json()}
        name, wrote = uuid.uuid4().hex[:8], Observation()
        out = rows.withColumn("bucket", self._bucket(now)).observe(wrote, F.count("*").alias("n"))
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/base/{name}")
        there = sorted(int(x.removeprefix("bucket=")) for x in self.versions.names("base", name) if x.startswith("bucket="))
        self.versions.commit(version, now | {"jobs": {}, "base": {str(b): name for b in there}, "base_rows": wrote.get["n"]})

    def put(self, rows: DataFrame, job_id: str = "", batch_id: int | None = None, gone: DataFrame | None = None, side=None, errors=None, scanned: int | None = None, mode: str | None = "incremental", at: int | None = None) -> dict:
        """Puts rows over those with their keys, and deletes those in ``gone`` (key); the batch's counts. Keys are unique in ``rows``.

        ``side`` gives further columns by key from the rows once they are written, ``errors`` the rows of the error log among them; ``scanned`` is how many
        rows were looked at for these. Without a ``mode`` the batch has no row in ``jobs``.
        """
        version, now = self.versions.current()
        if (counts := self._done(now, job_id, batch_id)) is not None:
            return counts
        now = self._with_job(now, job_id, now.get("jobs", {}).get(job_id) or {"batch": -1, "status": "running", **dict.fromkeys(COUNTERS, 0), "scan_complete": 0, "current_file": "", "updated_ts": 0, "counts": {}})
        seq, seen = now["seq"] + 1, Observation()
        name, at = f"{seq}-{uuid.uuid4().hex[:8]}", int(time.time()) if at is None else at
        out = rows.withColumn("_gone", F.lit(False))
        out.observe(seen, F.count("*").alias("n"), F.max(self.key).alias("last")).write.parquet(f"{self.folder}/log/{name}")
        n, log, tables = seen.get["n"], [], {k: list(v) for k, v in now["tables"].items()}
        written = self.spark.read.schema(out.schema).parquet(f"{self.folder}/log/{name}")
        full = rows.schema
        if n:
            if side is not None:
                extra = side(written)
                extra.write.parquet(f"{self.folder}/side/{name}")
                full = reduce(lambda s, f: s.add(f) if f.name not in s.names else s, extra.schema.fields, StructType(list(rows.schema.fields)))
            log.append({"name": name, "seq": seq, "schema": out.schema.json(), "side": side is not None, "rows": n})
        deleted = 0
        if gone is not None:
            lost = Observation()
            marks = gone.select(self.key).distinct().withColumn("_gone", F.lit(True))
            marks.observe(lost, F.count("*").alias("n")).write.parquet(f"{self.folder}/log/{name}-gone")
            deleted = lost.get["n"]
            if deleted:
                log.append({"name": f"{name}-gone", "seq": seq, "schema": marks.schema.json(), "side": False, "rows": deleted})
        failed = 0
        if errors is not None and n:
            bad = Observation()
            errors(written).select(F.lit(job_id).alias("job_id"), "*", F.lit(at).cast("bigint").alias("created_ts")).observe(bad, F.count("*").alias("n")).write.parquet(f"{self.folder}/errors/{name}")
            failed = bad.get["n"]
            if failed:
                tables["errors"] = [*tables.get("errors", []), name]
        looked = n if scanned is None else scanned
        counts = {"indexed_count": n - failed, "error_count": failed, "skipped_count": looked - n}
        if mode is not None:
            self._note(job_id, batch_id, mode, counts, at, name)
            tables["jobs"] = [*tables.get("jobs", []), name]
        old = now["jobs"][job_id]
        job = old | {"batch": old["batch"] if batch_id is None else batch_id, "counts": counts, "indexed": old["indexed"] + n - failed, "errors": old["errors"] + failed, "skipped": old["skipped"] + looked - n, "scanned": old["scanned"] + looked, "queued": old["queued"] + n, "pending": 0, "current_file": seen.get["last"] or old["current_file"], "updated_ts": at}
        schema = StructType.fromJson(json.loads(now["schema"])) if now["schema"] else full
        schema = reduce(lambda s, f: s.add(f) if f.name not in s.names else s, full.fields, schema)
        now = now | {"seq": seq, "schema": schema.json(), "log": [*now["log"], *log], "log_rows": now["log_rows"] + n + deleted, "tables": tables}
        self.versions.commit(version, self._with_job(now, job_id, job))
        if now["log_rows"] > self.ratio * now["base_rows"]:
            self.compact()
        return counts

    def _note(self, job_id: str, batch_id: int | None, mode: str, counts: dict, at: int, name: str) -> None:
        row = self.spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(mode).alias("mode"), *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()], F.lit(at).cast("bigint").alias("finished_ts"))
        row.coalesce(1).write.parquet(f"{self.folder}/jobs/{name}")

    def compact(self) -> None:
        """Writes the buckets that the log touches anew, with the log's rows; tables of error and job rows become one each."""
        version, now = self.versions.current()
        if not version or not now["log"] and all(len(x) < 2 for x in now["tables"].values()):
            return
        name = f"{now['seq']}-{uuid.uuid4().hex[:8]}"
        if now["log"]:
            touched = sorted(r[0] for r in self._log(now).select(self._bucket(now)).distinct().collect())  # at most one for each bucket
            wrote = Observation()
            rows = self._merged(now, touched).withColumn("bucket", self._bucket(now)).observe(wrote, F.count("*").alias("n"))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/base/{name}")
            there = {int(x.removeprefix("bucket=")) for x in self.versions.names("base", name) if x.startswith("bucket=")}
            base = {b: x for b, x in now["base"].items() if int(b) not in touched} | {str(b): name for b in sorted(there)}
            untouched = self._base(now, [b for b in map(int, now["base"]) if b not in touched]).count()  # from the files' footers
            now = now | {"base": base, "base_rows": untouched + wrote.get["n"], "log": [], "log_rows": 0}
        tables = {}
        for kind, names in now["tables"].items():
            if len(names) > 1:
                self.spark.read.parquet(*[f"{self.folder}/{kind}/{x}" for x in names]).coalesce(1).write.parquet(f"{self.folder}/{kind}/{name}")
            tables[kind] = [name] if len(names) > 1 else names
        self.versions.commit(version, now | {"tables": tables})

    def vacuum(self) -> None:
        """Deletes what the current manifest doesn't name: call it when nothing reads."""
        _, now = self.versions.current()
        live = {"log": {x["name"] for x in now.get("log", ())}, "side": {x["name"] for x in now.get("log", ()) if x["side"]}, "base": set(now.get("base", {}).values()), **{k: set(v) for k, v in now.get("tables", {}).items()}}
        for kind, names in live.items():
            for name in set(self.versions.names(kind)) - names:
                self.versions.remove(kind, name)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
