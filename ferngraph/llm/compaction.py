"""Sharding by size-tiered compaction.

A store is a folder of immutable runs (parquet files) and of numbered manifests.
Arrivals are appended as small runs. Runs smaller than the target are put into
tiers by size, each tier's sizes `fanout` times those of the one below; once a
tier has `fanout` runs, its oldest are merged into one run of target-sized
files. Once no tier is full, runs of any size that lie in files far below the
target are rewritten, each by itself. A version is committed by moving a
finished manifest to its number, which fails if another writer took it; readers
see one version or the next, never a mixture, and files that no version lists
are never read. A manifest has a line's worth for each run, its folder, bytes
and number of files, and never names files. A writer that loses the race for a
version puts its runs on top of the winner's once, and else takes them away.
Superseded runs stay, so every listed version can be read, until
clean_up() drops old versions and then what only they had. DataFrame functions
only: a merge is a scan and a write, without a shuffle.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tier(size: int, smallest: int, fanout: int) -> int:
    return max(0, math.floor(math.log(max(size, 1) / smallest, fanout) + 1e-9))


def scattered(run: dict, target: int) -> bool:
    """Whether the run lies in more than twice the files that its bytes fill,
    and wasn't found to lie in no fewer when it was rewritten."""
    return not run.get("settled") and run.get("files", 0) > 2 * max(1, math.ceil(run["bytes"] / target))


def plan(runs: list[dict], target: int, smallest: int, fanout: int) -> list[list[str]]:
    """Groups of run ids to merge now: of each tier below the target, oldest
    first, every `fanout` runs; if no tier is full, every scattered run alone."""
    tiers: dict[int, list[str]] = {}
    for r in runs:
        if r["bytes"] < target:
            tiers.setdefault(tier(r["bytes"], smallest, fanout), []).append(r["id"])
    full = [ids[k : k + fanout] for _, ids in sorted(tiers.items()) for k in range(0, len(ids) - fanout + 1, fanout)]
    return full or [[r["id"]] for r in runs if scattered(r, target)]


#: Tasks of an append until files of the target's size need more.
APPEND_TASKS = 4096


def append_tasks(size: int, ways: int, smallest: int, target: int) -> int:
    """Tasks that write size bytes for so many arrivals, a file each: files of
    a quarter of the smallest run at least, and no more than APPEND_TASKS files an
    arrival until files reach the target."""
    fine, coarse = math.ceil(4 * size / (ways * smallest)), math.ceil(size / (ways * target))
    return max(1, min(fine, max(APPEND_TASKS, coarse)))


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class ShardStore:
    spark: SparkSession
    root: str
    target_bytes: int = 256 << 20
    smallest_bytes: int = 1 << 20
    fanout: int = 4
    _jvm: object = field(init=False, repr=False)

    def __post_init__(self):
        self._jvm = self.spark._jvm
        self._conf = self.spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # manifests

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """A committed version (the newest, if none is named); version 0 is empty."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        text = self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, base: dict, runs: list[dict], schema: str | None) -> dict:
        new = {"version": base["version"] + 1, "schema": schema, "runs": runs}
        self._fs.mkdirs(self._path("manifests"))
        own, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{new['version']:08d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, final, options)  # never over an existing file
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {new['version']} exists") from e
            raise
        return new

    def _run(self, folder: str, arrived: int) -> dict | None:
        sizes = [s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return {"id": folder, "arrived": arrived, "files": len(sizes), "largest": max(sizes), "bytes": sum(sizes)} if sizes else None

    # writing

    def append(self, df: DataFrame, arrival: str | None = None, ways: int = 1) -> dict:
        """Commit df as new runs: one for each value of the column `arrival`
        (null is a value too; about `ways` of them), or one. The column stays in
        the data. Rows of other columns or types than the store's are refused.
        Input partitions are written together, so that a run's files don't become
        tiny, and not more than APPEND_TASKS of them, or as many as files of the
        target's size need; of rows of unknown size, a partition for each core. If another writer commits first, the runs follow its
        own; if that happens again, they are dropped and CommitConflict is raised."""
        base = self.manifest()
        self._check(base, df.schema)
        folder = f"runs/{uuid.uuid4().hex}"
        name = "run"
        while name in df.columns:
            name += "_"
        key = F.coalesce(F.col(arrival).cast("string"), F.lit("none")) if arrival else F.lit("all")
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size < 1 << 60
        df = df.coalesce(append_tasks(size, ways, self.smallest_bytes, self.target_bytes) if known else self.spark.sparkContext.defaultParallelism)
        df.withColumn(name, key).write.partitionBy(name).parquet(f"{self.root}/{folder}")
        parts = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory())
        runs = [r for k, p in enumerate(parts) if (r := self._run(f"{folder}/{p}", k))]
        try:
            for again in (False, True):
                number = 1 + max([r["arrived"] for r in base["runs"]], default=0)
                try:
                    return self._commit(base, base["runs"] + [r | {"arrived": number + k} for k, r in enumerate(runs)], base["schema"] or df.schema.json())
                except CommitConflict:
                    if again:
                        raise
                    base = self.manifest()
                    self._check(base, df.schema)
        except (CommitConflict, ValueError):
            self._fs.delete(self._path(folder), True)
            raise
        raise AssertionError("unreachable")

    def _check(self, base: dict, schema: T.StructType) -> None:
        kinds = lambda fields: [(f.name, f.dataType) for f in fields]
        if base["schema"] and kinds(self._schema(base)) != kinds(schema):
            raise ValueError(f"the store holds {self._schema(base).simpleString()}, not {schema.simpleString()}")

    def _merge(self, runs: list[dict], schema: T.StructType) -> dict:
        folder = f"runs/{uuid.uuid4().hex}"
        total, largest = sum(r["bytes"] for r in runs), max(r["largest"] for r in runs)
        # a partition takes files until the next would pass its most, so all but the last hold total / files at least
        most = -(-total // max(1, round(total / self.target_bytes))) + largest
        session = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        for key, value in (("maxPartitionBytes", most), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{key}", str(value))
        rows = session.read.schema(schema).parquet(*[f"{self.root}/{r['id']}" for r in runs])
        rows = rows.coalesce(max(1, round(total / self.target_bytes)))  # where the settings don't hold, too
        rows.write.parquet(f"{self.root}/{folder}")
        new = self._run(folder, max(r["arrived"] for r in runs))
        if len(runs) == 1 and new["files"] >= runs[0]["files"]:
            new["settled"] = True
        return new

    def compact(self, keep: int | None = None) -> dict:
        """Merge until no tier is full and no run is scattered; one committed
        version a round. What it supersedes stays for readers of older versions,
        or of the newest `keep`, if that is given."""
        now = self.manifest()
        while groups := plan(now["runs"], self.target_bytes, self.smallest_bytes, self.fanout):
            by, schema = {r["id"]: r for r in now["runs"]}, self._schema(now)
            with ThreadPoolExecutor(4) as pool:
                merged = list(pool.map(lambda g: self._merge([by[i] for i in g], schema), groups))
            gone = {i for g in groups for i in g}
            for again in (False, True):
                runs = sorted([r for r in now["runs"] if r["id"] not in gone] + merged, key=lambda r: r["arrived"])
                try:
                    now = self._commit(now, runs, now["schema"])
                    break
                except CommitConflict:
                    now = self.manifest()
                    if again or not gone <= {r["id"] for r in now["runs"]}:  # what was merged may have been merged by another
                        for r in merged:
                            self._fs.delete(self._path(r["id"]), True)
                        if again:
                            raise
                        break
            if keep:
                self.clean_up(keep)
        return now

    def clean_up(self, keep: int = 1, orphans_after: float | None = None) -> list[int]:
        """Drop all but the newest `keep` versions, first from the list, then
        the runs that no version left names; the versions that went. Folders that
        no version ever named, which writers leave that died before they
        committed, go if nothing in them is younger than orphans_after seconds."""
        known = self.versions()
        gone, left = known[: max(0, len(known) - max(keep, 1))], known[-max(keep, 1) :]
        old = {r["id"] for v in gone for r in self.manifest(v)["runs"]}
        needed = {r["id"] for v in left for r in self.manifest(v)["runs"]}
        for v in gone:
            self._fs.delete(self._path(f"manifests/{v:08d}.json"), False)
        append = lambda i: "/".join(i.split("/")[:2])  # noqa: E731  the folder of all runs that were written together
        held = set(map(append, needed))
        for i in sorted(old - needed):
            self._fs.delete(self._path(i if append(i) in held else append(i)), True)
        top = self._path("runs")
        if orphans_after is not None and self._fs.exists(top):
            named = {i.split("/")[1] for i in needed}
            for s in self._fs.listStatus(top):
                if s.getPath().getName() not in named and self._age(s) >= orphans_after:
                    self._fs.delete(s.getPath(), True)
        return gone

    def _age(self, status) -> float:
        """Seconds since anything in a folder was changed."""
        latest = max([status.getModificationTime(), *(s.getModificationTime() for s in self._fs.listStatus(status.getPath()))])
        return time.time() - latest / 1000

    # reading

    @staticmethod
    def _schema(manifest: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else T.StructType([])

    def _scan(self, runs: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{r['id']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a committed version."""
        m = self.manifest(version)
        schema = self._schema(m)
        return self._scan(m["runs"], schema) if m["runs"] else self.spark.createDataFrame([], schema)


ARRIVALS = 64


def shard(docs: DataFrame, root: str, target_bytes: int = 32 << 20, arrivals: int = ARRIVALS, keep: int = 1) -> ShardStore:
    """Append docs as `arrivals` small runs, by doc_id modulo that number, and
    compact them; the newest `keep` versions stay, so that a table needs twice
    its room at most. Nulls in any column, repeated rows and empty texts are stored
    as they are; rows without doc_id arrive together. An empty table gives a
    store without runs. A column of docs named arrival is kept under that name
    with as many underscores as make it new."""
    other = "arrival_"
    while other in docs.columns:
        other += "_"
    rows = docs.withColumnRenamed("arrival", other).withColumn("arrival", F.pmod("doc_id", F.lit(arrivals)).cast("int"))
    store = ShardStore(docs.sparkSession, root, target_bytes)
    store.append(rows, "arrival", arrivals)
    store.compact(keep)
    return store


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, arrival, lang, source, n_chars, n_bytes and text_sha256, of what
    the committed shards hold."""
    return stored.select("doc_id", "arrival", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = """
SELECT doc_id, CAST(doc_id % 64 AS INTEGER) AS arrival, lang, source, n_chars,
  CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
FROM documents
"""
