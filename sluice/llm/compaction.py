"""Sharding by size-tiered compaction: small immutable shards, merged by size, one manifest a version.

``append`` writes arrivals as new shards; ``compact`` groups shards of a similar size and rewrites
each group as one larger shard, until no size class holds ``fan_in`` shards. A merge is one task that
reads its files one after the other, with no shuffle, so the work is a copy of the bytes whatever the
keys are. Shards are never changed. What the store holds is what its newest manifest lists: a
manifest is written beside its place and renamed there without overwriting, so a reader sees a whole
version, and of two writers one commits on top of the other's version. Older versions stay readable
until ``vacuum`` is told to forget them; it then deletes files that no kept version lists, if they are
older than an age within which every writer has committed what it wrote. A failed job leaves only
files that no manifest lists, which go then too.

The driver holds the manifest, one entry a shard. Merges of a round run side by side from
``JOBS`` threads, each a job of its own that Spark retries by itself if an executor is lost.

Defined results: an arrival without rows adds no shard but a version; repeated rows, nulls, empty and
very long texts are kept as they are; columns are stored as they come, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import work_dir
from .shared_fs import SharedFolder

TARGET_BYTES, LEAST_BYTES, FAN_IN, JOBS = 128 << 20, 1 << 20, 4, 8


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    merges: int


class ConflictError(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES, fan_in: int = FAN_IN) -> None:
        if fan_in < 2:
            raise ValueError("fan_in must be 2 or more")
        self.spark, self.folder = spark, SharedFolder(spark, path)
        self.data = SharedFolder(spark, self.folder.under("data"))
        self.target_bytes, self.least_bytes, self.fan_in = target_bytes, least_bytes, fan_in

    def version(self) -> int:
        names = [n for n in self.folder.files() if n.startswith("manifest-")]
        return max((int(n[9:-5]) for n in names), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "shards": []}
        found = json.loads(self.folder.read_text(f"manifest-{v:010d}.json"))
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def commit(self, before: dict, shards: list[Shard], schema: str | None) -> int:
        v = before["version"] + 1
        text = json.dumps({"version": v, "schema": schema, "shards": [asdict(s) for s in shards]})
        if not self.folder.write_once(f"manifest-{v:010d}.json", text):
            raise ConflictError(f"version {v} is taken")
        return v

    def _write(self, rows: DataFrame, merges: int) -> list[Shard]:
        """The rows as files that no manifest lists yet, moved to names that are never used again."""
        job = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(self.data.under(job))
        made = []
        for name, size in sorted(self.data.files(job).items()):
            if name.startswith("part-"):
                file = f"{job}-{len(made):06d}.parquet"
                self.data.move(f"{job}/{name}", file)
                made.append(Shard(file, size, merges))
        self.data.delete(job)
        return made

    def append(self, rows: DataFrame) -> int:
        """Arrivals as small shards, one a partition; returns the new version."""
        schema = rows.schema.json()
        made = self._write(rows, 0)
        while True:
            before = self.manifest()
            if before["schema"] not in (None, schema):
                raise ValueError("the arrivals' schema differs from the store's")
            try:
                return self.commit(before, [*before["shards"], *made], schema)
            except ConflictError:
                continue

    def tier(self, shard: Shard) -> int:
        """Size class: each is ``fan_in`` times the one before; -1 for shards that are large enough."""
        if shard.bytes * 2 > self.target_bytes:
            return -1
        at, size = 0, self.least_bytes
        while shard.bytes >= size:
            at, size = at + 1, size * self.fan_in
        return at

    def groups(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of shards of one size class to be merged: ``fan_in`` or more, up to the target size."""
        classes: dict[int, list[Shard]] = {}
        for s in shards:
            classes.setdefault(self.tier(s), []).append(s)
        found = []
        for at, members in sorted(classes.items()):
            if at < 0 or len(members) < self.fan_in:
                continue
            run: list[Shard] = []
            for s in members:
                if len(run) >= self.fan_in or (run and sum(x.bytes for x in run) + s.bytes > self.target_bytes):
                    found.append(run)
                    run = []
                run.append(s)
            found.append(run)
        return [run for run in found if len(run) >= 2]

    def _merge(self, group: list[Shard]) -> list[Shard]:
        rows = self.spark.read.schema(self._schema()).parquet(*[self.data.under(s.file) for s in group])
        return self._write(rows.coalesce(1), 1 + max(s.merges for s in group))

    def _schema(self):
        return StructType.fromJson(json.loads(self.manifest()["schema"]))

    def compact(self) -> int:
        """Merges until no size class has enough shards; each round is one version."""
        while True:
            before = self.manifest()
            work = self.groups(before["shards"])
            if not work:
                return before["version"]
            with ThreadPoolExecutor(JOBS) as pool:
                made = [s for shards in pool.map(self._merge, work) for s in shards]
            self._replace({s.file for group in work for s in group}, made)

    def _replace(self, gone: set[str], made: list[Shard]) -> None:
        """Commits merged shards in place of others; nothing if another writer has replaced some of these."""
        while True:
            before = self.manifest()
            if not gone <= {s.file for s in before["shards"]}:
                return
            try:
                self.commit(before, [*(s for s in before["shards"] if s.file not in gone), *made], before["schema"])
                return
            except ConflictError:
                continue

    def vacuum(self, keep_versions: int = 1, least_age_s: float = 86_400.0) -> None:
        """Forgets versions older than the age but for the newest, and deletes as old files that none of the others lists."""
        ages = {int(n[9:-5]): age for n, age in self.folder.ages().items() if n.startswith("manifest-")}
        gone = {v for v, age in ages.items() if v <= max(ages) - keep_versions and age >= least_age_s}
        listed = {s.file for v in ages if v not in gone for s in self.manifest(v)["shards"]}
        for v in gone:
            self.folder.delete(f"manifest-{v:010d}.json")
        for name, age in self.data.ages().items():
            if name not in listed and age >= least_age_s:
                self.data.delete(name)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with ``shard_file``; an unwritten store cannot be read."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("nothing was appended yet")
        schema = self._schema()
        if not found["shards"]:
            return self.spark.createDataFrame([], schema).withColumn("shard_file", F.lit(""))
        return self.spark.read.schema(schema).parquet(*[self.data.under(s.file) for s in found["shards"]]).select("*", F.col("_metadata.file_name").alias("shard_file"))


#: The query's arrivals: parts of the table by a hash of the id, appended one after the other.
ARRIVALS = 4


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Each document's shard in the store's last version, after all arrivals and merges."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, work_dir(spark, "shards"))
    # The table is read once and dealt to its arrivals' folders, as arrivals would lie there.
    arrivals = SharedFolder(spark, work_dir(spark, "arrivals"))
    path = arrivals.under("rows")
    docs.select(F.struct("*").alias("row"), F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).alias("arrival")).write.option("compression", "zstd").partitionBy("arrival").parquet(path)
    rows = StructType([StructField("row", docs.schema), StructField("arrival", LongType())])
    for k in range(ARRIVALS):
        store.append(spark.read.schema(rows).parquet(path).filter(F.col("arrival") == k).select("row.*"))
        store.compact()
    arrivals.delete("")
    found = store.manifest()
    # One row a shard, as the manifest has them.
    shards = spark.createDataFrame([(s.file, i, s.bytes, s.merges) for i, s in enumerate(found["shards"])], "shard_file string, shard_no bigint, shard_bytes bigint, merges int")
    rows = store.read().select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"), "shard_file")
    return rows.join(F.broadcast(shards), "shard_file").select("doc_id", "text_sha256", "shard_no", "shard_bytes", "merges", F.lit(found["version"]).cast("bigint").alias("version"))
