"""Size-tiered shard compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet shards. A shard's tier is the
number of times its size doubles from the smallest size; once a tier holds enough
shards, runs of them, oldest first, are merged into files of about the target
size. What is current is what the manifest of the highest version lists: a
table in the shard folder whose folder name is the version. A version is
committed by one rename of a folder that is complete; a rename onto a version
that another writer has committed fails, and the compaction starts again from
that version. Files are never changed, so readers of an older version go on.

Everything works through Spark readers and writers and the Hadoop file system
of the path, so the folder may be in any store that renames folders atomically.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import checkpointed, id_mod, shared_folder, table

TARGET_BYTES = 64 << 20
SMALLEST_BYTES = 1 << 20
MIN_RUN = 4
JOBS_AT_ONCE = 16
ARRIVALS = 4

MANIFEST = "shard string, path string, rows long, bytes long, added long"


def tier(size: Column, smallest: int = SMALLEST_BYTES) -> Column:
    """0 up to the smallest size, then one more for each doubling."""
    return F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(smallest)))).cast("long")


def plan_compaction(shards: DataFrame, target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, min_run: int = MIN_RUN) -> DataFrame:
    """``shards`` (shard, bytes, added, ...) with ``tier`` and ``run``: shards of a run are merged, null stays as it is.

    A tier's shards are taken in order of age in runs of about ``target`` bytes. Whole runs are merged, and
    a rest is if it has ``min_run`` shards or more. Shards of the target size or more are never merged again.
    The running sum is over the manifest's rows of one tier, which the size tiers keep few.
    """
    tiered = shards.withColumn("tier", tier(F.col("bytes"), smallest))
    small = F.col("bytes") < target
    by_age = Window.partitionBy("tier").orderBy("added", "shard")
    before = F.sum(F.when(small, F.col("bytes"))).over(by_age.rowsBetween(Window.unboundedPreceding, -1))
    numbered = tiered.withColumn("slot", F.when(small, F.floor(F.coalesce(before, F.lit(0)) / F.lit(target))))
    own = Window.partitionBy("tier", "slot")
    merged = F.col("slot").isNotNull() & ((F.count("*").over(own) >= min_run) | ((F.sum("bytes").over(own) >= target) & (F.count("*").over(own) > 1)))
    return numbered.withColumn("run", F.when(merged, F.concat_ws("-", "tier", "slot"))).drop("slot")


class ShardStore:
    """A folder of immutable shards under ``root``; ``root/manifest/v=<n>`` holds version n."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The highest version committed, or -1."""
        if not self._fs.exists(self._path("manifest")):
            return -1
        return max((int(s.getPath().getName()[2:]) for s in self._fs.listStatus(self._path("manifest")) if s.getPath().getName().startswith("v=")), default=-1)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version}")

    def commit(self, shards: DataFrame, base: int) -> int | None:
        """Makes ``shards`` version ``base + 1``; None if another writer was first."""
        staged = f"staging/{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.root}/{staged}")
        self._fs.mkdirs(self._path("manifest"))
        target = self._path(f"manifest/v={base + 1}")
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target):
            return None
        inside = self._path(f"manifest/v={base + 1}/{staged.rpartition('/')[2]}")
        if self._fs.exists(inside):  # another writer's folder was there: the rename went into it
            self._fs.delete(inside, True)
            return None
        return base + 1

    def _written(self, frames: list[DataFrame], added: int) -> DataFrame:
        """Writes the frames to a new folder, a shard for each partition with rows; their manifest rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
            list(pool.map(lambda i: frames[i].write.parquet(f"{folder}/{i}"), range(len(frames))))
        files = self.spark.read.option("recursiveFileLookup", True).schema(frames[0].schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return files.agg(F.count("*").alias("rows")).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "path", "rows", "bytes", F.lit(added).cast("long").alias("added"))

    def append(self, rows: DataFrame, tries: int = 10) -> int:
        """Writes ``rows`` as new shards, one for each of its partitions, and commits them; the new version."""
        new = checkpointed(self._written([rows], self.version() + 1))
        for _ in range(tries):
            base = self.version()
            done = self.commit(self.manifest(base).unionByName(new), base)
            if done is not None:
                return done
        raise RuntimeError(f"other writers were first {tries} times")

    def compact(self, target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, min_run: int = MIN_RUN, tries: int = 10) -> int:
        """Merges the runs that are due, each into one file; returns the version that then is current."""
        for _ in range(tries):
            base = self.version()
            planned = checkpointed(plan_compaction(self.manifest(base), target, smallest, min_run))
            runs: dict[str, list[str]] = {}
            for r in planned.filter("run IS NOT NULL").select("run", "path").toLocalIterator():  # names of files, not their rows
                runs.setdefault(r.run, []).append(r.path)
            if not runs:
                return base
            files = [self.spark.read.parquet(*runs[run]).coalesce(1) for run in sorted(runs)]  # a run is about one target file
            merged = self._written(files, base + 1)
            done = self.commit(planned.filter("run IS NULL").drop("tier", "run").unionByName(merged), base)
            if done is not None:
                return done
        raise RuntimeError(f"other writers were first {tries} times")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the current one)."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            raise ValueError("the store has no rows in this version")
        return self.spark.read.parquet(*paths)


def op8_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in four arrivals, compacted, and read back from the current version.

    Per row: its id, the characters and digest of its text as the shards hold them, and the version read.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    for arrival in range(ARRIVALS):
        store.append(docs.filter(id_mod("doc_id", ARRIVALS) == arrival))
    version = store.compact()
    text = F.coalesce("text", F.lit(""))
    if not docs.take(1):
        return docs.select("doc_id", F.length(text).cast("long").alias("text_chars"), F.sha2(text, 256).alias("text_sha256"), F.lit(version).cast("long").alias("version"))
    return store.read(version).select("doc_id", F.length(text).cast("long").alias("text_chars"), F.sha2(text, 256).alias("text_sha256"), F.lit(version).cast("long").alias("version"))


OP8_SQL = f"""
SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS text_chars, sha256(coalesce(text, '')) AS text_sha256,
  CAST({ARRIVALS} AS BIGINT) AS version
FROM documents
"""
