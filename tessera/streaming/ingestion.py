"""Incremental ingestion of a folder by Structured Streaming: files to chunks and a manifest, each batch whole or not at all.

A micro-batch writes its chunks and then its manifest under one id. A chunk counts once its batch's
manifest is complete, and only while that manifest entry is its file's newest; so a batch that is
replayed, or was cut off between the two writes, changes nothing that is read. The file source knows files
by path, so one that was changed in place is found by a sweep over times of modification.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import FILE_TYPES
from tessera.operators.ingest import chunk_rows
from tessera.plans.config import ChunkConfig
from tessera.session import discard, settle
from tessera.sources import files

SOURCE = "path string, modificationTime timestamp, length long, content binary"
CHUNKS = "path string, filetype string, content_hash string, chunk_no int, page_content string, quality_score double, batch string"
MANIFEST = "path string, content_hash string, modified timestamp, length long, state string, chunks long, at timestamp, batch string"


@dataclass
class Ingestion:
    """``folder`` into ``target``/chunks and ``target``/manifest; ``checkpoint`` remembers how far the stream came."""

    spark: object
    folder: str
    target: str
    checkpoint: str
    keywords: list[str] | None = None
    cfg: ChunkConfig = field(default_factory=ChunkConfig)
    recursive: bool = True
    per_batch: int = 1000

    # tables

    def _batches(self, kind: str) -> list[str]:
        """Ids of complete batches."""
        jvm, root = self.spark._jvm, f"{self.target}/{kind}"
        where = jvm.org.apache.hadoop.fs.Path(root)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]

    def _read(self, kind: str, schema: str) -> DataFrame:
        names = self._batches("manifest")  # what has no manifest was not committed
        paths = [f"{self.target}/{kind}/{n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.target}/{kind}").parquet(*paths)

    def manifest(self) -> DataFrame:
        """The newest entry of each file: path, content_hash, modified, length, state (`stored`, `rejected` or `failed`), chunks, at, batch."""
        every = self._read("manifest", MANIFEST)
        newest = every.groupBy("path").agg(F.max_by(F.struct(*every.columns), F.struct("at", "batch")).alias("m"))
        return newest.select("m.*")

    def chunks(self) -> DataFrame:
        """The chunks of each file's newest content."""
        return self._read("chunks", CHUNKS).join(self.manifest().select("path", "batch"), ["path", "batch"], "left_semi")

    # batches

    def take(self, arrived: DataFrame, batch: str) -> None:
        """One batch of files (path, modificationTime, length, content): those the manifest doesn't know, or knows otherwise."""
        kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        rows = arrived.select("path", kind.alias("filetype"), F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("content_hash"))
        rows = rows.where(F.col("filetype").isin([f".{t.lstrip('.')}" for t in FILE_TYPES]))
        known = self._read("manifest", MANIFEST).where(F.col("batch") != batch)  # a replayed batch stands for itself
        known = known.groupBy("path").agg(F.max_by("content_hash", F.struct("at", "batch")).alias("content_hash"))
        new = settle(rows.join(known, ["path", "content_hash"], "left_anti"))
        text = settle(files.texts(new))
        made = chunk_rows(text, self.keywords, self.cfg).withColumn("batch", F.lit(batch))
        columns = [c.split()[0] for c in CHUNKS.split(", ")][:-1]
        made.select(*columns).write.mode("overwrite").parquet(f"{self.target}/chunks/batch={batch}")
        count = self.spark.read.schema(CHUNKS).parquet(f"{self.target}/chunks/batch={batch}").groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
        state = F.when(F.col("text").isNull(), "failed").when(F.coalesce("chunks", F.lit(0)) == 0, "rejected").otherwise("stored")
        listed = new.drop("content", "filetype").join(text.select("path", "text"), "path", "left").join(count, "path", "left")
        entry = listed.select("path", "content_hash", "modified", "length", state.alias("state"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.current_timestamp().alias("at"))
        entry.write.mode("overwrite").parquet(f"{self.target}/manifest/batch={batch}")
        discard(text)
        discard(new)

    def _files(self):
        glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in t.lstrip(".")) for t in FILE_TYPES) + "}"
        return {"pathGlobFilter": glob, "recursiveFileLookup": str(self.recursive).lower()}

    def stream(self) -> DataFrame:
        return self.spark.readStream.format("binaryFile").schema(SOURCE).options(**self._files(), maxFilesPerTrigger=self.per_batch).load(self.folder)

    def start(self, **trigger):
        """The running stream query; without a trigger it takes what is there and ends."""
        writer = self.stream().writeStream.foreachBatch(lambda rows, n: self.take(rows, f"s{n:012d}"))
        return writer.option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def sweep(self) -> int:
        """Take the files whose time of modification is not the manifest's; how many there were.

        Times and sizes are compared first, from the listing alone; only what differs is read.
        """
        listed = self.spark.read.format("binaryFile").options(**self._files()).load(self.folder).select("path", F.col("modificationTime").alias("modified"), "length")
        other = settle(listed.join(self.manifest().select("path", "modified", "length"), ["path", "modified", "length"], "left_anti"))
        found, since = other.agg(F.count(F.lit(1)), F.min("modified")).first()
        if found:
            arrived = self.spark.read.format("binaryFile").options(**self._files()).load(self.folder).where(F.col("modificationTime") >= F.lit(since))
            done = len([b for b in self._batches("manifest") if b.startswith("batch=w")])
            self.take(arrived.join(other.select("path"), "path", "left_semi"), f"w{done:012d}")
        discard(other)
        return found

    def run(self) -> None:
        """All that is new or changed, then the end."""
        self.start().awaitTermination()
        self.sweep()
