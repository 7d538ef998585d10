"""Exact dedup by a log-structured merge index of text digests.

Every partition of a batch is a memtable: it flushes sorted runs of ``(digest, id)`` of
bounded length (level 0). Compaction collapses the runs that are not merged yet, in
buckets of the digest, and merges the buckets with level 1, which is stored in the same
buckets in order of the digest, so that only new runs are shuffled. Level 1 has the
smallest identifier and the count of each digest. Every file has a bitmap filter, made
when it is first needed: a lookup probes the filters and reads those files only that may
hold a digest it asks for.

Digests seen more than once are *hits*. A filter of the hits takes their texts out of a
second scan, and their bytes are compared. Texts that share a digest but differ are
regrouped by the whole text. DataFrame functions only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, columns_of, fresh, read, scratch_dir, stored, text_of

Digest = Callable[[Column], Column]

#: Rows of a level-0 run at most.
MEMTABLE_ROWS = 1_000_000
#: Bits of a filter for each of its rows.
BITS_PER_ROW = 16
#: Bits of the largest filter that is broadcast: 16 MB. Beyond it, joins shuffle.
MAX_FILTER_BITS = 27


def normalised(col: Column | str) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_of(col), SPACES, " ")


def sha256(col: Column) -> Column:
    return F.unhex(F.sha2(F.encode(col, "UTF-8"), 256))


def _filter_bits(rows: int) -> int:
    return 2 ** max(15, math.ceil(math.log2(BITS_PER_ROW * max(rows, 1))))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def _bitmap(bits: int) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(_place(bits))).alias("bitmap")


def _has_bit(bits: int) -> Column:
    """Whether ``bitmap`` has the bit of ``digest``."""
    pos = F.bitmap_bit_position(_place(bits))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (pos % 8).cast("int")) == 1


class DigestIndex:
    """Digest index of any number of batches, in a folder that executors share.

    ``add`` flushes a batch as level-0 runs; ``compact`` merges the runs added since the
    last time into level 1; ``lookup`` finds digests in both levels. Files stay as they
    are once written, until the folder goes, so readers never lose them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = MEMTABLE_ROWS):
        self.spark = spark
        self.path = path or scratch_dir(spark, "digests")
        self.memtable_rows = memtable_rows
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._batches = 0
        self._new: list[str] = []
        self._merged: DataFrame | None = None
        self._filters: dict[str, tuple[int, DataFrame]] = {}
        self._schema = None

    def add(self, rows: DataFrame) -> None:
        """``rows``: ``id``, ``digest``."""
        rows = rows.select("digest", "id")
        run = f"{self.path}/level0/{self._batches:06d}"
        rows.sortWithinPartitions("digest", "id").write.option("maxRecordsPerFile", self.memtable_rows).parquet(run)
        self._schema = rows.schema
        self._batches += 1
        self._new.append(run)

    def runs(self) -> DataFrame:
        """``digest, id`` of every row of all batches."""
        return self.spark.read.schema(self._schema).parquet(*[f"{self.path}/level0/{k:06d}" for k in range(self._batches)])

    def _collapsed(self, runs: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self._schema).parquet(*runs)
        return rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))

    def merging(self) -> DataFrame:
        """What the next compaction writes: the new runs, collapsed, and level 1."""
        new = self._collapsed(self._new)
        if self._merged is None:
            return new
        old = self._merged.select(F.col("digest").alias("digest1"), F.col("keep_id").alias("keep1"), F.col("n").alias("n1"))
        both = new.hint("merge").join(old, F.col("digest") == F.col("digest1"), "full")
        zero = F.lit(0).cast("long")
        return both.select(F.coalesce("digest", "digest1").alias("digest"), F.least("keep_id", "keep1").alias("keep_id"), (F.coalesce("n", zero) + F.coalesce("n1", zero)).alias("n"))

    def compact(self) -> DataFrame:
        """Level 1: ``digest, keep_id, n``, each digest once; ``n`` rows have it, of which
        ``keep_id`` is the smallest identifier."""
        if self._new:
            name = f"digests_{uuid.uuid4().hex}"
            at = f"{self.path}/level1/{self._batches:06d}"
            self.merging().write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", at).saveAsTable(name)
            self._merged, self._new = self.spark.table(name), []
        return self._merged

    def _level(self, df: DataFrame) -> tuple[int, DataFrame]:
        """Bits of the filters of a level's files, and ``file, bucket, bitmap``."""
        rows = df.select("digest", F.col("_metadata.file_path").alias("file"))
        most = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        bits = _filter_bits(most or 1)
        return bits, stored(rows.groupBy("file", F.bitmap_bucket_number(_place(bits)).alias("bucket")).agg(_bitmap(bits)), "digest-filters")

    def candidates(self, digests: DataFrame) -> DataFrame:
        """``digest, file`` of all files that may hold a digest, by their filters."""
        levels = {run: self.spark.read.schema(self._schema).parquet(run) for run in self._new}
        if self._merged is not None:
            levels[f"{self.path}/level1/{self._batches - len(self._new)}"] = self._merged
        asked, out = digests.select("digest").distinct(), None
        for name, df in levels.items():
            if name not in self._filters:
                self._filters[name] = self._level(df)
            bits, bitmaps = self._filters[name]
            hit = asked.withColumn("bucket", F.bitmap_bucket_number(_place(bits))).join(broadcast_if_small(bitmaps, 2 ** (MAX_FILTER_BITS - 3)), "bucket").where(_has_bit(bits)).select("digest", "file")
            out = hit if out is None else out.unionByName(hit)
        return stored(out, "digest-candidates")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``digest, keep_id, n`` of the given digests that the index has. Reads only
        files whose filters let one of them through; their names are metadata of the
        index and no part of the data."""
        some = self.candidates(digests)
        files = sorted(r["file"] for r in some.select("file").distinct().collect())
        asked = some.select("digest").distinct()
        parts = []
        for level in (0, 1):
            mine = [f for f in files if f"/level{level}/" in f]
            if mine:
                parts.append(self._collapsed(mine) if level == 0 else self.spark.read.schema(self._merged.schema).parquet(*mine))
        if not parts:
            return asked.select("digest", F.lit(None).cast(self._schema["id"].dataType).alias("keep_id"), F.lit(0).cast("long").alias("n")).limit(0)
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return found.join(asked, "digest", "left_semi").groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def bit_filter(digests: DataFrame, rows: int, max_bits: int = MAX_FILTER_BITS) -> Callable[[DataFrame], DataFrame]:
    """A function that keeps the rows of a table (with ``digest``) that may be among
    ``digests``, by a bitmap of hashed digests. Where that would be too large to
    broadcast, by a shuffled join, and then no row passes by chance."""
    bits = _filter_bits(rows)
    if bits > 2**max_bits:
        return lambda df: df.join(digests.select("digest"), "digest", "left_semi")
    bucket = F.bitmap_bucket_number(_place(bits)).alias("bucket")
    bitmap = stored(digests.groupBy(bucket).agg(_bitmap(bits)), "digest-filter")
    return lambda df: df.withColumn("bucket", bucket).join(F.broadcast(bitmap), "bucket").where(_has_bit(bits)).drop("bucket", "bitmap")


class Copies(NamedTuple):
    """``runs``: ``digest, id`` of every row; ``hits``: ``digest, keep_id, n``;
    ``mixed``: rows ``id, norm, digest, keep_id, n`` of digests that unequal texts
    share, or None if there are none."""

    runs: DataFrame
    hits: DataFrame
    mixed: DataFrame | None


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> Copies:
    """Builds the index of ``docs`` and compares the bytes of its hits."""
    keyed = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
    index = DigestIndex(docs.sparkSession)
    index.add(keyed)
    hits = stored(index.compact().where("n > 1"), "digest-hits")
    maybe = bit_filter(hits, hits.count())
    compared = (
        maybe(keyed)
        .groupBy("digest")
        .agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        .where("lo <> hi")
        .select("digest")
    )
    shared = stored(compared, "digest-shared")
    if shared.isEmpty():
        return Copies(index.runs(), hits, None)
    shared = broadcast_if_small(shared)
    rows = keyed.join(shared, "digest", "left_semi")
    whole = rows.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return Copies(
        index.runs().join(shared, "digest", "left_anti"),
        hits.join(shared, "digest", "left_anti"),
        rows.join(whole, "norm"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``.

    Null texts count as empty, and empty texts are equal. Of equal texts the row
    with the smallest id stays; a null id is larger than any other. Of repeated
    rows (same id and text) one stays. Other columns of ``docs`` are ignored, so
    their names cannot clash. An empty table gives an empty result.
    """
    return verdicts(find_copies(docs, id_col, text_col, digest))


def verdicts(copies: Copies) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` of all rows."""
    runs, hits, mixed = copies
    rows = (
        runs.groupBy("digest", "id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(hits.select("digest", "keep_id", "n"), "digest", "left")
        .select(
            "digest",
            "id",
            "copies",
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("n"),
        )
    )
    if mixed is not None:
        mixed = mixed.groupBy("norm", "digest", "id", "keep_id", "n").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.unionByName(mixed.drop("norm"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
        "digest",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: Copies | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Nulls, ties and repeated
    rows count as in ``exact_dedup``. Texts of rows that have no copy are not shuffled
    while the hits are few enough to broadcast."""
    runs, hits, mixed = copies or find_copies(docs, id_col, text_col)
    hits = broadcast_if_small(hits.select("digest", "keep_id"))
    twice = runs.join(hits, "digest").where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = mixed is not None or not twice.isEmpty()
    at, keep, is_hit, norm, keep2 = fresh(docs, "digest", "keep", "hit", "norm", "keep2")
    hits = hits.select(F.col("digest").alias(at), F.col("keep_id").alias(keep))
    keyed = docs.withColumn(at, sha256(normalised(text_col))).join(hits.withColumn(is_hit, F.lit(True)), at, "left")
    if mixed is not None:
        whole = mixed.select(F.col("norm").alias(norm), F.col("keep_id").alias(keep2)).distinct()
        keyed = keyed.withColumn(norm, normalised(text_col)).join(whole, norm, "left")
        keyed = keyed.withColumn(keep, F.coalesce(keep, keep2)).withColumn(is_hit, F.coalesce(is_hit, F.col(keep2).isNotNull()))
    hit = F.coalesce(is_hit, F.lit(False))
    if not repeated:
        return keyed.where(~hit | F.col(id_col).eqNullSafe(F.col(keep))).select(*columns_of(docs))
    alone = keyed.where(~hit)
    first = keyed.where(hit & F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([at, id_col])
    return alone.unionByName(first).select(*columns_of(docs))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dropped ones too."""
    out = exact_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = {
    "op4_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
