"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a Parquet table of (digest, keep_id) at a path, bucketed and sorted by digest, one row
for each distinct text. A batch of new documents is reduced to one row for each digest by a partial
aggregate before the shuffle, so a text that a third of all rows share never meets in one task.
Those rows meet the index in a sort-merge anti-join; what is new is appended to it. A table is taken
in batches of falling ids (parts of about equal size, cut by approximate quantiles of the id), so what the index
has already is the row with the largest id. Documents get
their decision by a join on the digest whose two sides are both exchanged, so that adaptive
execution can split the rows of a frequent text.

Defined results: null text equals the empty text; of equal texts the row with the largest id stays
(a null id is smallest); of rows that repeat both id and text one stays; a text that the index has
already is dropped and keeps the index's keep_id; an empty table gives an empty result and leaves
the index as it is. Extra columns are not looked at; the stage hands them on under any name.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, packed, shared_dir, stage, unpacked

LEAST = -(2 ** 63)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """The table of known digests. With a path its files outlast the session."""

    def __init__(self, spark: SparkSession, table: str, buckets: int, path: str | None = None):
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path
        if path and not spark.catalog.tableExists(table) and self._has_files(path):
            spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def _has_files(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """fresh(digest, keep_id): one file for each bucket, sorted."""
        w = fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (w.option("path", self.path) if self.path else w).saveAsTable(self.table)

    def forget(self) -> None:
        """Drop the table's name. Its files at a path stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, digest of each row, staged: rid tells apart rows that repeat an id."""
    return stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "exact-prints")


def resolve(prints: DataFrame, index: DigestIndex) -> DataFrame:
    """A row for each digest of the batch: digest, keep_id, keep_rid (null if the index has it), n.
    What is new is appended to the index."""
    order = F.coalesce(F.col("id"), F.lit(LEAST))
    groups = prints.groupBy("digest").agg(F.max("id").alias("keep_id"), F.max_by("rid", order).alias("keep_rid"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups, "exact-groups")
    if not index.exists():
        index.append(groups)
        return groups
    known = index.read()
    fresh = groups.join(known.hint("merge"), "digest", "left_anti")
    old = groups.join(known.select("digest", F.col("keep_id").alias("old_id")).hint("merge"), "digest")
    both = stage(fresh.unionByName(old.select("digest", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_rid"), "n")), "exact-groups")
    index.append(both.where("keep_rid is not null"))
    return both


def in_batches(prints: DataFrame, index: DigestIndex, batches: int) -> DataFrame:
    """A row for each digest of the table, as resolve() gives, of batches with falling ids."""
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    cuts = (prints.agg(F.percentile_approx("id", shares, 1000)).first()[0] if shares else None) or []  # a number for each cut
    key, parts, above = F.coalesce(F.col("id"), F.lit(LEAST)), [], F.lit(True)
    for cut in cuts:
        parts.append(prints.where(above & (key > cut)))
        above = key <= cut
    parts.append(prints.where(above))
    groups = [resolve(p, index) for p in parts]
    return reduce(DataFrame.unionByName, groups).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_rid").alias("keep_rid"), F.sum("n").alias("n"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """id, keep_id, group_size, kept, digest for each row of docs."""
    prints = fingerprints(docs, id_col, text_col)
    groups = in_batches(prints, index, batches)
    return prints.join(groups, "digest").select(
        "id", "keep_id", F.col("n").alias("group_size"), (F.col("rid").eqNullSafe(F.col("keep_rid"))).alias("kept"), "digest")


#: Batches in which the registered query and the stage take a table.
BATCHES = 3


def _fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), shared_dir(spark, "digest-index"))


def query(spark, sf_dir: str) -> DataFrame:
    index = _fresh_index(spark)
    out = deduplicate(documents(spark, sf_dir), index, batches=BATCHES)
    index.forget()
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that stay; the columns of docs. Texts meet their decision by id and digest, which
    no two texts share, so that copies of one text do not meet in one task.

    Defined results: as for the module; null text counts as empty, so one document without text stays."""
    prints, index = fingerprints(docs), _fresh_index(spark)
    groups = in_batches(prints, index, BATCHES)
    index.forget()
    kept = stage(prints.join(groups.select(F.col("keep_rid").alias("rid"), F.col("digest").alias("d")), "rid").select(F.col("id").alias("i"), "d"), "exact-kept")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    out = packed(docs, id=F.col("doc_id"), digest=digest(F.col("text"))).join(kept, same, "left_semi")
    twice = prints.groupBy("id", "digest").count().where("count > 1").select(F.col("id").alias("i"), F.col("digest").alias("d"))
    if not twice.isEmpty():  # rows that repeat id and text
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["id", "digest"]))
    return unpacked(out, docs.columns)
