"""Raw pages as one table that can be changed in place: pages replaced, domains deleted, only touched partitions rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.state import cut, forget

RAW = "rel string, content string, domain string, bucket int"
TOMBSTONES = "domain string, number bigint, done boolean"


class Corpus:
    """Parquet of ``rel, content, domain`` below ``root``, in ``buckets`` partitions by a hash of the path.

    A change rewrites the partitions that hold what it touches and leaves all other files alone. A deletion is first noted as a tombstone, which hides the
    domain's pages at once; one that died half way is finished by the next change. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs, self.path = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def _all(self) -> DataFrame:
        return self.spark.read.schema(RAW).parquet(f"{self.root}/pages") if self._exists("pages") else self.spark.createDataFrame([], RAW)

    def tombstones(self) -> DataFrame:
        """(domain, number, done) of deletions; those not done hide what is still in files."""
        rows = self.spark.read.schema(TOMBSTONES).parquet(f"{self.root}/tombstones") if self._exists("tombstones") else self.spark.createDataFrame([], TOMBSTONES)
        return rows.groupBy("number", "domain").agg(F.max("done").alias("done"))

    def read(self) -> DataFrame:
        """(rel, content, domain) of the pages there are."""
        hidden = self.tombstones().filter("not done").select("domain").distinct()
        return self._all().join(hidden, "domain", "left_anti").select("rel", "content", "domain")

    def _rewrite(self, rows: DataFrame, touched: list[int]) -> None:
        """Put ``rows`` in place of the touched partitions; one that keeps no row is deleted with its folder."""
        new = cut(rows, "rewrite")  # what is read is about to be replaced
        left = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/pages")
        for b in set(touched) - left:
            self.fs.delete(self.path(f"{self.root}/pages/bucket={b}"), True)
        forget(new)

    def _bury(self, domain: str, number: int, done: bool) -> None:
        self.spark.createDataFrame([(domain, number, done)], TOMBSTONES).coalesce(1).write.mode("append").parquet(f"{self.root}/tombstones")

    def _finish(self) -> None:
        """End deletions that an earlier run did not."""
        for r in self.tombstones().filter("not done").orderBy("number").collect():
            self._clear(r["domain"])
            self._bury(r["domain"], r["number"], True)

    def _clear(self, domain: str) -> int:
        held = self._all().filter(F.col("domain") == domain).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row for each partition
        touched = [r["bucket"] for r in held]
        if touched:
            self._rewrite(self._all().filter(F.col("bucket").isin(touched)).filter(F.col("domain").isNull() | (F.col("domain") != domain)), touched)
        return sum(r["n"] for r in held)

    def upsert(self, pages: DataFrame) -> None:
        """Pages ``rel, content``: new ones, and those in place of pages of the same path; of rows that repeat a path the greatest content."""
        self._finish()
        new = pages.groupBy("rel").agg(F.max("content").alias("content"))
        new = cut(new.withColumn("domain", text.page_domain(F.col("content"))).withColumn("bucket", F.pmod(F.xxhash64("rel"), F.lit(self.buckets)).cast("int")), "upsert")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if touched:
            old = self._all().filter(F.col("bucket").isin(touched)).join(new.select("rel"), "rel", "left_anti").select("rel", "content", "domain", "bucket")
            self._rewrite(old.unionByName(new), touched)
        forget(new)

    def delete_domain(self, domain: str) -> int:
        """Delete a domain's pages; returns how many, 0 if it has none (then nothing is written)."""
        self._finish()
        if self._all().filter(F.col("domain") == domain).isEmpty():
            return 0
        number = (self.tombstones().agg(F.max("number")).first()[0] or 0) + 1
        self._bury(domain, number, False)
        n = self._clear(domain)
        self._bury(domain, number, True)
        return n
