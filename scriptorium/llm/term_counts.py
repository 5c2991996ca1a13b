"""Frequency of every distinct term (problem 5).

Method: incremental signed deltas. Only added, changed or deleted records are aggregated, into changes of each term's
occurrences and record count; the changes are merged into counts that persist in partitions, of which only those are
rewritten that hold a changed term. A first load is the delta of all records against empty counts.

Results for special inputs: null and empty terms count nothing; a null count is 0; repeated rows count once; a term whose
last record is deleted is gone; without any record the counts are an empty table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import discard, materialize

RARE_BELOW, COMMON_ABOVE = 3, 0.25
#: Buckets of new counts, and the mean number of terms in a bucket beyond which their number is multiplied by GROWTH.
BUCKETS, BUCKET_TERMS, GROWTH = 32, 2_000_000, 8
#: Versions whose files stay for readers that have begun on them.
KEPT_VERSIONS = 3


def token_terms(tokens: DataFrame, src_table: str = "relfreq_reviews") -> DataFrame:
    """(src_table, record, part, term, n): terms of a table with one token per row (text_id, sent_no, tok_no, freq,
    journal). A term is the token without blanks at its ends and in lower case; null and empty ones are none.
    Repeated rows count once. Rows are spread by review and sentence, so that no review fills a task."""
    term = F.lower(F.btrim(F.col("freq"), F.lit(" ")))
    rows = tokens.where("freq is not null").select(
        F.col("text_id").alias("record"), F.col("sent_no").alias("part"), "tok_no", term.alias("term"), F.xxhash64("freq", "journal").alias("same"),
    ).where("term <> ''")
    once = rows.repartition("record", "part").dropDuplicates(["record", "part", "tok_no", "same", "term"])
    return once.groupBy("record", "part", "term").agg(F.count(F.lit(1)).alias("n")).select(F.lit(src_table).alias("src_table"), "record", "part", "term", "n")


def map_terms(maps: DataFrame, key: str = "chunk_key", counts: str = "unigram_counts", src_table: str = "chunk") -> DataFrame:
    """(src_table, record, part, term, n): terms of a table with a map from term to count; a null count is 0."""
    entries = maps.select(F.col(key).alias("record"), F.explode(counts).alias("term", "n"))
    return entries.select(F.lit(src_table).alias("src_table"), "record", F.lit(0).alias("part"), "term", F.coalesce("n", F.lit(0)).alias("n"))


def term_deltas(added: DataFrame | None, removed: DataFrame | None = None) -> DataFrame:
    """(src_table, term, d_occurrences, d_records): changes that the records in ``removed`` and ``added`` make. A changed
    record stands in both. The first aggregation, by record and term, is spread over all records, so that a term that
    every record holds is already reduced when its rows meet."""
    signed = [x.withColumn("sign", F.lit(s)) for x, s in ((added, 1), (removed, -1)) if x is not None]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    by_record = rows.groupBy("src_table", "record", "term").agg(
        F.sum(F.col("sign") * F.col("n")).alias("d_occurrences"),
        (F.max(F.greatest("sign", F.lit(0))) + F.min(F.least("sign", F.lit(0)))).alias("d_records"),
    )
    return by_record.groupBy("src_table", "term").agg(F.sum("d_occurrences").alias("d_occurrences"), F.sum("d_records").cast("bigint").alias("d_records"))


def merge_counts(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """(src_table, term, occurrences, records) after the deltas; terms without a record are gone. A union and one sum, so that
    state and deltas need no join."""
    signed = state.unionByName(deltas.withColumnsRenamed({"d_occurrences": "occurrences", "d_records": "records"}))
    merged = signed.groupBy("src_table", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return merged.where("records > 0")


def marked(counts: DataFrame, totals: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """``counts`` with ``mark``: rare, else common, else null. ``totals`` has a row per source table: (src_table, total)."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("total"), "common")
    return counts.join(F.broadcast(totals), "src_table").select("src_table", "term", "occurrences", "records", mark.alias("mark"))


STATE = "src_table string, term string, occurrences bigint, records bigint"


class TermCounts:
    """Counts that persist in a folder, in buckets by a hash of the term.

    A version is a manifest ``m-<number>`` that names a folder of files for each bucket; the highest one counts. ``apply``
    writes new files for the buckets that the deltas touch, then the manifest under a name of its own, then renames it: a
    merge that stops before the rename has changed nothing, and no file that a manifest names is ever overwritten. Files
    are deleted only when none of the last KEPT_VERSIONS manifests names them. One writer at a time; of two, the second one's rename
    fails.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.first_buckets = spark, folder.rstrip("/"), buckets
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _listed(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._path()):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self.fs.listStatus(self._path())) if n.startswith(prefix))

    def _manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0])

    def manifest(self) -> dict:
        """The manifest that counts: number, buckets, and a folder by bucket."""
        names = self._listed("m-")
        return self._manifest(names[-1]) if names else {"number": 0, "buckets": self.first_buckets, "parts": {}}

    def _frame(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.folder}/{p}" for p in parts))

    def read(self) -> DataFrame:
        """(src_table, term, occurrences, records)."""
        return self._frame(sorted(set(self.manifest()["parts"].values())))

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("src_table", "term"), F.lit(buckets)).cast("int")

    def _written(self, counts: DataFrame, buckets: int) -> dict[str, str]:
        name = f"d-{uuid.uuid4().hex}"
        counts.withColumn("bucket", self._bucket(buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return {f.getPath().getName().removeprefix("bucket="): f"{name}/{f.getPath().getName()}" for f in self.fs.listStatus(self._path(name)) if f.isDirectory()}

    def _publish(self, number: int, buckets: int, parts: dict[str, str]) -> None:
        hidden, name = self._path(f".m-{uuid.uuid4().hex}"), self._path(f"m-{number:012d}")
        out = self.fs.create(hidden, False)
        out.write(bytearray(json.dumps({"number": number, "buckets": buckets, "parts": parts}).encode()))
        out.close()
        if self.fs.exists(name) or not self.fs.rename(hidden, name):
            raise RuntimeError(f"version {number} was written by another merge")

    def _vacuum(self) -> None:
        kept = self._listed("m-")[-KEPT_VERSIONS:]
        named = {p.split("/")[0] for m in kept for p in self._manifest(m)["parts"].values()}
        for name in [*(m for m in self._listed("m-") if m not in kept), *(d for d in self._listed("d-") if d not in named)]:
            self.fs.delete(self._path(name), True)

    def apply(self, added: DataFrame | None, removed: DataFrame | None = None) -> DataFrame:
        """The counts after ``removed`` and ``added`` records (src_table, record, part, term, n); a changed record stands in both,
        as it was and as it is."""
        now = self.manifest()
        buckets, parts = now["buckets"], now["parts"]
        deltas = materialize(term_deltas(added, removed).where("d_occurrences <> 0 or d_records <> 0"), "term-deltas")
        touched = {str(r[0]) for r in deltas.select(self._bucket(buckets)).distinct().collect()} if parts else set()  # a row per bucket
        merged = merge_counts(self._frame([parts[b] for b in sorted(touched) if b in parts]), deltas)
        new = {b: p for b, p in parts.items() if b not in touched} | self._written(merged, buckets)
        terms = self._frame(sorted(new.values())).count()  # from the files' footers
        if terms > buckets * BUCKET_TERMS:
            old, buckets = self._frame(sorted(new.values())), buckets * GROWTH
            new = self._written(old, buckets)
        self._publish(now["number"] + 1, buckets, new)
        self._vacuum()
        discard(deltas)
        return self.read()
