"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The index is a log-structured merge tree of runs: tables in buckets of the key's hash, sorted by key in each, so
that runs meet in merge joins and none is shuffled again. Each batch of lines is counted by key and
merge-anti-joined with the runs. The keys that no run holds become a new run of level 0, so every key is in one run
only; for the others, the batch's counts are kept beside the runs as raises. When a level has ``fanout`` runs they
are merged into one run of the next level, so a batch meets few runs and each key is rewritten O(log batches) times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm.common import (
    HOT_ONE_IN,
    free_names,
    pin,
    remove,
    settled,
    shuffle_partitions,
    table_path,
    text_or_empty,
    union_all,
    without,
)

KEY = ["h1", "h2"]
#: Stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """An array with a struct (h1, h2) a line: 128 bits of the line's key, or null where the key is too short.

    The key is the line without blanks at its ends and with A-Z lower-cased. ``lower`` would also fold other
    letters, so it is applied to the text's bytes read as ISO-8859-1: that folds A-Z, and folds lead bytes of
    UTF-8 in a way that stays one to one, since the number of continuation bytes tells them apart.
    """
    folded = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        # Code points are the bytes (now characters) that do not continue one; each has 1 to 4 bytes.
        long_enough = (F.length(key) >= 4 * min_chars) | (
            (F.length(key) >= min_chars) & (F.length(F.regexp_replace(key, "[\\x80-\\xBF]", "")) >= min_chars)
        )
        return F.when(
            long_enough, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
        )

    return F.transform(split_lines(folded), hashed)


class LineRuns:
    """The runs of one index: rows (h1, h2, n_docs, last_doc), every key in one run.

    ``fanout``: runs of a level that are merged into one of the next. ``buckets``: of each run, and tasks that merge.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        #: Counts of batches for keys that were in a run before.
        self.raises: list[str] = []
        self._paths: dict[str, str] = {}

    def _store(self, rows: DataFrame) -> str:
        """A table of rows in buckets by key, sorted in each. Rows come from a shuffle or a merge by key, so a
        bucket is one file."""
        name, path = f"line_run_{uuid.uuid4().hex}", table_path(self.spark)
        rows.write.option("path", path).format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self._paths[name] = path
        return name

    def _drop(self, *names: str) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            remove(self.spark, self._paths.pop(n))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, counted: DataFrame) -> DataFrame:
        """The rows of ``counted`` whose key no run holds: a merge-anti-join with every run in turn."""
        for run in self.runs():
            counted = counted.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        return counted

    def add(self, batch: DataFrame) -> None:
        """Add a batch's rows (h1, h2, doc_id). A document must not be spread over batches."""
        once = batch.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        own = self._store(once.groupBy(*KEY).agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if not self.runs():
            self._place(own, 0)
            return
        counted = self.spark.table(own)
        fresh = self._store(self.unseen(counted))
        known = counted.join(self.spark.table(fresh).select(*KEY).hint("merge"), KEY, "left_anti")
        self.raises.append(self._store(known))
        self._drop(own)
        self._place(fresh, 0)

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = _merged(merged, self.spark.table(other))
            merged = self._store(merged)
            self._drop(*old)
            self._place(merged, level + 1)

    def totals(self) -> DataFrame:
        """One row a key: every run's counts and what later batches raised them by."""
        parts = [self.spark.table(r) for r in self.runs()]
        if not parts:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        if not self.raises:
            return union_all(parts)
        more = union_all([self.spark.table(r) for r in self.raises])
        more = more.groupBy(*KEY).agg(F.sum("n_docs").alias("_n"), F.max("last_doc").alias("_last")).hint("merge")
        raised = [p.join(more, KEY, "left") for p in parts]
        n_docs, last = F.col("n_docs") + F.coalesce("_n", F.lit(0)), F.greatest("last_doc", "_last")
        return union_all(raised).select(*KEY, n_docs.alias("n_docs"), last.alias("last_doc"))

    def close(self) -> None:
        self._drop(*self._paths.copy())


def _merged(run: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs in one: an outer merge join, in which no key has two rows."""
    a, b = run.alias("a"), other.alias("b").hint("merge")
    both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*KEY, "n_docs", "last_doc"]])


def key_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) of each different line of a row whose key is long enough."""
    keys = F.array_distinct(line_keys(F.col("text"), min_chars))
    return (
        docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
        .select("doc_id", F.explode(keys).alias("k"))
        .filter("k is not null")
        .select("doc_id", "k.h1", "k.h2")
    )


def _dropped_keys(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    spark = docs.sparkSession
    path = table_path(spark)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    key_rows(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).drop("batch"))
    common = pin(runs.totals().filter(F.col("n_docs") >= min_docs))
    runs.close()
    # Keys of a thousandth of all lines or more are at most HOT_ONE_IN; their lines stay where they are.
    hot = F.col("n_docs") >= max(1000, lines.count() // HOT_ONE_IN + 1)
    rest = lines.drop("batch")
    few = F.broadcast(common.filter(hot).select(*KEY, "last_doc"))
    other = rest.join(few.select(*KEY), KEY, "left_anti").join(common.filter(~hot).select(*KEY, "last_doc"), KEY)
    losing = rest.join(few, KEY).unionByName(other).filter(F.col("doc_id") < F.col("last_doc"))
    return losing.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("dropped"))


def dropped_keys(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(doc_id, dropped): the keys, as an array of structs, that each document loses; only documents that lose any."""
    return settled(docs.sparkSession, lambda: _dropped_keys(docs, min_chars, min_docs, batches, fanout))


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2
) -> DataFrame:
    """Add to ``docs``: kept_text, n_lines (before dropping) and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold loses all its lines except in the largest doc_id holding it.
    All other lines stay, in order. A null or empty text is one empty line. Rows that repeat a doc_id count as one
    document; rows without a doc_id count for nothing and stay whole. An empty table gives no rows. Other columns
    pass through, whatever their names; columns named like the added ones are replaced. Hash keys have 128 bits. A
    text's dropped keys are at most its own lines, so no group grows beyond a text; texts of any length are read
    whole, each by one task.
    """
    docs = without(docs, "kept_text", "n_lines", "n_dropped")
    losing = dropped_keys(docs, min_chars, min_docs, batches, fanout)
    of, gone, left = free_names(docs, "of", "gone", "left")
    mine = losing.select(F.col("doc_id").alias(of), F.col("dropped").alias(gone)).hint("shuffle_hash")
    both = docs.join(mine, F.col("doc_id") == F.col(of), "left")
    text, dropped = text_or_empty(), F.col(gone)
    keys = line_keys(text, min_chars)
    stays = F.transform(keys, lambda k: k.isNull() | ~F.array_contains(dropped, k))
    lines = split_lines(text)
    kept = F.filter(F.arrays_zip(lines.alias("line"), stays.alias("stays")), lambda x: x["stays"])
    cut = both.withColumn(left, F.when(dropped.isNotNull(), F.transform(kept, lambda x: x["line"])))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return cut.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.array_join(left, "\n"), text).alias("kept_text"),
        n_lines.alias("n_lines"),
        F.when(F.col(left).isNull(), F.lit(0)).otherwise(n_lines - F.size(left)).cast("long").alias("n_dropped"),
    )
