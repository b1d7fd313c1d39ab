"""What the operators of this subpackage share: scratch tables, skew-safe joins, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A key that holds at least this share of all rows is hot, so there are at most HOT_ONE_IN hot keys.
HOT_ONE_IN = 1000


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that the session names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder (the session's setting is left alone); a cluster
    must name one. The folder goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="seekspark-")
        _folders[app] = f"{base.rstrip('/')}/seekspark-{app}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders[app])
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(target)
        system.deleteOnExit(target)
    return _folders[app]


_folders: dict[str, str] = {}
#: Tables made within the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


def table_path(spark: SparkSession) -> str:
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, as a table; the tables that were made on the way go."""
    _scopes.append([])
    try:
        frame = make()
        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
    finally:
        made = _scopes.pop()
    for p in made:
        remove(spark, p)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add: its own output takes their place."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` bears."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, which are unique in ``right``; any key may hold a large share of ``left``.

    Keys that hold a thousandth of ``left`` or more are at most HOT_ONE_IN; their rows of ``right`` are
    broadcast, so their rows of ``left`` stay where they are. All others go through a shuffled join. ``left``
    should be cheap to read twice (a table, not a computation). Nulls in a key match nothing.
    """
    counts = left.groupBy(*keys).count()
    rows = left.count()
    hot = counts.filter(F.col("count") >= max(1000, rows // HOT_ONE_IN + 1)).select(*keys).collect()
    if not hot:
        return left.join(right, keys, how)
    listed = left.sparkSession.createDataFrame(hot, right.select(*keys).schema)
    few = F.broadcast(listed)
    common = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    return common.unionByName(left.join(few, keys, "left_anti").join(right, keys, how))


def prefix_sums(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before each row, by ``group`` in the order (chunk, order).

    ``chunk`` is a whole number that rises with the wanted order and holds a bounded number of rows a value, so a
    hot group is spread over many tasks. The chunks' totals are summed in two levels: CHUNKS of them make a chunk
    of the second, of which a group's task gets a row each (one for CHUNKS x CHUNK rows of the input).
    """
    totals = df.groupBy(*group, chunk).agg(F.sum(value).alias("_total"))
    starts = _chunk_starts(totals, group, chunk)
    inner = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(starts, [*group, chunk])
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_before", "_within")
    )


#: Chunks of a level that are one chunk of the next.
CHUNKS = 4096


def _chunk_starts(totals: DataFrame, group: list[str], chunk: str) -> DataFrame:
    """(group, chunk, _before): what all smaller chunks of the group hold."""
    w = lambda *by: Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("_upper", F.floor(F.col(chunk) / CHUNKS))
    upper = placed.groupBy(*group, "_upper").agg(F.sum("_total").alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_upper").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(*group, "_upper", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = placed.withColumn("_in", F.coalesce(F.sum("_total").over(w(*group, "_upper")), F.lit(0)))
    return within.join(upper, [*group, "_upper"]).select(*group, chunk, (F.col("_base") + F.col("_in")).alias("_before"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fields(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of ``base``."""
    starts, ends, reach = [], [], 0
    for _, a, b in sorted(base, key=lambda x: x[1]):
        reach = max(reach, b)
        starts.append(a)
        ends.append(reach)
    # Of the base spans that begin before a span's end, none may end after its start.
    return [s for s in spans if (i := bisect_left(starts, s[2])) == 0 or ends[i - 1] <= s[1]]


def trimmed(run: Callable) -> Callable:
    """``run``, a function of batches in a Python worker, which gives freed memory back when it ends: workers wait for
    later tasks, beside which they would keep the most that they ever held."""

    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)
