"""Shared pieces: Arrow text access, vectorised hashing of words, durable cuts and components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import ship

#: White space of the corpus contracts: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Folds A-Z to a-z and leaves every other byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = 1 << max(16, (n - 1).bit_length())
        for name, base in (("_POW", _BASE), ("_INV", pow(_BASE, -1, 2**64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span of bytes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_RANDOM[codes] * _powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a string column with their UTF-8 bytes and offsets, about limit bytes at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    buffers, kind = column.buffers(), np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of True that doesn't cross a row's end."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    last[at[1:] - 1] = inside[at[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one in the warehouse where that is unset, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def scratch(spark: SparkSession) -> str:
    """The folder below checkpoint_dir() that holds this session's checkpoints and intermediate tables."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return context.getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever file system it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def own_scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder for what runs inside, deleted at its end: nothing that reads from it may be used afterwards."""
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    path = scratch(spark)
    try:
        yield path
    finally:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a durable checkpoint, so that a lost executor costs no recomputation of what went before."""
    scratch(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table of the scratch folder: for rows of which later steps read few columns."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """df, of at most so many short rows, in no more partitions than they need: the driver keeps a record of every task."""
    return df.coalesce(max(1, -(-rows // per_task)))


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of rows with a table of one short row per key, without gathering a frequent key's rows in one task.

    count is the table's column with the number of rows of each key and total at least all of them, so fewer than parts
    keys can hold over one in parts of all rows: those are broadcast. Both inputs are read more than once.
    """
    frequent = F.col(count) > max(1, total // parts)
    hot, cold = table.where(frequent), table.where(~frequent)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def salted_join(rows: DataFrame, table: DataFrame, key: str, deal: str, share: int) -> DataFrame:
    """Inner join in which a key with over share rows is dealt out by the hash of column deal, the table's rows copied per salt.

    share should be at least one in a thousand of all rows: then fewer than a thousand (key, salts) are broadcast, and no
    row of the table. rows are read twice.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(deal), salts).cast("int")).drop("_salts")
    right = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, most: int = 500_000) -> DataFrame:
    """The rows of docs but those whose id and text hash are in gone (id, th), null ids being equal.

    Up to most rows of two numbers go to every executor, so the texts needn't be shuffled; more are joined by shuffle.
    """
    gone = cut(gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct())
    few = gone.limit(most + 1).count() <= most
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    return own.join(F.broadcast(gone) if few else gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti").select("row.*")


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str, most: int = 1_000_000) -> DataFrame:
    """The rows of docs but those whose id is in gone (ids); up to most ids go to every executor, more are joined by shuffle."""
    gone = cut(gone.select(F.col(id_col).alias("gone_id")).distinct())
    few = gone.limit(most + 1).count() <= most
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col(id_col).cast("bigint").alias("id"))
    return own.join(F.broadcast(gone) if few else gone, F.col("id") == F.col("gone_id"), "left_anti").select("row.*")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as stars: of each component of them, those of all other nodes with its least."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(a), top(b)
            if p != q:
                up[max(p, q)] = min(p, q)
    a = [x for x in up if up[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([top(x) for x in a], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, per_task: int = 100_000) -> DataFrame:
    """(id, component) of every node of the links (a, b); component is the smallest id that can be reached.

    Rounds of three steps. Tasks of about per_task links turn theirs into stars around the least nodes. Large and small
    stars follow where nodes stand in several tasks' stars: each node's larger neighbours, then its smaller ones, are
    linked with the least of all, until every tree is a star around its least node; the rounds grow with the logarithm
    of the nodes. One way at every size: all state is in checkpointed links, a frequent node's links are joined with its
    least neighbour by hot_join(), and the driver sees a count and a flag per round.
    """
    ship(edges.sparkSession)
    links = cut(edges.where("a != b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct())
    n = links.count()
    while True:
        links = cut(packed(links, n, per_task).mapInArrow(_stars, "a bigint, b bigint"))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
        n, open_ = ends.agg(F.coalesce(F.sum("down"), F.lit(0)), F.bool_or(F.expr("up > 1 or up > 0 and down > 0"))).first()
        if not open_:  # every node has one smaller neighbour and no larger ones, or larger ones only
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "a", "n", 2 * n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        links = cut(small.where("a != b").distinct())
