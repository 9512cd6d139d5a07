"""Near-duplicate documents by one-permutation hashing with optimal densification and star-shaped candidates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom import ship
from tagloom.llm.common import FOLD, SPACE, components, cut, hot_join, mix, packed, prefix_sums, remove, runs, salted_join, scratch, span_hash, text_chunks

BINS = 128
_PROBES = np.random.default_rng(11).integers(0, BINS, (64, BINS))


def shingle_sets(codes: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row of a chunk of text."""
    codes = FOLD[codes]
    start, end, row = runs(~SPACE[codes], offsets)
    word = span_hash(prefix_sums(codes), start, end) if len(start) else np.zeros(0, np.uint64)
    at = np.searchsorted(row, np.arange(len(offsets)))
    chain = word.copy()
    for k in range(1, words):
        chain[: len(word) - k] = mix(chain[: len(word) - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:]) if len(word) > k else chain[: len(word) - k]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= words:
            s = np.sort(chain[lo : hi - words + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            h = np.uint64(hi - lo)
            for w in word[lo:hi]:
                h = mix(np.array([h ^ w]) * np.uint64(0xD6E8FEB86659FD93))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS bins; an empty bin takes that of the first non-empty one on its own random walk."""
    edges = np.searchsorted(shingles, (np.arange(BINS, dtype=np.uint64) << np.uint64(57)))
    full = np.append(edges[1:], len(shingles)) > edges
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[edges[full]]
    empty = np.flatnonzero(~full)
    for step in range(len(_PROBES) + BINS):
        if not len(empty):
            break
        to = _PROBES[step][empty] if step < len(_PROBES) else (empty + 1 + step - len(_PROBES)) % BINS
        found = full[to]
        out[empty[found]] = out[to[found]]
        empty = empty[~found]
    return out


def _signatures(words: int, bands: int, rows: int):
    scale = (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, offsets in text_chunks(batch.column(1)):
                n, h1, h2, keys = [], [], [], []
                for s in shingle_sets(codes, offsets, words):
                    n.append(len(s))
                    a = mix(s + np.uint64(0x632BE59BD9B4E019))
                    h1.append(a.sum(dtype=np.uint64) ^ mix(np.array([len(s)], np.uint64))[0])
                    h2.append(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
                    keys.append((mix((mix(signature(s))[: bands * rows].reshape(bands, rows) * scale).sum(1, dtype=np.uint64) + salt)).view(np.int64) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.array(n, np.int64)), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    names=["id", "n", "h1", "h2", "bands"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, offsets in text_chunks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(codes, offsets, words)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, per_salt: int = 200, tile_shingles: int = 300_000, tile_rows: int = 1500) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) per document; links are pairs with 100 * |A & B| >= percent * |A | B|.

    Equal sets fall into one class first (a partial aggregate, so exact copies never meet in one task). Class
    representatives go to banded buckets; each bucket links all members with one centre. Sets are confirmed in full.
    Where a bucket's members are still in several components, those documents meet again at the rarest shingles of
    their sets, as many as a link must share one of (prefix filter), with documents of like size only: so no link that
    shares a bucket is lost, whatever the centres were, and what has no link but common passages meets nowhere. Each
    document has its home at one such shingle and visits the homes of those it meets. What is at a home is
    compared in tiles of about tile_shingles shingles and tile_rows documents, of the shingles that several components have, which return a
    spanning set of the links between components, never pairs. A link with similarity s shares no bucket with
    probability (1 - s**rows)**bands: 5e-7 at 0.85, 5e-5 at 0.8.

    Null or empty text: n_shingles 0, linked with nothing. Rows that repeat an id: each row is returned and they are
    one node; they count as copies of one document. Null id: n_shingles is given, the component is null and it is kept.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    if bands * rows > BINS:
        raise ValueError(f"bands * rows must be at most {BINS}")
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = cut(text.mapInArrow(_signatures(words, bands, rows), "id bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>"))
    some = sig.where("n > 0 and id is not null")
    classes = some.groupBy("h1", "h2").agg(F.min(F.struct("id", "n", "bands")).alias("m"))
    classes = cut(classes.select("h1", "h2", F.col("m.id").alias("rep"), F.col("m.n").alias("n"), F.col("m.bands").alias("bands")))
    total = classes.count() * bands
    classes = packed(classes, total)
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    centre = buckets.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("s"), F.count("*").alias("k")).where("k > 1")
    centre = centre.select("key", "k", F.col("s.rep").alias("a"), F.col("s.n").alias("m"))
    buckets = cut(hot_join(buckets, centre, "key", "k", total).drop("k"))
    buckets = packed(buckets, buckets.count())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"near_sets_{uuid.uuid4().hex}"
    folder = f"{scratch(spark)}/{table}"
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    sets = text.join(wanted, "id", "left_semi").mapInArrow(_sets(words), "id bigint, shingles array<bigint>")
    sets.repartition(parts, "id").write.bucketBy(parts, "id").format("parquet").option("path", folder).saveAsTable(table)
    try:
        star = buckets.where("rep != a").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        star = cut(star.select("a", F.col("rep").alias("b")).distinct())
        label = components(_confirmed(star, spark.table(table), percent, per_salt)).select(F.col("id").alias("rep"), "component")
        own = buckets.join(label, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
        mixed = own.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("k")).where("least < most").select("key", "k")
        apart = cut(hot_join(own, mixed, "key", "k", total).select("rep", "n", "c").distinct())
        joined = components(_across(apart, spark.table(table), percent, tile_shingles, tile_rows)).select(F.col("id").alias("c"), F.col("component").alias("whole"))
    finally:
        spark.sql(f"drop table if exists {table}")
        remove(spark, folder)
    of = classes.select("h1", "h2", "rep")
    of = of.join(label, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    of = of.join(joined, "c", "left").select("h1", "h2", F.coalesce("whole", "c").alias("c"))
    out = sig.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.col("h1")).alias("h1"), "h2").join(of, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _spanning(percent: int):
    """Pairs of components that links from a tile's left to its right documents join, as many as join the same ones."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comp, n, left, right = (table.column(c).to_numpy() for c in ("c", "n", "left", "right"))
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        lists = table.column("shared").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        value, seen, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        often = times > 1
        place = np.cumsum(often) - 1
        row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        row, col = row[often[seen]], place[seen[often[seen]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(left), len(right)), np.float32)
        at_left, at_right = np.full(len(n), -1), np.full(len(n), -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        step = 4096
        for k in range(0, int(often.sum()), step):
            a, b = np.searchsorted(col, [k, k + step])
            x, y = np.zeros((len(left), step), np.float32), np.zeros((step, len(right)), np.float32)
            r, c = row[a:b], col[a:b] - k
            x[at_left[r[at_left[r] >= 0]], c[at_left[r] >= 0]] = 1
            y[c[at_right[r] >= 0], at_right[r[at_right[r] >= 0]]] = 1
            both += x @ y
        union = n[left][:, None] + n[right][None, :] - both
        a, b = np.nonzero((100 * both.astype(np.float64) >= percent * union.astype(np.float64)) & (comp[left][:, None] != comp[right][None, :]))
        a, b = left[a], right[b]
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = sorted((top(int(comp[x])), top(int(comp[y]))))
            if p != q:
                up[q] = p
                out.append((p, q))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _across(apart: DataFrame, sets: DataFrame, percent: int, tile_shingles: int, tile_rows: int) -> DataFrame:
    """Pairs (a, b) of components that links join; apart has (rep, n, c) of the documents whose buckets hold several components.

    In any one order of all shingles, two sets that are similar enough share one of their first n - ceil(n * percent /
    100) + 1. The order begins with shingles that one component alone has, which can join nothing; the others follow by
    the number of documents that have them. Documents meet at (shingle, size class), a class with its neighbour; groups
    with the same members count once. A document is at home in the largest of its groups, so that documents that resemble
    each other have few homes, and visits the homes of all that it shares a group with.
    """
    total, documents = apart.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    apart = packed(apart, documents)
    own = apart.join(sets, apart["rep"] == sets["id"])
    common = own.select("c", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("k")).where("least < most").select("s", "k")
    each = hot_join(own.select("rep", F.explode("shingles").alias("s")), common, "s", "k", total)
    each = each.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("x")).join(apart, "rep")
    first = F.expr(f"slice(x.s, 1, greatest(0, least(size(x), size(x) - (({percent} * n + 99) div 100) + 1)))")  # the n - size(x) others come before
    size = F.floor(F.log("n") / np.log(100 / percent)).cast("int")
    each = cut(each.select("rep", "n", "c", size.alias("g"), F.col("x.s").alias("shared"), first.alias("first")).where("size(first) > 0"))
    met = each.select("rep", "c", F.size("shared").alias("load"), F.explode(F.array("g", F.col("g") + 1)).alias("g"), "first").select("rep", "c", "load", "g", F.explode("first").alias("s"))
    met = cut(met.select("rep", "c", "load", F.xxhash64("s", "g").alias("group")))
    many = met.count()
    met = packed(met, many)
    groups = met.groupBy("group").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("least < most")
    groups = groups.groupBy("k", "who").agg(F.min("group").alias("group")).select("group", "k")
    met = hot_join(met.select("rep", "load", "group"), groups, "group", "k", many)
    own = F.max(F.struct("k", "group")).over(Window.partitionBy("rep"))["group"]  # a document's groups are fewer than its shingles
    met = packed(cut(met.select("rep", "load", "group", own.alias("own"))), many)
    homes = met.select("group", F.col("own").alias("home")).distinct()
    visits = salted_join(met, homes, "group", "rep", max(1000, many // 1000)).select("rep", "home", "load", (F.col("own") == F.col("home")).alias("here"))
    visits = cut(visits.distinct())
    visited = visits.count()
    visits = packed(visits, visited)
    parts = lambda mine: F.greatest(F.lit(1), F.ceil(F.sum(F.when(mine, F.col("load"))) / tile_shingles), F.ceil(F.count_if(mine) / tile_rows)).cast("int")
    load = visits.groupBy("home").agg(parts(F.col("here")).alias("lefts"), parts(F.lit(True)).alias("rights"), F.count("*").alias("k"))
    rows = hot_join(visits.select("rep", "home", "here"), load, "home", "k", visited)
    mine, other = F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rights")).cast("int")
    rows = rows.withColumn("i", mine).withColumn("j", other)
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), (F.col("here") & (i == F.col("i"))).alias("left"), F.lit(True).alias("right")))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.col("here") & (j != F.col("j"))), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    rows = rows.select("home", "rep", F.explode(F.concat(as_right, as_left)).alias("t")).select("home", "rep", "t.i", "t.j", "t.left", "t.right")
    whole = rows.join(each, "rep").select("home", "n", "c", "i", "j", "left", "right", "shared")
    return whole.groupBy("home", "i", "j").applyInArrow(_spanning(percent), "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, per_salt: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    A centre with more than per_salt pairs and more than one in a thousand of all is dealt out by the other end's hash before
    anything is joined, with a copy of its set per salt; there are fewer than a thousand such centres, so their numbers of
    salts are broadcast.
    """
    total = pairs.count()
    pairs, share = packed(pairs, total), max(per_salt, total // 1000)
    hot = pairs.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > share).select("a", F.ceil(F.col("k") / share).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = pairs.select("a").distinct().join(F.broadcast(hot), "a", "left").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    left = left.join(sets, left["a"] == sets["id"]).select("a", "salt", F.col("shingles").alias("x"))
    right = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    right = right.join(sets, right["b"] == sets["id"]).select("a", "b", "salt", F.col("shingles").alias("y"))
    both = left.join(right, ["a", "salt"]).withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.expr(f"100 * i >= {percent} * (size(x) + size(y) - i)")).select("a", "b")
