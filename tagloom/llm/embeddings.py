"""Near-duplicate vectors by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import ship
from tagloom.llm.common import components, cut, hot_join


def calibrate(cosine: float, projections: int = 32, sigmas: float = 2.2, miss: float = 1e-7) -> tuple[float, int]:
    """Window half-width and least count of collisions: a pair just as similar as asked for has fewer with probability miss at most.

    A Gaussian projection of the difference of two unit vectors at distance d is normal with deviation d, whatever the data.
    """
    width = sigmas * math.sqrt(2 - 2 * cosine)
    p, below, count = math.erf(sigmas / math.sqrt(2)), 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            break
        count += 1
    return width, count


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column(2):
            x = None
            if v.is_valid and not v.values.null_count:
                a = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                x = a.tobytes() if len(a) and np.isfinite(a).all() and a.any() else None
            out.append(x)
        vector = pa.array(out, pa.binary())
        size = pa.array([None if x is None else len(x) // 8 for x in out], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(vector), batch.column(1), None), size, vector], names=["id", "label", "dim", "vector"])


def _units(table: pa.Table) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tiles(cosine: float, projections: int, block: int = 256):
    width, least = calibrate(cosine, projections)

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        unit, ids, size = _units(table), table.column("node").to_numpy(), table.column("size").to_numpy()
        p = unit @ np.random.default_rng(17).standard_normal((unit.shape[1], projections))
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        pairs = []
        if len(left) and len(right):
            order = np.argsort(p[right], axis=0, kind="stable")
            ranks = np.empty((projections, len(right)), np.int32)
            lo, span = np.empty((projections, len(left)), np.int32), np.empty((projections, len(left)), np.int32)
            for k in range(projections):
                ranks[k, order[:, k]] = np.arange(len(right))
                line = p[right, k][order[:, k]]
                lo[k] = np.searchsorted(line, p[left, k] - width, "left")
                span[k] = np.searchsorted(line, p[left, k] + width, "right") - lo[k]
            kind = np.uint16 if len(right) < 2**15 else np.uint32
            ranks, lo, span = ranks.astype(kind), lo.astype(kind), span.astype(kind)
            for q in range(0, len(left), block):
                count = np.zeros((len(left[q : q + block]), len(right)), np.uint8)
                for k in range(projections):
                    count += (ranks[k][None, :] - lo[k, q : q + block, None]) < span[k, q : q + block, None]
                a, b = np.nonzero(count >= least)
                a, b = left[q + a], right[b]
                if i == j:
                    a, b = a[a < b], b[a < b]
                for s in range(0, len(a), 1 << 16):
                    x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                    good = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    pairs.append((x[good], y[good]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        root = ids.copy()
        while len(a):  # the least id of each component of this tile's links
            was = root.copy()
            np.minimum.at(root, a, was[b])
            np.minimum.at(root, b, was[a])
            if (root == was).all():
                break
        some = np.flatnonzero(links)
        return pa.table({"node": ids[some], "links": links[some], "root": root[some]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, projections: int = 32, tile_rows: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept) per row: pairs of one label with a cosine, in doubles, of at least the given one.

    Equal vectors of a label are one class with a size, so copies never meet. A label's classes are dealt to hash tiles
    of about tile_rows; each pair of tiles is a task of bounded size that sorts the projections of one tile and counts,
    for every vector of the other, the windows around it that hold each vector. Pairs that pass the count calibrated
    by calibrate() are verified. A tile pair returns counts and least nodes by row, never pairs. The work in a label
    grows with the square of its distinct vectors; there is no cap on them. Single windows can't bound it: at 0.93 one
    holds 44 % of all unrelated vectors, so emitting collisions instead of counting them would be far more work.

    Null, empty or zero vectors, those with null or non-finite components and rows of null label link with nothing.
    Vectors of different length don't link. Links are between vectors, not ids: rows that repeat an id are vectors of
    their own, each with its own links, and so are rows of null id; these have no component (null) and are kept. A
    component that has null ids only is null for all. Other columns, whatever their names, are not read.
    """
    ship(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    key = F.when(F.expr("label is not null and vector is not null"), F.sha2(F.concat(F.concat_ws("/", "label", "dim").cast("binary"), F.lit("/").cast("binary"), "vector"), 256))
    base = cut(base.mapInArrow(_packed, "id bigint, label bigint, dim int, vector binary").withColumn("mark", key))
    able = base.where("mark is not null")
    classes = able.groupBy("mark").agg(F.min("label").alias("label"), F.min("dim").alias("dim"), F.min("id").alias("rep"), F.count("*").alias("size"), F.min("vector").alias("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by the cut
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"), F.count("*").alias("n")).withColumn("part", F.struct("label", "dim"))
    total = classes.count()
    dealt = hot_join(classes.withColumn("part", F.struct("label", "dim")), counts.select("part", "tiles", "n"), "part", "n", total)
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("mark"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).select("label", "dim", "i", "j", "tile", "node", "size", "vector")
    met = cut(dealt.groupBy("label", "dim", "i", "j").applyInArrow(_tiles(cosine, projections), "node bigint, links bigint, root bigint"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(met.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("c"))
    of = classes.select("node", "mark", "rep", "size").join(links, "node", "left").join(label, "node", "left")
    of = cut(of.select("mark", "size", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("c", "node").alias("c")))
    first = of.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    of = hot_join(of, first, "c", "k", total).select("mark", "size", "n_links", "component_id")
    linked = hot_join(able.select("id", "mark"), of, "mark", "size", base.count()).select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = base.where("mark is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
