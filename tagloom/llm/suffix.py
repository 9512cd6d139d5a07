"""Removal of later copies of long byte strings, by longest previous factors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom import ship
from tagloom.llm.common import cut, mix, prefix_sums, span_hash, text_chunks, written

_LAST = 2**63 - 1
_MIX = np.uint64(0x9FB21C651E98DF25)
_CODES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def _smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one before (step -1) or after it (step 1) with a smaller value; -1 if there is none.

    All places jump at once: between a place and its candidate no value is smaller, and so it is for the candidate.
    """
    n = len(values)
    if step > 0:
        back = _smaller(values[::-1], -1)[::-1]
        return np.where(back < 0, -1, n - 1 - back)
    to = np.arange(n, dtype=np.int64) - 1
    active = np.arange(1, n)
    while len(active):
        active = active[values[to[active]] >= values[active]]
        to[active] = to[to[active]]
        active = active[to[active] >= 0]
    return to


def _ranks(data: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The 8 bytes at each place as a number, and the ranks of the strings of 8, 16 ... width bytes there; past the end stand 0s."""
    padded = np.zeros(len(data) + width, np.uint64)
    padded[: len(data)] = data
    key = padded[: len(data)]
    for shift, by in ((8, 1), (16, 2), (32, 4)):
        longer = np.zeros(len(data), np.uint64)
        longer[: max(0, len(data) - by)] = key[by:]
        key = (key << np.uint64(shift)) | longer
    ranks, size = [np.unique(key, return_inverse=True)[1].astype(np.int64)], 8
    while size < width:
        after = np.full(len(data), -1, np.int64)
        after[: max(0, len(data) - size)] = ranks[-1][size:]
        ranks.append(np.unique(ranks[-1] * (len(data) + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return key, ranks


def longest_previous(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """For each start the length of the longest string there that also begins at a start with a smaller place.

    Starts are put in suffix order, by twice the largest power of two within length; each must have length bytes before
    its end. The candidates are the nearest ones before and after it in that order that have a smaller place. Lengths are
    measured up to the ends and below that many bytes; equal places are not earlier than each other.
    """
    width = 8
    while width * 2 <= length:
        width *= 2
    key, ranks = _ranks(data, width)
    order = np.lexsort((places, np.append(ranks[-1], -1)[starts + width], ranks[-1][starts]))
    at, room, place = starts[order], (ends - starts)[order], places[order]
    most = np.zeros(len(order), np.int64)
    for step in (-1, 1):
        to = _smaller(place, step)
        mine = np.flatnonzero(to >= 0)
        i, j, same = at[mine], at[to[mine]], np.zeros(len(mine), np.int64)
        limit = np.minimum(room[mine], room[to[mine]])
        size = width
        while size:  # the common prefix, by halves
            x, y = np.minimum(i + same, len(data) - 1), np.minimum(j + same, len(data) - 1)
            if size >= 8:
                rank = ranks[size.bit_length() - 4]
                alike = rank[x] == rank[y]
            else:
                alike = (key[x] ^ key[y]) >> np.uint64(64 - 8 * size) == 0
            same += size * (alike & (same < limit))
            size //= 2
        most[mine] = np.maximum(most[mine], np.minimum(same, limit))
    out = np.empty(len(order), np.int64)
    out[order] = most
    return out


def anchors(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, key, context, lo, span) of each anchor: strings of length bytes that start at lo..lo+span share a least gram.

    A string's least gram (by hash, the first of equals) depends on its bytes only, so equal strings have equal keys.
    context hashes all bytes of these strings and the gram's place among them.
    """
    none = np.zeros(0, np.int64)
    if len(codes) < length or not (np.diff(offsets) >= length).any():
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    hashes, size = _CODES[codes], 1
    while size < gram:
        hashes = (hashes[:-size] ^ (hashes[:-size] >> np.uint64(29))) * _MIX + hashes[size:]
        size *= 2
    hashes = hashes ^ (hashes >> np.uint64(32))
    low = np.uint64((1 << max(1, len(hashes).bit_length())) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size, want = 1, length - gram + 1
    while size < want:
        by = min(size, want - size)
        least = np.minimum(least[:-by], least[by:])
        size += by
    valid = np.zeros(len(least) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    gram_at = (least[at] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (gram_at[1:] != gram_at[:-1]) | (at[1:] != at[:-1] + 1))))
    lo, hi, g = at[new], at[np.append(new[1:], len(at)) - 1], gram_at[new]
    row = np.searchsorted(offsets, lo, "right") - 1
    context = mix(span_hash(prefix_sums(codes), lo, hi + length) + mix(((g - lo) << 20 | (hi - lo)).astype(np.uint64)))
    return row, hashes[g], context, lo - offsets[row], hi - lo


_ANCHORS = "key bigint, context bigint, id bigint, th bigint, lo int, span int, done boolean"


def _runs(docs: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (index of the first, start, end), those of a document that touch joined; docs, numbers of documents, and starts are sorted."""
    base = docs * (int(end.max()) + 2)
    far = np.maximum.accumulate(base + end)
    first = np.flatnonzero(np.concatenate(([True], (base + lo)[1:] > far[:-1])))
    last = np.append(first[1:], len(docs)) - 1
    return first, lo[first], (far - base)[last]


def _documents(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the documents (id, hash of the text) of sorted rows."""
    return np.cumsum(np.concatenate(([0], ((ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])).astype(np.int64))))


def _anchored(length: int, gram: int, most: int = 250_000):
    schema = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("span", pa.int32()), ("done", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, context, ids, th, lo, span = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((lo, th, ids, context, key))
            key, context, ids, th, lo, span = (x[order] for x in (key, context, ids, th, lo, span))
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])))
            head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            later = (ids != ids[head]) | (th != th[head]) | (lo != lo[head])  # a row that repeats has the same places
            for k in range(0, len(f := np.flatnonzero(first)), 50_000):
                s = f[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(context[s].view(np.int64)), pa.array(ids[s]), pa.array(th[s]), pa.array(lo[s].astype(np.int32)), pa.array(span[s].astype(np.int32)), pa.array(np.zeros(len(s), bool))], schema=schema)
            if later.any():
                i, h, a, b = ids[later], th[later], lo[later], (lo + span + length)[later]
                order = np.lexsort((a, h, i))
                i, h = i[order], h[order]
                at, a, b = _runs(_documents(i, h), a[order], b[order])
                i, h = i[at], h[at]
                key = mix(i.view(np.uint64) * np.uint64(31) + h.view(np.uint64) + a.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a.astype(np.int64)), pa.array(i), pa.array(h), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(np.ones(len(i), bool))], schema=schema)

        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, _, codes, offsets in text_chunks(batch.column(2), 1 << 18):
                row, key, context, lo, span = anchors(codes, offsets, length, gram)
                if len(row):
                    held.append((key, context, ids[first + row], hashes[first + row], lo, span))
            if sum(len(x[0]) for x in held) >= most:
                yield from flush()
        yield from flush()

    return run


_SEGMENTS = "key bigint, id bigint, th bigint, lo int, part binary, span int"


def _segments(length: int):
    """Bytes of the strings that are still open; strings of a key with very many contexts go one by one, under their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("part", pa.binary()), ("span", pa.int32())])
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            seen: dict[bytes, tuple[int, int, int]] = {}
            rows: list[tuple] = []
            for i, h, text, todo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for x in todo.as_py():
                    key, lo, span, crowded = x["key"], x["lo"], x["span"], x["crowded"]
                    if not crowded:
                        rows.append((key, i, h, lo, data[lo : lo + span + length], span))
                        continue
                    for s in range(lo, lo + span + 1):
                        part = data[s : s + length]
                        was = seen.get(part)
                        if was is None or (i, h, s) < was:
                            if was is not None:
                                rows.append((0, *was, None, 0))
                            seen[part] = (i, h, s)
                        elif (i, h, s) > was:
                            rows.append((0, i, h, s, None, 0))
            for part, was in seen.items():
                rows.append((int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), *was, part, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _factors(length: int, block: int = 1 << 20):
    """Per block of whole keys: suffix order, longest previous factors, and the ranges of those that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("end", pa.int32())])
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts = [x[4] for x in held]
            data = np.frombuffer(b"".join(parts), np.uint8)
            base = np.cumsum([0, *map(len, parts)])
            span = np.array([x[5] for x in held])
            seg = np.repeat(np.arange(len(held)), span + 1)
            step = np.arange(len(seg)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
            ids, th = (np.array([x[k] for x in held], np.int64)[seg] for k in (1, 2))
            lo = np.array([x[3] for x in held], np.int64)[seg] + step
            order = np.lexsort((lo, th, ids))
            ids, th, lo = ids[order], th[order], lo[order]
            doc, place = _documents(ids, th), np.empty(len(seg), np.int64)
            place[order] = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]))))
            factor = longest_previous(data, base[seg] + step, base[seg + 1], place, length)[order]
            found = factor >= length
            if found.any():
                at, a, b = _runs(doc[found], lo[found], (lo + factor)[found])
                yield pa.RecordBatch.from_arrays([pa.array(ids[found][at]), pa.array(th[found][at]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], schema=schema)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # ids and short strings
                if size >= block and row[0] != held[-1][0]:
                    yield from flush()
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from flush()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
        out = []
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans: list[list[int]] = []
            for a, b in sorted((x >> 32, x & 0xFFFFFFFF) for x in ranges.as_py() or []):
                b = min(b, len(data))
                if a >= b:
                    continue
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            at, left, gone = 0, hashlib.sha256(), 0
            for a, b in spans:
                left.update(data[at:a])
                at, gone = b, gone + b - a
            left.update(data[at:])
            out.append((len(data), gone, [{"a": a, "b": b} for a, b in spans], left.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), spans_type, pa.string()), strict=True))], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, crowd: int = 2000, sampled: int = 64, frequent: int = 32) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) of each row: spans are the byte ranges to remove.

    A byte goes if it is in a string of length bytes that also starts earlier (smaller id, or same id and earlier
    start) anywhere in the table. Strings meet at their least gram of gram bytes; of the same bytes around one, only
    the first place stays open (within each task before the shuffle, then over all). What is left open at a shared
    gram differs somewhere: those bytes are put in suffix order, previous and next smaller places give each start's
    longest previous factor, and one of at least length bytes goes. A gram with over crowd rows is dealt out by whole
    strings instead, so no task gets it alone; so is a gram that over frequent and over one in a thousand anchors of
    every sampled-th document have, whose rows are also dealt out before they are first ordered. That sample only
    chooses a way for the rows: both give the same result.

    Null text is empty; null ids come after all others and are null in the result. Rows that share an id are documents
    of their own, ordered by the hash of their texts, but rows of equal id and text are one document and get the same
    result. Texts of any length are read whole, in memory of one text. Other columns are not read. Needs length >=
    gram, gram a power of two, at least 8.
    """
    if gram < 8 or gram & (gram - 1) or length < gram:
        raise ValueError("gram must be a power of two from 8 to length")
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id"), F.col(id_col).isNull().alias("nameless"), F.col(text_col).cast("string").alias("text"))
    text = text.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text", "nameless")
    some = text.select("id", "th", "text").where(F.pmod("th", F.lit(sampled)) == 0).mapInArrow(_anchored(length, gram), _ANCHORS).where("not done")
    some = cut(some.groupBy("key").agg(F.count("*").alias("n")))
    hot = some.where(F.col("n") > max(frequent, (some.agg(F.sum("n")).first()[0] or 0) // 1000)).select("key", F.lit(True).alias("hot"))  # fewer than 1,000
    rows = text.select("id", "th", "text").mapInArrow(_anchored(length, gram), _ANCHORS).join(F.broadcast(hot), "key", "left")
    hot = F.col("hot").isNotNull()
    rows = rows.withColumn("salt", F.when(hot, F.pmod("context", F.lit(256))).otherwise(0).cast("int"))
    by_key = Window.partitionBy("key", "salt").orderBy("context").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_both = Window.partitionBy("key", "salt", "context").orderBy("id", "th", "lo").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("least", F.min("context").over(by_key)).withColumn("most", F.max("context").over(by_key)).withColumn("many", F.count("*").over(by_key))
    rows = rows.withColumn("first", F.min(F.struct("id", "th", "lo")).over(by_both))
    later = F.struct("id", "th", "lo") > F.col("first")
    rows = rows.withColumn("span", F.when(~F.col("done") & later, F.col("span") + length).otherwise(F.col("span")))
    rows = rows.withColumn("done", F.col("done") | later).where(F.col("done") | hot | F.expr("least < most"))
    rows = written(rows.select("key", "id", "th", "lo", "span", "done", (hot | (F.col("many") > crowd)).alias("crowded")), "factors")
    todo = rows.where("not done").groupBy("id", "th").agg(F.collect_list(F.struct("key", "lo", "span", "crowded")).alias("todo"))
    # All columns of text, so that both joins with it share one exchange.
    parts = text.join(todo, ["id", "th"]).select("id", "th", "text", "todo", "nameless").mapInArrow(_segments(length), _SEGMENTS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("key", F.when(F.col("part").isNull(), F.xxhash64("id", "th", "lo")).otherwise(F.col("key")))
    parts = parts.repartition(n, "key").sortWithinPartitions("key")
    found = parts.where("part is not null").mapInArrow(_factors(length), "id bigint, th bigint, lo int, end int")
    alone = parts.where("part is null").select("id", "th", "lo", (F.col("lo") + length).alias("end"))
    known = rows.where("done").select("id", "th", "lo", (F.col("lo") + F.col("span")).alias("end"))
    ranges = known.unionAll(found).unionAll(alone).select("id", "th", (F.shiftleft(F.col("lo").cast("bigint"), 32) + F.col("end")).alias("r")).groupBy("id", "th").agg(F.collect_list("r").alias("ranges"))
    out = text.join(ranges, ["id", "th"], "left").select(F.when(~F.col("nameless"), F.col("id")).alias("id"), "text", "ranges").mapInArrow(_kept, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<a:bigint,b:bigint>>, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
