"""Benchmark passages in documents: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import ship
from tagloom.llm.common import cut, mix, prefix_sums, salted_join, span_hash, text_chunks, without


def normal(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join((text or "").lower().split())


#: Letters of scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han and the like.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def _in_word(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LNM" and not _UNSPACED.match(ch)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] cuts no word at either end; scripts without spaces have no such cuts."""
    return all(not (0 < at < len(text) and _in_word(text[at - 1]) and _in_word(text[at])) for at in (start, end))


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 consecutive pieces of nearly equal length with their starts; budget edits leave one of them whole."""
    n, k = len(text), budget + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(a, text[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance between pattern and any substring of text, and that substring's end, if within budget."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = whole, 0, m, budget + 1, 0
    for j, ch in enumerate(text, 1):
        eq = masks.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(diagonal | up) & whole
        fall = up & diagonal
        score += bool(rise & top) - bool(fall & top)
        if score < best:
            best, end = score, j
            if not best:
                break
        rise, fall = rise << 1 & whole, fall << 1 & whole
        vertical = eq | down
        up = fall | ~(vertical | rise) & whole
        down = rise & vertical
    return (best, end) if best <= budget else None


#: Bytes at a piece's start by which places are looked up first; shorter pieces are looked up whole.
_HEAD = 11
_PIECES = "hash bigint, head bigint, n_head int, size int, offset int, item bigint"
_FOUND = "row string, hits array<struct<hash:bigint,at:int>>"


def _heads(hashes: np.ndarray, size: int) -> np.ndarray:
    return mix(hashes + np.uint64(0x9E3779B97F4A7C15 * size % 2**64))


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: the hash of its bytes and of its first ones, their sizes, where it starts, and the item's number."""
    for batch in batches:
        rows = []
        for item, pattern, budget in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for offset, piece in pieces(pattern, budget):
                codes = np.frombuffer(piece.encode(), np.uint8)
                sums, n = prefix_sums(codes), min(len(codes), _HEAD)
                head, whole = (_heads(span_hash(sums, np.array([0]), np.array([k])), k).view(np.int64)[0] for k in (n, len(codes)))
                rows.append((mix(np.array([whole], np.int64).view(np.uint64)).view(np.int64)[0], head, n, len(codes), offset, item))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["hash", "head", "n_head", "size", "offset", "item"])


def _pieces_met(shared, heads: list[int], sizes: list[int]):
    """Documents with the hashes and places, in their normal form, of what the filter takes for pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        low = np.uint64(len(words) * 64 - 1)
        schema = pa.schema([("row", pa.string()), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))])

        def there(h: np.ndarray) -> np.ndarray:
            slot = h & low
            return (words[(slot >> np.uint64(6)).view(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            column = pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())
            for lo, hi, codes, offsets in text_chunks(column):
                sums, found = prefix_sums(codes), []
                for n in heads:
                    if len(codes) < n:
                        continue
                    at = np.arange(len(codes) - n + 1)
                    at = at[there(_heads(span_hash(sums, at, at + n), n))]
                    for size in sizes if n == _HEAD else [n]:
                        if size >= n:
                            own = at[at + size <= len(codes)]
                            h = mix(_heads(span_hash(sums, own, own + size), size))
                            good = there(h)
                            row = np.searchsorted(offsets, own, "right") - 1
                            good &= own + size <= offsets[row + 1]
                            found.append((row[good], own[good], h[good].view(np.int64)))
                row, at, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                if not len(row):
                    continue
                order = np.lexsort((at, row))
                row, at, h = row[order], at[order], h[order]
                chars = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
                at = chars[at] - chars[offsets[row]]
                some, first = np.unique(row, return_index=True)
                ends = np.append(first, len(row)).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h), pa.array(at.astype(np.int32))], names=["hash", "at"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + some)), hits], schema=schema)

    return run


def locate(text: str, pattern: str, budget: int, exact: bool, starts: list[int]) -> tuple[int, int] | None:
    """(distance, end) of the best place of a pattern in a normal text, given where it may start; None beyond its budget."""
    best = None
    if exact:
        ends = [s + len(pattern) for s in starts if text.startswith(pattern, s) and whole_words(text, s, s + len(pattern))]
        return (0, min(ends)) if ends else None
    spans: list[list[int]] = []
    for s in sorted(starts):  # windows that overlap are read once
        lo, hi = max(0, s - budget), s + len(pattern) + budget
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        got = myers(pattern, text[lo:hi], budget)
        if got and (best is None or (got[0], lo + got[1]) < best):
            best = (got[0], lo + got[1])
    return best


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    for batch in batches:
        out = []
        for i, h, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            text = normal(text.as_py())
            for x in wanted.as_py():
                got = locate(text, x["pattern"], x["budget"], x["exact"], x["starts"])
                if got:
                    out.append((i, h, x["item_id"], *got))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "th", "item_id", "distance", "end"])


def _normal_items(rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            exact = [len(t) < min_chars for t in texts]
            budget = [0 if e else int(len(t) * rate) for t, e in zip(texts, exact, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(budget, pa.int32()), pa.array(exact, pa.bool_())], names=["item_id", "pattern", "budget", "exact"])
            yield out.filter(pa.array([bool(t) for t in texts], pa.bool_()))

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text", error_rate: float = 0.06, min_chars: int = 32, filter_bits: int = 1 << 27) -> DataFrame:
    """find_leaks() with the documents' text hashes, th."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    items = items.mapInArrow(_normal_items(error_rate, min_chars), "item_id bigint, pattern string, budget int, exact boolean").distinct()
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))  # fixed by the cut
    parts = cut(items.select("item", "pattern", "budget").mapInArrow(_cut_items, _PIECES))
    kinds = parts.groupBy("n_head", "size").agg(F.count("*").alias("n")).collect()  # sizes of pieces: under 4 * 32 of them
    bits = 1 << 16
    while bits < min(filter_bits, 128 * sum(r["n"] for r in kinds)):
        bits *= 2
    marks = parts.select(F.explode(F.array("head", "hash")).alias("slot")).withColumn("slot", F.col("slot").bitwiseAND(bits - 1)).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # filter_bits bounds it
    words = np.zeros(bits // 64, np.uint64)
    words[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).view(np.uint64)
    met = _pieces_met(spark.sparkContext.broadcast(words), sorted({r["n_head"] for r in kinds}), sorted({r["size"] for r in kinds}))
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))
    text = text.withColumn("row", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), "th"))  # rows of one id and text have the same hits
    hits = text.select("row", "text").mapInArrow(met, _FOUND).select("row", F.explode("hits").alias("x")).select("row", "x.hash", "x.at")
    hits = cut(hits)
    share = max(1000, hits.count() // 1000)
    may = salted_join(hits, parts.select("hash", "offset", "item"), "hash", "row", share)
    may = cut(may.groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("offset")).alias("starts")))
    may = salted_join(may, items, "item", "row", max(1000, may.count() // 1000))
    may = may.groupBy("row").agg(F.collect_list(F.struct("item_id", "pattern", "budget", "exact", "starts")).alias("wanted"))
    return text.join(may, "row").select("id", "th", "text", "wanted").mapInArrow(_verified, "id bigint, th bigint, item_id bigint, distance int, end bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = 0.06, min_chars: int = 32, filter_bits: int = 1 << 27) -> DataFrame:
    """A row (id, item_id, distance, end) for each benchmark item found in a document within error_rate times its length.

    Texts are compared in lower case with white space runs as one space; distance is the least edit distance to any
    part of the document and end is where that part ends in the normal text. Items shorter than min_chars are found
    where they stand exactly and as whole words (distance 0; scripts without spaces have no word ends to keep). Blank
    items find nothing. One pass over the documents keeps the places at which a filter of the pieces' hashes, of 128 bits a
    piece and filter_bits (16 MB) at most whatever the benchmark's size, finds any; their hits are joined with the
    pieces by hash, a hash of many hits being dealt out, and documents with candidates are read again and verified
    in their whole texts. A filter
    that is too small lets more documents through and changes no result.

    Null or empty texts find nothing, and texts of any length are searched whole. A repeated document row is reported
    once per row; a repeated item once per id and text; null ids stay null. Other columns are not read.
    """
    out = _leaks(docs, benchmark, id_col, text_col, item_col, item_text, error_rate, min_chars, filter_bits)
    return out.drop("th").withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which find_leaks() finds no item, with all their columns; rows that share an id, or have none, go by their own texts."""
    return without(docs, _leaks(docs, benchmark, id_col, text_col, **options), id_col, text_col)
