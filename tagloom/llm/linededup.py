"""Removal of later copies of repeated runs of lines, by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import cut, hot_join


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, th, runs): the line ranges [a, b] to remove from each document, th being the text's hash.

    Lines are parted by U+000A, trimmed of spaces, and those without words don't count. At each line a window holds
    the shortest run of lines, forwards and likewise backwards, with min_words words. The place of a window's least
    line hash is a fingerprint: two places with the same min_words words have windows of the same lines, and so
    fingerprints of the same hash. Fingerprints are joined by hash, and only windows whose fingerprint stands in another
    place too go on. Those reach from a line ahead and back as far as a match must at least go, and are compared by the
    hash of all their lines: one that also occurs in an earlier place (smaller id, text hash, line) goes. Every run of
    min_words words around a line contains such a window with that line, so exactly the lines of later copies go.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and id is not null")
    rows = rows.withColumn("th", F.xxhash64("text"))
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("line", F.trim("line"))
    lines = lines.select("id", "th", "p", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(r"[^ \x09-\x0D]+")).cast("bigint").alias("w")).where("w > 0")
    lines = lines.repartition("id")  # hashes only; all that follows per document needs no other exchange
    lines = lines.groupBy("id", "th", "p").agg(F.first("h").alias("h"), F.first("w").alias("w"))  # a row that repeats is one document
    doc = Window.partitionBy("id", "th")
    lines = lines.withColumn("upto", F.sum("w").over(doc.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("w"))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    least = lambda w: F.min(F.struct("h", "p")).over(w)
    cols = [F.struct(least(w).alias("m"), F.xxhash64(F.collect_list("h").over(w)).alias("run"), F.min("p").over(w).alias("a"), F.max("p").over(w).alias("b"), F.sum("w").over(w).alias("words")) for w in (ahead, back)]
    seen = lines.select("id", "th", cols[0].alias("fore"), cols[1].alias("aft")).select("id", "th", F.explode(F.array_distinct(F.array("fore", "aft"))).alias("x")).where(F.col("x.words") >= min_words)
    seen = seen.select("id", "th", F.col("x.m.h").alias("mark"), F.col("x.m.p").alias("at"), "x.run", "x.a", "x.b")
    prints = cut(seen.select("mark", "id", "th", "at").distinct())  # a window's neighbours mostly have its fingerprint
    places = prints.groupBy("mark").agg(F.count("*").alias("k")).where("k > 1")
    twice = hot_join(prints, places, "mark", "k", prints.count()).select("id", "th", "at")
    seen = seen.join(twice, ["id", "th", "at"], "left_semi")
    seen = cut(seen.select("id", "th", "a", "b", F.struct(F.col("mark").bitwiseAND(0x7FFFFFFF).cast("int").alias("mark"), "run").alias("key")))
    first = seen.groupBy("key").agg(F.min(F.struct("id", "th", "a")).alias("first"), F.max(F.struct("id", "th", "a")).alias("last"), F.count("*").alias("k")).where("first < last").select("key", "first", "k")
    later = hot_join(seen, first, "key", "k", seen.count()).where(F.struct("id", "th", "a") > F.col("first")).select("id", "th", "a", "b")
    far = F.max("b").over(doc.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("a") > F.coalesce(far, F.lit(-2)) + 1, 1).otherwise(0)).withColumn("g", F.sum("new").over(doc.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "th", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """All rows and columns of docs, the text without later copies of line runs, and __lines and __removed (counts).

    Null text and rows of null id pass as they are (0 lines removed). Lines without words between two lines that go
    go with them. Rows that repeat (same id and text) are one document and get the same result; rows of one id with
    other texts are ordered by text hash. Ties don't occur otherwise: an id and a line fix a place. Columns of docs whose
    names begin with two underscores and clash with those used here are replaced.
    """
    docs = docs.drop("__key", "__hash", "__id", "__th", "__runs", "__kept", "__lines", "__removed")
    runs = removed_runs(docs, id_col, text_col, min_words)
    runs = runs.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    left = docs.withColumn("__key", F.col(id_col).cast("bigint")).withColumn("__hash", F.xxhash64(F.col(text_col).cast("string")))
    both = left.join(runs, (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    lines = F.split(F.col(text_col), "\n")
    keep = F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: (r["a"] <= i) & (i <= r["b"])))
    # Generated, so that later filters on it don't have the lines cut again.
    found = F.struct(F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.when(F.col("__runs").isNotNull(), keep).alias("kept"))
    out = both.withColumn("__kept", F.explode(F.array(found))).withColumn("__lines", F.col("__kept.n"))
    out = out.withColumn("__removed", F.when(F.col("__kept.kept").isNotNull(), F.col("__lines") - F.size("__kept.kept")).otherwise(0))
    out = out.withColumn(text_col, F.when(F.col("__kept.kept").isNotNull(), F.array_join("__kept.kept", "\n")).otherwise(F.col(text_col)))
    return out.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns], "__lines", "__removed")
