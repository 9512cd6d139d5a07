"""Text of differences and stream properties, a string per file; made by expressions, so it scales with the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(values: Column | str) -> Column:
    """A list as ["a", "b"], with backslashes, quotes and control characters escaped."""
    c = F.col(values) if isinstance(values, str) else values

    def one(v: Column) -> Column:
        for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            v = F.replace(v, F.lit(raw), F.lit(code))
        return F.concat(F.lit('"'), v, F.lit('"'))

    return F.concat(F.lit("["), F.array_join(F.transform(c, one), ", "), F.lit("]"))


def _lines(rows: DataFrame, shown: list[str]) -> DataFrame:
    mark = F.when(F.col("status") == "changed", "~").when(F.col("status") == "left_only", "-").when(F.col("status") == "right_only", "+").otherwise("=")
    turn = F.when(F.col("status") == "changed", 0).when(F.col("status") == "left_only", 1).when(F.col("status") == "right_only", 2).otherwise(3)
    text = F.when(F.col("status") == "changed", F.concat(quoted("left"), F.lit(" → "), quoted("right"))).otherwise(quoted(F.coalesce("left", "right")))
    return rows.where(F.col("status").isin(shown)).select("file_id", turn.alias("turn"), "key", mark.alias("mark"), text.alias("text"))


def pretty(differences: DataFrame, full: bool = False) -> DataFrame:
    """(file_id, text): a line per field, keys aligned to the right, changed ones first; full adds unchanged ones."""
    shown = ["changed", "left_only", "right_only", *(["unchanged"] if full else [])]
    rows = _lines(differences, shown).groupBy("file_id").agg(F.max(F.octet_length("key")).alias("w"), F.sort_array(F.collect_list(F.struct("turn", "key", "mark", "text"))).alias("x"))
    width = F.col("w")
    line = lambda r: F.concat(r["mark"], F.lit(" "), F.repeat(F.lit(" "), F.greatest(width - F.length(r["key"]), F.lit(0))), r["key"], F.lit(": "), r["text"], F.lit("\n"))
    return rows.select("file_id", F.array_join(F.transform("x", line), "").alias("text"))


def unified(differences: DataFrame) -> DataFrame:
    """(file_id, text) with a two-line head, as of a unified diff; 'No differences' where rows show none."""
    rows = _lines(differences, ["changed", "left_only", "right_only"]).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "mark", "text"))).alias("x"))
    text = F.concat(F.lit("--- left\n+++ right\n"), F.array_join(F.transform("x", lambda r: F.concat(r["mark"], F.lit(" "), r["key"], F.lit(": "), r["text"], F.lit("\n"))), ""))
    all_files = differences.select("file_id").distinct()
    return all_files.join(rows.select("file_id", text.alias("text")), "file_id", "left").select("file_id", F.coalesce("text", F.lit("No differences")).alias("text"))


def stream_text(info: Column | str) -> Column:
    """One line of a stream_info struct: length, bitrate, sample rate, channels and bits, as far as known."""
    c = F.col(info) if isinstance(info, str) else info
    parts = [
        F.when(c["length_secs"].isNotNull(), F.format_string("%.2f seconds", c["length_secs"])),
        F.when(c["bitrate"] > 0, F.format_string("%d kbps", F.floor(c["bitrate"] / 1000))),
        F.when(c["sample_rate"].isNotNull(), F.format_string("%d Hz", c["sample_rate"])),
        F.when(c["channels"].isNotNull(), F.format_string("%d channels", c["channels"])),
        F.when(c["bits_per_sample"].isNotNull(), F.format_string("%d bit", c["bits_per_sample"])),
    ]
    return F.concat_ws(", ", *parts)
