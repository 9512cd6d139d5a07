"""Plans: what is pruned, what is broadcast, and where a shuffle stands."""

from __future__ import annotations

from tagloom.operators import convert, diff
from tagloom.operators import items as I
from tagloom.plans.samples import items
from tagloom.sources import audio

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_is_a_broadcast_and_extraction_one_shuffle(spark):
    text = plan(convert.extract(items(spark, SMALL, "ID3v2")))
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_is_used(spark):
    text = plan(convert.extract(items(spark, SMALL, "ASF")))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int>" in text and "p_retailprice" not in text


def test_key_filters_stand_before_the_shuffle(spark):
    rows = items(spark, SMALL, "ID3v2")
    text = plan(diff.diff(rows, rows, diff.Options(include_keys=("TIT2",))))
    below = text[text.index("Exchange hashpartitioning") :]
    assert "Filter" in below and "TIT2" in below


def test_single_key_lookups_do_not_shuffle(spark):
    rows = items(spark, SMALL, "ID3v2")
    for df in (I.get_first(rows, "TIT2"), I.getall(rows, "TXXX"), I.remove(rows, "TIT2"), convert.to_fields(rows)):
        assert "Exchange hashpartitioning" not in plan(df)


def test_file_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"ID3")
    text = plan(audio.scan(spark, str(tmp_path)).select("path", "length").where("length < 100"))
    assert "content" not in text.split("ReadSchema")[1] and "length" in text
