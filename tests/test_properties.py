"""Codecs give back what they were given, and no bytes break a parser."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tagloom.sources import audio
from tagloom.sources.parsers import ape, flac, id3, rewrite, vorbis
from tagloom.plans.fixtures import FILES

TEXT = st.text(st.characters(exclude_characters="\0", exclude_categories=("Cs",)), min_size=1, max_size=30)
VALUES = st.lists(TEXT, min_size=1, max_size=3)
FAST = settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])


@FAST
@given(st.dictionaries(st.sampled_from(["TIT2", "TPE1", "TALB", "TCON", "TDRC", "TXXX:a", "TXXX:b c"]), VALUES))
def test_id3(tags):
    items = sorted(tags.items())
    assert sorted(id3.decode(id3.encode(items)).items) == items


@FAST
@given(st.dictionaries(st.text(st.characters(min_codepoint=32, max_codepoint=125, exclude_characters="="), min_size=1, max_size=8).map(str.lower), VALUES, max_size=5))
def test_vorbis(tags):
    assert vorbis.decode(vorbis.encode(sorted(tags.items())))[0].items == sorted(tags.items())
    assert flac.parse(flac.write(FILES["a.flac"][0], sorted(tags.items()))).items == sorted(tags.items())
    for name in ("a.ogg", "a.opus", "a.oga"):
        assert audio.PARSERS[FILES[name][1]](rewrite.ogg_tags(FILES[name][0], sorted(tags.items()))).items == sorted(tags.items())


@FAST
@given(st.dictionaries(st.sampled_from(["Title", "Artist", "Album", "My key"]), VALUES, min_size=1))
def test_ape(tags):
    items = sorted(tags.items())
    assert ape.tag(b"audio" * 9 + ape.encode(items)).items == items


@FAST
@given(st.dictionaries(st.sampled_from(["©nam", "©ART", "desc", "----:com.apple.iTunes:X"]), VALUES))
def test_mp4(tags):
    out = audio.PARSERS["MP4"](rewrite.mp4_tags(FILES["a.m4a"][0], sorted(tags.items())))
    assert out.items == sorted(tags.items()) and out.length_secs == 2.0 and len(out.extra["pictures"]) == 1 and out.extra["chapters"]


@FAST
@given(st.dictionaries(st.sampled_from(["Title", "Author", "WM/Genre", "WM/Year"]), VALUES))
def test_asf(tags):
    out = audio.PARSERS["ASF"](rewrite.asf_tags(FILES["a.wma"][0], sorted(tags.items())))
    assert out.items == sorted(tags.items()) and out.length_secs == 2.0


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(FILES)), st.integers(0, 400), st.binary(max_size=60), st.integers(0, 3000))
def test_damaged_files_are_errors_at_worst(name, at, junk, keep):
    data, fmt, _ = FILES[name]
    row = audio.parse_one(fmt, (data[:at] + junk + data[at + len(junk) :])[: keep or len(data)])
    assert "error" in row or row["stream_info"] is not None


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(sorted(audio.PARSERS)), st.binary(max_size=300))
def test_noise_is_an_error_at_worst(fmt, data):
    audio.parse_one(fmt, data)
