"""The training-data operators against brute force, on the small tables and on edge cases."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat, common, decontaminate, embeddings, html, licenses, linededup, minhash, mixing, quality, queries, suffix

SMALL = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `text.x` string"
EDGES = [
    (1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (3, "one", "en", "s", 3, None), (4, "one", "en", "s", 3, None), (4, "one", "en", "s", 3, None),
    (5, "A b c d e f g h i j " * 40, "en", None, 1, "x"), (6, "a B c d e f g h i j " * 40, "en", "t", 1, "x"), (7, "word " * 30_000, "en", "t", 1, "x"), (8, "\n\n \n", "en", "t", 4, "x"), (None, "no id here", "en", "t", 1, "x"), (9, "été ßÄ  x" * 50, "fr", "t", 1, "x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def linked(sets, percent):
    """(id -> least id reachable) by comparing all pairs that share a shingle."""
    at, up = defaultdict(list), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in at[s]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for s in sets[i]:
            at[s].append(i)
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_minhash_against_all_pairs(spark, words, percent):
    docs = small(spark, "documents")
    sets = {r.doc_id: shingles(r.text, words) for r in docs.collect()}
    want = linked(sets, percent)
    for r in rows(minhash.near_duplicates(docs, words=words, percent=percent)):
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_minhash_finds_chains_and_hubs(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts, now = [], base
    for k in range(60):
        now = list(now)
        now[(k * 7) % 120] = f"x{k}"
        texts.append(" ".join(now))
    texts += [" ".join(base)] * 30 + [f"only {i} of its kind" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = linked({i: shingles(t, 3) for i, t in enumerate(texts)}, 85)
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(docs, words=3, percent=85, per_salt=3))} == want


def brute_components(edges):
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            i, j = sorted((top(a), top(b)))
            up[j] = i
    return {x: top(x) for x in up}


def test_components(spark):
    rng = random.Random(9)
    path = rng.sample(range(10_000, 10_300), 300)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k + 1000, k + 1001) for k in range(40)] + [(5000 - k, 2000 + k) for k in range(5)]
    edges += list(zip(path[:-1], path[1:], strict=True)) + [(30_000, 20_000 + k) for k in range(3000)] + [(40_000, 50_000 + k) for k in range(3000)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute_components(edges)
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_component_rounds_grow_with_the_logarithm(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or df.checkpoint())
    rng = random.Random(2)
    for n, most in ((100, 9), (6400, 14)):
        path, before = rng.sample(range(n), n), len(cuts)
        links = spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "a bigint, b bigint")
        assert {r.component for r in common.components(links).collect()} == {0}
        assert (len(cuts) - before) / 2 < most


def test_components_of_links_in_many_tasks(spark, monkeypatch):
    rng, cuts = random.Random(4), []
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or df.checkpoint())
    path = rng.sample(range(3000), 3000)
    edges = list(zip(path[:-1], path[1:], strict=True)) + [(5000 + rng.randrange(900), 5000 + rng.randrange(900)) for _ in range(700)]
    edges += [(30_000, 20_000 + k) for k in range(1500)] + [(40_000, 50_000 + k) for k in range(1500)]
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.component for r in common.components(links, per_task=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_components(edges) and 4 < len(cuts) < 3 * 14


def tasks_of(spark, run):
    """Tasks of all that run() has Spark do."""
    context, group = spark.sparkContext, f"tasks-{random.random()}"
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_few_links_take_few_tasks(spark):
    rng = random.Random(6)
    path = rng.sample(range(1000), 1000)
    links = spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "a bigint, b bigint")
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert tasks_of(spark, lambda: common.components(links)) < 6 * 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_are_dropped_alike_by_broadcast_and_by_shuffle(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "a", "z"), (None, "c", None), (2, None, "w")], "doc_id bigint, text string, `o.th` string")
    gone = spark.createDataFrame([(1, "a"), (None, "c")], "id bigint, text string").select("id", F.xxhash64("text").alias("th"))
    for most in (500_000, 0):
        left = common.without(docs, gone, "doc_id", "text", most)
        assert left.columns == docs.columns and {(r[0], r[1]) for r in left.collect()} == {(1, "b"), (None, "a"), (2, None)}
        left = common.without_ids(docs, spark.createDataFrame([(1,)], "doc_id bigint"), "doc_id", most)
        assert left.columns == docs.columns and {(r[0], r[1]) for r in left.collect()} == {(None, "a"), (None, "c"), (2, None)}


def test_own_scratch_is_removed(spark, tmp_path):
    import os

    with common.own_scratch(spark) as folder:
        common.cut(spark.range(5).toDF("x")).write.parquet(str(tmp_path / "out"))
        common.written(spark.range(5).toDF("x"), "t")
        assert os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and spark.read.parquet(str(tmp_path / "out")).count() == 5


def boilerplate(n, seed=1):
    """Texts of 120 words that all share and 60 of their own: none is a copy of another."""
    rng = random.Random(seed)
    shared = [f"s{k}" for k in range(120)]
    return [" ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(n)]


def test_minhash_compares_nothing_in_shared_boilerplate(spark, monkeypatch):
    sizes, across = [], minhash._across

    def counted(apart, *rest):
        sizes.append(apart.count())
        return across(apart, *rest)

    monkeypatch.setattr(minhash, "_across", counted)
    monkeypatch.setattr(minhash, "_spanning", lambda percent: lambda table: 1 / 0)  # no tile may be run
    docs = spark.createDataFrame(list(enumerate(boilerplate(600))), "doc_id bigint, text string")
    out = minhash.near_duplicates(docs, words=3, percent=85)
    assert out.where("kept").count() == 600 and sizes[0] > 300  # most share a bucket with another


def test_minhash_finds_links_that_centres_miss(spark):
    rng = random.Random(8)
    texts = boilerplate(200)
    for k in range(100):  # copies of documents that are no bucket's centre, with one word replaced
        words = texts[100 + k].split()
        words[130 + rng.randrange(40)] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = linked({i: shingles(t, 3) for i, t in enumerate(texts)}, 85)
    assert sum(want[i] != i for i in want) == 100
    for tile in (1500, 2):
        assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(docs, words=3, percent=85, tile_rows=tile))} == want


@pytest.mark.parametrize(("percent", "words"), [(85, 3), (80, 5)])
def test_minhash_recall_at_the_threshold(spark, percent, words):
    """Pairs just as similar as asked for, or a little more."""
    rng, texts = random.Random(percent), []
    for k in range(300):
        n = 300
        own = [f"{k}w{j}" for j in range(n)]
        change = int(n * (1 - percent / 100) / (1 + percent / 100)) - words
        texts += [" ".join(own), " ".join([*own[: n - change], *(f"{k}x{j}" for j in range(change))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = linked({i: shingles(t, words) for i, t in enumerate(texts)}, percent)
    pairs = {i for i, c in want.items() if i != c}
    got = {r["doc_id"] for r in rows(minhash.near_duplicates(docs, words=words, percent=percent)) if not r["kept"]}
    assert len(pairs) == 300 and len(got & pairs) >= 297 and got <= pairs


def test_minhash_edges(edges, empty):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(minhash.near_duplicates(edges, words=3, percent=85))}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (6, 10, 5, False), (7, 1, 7, True), (8, 0, 8, True), (None, 1, None, True)} <= out
    assert minhash.near_duplicates(edges).count() == len(EDGES)
    assert minhash.near_duplicates(empty).count() == 0


def brute_lines(docs, least):
    """Lines that lie in some run of at least least words whose lines also stand earlier."""
    seq = {}
    for i, text in docs:
        lines = [(p, x.strip(" ")) for p, x in enumerate((text or "").split("\n"))]
        seq[i] = [(p, x, len(re.findall(r"[^ \x09-\x0D]+", x))) for p, x in lines]
        seq[i] = [x for x in seq[i] if x[2]]
    seen, gone = {}, set()
    for i in sorted(seq):
        for a in range(len(seq[i])):
            for b in range(a, len(seq[i])):
                run = seq[i][a : b + 1]
                if sum(x[2] for x in run) >= least:
                    key = tuple(x[1] for x in run)
                    if key in seen:
                        gone |= {(i, p) for p in range(run[0][0], run[-1][0] + 1)}
                    seen.setdefault(key, (i, a))
    return gone


def test_line_dedup_against_all_runs(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 7]))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if i > 5:
            other = docs[rng.randrange(len(docs))][1].split("\n")
            k = rng.randrange(len(other))
            lines[1:1] = other[k : k + 5] + [""]
        docs.append((i, "\n".join(lines)))
    gone = brute_lines(docs, 8)
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=8)
    for r in rows(out):
        lines = dict(docs)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for p, x in enumerate(lines) if (r["doc_id"], p) not in gone), r["doc_id"]
    assert gone


def test_line_dedup_edges(edges, empty):
    out = rows(linededup.dedup_lines(edges))
    assert len(out) == len(EDGES)
    assert {(r["doc_id"], r["__removed"]) for r in out} == {(e[0], 0) for e in EDGES}
    assert next(r for r in out if r["doc_id"] == 1)["text"] is None
    assert linededup.dedup_lines(empty).count() == 0


def test_license_base_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in small(spark, "documents").collect()}
    for r in rows(queries.op2_license_scan(spark, SMALL)):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").translate(FOLD))
        hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = sorted({x[1] for x in hits})
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert got == (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(base))
        assert set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_rules(spark):
    def labels(text):
        words = b" " + b" ".join(re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())) + b" "
        return [d.label for d in licenses.detect(words)[0]]

    assert len(licenses.rules()) > 400 and len(licenses.NAMES) >= 200 and len({n[2] for n in licenses.NAMES}) == len(licenses.NAMES)
    assert labels("redistribution and use in source and binary forms, with or without modification, are permitted") == ["bsd"]
    assert labels("GPLv2+") == ["gpl-2.0"] and labels("GPL v2 or later") == ["gpl-2.0-or-later"] and labels("the BSD 3-Clause License") == ["bsd-3-clause"]
    assert labels("under the GNU General Public License, version 3 or later.") == ["gpl-3.0-or-later"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("nothing to see, licensee") == []


def brute_detect(words):
    """As licenses.detect(), each match held against all accepted ones."""
    found = []
    for rule in licenses.rules():
        got = []
        if rule.keyword.encode() in words:
            for m in rule.pattern.finditer(words):
                a, b = words[: m.start()].count(b" ") - 1, words[: m.end()].count(b" ") - 1
                if not any(x[0] <= a and b <= x[1] for x in found):
                    got.append((a, b, rule.label, rule.weight))
        found += got
    return sorted(found)


def test_license_suppression_against_brute_force():
    import time

    rng = random.Random(4)
    parts = [re.sub(r"\(\?![^)]*\)|\(\?:[^)|]*\)\?|[^a-z0-9 ]", "", n[2]).replace("cs", "") for n in licenses.NAMES] + ["gnu general public license", "version 2 0", "or later", "cc by", "4 0", "mit license", "x", "spdx license identifier", "apache 2 0"]
    for _ in range(300):
        words = f" {' '.join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))} ".replace("  ", " ").encode()
        assert [tuple(d) for d in licenses.detect(words)[0]] == brute_detect(words)
    start = time.monotonic()
    assert len(licenses.detect(b" mit license version 2" * 100_000 + b" ")[0]) == 100_000
    assert time.monotonic() - start < 20


def test_license_edges(spark, edges, empty):
    out = rows(licenses.scan_licenses(edges))
    assert len(out) == len(EDGES) and all(r["n_words"] == 0 for r in out if r["doc_id"] in (1, 2, 8))
    assert licenses.scan_licenses(empty).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><title>T</title><style>p{}</style><script>var t="</p>";</script><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy &amp; fly</div><div class="cookie-notice"><p>We use cookies</div><article><h1>A title</h1><p><b>Bold&nbsp;one.<br><p>x &lt; y<p>Be.<p>A <a href=/a>link</a> in\n a&#x20;sentence.
    <aside>Side</aside><section class="comments"><p>First!</p></section></article><aside class="sidebar"><p>Related things</aside><form><label>Mail</label><input></form><!-- gone --><footer>&copy; me</footer>"""
    out = rows(html.extract_text(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<p>a<b"), (None, "u", "<" * 5000)], "page_id bigint, url string, html string")))
    got = [(r["page_id"], r["text"]) for r in out]
    assert got[0] == (1, "A title Bold one. x < y Be. A link in a sentence.")
    assert got[1:3] == [(2, ""), (3, "")] and len(got) == 5
    wrapped = '<div class="layout with-sidebar"><main><article class="post"><header class="entry-header"><h1 class="entry-title">T</h1></header><div class="entry-content"><p>One <em>two</em>.</p></div><div id="comments" class="comments-area"><article class="comment"><p>No.</p></article></div></article></main><div id="sidebar"><p>Side</p></div></div>'
    assert [b.text for b in html.main_blocks(wrapped)] == ["T", "One two."]
    plain = "<html><body><ul><li><a href=/>One</a><li><a href=/>Two</a></ul><p>" + "long words of text " * 20 + "<p>" + "more of them here " * 20 + "</body>"
    assert " ".join(b.text for b in html.main_blocks(plain)).startswith("long words") and "One" not in " ".join(b.text for b in html.main_blocks(plain))


def test_html_pages_that_mark_nothing():
    """Pages without articles, classes or roles, which the tree wasn't fitted on: titles, texts and short lines in them stay."""
    rng = random.Random(3)
    words = lambda a, b: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randrange(a, b)))
    right = total = 0
    for _ in range(60):
        menu = [f"<li><a href=/>{words(1, 4)}</a>" for _ in range(rng.randrange(2, 8))]
        body = [("h1", words(4, 14))] + [("p", words(22, 140)) for _ in range(rng.randrange(2, 8))]
        body.insert(3, ("h2", words(3, 9)))
        more = [f"<li><a href=/>{words(3, 9)}</a>" for _ in range(rng.randrange(2, 6))]
        page = f"<html><body><ul>{''.join(menu)}</ul>{''.join(f'<{t}>{x}</{t}>' for t, x in body)}<div>{words(1, 4)}</div><ul>{''.join(more)}</ul><div>{words(5, 12)}</div></body></html>"
        got = [b.text for b in html.main_blocks(page)]
        wrong = set(got) ^ {x for _, x in body}
        total += len(html.blocks(page))
        right += len(html.blocks(page)) - len(wrong)
    assert right / total > 0.97

    def features(tree):
        return {tree[0]} | features(tree[2]) | features(tree[3]) if isinstance(tree, tuple) else set()

    names = ["words", "links", "words before", "links before", "words after", "links after", "place"]
    used = {names[f] for f in features(html.tree())}
    assert {"links", "place"} <= used and used & {"words before", "links before"} and used & {"words after", "links after"}


def test_html_reads_hostile_pages_in_one_pass():
    import time

    start = time.monotonic()
    for part in ('<a "', "<a ", "<!x ", "<a '", "<", "</a ", '<a "x>', "<script>", "<!--", "<b><div></b>"):
        html.main_blocks(part * (300_000 // len(part)))
        html.main_blocks(part * (300_000 // len(part)) + ">'\"")
    html.main_blocks("<div>" * 50_000 + "</p></b></i>" * 50_000)
    html.main_blocks("<i>" * 50_000 + "<div>" + "</i></b>" * 50_000)
    assert time.monotonic() - start < 60


def test_html_articles_of_the_table(spark):
    import html as lib

    pages = {r.page_id: r.html for r in small(spark, "pages").collect()}
    for r in rows(queries.op4_html_extraction(spark, SMALL)):
        raw = pages[r["page_id"]]
        if raw:
            inner = raw.split("<article>")[1].split("</article>")[0]
            want = " ".join(lib.unescape(re.sub(r"<br>|</?(p|h1)>", " ", re.sub(r"</?b>", "", inner))).split())
            assert (r["text"], r["n_chars"]) == (want, len(want))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = out.predicted == out.quality
    assert right.mean() > 0.99 and right[out.quality == 1].mean() > 0.99 and right[out.quality == 0].mean() > 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (3, None), (None, 1), (2, 0), (2, 1)], "doc_id bigint, quality int")
    out = rows(quality.classify(edges, labels))
    assert len(out) == len(EDGES) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in rows(quality.classify(edges, labels.limit(0)))} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    few = quality.fit_frame(edges, labels, max_fit_features=12)
    assert few.weight.any() == quality.fit_frame(edges, labels.where("doc_id = 5"), max_fit_features=12).weight.any()


def brute_distance(pattern, text):
    last = list(range(len(pattern) + 1))
    best = last[-1]
    for ch in text:
        now = [0]
        for i, p in enumerate(pattern, 1):
            now.append(min(now[-1] + 1, last[i] + 1, last[i - 1] + (p != ch)))
        last, best = now, min(best, now[-1])
    return best


def test_myers_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))
        want, got = brute_distance(pattern, text), decontaminate.myers(pattern, text, 10)
        assert (got[0] if got else None) == (want if want <= 10 else None)


def test_decontamination(spark, edges, empty):
    bench, docs = small(spark, "benchmark"), small(spark, "documents")
    items = [(r.item_id, decontaminate.normal(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in decontaminate.normal(r.text)}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows(decontaminate.find_leaks(docs, bench))}
    assert want and want == {k for k, d in got.items() if d == 0}
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.find_leaks(docs, bench, filter_bits=1 << 16))} == set(got)
    text = items[0][1]
    odd = text[:40].upper() + "\n" + text[41:70] + "zz" + text[72:]
    some = spark.createDataFrame([(1, f"xx {odd} yy"), (2, text[: len(text) // 2]), (3, None), (1, f"xx {odd} yy")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.find_leaks(some, bench))} == {(1, items[0][0])}
    assert decontaminate.find_leaks(edges, bench).count() == 0 and decontaminate.clean_documents(edges, bench).count() == len(EDGES)
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_short_items(spark):
    bench = spark.createDataFrame([(1, "What is\n2+2?"), (2, "cat"), (3, "首都はどこ"), (4, " "), (5, None), (6, "x" * 31), (7, "हिन्द")], "item_id bigint, text string")
    texts = ["so: what  is 2+2? yes", "What is 2+3?", "concatenate", "a Cat, a dog", "日本の首都はどこですか", "y" + "x" * 31, "x" * 31 + ".", "", None, "हिन्दी", "cats and a cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in rows(decontaminate.find_leaks(docs, bench))}
    assert got == {(0, 1, 0, 16), (3, 2, 0, 5), (4, 3, 0, 8), (6, 6, 0, 31), (10, 2, 0, 14)}
    assert {r["doc_id"] for r in rows(decontaminate.clean_documents(docs, bench))} == {1, 2, 5, 7, 8, 9}


def test_decontamination_against_the_table(spark):
    """Mutated items in other text, by a plain distance table over all pairs."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(n))
    bench = [(k % 9 if k % 5 else None, words(rng.randrange(4, 22))) for k in range(24)]
    docs = []
    for k in range(60):
        text = list(decontaminate.normal(rng.choice(bench)[1]))
        for _ in range(rng.randrange(0, 9)):
            at, what = rng.randrange(len(text)), rng.randrange(3)
            text[at : at + (what > 0)] = [] if what == 1 else [rng.choice("abc é")]
        docs.append((k % 50 if k % 7 else None, f"{words(3)} {''.join(text)} {words(4)}"))
    docs += [docs[0], docs[7], docs[7]]
    want, clean = [], 0
    for i, text in docs:
        t, before = decontaminate.normal(text), len(want)
        for item, pattern in bench:
            p = decontaminate.normal(pattern)
            if len(p) < 32:
                if any(t.startswith(p, s) and decontaminate.whole_words(t, s, s + len(p)) for s in range(len(t))):
                    want.append((i, item, 0))
            elif (d := brute_distance(p, t)) <= int(len(p) * 0.06):
                want.append((i, item, d))
        clean += len(want) == before
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in rows(decontaminate.find_leaks(docs, bench))]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {d for *_, d in got} >= {0, 1, 2}
    assert decontaminate.clean_documents(docs, bench).count() == clean


def test_embeddings_against_all_pairs(spark):
    df = small(spark, "embeddings").limit(400)
    got = df.collect()
    v = [(r.vec_id, r.label, list(r.embedding)) for r in got]
    v += [(1000 + i, v[i][1], [2 * x for x in v[i][2]]) for i in range(20)] + [(2000 + i, v[i][1], v[i][2]) for i in range(20)]
    v += [(3000, 1, None), (3001, 1, [0.0] * 64), (3002, 1, [float("nan")] + [1.0] * 63), (3003, None, v[0][2]), (3004, 1, []), (3005, 1, [1.0]), (3006, 1, [2.0]), (3007, 1, [None, 1.0])]
    df = spark.createDataFrame(v, "vec_id bigint, label int, embedding array<double>")
    ok = [x for x in v if x[1] is not None and x[2] and None not in x[2] and np.isfinite(x[2]).all() and any(x[2])]
    links, up = Counter(), {x[0]: x[0] for x in v}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, x in enumerate(ok):
        for y in ok[:n]:
            if x[1] == y[1] and len(x[2]) == len(y[2]):
                a, b = np.array(x[2]), np.array(y[2])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[x[0]] += 1
                    links[y[0]] += 1
                    i, j = sorted((top(x[0]), top(y[0])))
                    up[j] = i
    for tile in (1024, 16):
        for r in rows(embeddings.near_vectors(df, tile_rows=tile)):
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], top(i), top(i) == i)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_null_and_repeated_ids(spark):
    e = lambda k: [1.0 if j == k else 0.0 for j in range(8)]
    near = lambda k: [1.0 if j == k else 0.05 for j in range(8)]
    v = [(1, 0, e(0)), (1, 0, e(1)), (2, 0, near(0)), (None, 0, e(2)), (3, 0, near(2)), (None, 0, e(3)), (None, 0, near(3)), (4, 0, e(4)), (4, 0, e(4)), (5, 1, e(4)), (None, 0, e(0))]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in rows(embeddings.near_vectors(spark.createDataFrame(v, "vec_id bigint, label int, embedding array<double>"))))
    want = [("1", 2, "1", True), ("1", 0, "1", True), ("2", 2, "1", False), ("None", 1, "None", True), ("3", 1, "3", True), ("None", 1, "None", True), ("None", 1, "None", True), ("4", 1, "4", True), ("4", 1, "4", True), ("5", 0, "5", True), ("None", 2, "None", True)]
    assert got == sorted(want)


def test_mixing(spark, edges, empty):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 9)), "big" if i % 10 else ("mid" if i % 20 else "tiny")) for i in range(3000)], "doc_id bigint, text string, source string")
    out = mixing.mix_sources(docs, entropy_share=0.9, max_repeats=3.0, block_docs=32).toPandas()
    tokens = docs.withColumn("n", F.size(F.split("text", " "))).toPandas().groupby("source").n.sum()
    best = None
    for a in np.linspace(0, 1, 20001):
        p = (tokens / tokens.sum()) ** a
        w = p / p.sum()
        if -(w * np.log(w)).sum() >= 0.9 * np.log(3):
            best = a
    for a in np.linspace(best, 1, 20001):
        p = (tokens / tokens.sum()) ** a
        w = p / p.sum()
        if (w / (tokens / tokens.sum())).max() <= 3.0:
            break
    drawn = out.groupby("source").n_tokens.sum()
    assert ((w * tokens.sum() - drawn).abs() <= 20 + 1e-4 * tokens.sum()).all() and (drawn <= w * tokens.sum() + 1 + 1e-4 * tokens.sum()).all()
    assert out.groupby("doc_id").epoch.nunique().eq(out.groupby("doc_id").size()).all() and out.groupby("doc_id").size().max() <= 3
    assert out.equals(mixing.mix_sources(docs.repartition(7), entropy_share=0.9, max_repeats=3.0, block_docs=32).toPandas()) or set(map(tuple, out.values)) == set(map(tuple, mixing.mix_sources(docs.repartition(7), entropy_share=0.9, max_repeats=3.0, block_docs=32).toPandas().values))
    drawn = {r["doc_id"] for r in rows(mixing.mix_sources(edges, entropy_share=0.0))}
    assert {3, 4, 5, 6, 7, 9, None} == drawn
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_refuses_limits_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id bigint, text string, source string")
    with pytest.raises(ValueError, match="more than 4.0 times"):
        mixing.mix_sources(docs, budget_ratio=8.0)


def brute_spans(docs, length):
    """Of each row, in order: an id and a text are a document, null ids come last, texts of an id go by hash (th)."""
    order = sorted({(i is None, i or 0, h): (t or "").encode() for i, t, h in docs}.items())
    seen, out = {}, {}
    for (nameless, i, h), text in order:
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            part = text[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\x01" * length
            seen.setdefault(part, 1)
        left = bytes(b for b, x in zip(text, gone, strict=True) if not x)
        out[None if nameless else i, h] = (len(text), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return [(i, *out[i, h]) for i, _, h in docs]


@pytest.mark.parametrize("ways", [{}, {"crowd": 2}, {"sampled": 1, "frequent": 3}])
def test_suffix_against_all_strings(spark, ways):
    docs = [(r.doc_id, r.text) for r in small(spark, "documents").collect()][:150]
    rng = random.Random(3)
    n = max(i for i, _ in docs) + 1
    for k in range(60):
        a, b = rng.choice(docs)[1], rng.choice(docs)[1]
        s, t = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        docs.append((n + k, a[s : s + rng.randrange(30, 400)] + b[t : t + rng.randrange(30, 300)]))
    docs += [(n + 100, "ab" * 300), (n + 101, "a" * 500), (n + 102, ""), (n + 103, None), (n + 104, "a" * 99), (n + 105, "x" * 99 + "a" * 100), (n + 106, "été" * 80)]
    docs += [(n + 200 + k, "A line that a lot of documents share, and that is far longer than a hundred bytes, so that whole strings lie within it. " + chr(97 + k % 26) * (k + 1)) for k in range(30)]
    letters = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    docs += [(None, docs[0][1]), (None, letters(300)), (None, letters(300)), (5, letters(300)), (5, docs[3][1]), (5, docs[3][1]), (-1, letters(250) + docs[9][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    want = brute_spans([tuple(r) for r in df.collect()], 100)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows(suffix.repeated_spans(df.repartition(5), **ways))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_suffix_edges(edges, empty):
    out = rows(suffix.repeated_spans(edges))
    assert len(out) == len(EDGES)
    assert {(r["doc_id"], r["n_removed"]) for r in out} >= {(1, 0), (2, 0), (3, 0), (4, 0), (None, 0), (7, 30_000 * 5 - 5)}
    assert suffix.repeated_spans(empty).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    raw, starts = data.tobytes(), np.arange(600 - 12)
    common = lambda i, j: next((k for k in range(600 - max(i, j)) if raw[i + k] != raw[j + k]), 600 - max(i, j))
    want = [max((common(i, j) for j in range(i)), default=0) for i in starts]
    got = suffix.longest_previous(data, starts, np.full(len(starts), 600), starts, 12).tolist()
    assert [min(x, 15) if x >= 12 else -1 for x in got] == [min(x, 15) if x >= 12 else -1 for x in want]
    values = rng.integers(0, 50, 200)
    assert suffix._smaller(values, -1).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(200)]
    assert suffix._smaller(values, 1).tolist() == [min((j for j in range(i + 1, 200) if values[j] < values[i]), default=-1) for i in range(200)]


def test_chat_layouts(spark):
    lines = [
        {"id": 1, "messages": [{"role": "user", "content": "a<b>\\1"}, {"role": "assistant", "content": "</turn>\n<turn user>"}]},
        {"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]},
        {"id": 3, "instruction": "do", "input": "this", "output": "done", "system": "be good"},
        {"id": 4, "prompt": "p", "response": "r"},
        {"id": 5, "odd": "thing"},
        {"id": 6, "instruction": "do", "output": ""},
    ]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in lines]))
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.learned(F.col("formatted"), F.col("mask")))
    got = {r["id"]: r for r in rows(out)}
    assert [got[i]["layout"] for i in range(1, 7)] == ["messages", "from-value", "instruction", "prompt-response", None, "instruction"]
    assert all(r["back"] == r["turns_out"] for r in got.values())
    assert [t["role"] for t in got[3]["turns_out"]] == ["system", "user", "user", "assistant"]
    assert [got[i]["loss"] for i in range(1, 7)] == ["</turn>\n<turn user>", "", "done", "r", "", ""]
    assert got[5]["turns_out"] == [] and got[2]["turns_out"][1] == {"role": "assistant", "text": ""}


def test_chat_round_trip(spark):
    rng = random.Random(5)
    alphabet = ["\\", "<", ">", "/", "turn", "0", "1", "2", "\n", " ", "é", "😀", "</turn>", "</turn>\n", "\\1"]
    data = [(i % 40, k, rng.choice(["user", "assistant", "odd <role>\n", None]), rng.choice([None, "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))])) for k, i in enumerate(range(400))]
    df = spark.createDataFrame([*data, (None, 1, "user", "x"), (7, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(chat.conversations(df)).withColumn("back", chat.read_back(F.col("formatted")))
    for r in rows(out.withColumn("loss", chat.learned(F.col("formatted"), F.col("mask")))):
        want = [{"role": t["role"] or "", "text": t["text"] or ""} for t in r["turns"]]
        assert r["back"] == want and r["loss"] == "".join(t["text"] for t in want if t["role"] == "assistant")
    assert chat.format_chats(chat.conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = db.execute(queries.oracle_sql()[name])
    want = [dict(zip([c[0] for c in cur.description], r, strict=True)) for r in cur.fetchall()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, rows(queries.queries()[name](spark, SMALL)))) == sorted(map(key, want))


def test_clashing_names(spark):
    names = "id text n a b key rep c label score predicted layout formatted mask turns_out __key __hash __runs __lines __removed __mark link dim".split()
    docs = spark.createDataFrame([(1, "some words here", "s", *["x"] * (len(names) - 1)), (2, "some words here", "s", *["y"] * (len(names) - 1))], ", ".join(["doc_id bigint", "text string", "source string", *(f"{n} string" for n in names if n != "text")]))
    labels = spark.createDataFrame([(1, 1, "z")], "doc_id bigint, quality int, text string")
    bench = spark.createDataFrame([(1, "some words here", 5)], "item_id bigint, text string, doc_id int")
    assert [r["kept"] for r in rows(minhash.near_duplicates(docs).orderBy("doc_id"))] == [True, False]
    assert {r["__removed"] for r in rows(linededup.dedup_lines(docs, min_words=3))} == {0, 1}
    assert {r["score"] for r in rows(quality.classify(docs, labels))} != {"x"}
    assert decontaminate.find_leaks(docs, bench, min_chars=5).count() == 2
    assert mixing.mix_sources(docs).count() == 2 and licenses.scan_licenses(docs).count() == 2
    assert suffix.repeated_spans(docs).count() == 2
    pages = docs.withColumnRenamed("source", "html")
    assert {r["text"] for r in rows(html.extract_text(pages))} == {"s"}
    talks = docs.withColumn("turns", F.array(F.struct(F.lit("user").alias("role"), F.col("text"))))
    assert {r["formatted"] for r in rows(chat.format_chats(talks))} == {"<turn user>\nsome words here</turn>\n"}
    assert "score" in quality.classify(docs, labels).columns


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES][-1] == "source mixing" and p.ORACLE_SQL is None
    docs = small(spark, "documents")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
    out = rows(p.run(spark, SMALL))
    kept = {r["doc_id"] for r in out}
    bench = [decontaminate.normal(r.text) for r in small(spark, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept and not any(b in decontaminate.normal(texts[i]) and len(b) >= 32 for i in kept for b in bench if texts[i].count("\n") == 0)
