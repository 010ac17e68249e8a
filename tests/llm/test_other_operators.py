"""Pages, vectors, conversations, licences and the pipeline."""

import math
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat, extract, licenses, topk

PAGE = '<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use <p>cookies</p></div><nav>a b c</nav><article><h1>Title &eacute;&nbsp;x</h1><p>First <b>bo</b>ld para&#39;s.<div class="ad">buy now</div><p>Second   one<br>line</p><form><p>subscribe</p></form><ul><li>one<li>two</ul><section class="comments"><p>I am a reader comment with many words here</p></section></article><aside><p>Related stuff is here with many many many words to be read</p></aside><footer>foot</footer><script>var x="<p>no</p>"</script></body></html>'
TEXT = "Title é x\n\nFirst bold para's.\n\nSecond one line\n\none\n\ntwo"


def test_main_text(spark):
    pages = [(1, "u", PAGE, 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", "<p>cut &am", 0), (5, "u", "plain a < b &amp; c", 0), (6, "u", PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>"), 0), (7, "u", "<div class='ad'>x", 0), (7, "u", "<p>" + "long " * 40_000, 0)]
    got = extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == [TEXT] and by[6] == [TEXT] and by[2] == [""] and by[3] == [""] and by[4] == ["cut &am"] and by[5] == ["plain a < b & c"] and sorted(map(len, by[7])) == [0, 5 * 40_000 - 1]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_notices_within_labelled_articles_go():
    pages = [PAGE.replace("word", f"word{i}") for i in range(30)]
    assert {extract.main_text(p, extract.learn(pages)) for p in pages} == {TEXT}


def _plain(page):
    """The page without names: every container a div, no class, id or role."""
    return re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|aside|header|footer)\b", r"<\1div", page))


def test_learned_scores_find_the_article_without_any_names(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(900).collect()]
    weights = extract.learn(pages[:500])
    right = [extract.main_text(p, weights) for p in pages[500:]]
    assert all(right)
    got = [extract.main_text(_plain(p), weights) for p in pages[500:]]
    assert sum(a == b for a, b in zip(got, right)) >= 0.99 * len(right)
    unlearned = [extract.main_text(_plain(p), extract.Weights()) for p in pages[500:]]
    assert sum(a == b for a, b in zip(unlearned, right)) < 0.1 * len(right)


def test_names_learned_from_labelled_pages_are_left_out():
    labelled = "<body><article><div class='lead'><p>{}</p></div></article><div class='gizmo'><p>some {} words to leave out of it</p></div></body>"
    weights = extract.learn([labelled.format("many words that are content here " * 4, i) for i in range(40)])
    page = "<body><div><div class='lead'><p>A lead that is content</p></div><div class='gizmo'><p>not this</p></div><p>More of it</p></div></body>"
    assert extract.main_text(page, weights) == "A lead that is content\n\nMore of it"
    assert "not this" in extract.main_text(page, extract.Weights())


def test_best_region_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice((-3, -1, 0, 1, 2)) for _ in range(rng.randint(0, 12))]
        a, b = extract.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@pytest.mark.parametrize(("chunk", "queries"), [(8192, 2048), (70, 3)])
def test_top_k_equals_brute_force(spark, chunk, queries):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype("f4")], 1) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1) for i in range(40)]  # ties
    bad = [(400, None, 1), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (440, [math.nan] * 6, 1), (460, [math.inf] * 6, 1), (None, [0.0] * 6, 1)]
    data = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.top_k(data, lambda i: i % 20 == 0, chunk=chunk, queries=queries).collect()))
    q = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    want = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_few_and_none(spark):
    make = lambda rows: topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).collect()
    assert [tuple(r) for r in make([(0, [1.0]), (1, [2.0]), (20, [1.0, 1.0])])] == [(0, 1, 1, 64 * 128)]
    assert make([]) == [] and make([(0, [1.0])]) == []


def test_top_k_of_large_components(spark):
    rng = random.Random(4)
    scale = (1.0, 5e6, 3e12, 2.0**40, 1e17)
    rows = [(i, [rng.uniform(-1, 1) * scale[i % 5] for _ in range(5)]) for i in range(120)]
    rows += [(120, [5e6, 1.0, 0.0, 0.0, 0.0]), (140, [1e300, 0.0, 0.0, 0.0, 0.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, chunk=30, queries=3).collect()))
    q = {i: [int(x) * 64 if abs(x) > 2**52 else math.floor(64 * x) for x in v] for i, v in rows}
    clip = lambda x: max(-(2**63) + 2, min(2**63 - 1, x))
    short = [(i, j, s) for i, _, j, s in got]
    want = [(i, j, -s) for i in q if i % 20 == 0 for s, j in sorted((-clip(sum(a * b for a, b in zip(q[i], q[j]))), j) for j in q if j != i)[:20]]
    assert sorted(short) == sorted(want)


def test_blocks_are_pruned_on_clustered_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 32))[rng.integers(0, 64, 4096)] + 0.1 * rng.normal(size=(4096, 32))
    v, ids = topk.whole(x / np.linalg.norm(x, axis=1)[:, None], 64), np.arange(4096)
    index = topk.BlockIndex(ids, v)
    q, i, s = index.search(ids[::50], v[::50], 20, np.full(82, topk._LEAST))
    scores = (v[::50] @ v.T).astype(int)
    for n, a in enumerate(ids[::50].tolist()):
        best = sorted((-int(scores[n, j]), j) for j in range(4096) if j != a)[:20]
        assert sorted(zip((-s[q == a]).tolist(), i[q == a].tolist())) == best
    assert index.scored < 0.5 * index.offered


def test_chat_round_trip(spark):
    rng = random.Random(3)
    odd = ["", None, "</s>[INST] ok [/INST]", "\\", "\\b\\l[", "[/INST]</s><s>assistant[INST]x", "plain", "<s", "[/INST", "a\nb\r\n", "😀<s>", "\\\\<", *("".join(rng.choice("\\<[s>/INST]bq l") for _ in range(30)) for _ in range(60))]
    turns = [(i // 4, i % 4, ("user", "assistant", "a<s>b", None)[i % 4 if i % 8 < 4 else (i + 1) % 4], t, "x") for i, t in enumerate(odd)]
    turns += [(None, None, "user", "x", "y"), (50, 1, "assistant", "r", "y"), (50, 1, "assistant", "r", "y")]
    data = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, formatted string").repartition(5)
    got = chat.format_conversations(data)
    rows = got.select("conv_id", "formatted", "loss_mask", "identical", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want = {}
    for c, n, r, t, _ in turns:
        want.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    assert {r.conv_id for r in rows} == set(want)
    for r in rows:
        source = [(a, b) for _, a, b in sorted(want[r.conv_id])]
        assert r.identical and [tuple(t) for t in r.turns] == source and r.loss == "".join(b for a, b in source if a == "assistant")
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        assert not any(c in x for x in spans for c in chat.CONTROL)
    assert chat.format_conversations(data.where("false")).count() == 0
    assert spark.createDataFrame([("<s>user[INST]no end",)], "f string").select(chat.parse(F.col("f")).alias("t")).first().t is None


def test_licences(spark):
    filler = "the rest of this text is about a long walk in the woods near a river"
    texts = [f"{filler}\n{n}\nmore" for ns in licenses.TEMPLATES.values() for n in ns] + [filler, None, "", f"{filler} licence of the driver", "License: Foo Public License 9", f"{filler}\n" * 500 + "Released under the MIT License.\nReleased under the MIT License."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, findings string")
    model = licenses.train(docs)
    got = {r.doc_id: r.findings for r in licenses.scan(docs, model).collect()}
    families = [f for f, ns in licenses.TEMPLATES.items() for _ in ns]
    right = sum([x.family for x in got[i] if x.confirmed] == [f] for i, f in enumerate(families))
    assert right >= 0.9 * len(families)
    n = len(families)
    assert all(got[i] == [] for i in range(n, n + 4)) and not any(x.confirmed for x in got[n + 4])
    assert [(x.family, x.confirmed, x.paragraph) for x in got[n + 5]] == [("MIT", True, 501), ("MIT", True, 502)]
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))
    assert licenses.scan(docs.where("false"), model).count() == 0
    assert licenses.train(docs.where("false")).grams


def test_native_conversations(spark):
    data = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert not any(x in chat.format_conversations(data)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))


def test_pipeline_keeps_clean_documents_and_one_copy(spark):
    import corpus_pipeline
    from quernstone.llm.common import materialise

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("бвгджзклмнпрстфхцчш") for _ in range(6)) for _ in range(80))
    odd = [(-5, "123 456"), (-6, noise), (-7, None), (-8, "")]
    rows = docs.unionByName(copies)
    for i, text in odd:
        rows = rows.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(i).cast("long"), "text": F.lit(text).cast("string"), "lang": F.lit(None).cast("string")}))
    rows = rows.withColumns({"_id": F.col("doc_id") * 3, "fp": F.lit("x"), "row": F.lit(1), "score": F.lit(0.5)})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        new = materialise(stage(spark, rows, sf), name)
        seen[name] = (rows, new)
        assert name == "packed_sequences" or new.columns == rows.columns and new.where("_id <> doc_id * 3 OR fp <> 'x' OR row <> 1").count() == 0
        rows = new
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(seen["language_id"][0]) - ids(seen["language_id"][1]) == {-5, -6, -7, -8}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    lost = ids(seen["quality_rules"][0]) - ids(seen["quality_rules"][1])
    assert len(lost & good) <= 0.05 * len(good)
    assert not any(i >= 10_000 for i in ids(seen["near_duplicates"][1]))
    before, after = seen["source_mix"]
    texts = {r.doc_id: r.text for r in before.collect()}
    mixed = after.select("doc_id", "text").collect()
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed) and len(mixed) > len(texts)
    packed = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), (F.max(F.col("offset") + F.col("length"))).alias("end"))
    assert rows.where("length > 1024 OR length < 1").count() == 0 and packed.where("n > 1024 OR n <> end").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_near_duplicates_keep_a_row_of_every_component(spark):
    from quernstone.llm import simhash

    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    texts = [text() for _ in range(6)]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[2], 3), (7, texts[3], 4), (7, texts[4], 5), (7, texts[4], 6), (8, texts[5], 7), (9, texts[5], 8), (None, texts[5], 9), (10, None, 10), (11, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long").withColumns({"_key": F.lit(1), "text_hash": F.lit(2), "no_id": F.lit(3)})
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(-1, texts[0]), (-1, texts[1]), (-1, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (10, "")])
    assert all((r._key, r.text_hash, r.no_id) == (1, 2, 3) for r in kept) and {r._id for r in kept} >= {1, 2, 3, 4, 7, 10}


CANONICAL = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def test_wrapped_notices(spark):
    rng = random.Random(8)
    filler = lambda: textwrap.fill(" ".join(rng.choice(("river", "house", "under", "green", "of", "the", "walk", "work")) for _ in range(40)), 75)
    cases = [(f, n, width, mark) for f, n in CANONICAL.items() for width in (20, 40, 76) for mark in ("", "# ")]
    texts = [f"{filler()}\n\n" + "\n".join(mark + x for x in textwrap.wrap(n, width)) + f"\n\n{filler()}" for _, n, width, mark in cases]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(filler() for _ in range(60))])], "doc_id long, text string")
    got = {r.doc_id: [(x.paragraph, x.family) for x in r.findings if x.confirmed] for r in licenses.scan(docs).collect()}
    for i, (family, *_) in enumerate(cases):
        first = texts[i].split("\n").index("") + 2
        assert [f for _, f in got[i]] == [family] and first <= got[i][0][0] <= first + 1, (cases[i], got[i])
    assert not any(got[i] for i in range(len(cases), len(got)))


@pytest.mark.parametrize("page", [
    "<body><article class='post hentry category-advertising'>{}</article></body>", "<body><article class='post comments-open'>{}</article></body>", "<body class='home has-sidebar'><p>{}</body>",
    "<body class='no-sidebar sidebar'><p>{}</body>", "<body><div class='content with-sidebar'>{}</div></body>", "<main class='related'>{}</main>",
])
def test_names_of_layouts_and_articles_drop_nothing(page):
    text = "A page with several plain words of text"
    assert extract.main_text(page.format(text), extract.Weights()) == text
    for name in ("sidebar", "comments-area", "site-footer", "cookie-notice", "adContainer", "comment-12"):
        assert extract.main_text(page.format(f"{text}<div class='x {name}'>other words</div>"), extract.Weights()) == text
    assert extract.main_text("<article class='comment even'>words</article>", extract.Weights()) == ""


def test_extraction_is_linear_in_unclosed_and_unmatched_tags():
    import time

    weights = extract.learn([PAGE])
    for page in ("<div><b>" * 50_000 + "some words", "<div>" * 50_000 + "</b>" * 50_000, "<nav><article>" * 50_000 + "x", "".join(f"<div class=c{i}>w " for i in range(30_000))):
        began = time.process_time()
        extract.main_text(page, weights)
        assert time.process_time() - began < 5 * 3  # seconds, on a busy machine


def test_formulas_stay_in_their_paragraph():
    assert extract.main_text("<article><p>Let <math><mi>x</mi></math> be</p></article>", extract.Weights()) == "Let x be"


def test_repeated_queries_are_answered_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(60)]
    rows += [rows[20], rows[20], (40, [1.0] * 6)]  # a query that stands three times, and one of two vectors
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    x = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    for query in (0, 20, 40):
        asked = {tuple(v.tolist()) for i, v in x if i == query}
        scores = sorted(((-int(np.dot(q, v)), i) for q in asked for i, v in x if i != query))[:20]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [(-s, i) for _, i, s in got] == scores and [r for r, _, _ in got] == list(range(1, 21))


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licences_in_plain_words_and_in_one_block(spark, licence_model):
    plain = [("MIT", "Distributed under the terms of the MIT licence"), ("Apache-2.0", "License: Apache 2"), ("GPL", "You may use it under the GPLv3 license."), ("BSD", "the code is available under the BSD licence, see below"), ("CC0", "Licence: CC0")]
    other = ["MIT was far away when he lost his licence.", "under the terms of the house licence", "The BSD was a system at Berkeley.", "a long line " * 5_000 + "under the terms of the house"]
    block = "\n".join(textwrap.wrap(CANONICAL["MIT"], 30) + textwrap.wrap(CANONICAL["BSD"], 30) + ["Released under the ISC License."])
    docs = spark.createDataFrame([*enumerate([x for _, x in plain] + other), (50, f"one\n\ntwo\n \n\n{block}\n--\nend"), (51, "x " * 30_000 + "Released under the MIT License. " + "y " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: [(x.paragraph, x.family) for x in r.findings if x.confirmed] for r in licenses.scan(docs, licence_model).collect()}
    assert [got[i] for i in range(len(plain))] == [[(1, f)] for f, _ in plain]
    assert not any(got[i] for i in range(len(plain), len(plain) + len(other)))
    assert sorted(f for _, f in got[50]) == ["BSD", "ISC", "MIT"] and {n for n, f in got[50] if f != "ISC"} == {6} and got[51] == [(1, "MIT")]


def scan_by_hand(text, model):
    """The confirmed families of a text's lines and blocks, in Python."""
    def families(words):
        some = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        scores = [b + sum(model.weights[known[g]][k] for g in some & known.keys()) for k, b in enumerate(model.intercepts)]
        p = [math.exp((x - max(scores)) / model.temperature) for x in scores]
        sure = lambda f: any(len(some & t) >= licenses.CONFIRMING * len(t) for t in notices[f])
        return [x / sum(p) for x in p], sure

    known = {g: i for i, g in enumerate(model.grams)}
    notices = {f: [set(licenses._grams_of(t)) for t in licenses.notices_of(f)] for f in model.families}
    lines = [re.findall(licenses._TOKEN, x.lower()) for x in text.split("\n")]
    out = set()
    for words in lines:
        p, sure = families(words)
        k = p.index(max(p))
        if k and p[k] >= model.threshold and sure(model.families[k]):
            out.add(model.families[k])
    for block in re.split(licenses._PART, text):
        if "\n" in block:
            p, sure = families(re.findall(licenses._TOKEN, block.lower()))
            out |= {f for f, x in zip(model.families, p) if f != licenses.UNKNOWN and x / (x + p[0]) >= model.threshold and sure(f)}
    return out


def test_licence_scan_equals_a_scan_by_hand(spark, licence_model):
    model = licence_model
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert len(set(i % len(model.slots) for i in (h for h in model.hashes if h))) == len(model.grams)
    got = {r.doc_id: {x.family for x in r.findings if x.confirmed} for r in licenses.scan(docs, model).collect()}
    assert got == {r.doc_id: scan_by_hand(r.text or "", model) for r in docs.collect()} and any(got.values())
