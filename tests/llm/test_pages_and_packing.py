"""Page texts, packing, licences and toxicity on small tables with nulls, ties and repeated rows."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cairn.llm import html_text, licenses, packing, tokens, toxicity

NAV = "<nav><ul><li><a href='/a'>Home</a></li><li>About us</li></ul></nav>"


def page(body, notice="We use cookies."):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x='<p>no</p>';</script></head><body>{NAV}<div class=\"cookie-notice\">{notice}</div>{body}<footer>&copy; Host</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "http://a.example/1", page("<article><h1>One &amp; two</h1><p>First\n  block &#233;.</p><p>Second <b>bold</b>x.</p></article>")),
        (2, "http://a.example/2", page("<article><h1>Other</h1><p>Body text<br>after break</p></article><section class='comments'><p>Nice!</p></section>")),
        (3, "http://a.example/3", page("<article><p>Only <aside>advert</aside> this</p></article>")),
        (4, "http://b.example/1", page("<div class='content'><p>No article tag.</p></div>")),
        (5, None, None),
        (6, "http://a.example/4", ""),
        (7, "no url", "plain words, no markup"),
        (7, "no url", "plain words, no markup"),
        (8, "http://a.example/5", page("<article><p>" + "long " * 50_000 + "</p></article>")),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, template string")
    got = defaultdict(list)
    for r in html_text.extract(pages).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert got[1] == ["One & two First block é. Second boldx."]
    assert got[2] == ["Other Body text after break"]
    assert got[3] == ["Only this"]
    assert got[4] == ["No article tag."]
    assert got[5] == [""] and got[6] == [""]
    assert got[7] == ["plain words, no markup"] * 2
    assert got[8] == [("long " * 50_000).strip()]


def test_template_text_goes(spark):
    # nothing but the alignment tells the repeated line from the body
    body = "<div><div>Read more on our site</div><div><p>{}</p></div></div>"
    rows = [(i, f"http://c.example/{i}", page(body.format(f"story number {i} of many"))) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story number {i} of many" for i in range(12)}


def test_empty_tables(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).collect() == []
    assert licenses.license_scan(docs).collect() == []
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    words = "the packing of documents leaves no gaps, however long they are über 12 x9".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 40, 700, 3000, 9000)))) for _ in range(150)] + [None, "", "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    rows = packing.pack(docs).collect()
    library = Tokenizer.from_file(tokens.tokenizer_file())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert total / (4096 * len(sequences)) > 0.9


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, 1365, 1366, 2048, 2049, 4095, 4096, 4097, 50_000])
def test_piece_lengths(n):
    out = packing.piece_lengths(n)
    assert sum(length for _, length in out) == n
    assert all(0 < length <= 4096 // k for k, length in out)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    texts = [
        None, "", "All rights reserved. all-rights-reserved ALL RIGHTS RESERVED", "cc by cc by cc", "CC-BY and cc—by, cc é by",
        "GNU General Public License", "x " * 30_000 + "general  public license", "allrights reserved", "reserved rights all rights reserved",
        "# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Licensed under the Apache License, Version 2.0", "the license of this version", "All rights reserved", "All rights reserved",
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[9].labels == "mit" and got[10].labels == "apache-2.0"
    assert got[11].labels == got[0].labels == "" and got[11].score == 0


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    foul = ["".join(rng.choice("stuvwxyz") for _ in range(6)) for _ in range(12)]
    rows = []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(4, 12)):
                w[rng.randrange(60)] = rng.choice(foul)
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.5), (901, "", 0.5), (None, foul[0], 0.5)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 600] + [(3, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 903
    held = [(got[i], y) for i, _, y in rows if i >= 600]
    assert sum(r.toxic == bool(y) for r, y in held) >= 0.97 * len(held)
    assert all(0 <= r.severity <= toxicity.GRADES for r, _ in held)
    assert not got[900].toxic and got[900].grade == 0 and got[901].severity == got[900].severity
    # without toxic labels there is nothing to learn
    none = toxicity.toxicity(docs, labels.where("toxic = 0"))
    assert {(r.severity, r.toxic) for r in none.collect()} == {(0.0, False)}
