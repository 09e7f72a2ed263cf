"""Operators that work row by row: 1, 2, 3, 6, 8."""

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import ODD, documents, frame, with_clashes  # noqa: E402

from tidemark.llm import bpe, language_id, license_scan, main_text, pii  # noqa: E402

# ---- 2: personal data


def _luhn_by_definition(digits):
    out = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        out += n // 10 + n % 10
    return out % 10 == 0


def base_spans(text):
    """The base kinds by their regular expressions alone."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and _luhn_by_definition(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0129.@+- ()%:é\n", max_size=60))
def test_pii_base_equals_regular_expressions(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_pii_cards_and_table(spark):
    texts = ["4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 1.2.3.400 10.0.0.1.", "a@b.c@d.e x@y",
             "+1 (017) 555-7713, +12 34", *[t or "" for t in ODD]]
    df = with_clashes(frame(spark, list(enumerate([*texts, None])), "doc_id long, text string"))
    for r in pii.scan_pii(df).collect():
        base = base_spans(([*texts, None][r["doc_id"]]) or "")
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(
            sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
        assert r["base_sha256"] == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()


def test_pii_cues():
    def found(text):
        return [(k, text[s:e]) for k, s, e in pii.find_spans(text) if k in pii.CUE_KINDS]

    assert found("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE89 3704 0044 0532 0130 01") == []
    assert found('token = "04dbebab91ab85687d33"') == [("secret", "04dbebab91ab85687d33")]
    assert found("the token was lost, password: none") == []
    assert found("Account number 12345678.") == [("account", "12345678")]
    assert found("see https://me:pw@host.example.org/x") == [("uri", "https://me:pw@host.example.org")]
    assert found("see https://host.example.org/a@b") == []


def test_pii_redaction_keeps_columns(spark):
    df = with_clashes(frame(spark, [(1, "mail a@b.cd now", 5), (2, None, None)], "doc_id long, text string, n_chars long"))
    got = pii.redact(df, size_col="n_chars")
    assert got.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {1: ("mail <EMAIL> now", 16), 2: (None, None)}


# ---- 3: language


def test_language_accuracy_and_inputs(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = language_id.train(docs)
    out = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_ignores_held_out_labels(spark):
    import zlib
    ids = list(range(60))
    def lang(i):
        return "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else ("aa" if i % 2 else None)
    rows = [(i, "alpha beta gamma", lang(i)) for i in ids]
    model = language_id.train(frame(spark, rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa"]


def test_language_odd_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "the cat", None), (3, "the cat", "en")]
    df = with_clashes(frame(spark, rows, "doc_id long, text string, lang string"))
    model = language_id.train(df)
    out = language_id.predict(df, model).collect()
    assert len(out) == len(rows)
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (0, 1, 2))
    empty = df.limit(0)
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df, language_id.train(empty)).collect()} == {"und"}
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["lang_pred"] != "und" for r in out)


def test_language_unknown_letters_go(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "die Katze und der Hund", "en" if i % 2 else "de") for i in range(40)]
    odd = [(50, "สวัสดีชาวโลก", None), (51, "你好，世界", None), (52, "你好 dog", None), (53, "qqq the", None)]
    df = frame(spark, rows + odd, "doc_id long, text string, lang string")
    model = language_id.train(df)
    import corpus_pipeline
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, "").collect()} == {*range(40), 52, 53}
    assert language_id.keep_identified(df, model).count() == 44
    assert {r["lang_pred"] for r in language_id.predict(df.where("doc_id in (50, 51)"), model).collect()} == {"de"}


def test_language_numerals_are_no_letters():
    scorer = language_id.Scorer(language_id.Model([("de", "und", 3), ("en", "and", 3)], [("de", "u", 3), ("en", "a", 3)]))
    langs, scores = scorer.predict(["½", "² ½", "Ⅷ", "12 _ ٣", "and ½", "ªnd"])
    assert langs[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and langs[4] == "en" and langs[5] != "und"


def test_language_ranks_in_parts(spark):
    """Ranked inside parts first: the same rows as by one window over a language with most of the rows."""
    rows = [("de" if i % 5 else "en", f"w{i % 97}", i % 11) for i in range(700)]
    counts = frame(spark, rows, "lang string, item string, n long").groupBy("lang", "item").agg({"n": "sum"}).toDF("lang", "item", "n")
    got = sorted(map(tuple, language_id._most_frequent(counts, ["lang"], 20).collect()))
    all_rows = list(map(tuple, counts.collect()))
    want = [r for lang in ("de", "en") for r in sorted((r for r in all_rows if r[0] == lang), key=lambda r: (-r[2], r[1]))[:20]]
    assert got == sorted(want)
    assert language_id._most_frequent(counts, ["lang"], None).count() == len(all_rows)


def test_language_sample_by_ranges(spark):
    """The same rows as by one ranking of a language."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, "en").otherwise("de").alias("lang")) \
        .withColumn("draw", F.xxhash64(F.col("id").cast("string")))
    for most in (1, 40, 3000):
        got = sorted((r.lang, r.id) for r in language_id._sample(rows, most).collect())
        of = {lang: sorted((r.draw, r.id) for r in rows.collect() if r.lang == lang)[:most] for lang in ("de", "en")}
        assert got == sorted((lang, i) for lang, found in of.items() for _, i in found)


def test_language_limits_change_no_prediction(spark):
    docs = documents(spark)
    texts = [r.text for r in docs.select("text").collect()]
    one = language_id.Scorer(language_id.train(docs)).predict(texts)[0]
    two = language_id.Scorer(language_id.train(docs, kept_words=None, kept_grams=None)).predict(texts)[0]
    assert one == two


def test_language_backoff_by_hand():
    m = language_id.Scorer(language_id.Model([("a", "foo", 3), ("b", "bar", 1)],
                          [("a", "fo", 2), ("b", "ba", 2), ("a", "f", 1), ("b", "b", 1), ("a", "o", 1)]))
    assert np.allclose(m.word_score("foo"), np.log([4 / 5, 1 / 3]))
    assert np.allclose(m.word_score("fox"), np.log([3 / 4, 1 / 4]))  # only "fo" is known
    assert np.allclose(m.word_score("zzb"), np.log([1 / 5, 2 / 4]))  # only "b" is known
    assert np.allclose(m.word_score("qqq"), 0)


# ---- 6: main text


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a &lt; b &amp;amp; c</p>", "a < b &amp; c"),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One  two\n three<p><b>Four<br>five</article>"
     "<footer>&copy; x</footer>", "T\nOne two three\nFour five"),
    ("<script>var t='</p><p>no</p>'</script><div class='post'><p>Some text, with commas, here it is.</p></div>"
     "<div id='comments'><p>A reader, who comments, at some length, for ever and ever.</p></div>",
     "Some text, with commas, here it is."),
    ("<main><p>Body</p><form><p>Sign up</p></form><aside>Side</aside><div role=alert>Cookies</div></main>", "Body"),
    ("<article><p>Kept<!-- <p>gone --></p><style>p{}</style><div class='ad-box'>Buy</div><ul><li>one<li>two</ul>"
     "</article>", "Kept\none\ntwo"),
    ("<p>unclosed <b>bold <p>next", "unclosed bold\nnext"), ("a < b and c > d", "a < b and c > d"), ("<!-- x", ""),
])
def test_main_text_cases(page, want):
    assert main_text.extract(page) == want


def test_main_text_in_sections():
    many = ["So the story, which is long, goes on " + "and on " * 36 + str(i) for i in range(5)]
    more = "What came of it was told by those who stayed to see it, and it was little more than they had hoped for."
    menu = "<div><b>Go to</b><ul>" + "".join(f"<li><a href={i}>Other page {i}</a>" for i in range(9)) + "</ul></div>"
    first = "<section>" + "".join(f"<p>{t}</p>" for t in many) + "</section>"
    second = f"<section><h2>After</h2><p>{more}</p></section>"
    want = "\n".join([*many, "After", more])
    assert main_text.extract(f"<div id=content>{first}{second}</div>") == want
    assert main_text.extract(f"<body>{menu}<div><div>{first}</div></div><div><div>{second}</div></div>{menu}") == want
    assert main_text.extract(f"<body><h1>Title</h1><div>{first}<div>Short end.</div></div><div class=footer>x</div>") == \
        "\n".join(["Title", *many, "Short end."])
    # a paragraph inside a menu stays, the menu goes; bare text of an ancestor stays
    assert main_text.extract(f"<body>{menu.replace('</ul>', f'</ul><p>{more}</p><ul><li><a href=x>{more}</a></ul>')}"
                             f"<div>Bare words<div>{first}</div></div>") == "\n".join([more, "Bare words", *many])


PARAGRAPH = ("<p>The council met in the town hall, and it spoke about the harbour, the school, and the road to the north of "
             "the town at length.</p>")
MENU = "<ul class=menu><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
SIDEBAR = "<div class=sidebar><p>Buy our things, they are cheap.</p></div>"
WHOLE_ARTICLES = {  # page -> paragraphs of the article
    f'<body>{MENU}<div class="content has-sidebar">{PARAGRAPH * 4}{SIDEBAR}</div></body>': 4,
    f'<body>{MENU}<div id="page" class="no-sidebar">{PARAGRAPH * 4}</div></body>': 4,
    f'<body>{MENU}<div class="share-price-report">{PARAGRAPH * 4}</div></body>': 4,
    f'<body>{MENU}<div class="promo">{PARAGRAPH * 4}</div></body>': 4,
    f'<body><form id="aspnetForm"><input type=text name=q><select><option>one</select>{MENU}<div>{PARAGRAPH * 4}</div>'
    '<button>Go</button></form></body>': 4,
    f'<article>{PARAGRAPH * 4}<div class="related-work"><h2>Related work</h2>{PARAGRAPH * 2}</div></article>': 6,
    f'<article>{PARAGRAPH * 3}<fieldset><legend>Terms</legend>{PARAGRAPH}</fieldset></article>': 4,
    f'<body><div id=post>{PARAGRAPH * 3}</div><div id="comments">{PARAGRAPH * 20}</div>'
    '<form class="comment-form"><p>Leave a reply</p><textarea></textarea></form></body>': 3,
    f'<body><form class=search><label>Search</label><input></form><div>{PARAGRAPH * 3}</div><div class="site-footer">{PARAGRAPH}</div></body>': 3,
    f'<body><header>{MENU}</header><div>{PARAGRAPH * 3}</div></body>': 3,
    '<body><div class="footer">Copyright by us. All rights.</div></body>': 0,
}


@pytest.mark.parametrize("page,paragraphs", WHOLE_ARTICLES.items())
def test_main_text_loses_no_article(page, paragraphs):
    text = main_text.extract(page)
    assert text.count("The council met") == paragraphs
    for furniture in ("Home", "Buy our", "one", "Go", "Leave a reply", "Search", "Copyright"):
        assert furniture not in text


def test_main_text_keeps_formulas():
    page = f"<article>{PARAGRAPH}<p>We have <math><mi>a</mi><mo>=</mo><mn>2</mn></math> here, as shown before.</p></article>"
    assert main_text.extract(page).endswith("We have a=2 here, as shown before.")


def test_main_text_of_odd_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", None), (None, None, f"<article>{PARAGRAPH}</article>"), (2, "v", ""), (2, "v", ""), (3, "w", "<p>" * 5000 + "x")]
    got = main_text.extract_pages(with_clashes(frame(spark, rows, schema))).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [
        (0, "", len(PARAGRAPH) - 7), (1, "u", 0), (2, "v", 0), (2, "v", 0), (3, "w", 1)]
    assert main_text.extract_pages(frame(spark, [], schema)).count() == 0


def test_main_text_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.collect()
    import html

    def by_structure(h):
        inner = h[h.index("<article>") + 9:h.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<(b|br)>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(b for b in blocks if b)

    got = {r["page_id"]: r for r in main_text.extract_pages(with_clashes(pages)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == by_structure(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "<li>", "<td>", "text, ", "&amp",
                                 "<", ">", "<!--", "-->", "<script>", "</script>", "<b", "\"", "<article>", "<br/>"]), max_size=30))
def test_main_text_bears_broken_pages(parts):
    assert isinstance(main_text.extract("".join(parts)), str)


# ---- 8: byte pair encoding


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet="aab \n\t'sé<|endoftx>", max_size=60), max_size=6))
def test_bpe_equals_library(texts):
    texts = [*texts, "".join(texts) + "<|endoftext|>" + " ".join(texts)]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tok = _library()
    for t, ids in zip(texts, bpe.codec().encode_batch(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert bpe.codec().decode(ids) == tok.decode(ids.tolist(), skip_special_tokens=False) == t


def test_bpe_table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, "x")]
    df = with_clashes(frame(spark, rows, "doc_id long, text string"))
    tok = _library()
    out = {(r["doc_id"], r["decoded_sha256"]): r for r in bpe.digests(df).collect()}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        r = out[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0
    lists = {r["doc_id"]: r["ids"] for r in bpe.encode(df.where("doc_id = 7")).collect()}
    assert lists[7] == tok.encode("a" * 5000, add_special_tokens=False).ids


def test_bpe_stretch_by_stretch(monkeypatch):
    """Texts shared out over many stretches, with and without double spaces and special tokens, one long text among them."""
    monkeypatch.setattr(bpe, "HELD_BYTES", 64)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 32)
    tok = _library()
    texts = ["one two three four five six", "seven  eight nine\n ten", None, "one two", "", "a<|endoftext|> b", "x " * 500, " lead", "trail ",
             "don't, won't. 3.5%", "À la carte; ok: yes!", "日本語。 テスト", "a\u00a0 b", "x\u2003y z", "tab\there"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    got = [r.tolist() for _, rows in bpe.encoded([batch.slice(0, 20), batch.slice(20)]) for r in rows]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(bpe.encoded([])) == []


# ---- 1: licenses


def test_license_wordings():
    s = license_scan.Scanner()

    def found(text):
        return [(n, text[a:b], m, x) for n, a, b, _, m, x in s.scan(text)[1]]

    assert found("blah\nReleased under the MIT License.\nblah") == [("MIT", "Released under the MIT License", 0, 0)]
    assert found("This work is licensed under the GNU General Public License, version 3.")[0][0] == "GPL-3.0"
    assert found("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0"
    assert found("a driver license is needed, with permission of the court") == []
    long = license_scan.TEMPLATES["MIT"][2]
    wrapped = "Copyright 2020\n\n" + "\n".join(long[i:i + 70] for i in range(0, len(long), 70)) + "\n\nend"
    assert [f[0] for f in found(long)] == ["MIT"]
    assert {f[0] for f in found(wrapped)} <= {"MIT"}
    changed = long.replace("free of charge", "at no cost")
    assert [(f[0], f[2] > 0) for f in found(changed)] == [("MIT", True)]


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_TEXT = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
"""
BSD_THIRD = """ *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
APACHE_TEXT = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GNU_TEXT = """# This %s is free software%s you can redistribute it and/or modify
# it under the terms of the GNU %s as published by
# the Free Software Foundation%s either version %s of the License, or
# (at your option) any later version."""
PUBLISHED = {
    MIT_TEXT: "MIT", BSD_TEXT: "BSD-2-Clause", BSD_TEXT + BSD_THIRD: "BSD-3-Clause", APACHE_TEXT: "Apache-2.0",
    GNU_TEXT % ("program", ";", "General Public License", ";", "2"): "GPL-2.0",
    GNU_TEXT % ("program", ":", "General Public License", ",", "3"): "GPL-3.0",
    GNU_TEXT % ("library", ";", "Lesser General Public License", ";", "2.1"): "LGPL-2.1",
    GNU_TEXT % ("program", ":", "Affero General Public License", ",", "3"): "AGPL-3.0",
    "// SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: GPL-3.0-or-later */": "GPL-3.0",
    "Licensed under the GNU General Public License v3.0": "GPL-3.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "Licensed under the EUPL, Version 1.2": "EUPL-1.2",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0"}


def test_license_texts_as_published():
    s = license_scan.Scanner()
    prose = "The council met in the town hall and spoke about the harbour, the school and the road to the north. "
    for text, name in PUBLISHED.items():
        for around in ("", prose * 60):
            finds = s.scan(around + "\n\n" + text + "\n\n" + around)[1]
            assert [f[0] for f in finds] == [name], (text, around[:5], finds)
    both = list(PUBLISHED.items())
    assert [f[0] for f in s.scan("\n\n".join(t for t, _ in both[:4]))[1]] == [n for _, n in both[:4]]


def test_license_exact_wordings_by_brute_force():
    """Every place where all words of a wording stand in a row lies in a find that differs no more."""
    s = license_scan.Scanner()
    rnd = random.Random(4)
    noise = "the license of a public permission and under which software may be used by any person or by the board".split()
    for _ in range(25):
        chosen = [rnd.choice(s.templates) for _ in range(3)]
        text = "\n\n".join(" ".join(rnd.choices(noise, k=rnd.randrange(80))) + "\n" + " ".join(t.words) for t in chosen) + "\n\nend"
        spots = [(m.start(), m.end()) for m in license_scan._WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spots]
        finds = s.scan(text)[1]
        for t in s.templates:
            for i in range(len(words) - len(t.words) + 1):
                if words[i:i + len(t.words)] == t.words:
                    a, b = spots[i][0], spots[i + len(t.words) - 1][1]
                    assert any(f[1] < b and f[2] > a for f in finds), (t.name, text)
        for t in chosen:
            assert t.name in {f[0] for f in finds}, (t.name, finds, text)


def test_license_long_lines():
    s = license_scan.Scanner()
    notice = license_scan.TEMPLATES["Apache-2.0"][1]
    for before in range(0, 4 * s.reach, s.reach // 3):  # wherever the notice lies to the border of a piece
        text = ("license " * 2000)[:before] + " " + notice + " " + "license " * 1500
        assert "Apache-2.0" in [f[0] for f in s.scan(text)[1]], before


def test_license_every_notice_of_a_line():
    s = license_scan.Scanner()

    def names(text):
        return [f[0] for f in s.scan(text)[1]]

    notices = {"Released under the MIT License.": "MIT", "Licensed under CC BY 4.0.": "CC-BY-4.0",
               "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
               "Licensed under the BSD 3-Clause License.": "BSD-3-Clause"}
    assert names(" ".join(notices)) == list(notices.values())
    assert names(" and ".join(["Licensed under the MIT License."] * 3)) == ["MIT"] * 3
    filler = "the board shall review any claim of the parties and report the outcome to the public within the year " * 30
    for notice, name in notices.items():
        assert names(filler + notice + " " + filler) == [name]
        assert names(filler + "\n" + notice.replace(" under ", " under\n") + "\n" + filler) == [name]
    long = license_scan.TEMPLATES["Apache-2.0"][1]
    assert names(f"{long} Licensed under CC BY-NC 4.0. {long}") == ["Apache-2.0", "CC-BY-NC-4.0", "Apache-2.0"]
    # the longest common run lies where the wording isn't
    assert names("licensed under the bsd 2-clause rules or licensed under the bsd 3-clause license") == ["BSD-3-Clause"]


def test_license_table(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(with_clashes(docs)).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Released under the MIT License.": "MIT"}
    for r in docs.collect():
        want = {n for line, n in lines.items() if line in r["text"].split("\n")}
        assert set(filter(None, got[r["doc_id"]].split(","))) == want
    odd = frame(spark, list(enumerate(ODD)), "doc_id long, text string")
    assert {r["licenses"] for r in license_scan.scan_licenses(odd).collect()} == {""}
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0
