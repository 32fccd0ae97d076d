"""Media, BPE, HTML and license operators: round trips, libraries and plain versions."""

import os
import random

import numpy as np
import pytest

from tidemill.llm import bpe, html_text, license, ogg

BPE = "/opt/tokenizers/byte_bpe_50k.json"
ODD = [None, "", "a", "<|endoftext|>x <|endoftext|>", "\x1c\x1d a\x85 x 　y", "  \n\t x's 'll ", "é​1٣\U0001f600 一一!!", "x" * 5000, "�\u0000", "the " * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string, media string")


def slow_checksum(page):
    register = 0
    for byte in page:
        register ^= byte << 24
        for _ in range(8):
            register = (register << 1 ^ (0x04C11DB7 if register & 1 << 31 else 0)) & 0xFFFFFFFF
    return register


def test_checksum_and_lacing():
    rng = random.Random(3)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)
    sizes = [0, 1, 254, 255, 256, 510, 70_000, 255 * 255, 255 * 255 + 1, 0]
    streams = {s: [(rng.randbytes(n), k * 10) for k, n in enumerate(sizes)] for s in (1, 2**32 - 1)}
    back = ogg.demux(ogg.mux(streams))
    assert {s: back[s].packets for s in back} == {s: [p for p, _ in v] for s, v in streams.items()}
    assert back[1].seconds(10)[-1] == 9.0 and ogg.demux(b"") == {}


def test_damage_is_found():
    good = ogg.to_ogg(ogg.payload("some text " * 500)[0])
    assert ogg.from_ogg(good)[0].startswith(b"some text")
    for k in range(0, len(good), 97):
        with pytest.raises(ogg.OggError):
            ogg.from_ogg(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    for k in (1, 30, len(good) - 1):
        with pytest.raises(ogg.OggError):
            ogg.demux(good[:k])


def test_media_columns(spark):
    media = ogg.store(docs(spark, ODD))
    rows = {r.doc_id: r for r in ogg.read(media).collect()}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        assert bytes(rows[k].samples) == raw + b" " * (-len(raw) % 192 or (0 if raw else 192)) and rows[k].error is None
    assert rows[0].feature == rows[1].feature
    broken = spark.createDataFrame([(1, b"Ogg"), (2, None)], "doc_id long, media binary")
    assert all(r.samples is None and r.error for r in ogg.read(broken).collect())
    assert ogg.store(docs(spark, ODD).limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(BPE), reason="needs the vocabulary")
def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BPE), random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é\n'1,.\U0001f600ß\x00tsre") for _ in range(200)) for _ in range(60)]
    encoded = bpe.encode(docs(spark, texts), BPE)
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BPE).collect()}
    for k, t in enumerate(texts):
        expected = library.encode(t or "", add_special_tokens=False).ids
        assert ids[k] == expected and back[k] == library.decode(expected, skip_special_tokens=False) == (t or "")
    assert bpe.digests(docs(spark, []).limit(0), BPE).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><p>Site header with a rather long line of text in it</p></header><nav><ul><li><a href="/a">menu one</a></li><li><a href='>'>menu two</a></ul></nav>
<div class="cookie-notice">We use cookies and say so at great length, as everybody does these days.</div><aside><p>Side words, long enough to look like text of an article, are here.</p></aside>
<!-- <p>comment</p> --><article><h1>A headline</h1><p>First <b>bold</b> para&shy;graph&nbsp;with &lt;marks&gt; and   white
space.<p>Second one, not closed, has <a href="/x">a link inside</a> and goes on.<br>After a break.<p>Ok.</p><form><p>Your name please</p><input></form></article>
<section id="comments"><p>Great article, I really liked reading all of it, thank you very much.</p></section><footer>&copy; example</footer></body></html>"""


def test_main_text(spark):
    expected = "A headline\nFirst bold para­graph with <marks> and white space.\nSecond one, not closed, has a link inside and goes on.\nAfter a break.\nOk."
    assert html_text.extract(PAGE) == expected
    assert html_text.extract(PAGE.replace("</footer></body></html>", "")) == expected
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.extract(bare).startswith("A headline\nFirst bold")
    for nothing in (None, "", "<nav>only</nav>", "<script>x", "<!--", "<p>", " \n"):
        assert html_text.extract(nothing) == ""
    assert html_text.extract("just text") == "just text"
    assert html_text.extract("<p class='ad'>buy this thing now, it is very cheap<p>Kept words of an article that go on for a while.") == "Kept words of an article that go on for a while."
    rows = html_text.extract_pages(spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, "u", expected, len(expected)), (2, None, "", 0)]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_many_pages_give_their_article():
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(n))
    for _ in range(100):
        paragraphs = [words(rng.randint(1, 60)) for _ in range(rng.randint(1, 12))] + [words(40)]
        menu = "".join(f"<li><a href='/'>{words(2)}</a></li>" for _ in range(9))
        page = f"<body><nav><ul>{menu}</ul></nav><div class='ad'>{words(12)}</div><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><footer>{words(9)}</footer>"
        assert html_text.extract(page) == "\n".join(paragraphs)


def test_windows_surge_and_dive():
    w = [0, 40, 0, 0, 0, 5, 0, 9, 30, 0, 0, 0, 0, 2]
    assert html_text.spans(w) == [(1, 2), (5, 9)]
    assert html_text.spans([]) == [] and html_text.spans([0, 0]) == []


def plain_alignment(template, words):
    """(first, last, matched) of the best local alignment over all cells, row by row."""
    above, best = {}, ((0, 0, 0, 0), -1)
    for t in template:
        row = {}
        for j, w in enumerate(words):
            zero = (0, 0, 0)
            ways = []
            s, m, f = above.get(j - 1, zero)
            if w == t:
                ways.append((s + 2, m + 1, f if s else -j))
            else:
                ways.append((s - 1, m, f))
            for s, m, f in (above.get(j, zero), row.get(j - 1, zero)):
                ways.append((s - 1, m, f))
            row[j] = max(max(ways), zero) if max(ways)[0] > 0 else zero
            if row[j] > best[0][:3]:
                best = ((*row[j], 0), j)
        above = row
    return (-best[0][2], best[1], best[0][1]) if best[1] >= 0 else None


def test_alignment_equals_the_plain_one():
    rng = random.Random(12)
    for _ in range(300):
        template = [rng.randrange(6) for _ in range(rng.randint(1, 14))]
        words = [rng.randrange(8) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            part = [w for w in template if rng.random() < 0.9]
            words[len(words) // 2 : len(words) // 2] = part
        found = license.align(np.array(template), np.array(words, np.int64), -len(template), len(words), 0, len(words))
        assert found == plain_alignment(template, words)


def test_license_spans(spark):
    rng = random.Random(7)
    index = license.Index()
    filler = lambda n: " ".join("".join(rng.choice("etaoins") for _ in range(5)) for _ in range(n))
    texts, planted = [None, "", "no license here, only words"], {}
    for name, notice in license.TEMPLATES.items():
        tokens = notice.split()
        if len(tokens) > 20:
            tokens[len(tokens) // 2] = "otherwise"
            del tokens[len(tokens) // 3]
        planted[len(texts)] = name
        texts.append(f"é {filler(30)}\n{' '.join(tokens)}\n{filler(30)}")
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    rows = license.scan(df).collect()
    assert {r.doc_id for r in rows} == set(planted) and len(rows) == len(planted)
    for r in rows:
        name, words = planted[r.doc_id], license.tokens(texts[r.doc_id])
        assert r.license == name and r.coverage >= 0.9
        first, last, matched = plain_alignment(index.templates[name], words)
        assert (r.matched, r.length) == (matched, len(index.templates[name]))
        assert license.tokens(texts[r.doc_id][r.start : r.end]) == words[first : last + 1]
    twice = spark.createDataFrame([(1, "Released under the MIT License. " + filler(20) + " Released under the MIT License.")], "doc_id long, text string")
    assert license.scan(twice).count() == 2 and license.scan(df.limit(0)).count() == 0


def test_overlapping_licenses_give_the_best():
    index = license.Index()

    def found(text):
        words = license.tokens(text)
        hits = license._hits(license.Words([license.utf8(text).translate(license.LOWER)], license._BETWEEN), index)
        return [(m.license, m.first) for m in index.match(words, hits.get(0, []))]

    for name in ("CC-BY-4.0", "CC-BY-SA-4.0", "Apache-2.0-header", "MIT", "MIT-permission", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0-notice"):
        assert found("one two " + license.TEMPLATES[name] + " three") == [(name, 2)], name
    copies = " ".join(["Released under the MIT License."] * 300)  # copies next to each other, ties throughout
    assert found(copies) == [("MIT-notice", 5 * k) for k in range(300)]
    long = " ".join(f"w{k}" for k in range(200_000)) + " Licensed under CC BY-NC 4.0. " + license.TEMPLATES["Zlib"]
    assert found(long) == [("CC-BY-NC-4.0-notice", 200_000), ("Zlib", 200_007)]
    assert found("") == []
