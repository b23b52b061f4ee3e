"""Pages, archives and vectors."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kinetoflow.llm import ann, html_text, warc

PAGES = "page_id long, url string, html string, key string"


def test_main_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class='ad'>Buy, now.</div><article><h1>A &amp; B</h1><p><b>Bold<br><p>First, one.\n  Second; two.</p><p>Bo<i>ld</i>er &lt;b&gt;.</p><script>x='<p>no</p>'</script></article><div id=comments><p>Great, really great.</p></div><aside>More, here.</aside><form><p>Sign up, please.</p></form><footer>&copy; 2024.</footer></body>"
    assert html_text.main_text(page) == "A & B Bold First, one. Second; two. Bolder <b>."
    for source, text in ((None, ""), ("", ""), ("just text", "just text"), ("<p>open, text", "open, text"), ("<script>x</script>", ""), ("<!-- c -->a<!-- open", "a"), ("<p>1 &lt; 2 & 3 > 2.", "1 < 2 & 3 > 2.")):
        assert html_text.main_text(source) == text
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert len(html_text.main_text(long)) == 20_000 * 12 - 1 + 0


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a, b.", "x"), (1, "u", "<p>a, b.", "x"), (None, None, "", None)], PAGES)
    assert sorted(r["text"] for r in html_text.extract(df).collect()) == ["", "", "a, b.", "a, b."]
    assert html_text.extract(df.limit(0)).count() == 0


def test_archive_round_trip(spark):
    rows = [(3, "u3", "same", None), (1, "u1", "same", None), (2, None, "é" * 50, None), (4, "u4", None, None), (5, "u5", "", None), (None, "n", "same", None), (6, "a\r\nb", "other", None), (6, "a\r\nb", "other", None)]
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(1, "response", None, 4), (3, "revisit", 1, 4), (None, "revisit", 1, 4), (2, "response", None, 100), (4, "response", None, 0), (5, "revisit", 4, 0), (6, "response", None, 5)}
    small = {(r["page_id"], r["record_type"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGES), least=5).collect()}
    assert (3, "response") in small and (5, "response") in small
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_salvage():
    records = [warc.page_record(i, f"u{i}", f"payload {i} ".encode() * 20, warc.digest(f"payload {i} ".encode() * 20), None, False) for i in range(6)]
    for make in (lambda r: r, warc.member):
        parts = [make(r) for r in records]
        whole = list(warc.salvage(b"".join(parts)))
        assert [r["headers"]["x-page-id"] for r in whole] == list("012345") and not any(r["gap"] for r in whole)
        rnd = random.Random(8)
        for _ in range(30):
            hurt = [bytearray(p) for p in parts]
            k = rnd.randrange(6)
            at = rnd.randrange(len(hurt[k]) - 8)
            kind = rnd.randrange(3)
            if kind == 0:
                hurt[k][at : at + 6] = bytes(6)
            elif kind == 1:
                del hurt[k][at : at + 9]
            else:
                hurt[k][0:0] = b"junk\r\n"
            data = b"".join(map(bytes, hurt))
            out = list(warc.salvage(data))
            ids = [r["headers"].get("x-page-id") for r in out if not r["gap"]]
            assert set("012345") - set(ids) <= {str(k)}
            spans = sorted({(r["offset"], r["length"]) for r in out})
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(data)
    assert list(warc.salvage(b"")) == [] and [r["gap"] for r in warc.salvage(b"no archive")] == [True]
    large = bytes(warc.member(warc.record_bytes([("WARC-Type", "resource")], b"x" * (17 << 20))))
    assert large[-1] == 0 and len(list(warc.salvage(large))) == 1


def test_search(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16))
    x[300:700] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (None, x[0].tolist()), (40, x[40].tolist()), (2080, [1.0, 2.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    recall = []
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11)) and len({r["vec_id"] for r in got}) == 10 and q not in {r["vec_id"] for r in got}
        assert all(abs(r["score"] - float(x[q] @ x[r["vec_id"]])) < 1e-9 for r in got)
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-round(s[i], 9), i))[:10]
        recall.append(len(set(best) & {r["vec_id"] for r in got}) / 10)
        if 300 < q < 700:  # equal vectors: the smallest ids
            assert [r["vec_id"] for r in got] == best
    assert np.mean(recall) >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_main_text_outside_the_container():
    body = "".join(f"<p>Sentence {i}, with words, and more of them; it goes on.</p>" for i in range(40))
    page = f"<body><nav>Menu</nav><div id=main><h1>Title</h1><div class=lead><p>The lead, short, comes first.</p></div><div class=body>{body}</div></div><footer>End</footer></body>"
    text = html_text.main_text(page)
    assert text.startswith("Title The lead, short, comes first. Sentence 0,") and text.endswith("it goes on.") and "Menu" not in text and "Sentence 39," in text


def test_salvage_inside_members():
    rnd = random.Random(18)
    payloads = [rnd.randbytes(3000) for _ in range(6)]
    records = [warc.page_record(i, f"u{i}", p, warc.digest(p), None, False) for i, p in enumerate(payloads)]
    hurt = records[2].replace(payloads[2][:100], bytes(100))
    one = warc.member(b"".join([*records[:2], hurt, *records[3:]]))
    whole = warc.member(b"".join(records))
    ids = lambda data: [r["headers"]["x-page-id"] for r in warc.salvage(data) if not r["gap"]]
    assert ids(one) == list("01345") and sum(r["gap"] for r in warc.salvage(one)) == 1
    assert ids(whole[: len(whole) * 3 // 5]) == list("012")
    bad = bytearray(zlib.compress(b"".join(records), wbits=31))
    bad[-6] ^= 1
    assert ids(bytes(bad)) == list("012345") and any(r["gap"] for r in warc.salvage(bytes(bad)))
    url = "http://x/" + "a" * 70_000
    for make in (lambda r: r, warc.member):
        (got,) = warc.salvage(make(warc.page_record(9, url, b"text", warc.digest(b"text"), None, False)))
        assert got["headers"]["warc-target-uri"] == url
