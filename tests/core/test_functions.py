"""Text and value functions on the cases that their definitions name."""

import pytest
from pyspark.sql import functions as F

from plumeria.functions import text as T
from plumeria.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("  Ab \n c ", "ab c"), ("„x« — y−z", '"x" - y-z'), ("don’t “x”", "don’t “x”"), (None, "")])
def test_normalize(spark, given, want):
    assert one(spark, T.normalize_for_dedup(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given, n, want", [("short", 10, "short"), ("aaaa bbbbb cccc", 12, "aaaa bbbbb..."), ("a " + "b" * 30, 20, "a " + "b" * 18 + "...")])
def test_truncate(spark, given, n, want):
    assert one(spark, T.truncate(F.lit(given), n)) == want


def test_combine(spark):
    made = lambda c, a: one(spark, T.combine(F.lit(c).cast("string"), F.array(*map(F.lit, a)).cast("array<string>")))
    assert made(" x ", ["a", "", "b"]).full_text == "x\n\n--- ATTACHMENT CONTENT ---\na\n\n--- NEXT ATTACHMENT ---\n\nb"
    assert made("", ["a"]).full_text == "a" and made("", ["a"]).text_source == "comment+attachments"
    assert made(None, []).full_text == "" and made(None, []).text_source == "comment"


def test_html(spark):
    assert one(spark, T.strip_html(F.lit("<a\nb>x</a> &amp;lt; &copy;"))) == "x &lt; ©"
    assert one(spark, T.strip_tags(F.lit("<a\nb>x</a>"))) == "<a\nb>x"


@pytest.mark.parametrize("url, name, want", [("", "a.PDF", "application/pdf"), ("", "a.docx", T.MIME_TYPES["docx"]), ("http://x/y.rtf?z", "file", "application/rtf"), ("http://x/y", "file", "application/octet-stream")])
def test_mime(spark, url, name, want):
    assert one(spark, T.mime_type(F.lit(url), F.lit(name))) == want


def test_snippets(spark):
    text = "x" * 60 + "Needle" + "y" * 100 + "needle" + "z" * 60
    got = one(spark, T.snippets(F.lit(text), "needle"))
    assert got == "..." + "x" * 40 + "Needle" + "y" * 40 + "... ••• ..." + "y" * 40 + "needle" + "z" * 40 + "..."
    assert one(spark, T.snippets(F.lit("a" * 200), "needle")) == "a" * 100 + "..."


def test_smart_truncate(spark):
    text = "a" * 100 + "needle" + "b" * 100
    assert one(spark, T.smart_truncate(F.lit(text), 30)) == "a" * 30 + "..."
    assert "needle" in one(spark, T.smart_truncate(F.lit(text), 30, "NEEDLE"))


@pytest.mark.parametrize("given, want", [("2024-01-01T10:00Z", True), ("2024-01-01T10:00:05Z", True), ("2024-01-01", False), ("2024-13-01T10:00Z", False), (None, False)])
def test_iso_dates(spark, given, want):
    assert one(spark, V.is_iso_date(F.lit(given).cast("string"))) is want


@pytest.mark.parametrize("n, want", [(None, "1"), (0, "50+"), (1, "1"), (2, "2-10"), (10, "2-10"), (11, "11-50"), (50, "11-50"), (51, "50+")])
def test_buckets(spark, n, want):
    assert one(spark, V.count_bucket(F.lit(n).cast("int"))) == want


def test_lists_and_codes(spark):
    assert [a.title for a in one(spark, T.attachments_of(F.lit("http://x/a.pdf, ,http://x/b.txt")))] == ["a.pdf", "b.txt"]
    assert [tuple(x) for x in one(spark, T.zip_links(F.lit("u1; u2"), F.lit("t1")))] == [("u1", "t1"), ("u2", "Attachment")]
    assert one(spark, V.child_code(F.lit("0a"), F.lit(2))) == "0ac"
    assert one(spark, V.colour_index(F.lit(1), F.lit("b"))) == 21
    assert T.wrap("aa bb cc", 5) == "aa bb\ncc"
    assert one(spark, T.json_object(F.lit('so: {"a":\n{"b": 1}} end'))) == '{"a":\n{"b": 1}}'
    assert one(spark, V.usable_text(F.lit("[error] " + "x" * 200))) is False


def test_character_references(spark):
    import html

    texts = ["a &rsquo;b&lsquo; &amp;lt;", "&lt;b&gt; &copy; &amp;", "&notit; &copy &#x41;&#66; &#128;", "&amp;rsquo; & x", "R&D &unknown;", "", None, "&nbsp;x", "<p\n>&hellip;</p>"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.x for r in rows.select("k", T.strip_html(F.col("t")).alias("x")).collect()}
    assert [got[k] for k in range(len(texts))] == [t if t is None else html.unescape(t.replace("<p\n>", "").replace("</p>", "")) for t in texts]


def test_types_by_name(spark):
    import mimetypes

    known = mimetypes.MimeTypes(())
    names = ["a.png", "b.JPG", "c.mp4", "d.tar.gz", "e.tgz", "f.json", "g.xml", "h.gif.bz2", "i.css", "j.svgz"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.m for r in rows.select("n", T.mime_type(F.lit("http://x"), F.col("n")).alias("m")).collect()} == {n: known.guess_type(n)[0] for n in names}
    of = lambda url, name: one(spark, T.mime_type(F.lit(url), F.lit(name)))
    assert of("http://x/a.DOCX?b", "a") == "application/msword" and of("http://x/a.pdf", "a.unheard") == "application/pdf" and of("http://x", "a") == "application/octet-stream"
    assert of("http://x", "a.docx").endswith("wordprocessingml.document") and of("http://x", "a.rtf") == "application/rtf"


def test_quote_report(spark, tmp_path):
    from plumeria.operators import quotes
    from plumeria.sources import writers

    rows = [("l2", 3, ["a", "b", "c", "d", "e", "f"], "never said at all", "word " * 40), ("l1", 1, ["g"], "was it", "Here it was it."), ("l3", 2, ["h"], "HERE IT WAS SAID, PLAINLY", "So here it was said, plainly."), ("l4", None, [], None, "x"), ("l0", 1, ["i"], "gone", "text")]
    lookup = spark.createDataFrame(rows, "lookup_id string, comment_count int, comment_ids array<string>, key_quote string, truncated_text string")
    writers.quote_report(quotes.report(quotes.verify(lookup)), str(tmp_path / "r"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*")))
    assert "Total lookup entries: 5\nTotal comments represented: 7\nLookup entries with quotes: 4\nQuotes found (exact): 1 (25.0%)\nQuotes found (similar): 1 (25.0%)\nQuotes NOT found: 2 (50.0%)\nOverall verification rate: 50.0%\n" in text
    assert "QUOTES NOT FOUND (2 entries)" in text and "QUOTES WITH SIMILAR MATCHES (1 entries)" in text
    assert text.index("SUMMARY") < text.index("1. Lookup ID: l0") < text.index("2. Lookup ID: l2") < text.index("1. Lookup ID: l3")
    assert "   Comment IDs: a, b, c, d, e...\n\n   QUOTE: \"never said at all\"\n\n   TRUNCATED TEXT (200 characters):\n   word word" in text
    assert max(map(len, text.split("\n"))) == 80
    assert quotes.report(quotes.verify(lookup.limit(0))).count() == 1
