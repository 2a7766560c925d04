"""Texts of office files, vectors by a loaded model and its ledger, and texts rebuilt from members."""

import io
import random
import time
import zipfile

import numpy as np
import pytest

from plumeria.operators import embeddings as e
from plumeria.operators import enrich, joins
from plumeria.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_paragraphs():
    body = '<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>One &amp;</w:t><w:tab/><w:t xml:space="preserve"> é</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:p/>'
    body += p("two") + "<w:p><w:r><w:delText>gone</w:delText></w:r><w:r><w:br w:type='page'/><w:t>a</w:t><w:noBreakHyphen/><w:t>b</w:t></w:r></w:p>"
    assert office.docx_text(docx(body)) == "One &\t é\nlink\n\ntwo\na-b"
    assert office.docx_text(docx("<w:p><w:r><w:t>out</w:t><w:drawing><w:txbxContent>" + p("box") + "</w:txbxContent></w:drawing><w:t>side</w:t></w:r></w:p>")) == "outside"


def test_docx_tables():
    inner = f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>"
    body = p("before") + f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{inner}{p('')}</w:tc></w:tr><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl>" + p("after")
    assert office.docx_text(docx(body)) == "before\nafter"
    assert office.docx_text(docx(body), tables=True) == "before\na b\tx\ty \nc\nafter"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (rb"{\rtf1\ansi plain \b bold\b0  text\par next\line x}", "plain bold text\nnext\nx"),
        (rb"{\rtf1\ansi\ansicpg1252 caf\'e9 \{\\\}}", "café {\\}"),
        (rb"{\rtf1\ansi{\fonttbl{\f0 A;}{\f1\fcharset204 B;}}\f0 \'e9{\f1 \'e9}\'e9}", "éйé"),
        (rb"{\rtf1\ansi{\fonttbl{\f2\fcharset128 C;}}{\f2 \'93\'fa\'96\'7b}}", "日本"),
        (rb"{\rtf1\uc1\u8364?\u-10179 ?\u-8704 ?{\uc2\u233\'c3\'a9}{\uc0\u233}x}", "€😀ééx"),
        (rb"{\rtf1{\*\generator Z{deep {\b er}}}{\info{\title T}}{\pict\bin5 }}{}\\a}b{\header h}c}", "bc"),
        (rb"{\rtf1 a{\field{\*\fldinst HYPERLINK x}{\fldrslt shown}}\~b\_c\-d}", "ashown\xa0b-cd"),
        (rb"{\rtf1\trowd 1\cell 2\cell\row after}", "1|2|\nafter"),
        (b"{\\rtf1 a\r\nb\\\nc} trailing", "ab\nc"),
        (rb"{\rtf1{{{deep}}} unclosed", "deep unclosed"),
    ],
)
def test_rtf(source, want):
    assert office.rtf_text(source) == want


def test_rtf_of_any_text_comes_back():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", " ", "\\", "{", "}", "é", "日", "😀", "?", "1", "-"]) for _ in range(rng.randrange(60)))
        units = np.frombuffer(text.encode("utf-16-le"), np.int16)
        body = "".join("\\" + chr(u) if chr(u % 65536) in "\\{}" else chr(u) if 0 < u < 128 else f"\\u{u}?" for u in units.tolist())
        assert office.rtf_text(("{\\rtf1 " + body + "}").encode()) == text


def test_long_and_broken_files():
    begun = time.time()
    assert len(office.rtf_text(b"{\\rtf1 " + b"\\'e9{\\b x}" * 300_000 + b"}")) == 600_000
    assert len(office.rtf_text(b"{\\rtf1 " + b"{" * 200_000 + b"x" + b"}" * 200_000 + b"}")) == 1
    assert time.time() - begun < 20
    assert office.local_text(b"no", "a.RTF").startswith("[RTF EXTRACTION FAILED: ") and office.local_text(b"no", "a.docx").startswith("[DOCX EXTRACTION FAILED: ")
    assert office.local_text(docx(""), "a.docx") == office.EMPTY_DOCX and office.local_text(b"{\\rtf1 }", "x/a.rtf") == office.EMPTY_RTF
    assert office.local_text(b" \n", "a.txt") == office.EMPTY_TEXT and office.local_text(b"a\r\nb\xff", "a.log") == "a\nb"
    assert office.local_text(b"", "a.png") == "[UNSUPPORTED FILE TYPE: .PNG]" and office.local_text(b"", "a") == "[UNSUPPORTED FILE TYPE: ]"


def test_extraction_runs_in_tasks(spark):
    files = spark.createDataFrame([("a.docx", bytearray(docx(p("x")))), ("b.rtf", bytearray(b"{\\rtf1 y}"))], "path string, content binary")
    assert {r.path: r.text for r in enrich.extract(files, office.local_text).collect()} == {"a.docx": "x", "b.rtf": "y"}


class Counting(e.HashedEncoder):
    """Writes a line to ``folder`` for each text that it encodes."""

    folder = ""
    version = "1"

    @property
    def key(self):
        return f"counting-{self.folder}-{self.version}"

    def load(self):
        encode, folder = super().load(), self.folder

        def counted(texts):
            with open(f"{folder}/seen", "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return encode(texts)

        return counted


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "A b, a"), (2, None), (3, ""), (4, "É"), (5, "a a b")], "id int, text string")
    found = {r.id: np.array(r.embedding) for r in e.embed(rows, "text", e.HashedEncoder(16), batch_size=2).collect()}
    assert np.allclose(found[1], found[5]) and np.isclose(np.linalg.norm(found[1]), 1) and not found[2].any() and not found[3].any() and not found[4].any()
    assert e.embed(rows.limit(0), "text", e.HashedEncoder()).count() == 0


def test_model_is_loaded_once_a_process():
    loads = []

    class Once(e.HashedEncoder):
        def load(self):
            loads.append(1)
            return super().load()

    assert e.loaded(Once(7)) is e.loaded(Once(7)) and len(loads) == 1
    e.loaded(Once(8))
    assert len(loads) == 2


def test_only_new_texts_are_encoded(spark, tmp_path):
    encoder = Counting(16)
    object.__setattr__(encoder, "folder", str(tmp_path))
    seen = lambda: sorted((tmp_path / "seen").read_text().splitlines())
    first = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "a", 0), (4, None, 0)], "id int, text string, embedding int")
    out = e.embed_resumable(first, "text", encoder, str(tmp_path / "v"), every=2)
    assert {r.id: np.argmax(r.embedding) for r in out.filter("id < 4").collect()} == {r.id: np.argmax(r.embedding) for r in e.embed(first, "text", e.HashedEncoder(16)).filter("id < 4").collect()}
    assert seen() == ["", "a", "b"] and out.count() == 4 and set(out.columns) == {"id", "text", "embedding"}
    grown = first.unionByName(spark.createDataFrame([(5, "c", 0)], first.schema))
    assert e.embed_resumable(grown, "text", encoder, str(tmp_path / "v")).filter("embedding is null").count() == 0
    assert seen() == ["", "a", "b", "c"]
    object.__setattr__(encoder, "version", "2")
    e.embed_resumable(grown, "text", encoder, str(tmp_path / "v"))
    assert len(seen()) == 8


def test_rebuilt_texts_match_a_plain_loop(spark):
    rng = random.Random(5)
    members = [(i, i, f"l{min(rng.randrange(12), 8)}") for i in range(300)]
    said = {i: rng.choice(["", None, "x" * rng.randrange(1, 9), "é y"]) for i in range(300)}
    files = [(i, f"f{k}", rng.choice([None, "", " z\n", "w" * rng.randrange(30)])) for i in range(300) for k in range(rng.randrange(3))]
    updated = [i for i, _, g in members if g in ("l1", "l8")][:40]
    lookup = spark.createDataFrame([(f"l{k}", "old", "was") for k in range(10)], "lookup_id string, truncated_text string, text_source string")
    frames = (spark.createDataFrame(members, "id int, seq int, lookup_id string"), spark.createDataFrame(list(said.items()), "id int, comment string"), spark.createDataFrame(files, "id int, name string, text string"), spark.createDataFrame([(i,) for i in updated], "id int"))
    for most in (5, 7, 100, 1000):
        got = {r.lookup_id: (r.truncated_text, r.text_source) for r in joins.rebuilt_texts(lookup, *frames, most=most).collect()}
        touched = {g for i, _, g in members if i in updated}
        for k in (f"l{n}" for n in range(10)):
            if k not in touched:
                assert got[k] == ("old", "was")
                continue
            ids = [i for i, _, g in members if g == k]
            pieces = [x for i in ids for x in [said[i], *((t or "").strip() for j, _, t in files if j == i)] if x]
            talk, kept = any(said[i] for i in ids), any(j in ids for j, _, _ in files)
            assert got[k] == ("\n\n".join(pieces)[:most], "both" if talk and kept else "attachment" if kept else "comment")


def test_batch_takes_an_encoder(spark, tmp_path):
    from plumeria.plans.batch import batch
    from plumeria.schemas import RAW_COMMENT
    from plumeria.sources import readers

    head = "Document ID,Title,Comment,First Name,Last Name,Attachment Files,Posted Date,Received Date,Agency ID"
    rows = [f'X-1-000{k},T,"{t}",A,B,,2024-01-01T00:00Z,2024-01-01T00:00Z,X' for k, t in enumerate(["red green", "red green", "blue sky above"], 1)]
    (tmp_path / "d.csv").write_text("\n".join([head, *rows]))
    raw = readers.comments_from_csv(readers.docket_csv(spark, str(tmp_path / "d.csv")))
    assert [f.name for f in raw.schema] == [f.name for f in RAW_COMMENT]
    done = batch(raw, str(tmp_path / "r"), encoder=e.HashedEncoder(16))
    assert done["data"].count() == 3
    assert spark.read.parquet(str(tmp_path / "r" / "embeddings")).selectExpr("size(embedding) AS n").distinct().first().n == 16
    assert e.vector_ledger(raw, e.HashedEncoder(16), str(tmp_path / "r" / "vectors")).read().count() == 2


def test_escapes_in_a_row_are_read_at_once(monkeypatch):
    """Also where some of them are substitutes of a character before, silent, or broken."""
    body = rb"\uc2 a\u233\'e9\'e9\'e8b{\*\x \'41\'42}\'41\'zz\'4"
    assert office.rtf_text(rb"{\rtf1\ansi " + body + b"}").startswith("aéèbA")
    matches = []

    class Counted:
        def match(self, *args):
            matches.append(args)
            return pattern.match(*args)

    pattern = office._RTF
    monkeypatch.setattr(office, "_RTF", Counted())
    assert office.rtf_text(rb"{\rtf1 " + rb"\'41" * 5_000 + b"}") == "A" * 5_000 and len(matches) < 10
