"""Attachments through the data source and the download hook, and docket files read in their own order."""

import os

from plumeria.schemas import RAW_COMMENT
from plumeria.sources import downloads as d
from plumeria.sources import readers


class Flaky(d.FolderConnector):
    """Fails the first two times that a file is asked for in a process; ``never`` always."""

    asked: dict = {}  # noqa: RUF012

    def get(self, url):
        n = self.asked[url] = self.asked.get(url, 0) + 1
        if n <= 2 or "never" in url:
            raise OSError("planted")
        return super().get(url)


def files(folder, names):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        (folder / n).write_text(f"text of {n}")
    return folder


def test_source_reads_a_folder_and_retries(spark, tmp_path):
    root = files(tmp_path / "a", ["one.txt", "two", "never.pdf"])
    spark.dataSource.register(d.AttachmentSource)
    read = lambda **o: {os.path.basename(r.url): r for r in spark.read.format("attachments").options(firstDelay=0.0, **o).load(str(root)).collect()}
    plain = read(slices=3)
    assert bytes(plain["two"].content) == b"text of two" and plain["two"].name.endswith(".txt") and {r.attempts for r in plain.values()} == {1}
    flaky = read(connector="tests.core.test_downloads:Flaky", slices=2, attempts=4)
    assert bytes(flaky["one.txt"].content) == b"text of one.txt" and flaky["one.txt"].attempts == 3 and flaky["one.txt"].error is None
    assert flaky["never.pdf"].content is None and flaky["never.pdf"].attempts == 4 and "planted" in flaky["never.pdf"].error
    assert flaky["one.txt"].name == plain["one.txt"].name  # of the URL alone


def test_delays_and_names():
    waits = list(d.waits(10))
    assert len(waits) == 9 and all(min(2**k, 60) <= w <= min(2**k + 1, 60) for k, w in enumerate(waits))
    slept = []
    assert d.persistent(lambda: 1 / 0, 3, slept.append)[:2] == (None, 3) and len(slept) == 2
    assert d.file_name("http://x.org/a%20b.PDF?q=1").startswith("a b_") and d.file_name("http://x.org/a%20b.PDF?q=1").endswith(".PDF")
    assert d.file_name("http://x.org/a.pdf") != d.file_name("http://y.org/a.pdf") and d.file_name("http://x.org/").endswith(".txt")


def test_downloads_repeat_without_fetching_again(spark, tmp_path):
    root, out = files(tmp_path / "a", ["x.txt", "y.txt"]), str(tmp_path / "out")
    rows = [(c, str(root / f) if f else None) for c, f in (("C-1", "x.txt"), ("C-1", "x.txt"), ("C-2", "y.txt"), ("C-3", "missing.txt"), ("C-4", None))]
    df = spark.createDataFrame(rows, "id string, url string")
    get = lambda: {(r.id, os.path.basename(r.url)): r for r in d.download(df, d.FolderConnector(str(root)), out, attempts=2, concurrency=2, sleep=lambda s: None).collect()}
    first, again = get(), get()
    assert len(first) == 3 and {k: r.attempts for k, r in first.items()} == {("C-1", "x.txt"): 1, ("C-2", "y.txt"): 1, ("C-3", "missing.txt"): 2}
    assert again["C-1", "x.txt"].attempts == 0 and again["C-1", "x.txt"].path == first["C-1", "x.txt"].path and again["C-3", "missing.txt"].path is None
    assert sorted(len(f) for _, _, f in os.walk(out)) == [0, 1, 1]  # nothing half written stays


def test_texts_are_kept_beside_the_files(spark, tmp_path):
    root, out = files(tmp_path / "a", ["x.txt", "y.bad"]), str(tmp_path / "out")
    attributes = {"attachments": [{"title": "t", "fileUrl": str(root / "y.bad")}, {"title": "u", "fileUrl": str(root / "x.txt")}]}
    comments = spark.createDataFrame([("C-1", attributes), ("C-2", {"attachments": []})], RAW_COMMENT)

    def extract(content, path):
        if ".bad" in path:
            raise ValueError("unreadable")
        return content.decode().upper()

    get = lambda f: {r.id: [t.text for t in r.attachment_texts] for r in d.fetch_texts(comments, d.FolderConnector(str(root)), out, f, attempts=1).collect()}
    assert get(extract) == {"C-1": ["[extraction failed: unreadable]", "TEXT OF X.TXT"]}
    assert get(lambda content, path: "new") == {"C-1": ["new", "TEXT OF X.TXT"]}  # the failed one only


def test_csv_ids_follow_the_files_at_any_partitioning(spark, tmp_path):
    for k, name in enumerate(["b.csv", "a.csv"]):
        (tmp_path / name).write_text("Title,Comment\n" + "".join(f"t{k}-{i},\"line {i}\nmore\"\n" for i in range(40)))
    want = {f"comment_{n}": f"t{k}-{i}" for n, (k, i) in enumerate([(1, i) for i in range(40)] + [(0, i) for i in range(40)])}
    for size in ("128m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            raw = readers.comments_from_csv(readers.docket_csv(spark, str(tmp_path)))
            assert {r.id: r.attributes.title for r in raw.collect()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    limited = readers.comments_from_csv(readers.docket_csv(spark, str(tmp_path)), limit=3)
    assert sorted(r.attributes.title for r in limited.collect()) == ["t1-0", "t1-1", "t1-2"]
    assert [r.id for r in readers.comments_from_csv(spark.createDataFrame([("x",)], "Title string")).collect()] == ["comment_0"]


def test_broken_quoting_is_read_plainly(spark, tmp_path):
    good, odd, wide = (tmp_path / n for n in ("good.csv", "odd.csv", "wide.csv"))
    good.write_text('Document ID,Comment\nA-1,"a, ""b""\nc"\nA-2,d\n')
    odd.write_text('Document ID,Comment\nA-1,"open\nA-2,d\nA-3,e\n')
    wide.write_text('Document ID,Comment\nA-1,a "b", c\nA-2,d\n')
    assert [readers.broken_quoting(spark, str(p)) for p in (good, odd, wide)] == [False, True, True]
    assert {r.Comment for r in readers.docket_csv(spark, str(good)).collect()} == {'a, "b"\nc', "d"}
    assert {r["Document ID"]: r.Comment for r in readers.docket_csv(spark, str(odd)).collect()} == {"A-1": '"open', "A-2": "d", "A-3": "e"}
    assert [r["Document ID"] for r in readers.docket_csv(spark, str(wide)).collect()] == ["A-2"]  # the bad line is skipped
