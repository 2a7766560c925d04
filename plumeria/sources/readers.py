"""Readers: docket CSV, nested JSON, lookup tables, cluster descriptions, attachments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attachments_of, trim_ws
from ..ledger import Ledger
from ..operators.dedup import numbered
from ..schemas import LOOKUP, RAW_COMMENT

# Extensions of attachments that can be extracted again.
RETRY_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp")
MINIMAL_TEXT = 100


def docket_csv(spark: SparkSession, path: str, plain: bool | None = None) -> DataFrame:
    """All columns as text. ``plain`` takes quotes as characters, for files with broken quoting, and skips bad lines; None finds out whether it is needed."""
    if plain is None:
        plain = broken_quoting(spark, path)
    reader = spark.read.option("header", True).option("multiLine", not plain).option("escape", '"')
    return (reader.option("quote", "").option("mode", "DROPMALFORMED") if plain else reader).csv(path)


def broken_quoting(spark: SparkSession, path: str) -> bool:
    """Whether a file's quotes don't pair, or a record of it has more fields than there are columns."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    if lines.groupBy("f").agg(F.sum("n").alias("n")).filter("n % 2 = 1").limit(1).count():
        return True
    columns = docket_csv(spark, path, False).columns
    schema = ", ".join(f"c{k} string" for k in range(len(columns) + 1))  # a field more than there are columns
    wide = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return bool(wide.filter(F.col(f"c{len(columns)}").isNotNull()).limit(1).count())


def in_file_order(csv: DataFrame, name: str = "row_number") -> DataFrame:
    """``csv`` with 1-based row numbers in the order of files' names and of the rows in them, however the files are split; rows that are no file's are numbered as they come."""
    try:
        at = csv.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    except AnalysisException:  # rows of no file
        at = csv.select("*", F.lit("").alias("_file"), F.lit(0).alias("_start"))
    return numbered(at.withColumn("_row", F.monotonically_increasing_id()), ["_file", "_start", "_row"], name).drop("_file", "_start", "_row")


def comments_from_csv(csv: DataFrame, rule_ids: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Nested comments (id, attributes) of a docket CSV.

    The rule document is left out by id. Nulls become ''. Null ids become ``nan``, so they are one id from
    there on. Without a ``Document ID`` column ids are ``comment_`` and the row's number in the files, from 0.
    ``limit`` takes the first rows of the files.
    """
    if limit is not None or "Document ID" not in csv.columns:
        csv = in_file_order(csv, "_number")
    cell = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) if n in csv.columns else F.lit("")
    key = F.coalesce(F.col("`Document ID`"), F.lit("nan")) if "Document ID" in csv.columns else F.concat(F.lit("comment_"), (F.col("_number") - 1).cast("string"))
    attachments = attachments_of(cell("Attachment Files"))
    attributes = F.struct(
        cell("Title").alias("title"), cell("Comment on Document ID").alias("commentOn"), cell("Posted Date").alias("postedDate"), cell("Received Date").alias("receivedDate"),
        trim_ws(F.concat(cell("First Name"), F.lit(" "), cell("Last Name"))).alias("submitterName"), cell("Organization Name").alias("organization"), cell("City").alias("city"), cell("State/Province").alias("state"),
        cell("Country").alias("country"), cell("Comment").alias("comment"), cell("Document Type").alias("documentType"), cell("Agency ID").alias("agencyId"), cell("Category").alias("category"),
        F.size(attachments).alias("attachmentCount"), attachments.alias("attachments"), F.lit(None).cast(RAW_COMMENT["attributes"].dataType["attachment_texts"].dataType).alias("attachment_texts"),
    )
    kept = csv.filter(~key.isin(*rule_ids) if rule_ids else F.lit(True))
    kept = kept.orderBy("_number").limit(limit) if limit is not None else kept
    return kept.select(key.alias("id"), attributes.alias("attributes"))


def csv_ids(csv: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct ids: ``Comment ID``, else ``Document ID``; blank ones are left out."""
    names = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in ("Comment ID", "Document ID") if n in csv.columns]
    out = csv.select(F.coalesce(*names, F.lit(None).cast("string")).alias("id")).filter("id is not null").distinct()
    return out.orderBy("id").limit(limit) if limit else out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_table(spark: SparkSession, path: str, schema, required: bool = True) -> DataFrame:
    """An array of objects, or one object; a missing optional file is an empty table."""
    if not required and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def raw_comments(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    return json_table(spark, path, RAW_COMMENT, required)


def lookup_table(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    return json_table(spark, path, LOOKUP, required)


def clusterable(lookup: DataFrame) -> DataFrame:
    """Rows with a text and an id."""
    return lookup.filter((trim_ws(F.coalesce("truncated_text", F.lit(""))) != "") & (F.coalesce("lookup_id", F.lit("")) != ""))


def clusterable_stats(lookup: DataFrame) -> DataFrame:
    rows = clusterable(lookup)
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.coalesce("stance", F.lit("")) != "").alias("analysed"), F.sum("comment_count").alias("comments"))


def cluster_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, title, description) of a JSON object of pairs."""
    parsed = F.from_json("value", "map<string,array<string>>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("cluster_id", "d")).select("cluster_id", F.get("d", F.lit(0)).alias("title"), F.get("d", F.lit(1)).alias("description"))


def cluster_report(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, level, total_comments) of a text report: headings at 0, 2 or 4 spaces."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n(?= *CLUSTER )")).alias("part"))
    head = r"^( *)CLUSTER ([0-9a-z]+)"
    found = lines.select((F.length(F.regexp_extract("part", head, 1)) / 2).cast("int").alias("level"), F.regexp_extract("part", head, 2).alias("cluster_id"), F.regexp_extract("part", r"Total comments: (\d+)", 1).try_cast("long").alias("total_comments"))
    return found.filter("cluster_id != ''")


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """(path, comment_id, ext, size, text) of ``<comment_id>/<file>`` below a folder; text only of text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    ext = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    text = F.when(ext.isin(".txt", ".csv", ".log", ".md"), F.decode("content", "UTF-8"))
    return files.select("path", F.element_at(parts, -2).alias("comment_id"), ext.alias("ext"), F.col("length").alias("size"), text.alias("text"))


def failed_attachments(files: DataFrame) -> DataFrame:
    """Files of ``files`` (path, ext, text) that need extraction: no sidecar text, or one that is too short."""
    suffix = ".extracted.txt"
    sidecars = files.filter(F.col("path").endswith(suffix)).select(F.regexp_replace("path", r"\.extracted\.txt$", "").alias("stem"), F.col("text").alias("sidecar"))
    wanted = files.filter(F.col("ext").isin(*RETRY_EXTENSIONS))
    whole = wanted.join(sidecars, wanted["path"] == sidecars["stem"], "left").drop("stem")
    return whole.filter(F.length(trim_ws(F.coalesce("sidecar", F.lit("")))) < MINIMAL_TEXT)


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path last modified of those that match; only metadata is read."""
    row = spark.read.format("binaryFile").load(pattern).select(F.max_by("path", "modificationTime").alias("p")).first()
    return row.p if row else None


def checkpoint(spark: SparkSession, path: str, schema, key: str = "lookup_id") -> DataFrame:
    """The committed rows of a ledger, the last of each key; an empty table if nothing was committed."""
    return Ledger(spark, path, schema, key).latest()
