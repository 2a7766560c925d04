"""Text functions as columns."""

from __future__ import annotations

import html
import mimetypes
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
ATTACHMENT_MARK = "\n\n--- ATTACHMENT CONTENT ---\n"
NEXT_ATTACHMENT_MARK = "\n\n--- NEXT ATTACHMENT ---\n\n"
#: Unicode white space, the space itself last.
SPACES = "\t\n\v\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000 "
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
MIME_TYPES = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain", "rtf": "application/rtf", "csv": "text/csv", "html": "text/html", "htm": "text/html",
}


def trim_ws(c: Column) -> Column:
    """Strip all white space, not only spaces."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """One space for each run of white space."""
    return F.regexp_replace(c, "(?U)\\s+", " ")


def replace_each(c: Column, chars: str, by: str) -> Column:
    """Each of ``chars`` replaced by its counterpart; for a few rare characters this is a byte search each."""
    for old, new in zip(chars, by, strict=True):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def capitals(c: Column) -> Column:
    """Upper case letter by letter, ẞ for ß; letters that would become several stay, so that lower case brings the text back."""
    simple = lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.split(F.replace(c, F.lit("ß"), F.lit("ẞ")), ""), simple), "")


def normalize_for_dedup(c: Column) -> Column:
    """Lower case, one space for white space, straight double quotes for „ « », a hyphen for dashes; curly quotes and apostrophes stay."""
    return F.trim(replace_each(squeeze(F.lower(F.coalesce(c, F.lit("")))), "„«»—–−", '"""---'))


def combine(comment: Column, attachments: Column) -> Column:
    """Struct of comment_text, attachment_text, full_text and text_source from a comment and an array of texts."""
    own = trim_ws(F.coalesce(comment, F.lit("")))
    useful = F.filter(F.coalesce(attachments, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    other = F.array_join(useful, NEXT_ATTACHMENT_MARK)
    full = F.when(other == "", own).when(own == "", other).otherwise(F.concat(own, F.lit(ATTACHMENT_MARK), other))
    source = F.when(F.size(useful) > 0, "comment+attachments").otherwise("comment")
    return F.struct(own.alias("comment_text"), other.alias("attachment_text"), full.alias("full_text"), source.alias("text_source"))


def stripped_text(comment: Column, attachments: Column) -> Column:
    """Comment and attachment texts without tags, empty ones left out of the latter, with a blank line between."""
    others = F.filter(F.transform(F.coalesce(attachments, F.array().cast("array<string>")), strip_tags), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat(strip_tags(F.coalesce(comment, F.lit(""))), F.array_join(F.transform(others, lambda x: F.concat(F.lit("\n\n"), x)), ""))


def truncate(c: Column, n: int) -> Column:
    """At most n characters and ``...``, cut at the last space if it lies beyond 80 % of n."""
    head = trim_ws(F.substring(c, 1, n))
    back = F.locate(" ", F.reverse(head))
    space = F.when(back > 0, F.length(head) - back).otherwise(-1)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(space > n * 0.8, F.substring(head, F.lit(1), space)).otherwise(head), F.lit("...")))


def strip_tags(c: Column) -> Column:
    """Remove tags that do not cross lines."""
    return F.regexp_replace(c, "<.*?>", "")


def unescape(c: Column) -> Column:
    """All character references decoded as HTML5 has them: names with or without a semicolon, and numbers."""

    @F.pandas_udf(StringType())
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return decoded(c)


def strip_html(c: Column, every: bool = True) -> Column:
    """Remove tags, also across lines, and decode character references: the common ones in the JVM, and texts that have others in Python.

    Without ``every``, only ``ENTITIES`` are decoded, each with its semicolon.
    """
    bare = F.regexp_replace(c, "<[^>]*>", "")
    out = bare
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    if not every:
        return out
    rare = F.rlike(bare, F.lit(f"&(?!(?:{'|'.join(e[1:-1] for e in ENTITIES)});)[#A-Za-z]"))
    return F.coalesce(unescape(F.when(rare, bare)), out)


def clean_for_comparison(c: Column) -> Column:
    return F.lower(F.trim(replace_each(squeeze(c), "—–", "--")))


def normalize_quotes(c: Column) -> Column:
    return F.translate(c, "„‟«»‹›", '""""<>')


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    return F.length(c) / 4


def split_list(c: Column, sep: str = ",") -> Column:
    """Items without white space around them, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), trim_ws), lambda x: x != "")


def attachments_of(urls: Column) -> Column:
    """Array of attachment structs from a comma-separated list; the title is the last part of the path."""
    none = F.lit(None).cast("string")
    return F.transform(split_list(urls), lambda u: F.struct(F.element_at(F.split(u, "/"), -1).alias("title"), u.alias("fileUrl"), extension(u).alias("type"), none.alias("localPath")))


def zip_links(urls: Column, titles: Column, default: str = "Attachment") -> Column:
    """Array of (url, title) of two ``'; '``-joined lists."""
    names = F.split(F.coalesce(titles, F.lit("")), "; ")
    return F.transform(F.filter(F.split(F.coalesce(urls, F.lit("")), "; "), lambda u: u != ""), lambda u, k: F.struct(u.alias("url"), F.coalesce(F.nullif(F.get(names, k), F.lit("")), F.lit(default)).alias("title")))


def quote_literal(term: str) -> str:
    """A regular expression for exactly ``term``."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def highlight(c: Column, term: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    return F.regexp_replace(c, f"(?i){quote_literal(term)}", f"{before}$0{after}") if term else c


def first_match(c: Column, term: str) -> Column:
    """0-based place of the first match without regard to case, -1 for none."""
    return F.locate(term.lower(), F.lower(c)) - 1 if term else F.lit(-1)


def snippets(c: Column, term: str, context: int = 40, most: int = 2) -> Column:
    """The first matches with their context, or the start of the text."""
    if not term:
        return c
    lowered, size = F.lower(c), len(term)
    first = F.locate(term.lower(), lowered)

    def piece(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - 1 - context), F.least(F.length(c), at - 1 + size + context)
        return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(c, start + 1, end - start), F.when(end < F.length(c), "...").otherwise(""))

    places = [first]
    for _ in range(most - 1):
        after = places[-1] + size
        places.append(F.when(places[-1] > 0, F.position(F.lit(term.lower()), lowered, after)).otherwise(0))
    found = F.concat_ws(" ••• ", *(F.when(p > 0, piece(p)) for p in places))
    return F.when(first == 0, F.concat(F.substring(c, 1, 100), F.lit("..."))).otherwise(found)


def smart_truncate(c: Column, limit: int, term: str = "") -> Column:
    """The first ``limit`` characters; if the term's first match lies beyond, a third of them and the match's context."""
    short = F.concat(F.substring(c, 1, limit), F.lit("..."))
    if not term:
        return F.when(F.length(c) <= limit, c).otherwise(short)
    at, size = first_match(c, term), limit // 2
    start = F.greatest(F.lit(0.0), at - size / 2).cast("int")
    end = F.least(F.length(c), start + size)
    far = F.concat(F.substring(c, 1, limit // 3), F.lit("..."), F.substring(c, start + 1, end - start), F.when(end < F.length(c), "...").otherwise(""))
    return F.when(F.length(c) <= limit, c).when((at == -1) | (at < limit), short).otherwise(far)


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def safe_name(c: Column, n: int = 50) -> Column:
    return F.substring(F.regexp_replace(c, "[^\\p{L}\\p{N}_\\- ]", ""), 1, n)


def basename(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)


def extension(url: Column, default: str = ".txt") -> Column:
    found = F.lower(F.regexp_extract(basename(url), "(\\.[A-Za-z0-9]+)$", 1))
    return F.when(found == "", default).otherwise(found)


def mime_type(url: Column, name: Column) -> Column:
    """By the name's extension, that of a compressed file before the compression's; else by the first known one that the URL has in it, else binary."""
    table = mimetypes.MimeTypes(())
    kinds = {k[1:]: v for k, v in table.types_map[True].items()} | MIME_TYPES
    bare = F.lower(name)
    for short, long in table.suffix_map.items():
        bare = F.when(bare.endswith(short), F.regexp_replace(bare, f"{re.escape(short)}$", long)).otherwise(bare)
    bare = F.regexp_replace(bare, f"({'|'.join(re.escape(k.lower()) for k in table.encodings_map)})$", "")
    ext = F.nullif(F.regexp_extract(bare, "[^/.][^/]*\\.([a-z0-9]+)$", 1), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    within = F.lit(None).cast("string")
    for k, v in reversed(MIME_TYPES.items()):
        within = F.when(F.contains(F.lower(url), F.lit(f".{k}")), v).otherwise(within)
    return F.coalesce(F.try_element_at(known, ext), within, F.lit("application/octet-stream"))


def lookup_id(n: Column) -> Column:
    return F.format_string("lookup_%06d", n)


def lookup_number(c: Column) -> Column:
    return F.regexp_extract(c, "^lookup_([0-9]+)$", 1).try_cast("long")


def json_object(reply: Column) -> Column:
    """The outermost braces of a model's reply."""
    return F.regexp_extract(reply, "(?s)\\{.*\\}", 0)


def wrap(text: str, width: int = 80) -> str:
    """Words in lines of at most ``width`` characters, for reports on the driver."""
    lines = [""]
    for w in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(w) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {w}".strip()
    return "\n".join(lines)


def attachment_flags(source: Column, text: Column) -> Column:
    """Whether source and text disagree on having attachments."""
    marked, named = F.contains(text, F.lit("--- ATTACHMENT CONTENT ---")), F.contains(source, F.lit("attachment"))
    return F.coalesce(marked, F.lit(False)) != F.coalesce(named, F.lit(False))
