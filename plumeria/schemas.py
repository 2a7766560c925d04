"""Schemas, vocabularies and field rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values.
STANCES = ("For", "Against", "Neutral/Unclear")
VALIDATOR_STANCES = ("For", "Against", "Neutral", "Mixed", "Neutral/Unclear", "")
COUNT_BUCKETS = ("1", "2-10", "11-50", "50+")
TEXT_SOURCES = ("comment", "comment+attachments")
COMMENT_ID = "^[A-Z]+-[0-9]{4}-[0-9]{4}-[0-9]+$"
LOOKUP_ID = "lookup_%06d"
MAX_TRUNCATED = 1003

_s, _i, _d, _b, _t = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


ATTACHMENT = struct(title=_s, fileUrl=_s, type=_s, localPath=_s)
ATTACHMENT_TEXT = struct(id=_s, title=_s, text=_s, file_path=_s, mime_type=_s)
RAW_TEXTS = ("title", "commentOn", "postedDate", "receivedDate", "submitterName", "organization", "city", "state", "country", "comment", "documentType", "agencyId", "category")
RAW_COMMENT = struct(id=_s, attributes=struct(**dict.fromkeys(RAW_TEXTS, _s), attachmentCount=_i, attachments=T.ArrayType(ATTACHMENT), attachment_texts=T.ArrayType(ATTACHMENT_TEXT)))
LOOKUP = struct(
    lookup_id=_s, truncated_text=_s, text_source=_s, comment_text=_s, attachment_text=_s, comment_ids=T.ArrayType(_s), comment_count=_i, full_text_length=_i, truncated_text_length=_i,
    stance=_s, key_quote=_s, rationale=_s, themes=_s, cluster_id=_s, pca_x=_d, pca_y=_d,
)
COMMENTS = struct(
    id=_s, title=_s, category=_s, comment=_s, link=_s, posted_date=_t, received_date=_t, has_attachments=_b, lookup_id=_s, text_source=_s, stance=_s, key_quote=_s, rationale=_s, themes=_s,
    comment_count=_i, cluster_id=_s, corrected=_b, organization=_s, document_type=_s, attachment_count=_i, attachment_urls=_s, attachment_titles=_s, truncated_text=_s, pca_x=_d, pca_y=_d, created_at=_t,
)
CLUSTER_DESCRIPTIONS = struct(cluster_id=_s, title=_s, description=_s, created_at=_t, updated_at=_t)
#: Lookup fields that a comment takes over, and what it gets without a lookup row.
LOOKUP_DEFAULTS = {
    "lookup_id": None, "truncated_text": "", "text_source": "", "comment_text": "", "attachment_text": "", "comment_count": 1, "stance": None, "key_quote": "", "rationale": "", "themes": "", "corrected": False, "cluster_id": None, "pca_x": None, "pca_y": None,
}


@dataclass(frozen=True)
class FieldSpec:
    """A rule for one field of a merged row."""

    name: str
    kind: str = "string"
    required: bool = False
    nullable: bool = True
    date: bool = False
    allowed: tuple[str, ...] = ()


def _fields() -> tuple[FieldSpec, ...]:
    fixed = [FieldSpec(n, "string", True, False) for n in ("id", "title", "comment", "original_comment", "agency_id")]
    fixed += [FieldSpec(n, "string", True, False, True) for n in ("posted_date", "received_date")]
    fixed += [FieldSpec("has_attachments", "boolean", True, False), FieldSpec("lookup_id", "string", True)]
    loose = "category submitter_name organization city state country comment_on document_type link attachment_urls attachment_titles attachment_local_paths truncated_text text_source comment_text attachment_text key_quote rationale themes cluster_id"
    fixed += [FieldSpec(n) for n in loose.split()]
    return (*fixed, FieldSpec("attachment_count", "int"), FieldSpec("comment_count", "int"), FieldSpec("corrected", "boolean"), FieldSpec("pca_x", "double"), FieldSpec("pca_y", "double"), FieldSpec("stance", allowed=VALIDATOR_STANCES))


FIELDS = _fields()


def _nullable(kind: str) -> dict:
    return {"type": [kind, "null"]}


def _row_schema(properties: dict[str, dict]) -> dict:
    """An array of objects that have all of these fields and no other."""
    return {"type": "array", "items": {"type": "object", "required": list(properties), "properties": properties, "additionalProperties": False}}


_STANCE_RULE = {"type": ["string", "null"], "enum": [*STANCES, "", None]}
_PLACES = {"cluster_id": _nullable("string"), "pca_x": _nullable("number"), "pca_y": _nullable("number")}
# Fields, types and bounds of the exported files.
LOOKUP_JSON_SCHEMA = _row_schema({
    "lookup_id": {"type": "string"}, "truncated_text": {"type": "string"}, "text_source": {"type": "string", "enum": list(TEXT_SOURCES)}, "comment_text": {"type": "string"}, "attachment_text": {"type": "string"},
    "comment_ids": {"type": "array", "items": {"type": "string", "pattern": COMMENT_ID}}, "comment_count": {"type": "integer", "minimum": 1}, "full_text_length": {"type": "integer", "minimum": 0},
    "truncated_text_length": {"type": "integer", "minimum": 0, "maximum": MAX_TRUNCATED}, "stance": _STANCE_RULE, **{n: _nullable("string") for n in ("key_quote", "rationale", "themes")}, **_PLACES,
})
_DATE = {"type": "string", "format": "date-time"}
DATA_JSON_SCHEMA = _row_schema({
    "id": {"type": "string", "pattern": COMMENT_ID}, "title": {"type": "string"}, "comment_on": _nullable("string"), "posted_date": _DATE, "received_date": _DATE,
    **{n: {"type": "string"} for n in ("submitter_name", "organization", "city", "state", "country", "comment", "original_comment", "document_type", "agency_id", "category")},
    "attachment_count": {"type": "integer", "minimum": 0}, "has_attachments": {"type": "boolean"}, **{n: {"type": "string"} for n in ("attachment_urls", "attachment_titles", "attachment_local_paths")},
    **{n: _nullable("string") for n in ("lookup_id", "truncated_text")}, "text_source": {"type": ["string", "null"], "enum": [*TEXT_SOURCES, None]}, **{n: _nullable("string") for n in ("comment_text", "attachment_text")},
    "comment_count": {"type": ["integer", "null"], "minimum": 1}, "stance": _STANCE_RULE, **{n: _nullable("string") for n in ("key_quote", "rationale")}, "themes": {"type": ["string", "array", "null"], "items": {"type": "string"}},
    "corrected": {"type": "boolean"}, **_PLACES,
})
