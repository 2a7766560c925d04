"""JSON Schemas compiled to columns: one array of the rules that a row breaks.

A schema of rows (or of an array of rows) becomes one native expression over the table's own types. Known are
type, enum, const, required, properties, additionalProperties, pattern, the bounds of numbers and lengths, items,
minItems, maxItems, uniqueItems, anyOf, allOf and not, at any depth. In a table a field that is absent from an object
is null, so a required field is missing if the table has no such column, and otherwise has to be of its type; null
breaks a rule only where the schema does not allow it. ``format`` states no rule, as in a validator's defaults.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords that say nothing about a row.
ANNOTATIONS = frozenset("$schema $id $comment title description default examples format definitions $defs".split())
KNOWN = frozenset("type enum const required properties additionalProperties pattern minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength items minItems maxItems uniqueItems anyOf allOf not".split())
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class SchemaError(ValueError):
    """A schema has a keyword that is not known here, or one of the wrong form."""


def load_schema(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _kinds(kind: T.DataType) -> set[str]:
    """JSON types that values of a column can have, besides null."""
    if isinstance(kind, WHOLE):
        return {"integer", "number"}
    if isinstance(kind, NUMBERS):
        return {"number"}
    if isinstance(kind, T.BooleanType):
        return {"boolean"}
    if isinstance(kind, T.ArrayType):
        return {"array"}
    if isinstance(kind, (T.StructType, T.MapType)):
        return {"object"}
    return set() if isinstance(kind, T.NullType) else {"string"}


def _type_rule(c: Column, kind: T.DataType, allowed: list[str]) -> Column:
    """Whether a value is of none of the allowed types."""
    own = _kinds(kind)
    if own & set(allowed):
        wrong = F.lit(False)
    elif "integer" in allowed and "number" in own:  # a number without fraction is an integer
        wrong = c != F.floor(c)
    else:
        wrong = F.lit(True)
    return F.when(c.isNull(), F.lit("null" not in allowed)).otherwise(wrong)


def _literal(value) -> Column:
    return F.lit(value)


def _fits(value, kind: T.DataType) -> bool:
    """Whether a column of this type can hold a schema's value."""
    name = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string" if isinstance(value, str) else "other"
    return name in _kinds(kind) or (name == "integer" and "number" in _kinds(kind))


def _rules(c: Column, kind: T.DataType, schema: dict, at: str) -> list[Column]:
    """Arrays of broken rules' names (``path: keyword``), none of which is null."""
    if schema is True:
        return []
    if schema is False:
        return [F.array(F.lit(f"{at}: not allowed"))]
    if unknown := set(schema) - KNOWN - ANNOTATIONS:
        raise SchemaError(f"{at}: {', '.join(sorted(unknown))} not known")
    out: list[Column] = []
    own = _kinds(kind)

    def rule(keyword: str, broken: Column) -> None:
        out.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit(f"{at}: {keyword}"))).otherwise(F.array().cast("array<string>")))

    if "type" in schema:
        rule("type", _type_rule(c, kind, [schema["type"]] if isinstance(schema["type"], str) else schema["type"]))
    for keyword in ("enum", "const"):
        if keyword in schema:
            values = schema[keyword] if keyword == "enum" else [schema[keyword]]
            held = [v for v in values if v is not None and _fits(v, kind)]
            rule(keyword, F.when(c.isNull(), F.lit(None not in values)).otherwise(~c.isin(*map(_literal, held)) if held else F.lit(True)))
    if "string" in own:
        text = c.cast("string")
        if "pattern" in schema:
            rule("pattern", ~text.rlike(schema["pattern"]))
        if "minLength" in schema:
            rule("minLength", F.length(text) < schema["minLength"])
        if "maxLength" in schema:
            rule("maxLength", F.length(text) > schema["maxLength"])
    if "number" in own:
        for keyword, broken in (("minimum", lambda v: c < v), ("maximum", lambda v: c > v), ("exclusiveMinimum", lambda v: c <= v), ("exclusiveMaximum", lambda v: c >= v)):
            if keyword in schema:
                rule(keyword, broken(schema[keyword]))
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            rule("minItems", F.size(c) < schema["minItems"])
        if "maxItems" in schema:
            rule("maxItems", F.size(c) > schema["maxItems"])
        if schema.get("uniqueItems"):
            rule("uniqueItems", F.size(F.array_distinct(c)) < F.size(c))
        if isinstance(schema.get("items"), (dict, bool)) and _rules(F.lit(None).cast(kind.elementType), kind.elementType, schema["items"], at):
            every = F.flatten(F.transform(c, lambda x: F.concat(*_rules(x, kind.elementType, schema["items"], f"{at}[]"))))
            out.append(F.coalesce(F.array_distinct(every), F.array().cast("array<string>")))
    if isinstance(kind, T.StructType):
        inner = _object({f.name: (c.getField(f.name), f.dataType) for f in kind.fields}, schema, f"{at}.")
        if inner:
            out.append(F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.concat(*inner)))
    for keyword in ("anyOf", "allOf"):
        if keyword in schema:
            broken = [F.size(_joined(_rules(c, kind, s, at))) > 0 for s in schema[keyword]]
            rule(keyword, reduce(Column.__and__ if keyword == "anyOf" else Column.__or__, broken, F.lit(keyword == "anyOf")))
    if "not" in schema:
        rule("not", F.size(_joined(_rules(c, kind, schema["not"], at))) == 0)
    return out


def _joined(found: list[Column]) -> Column:
    return F.concat(*found) if found else F.array().cast("array<string>")


def _object(fields: dict[str, tuple[Column, T.DataType]], schema: dict, at: str = "") -> list[Column]:
    """The rules of an object with these fields."""
    out = [F.array(F.lit(f"{at}{name}: required")) for name in schema.get("required", ()) if name not in fields]
    known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    for name, (c, kind) in fields.items():
        if name in known:
            found = _rules(c, kind, known[name], f"{at}{name}")
            if name not in schema.get("required", ()):  # null may stand for an absent field
                found = [F.when(c.isNull(), F.array().cast("array<string>")).otherwise(f) for f in found]
            out += found
        elif more is False:
            out.append(F.when(c.isNotNull(), F.array(F.lit(f"{at}{name}: additionalProperties"))).otherwise(F.array().cast("array<string>")))
        elif isinstance(more, dict):
            out += [F.when(c.isNull(), F.array().cast("array<string>")).otherwise(f) for f in _rules(c, kind, more, f"{at}{name}")]
    return out


def violations(table: T.StructType, schema: dict) -> Column:
    """The names of the rules of ``schema`` (of a row, or of an array of rows) that a row of such a table breaks."""
    row = schema["items"] if schema.get("type") == "array" else schema
    if unknown := set(row) - KNOWN - ANNOTATIONS:
        raise SchemaError(f"{', '.join(sorted(unknown))} not known")
    return _joined(_object({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in table.fields}, row))


def conform(df: DataFrame, schema: dict) -> DataFrame:
    """``df`` with the array ``violations`` (a column of that name is no part of the rows)."""
    rows = df.drop("violations")
    return rows.withColumn("violations", violations(rows.schema, schema))


def broken_rules(conformed: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule."""
    return conformed.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
