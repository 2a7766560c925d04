"""The dynamic filter algebra: query options become one condition.

Conditions of different keys are combined with AND. Empty values and unknown keys say nothing. ``%``
and ``_`` in a value act as wildcards unless ``literal`` is asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import all_of, any_of
from ..schemas import STANCES

# Keys that are matched as text, as they are spelled in a query, and the fields that a search looks at.
TEXT_KEYS = frozenset("comment title keyQuote category rationale key_quote submitterName organization city state country documentType commentOn attachmentUrls attachmentTitles".split())
SEARCH_KEYS = tuple("comment title keyQuote key_quote themes rationale category submitterName organization documentType commentOn attachmentUrls attachmentTitles".split())
COUNT_KEYS = frozenset("commentCount comment_count attachmentCount attachment_count".split())
DATE_MODES = ("exact", "range", "before", "after")


@dataclass(frozen=True)
class QueryOptions:
    """What a caller asks of the comments: filters by key, a search, an order and a page."""

    filters: Mapping[str, Any] = field(default_factory=dict)
    search: str | None = None
    search_fields: tuple[str, ...] = ()
    sort: tuple[str, str] | None = None
    page: int | None = None
    page_size: int | None = None

    def key(self) -> str:
        return json.dumps([dict(self.filters), self.search, list(self.search_fields), self.sort, self.page, self.page_size], sort_keys=True, default=str)


def options_from_url(params: Mapping[str, str]) -> QueryOptions:
    """``filter_<key>`` values are JSON or plain text; page 1 of 10 rows is the default."""
    filters = {}
    for k, v in params.items():
        if k.startswith("filter_"):
            try:
                filters[k[7:]] = json.loads(v)
            except ValueError:
                filters[k[7:]] = v
    sort = (params["sort"], params.get("sortDirection", "asc")) if params.get("sort") else None
    fields = tuple(x for x in params.get("searchFields", "").split(",") if x)
    return QueryOptions(filters, params.get("search"), fields, sort, int(params.get("page", 1)), int(params.get("pageSize", 10)))


def normalize_value(value: Any, kind: str) -> Any:
    """Filter dialogs' values: select and text objects become lists, themes keep their mode, a count is a scalar."""
    if kind == "themes" or not isinstance(value, dict):
        return value[0] if kind == "count" and isinstance(value, list) and value else value
    values = value.get("values", [])
    return (values[0] if values else None) if kind == "count" else values


def column_name(key: str, columns: list[str]) -> str | None:
    """The column that a key in either spelling means, or None."""
    snake = re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), key)
    return next((k for k in (snake, key) if k in columns), None)


def like(c: Column, value: Any, literal: bool = False) -> Column:
    text = str(value)
    if literal:
        return F.contains(F.lower(c), F.lit(text.lower()))
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")  # a backslash is one, and escapes nothing


def stance_is(c: Column, value: Any) -> Column | None:
    return c == value if value in STANCES else None


def in_bucket(c: Column, value: Any) -> Column | None:
    """A count bucket, else the number that the value starts with."""
    text = str(value)
    if text in ("1", "2-10", "11-50", "50+"):
        return {"1": c == 1, "2-10": c.between(2, 10), "11-50": c.between(11, 50), "50+": c > 50}[text]
    number = re.match(r"\s*([+-]?\d+)", text)
    return c == int(number[1]) if number else None


def _each(make, c: Column, values: list) -> list[Column]:
    return [x for x in (make(c, v) for v in values) if x is not None]


def _either(found: list[Column]) -> list[Column]:
    return [any_of(found)] if found else []


def date_condition(c: Column, value: Mapping[str, Any]) -> list[Column]:
    """Bounds on the column itself, so that they reach the scan; days are UTC."""
    moment = lambda k: datetime.fromisoformat(str(value[k]).replace("Z", "")) if value.get(k) else None
    mode, start, end = value.get("mode"), moment("startDate"), moment("endDate")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    if mode == "exact" and start:
        return [c >= at(start), c < at(start + timedelta(days=1))]
    if mode == "range" and start and end:
        return [c >= at(start), c <= at(end.replace(hour=23, minute=59, second=59, microsecond=999000))]
    if mode == "before" and end:
        return [c < at(end)]
    if mode == "after" and start:
        return [c >= at(start + timedelta(days=1))]
    return []


def key_condition(key: str, value: Any, c: Column, literal: bool = False) -> list[Column]:
    """Conditions of one key: by mode and values, by dates, by a list, or by one value."""
    match = lambda c, v: like(c, v, literal)
    if isinstance(value, Mapping) and isinstance(value.get("values"), list) and "mode" in value:
        values, mode = value["values"], value["mode"]
        if key == "stance":
            found = _each(stance_is, c, values)
            return found if mode == "at_least" else _either(found)
        if key in COUNT_KEYS:
            return _either(_each(in_bucket, c, values))
        if not values:
            return []
        if mode == "at_least":
            return _each(match, c, values)
        return [c == ",".join(map(str, values))] if mode == "exact" else _either(_each(match, c, values))
    if isinstance(value, Mapping):
        return date_condition(c, value) if value.get("mode") in DATE_MODES else []
    if isinstance(value, list | tuple):
        make = stance_is if key == "stance" else in_bucket if key in COUNT_KEYS else match if key == "themes" or key in TEXT_KEYS else None
        if make:
            return _either(_each(make, c, list(value)))
        return [c.isin(list(value))] if value else []
    if key == "stance":
        return _each(stance_is, c, [value])
    if key in COUNT_KEYS:
        return _each(in_bucket, c, [value])
    return [match(c, value)] if key in TEXT_KEYS else [c == value]


def condition(options: QueryOptions, columns: list[str], literal: bool = False) -> Column | None:
    """The condition of all filters and the search, or None."""
    found: list[Column] = []
    for key, value in options.filters.items():
        name = column_name(key, columns)
        if value is not None and value != "" and name:
            found += key_condition(key, value, F.col(name), literal)
    term = (options.search or "").strip().lower()
    if term:
        names = dict.fromkeys(n for n in (column_name(k, columns) for k in options.search_fields or SEARCH_KEYS) if n)
        found += _either([like(F.col(n), term, literal) for n in names])
    return all_of(found) if found else None


def apply_filters(df: DataFrame, options: QueryOptions, literal: bool = False) -> DataFrame:
    found = condition(options, df.columns, literal)
    return df if found is None else df.filter(found)


def order_columns(df: DataFrame, options: QueryOptions, default: str = "created_at", tie: str = "id") -> list[Column]:
    """One resolved column, nulls last ascending and first descending; an unknown one leaves the order open but for the tie-break."""
    by = []
    if options.sort:
        if name := column_name(options.sort[0], df.columns):
            by.append(F.col(name).asc_nulls_last() if options.sort[1] == "asc" else F.col(name).desc_nulls_first())
    elif default in df.columns:
        by.append(F.col(default).desc_nulls_first())
    return [*by, F.col(tie).asc_nulls_last()]


def order(df: DataFrame, options: QueryOptions, default: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(*order_columns(df, options, default, tie))


def page(df: DataFrame, options: QueryOptions, default: str = "created_at", tie: str = "id") -> DataFrame:
    """Filtered, ordered, and cut to the page if both its number and size are set; for deep pages, or many, see ``pages.Pages``."""
    out = order(apply_filters(df, options), options, default, tie)
    if options.page and options.page_size:
        out = out.offset((options.page - 1) * options.page_size).limit(options.page_size)
    return out


def total_pages(total: int, size: int) -> int:
    return -(-total // size)


def by_id(df: DataFrame, value: Any, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)
