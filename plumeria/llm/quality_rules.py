"""Quality rules: how far a document's histograms diverge from those of languages.

Two histograms of a document, of character classes and of a language's common words, are compared with
the language's references by Jensen-Shannon distance (base 2, so from 0 to 1). The references are the
same histograms over all documents in which that language's common words prevail. DataFrame functions
do all of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most frequent function words of each reference language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf",
    "en": "the of and to in is that for it was with as",
    "es": "de la que el en y a los se del las un",
    "fr": "de la le et les des en un du une que est",
}
CLASSES = ("upper", "letter", "digit", "stop", "mark")
WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Marks that a word may end in when it is looked up among the common ones.
END_MARKS = ".,"
#: Bits of a window's key that hold its place in the text; the others are its hash's.
PLACE_BITS = 20


@dataclass(frozen=True)
class QualityLimits:
    """Base limits, and the greatest distances that a document of enough words may have."""

    min_words: int = 50
    repeat_percent: int = 50
    guard_words: int = 50  #: with fewer words the histograms say too little, and no distance counts
    class_distance: float = 0.30
    word_distance: float = 0.29


LIMITS = QualityLimits()
#: language -> (share of each of CLASSES; share of each common word, and of all other words)
References = dict[str, tuple[tuple[float, ...], tuple[float, ...]]]


def _listed() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the whole expression."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _classes(chars: Column) -> Column:
    """Count of each of CLASSES among characters that are no white space: lower-case letters go first, so that little is left for the rest."""

    def split(rest: Column) -> Column:
        only = lambda pattern: F.length(F.regexp_replace(rest, pattern, "")).cast("long")
        raw = F.array(only(r"[^\p{Lu}]+"), only(r"[^\p{L}]+"), only(r"[^\p{Nd}]+"), only(r"[^.,;:'()\-]+"), F.length(rest).cast("long"))
        return _let(raw, lambda r: F.array(r[0], F.length(chars) - r[4] + r[1] - r[0], r[2], r[3], r[4] - r[1] - r[2] - r[3]))

    return _let(F.regexp_replace(chars, r"\p{Ll}+", ""), split)


def _counts(words: Column) -> Column:
    """Count of each listed word: the listed words are joined with two spaces each, and what taking one out shortens counts it."""
    bare = F.filter(F.transform(words, lambda w: F.rtrim(w, F.lit(END_MARKS))), lambda w: F.length(w) <= max(map(len, _listed())))
    common = F.filter(F.transform(bare, F.lower), lambda w: w.isin(_listed()))
    one = lambda text, w: ((F.length(text) - F.length(F.replace(text, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long")
    return _let(F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")), lambda text: F.transform(F.array(*map(F.lit, _listed())), lambda w: one(text, w)))


def _own(counts: Column, language: str) -> Column:
    """Counts of the language's common words."""
    at = {w: k for k, w in enumerate(_listed())}
    return F.transform(F.array(*(F.lit(at[w]) for w in COMMON_WORDS[language].split())), lambda k: F.get(counts, k))


def _histograms(text: Column, rest: Callable[[Column], list[Column]]) -> Column:
    """Struct of n (words), classes, counts, and what ``rest`` makes of the words."""
    return _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _classes(F.array_join(w, "")).alias("classes"), _counts(w).alias("counts"), *rest(w)))


def fit_references(docs: DataFrame) -> References:
    """Histograms of each reference language over all documents: at most a row for each language reaches the driver.

    A document counts for the language most of whose common words it has (the last by name of equals).
    """
    hist = docs.select(_histograms(F.col("text"), lambda w: []).alias("h")).select("h.n", "h.classes", "h.counts")
    hits = F.array_max(F.array(*(F.struct(_sum(_own(F.col("counts"), k)).alias("hits"), F.lit(k).alias("language")) for k in sorted(COMMON_WORDS))))
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.col("counts")[k]).alias(f"w{k}") for k in range(len(_listed()))]
    found = {}
    for row in hist.withColumn("most", hits).groupBy(F.when(F.col("most.hits") > 0, F.col("most.language")).alias("language")).agg(F.sum("n").alias("n"), *sums).collect():
        if row.language is not None:
            classes = [row[f"c{k}"] for k in range(len(CLASSES))]
            own = [row[f"w{_listed().index(w)}"] for w in COMMON_WORDS[row.language].split()]
            own.append(row.n - sum(own))
            found[row.language] = tuple(c / sum(classes) for c in classes), tuple(c / row.n for c in own)
    return found


def js_distance(counts: Column, total: Column, reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of an array of counts (of ``total`` in all) from a reference distribution."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(F.transform(counts, lambda c: c / total), F.array(*map(F.lit, reference)), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows sorted, those equal to a neighbour, and what their places cover.

    A window's key is one number, its hash above its place, and of neighbours with equal hashes the words
    are compared. Where they differ, or where places need more bits, windows are sorted by hash and words,
    so that equal ones are neighbours whatever their hashes: the result is exact either way.
    """
    n = F.size(words)
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    places = F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3)
    mask = (1 << PLACE_BITS) - 1
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    meet = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
    differ = lambda x, y: meet(x, y) & (F.slice(words, place(x) + 1, F.lit(3)) != F.slice(words, place(y) + 1, F.lit(3)))
    keys = F.transform(places, lambda i: F.shiftleft(F.shiftright(hashed(i), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))
    near = lambda s: F.transform(F.filter(s, lambda x, j: meet(x, F.get(s, j - 1)) | meet(x, F.get(s, j + 1))), place)
    clash = lambda s: F.exists(F.filter(s, lambda x, j: differ(x, F.get(s, j + 1))), lambda x: F.lit(True))
    wide = F.transform(places, lambda i: F.struct(hashed(i).alias("h"), F.slice(words, i + 1, F.lit(3)).alias("w"), i.alias("i")))
    alike = lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"])
    equal = lambda s: F.filter(s, lambda x, j: alike(x, F.get(s, j - 1)) | alike(x, F.get(s, j + 1)))
    exact = F.transform(_let(F.sort_array(wide), equal), lambda x: x["i"])
    either = _let(F.sort_array(keys), lambda s: F.when(clash(s), exact).otherwise(near(s)))
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
    twice = F.sort_array(F.when(n < 3, F.array().cast("array<int>")).when(n <= mask, either).otherwise(exact))
    return F.aggregate(twice, start, lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(3), x - a["p"])).alias("n")), lambda a: a["n"])


def verdict(text: Column, references: References, limits: QualityLimits = LIMITS) -> Column:
    """Struct of all that ``with_quality`` adds, as one expression: a filter on its ``kept`` computes it once for each row."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    duplicates = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")

    def judge(h: Column) -> Column:
        near = []
        for k, (classes, words) in sorted(references.items()):
            bins = _let(_own(h["counts"], k), lambda own: F.concat(own, F.array(h["n"] - _sum(own))))
            near.append(F.struct(js_distance(bins, h["n"], words).alias("word"), js_distance(h["classes"], _sum(h["classes"]), classes).alias("class")))
        within = lambda x: (x["word"] <= limits.word_distance) & (x["class"] <= limits.class_distance)
        best = lambda all_: F.array_min(F.transform(all_, lambda x: F.struct((~within(x)).alias("far"), x["word"].alias("word"), x["class"].alias("class"))))
        nearest = F.when(h["n"] > 0, _let(F.array(*near), best)) if near else F.lit(None).cast("struct<far:boolean,word:double,class:double>")
        failed = (h["n"] < limits.min_words) | (100 * h["repeats"] > limits.repeat_percent * h["n"])
        far = lambda x: (h["n"] >= limits.guard_words) & F.coalesce(x["far"], F.lit(False))
        return _let(nearest, lambda x: F.struct(
            h["n"].alias("n_words"), _sum(h["classes"]).alias("word_chars"), symbols.alias("n_symbols"), duplicates.alias("n_dup_lines"), h["repeats"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & ~far(x)).alias("kept"), x["word"].alias("word_distance"), x["class"].alias("class_distance"),
        ))

    return _let(_histograms(text, lambda w: [_repeat_words(w).alias("repeats")]), judge)


def with_quality(docs: DataFrame, references: References, limits: QualityLimits = LIMITS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, word_distance and class_distance.

    A document is kept if it passes the base limits and some reference language is near in both
    histograms; one with fewer than ``guard_words`` words, and any if there are no references, is judged
    by the base limits alone. The distances are those of a language that is near in both, or else of the one
    nearest by words. Null and empty texts have no words and fail. Each row is judged by itself,
    so repeated rows get the same verdict and ties do not arise; other columns pass through, and columns
    of those names are replaced.
    """
    own = "quality_verdict" + "_" * max(map(len, docs.columns), default=0)  # longer than any column's name
    judged = docs.withColumn(own, verdict(F.col("text"), references, limits))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "class_distance"]
    return judged.select(*(F.col(f"`{n}`") for n in docs.columns if n not in added), *(F.col(f"{own}.{n}").alias(n) for n in added))


def quality_rules(docs: DataFrame, limits: QualityLimits = LIMITS) -> DataFrame:
    """Fit the references over all of ``docs`` (doc_id, text, ...), then judge each row; see ``with_quality``."""
    return with_quality(docs, fit_references(docs), limits)


def oracle_sql(limits: QualityLimits = LIMITS) -> str:
    """The same in DuckDB's SQL, over the view documents."""
    listed, ws = _listed(), "[\\x20\\x09-\\x0D]"
    array = "[" + ", ".join(f"'{w}'" for w in listed) + "]"
    own = {k: [f"counts[{listed.index(w) + 1}]" for w in words.split()] for k, words in sorted(COMMON_WORDS.items())}
    hits = {k: " + ".join(v) for k, v in own.items()}
    most = "greatest(" + ", ".join(hits.values()) + ")"
    prevailing = "CASE " + " ".join(f"WHEN {most} > 0 AND ({h}) = {most} THEN '{k}'" for k, h in sorted(hits.items(), reverse=True)) + " END"
    bins = {k: [*v, f"(n - ({hits[k]}))"] for k, v in own.items()}
    classes = [f"classes[{i + 1}]" for i in range(len(CLASSES))]
    refs = "CASE language " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'sum({b})' for b in v)}]" for k, v in bins.items()) + " END"

    def distance(p: list[str], q: str) -> str:
        terms = [f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {q}[{i}]) / 2)) ELSE 0 END + CASE WHEN {q}[{i}] > 0 THEN {q}[{i}] * log2({q}[{i}] / (({x} + {q}[{i}]) / 2)) ELSE 0 END)" for i, x in enumerate(p, 1)]
        return "sqrt(greatest((" + " + ".join(terms) + ") / 2, 0))"

    pairs = ", ".join(
        f"CASE WHEN r{k}.q_class IS NOT NULL THEN {{'word': {distance([f'({b}::DOUBLE / n)' for b in bins[k]], f'r{k}.q_word')}, 'class': {distance([f'({c}::DOUBLE / word_chars)' for c in classes], f'r{k}.q_class')}}} END"
        for k in own
    )
    return f"""
WITH base AS (
  SELECT doc_id, text, CASE WHEN coalesce(trim(text, E' \\t\\n\\x0b\\f\\r'), '') = '' THEN [] ELSE regexp_split_to_array(trim(text, E' \\t\\n\\x0b\\f\\r'), '{ws}+') END AS w FROM documents),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, '') AS chars, regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g') AS symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \\t\\n\\x0b\\f\\r') != '') AS lines,
    list_filter(list_transform(w, lambda x: lower(rtrim(x, '{END_MARKS}'))), lambda x: list_contains({array}, x)) AS common, w
  FROM base),
windows AS (SELECT doc_id, n, w, unnest(range(1, n - 1)) AS i FROM counted WHERE n >= 3),
keyed AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS k FROM windows),
twice AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
features AS (
  SELECT c.doc_id, n, length(chars)::BIGINT AS word_chars, length(symbols)::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    [len(list_filter(common, lambda x: x = y)) FOR y IN {array}] AS counts,
    [length(regexp_replace(chars, '[^\\p{{Lu}}]', '', 'g')), length(regexp_replace(chars, '[^\\p{{L}}]', '', 'g')), length(regexp_replace(chars, '[^\\p{{Nd}}]', '', 'g')), length(regexp_replace(chars, '[^.,;:''()\\-]', '', 'g'))] AS raw
  FROM counted c LEFT JOIN repeated r ON c.doc_id = r.doc_id),
placed AS (SELECT *, [raw[1], raw[2] - raw[1], raw[3], raw[4], word_chars - raw[2] - raw[3] - raw[4]] AS classes, {prevailing} AS language FROM features),
summed AS (SELECT language, [{", ".join(f"sum({c})" for c in classes)}] AS c, {refs} AS w FROM placed WHERE language IS NOT NULL GROUP BY language),
refs AS (SELECT language, list_transform(c, lambda x: x::DOUBLE / list_sum(c)) AS q_class, list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS q_word FROM summed),
judged AS (SELECT p.*, CASE WHEN n > 0 THEN list_filter([{pairs}], lambda x: x IS NOT NULL) ELSE [] END AS near FROM placed p {" ".join(f"LEFT JOIN refs r{k} ON r{k}.language = '{k}'" for k in own)}),
failed AS (SELECT *, n < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n AS base_failed FROM judged)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n >= {limits.guard_words} AND len(near) > 0 AND len(list_filter(near, lambda x: x.word <= {limits.word_distance} AND x.class <= {limits.class_distance})) = 0) AS kept
FROM failed"""
