"""More registered queries: projections, membership, dates, text and array functions, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import clusters, dedup, embeddings, enrich, filters, joins, quality, quotes, stats
from ..operators.filters import QueryOptions
from ..sources import office, readers
from .catalog import COMMENTS, EVENTS, GROUPS, LOOKUPS, VECTORS, comments, entries, events, lookup, query, shared, table, texts, vectors

NESTED = "SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS comment, count(*) FILTER (turn > 0) AS n, coalesce(string_agg(role || turn, '; ' ORDER BY turn) FILTER (turn > 0), '') AS titles FROM conversations GROUP BY 1"


def raw(spark, sf):
    """Conversations as nested comments: turn 0 is the comment, the others are attachments."""
    c = table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    attachment = F.struct(F.concat("role", F.col("turn").cast("string")).alias("title"), none.alias("fileUrl"), none.alias("type"), none.alias("localPath"))
    grouped = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("comment"), F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", attachment.alias("a"))))).alias("x"))
    listed = F.transform("x", lambda x: x["a"])
    blank = {n: none.alias(n) for n in ("title", "commentOn", "postedDate", "receivedDate", "submitterName", "organization", "city", "state", "country", "documentType", "agencyId", "category")}
    return grouped.select(F.col("conv_id").alias("id"), F.struct(F.col("comment").alias("comment"), F.size("x").alias("attachmentCount"), listed.alias("attachments"), *blank.values()).alias("attributes"))


@query(f"SELECT conv_id AS id, md5(coalesce(comment, '')) AS digest, n::INTEGER AS attachment_count, n > 0 AS has_attachments, titles AS attachment_titles FROM ({NESTED})")
def prj_01_flatten(spark, sf):
    return joins.flatten(raw(spark, sf)).select("id", F.md5("comment").alias("digest"), "attachment_count", "has_attachments", "attachment_titles")


@query(f"SELECT sum(n)::BIGINT AS attachments FROM ({NESTED})")
def agg_33_attachments(spark, sf):
    return joins.flatten(raw(spark, sf)).agg(F.sum("attachment_count").alias("attachments"))


@query(f"SELECT trim(coalesce(organization, '') || ' ' || coalesce(category, '')) AS name, id FROM ({COMMENTS})")
def prj_02_names(spark, sf):
    return comments(spark, sf).select(T.trim_ws(F.concat(F.coalesce("organization", F.lit("")), F.lit(" "), F.coalesce("category", F.lit("")))).alias("name"), "id")


MEMBERS = f"SELECT unnest(string_split(ids, ','))::BIGINT AS id, lookup_id, n FROM ({LOOKUPS}) WHERE n > 1"


@query(f"SELECT c.id, m.lookup_id, coalesce(m.n, 1)::INTEGER AS comment_count FROM ({COMMENTS}) c LEFT JOIN ({MEMBERS}) m ON c.id = m.id")
def prj_03_defaults(spark, sf):
    found, ids = shared(spark, sf)
    return joins.merge(comments(spark, sf).select("id"), found.withColumn("comment_count", F.col("comment_count").cast("int")), ids).select("id", "lookup_id", "comment_count")


@query(f"SELECT c.id, coalesce(m.n, 1)::INTEGER AS comment_count FROM ({COMMENTS}) c LEFT JOIN ({MEMBERS}) m ON c.id = m.id")
def prj_08_group_sizes(spark, sf):
    return prj_03_defaults(spark, sf).select("id", "comment_count")


@query(f"SELECT c.id FROM ({COMMENTS}) c WHERE c.id NOT IN (SELECT id FROM ({MEMBERS}))")
def join_03_unmatched(spark, sf):
    return joins.unmatched(comments(spark, sf), shared(spark, sf)[1]).select("id")


@query(f"SELECT m.lookup_id, md5(string_agg(d.text, chr(10) || chr(10) ORDER BY d.doc_id)) AS digest FROM ({MEMBERS}) m JOIN documents d ON d.doc_id = m.id GROUP BY 1")
def join_10_ordered_texts(spark, sf):
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return joins.sidecar_texts(shared(spark, sf)[1], own).select("lookup_id", F.md5("text").alias("digest"))


@query(f"SELECT lookup_id, CASE WHEN first_id % 2 = 0 THEN '7' END AS cluster_id FROM ({LOOKUPS})")
def join_11_relabel(spark, sf):
    all_ = entries(spark, sf)
    found = all_.filter("seq % 2 = 0").select("lookup_id", F.lit("7").alias("cluster_id"), F.lit(0.0).alias("pca_x"), F.lit(0.0).alias("pca_y"))
    blank = {"cluster_id": F.lit(None).cast("string"), "pca_x": F.lit(None).cast("double"), "pca_y": F.lit(None).cast("double")}
    return joins.relabel(all_.withColumns(blank), found).select("lookup_id", "cluster_id")


@query("SELECT doc_id AS id, CASE WHEN source IN ('For', 'Against', 'Neutral/Unclear') THEN source END AS stance, nullif(lang, 'en') AS organization, coalesce(NULL::INTEGER, 0) AS attachment_count FROM documents")
def prj_06_coercions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), V.known_stance(F.col("source")).alias("stance"), F.nullif("lang", F.lit("en")).alias("organization"), F.coalesce(F.lit(None).cast("int"), F.lit(0)).alias("attachment_count"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS even FROM documents")
def prj_10_yes_no(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), V.yes_no(F.col("doc_id") % 2 == 0).alias("even"))


@query(f"SELECT lookup_id FROM ({LOOKUPS}) WHERE list_contains(string_split(ids, ','), '5')")
def flt_15_membership(spark, sf):
    return lookup(spark, sf).filter(F.array_contains("comment_ids", F.lit(5).cast("long"))).select("lookup_id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (0, 3)")
def flt_20_excluded(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).filter(~F.col("id").isin(0, 3))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def flt_21_new_rows(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query(f"SELECT id FROM ({COMMENTS}) WHERE stance IS DISTINCT FROM 'For'")
def flt_22_deviations(spark, sf):
    return comments(spark, sf).filter(~F.col("stance").eqNullSafe("For")).select("id")


@query(f"SELECT id FROM ({VECTORS}) WHERE cluster_id IS NOT NULL AND (pca_x IS NULL OR pca_y IS NULL)")
def flt_23_without_place(spark, sf):
    return vectors(spark, sf).filter("cluster_id is not null and (pca_x is null or pca_y is null)").select("id")


@query(f"SELECT id FROM ({MEMBERS}) WHERE lookup_id = (SELECT min(lookup_id) FROM ({MEMBERS})) AND id <> (SELECT min(id) FROM ({MEMBERS}) WHERE lookup_id = (SELECT min(lookup_id) FROM ({MEMBERS})))")
def flt_24_related_others(spark, sf):
    found, ids = shared(spark, sf)
    first = found.orderBy("lookup_id").select("lookup_id", F.col("seq").alias("own")).first()
    rows = joins.related(comments(spark, sf), ids, first.lookup_id if first else "")
    return (rows.filter(F.col("id") != first.own) if first else rows).select("id")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 100 AND NOT starts_with(ltrim(text), '[') AND NOT starts_with(upper(ltrim(text)), 'ERROR')")
def flt_26_usable(spark, sf):
    return table(spark, sf, "documents").filter(V.usable_text(F.col("text"))).select("doc_id")


@query(f"SELECT coalesce(stance, 'Unknown') AS stance, count(*) AS n FROM ({COMMENTS}) GROUP BY 1")
def agg_27_distribution(spark, sf):
    return comments(spark, sf).groupBy(F.coalesce("stance", F.lit("Unknown")).alias("stance")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE abs(n_chars - length(text)) > 5")
def agg_24_length_mismatch(spark, sf):
    return quality.truncation_issues(table(spark, sf, "documents").withColumnsRenamed({"text": "truncated_text", "n_chars": "truncated_text_length"})).select("doc_id")


@query("SELECT lang AS ext, count(*) AS total, count(*) FILTER (length(text) >= 50) AS with_text, coalesce(floor(avg(length(text)) FILTER (length(text) >= 50)), 0)::BIGINT AS mean_length, round(count(*) FILTER (length(text) >= 50) / count(*) * 100, 6) AS success FROM documents GROUP BY 1")
def agg_26_extraction(spark, sf):
    return quality.extraction_stats(table(spark, sf, "documents").withColumnRenamed("lang", "ext")).withColumn("success", F.round("success", 6))


@query("SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents")
def agg_34_distinct(spark, sf):
    return table(spark, sf, "documents").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))


@query(f"SELECT count(*) AS entries FROM ({LOOKUPS}) WHERE len(list_intersect(string_split(ids, ','), ['1', '2', '3', '40'])) > 0")
def agg_35_new_entries(spark, sf):
    return lookup(spark, sf).filter(F.arrays_overlap("comment_ids", F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 40))))).agg(F.count(F.lit(1)).alias("entries"))


@query(f"SELECT cluster_id, arg_min(stance, id) FILTER (stance IS NOT NULL) AS first_stance, count(*) AS points FROM ({VECTORS}) GROUP BY 1")
def agg_37_picker(spark, sf):
    v = vectors(spark, sf)
    return v.groupBy("cluster_id").agg(F.min_by("stance", F.when(F.col("stance").isNotNull(), F.col("id"))).alias("first_stance"), F.count(F.lit(1)).alias("points"))


@query("SELECT a.item_id AS a, len(list_intersect(list_distinct(string_split(lower(a.text), ' ')), list_distinct(string_split(lower(b.text), ' '))))::INTEGER AS common FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def set_02_common_words(spark, sf):
    a = table(spark, sf, "benchmark")
    words = F.array_distinct(F.split(F.lower("text"), " "))
    left, right = a.select(F.col("item_id").alias("a"), words.alias("x")), a.select((F.col("item_id") - 1).alias("a"), words.alias("y"))
    return left.join(right, "a").select("a", F.size(F.array_intersect("x", "y")).alias("common"))


@query("SELECT doc_id AS id FROM documents UNION ALL SELECT conv_id + 1000000 FROM conversations")
def set_03_append(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, sf, "conversations").select((F.col("conv_id") + 1000000).alias("id")))


@query(f"SELECT first_id AS seq, lookup_id FROM ({LOOKUPS})")
def win_03_numbers(spark, sf):
    return entries(spark, sf).select("seq", "lookup_id")


@query("SELECT doc_id, 'lookup_' || lpad((100 + row_number() OVER (ORDER BY doc_id))::VARCHAR, 6, '0') AS lookup_id FROM documents")
def win_04_next_numbers(spark, sf):
    return dedup.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id", "n", 100).select("doc_id", T.lookup_id(F.col("n")).alias("lookup_id"))


@query("SELECT doc_id, '0' || chr((97 + doc_id % 20)::INTEGER) AS code FROM documents")
def win_10_child_codes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.child_code(F.lit("0"), (F.col("doc_id") % 20).cast("int")).alias("code"))


@query("SELECT item_id, lower(trim(translate(regexp_replace(text, '\\s+', ' ', 'g'), '—–', '--'))) AS cleaned, translate(text, '„‟«»‹›', '\"\"\"\"<>') AS quotes FROM benchmark")
def txt_07_cleaned(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.clean_for_comparison(F.col("text")).alias("cleaned"), T.normalize_quotes(F.col("text")).alias("quotes"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|')) AS items FROM documents")
def txt_10_lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(T.split_list(F.col("text")), "|")).alias("items"))


@query("SELECT doc_id, substring(text, 1, 25) AS prefix, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS short FROM documents")
def txt_18_prefix(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 25).alias("prefix"), T.smart_truncate(F.col("text"), 60).alias("short"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.html%' THEN 'text/html' WHEN lower(url) LIKE '%.htm%' THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages")
def txt_20_mime(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.mime_type(F.col("url"), F.lit("page")).alias("mime"))


@query(f"SELECT lookup_id, right(lookup_id, 6)::BIGINT AS number FROM ({LOOKUPS})")
def txt_22_numbers(spark, sf):
    return entries(spark, sf).select("lookup_id", T.lookup_number(F.col("lookup_id")).alias("number"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM events")
def dat_01_days(spark, sf):
    return table(spark, sf, "events").select("event_id", V.day(F.col("ts")).alias("day"), F.date_format(F.date_add("ts", 1), "yyyy-MM-dd").alias("next_day"))


@query("SELECT event_id, event_id % 2 = 0 AS iso FROM events")
def dat_02_iso(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")
    return table(spark, sf, "events").select("event_id", V.is_iso_date(F.when(F.col("event_id") % 2 == 0, text).otherwise(F.date_format("ts", "yyyy-MM-dd"))).alias("iso"))


@query("SELECT event_id, date_trunc('minute', ts) AS at FROM events")
def dat_03_parsed(spark, sf):
    return table(spark, sf, "events").select("event_id", V.parse_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")).alias("at"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def jsn_01_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query(f"SELECT user_id, sum(value) FILTER (event_type = 'click') IS NOT NULL AS clicked, count(*) AS n FROM ({EVENTS}) GROUP BY 1")
def map_01_counters(spark, sf):
    e = events(spark, sf)
    return e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") > 0).alias("clicked"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT lookup_id, array_to_string(string_split(ids, ',')[1:3], ',') AS first_ids, n::INTEGER AS size FROM ({LOOKUPS})")
def arr_01_slices(spark, sf):
    return lookup(spark, sf).select("lookup_id", F.array_join(F.transform(F.slice("comment_ids", 1, 3), lambda x: x.cast("string")), ",").alias("first_ids"), F.size("comment_ids").alias("size"))


@query("SELECT doc_id, (doc_id % 3 * 20 + doc_id % 15)::INTEGER AS colour FROM documents")
def clr_01_colours(spark, sf):
    letter = F.char(F.lit(97) + (F.col("doc_id") % 15).cast("int"))
    return table(spark, sf, "documents").select("doc_id", V.colour_index((F.col("doc_id") % 3).cast("int"), letter).alias("colour"))


@query(f"SELECT count(*) AS entries, 0::BIGINT AS analysed, sum(n)::BIGINT AS comments FROM ({GROUPS})")
def src_05_clusterable(spark, sf):
    return readers.clusterable_stats(dedup.lookup_rows(texts(spark, sf), entries(spark, sf)))


@query("SELECT count(*) AS n FROM documents WHERE left(text, 40) <> '' AND NOT contains(text, upper(left(text, 40)))")
def txt_09_quote_cascade(spark, sf):
    d = table(spark, sf, "documents").filter("substring(text, 1, 40) != ''").withColumn("key_quote", F.upper(F.substring("text", 1, 40)))
    return quotes.verify(d, text="text").filter("match_type != 'exact'").agg(F.count(F.lit(1)).alias("n"))


@query()
def ml_09_sample(spark, sf):
    return clusters.sample_ids(vectors(spark, sf), 100).select("id")


@query()
def udf_08_descriptions(spark, sf):
    return clusters.describe(stats.keywords(table(spark, sf, "documents"), "lang", "text"), "lang")


# Operators on tables that hold odd cases

SEARCHED = "SELECT page_id AS id, url AS attachment_urls, 'Doc ' || page_id AS document_type, CASE WHEN page_id % 3 = 0 THEN 'a\\b' || page_id ELSE 'none' END AS submitter_name, html AS truncated_text FROM pages"


def searched(spark, sf):
    """Pages as comments that have the fields which only a search looks at."""
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a\\b"), F.col("page_id").cast("string"))).otherwise("none")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("attachment_urls"), F.concat(F.lit("Doc "), F.col("page_id").cast("string")).alias("document_type"), name.alias("submitter_name"), F.col("html").alias("truncated_text"))


def _searched(name: str, where: str, options: QueryOptions) -> None:
    query(f"SELECT id FROM ({SEARCHED}) WHERE {where}", name)(lambda spark, sf: filters.apply_filters(searched(spark, sf), options).select("id"))


_searched("flt_08_url_key", "attachment_urls ILIKE '%example.org%'", QueryOptions({"attachmentUrls": "example.ORG"}))
_searched("flt_13_default_fields", "attachment_urls ILIKE '%doc 1%' OR document_type ILIKE '%doc 1%' OR submitter_name ILIKE '%doc 1%'", QueryOptions(search="DOC 1"))
_searched("flt_13_backslash", "contains(lower(submitter_name), 'a\\b1')", QueryOptions(search="A\\b1"))


@query("SELECT event_id, event_type AS stance FROM events WHERE starts_with('Error: ' || event_type, 'Error: c') AND event_id % 2 = 0")
def flt_25_errors(spark, sf):
    e = table(spark, sf, "events")
    marked = e.withColumn("rationale", F.when((F.col("event_id") % 2 == 0) & F.col("event_type").startswith("c"), F.concat(F.lit("Error: "), "event_type")).otherwise(F.col("event_type")))
    return quality.failed_rows(marked).select("event_id", F.col("event_type").alias("stance"))


FLAT_STOP = ", ".join(f"'{w}'" for w in sorted(stats.FLAT_STOP_WORDS))


@query(f"WITH w AS (SELECT lang, doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))) AS word, generate_subscripts(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')), 1) AS pos FROM documents), c AS (SELECT lang, word, count(*) AS freq, min((doc_id, pos)) AS first FROM w WHERE word NOT IN ({FLAT_STOP}) GROUP BY 1, 2) SELECT lang, word, freq, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, first)::INTEGER AS rank FROM c) WHERE rank <= 15")
def agg_11_flat_keywords(spark, sf):
    return stats.keywords(table(spark, sf, "documents"), "lang", "text", 15, stats.FLAT_STOP_WORDS, "doc_id").select("lang", "word", "freq", "rank")


LABELLED = "SELECT doc_id AS lookup_id, CASE WHEN toxic = 1 THEN 'Against' WHEN doc_id % 5 <> 0 THEN 'For' END AS stance, CASE WHEN doc_id % 7 <> 0 THEN 'q' END AS key_quote FROM labels"


@query(f"WITH r AS ({LABELLED}), m AS (SELECT DISTINCT doc_id AS id FROM documents), l AS (SELECT DISTINCT lookup_id AS id FROM r) SELECT (SELECT count(*) FROM m WHERE id <> 0) AS csv_count, (SELECT count(*) FROM documents) AS raw_count, (SELECT count(*) FROM documents) AS data_count, 0::BIGINT + (SELECT count(*) FROM m WHERE id <> 0 AND id NOT IN (SELECT id FROM m)) AS missing_from_raw, (SELECT count(*) FROM m WHERE id <> 0 AND id NOT IN (SELECT id FROM l)) AS missing_from_lookup, (SELECT count(*) FROM r) AS lookup_entries, (SELECT count(*) FROM r WHERE stance IS NULL) AS unanalysed, (SELECT count(*) FROM r WHERE stance IS NOT NULL AND key_quote IS NULL) AS partly_analysed, (SELECT count(*) FROM documents LEFT JOIN r ON doc_id = lookup_id WHERE stance IS NULL) AS data_without_lookup, round((SELECT count(stance) / count(*) FROM r) * 100, 6) AS analysis_rate, false AS valid")
def val_04_output(spark, sf):
    labels, d = table(spark, sf, "labels"), table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    stance = F.when(F.col("toxic") == 1, "Against").when(F.col("doc_id") % 5 != 0, "For")
    rows = labels.select(F.col("doc_id").alias("lookup_id"), stance.alias("stance"), F.when(F.col("doc_id") % 7 != 0, "q").alias("key_quote"), F.lit("").alias("rationale"), F.lit("").alias("themes"))
    data = d.join(rows.withColumn("id", F.col("lookup_id")), "id", "left")
    return quality.output_check(d, d, data, rows, rows.withColumn("id", F.col("lookup_id")), (0,)).withColumn("analysis_rate", F.round("analysis_rate", 6))


@query("SELECT max(least(length(text), 1000)) AS most, bool_or(length(text) > 1000) AS cut, max(length(text)) > max(least(length(text), 1000)) AS longer FROM documents")
def val_06_truncation(spark, sf):
    size = F.length("text").cast("long")
    return quality.truncation_state(table(spark, sf, "documents").select(F.least(size, F.lit(1000)).alias("truncated_text_length"), size.alias("full_text_length")))


@query("WITH t AS (SELECT length(regexp_replace(coalesce(text, ''), '<.*?>', '', 'g')) / 4 AS v FROM documents), s AS (SELECT median(v) AS m, quantile_cont(v, 0.95) AS p, max(v) AS x FROM t), r AS (SELECT unnest(list_filter([CASE WHEN m <= 256 THEN {'t': 256, 'd': 384} END, CASE WHEN m <= 256 THEN {'t': 384, 'd': 768} END, CASE WHEN p <= 512 THEN {'t': 512, 'd': 384} END, CASE WHEN x > 512 THEN {'t': 512, 'd': 768} END, CASE WHEN x > 1000 THEN {'t': 512, 'd': 768} END, {'t': 8192, 'd': 1536}], lambda q: q IS NOT NULL)) AS q FROM s) SELECT (row_number() OVER ())::INTEGER AS position, q.t AS max_tokens, q.d AS dimensions FROM r")
def ml_10_models(spark, sf):
    return enrich.recommend(stats.length_stats(table(spark, sf, "documents"), "text"))


@query("SELECT conv_id, md5(regexp_replace(coalesce(comment, ''), '<.*?>', '', 'g') || coalesce(other, '')) AS digest FROM (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS comment, string_agg(chr(10) || chr(10) || text, '' ORDER BY turn) FILTER (turn > 0 AND text <> '') AS other FROM conversations GROUP BY 1)")
def txt_06_stripped(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("comment"), F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text")))).alias("a"))
    return c.select("conv_id", F.md5(T.stripped_text(F.col("comment"), F.transform("a", lambda x: x["text"]))).alias("digest"))


@query("SELECT doc_id, left(regexp_replace(text, '[^\\p{L}\\p{N}_\\- ]', '', 'g'), 50) AS name FROM documents")
def txt_19_safe_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.safe_name(F.col("text")).alias("name"))


@query("SELECT event_id, CASE WHEN length(b) > 0 THEN b ELSE '' END AS object FROM (SELECT event_id, regexp_extract('reply: ' || props || CASE WHEN event_id % 2 = 0 THEN ' done' ELSE '' END, '(?s)\\{.*\\}') AS b FROM events)")
def txt_23_reply(spark, sf):
    reply = F.concat(F.lit("reply: "), "props", F.when(F.col("event_id") % 2 == 0, " done").otherwise(""))
    return table(spark, sf, "events").select("event_id", T.json_object(reply).alias("object"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN n > 100 AND NOT starts_with(t, '[') AND NOT starts_with(upper(t), 'ERROR') THEN text WHEN length(coalesce(r, '')) > length(text) AND NOT starts_with(r, '[') AND length(r) > 50 THEN r WHEN n > 50 THEN text END AS best FROM (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, CASE WHEN doc_id % 2 = 0 THEN repeat('remote ', 20) ELSE '[failed]' END AS r FROM documents WHERE text IS NOT NULL)")
def udf_06_best_text(spark, sf):
    remote = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("remote "), 20)).otherwise("[failed]")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", enrich.best_text(F.col("text"), remote).alias("best"))


@query("SELECT dense_rank() OVER (ORDER BY label)::INTEGER - 1 AS flat, vec_id AS id FROM embeddings")
def ml_11_flat_labels(spark, sf):
    return clusters.flat_labels(vectors(spark, sf).withColumn("cluster_id", F.col("cluster_id"))).select("id", "flat")


REBUILT = f"""WITH l AS ({LOOKUPS}), m AS (SELECT lookup_id, unnest(string_split(ids, ','))::BIGINT AS id FROM l),
touched AS (SELECT DISTINCT lookup_id FROM m JOIN pages ON page_id = id),
p AS (SELECT lookup_id, id, 0 AS k, text AS piece FROM m JOIN documents ON doc_id = id WHERE text <> '' UNION ALL SELECT lookup_id, id, 1, html FROM m JOIN pages ON page_id = id)
SELECT lookup_id, CASE WHEN min(k) = 1 THEN 'attachment' ELSE 'both' END AS text_source, md5(left(string_agg(piece, chr(10) || chr(10) ORDER BY id, k), 1000)) AS digest FROM p JOIN touched USING (lookup_id) GROUP BY 1
UNION ALL SELECT lookup_id, 'comment', md5(trim(text)) FROM l JOIN documents ON doc_id = first_id WHERE lookup_id NOT IN (SELECT lookup_id FROM touched)"""


@query(REBUILT)
def udf_10_rebuilt(spark, sf):
    """Pages are the attachments that documents of their number have got since."""
    own = texts(spark, sf)
    found, ids = dedup.entries(own)
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"), F.col("html").alias("text"))
    out = joins.rebuilt_texts(dedup.lookup_rows(own, found).drop("seq"), ids, comments(spark, sf), pages, pages.select("id"))
    return out.select("lookup_id", "text_source", F.md5("truncated_text").alias("digest"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def udf_05_rtf(spark, sf):
    """Documents as RTF files, each byte escaped, and their texts out of these."""
    body = F.regexp_replace(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "(..)", r"\\'$1")
    content = F.encode(F.concat(F.lit(r"{\rtf1\ansi\ansicpg65001{\fonttbl{\f0 Times;}}\f0 "), body, F.lit("}")), "US-ASCII")
    files = table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".rtf")).alias("path"), content.alias("content"))
    text = F.when(F.col("text") == office.EMPTY_RTF, "").otherwise(F.col("text"))
    return enrich.extract(files, office.local_text).select(F.split("path", "[.]")[0].cast("long").alias("doc_id"), F.md5(text).alias("digest"))


HASHED = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
c AS (SELECT doc_id, ('0x' || left(md5(word), 8))::BIGINT % 256 AS dim, count(*) AS n FROM w GROUP BY 1, 2),
v AS (SELECT doc_id, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS x FROM c)
SELECT d.doc_id, count(v.dim) AS dims, coalesce(round(max(x), 6), 0) AS peak, coalesce(round(sum(x * dim), 4), 0) AS weighted FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY 1"""


@query(HASHED)
def ml_01_embeddings(spark, sf):
    d = embeddings.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", embeddings.HashedEncoder()).withColumn("v", F.col("embedding").cast("array<double>"))
    weighted = F.aggregate(F.transform("v", lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
    return d.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("dims"), F.round(F.array_max("v"), 6).alias("peak"), F.round(weighted, 4).alias("weighted"))


@query("SELECT doc_id, lang || '|' || source || '; ' || source || '|Attachment; ' || doc_id || '|Attachment' AS links FROM documents")
def txt_12_links(spark, sf):
    d = table(spark, sf, "documents")
    links = T.zip_links(F.concat_ws("; ", "lang", "source", "doc_id"), F.concat_ws("; ", "source", F.lit("")))
    return d.select("doc_id", F.array_join(F.transform(links, lambda x: F.concat_ws("|", x["url"], x["title"])), "; ").alias("links"))


@query("SELECT doc_id::VARCHAR AS lookup_id, md5(left(coalesce(text, ''), 1003)) AS digest, least(length(coalesce(text, '')), 1003)::INTEGER AS truncated_text_length, '' AS text_source FROM documents")
def val_07_repaired(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("lookup_id"), F.col("text").alias("truncated_text"), F.lit(True).alias("corrected"))
    return quality.repair_lookup(d).select("lookup_id", F.md5("truncated_text").alias("digest"), "truncated_text_length", "text_source")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def txt_05_entities(spark, sf):
    """Texts with references for some of their characters, decoded."""
    text = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    for char, reference in {"é": "&eacute;", "ç": "&#231;", "è": "&#xE8;", "ü": "&uuml;", "<": "&lt;", ",": "&comma;"}.items():
        text = F.replace(text, F.lit(char), F.lit(reference))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_html(text)).alias("digest"))


QUOTED = """WITH q AS (SELECT doc_id::VARCHAR AS lookup_id, CASE WHEN lang = 'en' OR lang = 'fr' AND contains(text, upper(left(text, 40))) THEN 0
WHEN lang = 'fr' AND length(trim(regexp_replace(left(text, 40), '\\s+', ' ', 'g'))) > 20 THEN 2 ELSE 1 END AS section FROM documents WHERE coalesce(text, '') <> ''),
s AS (SELECT * FROM q WHERE section > 0) SELECT section, row_number() OVER (PARTITION BY section ORDER BY lookup_id) AS number, lookup_id, '' AS summary FROM s
UNION ALL SELECT DISTINCT section, 0, NULL, '' FROM s
UNION ALL SELECT 0, 0, NULL, 'Quotes found (exact): ' || count(*) FILTER (section = 0) || ' (' || round(count(*) FILTER (section = 0) / count(*) * 100, 1) || '%)' FROM q"""


@query(QUOTED)
def snk_07_quote_report(spark, sf):
    """Quotes that are the text's own beginning in English, that in capitals in French, and that backwards after a dagger elsewhere."""
    own = F.substring("text", 1, 40)
    quote = F.when(F.col("lang") == "en", own).when(F.col("lang") == "fr", T.capitals(own)).otherwise(F.concat(F.lit("†"), F.reverse(own)))
    d = table(spark, sf, "documents").filter("coalesce(text, '') != ''")
    rows = d.select(F.col("doc_id").cast("string").alias("lookup_id"), F.lit(1).alias("comment_count"), quote.alias("key_quote"), F.col("text").alias("truncated_text"))
    summary = F.when(F.col("section") == 0, F.regexp_extract("text", "Quotes found .exact.: .*", 0)).otherwise("")
    return quotes.report(quotes.verify(rows)).select(F.col("section").cast("long").alias("section"), "number", "lookup_id", summary.alias("summary"))
