"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.plans.register import query
from quillon.sources.tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"


@query("text_features_v1", f"""{D}, w AS (SELECT doc_id, text, {WORDS} AS w FROM d)
SELECT doc_id, length(text) AS n_chars, len(w) AS n_words, CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, chr(10), '')) + 1 ELSE 0 END AS n_lines,
 len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[\\t\\n\\r]', ' ', 'g')) <> '')) AS n_sentences,
 CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 2) ELSE 0 END AS avg_word_len, len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+([.,][0-9]+)?'))) AS n_numeric,
 len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_unique, CASE
  WHEN len(w) > 0 THEN round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w), 4) ELSE 0 END AS lexical_diversity FROM w""")
def text_features_v1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in X.basic_features(F.col("text")).items()))


def _list(xs):
    return ", ".join(f"'{x}'" for x in xs)


_NEG = f"len(list_filter(t, lambda x: x IN ({_list(X.NEGATIONS)})))"
_UNSURE = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN 1 ELSE 0 END" for p in X.UNCERTAIN) + ")"
_SENT = "len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[\\t\\n\\r]', ' ', 'g')) <> ''))"


def _rate(x: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round({x} / {n}, 6) ELSE 0 END"


@query("text_features_v2", f"""{D}, t AS (SELECT doc_id, text, {TOKENS} AS t FROM d)
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_unique, {_rate('len(list_distinct(t))', 'len(t)')} AS lexical_diversity,
 CASE WHEN len(t) > 0 THEN round(length(array_to_string(t, '')) / len(t), 4) ELSE 0 END AS avg_token_len, {_SENT} AS n_sentences, {_rate('len(t)', _SENT)} AS avg_sentence_len,
 {_NEG} AS n_negations, {_rate(_NEG, 'len(t)')} AS negation_rate, {_UNSURE} AS n_uncertain, {_rate(_UNSURE, 'len(t)')} AS uncertainty_rate, length(text) AS n_chars FROM t""")
def text_features_v2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in X.token_features(F.col("text")).items()))


@query("negation_uncertainty", f"{D}, t AS (SELECT lang, {TOKENS} AS t FROM d) SELECT lang, count(*) AS n_docs, CAST(sum(len(list_filter(t, "
    f"lambda x: x IN ({_list(X.NEGATIONS)})))) AS BIGINT) AS negations, CAST(sum(len(t)) AS BIGINT) AS tokens FROM t GROUP BY lang")
def negation_uncertainty(spark, sf_dir):
    f = X.token_features(F.col("text"))
    return docs(spark, sf_dir).select("lang", f["n_negations"].alias("a"), f["n_tokens"].alias("b")).groupBy("lang").agg(F.count("*").alias("n_docs"),
        F.sum("a").alias("negations"), F.sum("b").alias("tokens"))


@query("token_freq", f"{D} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM d) GROUP BY token")
def token_freq(spark, sf_dir):
    """Counts within documents first: a token's distinct documents are then a plain count."""
    t = docs(spark, sf_dir).select("doc_id", F.explode(X.word_tokens(F.col("text"))).alias("token"))
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


@query("phi_rule_counts", f"{D} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(coalesce(sum(len(regexp_extract_all(text, '(?i){p}'))), 0) AS BIGINT) AS n, count(*) "
    f"FILTER (regexp_matches(text, '(?i){p}')) AS n_docs FROM d" for n, p in X.REDACTION_RULES))
def phi_rule_counts(spark, sf_dir):
    """Each rule runs at most once over a text, if it can match; sums of matches and of texts with one come from that."""
    text = F.col("text")
    signs = docs(spark, sf_dir).select("text", X.spared(text).alias("_spared"), text.rlike("[0-9]").alias("_digit"), text.rlike(X.as_in_sql(X.SIGNS)).alias("_sign"))
    worth = {n: F.lit(True) if n == "CITY" else F.col("_digit") if n in X.WITH_DIGIT else F.col("_sign") for n, _ in X.REDACTION_RULES}
    found = signs.select(*(F.when(worth[n], X.spared_count(F.col("_spared"), text, p)).otherwise(0).alias(n) for n, p in X.REDACTION_RULES))
    one = found.agg(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.count_if(F.col(n) > 0).alias("n_docs")).alias(n) for n, _ in X.REDACTION_RULES))
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


def _redact_sql(rules) -> str:
    out = "text"
    for n, p in rules:
        out = f"regexp_replace({out}, '{p}', '[{n}]', 'gi')"
    return out


@query("redact_text", f"{D} SELECT doc_id, md5({_redact_sql(X.REDACTION_RULES)}) AS redacted_md5 FROM d")
def redact_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.redact(F.col("text"))).alias("redacted_md5"))


def _simple_sql(text: str) -> str:
    for p, new, folded in X.SIMPLE_RULES:
        text = f"regexp_replace({text}, '{p}', '{new}', '{'gi' if folded else 'g'}')"
    return text


@query("redact_simple", f"{D}, r AS (SELECT doc_id, text, {_simple_sql('text')} AS r FROM d) SELECT doc_id, length(r) - length(text) AS delta, r = text AS unchanged, md5(r) AS redacted_md5 FROM r")
def redact_simple(spark, sf_dir):
    r = docs(spark, sf_dir).withColumn("r", X.redact_simple(F.col("text")))
    return r.select("doc_id", (F.length("r") - F.length("text")).alias("delta"), (F.col("r") == F.col("text")).alias("unchanged"), F.md5("r").alias("redacted_md5"))


_NOTE = (
    "'seen on 03/04/2021 at 10:30 AM, aged ' || (80 + page_id % 25) || ', MRN: ' || (1000000 + page_id) || ', "
    "call (212) 555-0' || (100 + page_id % 900) || ' or x' || page_id || '@y.org, ZIP 10001'"
)


@query("redact_nested_json", f"SELECT page_id, {_simple_sql(_NOTE)} AS note, {_simple_sql('url')} AS url, page_id AS number FROM pages")
def redact_nested_json(spark, sf_dir):
    """A nested document built of each page, every string in it redacted, and read back at its paths."""
    note = F.expr(_NOTE)
    nested = F.struct(F.struct(note.alias("note"), F.array(F.col("url")).alias("urls")).alias("summary"), F.col("page_id").alias("number"))
    p = table(spark, sf_dir, "pages").select("page_id", nested.alias("j"))
    r = p.select("page_id", X.redact_json(F.col("j"), p.schema["j"].dataType).alias("j"))
    return r.select("page_id", F.col("j.summary.note").alias("note"), F.col("j.summary.urls")[0].alias("url"), F.col("j.number").alias("number"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM d)"
_BOXWORDS = "list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '')"


@query("redaction_boxes", f"""{D}, {_LINES}, t AS (SELECT doc_id, line_no, unnest({_BOXWORDS}) AS token, unnest(range(0, len({_BOXWORDS}))) AS word_no FROM l),
n AS (SELECT *, regexp_replace(lower(token), '[^a-z0-9]+', '', 'g') AS norm FROM t),
c AS (SELECT *, coalesce(max(CASE WHEN norm IN ({_list(X.CONTEXT_LABELS)}) THEN 1
  ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN {X.AFTER_LABEL} PRECEDING AND 1 PRECEDING), 0) = 1 AND norm <> '' AS near,
  coalesce({', '.join(f"CASE WHEN regexp_matches(token, '(?i){p}') THEN '{n}' END" for n, p in X.REDACTION_RULES)}) AS rule FROM n)
SELECT doc_id, line_no, word_no, token, rule FROM c WHERE rule <> 'MRN_NUMBER' UNION ALL SELECT doc_id, line_no, word_no, token, 'CONTEXT_AFTER_LABEL' FROM c WHERE near""")
def redaction_boxes(spark, sf_dir):
    line = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    token = line.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode(X.words(F.col("line"))).alias("word_no", "token")).withColumn("word_no", F.col("word_no").cast("long"))
    return X.redaction_boxes(token, ["doc_id", "line_no"], "word_no").select("doc_id", "line_no", "word_no", "token", "rule")


@query("token_rules", f"{D}, t AS (SELECT doc_id, unnest({WORDS}) AS w FROM d) "
    f"SELECT coalesce({', '.join(f'''CASE WHEN regexp_matches(w, '(?i){p}') THEN '{n}' END''' for n, p in X.REDACTION_RULES)}) AS rule, "
    f"count(*) AS n FROM t GROUP BY ALL")
def token_rules(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.explode(X.words(F.col("text"))).alias("w"))
    return t.groupBy(X.first_rule(F.col("w")).alias("rule")).agg(F.count("*").alias("n"))


LABELS = ("the", "el", "der", "le")


@query("context_after_label", f"{D}, t AS (SELECT doc_id, unnest({TOKENS}) AS token, unnest(range(0, len({TOKENS}))) AS pos FROM d), w AS (SELECT token, "
    f"coalesce(max(CASE WHEN token IN ({_list(LABELS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING "
    f"AND 1 PRECEDING), 0) AS f FROM t) SELECT token, count(*) AS n FROM w WHERE f = 1 GROUP BY token")
def context_after_label(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.posexplode(X.word_tokens(F.col("text"))).alias("pos", "token"))
    return X.after_labels(t, LABELS, 3, "doc_id", "pos").where("near_label").groupBy("token").agg(F.count("*").alias("n"))


@query("normalise_token", f"{D}, t AS (SELECT regexp_replace(lower(unnest({WORDS})), '[^a-z0-9]+', '', 'g') AS token FROM d) SELECT length(token) AS n_chars, count(*) AS n FROM t GROUP BY ALL")
def normalise_token(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.explode(X.words(F.col("text"))).alias("w"))
    return t.groupBy(F.length(F.regexp_replace(F.lower("w"), "[^a-z0-9]+", "")).alias("n_chars")).agg(F.count("*").alias("n"))


@query("case_id_hash", "SELECT doc_id, 'CASE_' || upper(substr(sha256(source || ':' || doc_id), 1, 12)) AS case_id, substr(md5(coalesce(text, '')), 1, 12) AS text_hash FROM documents")
def case_id_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.case_id(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("case_id"), F.substring(F.md5("text"), 1, 12).alias("text_hash"))


@query("chunk_documents", f"{D}, c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS chunk_no FROM d "
    f"WHERE length(text) > 0) SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, md5(substr(text, chunk_no * 450 + 1, 500)) AS chunk_md5 FROM c")
def chunk_documents(spark, sf_dir):
    return X.chunks(docs(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query("clean_text", f"{D} SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7E\\x0A\\x0D\\x09\\x{{00A0}}-\\x{{FFFF}}]', '', 'g'), "
    f"'[ \\t\\n\\r]+', ' ', 'g'))) AS clean_md5 FROM d")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.collapse(F.col("text"))).alias("clean_md5"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, "
    "count(DISTINCT json_extract_string(props, '$.k')) AS n_k, count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS n_absent "
    "FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("m"))
    return e.groupBy("event_type").agg(F.sum(F.col("k").cast("long")).alias("sum_k"), F.count_distinct("k").alias("n_k"), F.count_if(F.col("m").isNull()).alias("n_absent"))


@query("fence_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fence_parse(spark, sf_dir):
    """The JSON of a fenced answer: the fence is put on here, then taken off and parsed."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(X.unfenced(fenced), "k bigint").getField("k").alias("k"))


@query("kv_lines", "WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations) SELECT role_key "
    "AS line_key, count(*) AS n FROM (SELECT CASE WHEN contains(line, ', ') THEN lower(trim(string_split(line, ', ')[1])) END AS role_key "
    "FROM l) WHERE role_key IS NOT NULL GROUP BY ALL")
def kv_lines(spark, sf_dir):
    line = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    key = F.lower(F.trim(F.substring_index("line", ", ", 1)))
    return line.where(F.contains("line", F.lit(", "))).groupBy(key.alias("line_key")).agg(F.count("*").alias("n"))


@query("not_reported_flag", f"WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Not Reported' WHEN 1 THEN ' N/A ' WHEN 2 THEN '' WHEN 3 THEN 'unknown' "
    f"ELSE p_name END AS v FROM part) SELECT p_partkey, lower(trim(v)) NOT IN ({_list(X.NOT_REPORTED)}) AS present FROM v")
def not_reported_flag(spark, sf_dir):
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, "Not Reported").when(k == 1, " N/A ").when(k == 2, "").when(k == 3, "unknown").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", (~F.lower(F.trim(v)).isin(*X.NOT_REPORTED)).alias("present"))


@query("prompt_render", f"{D} SELECT doc_id, md5(replace('Find the element in: <<<TEXT>>>', '<<<TEXT>>>', substr(text, 1, 8000))) AS prompt_md5 FROM d")
def prompt_render(spark, sf_dir):
    """A prompt's text limit is part of the feature: models take so much."""
    return docs(spark, sf_dir).select("doc_id", F.md5(F.replace(F.lit("Find the element in: <<<TEXT>>>"), F.lit("<<<TEXT>>>"), F.substring("text", 1, 8000))).alias("prompt_md5"))


_ANSWERS = """CASE event_id % 7 WHEN 0 THEN 'Here: {"value": "' || event_type || '", "note": "n/a"} done' WHEN 1 THEN '{"value": "Not reported"}' WHEN 2 THEN 'It is not stated.' WHEN 3 THEN 'illegible scan'
 WHEN 4 THEN '  ' WHEN 5 THEN '{broken' ELSE 'Grade ' || event_id END"""


@query("parse_response", f"""WITH a AS (SELECT event_id, trim({_ANSWERS}) AS raw FROM events), j AS (SELECT *, regexp_extract(raw, '(?s)\\{{[^{{}}]+\\}}') AS block FROM a),
v AS (SELECT *, CASE WHEN json_valid(block) THEN list_filter([json_extract_string(block, '$.value'), json_extract_string(block, '$.note')], lambda x: x IS NOT NULL) END AS vs FROM j)
SELECT event_id, CASE WHEN vs IS NOT NULL THEN len(list_filter(vs, lambda x: lower(x) NOT IN ({_list(X.NOT_REPORTED)}, 'false'))) > 0
  WHEN regexp_matches(lower(raw), 'not reported|not stated|not mentioned') THEN false ELSE length(raw) > 0 END AS present,
 CASE WHEN vs IS NOT NULL THEN array_to_string(vs, '; ') WHEN regexp_matches(lower(raw), 'not reported|not stated|not mentioned') THEN 'Not reported'
  WHEN regexp_matches(lower(raw), 'unclear|illegible') THEN 'Unclear (illegible)' ELSE substr(raw, 1, 200) END AS value FROM v""")
def parse_response(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", F.expr(_ANSWERS).alias("raw"))
    return a.select("event_id", *(c.alias(k) for k, c in X.parse_response(F.col("raw")).items()))


@query("key_value_lines", "WITH l AS (SELECT event_id, "
    "unnest(string_split('Event Type: ' || event_type || chr(10) || 'no colon' || chr(10) || 'At: ' || strftime(ts, "
    "'%Y-%m-%d %H:%M:%S') || chr(10) || 'Value : ' || value, chr(10))) AS line FROM events) SELECT event_id, "
    "replace(lower(trim(split_part(line, ':', 1))), ' ', '_') AS element, trim(substr(line, instr(line, ':') + 1)) AS value FROM l "
    "WHERE contains(line, ':')")
def key_value_lines(spark, sf_dir):
    note = F.concat(F.lit("Event Type: "), F.col("event_type"), F.lit("\nno colon\nAt: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\nValue : "), F.col("value").cast("string"))
    return X.key_value_lines(table(spark, sf_dir, "events").select("event_id", note.alias("note")), "note", ["event_id"])


@query("explanation_fields", "SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'a: b' END AS reason, CAST(NULL AS VARCHAR) AS absent FROM events")
def explanation_fields(spark, sf_dir):
    text = F.concat(F.lit("kind : old; kind: "), F.col("event_type"), F.lit(" ; nothing"), F.when(F.col("event_id") % 3 == 0, "; reason: a: b").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in X.explanation_fields(text, ["kind", "reason", "absent"]).items()))


@query("prompt_interpolations", " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, 'Find ' || p_name || ' in ' || p_brand || '.' AS prompt FROM part" for k in X.INTERPOLATIONS))
def prompt_interpolations(spark, sf_dir):
    """One template in each way of writing variables."""
    p = table(spark, sf_dir, "part")
    made = [F.struct(F.lit(k).alias("kind"), X.interpolate(F.lit(f"Find {v % 'what'} in {v % 'where'}."), {"what": F.col("p_name"),
        "where": F.col("p_brand")}, k).alias("prompt")) for k, v in X.INTERPOLATIONS.items()]
    return p.select("p_partkey", F.explode(F.array(*made)).alias("x")).select("p_partkey", "x.*")


@query("json_path_default", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, 'none' AS deep FROM events")
def json_path_default(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_path(F.col("props"), "$.k").alias("k"), X.json_path(F.col("props"), "$.a.b", "none").alias("deep"))


@query("recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return X.chunked_recursively(docs(spark, sf_dir)).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query("prompt_limits", f"{D} SELECT doc_id, n AS max_chars, md5(replace('Read: <<<PDF_TEXT>>>', '<<<PDF_TEXT>>>', substr(text, 1, n))) AS prompt_md5 FROM d, (VALUES (12000), (8000), (512)) v(n)")
def prompt_limits(spark, sf_dir):
    """The three text limits of prompts; a limit is a feature of the prompt."""
    d = docs(spark, sf_dir).withColumn("max_chars", F.explode(F.array(*map(F.lit, (12000, 8000, 512)))))
    return d.select("doc_id", "max_chars", F.md5(F.replace(F.lit("Read: <<<PDF_TEXT>>>"), F.lit("<<<PDF_TEXT>>>"), F.substr("text", F.lit(1), F.col("max_chars")))).alias("prompt_md5"))


@query("report_type_classify", "SELECT page_id, CASE WHEN regexp_matches(lower(url), 'feed|rss') THEN 'feed' WHEN regexp_matches(lower(url), '/(en|de|fr|es)/') "
    "THEN 'language' WHEN regexp_matches(lower(url), 'example') THEN 'example' ELSE 'other' END AS kind FROM pages")
def report_type_classify(spark, sf_dir):
    u = F.lower("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(u.rlike("feed|rss"), "feed").when(u.rlike("/(en|de|fr|es)/"),
        "language").when(u.rlike("example"), "example").otherwise("other").alias("kind"))


@query("date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, monthname(o_orderdate) AS month_name, hour(o_orderdate) AS h, dayofmonth(o_orderdate) "
    "AS dom, dayname(o_orderdate) AS day_name, 2024 - year(o_orderdate) AS age FROM orders")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.date_format(d, "MMMM").alias("month_name"),
        F.hour(d).cast("long").alias("h"), F.dayofmonth(d).cast("long").alias("dom"), F.date_format(d, "EEEE").alias("day_name"),
        (2024 - F.year(d)).cast("long").alias("age"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://([^/]+)', 1) AS host, "
    "len(regexp_extract_all(html, '<a href')) AS n_links FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("(<a href)"), F.lit(1))).alias("n_links"))


@query("page_quality_rollup", "SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n_pages, round(avg(length(html)), 6) AS avg_chars, min(length(html)) "
    "AS min_chars, round(100.0 * avg(CASE WHEN length(html) < 1500 THEN 1.0 ELSE 0 END), 6) AS pct_short FROM pages GROUP BY ALL")
def page_quality_rollup(spark, sf_dir):
    n = F.length("html")
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n_pages"),
        F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.round(100.0 * F.avg((n < 1500).cast("double")), 6).alias("pct_short"))


@query("page_concat", "SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) || '--- TURN ---' || chr(10) ORDER BY turn)) AS joined_md5, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def page_concat(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n--- TURN ---\n")).alias("joined_md5"), F.count("*").alias("n_turns"))


@query("turn_pivot", "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) "
    "FILTER (role = 'system') AS n_system, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def turn_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")), F.sum(F.length("text")).alias("n_chars"))


@query("self_consistency", "SELECT conv_id, CASE WHEN count(DISTINCT length(text) // 100) = 1 THEN CAST(min(length(text) // 100) AS VARCHAR) "
    "ELSE 'Indeterminate' END AS verdict FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def self_consistency(spark, sf_dir):
    v = F.floor(F.length("text") / 100)
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.when(F.min(v) == F.max(v), F.min(v).cast("string")).otherwise("Indeterminate").alias("verdict"))
