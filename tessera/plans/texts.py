"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import views as V
from .catalog import query

M_ = f"WITH {V.MESSAGES}"
SP = "' ' || chr(9) || chr(10) || chr(13)"
KEPT = f"list_filter(messages, lambda m: trim(coalesce(m.content, ''), {SP}) <> '')"


def docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text")


@query("SC1_sha1", "SELECT doc_id, substr(sha1(text), 1, 12) AS h FROM documents")
def sha1(spark, d):
    return docs(spark, d).select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("h"))


@query("SC2_flattened", M_ + f" SELECT conv_id, md5(array_to_string(list_transform({KEPT}, lambda m: m.role || ': ' || m.content), chr(10))) AS h FROM msgs")
def flattened(spark, d):
    return V.messages(spark, d).select("conv_id", F.md5(X.flattened(F.col("messages"))).alias("h"))


@query("SC3_rendered", M_ + " SELECT conv_id, md5(array_to_string(list_transform(messages, lambda m: '[' || upper(m.role) || ']: ' || m.content), chr(10) || chr(10)) || chr(10) || chr(10) || '[TOOLS]: a, b') AS h FROM msgs")
def rendered(spark, d):
    return V.messages(spark, d).select("conv_id", F.md5(X.rendered(F.col("messages"), F.array(F.lit("a"), F.lit("b")))).alias("h"))


G_ = f"{M_}, k AS (SELECT conv_id, array_to_string(list_transform(list_filter({KEPT}, lambda m: m.role = 'system'), lambda m: m.content), chr(10) || chr(10)) AS sys, list_filter({KEPT}, lambda m: m.role <> 'system') AS o FROM msgs), f AS (SELECT *, list_position(list_transform(o, lambda m: m.role), 'user') AS first FROM k)"


@query("SC4_guard_chat", G_ + " SELECT conv_id, CAST(len(o) + 1 AS BIGINT) AS n, md5(array_to_string(list_transform(o, lambda m, i: m.role || ':' || CASE WHEN i = first AND sys <> '' THEN sys || chr(10) || chr(10) || m.content ELSE m.content END), chr(10)) || chr(10) || 'assistant:ok') AS h FROM f")
def guard_chat(spark, d):
    chat = X.guard_chat(F.col("messages"), F.lit("ok"))
    return V.messages(spark, d).select("conv_id", chat.alias("c")).select("conv_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join(F.transform("c", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("h"))


OUT = "SELECT event_id AS id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'safe' WHEN 1 THEN 'unsafe' || chr(10) || 'S1,S10,S' || CAST(event_id % 16 AS VARCHAR) WHEN 2 THEN 'Unsafe' WHEN 3 THEN '' WHEN 4 THEN 'maybe' ELSE 'unsafe S14' END AS o FROM events"


def outputs(spark, d):
    k = F.col("event_id") % 6
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(k == 0, "safe").when(k == 1, F.concat(F.lit("unsafe\nS1,S10,S"), (F.col("event_id") % 16).cast("string"))).when(k == 2, "Unsafe").when(k == 3, "").when(k == 4, "maybe").otherwise("unsafe S14").alias("o"))


@query("SC5_guard_output", f"WITH t AS ({OUT}) SELECT id, CASE WHEN lower(split_part(o, chr(10), 1)) LIKE '%unsafe%' THEN 'UNSAFE' WHEN lower(split_part(o, chr(10), 1)) LIKE '%safe%' THEN 'SAFE' END AS verdict, array_to_string(list_sort(list_distinct(regexp_extract_all(o, '\\b(S(?:1[0-3]|[1-9]))\\b', 1))), ',') AS categories FROM t")
def guard_output(spark, d):
    return outputs(spark, d).select("id", X.guard_verdict(F.col("o")).alias("verdict"), F.array_join(X.guard_categories(F.col("o")), ",").alias("categories"))


@query("SC6_judge_output", f"WITH t AS ({OUT}) SELECT id, CASE WHEN upper(o) LIKE '%UNSAFE%' THEN 'UNSAFE' WHEN upper(o) LIKE '%SAFE%' THEN 'SAFE' END AS verdict FROM t")
def judge_output(spark, d):
    return outputs(spark, d).select("id", X.judge_verdict(F.col("o")).alias("verdict"))


@query("SC7_without_tools", "SELECT doc_id, md5(left(text, 20) || substr(text, 41)) AS h FROM documents")
def without_tools(spark, d):
    t = F.concat(F.substring("text", 1, 20), F.lit("<TOOLS>x\n"), F.substring("text", 21, 20), F.lit("</tools>"), F.expr("substring(text, 41)"))
    return docs(spark, d).select("doc_id", F.md5(X.without_tools(t)).alias("h"))


@query("SC8_chunks", "SELECT doc_id, CAST(ceil(length(text) / 500.0) AS BIGINT) AS n, md5(array_to_string(list_transform(range(CAST(ceil(length(text) / 500.0) AS BIGINT)), lambda i: substr(text, i * 500 + 1, 500)), '|')) AS h FROM documents")
def chunks(spark, d):
    return docs(spark, d).select("doc_id", X.chunks(F.col("text"), 500).alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("h"))


@query("SC9_chat_template", M_ + " SELECT conv_id, md5(array_to_string(list_transform(messages, lambda m: '<|' || m.role || '|>' || chr(10) || m.content || '<|end|>' || chr(10)), '') || '<|assistant|>' || chr(10)) AS h FROM msgs")
def chat_template(spark, d):
    return V.messages(spark, d).select("conv_id", F.md5(X.chat_template(F.col("messages"))).alias("h"))


@query("SC10_parsed_levels", "SELECT doc_id, TRY_CAST(substr(source, 4) AS INTEGER) AS level, split_part(source, 'c', 1) AS head FROM documents")
def parsed_levels(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.expr("try_cast(substring(source, 4) AS int)").alias("level"), F.split_part("source", F.lit("c"), F.lit(1)).alias("head"))


@query("SC11_json_or_raw", "SELECT doc_id, md5('{\"raw\":\"' || source || '\"}') AS h FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, md5('{\"k\":1}') FROM documents WHERE doc_id % 2 = 0")
def json_or_raw(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, '{"k":1}').otherwise(F.col("source"))
    return V.table(spark, d, "documents").select("doc_id", F.md5(X.json_or_raw(t)).alias("h"))


@query("SC13_math", "SELECT event_id, round(log2(1 + abs(value)), 6) AS lg, round(ln(1 + abs(value)), 6) AS l1p, round(1 / (1 + exp(-value / 100)), 6) AS sig, round(sqrt(abs(value)), 6) AS root, round(least(50, greatest(10, value)), 6) AS clip FROM events")
def math(spark, d):
    v = F.col("value")
    return V.table(spark, d, "events").select("event_id", F.round(F.log2(1 + F.abs(v)), 6).alias("lg"), F.round(F.log1p(F.abs(v)), 6).alias("l1p"), F.round(1 / (1 + F.exp(-v / 100)), 6).alias("sig"), F.round(F.sqrt(F.abs(v)), 6).alias("root"), F.round(F.least(F.lit(50.0), F.greatest(F.lit(10.0), v)), 6).alias("clip"))


@query("SC16_duration", "SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS t FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def duration(spark, d):
    return V.table(spark, d, "events").select("event_id", X.duration(F.col("event_id") * 7 % 9000).alias("t"))


@query("SC17_truncated", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS t FROM documents")
def truncated(spark, d):
    return docs(spark, d).select("doc_id", X.truncated(F.col("text"), 60).alias("t"))


@query("SC18_opacity", "WITH p AS (SELECT quantile_cont(abs(value), 0.99) AS p99 FROM events) SELECT event_id, round(greatest(0, least(0.9, ln(1 + abs(value)) / ln(1 + p99) * 0.9)), 6) AS alpha FROM events, p")
def opacity(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.abs("value").alias("w"))
    p = e.agg(F.percentile("w", 0.99).alias("p99"))
    return e.join(F.broadcast(p)).select("event_id", F.round(X.opacity(F.col("w"), F.col("p99")), 6).alias("alpha"))


@query("SC18_html_escaped", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS h FROM pages")
def html_escaped(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(X.html_escaped(F.col("html"))).alias("h"))


@query("SC23_feature_url", f"WITH {V.INCIDENCE} SELECT DISTINCT 'm/' || layer::VARCHAR || '/' || feature_idx::VARCHAR AS url FROM incidence")
def feature_url(spark, d):
    return V.incidence(spark, d).select(X.feature_url(F.lit("m"), F.col("layer"), F.col("feature_idx")).alias("url")).distinct()


@query("SC24_from_end", "SELECT doc_id, CASE WHEN doc_id % 7 - 3 < 0 THEN n_chars + doc_id % 7 - 3 ELSE doc_id % 7 - 3 END AS at FROM documents")
def from_end(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.from_end(F.col("doc_id") % 7 - 3, F.col("n_chars")).alias("at"))


@query("FLT13_semantic_tokens", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND t NOT IN ('<s>', '</s>', '<pad>', '<unk>') GROUP BY doc_id")
def semantic_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.split("text", " ")).alias("t")).where(X.semantic(F.col("t"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("D2_valid_prompts", M_ + " SELECT conv_id, len(messages) > 0 AS valid FROM msgs")
def valid_prompts(spark, d):
    return V.messages(spark, d).select("conv_id", X.has_content(F.col("messages"), F.lit(None).cast("string"), F.col("conv_id").cast("string")).alias("valid"))


@query("AG21_max_pool", "WITH c AS (SELECT doc_id, unnest(range(greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS k FROM documents), s AS (SELECT doc_id, max(((doc_id * 31 + k * 17) % 100) / 100.0) AS score FROM c GROUP BY doc_id) SELECT doc_id, round(score::DOUBLE, 6) AS score, score >= 0.9 AS flagged FROM s")
def max_pool(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).cast("int") - 1)).alias("k")
    s = docs(spark, d).select("doc_id", k).groupBy("doc_id").agg(F.max(((F.col("doc_id") * 31 + F.col("k") * 17) % 100) / F.lit(100.0)).alias("score"))
    return s.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.9).alias("flagged"))


@query("AG23_head_aggregation", "SELECT user_id % 20 AS q, event_type AS k, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY 1, 2")
def heads(spark, d):
    return V.table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("q"), F.col("event_type").alias("k")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))


@query("TK7_softmax_top_k", "WITH l AS (SELECT user_id AS q, event_id AS t, value / 50 AS x, max(value / 50) OVER (PARTITION BY user_id) AS m FROM events), p AS (SELECT q, t, x, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY q) AS p FROM l) SELECT q, t, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY x DESC, t) AS k FROM p) WHERE k <= 5")
def softmax_top_k(spark, d):
    from ..operators.metrics import softmax_top_k as top

    e = V.table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("t"), (F.col("value") / 50).alias("x"))
    return top(e, "q", "t", "x", 5).withColumn("p", F.round("p", 6))


@query("TK8_top_attended", "WITH l AS (SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id) SELECT q, t FROM (SELECT user_id AS q, event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events JOIN l USING (user_id) WHERE event_type <> 'error' AND event_id < last_id) WHERE k <= 3")
def top_attended(spark, d):
    """The query position of a user is its last event."""
    from ..operators.metrics import top_before

    e = V.table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("t"), "event_type", "value")
    positions = e.groupBy("q").agg(F.max("t").alias("at"))
    return top_before(e.where("event_type <> 'error'"), positions, "q", "t", "value", 3).select("q", "t")
