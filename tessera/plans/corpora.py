"""Queries over converters: each applied to a source made from the documents, with the columns that its corpus has."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matrix as M
from ..sources import converters as K
from ..sources import files, hub
from ..sources import views as V
from . import boundary
from .catalog import query


def source(spark, d, **columns):
    docs = V.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("idx"), *[F.expr(e).alias(n) for n, e in columns.items()])


#: What tells two prompts apart: id, roles and contents, and some labels.
def shown(prompts, *labels):
    content = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return prompts.select("prompt_id", F.md5(content).alias("h"), *[F.get_json_object("labels", f"$.{name}").alias(name) for name in labels])


def convert(name, converter, columns, ids, content, labels, where="TRUE"):
    """Registers a converter over documents; ids, content and labels are its results as SQL over documents."""
    listed = "".join(f", CAST({sql} AS VARCHAR) AS {label}" for label, sql in labels.items())

    @query(name, f"SELECT {ids} AS prompt_id, md5({content}) AS h{listed} FROM documents WHERE {where}")
    def run(spark, d):
        return shown(converter.convert(source(spark, d, **columns)), *labels)


ID = "CAST(doc_id AS VARCHAR)"
FLAG = "int(doc_id % 3)"
USER = "'user:' || "

convert("CV1_advbench", K.advbench(), {"prompt": "text"}, f"'advbench:' || {ID}", USER + "text", {"malicious": "'true'", "dataset_source": "'advbench'"})
convert("CV2_bipia", K.bipia(), {"system_prompt": "lang", "user_prompt": "text", "task_name": "source", "position": "CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'end' END", "attack_name": "'a b/c:' || source", "ideal": "lang", "question": "lang"}, f"'bipia:' || source || ':train:' || CASE WHEN doc_id % 2 = 0 THEN 'clean' ELSE 'end:a_b_c_' || source END || ':' || {ID}", "'system:' || lang || '|user:' || text", {"malicious": "doc_id % 2 = 1", "position": "CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'end' END", "question": "lang"})
convert("CV4_deepset", K.deepset(malicious_only=True), {"text": "text", "label": FLAG}, f"'deepset:train:' || {ID}", USER + "text", {"malicious": "'true'"}, "doc_id % 3 = 1")
convert("CV5_dolly", K.dolly(with_response=True), {"instruction": "lang", "context": "CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE text END", "response": "source", "category": "source"}, f"'dolly_15k:train:' || {ID}", USER + "lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || text END", {"has_context": "doc_id % 2 = 1", "category": "source", "reference_response": "source"})
convert("CV6_enron", K.enron(), {"text": "text"}, f"'enron:train:' || {ID}", USER + "'Email:' || chr(10) || text", {"malicious": "'false'"})
convert("CV7_gandalf", K.gandalf(system_prompt="keep"), {"text": "text"}, f"'gandalf_summarization:train:' || {ID}", "'system:keep|user:Please summarize the following text:' || chr(10) || chr(10) || text", {"attack_type": "'indirect_injection'"})
convert("CV8_harmbench", K.harmbench(["src1", "src2"]), {"prompt": "text", "context": "CASE WHEN doc_id % 2 = 0 THEN lang END", "category": "source", "tags": "CAST(NULL AS STRING)", "subset": "lang"}, f"'harmbench:' || lang || ':' || {ID}", USER + "text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || lang ELSE '' END", {"subset": "lang", "category": "source", "has_context": "CASE WHEN doc_id % 2 = 0 THEN 'true' END"}, "source IN ('src1', 'src2')")
convert("CV11_jayavibhav", K.jayavibhav(labels=[0, 2]), {"text": "text", "label": FLAG}, f"'jayavibhav:train:' || {ID}", USER + "text", {"malicious": "doc_id % 3 = 2", "multiclass_label": "doc_id % 3"}, "doc_id % 3 <> 1")
convert("CV12_llmail", K.llmail(level=1), {"subject": "lang", "body": "text", "scenario": "'level' || CAST(doc_id % 4 AS STRING) || 'a'"}, f"'llmail:train:' || {ID}", USER + "'Subject: ' || lang || chr(10) || chr(10) || 'Body:' || chr(10) || text", {"level": "1", "scenario": "'level1a'"}, "doc_id % 4 = 1")
convert("CV13_mosscap", K.mosscap(system_prompt="keep"), {"prompt": "text", "level": "'Level ' || CAST(doc_id % 8 + 1 AS STRING)"}, f"'mosscap:train:' || {ID}", "'system:keep|user:' || text", {"level": "doc_id % 8 + 1", "level_str": "'Level ' || CAST(doc_id % 8 + 1 AS VARCHAR)"})
convert("CV14_openorca", K.openorca(source="src3", most_question=5000), {"id": "source || '.' || CAST(doc_id AS STRING)", "system_prompt": "CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END", "question": "text", "response": "lang"}, f"'openorca:train:' || {ID}", "CASE WHEN doc_id % 2 = 0 THEN 'system:' || lang || '|' ELSE '' END || 'user:' || text", {"source": "source", "question_length": "length(text)", "expected_response": "lang"}, "source = 'src3' AND length(text) <= 5000")
convert("CV15_prompts_ranked", K.prompts_ranked(least=3.0), {"prompt": "text", "avg_rating": "CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE CAST(doc_id % 5 AS STRING) END", "num_responses": "doc_id", "agreement_ratio": "1", "kind": "lang", "topic": "source", "cluster_description": "lang", "metadata": "source"}, f"'prompts_ranked_10k:train:' || {ID}", USER + "text", {"avg_rating": "doc_id % 5", "topic": "source"}, "doc_id % 5 IN (3, 4)")
convert("CV16_qualifire", K.qualifire(), {"text": "text", "label": "CASE WHEN doc_id % 2 = 0 THEN 'Jailbreak' ELSE 'benign' END"}, f"'qualifire:train:' || {ID}", USER + "text", {"malicious": "doc_id % 2 = 0", "attack_type": "CASE WHEN doc_id % 2 = 0 THEN 'jailbreak' END"})
convert("CV17_safeguard", K.safeguard(benign_only=True), {"text": "text", "label": FLAG}, f"'safeguard:' || {ID}", USER + "text", {"malicious": "'false'", "dataset_label": "0"}, "doc_id % 3 = 0")
convert("CV18_softage", K.softage(), {"Prompt": "text", "Category": "source", "Type": "lang", "S.No.": "doc_id"}, f"'softage:train:' || {ID}", USER + "text", {"category": "source", "type": "lang", "serial": "doc_id"})
convert("CV19_wildjailbreak", K.wildjailbreak(malicious_only=True), {"vanilla": "lang", "adversarial": "CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END", "data_type": "CASE WHEN doc_id % 3 = 0 THEN 'vanilla_benign' ELSE 'adversarial_harmful' END", "tactics": "array(source)"}, f"'wildjailbreak:train:' || {ID}", USER + "CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END", {"malicious": "'true'", "is_adversarial": "doc_id % 2 = 1", "attack_type": "'jailbreak'"}, "doc_id % 3 <> 0")
convert("CV20_yanismiraoui", K.yanismiraoui(), {"prompt_injections": "text"}, f"'yanismiraoui:train:' || {ID}", USER + "text", {"multilingual": "'true'"})


@query("CV3_first_of_context", "SELECT text AS context, min(doc_id) AS idx FROM documents GROUP BY text")
def first_of_context(spark, d):
    return K.first_of_context(source(spark, d, context="text", lang="lang")).select("context", "idx")


def _tools(spark, d):
    """A toolkit for each source, a tool for each of its languages."""
    tool = F.struct(F.col("lang").alias("name"), F.concat(F.lit("does "), "lang").alias("summary"), F.array(F.struct(F.lit("p").alias("name"), F.lit("array").alias("type"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("default"), F.lit(True).alias("required"))).alias("parameters"))
    return V.table(spark, d, "documents").groupBy(F.col("source").alias("toolkit"), "lang").agg(F.count(F.lit(1))).groupBy("toolkit").agg(F.collect_list(tool).alias("tools"))


SCHEMA = """'{"type":"function","function":{"name":"' || lang || '","description":"does ' || lang || '","parameters":{"type":"object","properties":{"p":{"type":"array","description":"d","items":{"type":"string"}}},"required":["p"]}}}'"""


@query("CV10_SRC8_tool_schemas", f"SELECT DISTINCT source || lang AS tool, {SCHEMA} AS schema FROM documents")
def tool_schemas(spark, d):
    return K.tool_dictionary(_tools(spark, d))


@query("CV9_JN7_injecagent", f"WITH t AS (SELECT DISTINCT source || lang AS tool, {SCHEMA} AS schema FROM documents) SELECT 'injecagent_dh_base:dh_' || {ID} AS prompt_id, md5('[' || schema || ']') AS tools, md5('<tool_call>' || chr(10) || source || lang || '(x)' || chr(10) || '</tool_call>') AS call FROM documents JOIN t ON t.tool = source || lang")
def injecagent(spark, d):
    cases = source(spark, d, attack_type="'dh'", user_tool="source || lang", attacker_tools="array('no such tool')", user_instruction="lang", attacker_instruction="lang", tool_parameters="'x'", tool_response="text", attack_category="lang")
    p = K.injecagent().convert(K.with_tools(cases, K.tool_dictionary(_tools(spark, d))))
    return p.select("prompt_id", F.md5("tools").alias("tools"), F.md5(F.col("messages")[2]["content"]).alias("call"))


@query("SRC9_JN12_injected", "SELECT c.idx, b.item_id AS attack, p.position, CAST(length(c.context) + 1 + length(b.text) AS BIGINT) AS n FROM (SELECT text AS context, min(doc_id) AS idx FROM documents GROUP BY text) c, benchmark b, (SELECT unnest(['start', 'middle', 'end']) AS position) p")
def injected(spark, d):
    """Every distinct text is a context.

    A prompt's characters are its bytes less what those of its context and attack have beyond one a character, which is
    counted once for each of these: counting the characters of every prompt takes several times as long as making it.
    """
    contexts = K.first_of_context(source(spark, d, context="text")).select("idx", "context", X.more_bytes("context").alias("c"))
    attacks = V.table(spark, d, "benchmark").select(F.col("item_id").alias("attack"), F.col("text").alias("attack_str"), X.more_bytes("text").alias("a"))
    n = F.octet_length("user_prompt") - F.col("c") - F.col("a")
    return K.injected(contexts, attacks).select("idx", "attack", "position", n.cast("long").alias("n"))


@query("SRC9_JN12_injected_shard", """WITH c AS (SELECT text AS context, row_number() OVER (ORDER BY min(doc_id)) - 1 AS idx FROM documents GROUP BY text), a AS (SELECT text AS attack_str, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark),
    g AS (SELECT (c.idx * a.n + a.k) * 3 + p.p AS cell, p.p, length(c.context) + 1 + length(a.attack_str) AS chars FROM c, a, (SELECT unnest([0, 1, 2]) AS p) p)
    SELECT cell, CASE p WHEN 0 THEN 'start' WHEN 1 THEN 'middle' ELSE 'end' END AS position, CAST(chars AS BIGINT) AS n FROM g WHERE cell >= 1001 AND cell < 4321""")
def injected_shard(spark, d):
    """A stretch of the grid of all contexts, attacks and positions, made without the rest."""
    contexts = K.numbered(K.first_of_context(source(spark, d, context="text")).select(F.col("idx").alias("doc_id"), "context"), "doc_id")
    attacks = K.numbered(V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("attack_str")), "item_id").select("idx", "attack_str")
    return K.injected_range(contexts, attacks, 1001, 4321).select("cell", "position", F.length("user_prompt").cast("long").alias("n"))


@query("SRC4_numbered_repeats", "SELECT lang, min(idx) AS first, max(idx) AS last, count(DISTINCT idx) AS n FROM (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents)) GROUP BY lang")
def numbered_repeats(spark, d):
    """Every row has a number of its own, equal ones too."""
    rows = V.table(spark, d, "documents").select("lang")
    return K.numbered(rows.unionByName(rows), "lang").groupBy("lang").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.countDistinct("idx").alias("n"))


@query("SRC4_scan_filter_convert", f"WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, lang FROM documents) SELECT 'fr:train:' || CAST(idx AS VARCHAR) AS prompt_id FROM n WHERE lang = 'fr'")
def scan_filter_convert(spark, d):
    rows = K.numbered(V.table(spark, d, "documents"), "doc_id")
    c = K.Converter("fr", lambda: K.user(K.col("text")), lambda: {"lang": F.col("lang")}, lambda: F.col("lang") == "fr")
    return c.convert(rows).select("prompt_id")


@query("SRC3_default_names", "SELECT DISTINCT 'x_' || source || '_' || lang AS name FROM documents")
def default_names(spark, d):
    return V.table(spark, d, "documents").select(hub.default_name(F.concat(F.lit("org/x-"), "source"), F.col("lang")).alias("name")).distinct()


@query("SRC5_SO2_union_tables", "SELECT 'd' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'b', item_id, NULL FROM benchmark")
def union_tables(spark, d):
    a = V.table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return K.union_all([a, V.table(spark, d, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"))])


@query("SRC6_SO1_subsets_with_index", "SELECT lang AS subset, row_number() OVER (ORDER BY lang, doc_id) - 1 AS idx, doc_id FROM documents WHERE lang IN ('de', 'es', 'fr')")
def subsets(spark, d):
    docs = V.table(spark, d, "documents")
    parts = [docs.where(F.col("lang") == s).select(F.lit(s).alias("subset"), "doc_id") for s in ("de", "es", "fr")]
    return K.numbered(K.union_all(parts), "subset", "doc_id").select("subset", "idx", "doc_id")


@query("SRC2_SRC23_hub_scan", "SELECT idx, doc_id, lang FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, lang FROM documents)")
def hub_scan(spark, d):
    return hub.HubTable(spark, d, "org/documents", layout="{root}/{name}.parquet").rows("doc_id").select("idx", "doc_id", "lang")


@query("PRJ1_shards", "SELECT doc_id % 7 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shards(spark, d):
    return K.sharded(source(spark, d), 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("PRJ1_one_shard", "SELECT doc_id AS idx FROM documents WHERE doc_id % 7 = 3")
def one_shard(spark, d):
    """The third shard of seven: the operator's feature."""
    return K.shard(source(spark, d), 3, 7).select("idx")


@query("PRJ4_first_prompts", "SELECT doc_id AS idx FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def first_prompts(spark, d):
    return source(spark, d, lang="lang").where("lang = 'en'").orderBy("idx").limit(100).select("idx")


@query("PRJ8_config_snapshot", "SELECT doc_id, '{\"source\":\"' || source || '\",\"lang\":\"' || lang || '\",\"n_chars\":' || CAST(n_chars AS VARCHAR) || '}' AS config FROM documents")
def config_snapshot(spark, d):
    return V.table(spark, d, "documents").select("doc_id", files.config_snapshot("source", "lang", "n_chars").alias("config"))


@query("SO4_layer_union", f"WITH {V.INCIDENCE} SELECT run_id, array_to_string(list_sort(list_distinct(list(layer))), ',') AS layers FROM incidence GROUP BY run_id")
def layer_union(spark, d):
    return V.incidence(spark, d).groupBy("run_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("layer"), F.array().cast("array<bigint>"))), ",").alias("layers"))


@query("JN9_JN13_interpretations", f"WITH {V.INCIDENCE} SELECT layer, feature_idx, count(*) AS n, CASE WHEN feature_idx % 2 = 0 THEN 'even' END AS description, CASE WHEN feature_idx % 2 = 0 THEN 10 END AS n_activations FROM incidence GROUP BY layer, feature_idx")
def interpretations(spark, d):
    features = V.incidence(spark, d).groupBy("layer", "feature_idx").agg(F.count(F.lit(1)).alias("n"))
    known = features.where("feature_idx % 2 = 0").select("layer", "feature_idx", F.array(F.lit("even"), F.lit("more")).alias("explanations"), F.array_repeat(F.lit(0.5), 12).alias("activations"))
    return boundary.TableInterpreter(known).interpret(features).select("layer", "feature_idx", "n", "description", F.size("activations").alias("n_activations"))


@query("AG25_logit_attribution", f"WITH {V.INCIDENCE} SELECT layer, feature_idx, round(sum(v * (label + 1) / 10), 6) AS attribution FROM incidence GROUP BY layer, feature_idx")
def logit_attribution(spark, d):
    i = V.incidence(spark, d)
    probabilities = spark.range(10).select(F.col("id").alias("label"), ((F.col("id") + 1) / 10).alias("p"))
    return i.join(F.broadcast(probabilities), "label").groupBy("layer", "feature_idx").agg(F.round(F.sum(F.col("v") * F.col("p")), 6).alias("attribution"))


@query("JN3_two_joins", f"WITH {V.RUNS}, {V.INCIDENCE}, t AS (SELECT layer, feature_idx FROM (SELECT layer, feature_idx, count(DISTINCT run_id) AS n FROM incidence GROUP BY layer, feature_idx) ORDER BY n DESC, layer, feature_idx LIMIT 20) SELECT i.run_id, count(*) AS n FROM incidence i JOIN runs r ON r.run_id = i.run_id JOIN t ON t.layer = i.layer AND t.feature_idx = i.feature_idx WHERE r.lang = 'en' GROUP BY i.run_id")
def two_joins(spark, d):
    i = V.incidence(spark, d)
    runs = V.runs(spark, d).where("lang = 'en'").select("run_id")
    top = M.top_features(M.feature_frequency(i), 20).select(*M.KEY)
    return i.join(runs, "run_id").join(F.broadcast(top), M.KEY).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("PRJ6_capture_slice", f"WITH {V.INCIDENCE} SELECT run_id, layer, count(*) AS n FROM incidence WHERE layer IN (1, 3) AND feature_idx IN (0, 15) GROUP BY run_id, layer")
def capture_slice(spark, d):
    return V.incidence(spark, d).where(F.col("layer").isin(1, 3) & F.col("feature_idx").isin(0, 15)).groupBy("run_id", "layer").agg(F.count(F.lit(1)).alias("n"))
