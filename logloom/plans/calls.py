"""Queries: guards of calls, rendered corpora, harness figures, analysis, locks from syntax, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import text as T
from ..operators import facts, harness, labels, methods, stats, timeline
from ..sources import adapters, curated
from . import inputs as I
from .registry import add, query

# --- guards -------------------------------------------------------------------------------

_BIG = 1 << 20


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND length(text) * 900 > {_BIG} THEN 'text exceeds max length 1048576' WHEN doc_id % 7 = 0 THEN 'language exceeds max length 16'
  WHEN doc_id % 11 = 0 THEN 'keywords exceeds max count 256' WHEN doc_id % 3 = 0 THEN 'keywords[1] exceeds max length 4096' END AS error
  FROM (SELECT doc_id, repeat('x', length(text)) AS text FROM documents)""")
def guard_lock_mask(s, d):
    n = F.col("doc_id")
    rows = I.documents(s, d).select("doc_id", F.when(n % 5 == 0, F.expr("repeat('x', length(text) * 900)")).otherwise("x").alias("text"), F.when(n % 7 == 0, "a language too long").otherwise("json").alias("language"),
                                    F.when(n % 11 == 0, F.array_repeat(F.lit("k"), 257)).when(n % 3 == 0, F.array(F.lit("k"), F.expr("repeat('k', 4097)"))).otherwise(F.array(F.lit("k"))).alias("keywords"))
    return rows.select("doc_id", api.call_errors("lock_mask").alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'provide exactly one of text or path, not both' WHEN event_id % 6 = 1 THEN 'provide one of text or path' WHEN event_id % 6 = 2 THEN 'path exceeds max length 4096'
  WHEN user_id % 4 = 0 THEN 'target_rate must be a finite number in (0,1)' WHEN user_id % 4 = 1 THEN 'unsupported language: ' || event_type || ' (use text|json|python)' END AS error FROM events""")
def guard_compress_log(s, d):
    k, u = F.col("event_id") % 6, F.col("user_id") % 4
    path = F.when(k == 0, "p").when(k == 2, F.expr("repeat('p', 4097)"))
    rows = I.table(s, d, "events").select("event_id", F.when((k == 0) | (k > 2), "t").alias("text"), path.alias("path"), F.array(F.lit("k")).alias("keywords"), F.when(u == 0, F.lit(1.0)).when(u == 2, F.lit(0.5)).alias("target_rate"), F.when(u == 1, F.col("event_type")).otherwise("log").alias("language"))
    return rows.select("event_id", api.call_errors("compress_log").alias("error"))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'head_keep exceeds max items 100000' WHEN vec_id % 5 = 1 THEN 'tail_keep exceeds max items 100000' WHEN vec_id % 5 = 2 THEN 'head_keep + tail_keep exceeds max items 100000'
  WHEN vec_id % 5 = 3 THEN 'value array exceeds max items 100000' END AS error FROM embeddings""")
def guard_compress_array(s, d):
    k = F.col("vec_id") % 5
    rows = I.table(s, d, "embeddings").select("vec_id", F.when(k == 0, 100_001).when(k == 2, 60_000).otherwise(3).alias("head_keep"), F.when(k == 1, 100_001).when(k == 2, 60_000).alias("tail_keep"), F.when(k == 3, F.array_repeat(F.lit(0), 100_001)).otherwise(F.array(F.lit(0))).alias("value"))
    return rows.select("vec_id", api.call_errors("compress_array").alias("error"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'conversation_id exceeds max length 256' WHEN turn % 4 = 1 THEN 'role exceeds max length 64' END AS append_error,
  CASE WHEN turn % 3 = 0 THEN 'node_id exceeds max length 256' END AS node_error, CASE WHEN turn % 3 = 1 THEN 'cache_id exceeds max length 256' END AS cache_error FROM conversations""")
def guard_store_calls(s, d):
    t = F.col("turn")
    long = lambda k, m, n: F.when(t % m == k, F.expr(f"repeat('i', {n})")).otherwise("i")
    rows = I.table(s, d, "conversations").select("conv_id", "turn", long(0, 4, 257).alias("conversation_id"), long(1, 4, 65).alias("role"), F.col("text").alias("content"), long(0, 3, 257).alias("node_id"), long(1, 3, 257).alias("cache_id"))
    return rows.select("conv_id", "turn", api.call_errors("lcm_append").alias("append_error"), api.call_errors("lcm_node").alias("node_error"), api.call_errors("retrieve_cache").alias("cache_error"))


# --- rendered corpora ---------------------------------------------------------------------


def _cell(i: int) -> str:
    """A value a column for customers: with inner newlines and spaces, and absent for some rows."""
    return f"CASE WHEN (c_custkey + {i}) % 9 = 0 THEN NULL ELSE 'v{i}' || CASE WHEN (c_custkey + {i}) % 4 = 0 THEN chr(10) ELSE '  ' END || (c_custkey * {i + 3}) % 1000 END"


def _rendering(corpus: str):
    template = adapters.LINES[corpus][1]
    names = list(dict.fromkeys([*adapters.template_columns(template), *adapters.required(corpus)]))
    at = {name: i for i, name in enumerate(names)}

    def run(s, d):
        cells = [F.expr(_cell(i)).alias(name) for name, i in at.items()]
        rows = I.table(s, d, "customer").select(*cells)
        return adapters.render_corpus(rows, corpus)

    pieces = [f"'{x.replace(chr(39), chr(39) * 2)}'" if k % 2 == 0 else f"coalesce(replace({_cell(at[x])}, chr(10), ' '), '')" for k, x in enumerate(adapters.split_template(template))]
    return run, f"SELECT trim(regexp_replace({' || '.join(pieces)}, '\\s+', ' ', 'g')) AS line FROM customer"


for _corpus in adapters.LINES:
    if _corpus != "distsys_synth":
        add(f"render_{_corpus}", *_rendering(_corpus))


@query("""SELECT trim(regexp_replace('Traceback (most recent call last): File "f' || c_custkey || '.py"' || chr(10) || '  KeyError ' || c_name, '\\s+', ' ', 'g')) AS line FROM customer WHERE c_custkey % 3 = 0""")
def render_tracebacks(s, d):
    text = F.concat(F.lit('Traceback (most recent call last): File "f'), F.col("c_custkey").cast("string"), F.lit('.py"\n  KeyError '), F.col("c_name"))
    fourth = F.when(F.col("c_custkey") % 3 == 0, text).otherwise("no trace")
    items = I.table(s, d, "customer").select(F.to_json(F.array(F.lit("a"), F.lit("b"), F.lit("c"), fourth)).alias("item"))
    return adapters.render_tracebacks(items)


# --- harness ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () - 1 AS top FROM orders)
SELECT max(x) FILTER (i = floor(0.50 * top + 0.5)) AS p50, max(x) FILTER (i = floor(0.95 * top + 0.5)) AS p95, max(x) FILTER (i = floor(0.99 * top + 0.5)) AS p99 FROM r""")
def latency_percentiles(s, d):
    found = harness.percentiles(I.table(s, d, "orders"), "o_totalprice")
    return s.createDataFrame([tuple(found[p] for p in harness.PERCENTS)], "p50 double, p95 double, p99 double")


_REDUCED = f"""WITH {I.lines_sql("documents").strip()},{I.runs_sql()},
parts AS (SELECT doc_id, string_agg(CASE WHEN kept THEN line ELSE '⟪elided idx=' || group_idx || ' lines=' || (n - 2) || ' key="' || replace(replace(key, '\\', '\\\\'), '"', '\\"') || '"⟫' END, chr(10) ORDER BY line_no) FILTER (kept OR rn = 2) AS body, count(*) FILTER (NOT kept) AS elided FROM marked GROUP BY doc_id),
both_ AS (SELECT d.doc_id, d.text, p.elided, p.body || CASE WHEN ends_with(d.text, chr(10)) THEN chr(10) ELSE '' END AS reduced FROM documents d JOIN parts p USING (doc_id)),
sized AS (SELECT doc_id, strlen(text) AS bytes, len({T.word_tokens_sql("text")}) AS i, len({T.word_tokens_sql("reduced")}) AS o, elided FROM both_)
SELECT count(DISTINCT doc_id) AS files, count(*) AS chunks, sum(bytes)::BIGINT AS bytes, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, sum(elided)::BIGINT AS elided,
  round(sum(i) / sum(o)::DOUBLE, 9) AS ratio, round(100.0 * (sum(i) - sum(o)) / sum(i)::DOUBLE, 9) AS pct_removed FROM sized"""


@query(_REDUCED)
def reduction_totals(s, d):
    out = harness.totals(harness.reductions(I.documents(s, d)))
    return out.withColumn("ratio", F.round("ratio", 9)).withColumn("pct_removed", F.round("pct_removed", 9))


_RESULTS = """WITH results AS (SELECT 'iso' || (event_id % 2) AS ratio_key, m AS method, event_id AS ord, 'd' || event_id AS doc_id, CASE WHEN user_id % 3 = 0 THEN 'loghub:' || event_type ELSE event_type END AS fact_type,
  (event_id * (3 + ascii(m)) + user_id) % 7 < 4 AS judge, (event_id * (5 + ascii(m))) % 11 < 6 AS exact, (event_id + ascii(m)) % 13 = 0 AS judge_error FROM events, (VALUES ('a'), ('b'), ('c')) v(m) WHERE NOT (m = 'c' AND event_id % 2 = 1)),
both_ AS (SELECT ratio_key, method, metric, CASE WHEN metric = 'judge' THEN judge ELSE exact END AS survived, doc_id, judge_error FROM results, (VALUES ('judge'), ('exact')) w(metric))"""


def _results(s, d):
    rows = I.table(s, d, "events").withColumn("method", F.explode(F.array(*map(F.lit, "abc")))).where("not (method = 'c' and event_id % 2 = 1)")
    a = F.ascii("method")
    return rows.select(
        F.concat(F.lit("iso"), (F.col("event_id") % 2).cast("string")).alias("ratio_key"), "method", F.col("event_id").alias("ord"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("doc_id"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("loghub:"), "event_type")).otherwise(F.col("event_type")).alias("fact_type"),
        ((F.col("event_id") * (a + 3) + F.col("user_id")) % 7 < 4).alias("judge"), ((F.col("event_id") * (a + 5)) % 11 < 6).alias("exact"), ((F.col("event_id") + a) % 13 == 0).alias("judge_error"),
    )


@query(_RESULTS + " SELECT ratio_key, method, metric, count(*) AS n, round(avg(survived::INT), 9) AS point, count(*) FILTER (judge_error) AS judge_errors FROM both_ GROUP BY ALL")
def analysis_methods(s, d):
    return harness.method_stats(_results(s, d), resamples=50).select("ratio_key", "method", "metric", "n", F.round("point", 9).alias("point"), "judge_errors")


@query(_RESULTS + """ SELECT ratio_key, method, CASE WHEN starts_with(fact_type, 'loghub:') THEN substr(fact_type, 8) ELSE fact_type END AS domain, count(*) AS n, count(*) FILTER (judge) AS judge_survived,
  count(*) FILTER (exact) AS exact_survived, round(avg(judge::INT), 9) AS judge_rate, round(avg(exact::INT), 9) AS exact_rate FROM results GROUP BY ALL""")
def analysis_domains(s, d):
    return harness.domain_stats(_results(s, d)).withColumns({f"{m}_rate": F.round(f"{m}_rate", 9) for m in harness.METRICS})


@query(_RESULTS + """, p AS (SELECT x.ratio_key, x.method AS method_a, y.method AS method_b, x.metric, x.survived AS a, y.survived AS b FROM both_ x JOIN both_ y ON x.ratio_key = y.ratio_key AND x.metric = y.metric AND x.doc_id = y.doc_id
  WHERE (x.method, y.method) IN (('a', 'b'), ('c', 'a'))), c AS (SELECT ratio_key, method_a, method_b, metric, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM p GROUP BY ALL)
SELECT *, b + c AS n_discordant, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END, 6) AS chi2, b > c AS a_better FROM c""")
def analysis_pairs(s, d):
    wanted = s.createDataFrame([("a", "b"), ("c", "a"), ("a", "none")], "method_a string, method_b string")
    out = harness.pair_tests(_results(s, d), wanted)
    return out.select("ratio_key", "method_a", "method_b", "metric", "b", "c", "n_discordant", F.round("chi2", 6).alias("chi2"), "a_better")


@query(_RESULTS + """, p AS (SELECT x.survived AS a, y.survived AS b FROM both_ x JOIN both_ y ON x.ratio_key = y.ratio_key AND x.metric = y.metric AND x.doc_id = y.doc_id AND x.method = 'a' AND y.method = 'b' WHERE x.metric = 'judge')
SELECT 0.5::DOUBLE AS rate, round(avg(a::INT), 9) AS survival_a, round(avg(b::INT), 9) AS survival_b, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM p""")
def paired_verdicts(s, d):
    items = _results(s, d).where("method <> 'c'").select("method", F.lit(0.5).alias("rate"), F.col("doc_id").alias("triple_id"), F.col("judge").alias("survived"))
    out = methods.verdicts(items, "a", "b")
    return out.select("rate", F.round("survival_a", 9).alias("survival_a"), F.round("survival_b", 9).alias("survival_b"), "b", "c")


# the tail of chi-squared with one degree of freedom, from the series of the error function
_ERFC = """1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * list_reduce(list_transform(range(0, 300), lambda k: {'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'k': k::DOUBLE}),
  lambda a, x: {'t': a.t * chi2 / (2 * x.k + 3), 's': a.s + a.t * chi2 / (2 * x.k + 3), 'k': x.k}, {'t': sqrt(chi2 / 2), 's': sqrt(chi2 / 2), 'k': 0.0::DOUBLE}).s"""


@query(f"""WITH c AS (SELECT l_linenumber, l_returnflag, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM (SELECT l_linenumber, l_returnflag, l_orderkey % 3 <> 0 AS a, (l_orderkey + l_partkey) % 3 <> 0 AS b FROM lineitem) GROUP BY ALL),
x AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2)::DOUBLE / (b + c) END AS chi2 FROM c)
SELECT l_linenumber, l_returnflag, b + c AS n_discordant, round(CASE WHEN b + c = 0 THEN 1.0 WHEN chi2 > 60 THEN 0.0 ELSE {_ERFC} END, 6) AS p_chi2 FROM x""")
def mcnemar_chi2(s, d):
    k = F.col("l_orderkey")
    pairs = I.table(s, d, "lineitem").select("l_linenumber", "l_returnflag", (k % 3 != 0).alias("a"), ((k + F.col("l_partkey")) % 3 != 0).alias("b"))
    return stats.mcnemar(pairs, "l_linenumber", "l_returnflag").select("l_linenumber", "l_returnflag", "n_discordant", F.round("p_chi2", 6).alias("p_chi2"))


# --- facts and locks ----------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('distsys#0', 'distsys', '1000', 'request_id'), ('traceback#0', 'traceback', 'ConnectionResetError', 'exception'), ('servicenow#0', 'servicenow', 'INC0000040', 'incident'), ('api#0', 'api', '503', 'http_status')) v(doc_id, source, answer, fact_type)""")
def curated_facts(s, d):
    return curated.curated_triples(s).select("doc_id", "source", "answer", "fact_type")


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'semantic' ELSE 'structural' END AS class, count(*) AS n FROM events GROUP BY 1")
def fact_class_counts(s, d):
    kinds = F.when(F.col("event_id") % 4 == 0, F.lit("semantic:msg")).otherwise("http_status")
    return facts.class_counts(I.table(s, d, "events").select(kinds.alias("fact_type")))


_HDFS = "lpad((event_id % 1000000)::VARCHAR, 6, '0') || ' 101010 ' || user_id || ' INFO dfs.Node: Receiving block ' || event_type || ' from the client ' || (event_id % 50)"


@query(f"""WITH l AS (SELECT event_id, {_HDFS} AS line FROM events), m AS (SELECT event_id, trim(regexp_extract(line, '^\\d{{6}} \\d{{6}} \\d+ [A-Z]+ [\\w.$]+: (.*)$', 1)) AS msg FROM l)
SELECT event_id, msg, trim(regexp_replace(msg, '\\s+\\d+\\s*$', '')) AS needle FROM m""")
def needle_shaping(s, d):
    line = F.concat(F.lpad((F.col("event_id") % 1_000_000).cast("string"), 6, "0"), F.lit(" 101010 "), F.col("user_id").cast("string"), F.lit(" INFO dfs.Node: Receiving block "), F.col("event_type"), F.lit(" from the client "), (F.col("event_id") % 50).cast("string"))
    msg = facts.message(F.lit("hdfs"), line)
    return I.table(s, d, "events").select("event_id", msg.alias("msg"), facts.needle(msg).alias("needle"))


@query("SELECT event_id, 12 AS n_spans, 11 + strlen(user_id::VARCHAR) AS bytes FROM events")
def json_locks(s, d):
    """Of ``{"k1": 7, "name": "x"}``: 2 braces, 6 quotes, 2 colons, a comma and a number are locked; keys, values and spaces aren't."""
    text = F.concat(F.lit('{"k'), F.col("event_id").cast("string"), F.lit('": '), F.col("user_id").cast("string"), F.lit(', "name": "'), F.col("event_type"), F.lit('"}'))
    spans = labels.syntax_spans(text, "json")
    rows = I.table(s, d, "events").select("event_id", spans.alias("x"))
    return rows.select("event_id", F.size("x").alias("n_spans"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: a + x.e - x.s).alias("bytes"))


@query(f"SELECT doc_id, list_transform({T.word_tokens_sql('text')}, lambda t: 1.0)::VARCHAR = list_transform({T.word_tokens_sql('text')}, lambda t: 1.0)::VARCHAR AS all_semantic, len({T.word_tokens_sql('text')})::INT AS n, false AS is_code FROM documents")
def split_labels_text(s, d):
    """Prose has semantic weight 1 and no syntax."""
    from ..functions import spans as S

    rows = I.documents(s, d).select("doc_id", F.col("text").alias("original"), S.token_spans(T.word_tokens(F.col("text"))).alias("spans"))
    out = labels.split_labels(rows, "text")
    whole = F.forall("w_semantic", lambda w: w == 1.0) & F.forall("w_dependency", lambda w: w == 0.0)
    return out.select("doc_id", whole.alias("all_semantic"), F.size("spans").alias("n"), "is_code")


# --- calls over tables --------------------------------------------------------------------


@query(f"""WITH t AS (SELECT conv_id, turn, role, len({T.word_tokens_sql("text")})::BIGINT AS tokens, (40 + 60 * (turn % 4))::BIGINT AS most FROM conversations),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS c FROM t)
SELECT a.conv_id, a.turn, a.tokens, (SELECT min(b.turn) FROM c b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.c - b.most > a.c - a.tokens) AS archived_at FROM c a""")
def archive_by_turn(s, d):
    rows = timeline.archived(I.table(s, d, "conversations"), 40 + 60 * (F.col("turn") % 4))
    return rows.select("conv_id", "turn", "tokens", "archived_at")


@query("WITH" + I.EVENT_DOCS + "," + I.lines_sql("logs") + "," + I.runs_sql() + f""",
made AS (SELECT doc_id, string_agg(CASE WHEN kept THEN line ELSE '⟪elided idx=' || group_idx || ' lines=' || (n - 2) || ' key="' || replace(replace(key, '\\', '\\\\'), '"', '\\"') || '"⟫' END, chr(10) ORDER BY line_no) FILTER (kept OR rn = 2) AS reduced FROM marked GROUP BY doc_id)
SELECT doc_id, reduced AS compressed, len({T.word_tokens_sql("text")})::INT AS input_tokens, len({T.word_tokens_sql("reduced")})::INT AS output_tokens, round(len({T.word_tokens_sql("text")}) / len({T.word_tokens_sql("reduced")})::DOUBLE, 9) AS ratio, false AS used_model FROM logs JOIN made USING (doc_id)""")
def compress_log_call(s, d):
    out = api.compress_log(I.event_docs(s, d))
    return out.select("doc_id", "compressed", "input_tokens", "output_tokens", F.round("ratio", 9).alias("ratio"), "used_model")


@query("SELECT CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS kind, count(*) AS n FROM labels WHERE quality = 1 OR toxic = 0 GROUP BY 1")
def min_token_filter(s, d):
    rows = I.table(s, d, "labels").select(F.when(F.col("quality") == 1, F.array_repeat(F.lit("t"), 9)).when(F.col("toxic") == 0, F.array_repeat(F.lit("t"), 5)).otherwise(F.array_repeat(F.lit("t"), 4)).alias("tokens"))
    return harness.long_enough(rows, 5).groupBy(F.when(F.size("tokens") > 5, "long").otherwise("short").alias("kind")).agg(F.count("*").alias("n"))
