"""Queries: lines, templates, stores, timelines, arrays and rendering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..api import input_errors
from ..functions import text as T
from ..operators import arrays, store, timeline
from ..operators import lines as L
from ..session import is_folder, shared_dir
from ..sources import adapters
from ..streaming import timeline as stream
from . import inputs as I
from .registry import query

_DOC_LINES = "WITH" + I.lines_sql("documents")
_DOC_RUNS = _DOC_LINES + "," + I.runs_sql()
_LOG_LINES = "WITH" + I.EVENT_DOCS + "," + I.lines_sql("logs")
_LOG_RUNS = _LOG_LINES + "," + I.runs_sql()


@query(_DOC_LINES + " SELECT doc_id, line_no, line FROM lines")
def line_explode(s, d):
    return I.lines(s, d)


@query(_DOC_LINES + f" SELECT doc_id, line_no, {T.normalize_line_sql('line')} AS template FROM lines")
def template_key(s, d):
    return I.lines(s, d).select("doc_id", "line_no", T.normalize_line(F.col("line")).alias("template"))


@query(_DOC_LINES + f" SELECT doc_id, line_no, {T.normalize_key_sql('line')} AS template FROM lines")
def benchmark_key(s, d):
    return I.lines(s, d).select("doc_id", "line_no", T.normalize_key(F.col("line")).alias("template"))


@query(_LOG_RUNS + " SELECT doc_id, run::BIGINT AS run, min(key) AS template, count(*) AS n, min(line_no) AS first_line FROM runs GROUP BY doc_id, run")
def run_length_groups(s, d):
    rows = L.with_runs(L.explode_lines(I.event_docs(s, d)))
    return rows.groupBy("doc_id", "run").agg(F.min("key").alias("template"), F.count("*").alias("n"), F.min("line_no").alias("first_line"))


_SUMMARY = """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_elided, (coalesce(max(group_idx), -1) + 1)::BIGINT AS n_groups,
       sum(strlen(line))::BIGINT AS bytes_in, sum(CASE WHEN kept THEN strlen(line) ELSE 0 END)::BIGINT AS bytes_kept FROM marked GROUP BY doc_id"""


def _summary(docs):
    return L.marked(L.explode_lines(docs)).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("kept")).alias("n_elided"), (F.coalesce(F.max("group_idx"), F.lit(-1)) + 1).cast("bigint").alias("n_groups"),
        F.sum(F.octet_length("line")).alias("bytes_in"), F.sum(F.when(F.col("kept"), F.octet_length("line")).otherwise(0)).alias("bytes_kept"),
    )


@query(_DOC_RUNS + _SUMMARY)
def dedup_summary(s, d):
    return _summary(I.documents(s, d))


@query(_LOG_RUNS + _SUMMARY)
def dedup_summary_logs(s, d):
    return _summary(I.event_docs(s, d))


_REDUCED = """
SELECT doc_id, string_agg(CASE WHEN kept THEN line ELSE '⟪elided idx=' || group_idx || ' lines=' || (n - 2) || ' key="' || replace(replace(replace(replace(key, '\\', '\\\\'), '"', '\\"'), chr(9), '\\t'), chr(13), '\\r') || '"⟫' END, chr(10) ORDER BY line_no)
       FILTER (kept OR rn = 2) AS reduced, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_elided, (coalesce(max(group_idx), -1) + 1)::BIGINT AS n_groups
FROM marked GROUP BY doc_id"""


@query(_LOG_RUNS + _REDUCED)
def dedup_reduced_text(s, d):
    return L.reduced(I.event_docs(s, d))


@query("WITH" + I.EVENT_DOCS + " SELECT doc_id, sha256(text) AS text_sha256 FROM logs UNION ALL SELECT doc_id, sha256(text) FROM documents")
def dedup_roundtrip(s, d):
    """Rebuilt from units and groups; the oracle has the originals."""
    out = None
    for docs in (I.event_docs(s, d), I.table(s, d, "documents").select("doc_id", "text")):
        unit_rows, group_rows = L.units(docs)
        made = L.rebuild(unit_rows, group_rows, docs.select("doc_id", F.col("text").endswith("\n").alias("ends_in_newline")))
        made = made.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
        out = made if out is None else out.unionAll(made)
    return out


_GROUPS = """, grouped AS (
  SELECT doc_id, group_idx::INT AS group_idx, min(key) AS template, count(*)::INT AS n_elided, string_agg(line, chr(10) ORDER BY line_no) AS elided
  FROM marked WHERE NOT kept GROUP BY doc_id, group_idx)"""


@query(_LOG_RUNS + _GROUPS + " SELECT doc_id, group_idx, template, n_elided, elided FROM grouped")
def dedup_groups(s, d):
    g = L.groups(L.explode_lines(I.event_docs(s, d)))
    return g.select("doc_id", "group_idx", F.col("key").alias("template"), "n_elided", F.array_join("elided", "\n").alias("elided"))


_TEXT_STORE = "WITH kept AS (SELECT sha256(text) AS id, min(text) AS payload, count(*) AS copies FROM documents GROUP BY 1)"


def _text_store(s, d):
    docs = I.table(s, d, "documents")
    return docs, store.entries(docs.select(F.col("text").alias("payload"), F.lit(1).alias("omitted_count")), created_at="2020-01-01 00:00:00")


@query("SELECT doc_id, sha256(text) AS cache_id, text AS payload, 1::BIGINT AS omitted_count, true AS found, NULL::VARCHAR AS error FROM documents")
def cache_retrieve(s, d):
    docs, kept = _text_store(s, d)
    wanted = docs.select("doc_id", arrays.content_id(F.col("text")).alias("cache_id"))
    got = store.retrieve(kept, wanted.select("cache_id").distinct())
    return wanted.join(got, "cache_id").select("doc_id", "cache_id", "payload", "omitted_count", "found", "error")


@query("SELECT sha256('missing:' || doc_id) AS cache_id, false AS found, 'cache_miss' AS error FROM documents")
def cache_miss(s, d):
    docs, kept = _text_store(s, d)
    wanted = docs.select(F.sha2(F.concat(F.lit("missing:"), F.col("doc_id").cast("string")), 256).alias("cache_id"))
    return store.retrieve(kept, wanted).select("cache_id", "found", "error")


# --- timeline -----------------------------------------------------------------------------

_T = 150
_ARCHIVE = f"""
WITH turns AS (SELECT conv_id, turn, role, text, len({T.word_tokens_sql("text")})::BIGINT AS tokens FROM conversations),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS c FROM turns),
archived AS (
  SELECT a.conv_id, a.turn, a.role, a.text, a.tokens,
         (SELECT min(b.turn) FROM summed b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.c - (a.c - a.tokens) > {_T}) AS archived_at
  FROM summed a),
nodes AS (
  SELECT sha256(conv_id || ':' || archived_at) AS node_id, conv_id, archived_at, count(*) AS child_count, sum(tokens)::BIGINT AS total_tokens,
         string_agg(role, ',' ORDER BY turn) AS roles, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS child_turns
  FROM archived WHERE archived_at IS NOT NULL GROUP BY conv_id, archived_at)"""


def _archived(s, d):
    return timeline.archived(I.table(s, d, "conversations"), _T)


@query("SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn_index FROM conversations")
def turn_numbering(s, d):
    return timeline.numbered(I.table(s, d, "conversations")).select("conv_id", "turn", "role", "turn_index")


@query(_ARCHIVE + " SELECT conv_id, turn, tokens, archived_at FROM archived")
def archive_assign(s, d):
    return _archived(s, d).select("conv_id", "turn", "tokens", "archived_at")


@query(_ARCHIVE + " SELECT conv_id, coalesce(sum(tokens) FILTER (archived_at IS NULL), 0)::BIGINT AS active_tokens, coalesce(max(turn), -1) + 1 AS next_index FROM archived GROUP BY conv_id")
def active_tokens(s, d):
    return timeline.active_tokens(_archived(s, d))


def _nodes(s, d):
    rows = timeline.nodes(_archived(s, d))
    return rows.withColumn("roles", F.array_join("roles", ",")).withColumn("child_turns", F.array_join(F.col("child_turns").cast("array<string>"), ","))


@query(_ARCHIVE + " SELECT node_id, conv_id, archived_at, 0 AS depth, child_count, total_tokens, roles, child_turns FROM nodes")
def archive_nodes(s, d):
    return _nodes(s, d)


@query(_ARCHIVE + " SELECT node_id, conv_id, archived_at, child_count, total_tokens, roles, child_turns FROM nodes")
def archive_stream(s, d):
    """The same archive steps from a stream over the table, a file or a folder of files, run until it has read all."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = f"{shared_dir(s).rstrip('/')}/archive-stream-{uuid.uuid4().hex}"
    reader = s.readStream.schema(I.table(s, d, "conversations").schema)
    path = f"{d.rstrip('/')}/conversations.parquet"
    # a stream reads folders: that of the table's files, or the one that its only file is in
    turns = reader.parquet(path) if is_folder(s, path) else reader.option("pathGlobFilter", "conversations.parquet").parquet(d)
    steps = stream.archive_stream(turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", T.token_count(F.col("text")).cast("bigint").alias("tokens")), _T)
    steps.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    rows = s.read.schema(stream.OUT).parquet(f"{base}/out")
    return rows.withColumn("roles", F.array_join("roles", ",")).withColumn("child_turns", F.array_join(F.col("child_turns").cast("array<string>"), ","))


@query(_ARCHIVE + " SELECT node_id, child_count, total_tokens, roles FROM nodes")
def node_describe(s, d):
    wanted = timeline.nodes(_archived(s, d)).select("node_id")
    return wanted.join(_nodes(s, d), "node_id").select("node_id", "child_count", "total_tokens", "roles")


@query(_ARCHIVE + " SELECT sha256(conv_id || ':' || archived_at) AS node_id, turn, role, text, tokens FROM archived WHERE archived_at IS NOT NULL")
def node_expand(s, d):
    rows = _archived(s, d)
    return timeline.expand(rows, timeline.nodes(rows).select("node_id"))


@query("SELECT sha256('no such ' || conv_id) AS node_id, 'unknown_node' AS error FROM (SELECT DISTINCT conv_id FROM conversations)")
def node_unknown_anti(s, d):
    rows = _archived(s, d)
    bogus = rows.select("conv_id").distinct().select(F.sha2(F.concat(F.lit("no such "), F.col("conv_id").cast("string")), 256).alias("node_id"))
    return timeline.unknown(rows, bogus.unionByName(timeline.nodes(rows).select("node_id")))


# --- arrays -------------------------------------------------------------------------------


@query("""SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS first_value, CASE WHEN len(embedding) >= 26 THEN 3 ELSE len(embedding) END AS n_head,
  CASE WHEN len(embedding) >= 26 THEN len(embedding) - 6 ELSE 0 END AS omitted, round(list_sum(embedding[4:len(embedding) - 3])::DOUBLE, 4) AS middle_sum FROM embeddings""")
def array_head_tail(s, d):
    rows = arrays.compress_array(I.table(s, d, "embeddings"), "embedding")
    total = F.round(F.aggregate("middle", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return rows.select("vec_id", F.size("embedding").alias("n"), F.get("head", F.lit(0)).cast("double").alias("first_value"), F.size("head").alias("n_head"), "omitted", total.alias("middle_sum"))


_USER_EVENTS = "WITH grouped AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id)"


@query(_USER_EVENTS + """ SELECT user_id, len(ids) AS n, CASE WHEN len(ids) >= 16 THEN len(ids) - 11 ELSE 0 END AS omitted, CASE WHEN len(ids) >= 16 THEN ids[len(ids)] END AS last_tail,
  CASE WHEN len(ids) >= 16 THEN sha256('[' || array_to_string(ids[9:len(ids) - 3], ',') || ']') END AS cache_id FROM grouped""")
def array_head_tail_edges(s, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x.event_id)
    rows = arrays.compress_array(I.table(s, d, "events").groupBy("user_id").agg(ids.alias("ids")), "ids", head=8, tail=3, min_len=5)
    return rows.select("user_id", F.size("ids").alias("n"), "omitted", F.element_at("tail", -1).alias("last_tail"), "cache_id")


@query("SELECT event_id, props AS compressed, 0 AS omitted, NULL::VARCHAR AS cache_id FROM events")
def array_passthrough(s, d):
    return arrays.compress_json(I.table(s, d, "events"), "props").select("event_id", "compressed", "omitted", "cache_id")


# --- rendering and projections ------------------------------------------------------------


@query("WITH" + I.EVENT_LINES + " SELECT event_id, line FROM ev")
def render_event_lines(s, d):
    return I.event_lines(s, d).select("event_id", "line")


_ORDER_LINE = "order={o_orderkey} customer={o_custkey} status={o_orderstatus} priority={o_orderpriority} cents={cents}"


@query("SELECT o_orderkey, trim(regexp_replace('order=' || o_orderkey || ' customer=' || o_custkey || ' status=' || o_orderstatus || ' priority=' || o_orderpriority || ' cents=' || round(o_totalprice * 100)::BIGINT, '\\s+', ' ', 'g')) AS line FROM orders")
def render_order_lines(s, d):
    rows = I.table(s, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return rows.select("o_orderkey", adapters.render(_ORDER_LINE, set(rows.columns)).alias("line"))


_DISTSYS = {
    "Timestamp": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "LogLevel": "upper(event_type)", "Service": "event_type", "Message": "concat('value  recorded', char(10), 'ok')",
    "RequestID": "cast(event_id as string)", "User": "cast(user_id as string)", "ClientIP": "concat('10.0.0.', cast(user_id % 256 as string))", "TimeTaken": "cast(cast(null as int) as string)",
}


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' [' || event_type || '] value recorded ok request_id=' || event_id || ' user=' || user_id || ' client_ip=10.0.0.' || (user_id % 256) || ' time_taken=' AS line FROM events")
def render_distsys(s, d):
    rows = I.table(s, d, "events").select(*[F.expr(v).alias(k) for k, v in _DISTSYS.items()])
    return adapters.render_corpus(rows, "distsys_synth")


@query(_DOC_LINES + f" SELECT {T.severity_rank_sql('line')} AS severity, count(*) AS n FROM lines GROUP BY 1")
def severity_rank(s, d):
    return I.lines(s, d).groupBy(T.severity_rank(F.col("line")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'missing_text' WHEN strlen(text) > 4096 THEN 'text_too_large' END AS error FROM documents")
def input_guard(s, d):
    return I.table(s, d, "documents").select("doc_id", input_errors(F.col("text"), 4096).alias("error"))


@query("SELECT doc_id, len(" + T.word_tokens_sql("text") + ") AS n_tokens, len(" + T.qc_tokens_sql("text") + ") AS n_qc_tokens FROM documents")
def count_tokens_word(s, d):
    return I.documents(s, d).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"), F.size(T.qc_tokens(F.col("text"))).alias("n_qc_tokens"))
