"""Queries: corpora, quality control and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import corpus, facts, harness, labels
from ..sources import sinks
from ..sources.readers import byte_chunks, capped, token_windows
from . import inputs as I
from .analysis import raw_spans_sql
from .registry import query

_LINES = "WITH corpus_lines AS (SELECT source AS corpus, doc_id, text FROM documents)," + I.lines_sql("corpus_lines", "split_lines").replace("SELECT doc_id, unnest(range", "SELECT corpus, doc_id, unnest(range").replace("FROM (SELECT doc_id, string_split", "FROM (SELECT corpus, doc_id, string_split") + ", lines AS (SELECT corpus, doc_id * 4294967296 + line_no AS ord, line FROM split_lines)"


def _corpus_lines(s, d):
    rows = I.lines(s, d, ("source",))
    return rows.select(F.col("source").alias("corpus"), (F.shiftleft("doc_id", 32) + F.col("line_no")).alias("ord"), "line")


def _runs_sql(source: str, id_: str, text: str) -> str:
    return f"runs AS (SELECT {id_}, unnest(regexp_extract_all({text}, '[A-Za-z0-9]+')) AS r FROM {source})"


_SIGNAL = f"""WITH {_runs_sql('documents', 'doc_id', 'text')},
rated AS (SELECT doc_id, sum(length(r)) AS total, sum(CASE WHEN {T.is_wordlike_sql('r')} THEN length(r) ELSE 0 END) AS good FROM runs GROUP BY doc_id)
"""


@query(_SIGNAL + "SELECT d.doc_id, round(CASE WHEN coalesce(total, 0) = 0 THEN 1.0 ELSE good / total::DOUBLE END, 9) AS signal FROM documents d LEFT JOIN rated USING (doc_id)")
def signal_ratio(s, d):
    return I.documents(s, d).select("doc_id", F.round(T.signal_ratio(F.col("text")), 9).alias("signal"))


@query(_SIGNAL + "SELECT d.doc_id, coalesce(total >= 24 AND good / total::DOUBLE < 0.30, false) AS low FROM documents d LEFT JOIN rated USING (doc_id)")
def low_signal_filter(s, d):
    return I.documents(s, d).select("doc_id", T.is_low_signal(F.col("text")).alias("low"))


@query(f"WITH {_runs_sql('documents', 'doc_id', 'text')} SELECT r AS token, {T.is_random_sql('r')} AS is_random, {T.is_wordlike_sql('r')} AS is_wordlike FROM (SELECT DISTINCT r FROM runs)")
def random_token_flags(s, d):
    rows = I.documents(s, d).select(F.explode(T.alnum_runs(F.col("text"))).alias("token")).distinct()
    return rows.select("token", T.is_random_token(F.col("token")).alias("is_random"), T.is_wordlike(F.col("token")).alias("is_wordlike"))


@query(_LINES + f""", keyed AS (SELECT *, {T.normalize_line_sql('line')} AS key FROM lines WHERE trim(line) <> '')
SELECT corpus, key, min(ord) AS ord, arg_min(line, ord) AS line, count(*) AS n FROM keyed GROUP BY corpus, key""")
def template_dedup(s, d):
    return corpus.template_dedup(_corpus_lines(s, d), T.normalize_line(F.col("line"))).select("corpus", "key", "ord", "line", "n")


_MASKED = T.normalize_line_sql("line")
_KEYED = f""", masked AS (SELECT corpus, ord, {_MASKED} AS m FROM lines), cut AS (SELECT corpus, ord, regexp_extract_all(m, '[A-Za-z0-9]+') AS r, regexp_split_to_array(m, '[A-Za-z0-9]+') AS g FROM masked),
runs AS (SELECT DISTINCT unnest(r) AS t FROM cut), odd AS (SELECT list(t) AS ts FROM runs WHERE {T.is_random_sql('t')}),
joined AS (SELECT corpus, ord, array_to_string(list_transform(g, lambda x, i: x || coalesce(CASE WHEN i > len(r) THEN '' WHEN list_contains(coalesce(ts, []), r[i]) THEN '<RAND>' ELSE r[i] END, '')), '') AS k FROM cut, odd),
keyed AS (SELECT corpus, ord, regexp_replace(regexp_replace(k, '\\d+', '<NUM>', 'g'), '<(?:TS|UUID|IP|HEX|NUM|RAND)>(?:\\s+<(?:TS|UUID|IP|HEX|NUM|RAND)>)+', '<RAND>', 'g') AS key FROM joined)"""


@query(_LINES + _KEYED + " SELECT corpus, ord, key FROM keyed")
def sampling_template_key(s, d):
    rows = _corpus_lines(s, d)
    return rows.select("corpus", "ord", T.template_key(F.col("line")).alias("key"))


@query(_LINES + f", keyed AS (SELECT *, {T.normalize_line_sql('line')} AS key FROM lines) SELECT corpus, count(*) AS raw_lines, count(DISTINCT key) AS unique_templates, sum(strlen(line) + 1)::BIGINT AS bytes FROM keyed GROUP BY corpus")
def corpus_stats(s, d):
    rows = _corpus_lines(s, d).withColumn("key", T.normalize_line(F.col("line")))
    return rows.groupBy("corpus").agg(F.count("*").alias("raw_lines"), F.countDistinct("key").alias("unique_templates"), F.sum(F.octet_length("line") + 1).alias("bytes"))


_PACK = f"""WITH u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS units FROM documents),
sized AS (SELECT doc_id, list_transform(units, lambda x: {{'c': len({T.word_tokens_sql('x')})::INT, 'q': -1, 'o': []::INT[]}}) AS l FROM u WHERE len(units) > 0),
folded AS (SELECT doc_id, list_transform(l, lambda x: x.c) AS sizes, list_reduce(l, lambda a, x: CASE WHEN x.c > 64 THEN {{'c': 0, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1)}}
  WHEN a.c = 0 OR a.c + x.c > 64 THEN {{'c': x.c, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1)}} ELSE {{'c': a.c + x.c, 'q': a.q, 'o': list_append(a.o, a.q)}} END, {{'c': 0, 'q': -1, 'o': []::INT[]}}).o AS o FROM sized)
SELECT doc_id, q, count(*) AS n_units, sum(n)::BIGINT AS n_tokens FROM (SELECT doc_id, unnest(o) AS q, unnest(sizes) AS n FROM folded) GROUP BY doc_id, q"""


@query(_PACK)
def chunk_pack(s, d):
    rows = I.documents(s, d).select("doc_id", corpus.units(F.col("text"), "log").alias("u")).withColumn("n", F.transform("u", lambda x: F.size(T.word_tokens(x))))
    pairs = rows.select("doc_id", F.explode(F.arrays_zip("n", corpus.pack(F.col("n"), 64).alias("q"))).alias("x"))
    return pairs.groupBy("doc_id", F.col("x.q").alias("q")).agg(F.count("*").alias("n_units"), F.sum("x.n").alias("n_tokens"))


_CHUNKED = f"""WITH u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS units FROM documents),
sized AS (SELECT doc_id, units, list_transform(units, lambda x: {{'c': len({T.word_tokens_sql('x')})::INT, 'q': -1, 'o': []::INT[]}}) AS l FROM u WHERE len(units) > 0),
folded AS (SELECT doc_id, units, list_transform(l, lambda x: x.c) AS sizes, list_reduce(l, lambda a, x: CASE WHEN x.c > 64 THEN {{'c': 0, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1)}}
  WHEN a.c = 0 OR a.c + x.c > 64 THEN {{'c': x.c, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1)}} ELSE {{'c': a.c + x.c, 'q': a.q, 'o': list_append(a.o, a.q)}} END, {{'c': 0, 'q': -1, 'o': []::INT[]}}).o AS o FROM sized),
units AS (SELECT doc_id, unnest(range(len(units))) AS pos, unnest(units) AS u, unnest(o) AS q, unnest(sizes) AS n FROM folded),
whole AS (SELECT doc_id, q, string_agg(u, chr(10) ORDER BY pos) AS t, max(n) AS n FROM units GROUP BY doc_id, q),
toks AS (SELECT *, {T.word_tokens_sql('t')} AS w FROM whole),
pieces AS (SELECT doc_id, q, 0 AS piece, t AS text FROM toks WHERE n <= 64 UNION ALL SELECT doc_id, q, k AS piece, array_to_string(w[k + 1:k + 64], '') FROM (SELECT *, unnest(range(0, len(w), 64)) AS k FROM toks WHERE n > 64))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY q, piece) - 1)::INT AS chunk_id, text, len({T.word_tokens_sql('text')})::INT AS n_tokens FROM pieces"""


@query(_CHUNKED)
def chunk_texts(s, d):
    return corpus.chunked(I.documents(s, d), 64, "log")


@query("""WITH RECURSIVE pools AS (SELECT lang AS corpus, count(*) AS n FROM documents GROUP BY lang),
goal AS (SELECT sum(n) // 2 AS target, greatest(1, (0.4 * (sum(n) // 2))::BIGINT) AS cap FROM pools),
ceil AS (SELECT corpus, least(n, cap) AS c FROM pools, goal),
levels AS (SELECT unnest(range(0, (SELECT cap + 1 FROM goal))) AS v),
fit AS (SELECT max(v) AS v FROM levels WHERE (SELECT sum(least(c, v)) FROM ceil) <= (SELECT least(target, (SELECT sum(c) FROM ceil)) FROM goal)),
base AS (SELECT corpus, least(c, v) AS a, c, row_number() OVER (ORDER BY (c - least(c, v)) DESC, corpus) AS r FROM ceil, fit)
SELECT corpus, (a + CASE WHEN a < c AND r <= (SELECT least(target, (SELECT sum(c) FROM ceil)) FROM goal) - (SELECT sum(a) FROM base) THEN 1 ELSE 0 END)::BIGINT AS slots FROM base""")
def water_fill(s, d):
    counts = {r.corpus: r["n"] for r in I.documents(s, d).groupBy(F.col("lang").alias("corpus")).agg(F.count("*").alias("n")).collect()}
    slots = corpus.water_fill(counts, sum(counts.values()) // 2, 0.4)
    return s.createDataFrame(sorted(slots.items()), "corpus string, slots bigint")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1(text), doc_id) AS r FROM documents) WHERE r <= 7")
def stable_select(s, d):
    docs = I.documents(s, d)
    names = [r.source for r in docs.select("source").distinct().collect()]
    return corpus.stable_select(docs, dict.fromkeys(names, 7), corpus="source", order="doc_id").select("doc_id", "source")


@query("SELECT event_id FROM events ORDER BY sha1(event_id || '|' || event_type || '|' || user_id), event_id LIMIT 50")
def stable_subsample(s, d):
    return corpus.stable_subsample(I.table(s, d, "events"), 50, "event_id", "event_type", "user_id").select("event_id")


@query(f"SELECT doc_id, CASE WHEN {T.hash_share_sql(chr(39) + '3:' + chr(39) + ' || source || ' + chr(39) + ':' + chr(39) + ' || doc_id')} < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(s, d):
    return I.documents(s, d).select("doc_id", corpus.split_bucket(F.col("source"), F.col("doc_id"), 0.1, 3).alias("split"))


@query(_LINES + """, good AS (SELECT * FROM lines WHERE trim(line) <> ''), ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY ord) AS r FROM good)
SELECT corpus, count(*) AS line_count, sum(strlen(line) + 1)::BIGINT AS bytes, string_agg(line, chr(10) ORDER BY ord) FILTER (r <= 3) AS samples FROM ranked GROUP BY corpus""")
def manifest_stats(s, d):
    rows = sinks.manifest(_corpus_lines(s, d))
    return rows.select("corpus", "line_count", "bytes", F.array_join("samples", "\n").alias("samples"))


_SAMPLED = _LINES + _KEYED + f""", templates AS (SELECT l.corpus, k.key, min(l.ord) AS ord, arg_min(l.line, l.ord) AS line FROM lines l JOIN keyed k USING (corpus, ord) WHERE trim(l.line) <> '' GROUP BY ALL),
words AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[A-Za-z0-9]+')) AS r FROM templates), wordlike AS (SELECT r FROM words WHERE {T.is_wordlike_sql('r')}),
rated AS (SELECT corpus, ord, sum(length(t.r)) AS total, sum(CASE WHEN w.r IS NOT NULL THEN length(t.r) ELSE 0 END) AS good FROM (SELECT corpus, ord, unnest(regexp_extract_all(line, '[A-Za-z0-9]+')) AS r FROM templates) t LEFT JOIN wordlike w USING (r) GROUP BY ALL),
clean AS (SELECT t.*, row_number() OVER (PARTITION BY t.corpus ORDER BY t.ord) - 1 AS place FROM templates t LEFT JOIN rated USING (corpus, ord) WHERE NOT coalesce(total >= 24 AND good / total::DOUBLE < 0.30, false)),
u AS (SELECT corpus, place // 10000 AS block, list(line ORDER BY ord) AS units FROM clean GROUP BY ALL),
sized AS (SELECT corpus, block, units, list_transform(units, lambda x: {{'c': len({T.word_tokens_sql('x')})::INT, 'q': -1, 'o': []::INT[]}}) AS l FROM u),
folded AS (SELECT corpus, block, units, list_transform(l, lambda x: x.c) AS sizes, list_reduce(l, lambda a, x: CASE WHEN x.c > 256 THEN {{'c': 0, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1)}}
  WHEN a.c = 0 OR a.c + x.c > 256 THEN {{'c': x.c, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1)}} ELSE {{'c': a.c + x.c, 'q': a.q, 'o': list_append(a.o, a.q)}} END, {{'c': 0, 'q': -1, 'o': []::INT[]}}).o AS o FROM sized),
units AS (SELECT corpus, block, unnest(range(len(units))) AS pos, unnest(units) AS u, unnest(o) AS q, unnest(sizes) AS n FROM folded),
whole AS (SELECT corpus, block, q, string_agg(u, chr(10) ORDER BY pos) AS t, max(n) AS n FROM units GROUP BY ALL),
toks AS (SELECT *, {T.word_tokens_sql('t')} AS w FROM whole WHERE n > 256),
pieces AS (SELECT corpus, block, q, 0 AS k, t AS text FROM whole WHERE n <= 256 UNION ALL SELECT corpus, block, q, k, array_to_string(w[k + 1:k + 256], '') FROM (SELECT *, unnest(range(0, len(w), 256)) AS k FROM toks)),
pool AS (SELECT corpus, (block * 4294967296 + row_number() OVER (PARTITION BY corpus, block ORDER BY q, k) - 1)::BIGINT AS ord, text FROM pieces),
pools AS (SELECT corpus, count(*) AS n FROM pool GROUP BY corpus), caps AS (SELECT corpus, least(n, 15) AS c FROM pools), goal AS (SELECT least(60, sum(c)) AS g FROM caps),
fit AS (SELECT max(v) AS v FROM (SELECT unnest(range(0, 16)) AS v) WHERE (SELECT sum(least(c, v)) FROM caps) <= (SELECT g FROM goal)),
base AS (SELECT corpus, least(c, v) AS a, c, row_number() OVER (ORDER BY (c - least(c, v)) DESC, corpus) AS r FROM caps, fit),
slots AS (SELECT corpus, a + CASE WHEN a < c AND r <= (SELECT g FROM goal) - (SELECT sum(a) FROM base) THEN 1 ELSE 0 END AS slots FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY sha1(text), ord) AS r FROM pool)
SELECT corpus, ord, text FROM ranked JOIN slots USING (corpus) WHERE r <= slots"""


@query(_SAMPLED)
def sample_corpus(s, d):
    chosen, _ = corpus.sample(_corpus_lines(s, d), 60, 0.25, 256)
    return chosen


# --- quality control ----------------------------------------------------------------------

def _short():
    """A shortened copy: every third word goes, and one document in seven gets novel words."""
    left = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 3 != 2), " ")
    return F.concat(left, F.when(F.col("doc_id") % 7 == 0, " qzxnovel qzxnovel").otherwise(""))


def _pairs(s, d):
    return I.documents(s, d).select("doc_id", F.col("text").alias("original"), _short().alias("compressed"))


_PAIRS = """WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
pairs AS (SELECT doc_id, text AS original, array_to_string(list_filter(w, lambda x, i: (i - 1) % 3 <> 2), ' ') || CASE WHEN doc_id % 7 = 0 THEN ' qzxnovel qzxnovel' ELSE '' END AS compressed FROM w)"""
_QC = _PAIRS + f""", o AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({T.qc_tokens_sql('original')}) AS t FROM pairs) GROUP BY ALL),
c AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({T.qc_tokens_sql('compressed')}) AS t FROM pairs) GROUP BY ALL),
on_ AS (SELECT doc_id, sum(n) AS n FROM o GROUP BY 1), cn AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
j AS (SELECT c.doc_id, sum(c.n) AS hits, sum(least(c.n, o.n)) AS matched FROM c JOIN o USING (doc_id, t) GROUP BY 1),
qc AS (SELECT p.doc_id, CASE WHEN coalesce(cn.n, 0) = 0 THEN 0.0 ELSE (cn.n - coalesce(hits, 0))::DOUBLE / cn.n END AS vr, CASE WHEN coalesce(on_.n, 0) = 0 THEN 0.0 ELSE coalesce(matched, 0)::DOUBLE / on_.n END AS mr,
       CASE WHEN coalesce(on_.n, 0) = 0 THEN 0.0 ELSE coalesce(hits, 0)::DOUBLE / on_.n END AS hr FROM pairs p LEFT JOIN on_ USING (doc_id) LEFT JOIN cn USING (doc_id) LEFT JOIN j USING (doc_id)),
qa AS (SELECT *, hr - mr AS ag FROM qc)"""


@query(_QC + " SELECT doc_id, round(vr, 9) AS vr, round(mr, 9) AS mr, round(hr, 9) AS hr, round(ag, 9) AS ag FROM qa")
def qc_metrics(s, d):
    return labels.qc_metrics(_pairs(s, d)).select("doc_id", *[F.round(c, 9).alias(c) for c in ("vr", "mr", "hr", "ag")])


@query(_QC + """, f AS (SELECT * FROM qa WHERE vr <= 0.5),
v AS (SELECT vr AS cut FROM (SELECT vr, row_number() OVER (ORDER BY vr) AS r, count(*) OVER () AS n FROM f) WHERE r = greatest(1, least(n, ceil((1.0::DOUBLE - 5.0::DOUBLE / 100) * n)))),
f1 AS (SELECT f.* FROM f, v WHERE vr <= cut),
a AS (SELECT ag AS cut FROM (SELECT ag, row_number() OVER (ORDER BY ag) AS r, count(*) OVER () AS n FROM f1) WHERE r = greatest(1, least(n, ceil((1.0::DOUBLE - 10.0::DOUBLE / 100) * n))))
SELECT doc_id FROM f1, a WHERE ag <= cut""")
def qc_filter(s, d):
    return labels.qc_filter(labels.qc_metrics(_pairs(s, d)).select("doc_id", "vr", "ag")).select("doc_id")


@query(_QC + " SELECT least(9, greatest(0, floor((hr - 0.0) / 0.1)))::INT AS bin, count(*) AS n FROM qa GROUP BY 1")
def qc_histogram(s, d):
    return labels.histogram(labels.qc_metrics(_pairs(s, d)), "hr")


def _rated_sql(pairs: str) -> str:
    """rated: (id, teacher, vr, ag) of ``pairs`` (id, teacher, original, compressed)."""
    return f"""o AS (SELECT id, teacher, t, count(*) AS n FROM (SELECT id, teacher, unnest({T.qc_tokens_sql('original')}) AS t FROM {pairs}) GROUP BY ALL),
c AS (SELECT id, teacher, t, count(*) AS n FROM (SELECT id, teacher, unnest({T.qc_tokens_sql('compressed')}) AS t FROM {pairs}) GROUP BY ALL),
os AS (SELECT id, teacher, sum(n) AS n FROM o GROUP BY ALL), cs AS (SELECT id, teacher, sum(n) AS n FROM c GROUP BY ALL),
j AS (SELECT id, teacher, sum(c.n) AS hits, sum(least(c.n, o.n)) AS matched FROM c JOIN o USING (id, teacher, t) GROUP BY ALL),
rated AS (SELECT p.*, CASE WHEN coalesce(cs.n, 0) = 0 THEN 0.0 ELSE (cs.n - coalesce(hits, 0))::DOUBLE / cs.n END AS vr,
  CASE WHEN coalesce(os.n, 0) = 0 THEN 0.0 ELSE coalesce(hits, 0)::DOUBLE / os.n END - CASE WHEN coalesce(os.n, 0) = 0 THEN 0.0 ELSE coalesce(matched, 0)::DOUBLE / os.n END AS ag
  FROM {pairs} p LEFT JOIN os USING (id, teacher) LEFT JOIN cs USING (id, teacher) LEFT JOIN j USING (id, teacher))"""


@query(_PAIRS + ", outputs AS (SELECT doc_id AS id, 'thirds' AS teacher, original, compressed FROM pairs UNION ALL SELECT doc_id, 'head', original, string_split(original, chr(10))[1] FROM pairs), offered AS (SELECT * FROM outputs WHERE trim(compressed, ' ') <> ''),"
       + _rated_sql("offered") + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vr > 0, vr, ag, length(compressed), teacher) AS r FROM rated) SELECT id, teacher, compressed, round(vr, 9) AS vr, round(ag, 9) AS ag FROM ranked WHERE r = 1")
def best_teacher(s, d):
    pairs = _pairs(s, d)
    one = pairs.select(F.col("doc_id").alias("id"), F.lit("thirds").alias("teacher"), "original", "compressed")
    two = pairs.select(F.col("doc_id").alias("id"), F.lit("head").alias("teacher"), "original", F.substring_index("original", "\n", 1).alias("compressed"))
    return labels.best_output(one.unionByName(two)).select("id", "teacher", "compressed", F.round("vr", 9).alias("vr"), F.round("ag", 9).alias("ag"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_comment LIKE '%.py' THEN 'python' WHEN l_comment LIKE '%.json' THEN 'json' ELSE 'text' END AS language FROM (SELECT l_orderkey, l_linenumber, 'f' || l_linenumber || CASE l_linenumber % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.json' ELSE '.log' END AS l_comment FROM lineitem)")
def language_of_path(s, d):
    n = F.col("l_linenumber")
    path = F.concat(F.lit("f"), n.cast("string"), F.when(n % 3 == 0, ".py").when(n % 3 == 1, ".json").otherwise(".log"))
    return I.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", labels.language_of(path).alias("language"))


@query()
def derive_mask(s, d):
    # alignment is quadratic, so documents are aligned a chunk at a time, all of them
    chunks = corpus.chunked(I.documents(s, d)).repartition(F.col("doc_id"), F.col("chunk_id"))
    short = chunks.select("doc_id", "chunk_id", F.col("text").alias("original"), F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 3 != 2), " ").alias("compressed"))
    return labels.derive_mask(short).select("doc_id", "chunk_id", F.size("tokens").alias("n_tokens"), F.size(F.filter("keep", lambda k: k)).alias("n_kept"))


_SAL = facts.SEMANTIC.replace("'", "''")
_SALIENT = ("WITH" + I.EVENT_LINES + ", texts AS (SELECT event_id AS doc_id, line AS text FROM ev)," + I.tokens_sql("texts") + "," + raw_spans_sql("texts", "doc_id", "text", facts.STRUCTURAL) + f""",
said AS (SELECT doc_id, unnest(range(len(h)))::INT AS i, unnest(h) AS hit, unnest(v) AS v, unnest(g[:len(h)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '{_SAL}') AS h, regexp_extract_all(text, '{_SAL}', 2) AS v, regexp_split_to_array(text, '{_SAL}') AS g FROM texts)),
quoted AS (SELECT doc_id, (sum(strlen(gap) + strlen(hit)) OVER (PARTITION BY doc_id ORDER BY i))::INT - 1 AS e, strlen(v)::INT AS n FROM said),
every AS (SELECT id, s, e FROM merged UNION ALL SELECT doc_id, e - n, e FROM quoted)
SELECT t.doc_id AS event_id, (count(*) FILTER (EXISTS (SELECT 1 FROM every m WHERE m.id = t.doc_id AND m.s < t.e AND m.e > t.s)))::INT AS n_salient, count(*)::INT AS n FROM toks t GROUP BY t.doc_id""")


@query(_SALIENT)
def salience_weights(s, d):
    w = labels.salience_weights(F.col("line"), S.token_spans(T.word_tokens(F.col("line"))), 3.0)
    # weights are computed by themselves: a function that isn't deterministic is run for each use
    return I.event_lines(s, d).select("event_id", w.alias("w")).select("event_id", F.size(F.filter("w", lambda x: x > 1)).alias("n_salient"), F.size("w").alias("n"))


@query()
def label_ceiling(s, d):
    """By alignment of each chunk with a shortened copy; tests hold it to a plain model."""
    chunks = facts.windows(I.event_docs(s, d), 20, 20)
    short = F.array_join(F.filter(F.split("chunk", " "), lambda w, i: i % 3 != 2), " ")
    return harness.ceiling_types(harness.ceiling_items(chunks.select(F.concat_ws(":", "doc_id", "start").alias("id"), F.col("chunk").alias("original"), short.alias("compressed"))))


# --- source operators over tables ---------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE length(text) > 0)),
t AS (SELECT doc_id, sum(strlen(x) + 1) - 1 AS bytes FROM l GROUP BY doc_id) SELECT doc_id, bytes::BIGINT AS bytes FROM t""")
def byte_chunk_totals(s, d):
    rows = byte_chunks(I.documents(s, d), 2048)
    return rows.groupBy("doc_id").agg(F.sum(F.octet_length("chunk")).alias("bytes"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) || CASE WHEN unnest(range(len(p))) < len(p) - 1 THEN chr(10) ELSE '' END AS x FROM p) WHERE x <> ''),
u AS (SELECT doc_id, i, 0 AS k, x FROM l WHERE strlen(x) <= 2048 UNION ALL SELECT doc_id, i, k, substr(x, k + 1, 512) FROM (SELECT *, unnest(range(0, length(x), 512)) AS k FROM l WHERE strlen(x) > 2048)),
s AS (SELECT doc_id, list({'c': strlen(x)::INT, 'q': 0, 'o': []::INT[], 'n': []::INT[]} ORDER BY i, k) AS l FROM u GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.c > 0 AND a.c + x.c > 2048 THEN {'c': x.c, 'q': a.q + 1, 'o': list_append(a.o, a.q + 1), 'n': list_append(a.n, x.c)}
  ELSE {'c': a.c + x.c, 'q': a.q, 'o': list_append(a.o, a.q), 'n': list_append(a.n, x.c)} END, {'c': 0, 'q': 0, 'o': []::INT[], 'n': []::INT[]}) AS r FROM s)
SELECT doc_id, q AS chunk_id, sum(n)::INT AS bytes FROM (SELECT doc_id, unnest(r.o) AS q, unnest(r.n) AS n FROM f) GROUP BY doc_id, q""")
def byte_chunk_rows(s, d):
    return byte_chunks(I.documents(s, d), 2048).select("doc_id", "chunk_id", F.octet_length("chunk").alias("bytes"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(p)))::INT AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
own AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS own FROM l), kept AS (SELECT * FROM own WHERE own <= 1500),
sizes AS (SELECT doc_id, max(own) AS size FROM kept GROUP BY doc_id), before AS (SELECT doc_id, coalesce(sum(size) OVER (ORDER BY lpad(doc_id::VARCHAR, 12, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes)
SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, line_no FROM kept JOIN before USING (doc_id) WHERE b + own <= 200000""")
def byte_caps(s, d):
    files = I.documents(s, d).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    return capped(files, 1500, 200_000).select("path", "line_no")


@query("SELECT vec_id, start::INT AS start, len(embedding[start + 1:start + 24])::INT AS n FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding), 16)) AS start FROM embeddings) WHERE start = 0 OR start - 16 + 24 < len(embedding)")
def token_window_rows(s, d):
    return token_windows(I.table(s, d, "embeddings"), 24, 16, "embedding").select("vec_id", "start", F.size("window").alias("n"))
