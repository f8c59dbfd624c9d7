"""Queries: facts, locks, span decoding, methods, survival, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import decode, facts, methods, stats
from . import inputs as I
from .registry import query

_EV = "WITH" + I.EVENT_LINES
_KEYWORDS = ["the", "license", "que"]


def _union_sql(parts):
    return " UNION ALL ".join(parts)


def raw_spans_sql(source: str, id_: str, text: str, patterns) -> str:
    """All matches of RE2 patterns with byte offsets, from split and extract."""
    out = []
    for k, p in enumerate(patterns):
        p = p.replace("'", "''")
        out.append(f"""
  SELECT {id_} AS id, {k} AS k, unnest(range(len(h)))::INT AS i, unnest(h) AS hit, unnest(g[:len(h)]) AS gap
  FROM (SELECT {id_}, regexp_extract_all({text}, '{p}') AS h, regexp_split_to_array({text}, '{p}') AS g FROM {source})""")
    return f"""
hits AS ({_union_sql(out)}),
placed AS (SELECT id, k, (sum(strlen(gap) + strlen(hit)) OVER (PARTITION BY id, k ORDER BY i))::INT AS e, strlen(hit)::INT AS n FROM hits),
spans AS (SELECT id, e - n AS s, e FROM placed WHERE n > 0),
edges AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e) AS g FROM edges),
merged AS (SELECT id, min(s) AS s, max(e) AS e FROM islands GROUP BY id, g)"""


_STRUCTURAL = _EV + "," + raw_spans_sql("ev", "event_id", "line", facts.STRUCTURAL)


@query(_STRUCTURAL + " SELECT id AS event_id, s, e FROM merged")
def structural_spans(s, d):
    rows = I.event_lines(s, d)
    return rows.select("event_id", F.explode(facts.structural_spans(F.col("line"))).alias("x")).select("event_id", "x.s", "x.e")


@query(_EV + "," + raw_spans_sql("ev", "event_id", "line", [facts.STRUCTURAL[5]]) + " SELECT id AS event_id, count(*) AS n, sum(e - s)::BIGINT AS bytes FROM merged GROUP BY id")
def ip_spans(s, d):
    spans = F.explode(S.match_spans(F.col("line"), facts.STRUCTURAL[5])).alias("x")
    return I.event_lines(s, d).select("event_id", spans).groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.col("x.e") - F.col("x.s")).alias("bytes"))


@query("WITH" + raw_spans_sql("documents", "doc_id", "text", _KEYWORDS) + " SELECT id AS doc_id, s, e FROM merged")
def keyword_intervals(s, d):
    return S.merge_rows(decode.keyword_spans(I.documents(s, d), _KEYWORDS))


_CAND = []
for _p, (_kind, _rx, _at, _q) in enumerate(facts.EXTRACTORS):
    _lists = ", ".join(f"regexp_extract_all(line, '{_rx}', {i})" for i in _at)
    _pick = f"unnest({_lists})" if len(_at) == 1 else f"unnest(list_transform(list_zip({_lists}), lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END))"
    _CAND.append(f"SELECT event_id, line, {_p} AS prio, generate_subscripts(regexp_extract_all(line, '{_rx}', {_at[0]}), 1) - 1 AS pos, '{_kind}' AS fact_type, {_pick} AS answer FROM ev")
_CANDIDATES = _EV + f", cands AS (SELECT * FROM ({_union_sql(_CAND)}) WHERE strlen(answer) >= 2)"


@query(_CANDIDATES + " SELECT event_id, prio, pos::INT AS pos, fact_type, answer FROM cands")
def fact_candidates(s, d):
    rows = I.event_lines(s, d).select("event_id", F.explode(facts.candidates(F.col("line"))).alias("c"))
    return rows.select("event_id", "c.prio", "c.pos", "c.fact_type", "c.answer")


_SEM = facts.SEMANTIC


@query(_EV + f""" SELECT event_id, 'semantic:' || lower(k) AS fact_type, trim(v) AS answer FROM (
  SELECT event_id, unnest(regexp_extract_all(line, '{_SEM}', 1)) AS k, unnest(regexp_extract_all(line, '{_SEM}', 2)) AS v FROM ev) WHERE contains(trim(v), ' ')""")
def semantic_candidates(s, d):
    rows = I.event_lines(s, d).select("event_id", F.explode(facts.semantic_candidates(F.col("line"))).alias("c"))
    return rows.select("event_id", "c.fact_type", "c.answer")


@query(_CANDIDATES + f""", firsts AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, fact_type ORDER BY prio, pos) AS nth, row_number() OVER (PARTITION BY event_id ORDER BY prio, pos) AS any_nth,
         {T.occurrences_sql('line', 'answer')} AS uses FROM cands),
picked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (nth = 1 AND uses = 1) DESC, any_nth) AS choice FROM firsts)
SELECT event_id, fact_type, answer FROM picked WHERE choice = 1""")
def best_triple(s, d):
    rows = I.event_lines(s, d).select("event_id", F.explode(facts.best(F.col("line"), facts.candidates(F.col("line")))).alias("b"))
    return rows.select("event_id", "b.fact_type", "b.answer")


_LINES_OF_DOCS = """WITH split AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE length(text) > 0)"""


@query(_LINES_OF_DOCS + """, starts AS (SELECT doc_id, l, unnest(range(0, len(l), 3)) AS start FROM split)
SELECT doc_id, start::INT AS start, array_to_string(l[start + 1:start + 5], chr(10)) AS chunk FROM starts WHERE start = 0 OR start - 3 + 5 < len(l)""")
def line_windows(s, d):
    return facts.windows(I.documents(s, d), 5, 3)


@query("WITH" + I.lines_sql("documents") + """ SELECT doc_id, line_no, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS chunk FROM lines""")
def centered_windows(s, d):
    return facts.centered_windows(I.lines(s, d), 4).select("doc_id", "line_no", "chunk")


_LOCKABLE = " OR ".join("regexp_matches(line, '{}')".format(p.replace("'", "''")) for p in facts.STRUCTURAL)


@query("WITH" + I.lines_sql("documents") + f" SELECT doc_id, count(*) AS n, count(*) FILTER ({_LOCKABLE}) AS lockable FROM lines GROUP BY doc_id")
def floor_lockable(s, d):
    return I.lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(facts.floor_lockable(F.col("line"))).alias("lockable"))


# --- locks and decoding -------------------------------------------------------------------

_TOKS = "WITH" + I.tokens_sql("documents") + "," + raw_spans_sql("documents", "doc_id", "text", _KEYWORDS)
_SCORE = "((hash_of % 1000) / 1000.0)"


@query("WITH" + I.tokens_sql("documents") + " SELECT doc_id, i, s, e FROM toks")
def token_spans(s, d):
    return decode.tokens(I.documents(s, d)).select("doc_id", "i", "s", "e")


_LOCKED = _TOKS + """, locked AS (
  SELECT t.*, m.id IS NOT NULL AS locked FROM toks t LEFT JOIN (SELECT DISTINCT t.doc_id AS id, t.i AS at FROM toks t JOIN merged m ON m.id = t.doc_id AND m.s < t.e AND m.e > t.s) m ON m.id = t.doc_id AND m.at = t.i)"""


@query(_LOCKED + " SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (locked) AS n_locked FROM locked GROUP BY doc_id")
def lock_mask_word(s, d):
    text = F.col("text")
    rows = I.documents(s, d).where(F.length(text) > 0).select("doc_id", decode.placed(T.word_tokens(text), decode.keyword_parts(text, _KEYWORDS)).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.filter("t", lambda x: x.locked)).cast("bigint").alias("n_locked"))


def _scored(s, d):
    """Event lines as arrays of tokens t with a made-up drop score each, prob, and the parts of structural atoms."""
    rows = I.event_lines(s, d).select(F.col("event_id").alias("doc_id"), T.word_tokens(F.col("line")).alias("t"), S.parts_of(F.col("line"), facts.STRUCTURAL).alias("parts"))
    return rows.withColumn("prob", F.transform("t", lambda x, i: ((F.length(x) * 37 + i * 61) % 101) / 101.0))


_SCORED = (
    _EV + ", texts AS (SELECT event_id AS doc_id, line AS text FROM ev)," + I.tokens_sql("texts") + "," + raw_spans_sql("texts", "doc_id", "text", facts.STRUCTURAL)
    + """, scored AS (SELECT t.doc_id, t.i, t.token, t.s, t.e, ((length(token) * 37 + i * 61) % 101) / 101.0::DOUBLE AS prob,
  EXISTS (SELECT 1 FROM merged m WHERE m.id = t.doc_id AND m.s < t.e AND m.e > t.s) AS locked FROM toks t)"""
)
_WORDS = """, bounds AS (SELECT *, (i = 0 OR regexp_matches(token, '^[ \\t\\r\\n]') OR regexp_matches(lag(token) OVER (PARTITION BY doc_id ORDER BY i), '[ \\t\\r\\n]$'))::INT AS b FROM scored),
grouped AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS g FROM bounds)"""
_CHUNKS = ", grouped AS (SELECT *, i // 4 AS g FROM scored)"


@query(_SCORED + _WORDS + " SELECT doc_id, i, g::INT AS g FROM grouped")
def word_groups(s, d):
    return _scored(s, d).select("doc_id", F.posexplode(decode.group_numbers(F.col("t"), "word")).alias("i", "g"))


@query(_SCORED + _CHUNKS + " SELECT doc_id, g::INT AS g, count(*) AS n FROM grouped GROUP BY doc_id, g")
def chunk_groups(s, d):
    return _scored(s, d).select("doc_id", F.posexplode(decode.group_sizes(F.col("t"), "chunk:4")).alias("g", "n"))


@query(_SCORED + " SELECT doc_id, count(*) AS n, count(*) FILTER (locked) AS n_locked FROM scored GROUP BY doc_id")
def project_locks(s, d):
    rows = I.event_lines(s, d).select("event_id", facts.structural_spans(F.col("line")).alias("spans"), S.token_spans(T.word_tokens(F.col("line"))).alias("t"))
    mask = decode.project(F.col("spans"), F.col("t"))
    return rows.select(F.col("event_id").alias("doc_id"), F.size("t").cast("bigint").alias("n"), F.size(F.filter(mask, lambda x: x)).cast("bigint").alias("n_locked"))


@query(_SCORED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, locked ORDER BY prob DESC, i) AS r, count(*) FILTER (NOT locked) OVER (PARTITION BY doc_id) AS u FROM scored)
SELECT doc_id, i, (NOT locked AND r <= round(0.3 * u)) AS dropped FROM ranked""")
def topk_drop(s, d):
    gone = decode.drop_flags(F.col("t"), F.col("prob"), F.col("parts"), 0.3)
    return _scored(s, d).select("doc_id", F.posexplode(gone).alias("i", "dropped"))


def _decode_sql(groups: str, agg: str, rate: float) -> str:
    return _SCORED + groups + f""", per AS (SELECT doc_id, g, {agg}(prob) AS score, count(*)::INT AS n, bool_or(locked) AS held FROM grouped GROUP BY doc_id, g),
lists AS (SELECT doc_id, sum(n) AS total, list({{'t': NULL::INT, 'out': []::BIGINT[], 'n': n, 'g': g::BIGINT}} ORDER BY score DESC, g) FILTER (NOT held) AS l FROM per GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.t + x.n <= round({rate} * total) THEN {{'t': a.t + x.n, 'out': list_append(a.out, x.g), 'n': 0, 'g': 0::BIGINT}} ELSE a END, {{'t': 0, 'out': []::BIGINT[], 'n': 0, 'g': 0::BIGINT}}).out AS gone FROM lists)
SELECT s.doc_id, count(*) AS n_in, count(*) FILTER (NOT coalesce(list_contains(f.gone, s.g::BIGINT), false)) AS n_out,
       string_agg(token, '' ORDER BY i) FILTER (NOT coalesce(list_contains(f.gone, s.g::BIGINT), false)) AS compressed
FROM grouped s LEFT JOIN folded f ON f.doc_id = s.doc_id GROUP BY s.doc_id"""


def _decoded(s, d, *how):
    made = decode.span_decoded(F.col("t"), F.col("prob"), F.col("parts"), *how)
    return _scored(s, d).select("doc_id", made.alias("m")).select("doc_id", "m.*")


@query(_decode_sql(_WORDS, "max", 0.4))
def span_decode_word(s, d):
    return _decoded(s, d, 0.4, "word", "max")


@query(_decode_sql(_CHUNKS, "max", 0.4))
def span_decode_chunk(s, d):
    return _decoded(s, d, 0.4, "chunk:4", "max")


@query(_decode_sql(_WORDS, "min", 0.5))
def span_decode_min(s, d):
    return _decoded(s, d, 0.5, "word", "min")


# --- methods and survival -----------------------------------------------------------------

_LOGS = "WITH" + I.EVENT_DOCS + "," + I.lines_sql("logs")


@query(_LOGS + "," + I.runs_sql(key=T.normalize_key_sql("line")) + """ SELECT doc_id, string_agg(CASE WHEN n < 3 OR rn = 1 OR rn = n THEN line ELSE '... ' || (n - 2) || ' lines elided ...' END, chr(10) ORDER BY line_no)
  FILTER (n < 3 OR rn <= 2 OR rn = n) AS compressed FROM runs GROUP BY doc_id""")
def method_dedup(s, d):
    return methods.deterministic(I.event_docs(s, d))


def _severity_sql(rate: float) -> str:
    return _LOGS + f""", costs AS (SELECT doc_id, line_no, line, {T.severity_rank_sql('line')} AS sev, len({T.word_tokens_sql('line')})::INT + 1 AS cost FROM lines),
budgets AS (SELECT doc_id, greatest(1, round_even((1.0::DOUBLE - {rate}::DOUBLE) * len({T.word_tokens_sql('text')}), 0)::INT) AS budget FROM logs),
lists AS (SELECT doc_id, list({{'spent': NULL::INT, 'out': []::INT[], 'cost': cost, 'no': line_no}} ORDER BY sev, line_no) AS l FROM costs GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.spent + x.cost > budget AND len(a.out) > 0 THEN a ELSE {{'spent': a.spent + x.cost, 'out': list_append(a.out, x.no), 'cost': 0, 'no': 0}} END, {{'spent': 0, 'out': []::INT[], 'cost': 0, 'no': 0}}).out AS kept
  FROM lists JOIN budgets USING (doc_id))
SELECT c.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS compressed FROM costs c JOIN folded f ON f.doc_id = c.doc_id AND list_contains(f.kept, c.line_no) GROUP BY c.doc_id"""


@query(_severity_sql(0.6))
def method_keep_severity(s, d):
    return methods.keep_severity(I.event_docs(s, d), 0.6)


def _short_logs(s, d):
    return I.event_lines(s, d).select(F.col("event_id").alias("doc_id"), F.col("line").alias("text"))


@query()
def method_random(s, d):
    return methods.random_drop(_short_logs(s, d), 0.5)


@query()
def method_random_floor(s, d):
    return methods.random_drop(_short_logs(s, d), 0.5, floor=True)


def _triples(s, d):
    rows = facts.triples(I.event_docs(s, d), 20, 20)
    return rows.select(F.concat_ws(":", "doc_id", "start").alias("triple_id"), "chunk", "answer", "fact_type", F.concat(F.lit("loghub:svc"), (F.col("doc_id") % 3).cast("string")).alias("source"))


# chunks of 20 lines with their best fact; ``logs`` are the chunks, as texts to compress
_TRIPLES = "WITH" + I.EVENT_DOCS.replace("logs AS", "whole AS") + f""",
split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM whole), windows AS (SELECT doc_id, unnest(range(0, len(l), 20)) AS start, l FROM split),
ev2 AS (SELECT doc_id || ':' || start AS event_id, doc_id % 3 AS svc, array_to_string(l[start + 1:start + 20], chr(10)) AS line FROM windows),
cands AS (SELECT * FROM ({_union_sql(c.replace("FROM ev", "FROM ev2") for c in _CAND)}) WHERE strlen(answer) >= 2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY event_id, fact_type ORDER BY prio, pos) AS nth, row_number() OVER (PARTITION BY event_id ORDER BY prio, pos) AS any_nth, {T.occurrences_sql('line', 'answer')} AS uses FROM cands),
picked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (nth = 1 AND uses = 1) DESC, any_nth) AS choice FROM firsts),
triples AS (SELECT p.event_id AS doc_id, p.fact_type, p.answer, p.line AS text, e.svc FROM picked p JOIN ev2 e USING (event_id) WHERE choice = 1),
logs AS (SELECT doc_id, text FROM triples)"""


def _survival_sql(rates: tuple[float, ...], by: str = "", value: str = "") -> str:
    """Of the methods that SQL can say: line runs and severities."""
    runs = I.runs_sql(key=T.normalize_key_sql("line"))
    made = [f"""SELECT 'deterministic' AS method, 0.0::DOUBLE AS rate, doc_id, string_agg(CASE WHEN n < 3 OR rn = 1 OR rn = n THEN line ELSE '... ' || (n - 2) || ' lines elided ...' END, chr(10) ORDER BY line_no) FILTER (n < 3 OR rn <= 2 OR rn = n) AS compressed FROM runs GROUP BY doc_id"""]
    parts = [_TRIPLES, I.lines_sql("logs"), runs, f"costs AS (SELECT doc_id, line_no, line, {T.severity_rank_sql('line')} AS sev, len({T.word_tokens_sql('line')})::INT + 1 AS cost FROM lines)",
             "lists AS (SELECT doc_id, list({'spent': NULL::INT, 'out': []::INT[], 'cost': cost, 'no': line_no} ORDER BY sev, line_no) AS l FROM costs GROUP BY doc_id)"]
    for k, rate in enumerate(rates):
        parts.append(f"""budgets{k} AS (SELECT doc_id, greatest(1, round_even((1.0::DOUBLE - {rate}::DOUBLE) * len({T.word_tokens_sql('text')}), 0)::INT) AS budget FROM logs),
folded{k} AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.spent + x.cost > budget AND len(a.out) > 0 THEN a ELSE {{'spent': a.spent + x.cost, 'out': list_append(a.out, x.no), 'cost': 0, 'no': 0}} END, {{'spent': 0, 'out': []::INT[], 'cost': 0, 'no': 0}}).out AS kept FROM lists JOIN budgets{k} USING (doc_id))""")
        made.append(f"SELECT 'keep-severity', {rate}::DOUBLE, c.doc_id, string_agg(line, chr(10) ORDER BY line_no) FROM costs c JOIN folded{k} f ON f.doc_id = c.doc_id AND list_contains(f.kept, c.line_no) GROUP BY c.doc_id")
    n = lambda c: f"len({T.word_tokens_sql(c)})"
    return ",".join(parts) + f""", made AS ({_union_sql(made)}),
items AS (SELECT m.method, m.rate, {value}contains({T.survival_norm_sql('m.compressed')}, {T.survival_norm_sql('t.answer')}) AS survived, {n('t.text')} / {n('m.compressed')}::DOUBLE AS ratio, 1.0 - {n('m.compressed')} / {n('t.text')}::DOUBLE AS dropped FROM made m JOIN triples t USING (doc_id))
SELECT method, rate, {by}round(avg(survived::INT), 6) AS survival, round(avg(ratio), 6) AS mean_ratio, round(avg(dropped), 6) AS mean_drop, count(*) AS n FROM items GROUP BY ALL"""


_PLAIN = ("deterministic", "keep-severity")


def _rounded(rows):
    return rows.withColumns({c: F.round(c, 6) for c in ("survival", "mean_ratio", "mean_drop")})


@query(_survival_sql((0.2, 0.5, 0.8)))
def survival_sweep(s, d):
    return _rounded(methods.survival_rows(methods.survival_items(_triples(s, d), methods=_PLAIN)))


@query(_survival_sql((0.5,), "fact_type, ", "t.fact_type, "))
def survival_by_fact_type(s, d):
    return _rounded(methods.survival_rows(methods.survival_items(_triples(s, d), rates=(0.5,), methods=_PLAIN), "fact_type"))


@query(_survival_sql((0.5,), "domain, ", "'svc' || t.svc AS domain, "))
def domain_survival(s, d):
    items = methods.survival_items(_triples(s, d), rates=(0.5,), methods=_PLAIN).withColumn("domain", facts.domain(F.col("source")))
    return _rounded(methods.survival_rows(items, "domain"))


@query()
def survival_random(s, d):
    """The methods that drop tokens in the order of their CRC; tests hold them to a plain model."""
    return methods.survival_rows(methods.survival_items(_triples(s, d), rates=(0.5,), methods=("random", "random+floor", "random+span", "random+span+floor")), "fact_type")


_NORM = T.survival_norm_sql


@query(f"SELECT l.o_orderkey AS orderkey, contains({_NORM('upper(l.o_orderpriority) || chr(10) || l.o_orderstatus')}, {_NORM('l.o_orderpriority')}) AS survived FROM orders l")
def survival_vector(s, d):
    text = F.concat(F.upper("o_orderpriority"), F.lit("\n"), F.col("o_orderstatus"))
    return I.table(s, d, "orders").select(F.col("o_orderkey").alias("orderkey"), T.survives(F.col("o_orderpriority"), text).alias("survived"))


# --- statistics ---------------------------------------------------------------------------

_PAIRS = "SELECT event_type, user_id % 3 <> 0 AS a, (user_id + event_id) % 5 <> 0 AS b FROM events"


def _pairs(s, d):
    return I.table(s, d, "events").select("event_type", (F.col("user_id") % 3 != 0).alias("a"), ((F.col("user_id") + F.col("event_id")) % 5 != 0).alias("b"))


@query(f"""WITH p AS ({_PAIRS}), c AS (SELECT event_type, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM p GROUP BY event_type)
SELECT event_type, b, c, b + c AS n_discordant, CASE WHEN b + c = 0 THEN 0.0 ELSE round(pow(abs(b - c) - 1, 2) / (b + c), 6) END AS chi2, b > c AS a_better FROM c""")
def mcnemar_counts(s, d):
    out = stats.mcnemar(_pairs(s, d), "event_type", chi2_p=False)
    return out.select("event_type", "b", "c", "n_discordant", F.round("chi2", 6).alias("chi2"), "a_better")


_FEW = "SELECT user_id, event_type = 'click' AS a, event_id % 7 = 0 AS b FROM events"


@query(f"""WITH RECURSIVE p AS ({_FEW}), c AS (SELECT user_id, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM p GROUP BY user_id),
terms(user_id, n, k, i, term, total) AS (
  SELECT user_id, b + c, least(b, c), 0::BIGINT, pow(0.5::DOUBLE, b + c), pow(0.5::DOUBLE, b + c) FROM c
  UNION ALL SELECT user_id, n, k, i + 1, term * (n - i) / (i + 1), total + term * (n - i) / (i + 1) FROM terms WHERE i < k)
SELECT user_id, n AS n_discordant, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * total) END, 6) AS p_exact FROM terms WHERE i = k""")
def mcnemar_exact_p(s, d):
    few = I.table(s, d, "events").select("user_id", (F.col("event_type") == "click").alias("a"), (F.col("event_id") % 7 == 0).alias("b"))
    return stats.mcnemar(few, "user_id", chi2_p=False).select("user_id", "n_discordant", F.round("p_exact", 6).alias("p_exact"))


@query()
def bootstrap_ci(s, d):
    few = I.table(s, d, "labels").select("toxic", (F.col("quality") == 1).alias("survived"))
    return stats.bootstrap_ci(few, "toxic")


_GOLD = "WITH x AS (SELECT l.doc_id AS i, l.quality::BIGINT AS gold, ((d.n_chars * 7919) % 10007) / 10007.0::DOUBLE AS prob FROM labels l JOIN documents d USING (doc_id))"
_RANKED = _GOLD + """, r AS (SELECT *, row_number() OVER (ORDER BY prob DESC, i) AS rank, row_number() OVER (ORDER BY prob, i) AS up, sum(gold) OVER (ORDER BY prob DESC, i) AS tp, count(*) OVER () AS n, sum(gold) OVER () AS pos FROM x)"""


def _gold(s, d):
    rows = I.table(s, d, "labels").join(I.documents(s, d).select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("doc_id").alias("i"), F.col("quality").alias("gold"), (((F.col("n_chars") * 7919) % 10007) / F.lit(10007.0)).alias("prob"))


@query(_RANKED + " SELECT round(sum(CASE WHEN gold = 1 THEN tp / rank::DOUBLE END) / max(pos), 6) AS pr_auc FROM r")
def ranking_pr_auc(s, d):
    return stats.ranking(_gold(s, d)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(_RANKED + " SELECT round((sum(CASE WHEN gold = 1 THEN up END) - max(pos) * (max(pos) + 1) / 2.0) / (max(pos) * (max(n) - max(pos))), 6) AS roc_auc FROM r")
def ranking_roc_auc(s, d):
    return stats.ranking(_gold(s, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(_RANKED + ", f AS (SELECT 2.0 * tp / (rank + pos) AS f1, rank, prob FROM r) SELECT round(f1, 6) AS best_f1, round(prob, 6) AS best_f1_thr FROM f ORDER BY f1 DESC, rank LIMIT 1")
def ranking_best_f1(s, d):
    return stats.ranking(_gold(s, d)).select(F.round("best_f1", 6).alias("best_f1"), F.round("best_f1_thr", 6).alias("best_f1_thr"))


@query(_RANKED + """, here AS (SELECT tp, rank, n, pos, prob FROM r WHERE rank = greatest(1, round_even(0.25::DOUBLE * n, 0)))
SELECT round(tp / rank::DOUBLE, 6) AS prec_at_target, round(tp / pos::DOUBLE, 6) AS rec_at_target, round(2.0 * tp / (rank + pos), 6) AS f1_at_target, round((tp + (n - pos) - (rank - tp)) / n::DOUBLE, 6) AS accuracy_at_target, round(prob, 6) AS thr_at_target FROM here""")
def ranking_at_target(s, d):
    row = stats.ranking(_gold(s, d), target_rate=0.25)
    return row.select(*[F.round(c, 6).alias(c) for c in ("prec_at_target", "rec_at_target", "f1_at_target", "accuracy_at_target", "thr_at_target")])


@query(_GOLD + " SELECT round(avg(-CASE WHEN gold = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, prob))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, prob))) END), 6) AS per_token_bce, round(count(*) FILTER (prob >= 0.5) / count(*)::DOUBLE, 6) AS argmax_drop_rate FROM x")
def token_bce(s, d):
    return stats.ranking(_gold(s, d)).select(F.round("per_token_bce", 6).alias("per_token_bce"), F.round("argmax_drop_rate", 6).alias("argmax_drop_rate"))


@query("SELECT doc_id, round(exp(-0.5 * (n_chars % 7)), 9) AS by_exp, round(greatest(0.0, 1 - (n_chars % 7) / 6.0), 9) AS by_line, round(1 / (1 + exp(-((n_chars % 9) - 4.0))), 9) AS squashed FROM documents")
def decay_kernels(s, d):
    hops = F.col("n_chars") % 7
    return I.documents(s, d).select("doc_id", F.round(T.hop_decay_exp(hops), 9).alias("by_exp"), F.round(T.hop_decay_linear(hops), 9).alias("by_line"), F.round(T.sigmoid((F.col("n_chars") % 9).cast("double") - 4.0), 9).alias("squashed"))
