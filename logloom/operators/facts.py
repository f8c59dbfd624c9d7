"""Structural atoms, facts and question/answer triples of log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import spans as S
from ..functions import text as T

# The patterns of atoms that compression must keep.
_UUID = T.RUNTIME_MASKS[2][0]
STRUCTURAL = (
    r"\b[A-Z][A-Za-z0-9_]*(?:Error|Exception)\b",
    r"\b(?:FATAL|CRITICAL|ERROR|EXCEPTION|TRACEBACK|WARN(?:ING)?)\b",
    r"(?i)(?:status|HTTP|code)[=:\s]+[45]\d{2}\b",
    r"\berrno[=:]\s*\d+\b",
    r"(?i)\berror code\s+(?:0x[0-9A-Fa-f]+|\d+)\b",
    T.RUNTIME_MASKS[3][0],
    _UUID,
    r"\bINC\d{4,}\b",
    r"request_id[=:]\s*[A-Za-z0-9_-]+",
    r'(?i)\b(?:root_cause|resolution|resolution_action|remediation|failure_reason|reason|msg|message|short_description|summary)\s*[=:]\s*"[^"\n]{1,200}"',
)
# Fact type, pattern, the groups whose first match is the answer, question.
EXTRACTORS = (
    ("exception", r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b", (1,), "Which exception type was raised?"),
    ("incident", r"\b(INC\d{4,})\b", (1,), "What incident number is referenced?"),
    ("request_id", r"request_id[=:]\s*([A-Za-z0-9_-]+)", (1,), "What was the request_id of the affected request?"),
    ("http_status", r"(?i)\b(?:status|HTTP|code)[=:\s]+([45]\d{2})\b", (1,), "What HTTP status code was returned?"),
    ("error_code", r"\berrno[=:]\s*(\d+)\b|\berror code\s+(0x[0-9A-Fa-f]+|\d+)\b", (1, 2), "What error code was reported?"),
    ("client_ip", r"client_ip[=:]\s*(\d{1,3}(?:\.\d{1,3}){3})", (1,), "What client IP is associated with the event?"),
    ("severity", r"\b(FATAL|CRITICAL|ERROR)\b", (1,), "What is the most severe log level present in this chunk?"),
)
SEMANTIC_QUESTIONS = {
    "root_cause": "What was the root cause?",
    "resolution": "What resolution or action was applied?",
    "resolution_action": "What resolution or action was applied?",
    "remediation": "What remediation was applied?",
    "reason": "What reason was given?",
    "failure_reason": "What was the failure reason?",
    "msg": "What did the log message say?",
    "message": "What did the log message say?",
    "short_description": "What was the issue described as?",
    "summary": "What was the summary?",
}
SEMANTIC = r'(?i)\b(' + "|".join(SEMANTIC_QUESTIONS) + r')\s*[=:]\s*"([^"\n]{3,})"'


def structural_spans(text: Column) -> Column:
    """Merged byte ranges of all structural atoms."""
    return S.merged_spans(S.parts_of(text, STRUCTURAL))


def floor_lockable(text: Column) -> Column:
    """Whether any structural atom is in the text."""
    found = F.lit(False)
    for p in STRUCTURAL:
        found = found | text.rlike(p)
    return found


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(i))


def _candidate(prio: int, kind: str, question: str):
    return lambda a, i: F.struct(F.lit(prio).alias("prio"), i.alias("pos"), F.lit(kind).alias("fact_type"), F.lit(question).alias("question"), a.alias("answer"))


def candidates(text: Column) -> Column:
    """array<struct<prio, pos, fact_type, question, answer>>, by extractor, then by place."""
    parts = []
    for prio, (kind, pattern, at, question) in enumerate(EXTRACTORS):
        answers = _group(text, pattern, at[0])
        for i in at[1:]:
            answers = F.zip_with(answers, _group(text, pattern, i), lambda a, b: F.when(a != "", a).otherwise(b))
        parts.append(F.transform(answers, _candidate(prio, kind, question)))
    return F.filter(F.concat(*parts), lambda c: F.octet_length(c.answer) >= 2)


def semantic_candidates(text: Column) -> Column:
    """The same for quoted values of salient keys that have a space."""
    question = F.create_map(*[F.lit(x) for kv in SEMANTIC_QUESTIONS.items() for x in kv])
    pairs = F.zip_with(_group(text, SEMANTIC, 1), _group(text, SEMANTIC, 2), lambda k, v: F.struct(F.lower(k).alias("k"), F.trim(v).alias("v")))
    made = F.transform(pairs, lambda p, i: F.struct(F.lit(0).alias("prio"), i.alias("pos"), F.concat(F.lit("semantic:"), p.k).alias("fact_type"), F.element_at(question, p.k).alias("question"), p.v.alias("answer")))
    return F.filter(made, lambda c: F.contains(c.answer, F.lit(" ")))


def best(text: Column, found: Column) -> Column:
    """An array of the candidate to ask for, empty without any: of the first of each fact type,
    the first whose answer is unique in the text; the very first candidate if none is."""

    def first(c: Column) -> Column:
        return T.bound(F.transform(c, lambda x: x.fact_type), lambda types: F.filter(c, lambda x, i: F.array_position(types, x.fact_type) == i + 1))

    return T.bound(found, lambda c: F.slice(F.concat(F.filter(first(c), lambda x: T.occurrences(text, x.answer) == 1), c), 1, 1))


def windows(docs: DataFrame, width: int, stride: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, chunk): lines in windows; the last one ends at the last line."""
    text = F.regexp_replace(F.col(text_col), "\r?\n$", "")
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.split(text, "\r?\n", -1).alias("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(stride)), lambda i: (i == 0) | (i - stride + width < F.size("lines")))
    return rows.withColumn("start", F.explode(starts)).select("doc_id", "start", F.array_join(F.slice("lines", F.col("start") + 1, F.lit(width)), "\n").alias("chunk"))


def centered_windows(lines: DataFrame, width: int) -> DataFrame:
    """Adds chunk: the lines up to ``width // 2`` before and after, clipped."""
    half = width // 2
    around = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(-half, half)
    return lines.withColumn("chunk", F.array_join(F.collect_list("line").over(around), "\n"))


def triples(docs: DataFrame, width: int = 40, stride: int = 40, semantic: bool = False) -> DataFrame:
    """(doc_id, start, chunk, fact_type, question, answer): at most one triple a window."""
    chunks = windows(docs, width, stride)
    found = (semantic_candidates if semantic else candidates)(F.col("chunk"))
    rows = chunks.select("doc_id", "start", "chunk", F.explode(best(F.col("chunk"), found)).alias("b"))
    return rows.select("doc_id", "start", "chunk", "b.fact_type", "b.question", "b.answer")


# --- prose needles of known log systems ---------------------------------------------------

# Line headers; group 1 is the message.
HEADERS = {
    "openstack": r"^\S+\s+\d{4}-\d{2}-\d{2}\s+[\d:.]+\s+\d+\s+[A-Z]+\s+[\w.$]+\s+(?:\[[^\]]*\]\s+)?(.*)$",
    "spark": r"^\d\d/\d\d/\d\d \d\d:\d\d:\d\d [A-Z]+ +[\w.$]+: (.*)$",
    "hadoop": r"^\d{4}-\d{2}-\d{2} [\d:,]+ [A-Z]+ +\[[^\]]*\] [\w.$]+: (.*)$",
    "zookeeper": r"^[\d\- :,]+ - [A-Z]+ +\[[^\]]*\] - (.*)$",
    "hdfs": r"^\d{6} \d{6} \d+ [A-Z]+ [\w.$]+: (.*)$",
    "linux": r"^[A-Z][a-z]{2} +\d+ [\d:]+ \S+ \S+: (.*)$",
    "bgl": r"^\S+ \d+ [\d.]+ \S+ [\d.\-]+ \S+ RAS \w+ [A-Z]+ (.*)$",
}
VOLATILE_TAIL = r"(?:\s+(?:\d+|0x[0-9a-fA-F]+|blk_-?\d+|[\w.$]+_\d+|\S*\d{3,}\S*))+\s*$"
NEEDLE_QUESTION = "What operational event or condition did the log report?"


def _words(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))


def message(system: Column, line: Column) -> Column:
    """The line without its system's header; null where it doesn't fit, or is web noise."""
    out = F.lit(None).cast("string")
    for name, pattern in HEADERS.items():
        got = F.when(line.rlike(pattern), F.trim(F.regexp_extract(line, pattern, 1)))
        if name == "openstack":
            got = F.when(~(got.startswith('"') | F.lower(got).startswith("get ") | F.contains(got, F.lit("HTTP/1.1"))), got)
        out = F.when(system == name, got).otherwise(out)
    return out


def needle(msg: Column) -> Column:
    """A stable prose phrase of a message, or null: three words, a small letter, no three
    digits in a row, 12 to 120 characters."""
    x = F.regexp_replace(F.trim(msg), r"\.+$", "")
    cut = F.trim(F.regexp_replace(x, VOLATILE_TAIL, ""))
    x = F.when(_words(cut) >= 3, cut).otherwise(x)
    x = F.trim(F.regexp_replace(F.trim(x), "^:+|:+$", ""))
    good = (_words(x) >= 3) & x.rlike("[A-Za-z]") & x.rlike(r"\p{Ll}") & ~x.rlike(r"\d{3,}") & F.length(x).between(12, 120)
    return F.when(good, x)


def system_triples(lines: DataFrame, width: int = 40, most: int = 200) -> DataFrame:
    """Needles of lines (system, doc_id, line_no, line): prose that no structural atom covers
    and that is unique in the window around it; the first ``most`` accepted ones a system."""
    rows = centered_windows(lines, width).withColumn("answer", needle(message(F.col("system"), F.col("line"))))
    ok = F.col("answer").isNotNull() & ~floor_lockable(F.col("answer")) & (T.occurrences(F.col("chunk"), F.col("answer")) == 1)
    # of lines with one answer the first stands for it, so that reruns agree
    first = rows.where(ok).groupBy("system", "answer").agg(F.min_by(F.struct("doc_id", "line_no", "chunk"), F.struct("doc_id", "line_no")).alias("f")).select("system", "answer", "f.*")
    rank = F.row_number().over(W.partitionBy("system").orderBy("doc_id", "line_no"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(
        F.concat(F.lit("loghub:"), F.col("system")).alias("source"), "doc_id", "line_no", "chunk", F.lit(NEEDLE_QUESTION).alias("question"), "answer", F.lit("semantic:prose").alias("fact_type")
    )


def domain(source: Column) -> Column:
    return F.when(source.startswith("loghub:"), F.substring(source, 8, 1 << 20)).otherwise(source)


def held_out(chunks: DataFrame) -> DataFrame:
    """(chunk_id, chunk, fact_type, question, answer) of chunks (chunk_id, chunk): the best
    semantic and the best structural fact of each, an answer of a type once, the first."""
    text = F.col("chunk")
    both = [best(text, semantic_candidates(text)), best(text, candidates(text))]
    slim = lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), c.fact_type.alias("fact_type"), c.question.alias("question"), c.answer.alias("answer"))
    rows = chunks.select("chunk_id", "chunk", F.explode(F.concat(*[F.transform(b, slim(k)) for k, b in enumerate(both)])).alias("b")).withColumn("kind", F.col("b.kind"))
    first = F.row_number().over(W.partitionBy("b.fact_type", "b.answer").orderBy("chunk_id", "kind"))
    return rows.withColumn("_n", first).where("_n = 1").select("chunk_id", "chunk", "b.fact_type", "b.question", "b.answer")


def class_counts(triples_: DataFrame) -> DataFrame:
    """(class, n): semantic and structural facts."""
    return triples_.groupBy(F.when(F.col("fact_type").startswith("semantic:"), "semantic").otherwise("structural").alias("class")).agg(F.count("*").alias("n"))
