"""The driver's tables as this engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lines import explode_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task gets of a table that is dealt again.
ROWS = 100_000


def spread(rows: DataFrame, key: str | None = None) -> DataFrame:
    """``rows`` in as many partitions as there are cores, if a scan gives fewer or uneven ones.

    A table of one row group is one task, however much work its rows need and however many
    splits its file has; tables of many even splits are left as they are. A large table is dealt by its
    first column in tasks of about ``ROWS`` rows. With a ``key`` rows are dealt by it in any case.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return rows.repartition(cores, *([key] if key else []))
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]  # from the files' own counts
    if key is None and max(sizes, default=0) * cores <= 2 * sum(sizes):
        return rows
    return rows.repartition(max(cores, sum(sizes) // ROWS + 1), key or rows.columns[0])


def event_lines(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """(event_id, user_id, ts, line): events as log lines, dealt by ``key``."""
    u, e, c = F.col("user_id"), F.col("event_type"), lambda x: x.cast("string")
    level = F.when(e == "error", "ERROR").when(e == "purchase", "WARN").otherwise("INFO")
    tail = F.when(e == "error", ' raised TimeoutError msg="upstream pool exhausted"').otherwise(' msg="handled"')
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" svc="), e, F.lit(" user="), c(u), F.lit(" status="), F.when(e == "error", "503").otherwise("200"),
        F.lit(" request_id="), c(F.col("event_id")), F.lit(" client_ip=10.0."), c(F.floor(u / 256)), F.lit("."), c(u % 256), tail,
    )
    return spread(table(spark, sf_dir, "events"), key).select("event_id", "user_id", "ts", line.alias("line"))


EVENT_LINES = """
ev AS (
  SELECT event_id, user_id, ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END
         || ' svc=' || event_type || ' user=' || user_id || ' status=' || CASE event_type WHEN 'error' THEN '503' ELSE '200' END
         || ' request_id=' || event_id || ' client_ip=10.0.' || (user_id // 256) || '.' || (user_id % 256)
         || CASE event_type WHEN 'error' THEN ' raised TimeoutError msg="upstream pool exhausted"' ELSE ' msg="handled"' END AS line
  FROM events)"""


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a log a user."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))), lambda x: x.line)
    return event_lines(spark, sf_dir, "user_id").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(lines, "\n").alias("text"))


EVENT_DOCS = EVENT_LINES + """,
logs AS (SELECT user_id AS doc_id, string_agg(line, chr(10) ORDER BY ts, event_id) AS text FROM ev GROUP BY user_id)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return explode_lines(documents(spark, sf_dir), keep=keep)


def lines_sql(source: str, name: str = "lines") -> str:
    return f"""
{name} AS (
  SELECT doc_id, unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts
        FROM {source} WHERE length(text) > 0))"""


def runs_sql(lines: str = "lines", key: str | None = None, head: int = 1, tail: int = 1, min_run: int = 3) -> str:
    """keyed, numbered, runs and marked, as ``operators.lines.marked``."""
    return f"""
keyed AS (SELECT *, {key or T.normalize_line_sql("line")} AS key FROM {lines}),
flagged AS (SELECT *, (key IS DISTINCT FROM lag(key) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS is_new FROM keyed),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM flagged),
runs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS rn FROM numbered),
marked AS (
  SELECT *, (n < {max(min_run, head + tail + 1)} OR rn <= {head} OR rn > n - {tail}) AS kept,
         CASE WHEN n >= {max(min_run, head + tail + 1)} THEN sum(CASE WHEN n >= {max(min_run, head + tail + 1)} AND rn = 1 THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY line_no) - 1 END AS group_idx
  FROM runs)"""


def tokens_sql(source: str, name: str = "toks") -> str:
    """(doc_id, i, token, s, e): word tokens with byte spans."""
    return f"""
{name}_list AS (SELECT doc_id, {T.word_tokens_sql("text")} AS l FROM {source}),
{name}_rows AS (SELECT doc_id, unnest(range(len(l)))::INT AS i, unnest(l) AS token FROM {name}_list),
{name}_ends AS (SELECT *, sum(strlen(token)) OVER (PARTITION BY doc_id ORDER BY i)::INT AS e FROM {name}_rows),
{name} AS (SELECT *, e - strlen(token)::INT AS s FROM {name}_ends)"""
