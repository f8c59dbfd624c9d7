"""Line templates: runs of equal templates collapse, and rebuild exactly.

Everything hangs on one exchange by document: lines, run numbers, run lengths and group
numbers are windows over the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, line_no, line): the ``\\n`` segments; a last newline ends a line, it begins none.

    A carriage return stays part of its line. Empty and null texts have no lines.
    """
    t = F.col(text_col)
    body = F.when(t.endswith("\n"), F.expr(f"left(`{text_col}`, length(`{text_col}`) - 1)")).otherwise(t)
    return docs.where(F.length(t) > 0).select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line"))


def with_runs(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """Adds key, run (number in the document), n (lines in the run) and rn (place in it, from 1)."""
    by = W.partitionBy("doc_id").orderBy("line_no")
    out = lines.withColumn("key", T.normalize_line(F.col("line")) if key is None else key)
    new = F.coalesce(F.col("key") != F.lag("key").over(by), F.lit(True)).cast("int")
    out = out.withColumn("_new", new)
    out = out.withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    run = W.partitionBy("doc_id", "run")
    return out.withColumn("n", F.count("*").over(run).cast("int")).withColumn("rn", F.row_number().over(run.orderBy("line_no")))


def marked(lines: DataFrame, head: int = 1, tail: int = 1, min_run: int = 3, key: Column | None = None) -> DataFrame:
    """Adds kept (the line stays) and group_idx (number of its collapsed run, else null)."""
    head, least = max(head, 1), max(min_run, max(head, 1) + tail + 1)
    runs = with_runs(lines, key)
    collapsed = F.col("n") >= least
    kept = ~collapsed | (F.col("rn") <= head) | (F.col("rn") > F.col("n") - tail)
    by = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    first = (collapsed & (F.col("rn") == 1)).cast("int")
    out = runs.withColumn("kept", kept).withColumn("_first", first)
    return out.withColumn("group_idx", F.when(collapsed, (F.sum("_first").over(by) - 1).cast("int"))).drop("_first")


def groups(lines: DataFrame, head: int = 1, tail: int = 1, min_run: int = 3) -> DataFrame:
    """(doc_id, group_idx, key, n_elided, elided): the middles of collapsed runs, verbatim."""
    gone = marked(lines, head, tail, min_run).where("not kept")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line)
    return gone.groupBy("doc_id", "group_idx").agg(F.min("key").alias("key"), F.count("*").cast("int").alias("n_elided"), ordered.alias("elided"))


def escaped(key: Column) -> Column:
    """The key as a quoted string literal shows it: quotes, backslashes and controls escaped."""
    plain = F.replace(F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    named = {"\r": "\\r", "\n": "\\n", "\0": "\\0"}
    whole = plain
    for c in map(chr, (*range(32), *range(127, 160))):
        if c != "\t":
            whole = F.replace(whole, F.lit(c), F.lit(named.get(c, f"\\u{{{ord(c):x}}}")))
    return F.when(key.rlike("[\\x00-\\x08\\x0a-\\x1f\\x7f-\\x9f]"), whole).otherwise(plain)


def summary_line(index: Column, count: Column, key: Column) -> Column:
    """What stands for an elided middle."""
    return F.concat(F.lit("⟪elided idx="), index.cast("string"), F.lit(" lines="), count.cast("string"), F.lit(' key="'), escaped(key), F.lit('"⟫'))


def reduced(docs: DataFrame, head: int = 1, tail: int = 1, min_run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, reduced, n_lines, n_elided, n_groups): the text with each middle summarised."""
    head = max(head, 1)
    lines = marked(explode_lines(docs, id_col, text_col), head, tail, min_run)
    shown = F.when(F.col("kept"), F.col("line")).when(F.col("rn") == head + 1, summary_line(F.col("group_idx"), F.col("n") - head - tail, F.col("key")))
    made = lines.withColumn("shown", shown).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("line_no", "shown")))), lambda x: x.shown), "\n").alias("body"),
        F.count("*").alias("n_lines"),
        F.count_if(~F.col("kept")).alias("n_elided"),
        F.coalesce(F.max("group_idx") + 1, F.lit(0)).alias("n_groups"),
    )
    ends = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).endswith("\n").alias("ends"))
    out = ends.join(made, "doc_id", "left")
    text = F.concat(F.coalesce("body", F.lit("")), F.when(F.col("ends"), "\n").otherwise(""))
    return out.select("doc_id", text.alias("reduced"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("n_lines", "n_elided", "n_groups")])


def units(docs: DataFrame, head: int = 1, tail: int = 1, min_run: int = 3) -> tuple[DataFrame, DataFrame]:
    """(units, groups): what is rebuilt from; a unit is a kept line or the place of a group."""
    head = max(head, 1)
    lines = marked(explode_lines(docs), head, tail, min_run)
    shown = lines.where(F.col("kept") | (F.col("rn") == head + 1))
    return shown.select("doc_id", "line_no", F.when(F.col("kept"), F.col("line")).alias("line"), F.when(~F.col("kept"), F.col("group_idx")).alias("group_idx")), groups(explode_lines(docs), head, tail, min_run)


def rebuild(unit_rows: DataFrame, group_rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, text) from units and groups; ``ends``: (doc_id, ends_in_newline). Never parses a summary."""
    parts = unit_rows.join(group_rows.select("doc_id", "group_idx", "elided"), ["doc_id", "group_idx"], "left")
    piece = F.coalesce(F.col("line"), F.array_join("elided", "\n"))
    body = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))), lambda x: x.piece), "\n").alias("body"))
    return ends.join(body, "doc_id", "left").select("doc_id", F.concat(F.coalesce("body", F.lit("")), F.when(F.col("ends_in_newline"), "\n").otherwise("")).alias("text"))
