"""Readers. Each gives a DataFrame; what a record lacks becomes "" or null, never an error."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.stats import numbered

MAX_FILE_BYTES = 64 << 20
MAX_TEXT_BYTES = 1 << 20
MAX_LINE_BYTES = 16 << 20
PER_FILE_BYTES, TOTAL_BYTES, CHUNK_BYTES = 25 << 20, 64 << 20, 256 << 10
LOG_GLOB = "*.{log,txt,jsonl,out,err}"


def read_log_file(spark: SparkSession, path: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text), whole files; one over ``most`` bytes or not UTF-8 raises when it is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    ok = F.when(F.octet_length("content") > most, F.raise_error(F.lit("path_too_large"))).otherwise(F.col("content").cast("string"))
    return rows.select("path", ok.alias("text")).select("path", F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(F.raise_error(F.lit("invalid_utf8"))).alias("text"))


def discover_logs(spark: SparkSession, root: str, glob: str = LOG_GLOB, skip: str = r"(?:expected|needles|sidecar)[^/]*$") -> DataFrame:
    """(path, text) of log files under ``root``, at any depth, without side files; bad bytes replaced."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.make_valid_utf8("value").alias("text")).where(~F.col("path").rlike(skip)).orderBy("path")


def source_tree(spark: SparkSession, root: str, suffixes=("py", "rs", "ts", "tsx", "js", "go", "java", "c", "cpp", "h", "json", "md")) -> DataFrame:
    """(path, text) of source files; generated parsers are passed over."""
    return discover_logs(spark, root, "*.{" + ",".join(suffixes) + "}", r"(?:^|/)parser\.c$|/node_modules/|/target/")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings, absent values "". Without a required column no row is left."""
    rows = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=True, escape='"')
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])
    return rows if set(required) <= set(rows.columns) else rows.limit(0)


def read_json_items(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(path, pos, item): the elements of a JSON array, or of the array under ``key``, as JSON text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    items = F.try_variant_get("v", f"$.{key}" if key else "$", "array<variant>")
    return rows.select("path", F.posexplode(items).alias("pos", "item")).select("path", "pos", F.to_json("item").alias("item"))


def read_jsonl(spark: SparkSession, path: str, schema: str, need: tuple[str, ...] = ()) -> DataFrame:
    """Records of JSON lines; malformed lines, and those that lack a ``need``, are passed over."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").where("_corrupt_record is null")
    for c in need:
        rows = rows.where(F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0)
    return rows.drop("_corrupt_record")


def read_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = read_jsonl(spark, path, "original string, compressed string, src_path string, chunk_id bigint", ("original", "compressed"))
    return rows if limit is None else rows.limit(limit)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(tag, text): sampled chunks, tagged corpus:src_path."""
    rows = read_jsonl(spark, path, "corpus string, src_path string, chunk_id bigint, text string", ("text",))
    return rows.select(F.concat_ws(":", "corpus", "src_path").alias("tag"), "chunk_id", "text")


TRIPLE = "doc_id string, text string, question string, answer string, fact_type string, source string"


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Answer triples from a bare list, or from the list under ``triples``."""
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.triples", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return rows.select(F.explode(F.transform(items, lambda x: F.from_json(F.to_json(x), TRIPLE))).alias("t")).select("t.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(method, ratio_key, ord, doc_id, fact_type, judge, exact, judge_error) of a results file.

    Keys are method@ratio, parted at the last @; fields that are absent take defaults.
    """
    item = "array<struct<doc_id:string,fact_type:string,judge:boolean,exact:boolean,judge_error:boolean>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"per_item map<string,{item}>").alias("r"))
    rows = rows.select(F.explode("r.per_item").alias("key", "items")).select("key", F.posexplode("items").alias("ord", "x"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c.split(".")[1])
    parted = F.col("key").rlike("^.+@[^@]*$")  # else the key is the method
    method, ratio = F.when(parted, F.regexp_extract("key", "^(.+)@[^@]*$", 1)).otherwise(F.col("key")), F.when(parted, F.regexp_extract("key", "@([^@]*)$", 1)).otherwise("")
    return rows.select(method.alias("method"), ratio.alias("ratio_key"), "ord", "x.doc_id", F.coalesce("x.fact_type", F.lit("?")).alias("fact_type"), no("x.judge"), no("x.exact"), no("x.judge_error"))


def read_systems(spark: SparkSession, root: str) -> DataFrame:
    """(system, line_no, line) of ``<system>.log`` files; bad bytes replaced."""
    rows = spark.read.text(f"{root}/*.log", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.log$", 1).alias("system"), F.make_valid_utf8("value").alias("text"))
    return rows.select("system", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def bounded(line: Column, most: int = MAX_LINE_BYTES) -> Column:
    """The line; one over ``most`` bytes raises when it is read."""
    return F.when(F.octet_length(line) <= most, line).when(line.isNotNull(), F.raise_error(F.lit(f"incoming line exceeds {most} bytes")))


def read_lines(spark: SparkSession, path: str, stream: bool = False, most: int = MAX_LINE_BYTES) -> DataFrame:
    """(line): non-blank lines of at most ``most`` bytes, from files or, as they arrive, from a folder."""
    rows = (spark.readStream if stream else spark.read).text(path).select(bounded(F.col("value"), most).alias("value"))
    return rows.select(F.col("value").alias("line")).where(F.trim("line") != "")


def resolve(spark: SparkSession, entry: dict, root: str, manifest_dir: str) -> list[str]:
    """The paths that a manifest entry names, tried as given, then under root, manifest and by base name.

    Globbing goes through the Hadoop file system, so any store that Spark reads will do.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = entry.get("staged_path") or entry.get("source_glob") or ""
    base = name.rsplit("/", 1)[-1]
    for candidate in (name, f"{root}/{name}", f"{manifest_dir}/{name}", f"{manifest_dir}/{base}"):
        if not candidate:
            continue
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        found = path.getFileSystem(conf).globStatus(path)
        if found:
            return sorted(str(f.getPath()) for f in found)
    return []


def must_survive(spark: SparkSession, root: str, texts: DataFrame, glob: str = "*needles*.txt") -> DataFrame:
    """(folder, needle): the strings of side files; a folder without one gives its first 50
    lines with a grave word, over 8 characters."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    side = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root).select(folder("_metadata.file_path").alias("folder"), F.trim("value").alias("needle")).where("needle <> ''")
    lines = texts.select(folder(F.col("path")).alias("folder"), "path", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("folder", "path", "n", F.trim("line").alias("needle"))
    odd = lines.where(F.col("needle").rlike("(?i)error|fatal|exception|critical") & (F.length("needle") > 8)).join(side.select("folder").distinct(), "folder", "left_anti")
    rank = F.row_number().over(W.partitionBy("folder").orderBy("path", "n"))
    return side.unionByName(odd.withColumn("_r", rank).where("_r <= 50").select("folder", "needle"))


def byte_chunks(docs: DataFrame, most: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, chunk): whole lines packed to ``most`` bytes; a longer line is cut.

    Packing starts anew with each chunk, so it is a loop over the lines' sizes. A line over
    ``most`` bytes is cut between characters, to pieces of ``most // 4`` characters, which
    fit whatever the characters are.
    """
    lines = F.filter(F.split(F.col(text_col), "(?<=\n)", -1), lambda x: x != "")
    size = max(1, most // 4)
    pieces = F.flatten(F.transform(lines, lambda x: F.when(F.octet_length(x) <= most, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.length(x), F.lit(size)), lambda i: F.substring(x, i, F.lit(size))))))
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), pieces.alias("p"))

    def each(lists: pa.Array) -> pa.Array:
        out = []
        for sizes in lists.to_pylist():
            held, q, numbers = 0, 0, []
            for n in sizes or ():
                if held and held + n > most:
                    held, q = 0, q + 1
                held += n
                numbers.append(q)
            out.append(numbers)
        return pa.array(out, pa.list_(pa.int32()))

    numbers = F.arrow_udf(each, "array<int>").asNondeterministic()(F.transform("p", F.octet_length))
    rows = rows.select("doc_id", "p", numbers.alias("q"))
    unit = rows.select("doc_id", F.posexplode(F.arrays_zip("p", "q")).alias("pos", "x")).select("doc_id", "pos", F.col("x.p").alias("p"), F.col("x.q").alias("chunk_id"))
    return unit.groupBy("doc_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x.p), "").alias("chunk"))


def capped(files: DataFrame, per_file: int = PER_FILE_BYTES, total: int = TOTAL_BYTES) -> DataFrame:
    """(path, line_no, line): the whole lines within the first ``per_file`` bytes of each file and
    ``total`` bytes of all, files by path. A report's bound, as the benchmark defines it."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("_n", F.octet_length("line") + 1)
    own = F.sum("_n").over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("_own", own).where(F.col("_own") <= per_file)
    sizes = lines.groupBy("path").agg(F.max("_own").alias("_size"))
    placed = numbered(sizes, [F.col("path")], "_place", "_size", "_upto")
    return lines.join(placed.select("path", (F.col("_upto") - F.col("_size")).alias("_before")), "path").where(F.col("_before") + F.col("_own") <= total).select("path", "line_no", "line")


def read_shards(spark: SparkSession, path: str, seed: int | None = None, worker: int = 0, workers: int = 1) -> DataFrame:
    """Labelled rows whose arrays align, of every ``workers``-th file from ``worker`` on; with ``seed``
    files, and rows, come in an order that the seed decides."""
    schema = "input_ids array<int>, tags array<int>, w_semantic array<double>, w_dependency array<double>, is_code boolean, src_path string"
    files = sorted(spark.read.schema(schema).json(path).inputFiles())
    if seed is not None:
        random.Random(seed).shuffle(files)
    own = files[worker::workers]
    rows = spark.read.schema(schema).json(own) if own else spark.createDataFrame([], schema)
    rows = rows.where("size(input_ids) = size(tags) and size(tags) = size(w_semantic) and size(tags) = size(w_dependency)")
    rows = rows.withColumn("is_code", F.coalesce("is_code", F.lit(False)))
    return rows if seed is None else rows.orderBy(F.xxhash64(F.lit(seed), "src_path", "input_ids"))


def token_windows(ids: DataFrame, most: int = 512, stride: int | None = None, column: str = "input_ids") -> DataFrame:
    """Adds start and window: slices of ``most`` tokens each ``stride``; the last ends the array."""
    stride = stride or most
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(column) - 1, F.lit(0)), F.lit(stride)), lambda i: (i == 0) | (i - stride + most < F.size(column)))
    return ids.withColumn("start", F.explode(starts)).withColumn("window", F.slice(column, F.col("start") + 1, F.lit(most)))
