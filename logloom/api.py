"""The engine's calls, over tables: mask, compress, store, archive."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import spans as S
from .functions import text as T
from .operators import arrays, decode, labels, lines, store, timeline

# Bounds of inputs.
MAX_TEXT_BYTES, MAX_KEYWORDS, MAX_KEYWORD_BYTES, MAX_ARRAY_ITEMS, MAX_TOKENS = 1 << 20, 256, 4_096, 100_000, 262_144
MAX_LANGUAGE_BYTES, MAX_ID_BYTES, MAX_ROLE_BYTES, MAX_PATH_BYTES = 16, 256, 64, 4_096
MAX_SCORED_TOKENS = 65_536


class EngineError(ValueError):
    """An error with a code, details and a hint."""

    def __init__(self, error: str, details: str = "", hint: str = ""):
        super().__init__(f"{error}: {details}" if details else error)
        self.error, self.details, self.hint = error, details, hint

    def as_dict(self) -> dict:
        return {"error": self.error, "details": self.details, "hint": self.hint}


def check_inputs(language: str = "text", keywords: list[str] | None = None, rate: float = 0.5) -> None:
    """Raise for what a call may not be given."""
    if language.lower() not in (*labels.LOCKERS, *labels.PLAIN):
        raise EngineError("unsupported_language", language, "use one of " + ", ".join((*labels.LOCKERS, *labels.PLAIN)))
    keywords = keywords or []
    if len(keywords) > MAX_KEYWORDS:
        raise EngineError("too_many_keywords", str(len(keywords)), f"at most {MAX_KEYWORDS}")
    if any(not k or len(k.encode()) > MAX_KEYWORD_BYTES for k in keywords):
        raise EngineError("invalid_keyword", "", f"1 to {MAX_KEYWORD_BYTES} bytes each")
    if not 0.0 < rate < 1.0:
        raise EngineError("invalid_rate", str(rate), "between 0 and 1")


def model_file(path: str | None, variable: str | None = None) -> tuple[str, str | None]:
    """(status, path) of an optional scorer's file on the driver: unset, empty, missing or found.

    Without a path, the environment's ``variable`` may name one.
    """
    if path is None and variable is not None:
        path = os.environ.get(variable)
    if path is None:
        return "unset", None
    full = os.path.expanduser(path) if path else ""
    return ("empty", None) if not path else ("found" if os.path.exists(full) else "missing", full)


def input_errors(text: Column, most: int = MAX_TEXT_BYTES) -> Column:
    """A row's error code, or null: the guard of a table's texts."""
    return F.when(text.isNull(), "missing_text").when(F.octet_length(text) > most, "text_too_large").when(~F.is_valid_utf8(text), "invalid_utf8")


def _too_long(column: str, most: int) -> Column:
    return F.when(F.octet_length(column) > most, F.lit(f"{column} exceeds max length {most}"))


def _keyword_errors(column: str = "keywords") -> Column:
    long = F.filter(F.transform(column, lambda k, i: F.when(F.octet_length(k) > MAX_KEYWORD_BYTES, i)), lambda i: i.isNotNull())
    item = F.when(F.size(long) > 0, F.concat(F.lit(f"{column}["), F.get(long, F.lit(0)).cast("string"), F.lit(f"] exceeds max length {MAX_KEYWORD_BYTES}")))
    return F.coalesce(F.when(F.size(column) > MAX_KEYWORDS, F.lit(f"{column} exceeds max count {MAX_KEYWORDS}")), item)


def _array_errors() -> Column:
    over = lambda n, name: F.when(n > MAX_ARRAY_ITEMS, F.lit(f"{name} exceeds max items {MAX_ARRAY_ITEMS}"))
    head, tail = F.coalesce("head_keep", F.lit(0)), F.coalesce("tail_keep", F.lit(0))
    return F.coalesce(over(head, "head_keep"), over(tail, "tail_keep"), over(head.cast("bigint") + tail, "head_keep + tail_keep"), over(F.size("value"), "value array"))


def _log_errors() -> Column:
    text, path = F.col("text").isNotNull(), F.col("path").isNotNull()
    one = F.when(text & path, "provide exactly one of text or path, not both").when(~text & ~path, "provide one of text or path")
    rate = F.when(~((F.col("target_rate") > 0) & (F.col("target_rate") < 1)), "target_rate must be a finite number in (0,1)")
    known = F.lower("language").isin(*labels.LOCKERS, *labels.PLAIN)
    language = F.when(~known, F.concat(F.lit("unsupported language: "), F.col("language"), F.lit(" (use text|json|python)")))
    return F.coalesce(one, _too_long("text", MAX_TEXT_BYTES), _too_long("path", MAX_PATH_BYTES), _keyword_errors(), rate, language)


#: Call to the error of a row of its arguments, or null.
GUARDS = {
    "lock_mask": lambda: F.coalesce(_too_long("text", MAX_TEXT_BYTES), _too_long("language", MAX_LANGUAGE_BYTES), _keyword_errors()),
    "compress_log": _log_errors,
    "compress_array": _array_errors,
    "retrieve_cache": lambda: _too_long("cache_id", MAX_ID_BYTES),
    "lcm_append": lambda: F.coalesce(_too_long("conversation_id", MAX_ID_BYTES), _too_long("role", MAX_ROLE_BYTES), _too_long("content", MAX_TEXT_BYTES)),
    "lcm_node": lambda: _too_long("node_id", MAX_ID_BYTES),
}


def call_errors(call: str) -> Column:
    """The first bound that a row of a call's arguments breaks, in words, or null: columns go by the arguments' names."""
    return GUARDS[call]()


def _locks(docs: DataFrame, language: str, keywords: list[str]) -> DataFrame:
    found = decode.keyword_spans(docs, keywords)
    if language.lower() in labels.PLAIN:
        return found
    return found.unionByName(decode.array_spans(docs, labels.syntax_spans(F.col("text"), language)))


def lock_mask(docs: DataFrame, language: str = "text", keywords: list[str] | None = None) -> DataFrame:
    """Tokens of (doc_id, text) with ``locked``: those of keywords and of the language's syntax."""
    check_inputs(language, keywords)
    return decode.locked(docs, _locks(docs, language, keywords or []))


def compress_log(docs: DataFrame, language: str = "text", keywords: list[str] | None = None, target_rate: float = 0.5, scorer: Callable[[pa.Array], pa.Array] | None = None, span: str = "word", reduce: str = "max") -> DataFrame:
    """(doc_id, compressed, input_tokens, output_tokens, ratio, used_model, cache_id).

    Lines are deduplicated by template; with a ``scorer`` (Arrow: lists of tokens to lists of
    drop probabilities) spans are then dropped to the rate, locks kept; tokens past
    ``MAX_SCORED_TOKENS`` stay. Without one the text passes as deduplicated. cache_id is the
    original's content address; ``originals`` gives the store's rows.
    """
    check_inputs(language, keywords, target_rate)
    short = lines.reduced(docs).select("doc_id", F.col("reduced").alias("text"))
    if scorer is None:
        out = short.select("doc_id", F.col("text").alias("compressed"), F.lit(False).alias("used_model"))
    else:
        probs = F.arrow_udf(scorer, "array<double>")(T.word_tokens(F.col("text")))
        toks = decode.locked(short, _locks(short, language, keywords or []), values=probs)
        scored = toks.where(F.col("i") < MAX_SCORED_TOKENS).select("doc_id", "i", "token", F.col("value").alias("prob"), "locked")
        tail = toks.where(F.col("i") >= MAX_SCORED_TOKENS).select("doc_id", "i", "token", F.lit(False).alias("dropped"))
        done = decode.span_decode(scored, target_rate, span, reduce).select("doc_id", "i", "token", "dropped").unionByName(tail)
        made = decode.rebuilt(done).select("doc_id", "compressed")
        out = short.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("compressed", F.lit("")).alias("compressed"), F.lit(True).alias("used_model"))
    both = docs.select("doc_id", "text").join(out, "doc_id")
    n_in, n_out = T.token_count(F.col("text")), T.token_count(F.col("compressed"))
    return both.select("doc_id", "compressed", n_in.alias("input_tokens"), n_out.alias("output_tokens"), F.when(n_out == 0, F.lit(float("inf"))).otherwise(n_in / F.greatest(n_out, F.lit(1))).alias("ratio"), "used_model", arrays.content_id(F.to_json(F.struct("text"))).alias("cache_id"))


def originals(docs: DataFrame) -> DataFrame:
    """Store rows of whole originals, for ``store.stash``."""
    return store.entries(docs.select(F.to_json(F.struct("text")).alias("payload"), F.lit(1).alias("omitted_count")))


def compress_array(df: DataFrame, column: str, head_keep: int = 3, tail_keep: int = 3, cache: bool = True) -> DataFrame:
    return arrays.compress_json(df, column, head_keep, tail_keep, cache=cache)


def retrieve(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    return store.retrieve(store.read(spark, path), wanted)


def archive_turns(turns: DataFrame, soft_threshold: int | Column = timeline.THRESHOLD) -> DataFrame:
    return timeline.archived(turns, soft_threshold)


def describe_nodes(turns: DataFrame, wanted: DataFrame, soft_threshold: int = timeline.THRESHOLD) -> DataFrame:
    return wanted.select("node_id").join(timeline.nodes(archive_turns(turns, soft_threshold)), "node_id")


def expand_nodes(turns: DataFrame, wanted: DataFrame, soft_threshold: int = timeline.THRESHOLD) -> DataFrame:
    return timeline.expand(archive_turns(turns, soft_threshold), wanted)


# --- byte-level BPE tokens, where a tokenizer's rank file is at hand -----------------------


def bpe_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) by a rank file; every worker must reach ``ranks_path``."""

    def each(texts: pa.Array) -> pa.Array:
        enc = _encoding(ranks_path, pattern)
        return pa.array([len(enc.encode_ordinary(x or "")) for x in texts.to_pylist()], pa.int64())

    return docs.select("doc_id", F.arrow_udf(each, "bigint")("text").alias("n_tokens"))


def bpe_tokens(text: Column, ranks_path: str, pattern: str) -> Column:
    """array<struct<id, s, e>>: the tokens' ids and byte ranges, which tile the text."""

    def each(texts: pa.Array) -> pa.Array:
        enc, ids, ends, sizes = _encoding(ranks_path, pattern), [], [], [0]
        for x in texts.to_pylist():
            own = enc.encode_ordinary(x or "")
            ids += own
            ends.append(np.cumsum([len(t) for t in enc.decode_tokens_bytes(own)], dtype=np.int64))
            sizes.append(len(own))
        e = np.concatenate([np.empty(0, np.int64), *ends])
        s = np.concatenate([np.empty(0, np.int64), *[np.concatenate([[0], x[:-1]]) if len(x) else x for x in ends]])
        rows = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["id", "s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    return F.arrow_udf(each, "array<struct<id:int,s:int,e:int>>").asNondeterministic()(text)


def bpe_decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The text of an array of ids; bytes that are no UTF-8 become replacement characters."""

    def each(lists: pa.Array) -> pa.Array:
        enc = _encoding(ranks_path, pattern)
        return pa.array([None if x is None else enc.decode(x) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")(ids)


def bpe_lock_mask(docs: DataFrame, ranks_path: str, pattern: str, language: str = "text", keywords: list[str] | None = None) -> DataFrame:
    """``lock_mask`` on byte-level tokens: (doc_id, i, id, s, e, locked)."""
    check_inputs(language, keywords)
    toks = docs.select("doc_id", F.posexplode(bpe_tokens(F.col("text"), ranks_path, pattern)).alias("i", "t")).select("doc_id", "i", "t.*")
    return S.mark_overlaps(toks, _locks(docs, language, keywords or []), "locked")


_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]
