"""The subpackage's queries, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_licences, op6_mixing
from .common import documents
from .op2_simhash import near_duplicates
from .op3_quality import quality_scores
from .op4_language import languages
from .op5_sharding import shard
from .op7_token_files import token_files
from .op8_bpe import bpe_encode
from .op9_exact import exact_groups
from .op10_rules import quality_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": lambda s, d: op1_licences.scan_licences(documents(s, d)),
        "op2_simhash": lambda s, d: near_duplicates(documents(s, d)),
        "op3_quality": lambda s, d: quality_scores(documents(s, d), documents(s, d, "labels")),
        "op4_language": lambda s, d: languages(documents(s, d)),
        "op5_sharding": lambda s, d: shard(documents(s, d)),
        "op6_mixing": lambda s, d: op6_mixing.mix(documents(s, d)),
        "op7_token_files": lambda s, d: token_files(documents(s, d)),
        "op8_bpe": lambda s, d: bpe_encode(documents(s, d)),
        "op9_exact": lambda s, d: exact_groups(documents(s, d)).drop("row"),
        "op10_rules": lambda s, d: quality_rules(documents(s, d), documents(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": op1_licences.oracle_sql(), "op6_mixing": op6_mixing.ORACLE_SQL, "op9_exact": OP9_SQL}


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
