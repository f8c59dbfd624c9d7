"""Four small documents whose best fact is known, for tests and the self-test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts

# The documents' lines, and the answers that are asked of them.
_HEARTBEAT = "2023-11-20T08:40:5{}.000 INFO [ServiceA] heartbeat ok request_id=10{:02} client_ip=10.0.0.{}"
_CRASH = "2023-11-20T08:41:02.111 FATAL [ServiceB] Crash request_id=99042 client_ip=192.168.1.185 time_taken=72ms"
_TRACE = 'Traceback (most recent call last): File "app.py", line 42, in run\n  File "db.py", line 10, in connect\nConnectionResetError: connection reset by peer'
_TICKET = "29/2/2016 0{}:23 incident=INC000004{} state=New priority=3 category=Category 55"
_CALL = "GET /v1/items 200 ok latency=12ms id=req{}"
_FAILED = "POST /v1/checkout HTTP status=503 service unavailable id=reqX9 retries=3"


def documents() -> list[tuple[str, str]]:
    """(source, text) of each."""
    beats = [_HEARTBEAT.format(i % 10, i, i % 5) for i in range(30)]
    return [
        ("distsys", "\n".join([*beats, _CRASH])), ("traceback", _TRACE),
        ("servicenow", "\n".join(_TICKET.format(i, i) for i in range(5))), ("api", "\n".join([*(_CALL.format(i) for i in range(20)), _FAILED])),
    ]


def curated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(documents(), "source string, text string").coalesce(1)


def curated_triples(spark: SparkSession) -> DataFrame:
    """(doc_id, source, question, answer, fact_type): the best fact of each document."""
    rows = curated(spark)
    found = rows.select(F.concat("source", F.lit("#0")).alias("doc_id"), "source", F.explode(facts.best(F.col("text"), facts.candidates(F.col("text")))).alias("b"))
    return found.select("doc_id", "source", "b.question", "b.answer", "b.fact_type")
