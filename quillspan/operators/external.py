"""Calls to external models as a table operation: injected, bounded, and written before use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: The first budget of answer tokens and the largest one of a repeated call.
FIRST_TOKENS, MOST_TOKENS = 1024, 4096
OUTCOME = "response string, status string, attempts int, max_tokens int"
RESULT = f"key string, {OUTCOME}"

Completion = Callable[[dict], str | None]


def offline_completion(request: dict) -> str:
    """A deterministic stand-in: supports a requirement if a passage holds its longest word."""
    words = sorted(request.get("requirement", "").lower().split(), key=lambda w: (-len(w), w))
    hit = next((p for p in request.get("passages", []) if words and words[0] in p["content"].lower()), None)
    return json.dumps({"basis": "STATED", "evidence_id": hit["id"], "quote": words[0]} if hit else {"basis": "INSUFFICIENT"})


@lru_cache(4096)
def is_object(response: str) -> bool:
    """Whether a response is a JSON object; equal ones are read once. Raises ValueError for what isn't JSON."""
    return isinstance(json.loads(response), dict)


def answer(completion: Completion, request: dict, retries: int) -> tuple[str | None, str, int, int]:
    """The OUTCOME of one call, with its repetitions."""
    tokens, attempt = FIRST_TOKENS, 0
    while True:
        attempt += 1
        try:
            response = completion({**request, "max_tokens": tokens, "temperature": 0, "seed": 42})
            if is_object(response or ""):
                return response, "OK", attempt, tokens
        except Exception:  # noqa: BLE001 an external call may fail in any way; the row keeps the outcome
            response = None
        if attempt > retries:
            return None, "ERROR", attempt, tokens
        tokens = min(MOST_TOKENS, 2 * tokens)


def call_rows(rows: DataFrame, requests_of: Callable[[dict], list[dict]], completion: Completion = offline_completion, retries: int = 2) -> DataFrame:
    """``rows`` with outcomes, an array of OUTCOME structs: a call for each request that ``requests_of`` makes of a row's column request (JSON), still to be written.

    A call that fails or gives no JSON object is repeated with twice the answer budget,
    at most ``retries`` times and MOST_TOKENS; then its outcome has the status ERROR.
    Rows are called where they lie, and what else a row has goes past the calls, so
    nothing need be joined to the answers.
    """
    own = [c for c in rows.columns if c != "request"]
    kinds = {"response": pa.string(), "status": pa.string(), "attempts": pa.int32(), "max_tokens": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, ends = [], [0]
            for request in batch.column("request").to_pylist():
                done += [answer(completion, r, retries) for r in requests_of(json.loads(request))]
                ends.append(len(done))
            columns = zip(*done, strict=True) if done else [()] * len(kinds)
            made = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], names=[*own, "outcomes"])

    asked = rows.select(*own, "request")
    return asked.mapInArrow(run, StructType([*asked.schema.fields[:-1], StructField("outcomes", ArrayType(StructType.fromDDL(OUTCOME)))]))


def calls(requests: DataFrame, completion: Completion = offline_completion, retries: int = 2) -> DataFrame:
    """One call per distinct request (columns key, request as JSON), as ``call_rows`` makes it: a row of RESULT each, still to be written.

    Equal keys are called once. The rows are dealt out evenly, as calls cost far more than rows.
    """
    once = requests.groupBy("key").agg(F.min("request").alias("request"))
    called = call_rows(once.repartition(requests.sparkSession.sparkContext.defaultParallelism), lambda r: [r], completion, retries)
    return called.select("key", F.inline("outcomes"))


def call_all(requests: DataFrame, path: str, completion: Completion = offline_completion, retries: int = 2) -> DataFrame:
    """``calls``, written to ``path`` and read back."""
    calls(requests, completion, retries).write.mode("errorifexists").parquet(path)
    return requests.sparkSession.read.schema(RESULT).parquet(path)
