"""The boundary to an external clustering service: a table of requests out, a table of responses in.

``Clusterer`` is any function from requests (request_id, name, prompt) to responses (request_id, content,
finish_reason, error). A local deterministic one is given; a remote client is a function of one prompt that the caller
supplies and that runs inside ``remote``, under a deadline.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Clusterer = Callable[[DataFrame], DataFrame]
RESPONSES = "request_id long, content string, finish_reason string, error string"


def with_deadline(seconds: float, function: Callable, *args):
    """The result of the call, or TimeoutError once the time is over."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(function, *args).result(timeout=seconds)
    except Late:
        raise TimeoutError(f"no answer within {seconds} seconds") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def remote(requests: DataFrame, call: Callable[[str], str], seconds: float = 300.0) -> DataFrame:
    """Responses of a client called once per prompt; an exception or a late answer becomes the row's error."""
    def run(batches):
        for b in batches:
            ids, content, finish, error = [], [], [], []
            for r in b.to_pylist():
                ids.append(r["request_id"])
                try:
                    content.append(with_deadline(seconds, call, r["prompt"]))
                    finish.append("stop")
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    content.append(None)
                    finish.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.string()), pa.array(finish, pa.string()), pa.array(error, pa.string())], names=["request_id", "content", "finish_reason", "error"])

    return requests.select("request_id", "prompt").mapInArrow(run, RESPONSES)


def by_organization(cards: DataFrame) -> DataFrame:
    """(name, cluster_index, label, pos, paper_id): a local clusterer that groups the papers of a block by organization."""
    from blockwise.operators.selection import organization_groups
    from blockwise.operators.similarity import numbered

    g = organization_groups(numbered(cards))
    return g.select("name", (F.col("group_no") - 1).alias("cluster_index"), F.col("org_key").alias("label"), F.col("i").alias("pos"), "paper_id")
