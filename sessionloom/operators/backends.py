"""Calling a model backend from tasks: bounded concurrency, retries, and failures as rows.

A backend is a picklable function from a text to a reply; which one is used is decided by a list of names in the order of
preference. What it costs to wait for one reply is shared by all that are under way in the task.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[str], str]
SCHEMA = "session_id string, reply string, error string, attempts int, model string"
#: Replies of one batch that goes back.
ROWS = 256


def chosen(backends: dict[str, Backend | None], precedence: list[str], preferred: str | None = None) -> tuple[str, Backend]:
    """The backend to call: the preferred one if it is configured, else the first of ``precedence`` that is; an unconfigured one is None."""
    for name in [*([preferred] if preferred else []), *precedence]:
        if backends.get(name) is not None:
            return name, backends[name]
    raise LookupError("no backend is configured")


def _attempt(backend: Backend, text: str, attempts: int, pause: float) -> tuple[str | None, str | None, int]:
    for n in range(1, attempts + 1):
        try:
            return backend(text), None, n
        except Exception as e:  # one row's failure is that row's result
            error = f"{type(e).__name__}: {e}"[:500]
            if n < attempts:
                time.sleep(pause * 2 ** (n - 1))
    return None, error, attempts


def call_all(rows: DataFrame, backend: Backend, model: str, concurrency: int = 5, attempts: int = 3, pause: float = 0.1) -> DataFrame:
    """(session_id, reply, error, attempts, model) for each row (session_id, digest), in the order of completion.

    At most ``concurrency`` calls of a task are under way, and no more rows than these are held; the number of tasks at a time
    bounds the whole. A call that fails is repeated ``attempts`` - 1 times with doubled pauses; then its row has an error instead
    of a reply and the others go on. A null digest is an error without a call.
    """

    def run(batches):
        out = []

        def batch():
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["session_id", "reply", "error", "attempts", "model"])

        with ThreadPoolExecutor(concurrency) as pool:
            under_way = {}

            def collect(when):
                done, _ = wait(under_way, return_when=when)
                for future in done:
                    reply, error, n = future.result()
                    out.append((under_way.pop(future), reply, error, n, model))

            for b in batches:
                for ident, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if digest is None:
                        out.append((ident, None, "no digest", 0, model))
                        continue
                    if len(under_way) >= concurrency:
                        collect(FIRST_COMPLETED)
                    under_way[pool.submit(_attempt, backend, digest, attempts, pause)] = ident
                    if len(out) >= ROWS:
                        yield batch()
            while under_way:
                collect(FIRST_COMPLETED)
        if out:
            yield batch()

    return rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("digest").cast("string").alias("digest")).mapInArrow(run, SCHEMA)
