"""Time-series store sink: points as text lines, written in batches by the executors.

The store is reached through a client that `connect()` makes on the executor: any object with write(lines), which raises
if the store refuses them, and close().
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a batch that keeps a request under the store's limit; rows of a chunk that is written at once.
BATCH, CHUNK = 500, 10_000


def line(measurement: str, tags: list[str], fields: list[str], time: str) -> Column:
    """A point: measurement,tag=... field=... nanoseconds. Null tags and fields are left out; commas, blanks and equals
    signs in tags are escaped; whole numbers get the suffix i; times without zone are UTC."""
    escape = lambda c: F.regexp_replace(c.cast("string"), "([,= ])", r"\\$1")
    head = F.concat_ws(",", F.lit(measurement), *[F.concat(F.lit(f"{t}="), escape(F.col(t))) for t in tags])
    body = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string"), F.when(F.typeof(F.col(f)).isin("bigint", "int"), "i").otherwise("")) for f in fields])
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(time).cast("timestamp_ntz"))
    at = F.unix_micros(local.cast("timestamp")) * F.lit(1000)
    return F.concat_ws(" ", head, body, at.cast("string"))


def write_points(lines: DataFrame, connect: Callable, column: str = "line", batch: int = BATCH, retries: int = 3, wait: float = 1.0, parallel: int = 1) -> tuple[int, int, int]:
    """Write the lines through clients, one for each task; returns points, batches and repeated tries.

    A batch that fails is tried again after wait, 2 * wait ... seconds, then the task fails, and Spark starts it anew:
    points are written at least once, which the store takes as the same points. parallel > 1: so many batches are on
    their way at a time; else each is waited for before the next.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, points, sent, again = connect(), 0, 0, 0

        def put(part: list[str]) -> int:
            for i in range(retries + 1):
                try:
                    client.write(part)
                    return i
                except Exception:  # whatever the client's library raises
                    if i == retries:
                        raise
                    clock.sleep(wait * 2**i)
            return 0

        def parts() -> Iterator[list[str]]:
            held: list[str] = []
            for pdf in batches:
                held += pdf[column].dropna().tolist()
                while len(held) >= batch:
                    yield held[:batch]
                    held = held[batch:]
            if held:
                yield held

        try:
            with ThreadPoolExecutor(max(1, parallel)) as pool:
                waiting: list = []
                for p in parts():
                    points, sent = points + len(p), sent + 1
                    waiting.append(pool.submit(put, p))
                    if len(waiting) >= max(1, parallel):
                        again += waiting.pop(0).result()
                again += sum(f.result() for f in waiting)
        finally:
            client.close()
        yield pd.DataFrame({"points": [points], "batches": [sent], "again": [again]})

    done = lines.select(column).mapInPandas(rows, "points long, batches long, again long")
    r = done.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("points", "batches", "again")]).first()
    return r["points"], r["batches"], r["again"]
