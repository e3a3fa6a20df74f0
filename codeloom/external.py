"""Models and sandboxes outside the engine: their answers are columns of a table, or come from an injected client.

Nothing here trains or runs a model; without a client the answers are joined from a table.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrying(call: Callable, tries: int = 3, wait: float = 0.5, default=None) -> Callable:
    """``call`` tried again with growing waits; the default, or what it makes of the error, after the last failure."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except Exception as e:  # a client may raise anything
                if i + 1 < tries:
                    time.sleep(wait * 2**i)
                elif callable(default):
                    return default(e)
        return default

    return run


def ask(df: DataFrame, client: Callable[[], Callable[[list], list]], question: str, schema: str, batch: int = 64) -> DataFrame:
    """``df`` with the columns of ``schema`` from a client made once a task and asked in batches.

    The client takes a list of questions and gives a list of tuples; a batch that fails after its retries gives nulls and
    the reason in ``failure``.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retrying(client(), default=lambda e: e)
        for rows in batches:
            out: list = []
            reasons: list = []
            for i in range(0, len(rows), batch):
                part = rows[question].iloc[i : i + batch].tolist()
                got = call([None if isinstance(x, float) and x != x else x for x in part])
                why = f"{type(got).__name__}: {got}" if isinstance(got, Exception) else None if got is not None and len(got) == len(part) else "wrong number of answers"
                out += list(got) if why is None else [(None,) * len(names)] * len(part)
                reasons += [why] * len(part)
            yield rows.assign(**{n: pd.Series([x[j] for x in out], index=rows.index, dtype=object) for j, n in enumerate(names)}, failure=pd.Series(reasons, index=rows.index, dtype=object))

    return df.mapInPandas(run, f"{own}, {schema}, failure string")


def endpoints(clients: list[Callable], tries: int = 3, wait: float = 0.5) -> Callable:
    """One call over several endpoints in turn; a failed one gives way to the next, ``tries`` times around."""
    turn = itertools.count()

    def run(*args):
        last: Exception | None = None
        for i in range(tries * len(clients)):
            try:
                return clients[next(turn) % len(clients)](*args)
            except Exception as e:
                last = e
                if (i + 1) % len(clients) == 0:
                    time.sleep(wait * 2 ** (i // len(clients)))
        raise last if last else ValueError("no endpoint")

    return run


def answers(df: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Answers that were worked out before, joined by key; rows without an answer keep nulls."""
    once = table.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])
    return df.join(once, key, "left")


def sanitised(df: DataFrame, original: str, attempts: list[str], valid: Callable) -> DataFrame:
    """The first attempt that is valid, else the original; ``fell_back`` says which."""
    chosen = F.coalesce(*[F.when(valid(F.col(a)), F.col(a)) for a in attempts])
    return df.withColumn("fell_back", chosen.isNull()).withColumn("sanitised", F.coalesce(chosen, F.col(original)))


#: Builders of tasks by (task, model); a registry in place of classes.
REGISTRY: dict[tuple[str, str], Callable] = {}


def register(task: str, model: str) -> Callable:
    def add(f: Callable) -> Callable:
        REGISTRY[task, model] = f
        return f

    return add


def load(task: str, model: str) -> Callable:
    if (task, model) not in REGISTRY:
        raise KeyError(f"no model {model} for {task}; known: {sorted(REGISTRY)}")
    return REGISTRY[task, model]
