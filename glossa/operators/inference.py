"""Batch inference over a pluggable adapter: memoised by context, batched by free memory, retried, bisected on failure."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Adapter = Callable[[list[str]], list[str]]
ADAPTERS: dict[str, Adapter] = {}
MIB = 1 << 20


class PolicyError(Exception):
    """An adapter broke a rule; trying again would break it again."""


def adapter(name: str):
    """Registers a function from a batch of inputs to as many outputs."""

    def keep(run: Adapter) -> Adapter:
        ADAPTERS[name] = run
        return run

    return keep


def batch_size(available: int, most: int) -> int:
    """Rows in a batch by the bytes of memory that are free: few when it is short."""
    return min(most, 8 if available < 600 * MIB else 24 if available < 1000 * MIB else most)


def free_memory() -> int:
    return os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")


def attempt(run: Adapter, inputs: list[str], tries: int = 3, pause: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str], int]:
    """The outputs, and how often the adapter was asked: again after pauses that double, but not after a PolicyError."""
    for n in range(1, tries + 1):
        try:
            out = run(inputs)
            if len(out) != len(inputs):
                raise ValueError("the adapter returned another number of rows")
            return out, n
        except PolicyError:
            raise
        except Exception:  # noqa: BLE001  whatever an adapter raises
            if n == tries:
                raise
            sleep(pause * 2 ** (n - 1))
    raise ValueError("no tries")


def bisect(run: Adapter, inputs: list[str], **how) -> list[tuple[str | None, str | None, int]]:
    """(output, error, tries) of each input; a batch that fails is halved until the inputs at fault stand alone."""
    if not inputs:
        return []
    try:
        out, n = attempt(run, inputs, **how)
        return [(o, None, n) for o in out]
    except Exception as error:  # noqa: BLE001  whatever an adapter raises is reported with its row
        if len(inputs) == 1 or isinstance(error, PolicyError):
            return [(None, f"{type(error).__name__}: {error}", how.get("tries", 3) if not isinstance(error, PolicyError) else 1)] * len(inputs)
        half = len(inputs) // 2
        return bisect(run, inputs[:half], **how) + bisect(run, inputs[half:], **how)


def infer(df: DataFrame, key: str, text: str, run: Adapter, batch: int = 64, tries: int = 3, pause: float = 0.25, memory: Callable[[], int] = free_memory,
          concurrency: int | None = None) -> DataFrame:
    """Df with output, error, tries and reused. Equal texts are run once and joined back; every further row of a
    text is marked as reused. concurrency: T16, how many tasks may ask the adapter at a time."""
    if concurrency is not None and concurrency < 1:
        raise ValueError("at least one task must ask the adapter")

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            lo = 0
            while lo < len(pdf):
                chunk = pdf.iloc[lo : lo + batch_size(memory(), batch)]
                lo += len(chunk)
                found = bisect(run, chunk[text].tolist(), tries=tries, pause=pause)
                yield pd.DataFrame({text: chunk[text].to_numpy(), "output": [f[0] for f in found], "error": [f[1] for f in found], "tries": [f[2] for f in found]})

    kind = df.schema[text].dataType.simpleString()
    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    once = (texts if concurrency is None else texts.repartition(concurrency, text)).mapInPandas(apply, f"{text} {kind}, output string, error string, tries int")
    first = df.groupBy(text).agg(F.min(key).alias("__first"))
    return df.join(once, text, "left").join(first, text, "left").withColumn("reused", F.col(key) != F.col("__first")).drop("__first")


def observed(results: DataFrame, name: str = "inference") -> tuple[DataFrame, Observation]:
    """Results, and an observer that, once they are computed, knows their number, failures, reuses and most tries; it changes nothing."""
    seen = Observation(name)
    return results.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("reused").alias("reused"), F.max("tries").alias("most_tries")), seen


def rounds(step: Callable[[int], DataFrame], key: str, wanted: int, most: int = 6) -> DataFrame:
    """Results of step(0), step(1), ... by distinct key, until there are enough, or, after two rounds, nothing new."""
    from glossa.session import cut

    found, n = None, 0
    for k in range(most):
        fresh = step(k) if found is None else step(k).join(found, key, "left_anti")
        found = cut(fresh.dropDuplicates([key]) if found is None else found.unionByName(fresh.dropDuplicates([key])))
        now = found.count()
        if now >= wanted or (k >= 1 and now == n):
            break
        n = now
    return found
