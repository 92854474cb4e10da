"""Surface for external models: detectors, recognisers and matchers run as functions over batches; their results are tables like any other.

A model is loaded once a worker by ``load()``, which gives a function from a pandas batch to a list of rows. No model ships with the engine.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, Callable] = {}


def with_retries(call: Callable, attempts: int = 3, most_wait: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to ``attempts`` times with growing waits; the last error becomes the result (None, its text)."""
    def tried(*args):
        error = ""
        for k in range(attempts):
            try:
                return call(*args), None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    sleep(min(most_wait, 2.0**k))
        return None, error

    return tried


def run_model(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list]], schema: str, name: str = "model") -> DataFrame:
    """Rows that a model makes of batches; it is loaded on first use in each worker and kept under ``name``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = _loaded.get(name) or _loaded.setdefault(name, load())
        for b in batches:
            made = predict(b)
            if made:
                yield pd.DataFrame(made, columns=names)

    return rows.mapInPandas(run, schema)


def recognise(crops: DataFrame, load: Callable[[], Callable[[bytes], tuple[str, float]]], cached: DataFrame | None = None, name: str = "recogniser") -> DataFrame:
    """Readings of crops (map_num, parcel_id, data) by a recogniser of one crop, with retries; crops with a cached record are left out.

    Gives cache records: map_num, parcel_id, number, raw, error.
    """
    from ..functions.text import first_number

    todo = crops.join(cached.select("map_num", "parcel_id"), ["map_num", "parcel_id"], "left_anti") if cached is not None else crops

    def prepared():
        read = with_retries(load())

        def predict(b: pd.DataFrame) -> list:
            rows = []
            for m, p, data in zip(b["map_num"], b["parcel_id"], b["data"], strict=True):
                got, error = read(bytes(data)) if data is not None and len(data) else (("SKIP_CROP", 0.0), None)
                rows.append((m, int(p), None if got is None else got[0], None if got is None else float(got[1]), error))
            return rows

        return predict

    raw = run_model(todo.select("map_num", "parcel_id", "data"), prepared, "map_num string, parcel_id int, raw string, confidence double, error string", name)
    return raw.withColumn("number", F.when(F.col("raw") != "SKIP_CROP", first_number(F.col("raw"))))


def assignment_loss(scores: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Mean negative log probability of known matches (a, b) under a soft assignment (a, b, score), by keys."""
    met = matches.join(scores, [*keys, "a", "b"])
    return met.groupBy(*keys).agg(F.avg(-F.ln(F.greatest("score", F.lit(1e-9)))).alias("loss"), F.count("*").alias("n"))
