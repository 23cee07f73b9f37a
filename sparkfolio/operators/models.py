"""Models behind names: recognisers, solvers and classifiers are functions over pandas batches, stubs until one is registered.

A stub returns what is stored beside the request, so that pipelines run the same way with and without a model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], pd.Series]
REGISTRY: dict[str, Model] = {}


def register(name: str, model: Model) -> None:
    REGISTRY[name] = model


def stub(batch: pd.DataFrame) -> pd.Series:
    return batch["stored"].fillna("") if "stored" in batch else pd.Series([""] * len(batch), index=batch.index)


def attempted(model: Model, batch: pd.DataFrame, attempts: int, wait: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> pd.DataFrame:
    """reply and error of a batch, tried up to `attempts` times; a failure is a row with its message, never a lost row.

    Between attempts it waits, twice as long each time.
    """
    message = ""
    for n in range(attempts):
        if n and wait:
            sleep(wait * 2 ** (n - 1))
        try:
            return batch.assign(reply=model(batch).astype("string"), error=pd.Series([None] * len(batch), index=batch.index, dtype="string"))
        except Exception as error:  # noqa: BLE001  what a model raises is data here
            message = f"{type(error).__name__}: {error}"
    return batch.assign(reply=pd.Series([None] * len(batch), index=batch.index, dtype="string"), error=message)


def apply_model(requests: DataFrame, name: str, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """requests with `reply` and `error` of the model of that name. The model is loaded once a Python worker, batches stream through it."""
    model = REGISTRY.get(name, stub)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield attempted(model, batch, attempts, wait)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in requests.dtypes) + ", reply string, error string"
    return requests.mapInPandas(run, schema)
