"""User hooks: encoders, generators and reward models are plain callables over Arrow batches.

``make`` runs once in each task and returns the callable, so a model is loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], text="text", name="embedding") -> DataFrame:
    """Adds ``name``: the vector of each text; null texts are passed as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return df.withColumn(name, run(F.col(text)))


def generate(df: DataFrame, make: Callable[[], Callable[[str], list[str]]], key="prompt_id", prompt="prompt") -> DataFrame:
    """(key, attempt, text): any number of outputs for each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = make()
        for b in batches:
            rows = [(k, i, t) for k, p in zip(b[key], b[prompt], strict=True) for i, t in enumerate(write(p))]
            yield pd.DataFrame(rows, columns=[key, "attempt", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, attempt int, text string")


def score(df: DataFrame, make: Callable[[], Callable[[str, str], tuple[float, float]]], question="question", response="response") -> DataFrame:
    """Adds reward and ppl of each (question, response)."""

    @F.pandas_udf("reward double, ppl double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = make()
        for q, r in batches:
            yield pd.DataFrame([judge(a, b) for a, b in zip(q, r, strict=True)], columns=["reward", "ppl"])

    return df.withColumn("__s", run(F.col(question), F.col(response))).select("*", "__s.reward", "__s.ppl").drop("__s")
