"""Answer providers: a function from prompts to answers, run in batches on the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "graph_id bigint, content string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, time double"


def answers(prompts: DataFrame, provider: Callable[[list[str]], list[str]], keys: tuple[str, ...] = (), tokens: Callable[[str], int] = lambda text: len(text.split())) -> DataFrame:
    """Answers to (keys, graph_id, prompt), null where the provider has none. ``tokens`` counts those of a text: words, or a tokenizer's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            began = time.time()
            said = provider(frame["prompt"].tolist())
            asked = pd.Series([tokens(x or "") for x in frame["prompt"]], dtype="int64")
            used = pd.Series([tokens(x or "") for x in said], dtype="int64")
            yield pd.DataFrame({k: frame[k].values for k in keys} | {"graph_id": frame["graph_id"].values, "content": said, "prompt_tokens": asked.values, "completion_tokens": used.values, "total_tokens": asked.values + used.values, "time": (time.time() - began) / max(len(frame), 1)})

    kinds = "".join(f"{k} {prompts.schema[k].dataType.simpleString()}, " for k in keys)
    return prompts.select(*keys, "graph_id", "prompt").mapInPandas(run, kinds + SCHEMA)


def from_table(prompts: DataFrame, table: DataFrame, words_a_second: float | None = None) -> DataFrame:
    """Answers looked up in a table (graph_id, content), at once or at a rate of words read and said."""
    words = lambda c: F.size(F.split(F.trim(c), r"\s+")).cast("bigint")
    df = prompts.join(table.select("graph_id", "content"), "graph_id")
    asked, used = words(F.col("prompt")), words(F.col("content"))
    return df.select("graph_id", "content", asked.alias("prompt_tokens"), used.alias("completion_tokens"), (asked + used).alias("total_tokens"), ((asked + used) / F.lit(words_a_second) if words_a_second else F.lit(0.0)).alias("time"))


def constant(text: str) -> Callable[[list[str]], list[str]]:
    """An offline provider."""
    return lambda prompts: [text] * len(prompts)
