"""URL filters: fixed rules first, else logistic regression on hashed character n-grams of host and path.

The model is trained in numpy on a small labelled URL table, a DataFrame (url, label: 1 for block). Its rows are at most
``MAX_LABELLED`` (more raise an error), so training is bounded and the weights have a fixed size (2 ** ``BITS`` floats),
shipped with the task. The query's table is ``url_labels``; rows without a url or label are left out, and without any rows
each URL scores 0.5 and is blocked at the default threshold. Scoring is one pass without a shuffle; a host seen before is scored from a cache in the worker.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or
the end. A rule (host, path, verdict) fits its host and all subdomains when the path starts with the rule's; the longest
rule wins (host and path together; ties by the rule's text, which can't be ties in fact).

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged by the model's bias like any
other; very long URLs are read whole; repeated rows are judged one by one; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.llm.common import ship

BITS = 16
MAX_LABELLED = 100_000

_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def host_path(url: str | None) -> tuple[str, str]:
    m = _SPLIT.search(url or "")
    if not m:
        return "", ""
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def features(host: str, path: str, least: int = 3, most: int = 5) -> np.ndarray:
    """Hashed n-gram slots; host and path differ by a mark."""
    out = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(least, most + 1):
            out.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for i in range(len(text) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def train(rows: list[tuple[str, int]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) by AdaGrad on the logistic loss; rows are scaled to unit length."""
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"{len(rows)} labelled rows; at most {MAX_LABELLED} are trained on")
    slots = [features(*host_path(u)) for u, _ in rows]
    w, g, bias, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            s = slots[i]
            scale = 1 / np.sqrt(max(len(s), 1))
            err = 1 / (1 + np.exp(-(w[s].sum() * scale + bias))) - rows[i][1]
            d = err * scale + decay * w[s]
            g[s] += d * d
            w[s] -= rate * d / np.sqrt(g[s])
            gb += err * err
            bias -= rate * err / np.sqrt(gb)
    return w.astype(np.float32), float(bias)


def score(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    s = features(host, path)
    return float(1 / (1 + np.exp(-(model[0][s].sum(dtype=np.float64) / np.sqrt(max(len(s), 1)) + model[1]))))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The text of the longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule_host, rule_path, _ in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(rule_host + rule_path)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, id_col: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, score, verdict); the score is null where a rule decides."""
    spark = pages.sparkSession
    ship(spark)
    known = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int")).limit(MAX_LABELLED + 1).collect()
    shared = spark.sparkContext.broadcast(train(sorted((r[0], r[1]) for r in known)))
    raw = F.col(url)
    found = F.coalesce(raw, F.lit("")).contains("://")
    after = F.when(found, F.substring_index(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"), "#", 1)).otherwise(F.lit(""))
    main = F.substring_index(after, "?", 1)
    host_raw = F.substring_index(main, "/", 1)
    host = F.translate(host_raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = pages.select(F.col(id_col), host.alias("host"), main.substr(F.length(host_raw) + 1, F.length(main)).alias("path"))
    df = df.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        for batch in batches:
            out = []
            for host, path, rule in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if rule is not None:
                    out.append(None)
                    continue
                if (host, path) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[host, path] = score(host, path, model)
                out.append(seen[host, path])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["id", "host", "path", "rule", "score"])

    id_type = pages.schema[id_col].dataType.simpleString()
    out = df.mapInArrow(judge, f"id {id_type}, host string, path string, rule string, score double").withColumnRenamed("id", id_col)
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule_host, rule_path, says in rules:
        verdict = F.when(F.col("rule") == rule_host + rule_path, says).otherwise(verdict)
    return out.withColumn("verdict", verdict)
