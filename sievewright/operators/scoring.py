"""Scores for batches of rows by a pluggable function; a row that fails gives an error row and does not stop the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import Check, require, where

Scorer = Callable[[list], "np.ndarray"]
OUTPUT = "image_path string, pred double, status string, error_type string, message string"


def score_rows(rows: DataFrame, path: str, payload: str, scorer: Scorer) -> DataFrame:
    """image_path, pred, status, error_type, message. scorer gives logits for a list of payloads; a batch that fails is scored row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            items = pdf[payload].tolist()
            try:
                logits = list(np.asarray(scorer(items), float))
                failed: list[Exception | None] = [None] * len(items)
            except Exception:  # noqa: BLE001  (found again row by row)
                logits, failed = [], []
                for item in items:
                    try:
                        logits.append(float(np.asarray(scorer([item]), float)[0]))
                        failed.append(None)
                    except Exception as e:  # noqa: BLE001
                        logits.append(float("nan"))
                        failed.append(e)
            for p, z, e in zip(pdf[path], logits, failed, strict=True):
                out.append((p, None if e else float(1 / (1 + np.exp(-z))), "error" if e else "ok", type(e).__name__ if e else None, str(e) if e else None))
            yield pd.DataFrame(out, columns=["image_path", "pred", "status", "error_type", "message"])

    return rows.select(path, payload).mapInPandas(run, OUTPUT)


def published(scored: DataFrame) -> DataFrame:
    """The two fields of good rows, in order of path; fails on a score outside 0 to 1 or a repeated path."""
    good = scored.filter("status = 'ok'").select("image_path", "pred")
    require([Check("score", good, where(F.isnan("pred") | ~F.col("pred").between(0, 1))), Check("path", good, F.count("image_path") - F.count_distinct("image_path"))])
    return good.orderBy("image_path")
