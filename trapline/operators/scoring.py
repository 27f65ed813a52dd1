"""Distributed batch scoring with a user-supplied model.

The model is not part of this library: a *scorer factory* ``(options) ->
score(pdf) -> pdf`` is called once per Python worker task (iterator form of
``mapInPandas``), and ``score`` is applied to Arrow batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` images (the chunk size).

``score`` receives the input columns of a batch and returns one row per
prediction: ``image_path, prediction_score`` and ``prediction`` or the structured
``class, class_name, genus, species, common_name``, optionally
``prediction_source`` and ``detections`` (boxes ``conf, bbox``).
Predictions keep their order per image (``det_index``).  When ``score``
raises, every image of the batch gets one row with ``error`` set and no
prediction (such images are not written as done, so a resume retries them).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trapline.constants import (
    DEFAULT_CHUNK_SIZE,
    DEFAULT_CONFIDENCE_THRESHOLD,
    DEFAULT_CONSECUTIVE_ERROR_LIMIT,
    DEFAULT_COUNTRY,
    DEFAULT_MODEL_BATCH_SIZE,
)
from trapline.operators.breaker import SharedBreaker

PREDICTION_SCHEMA = ("image_path string, det_index int, prediction string, prediction_score string, "
                     "prediction_source string, class string, class_name string, genus string, "
                     "species string, common_name string, "
                     "detections array<struct<conf:double,bbox:array<double>>>, error string")
_OPTIONAL = ("prediction", "prediction_source", "class", "class_name", "genus", "species", "common_name", "detections")
_COLUMNS = ("image_path", "det_index", "prediction", "prediction_score", *_OPTIONAL[1:], "error")
BREAKER = "BreakerTripped"


@dataclass(frozen=True)
class ScoringOptions:
    """Job options (unknown keys are ignored by :meth:`from_dict`)."""
    confidence_threshold: float = DEFAULT_CONFIDENCE_THRESHOLD
    chunk_size: int = DEFAULT_CHUNK_SIZE
    model_batch_size: int = DEFAULT_MODEL_BATCH_SIZE
    country: str = DEFAULT_COUNTRY
    run_mode: str = "multi_thread"
    consecutive_error_limit: int = DEFAULT_CONSECUTIVE_ERROR_LIMIT

    @classmethod
    def from_dict(cls, d: dict) -> "ScoringOptions":
        known = {f for f in cls.__dataclass_fields__}
        return cls(**{k: v for k, v in d.items() if k in known})


Scorer = Callable[[pd.DataFrame], pd.DataFrame]
ScorerFactory = Callable[[ScoringOptions], Scorer]


def _shape(out: pd.DataFrame) -> pd.DataFrame:
    out = out.copy()
    for c in _OPTIONAL:
        if c not in out.columns:
            out[c] = None
    out["detections"] = out["detections"].map(lambda v: v if isinstance(v, (list, tuple, np.ndarray)) else None)
    if "det_index" not in out.columns:
        out["det_index"] = out.groupby("image_path", sort=False).cumcount()
    if "prediction_score" not in out.columns:
        out["prediction_score"] = None
    # the score stays text: what is malformed, missing or NaN is decided with the other rows
    out["prediction_score"] = out["prediction_score"].map(_score_text)
    out["error"] = None
    return out[list(_COLUMNS)]


def _score_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return repr(float(value)).replace("nan", "NaN").replace("inf", "Infinity") if isinstance(value, (float, int, np.number)) else str(value)


def _errors(pdf: pd.DataFrame, error: str) -> pd.DataFrame:
    return pd.DataFrame({"image_path": pdf["image_path"], "det_index": -1, "prediction_score": None,
                         **{c: None for c in _OPTIONAL}, "error": error})[list(_COLUMNS)]


def score_images(images: DataFrame, factory: ScorerFactory, options: ScoringOptions | None = None,
                 path_col: str = "image_path", input_cols: tuple[str, ...] = (),
                 breaker: SharedBreaker | None = None) -> DataFrame:
    """PREDICTION rows for every image of ``images``.

    Only ``path_col`` and ``input_cols`` travel to Python.  Each Arrow batch
    is cut into chunks of ``options.chunk_size`` images; a chunk is the unit
    of scoring and of failure.  After ``options.consecutive_error_limit`` failed
    chunks in a row a task scores no more: the rest of its images get rows with
    a breaker error, so a broken model is not asked for the whole archive.  With a
    ``breaker`` failures in a row are counted over all tasks of the job, and all of
    them stop.  No session setting is changed.
    """
    options = options or ScoringOptions()
    cols = [path_col, *input_cols]
    size = max(1, int(options.chunk_size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, failed = factory(options), 0  # once per task: the model loads once per worker task
        task = TaskContext.get().partitionId() if breaker else 0
        for batch in batches:
            batch = batch.rename(columns={path_col: "image_path"})
            for start in range(0, len(batch), size):
                pdf = batch.iloc[start:start + size].reset_index(drop=True)
                if failed >= options.consecutive_error_limit or (breaker and breaker.tripped()):
                    yield _errors(pdf, f"{BREAKER}: {options.consecutive_error_limit} failed chunks in a row")
                    continue
                try:
                    out = _shape(score(pdf))
                    failed = 0
                except Exception as e:  # noqa: BLE001 - a failed chunk becomes error rows (Q13)
                    out = _errors(pdf, f"{type(e).__name__}: {e}")
                    failed += 1
                if breaker and failed:
                    breaker.failed(out["error"].iloc[0])
                elif breaker:
                    breaker.succeeded(task)
                yield out

    return images.select(*cols).mapInPandas(run, PREDICTION_SCHEMA)


# ---------------------------------------------------------------------------
# deterministic test scorers (the model is replaced in tests, as a fake detector)
# ---------------------------------------------------------------------------

def embedding_argmax_factory(options: ScoringOptions) -> Scorer:
    """Test scorer over an ``embedding`` column and a ``label``: one prediction per image.

    ``idx`` = position of the first maximum of the embedding; the prediction is
    ``u{idx};mammalia;o;f;genus{idx};sp{label};dim {idx}`` with score
    ``min(1, 4 * max)``.
    """
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        emb = np.stack([np.asarray(e, dtype=np.float32) for e in pdf["embedding"]])
        idx = emb.argmax(axis=1)
        top = emb[np.arange(len(emb)), idx].astype(np.float64)
        pred = [f"u{i};mammalia;o;f;genus{i};sp{lab};dim {i}" for i, lab in zip(idx, pdf["label"])]
        return pd.DataFrame({"image_path": pdf["image_path"], "prediction": pred,
                             "prediction_score": np.minimum(1.0, 4.0 * top)})
    return score


def fixed_factory(prediction: str, score: float = 0.9, fail_paths: frozenset[str] = frozenset(),
                  empty: bool = False) -> ScorerFactory:
    """Test scorer: one fixed prediction per image, none, or an error for chosen paths."""
    def factory(options: ScoringOptions) -> Scorer:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            if fail_paths and set(pdf["image_path"]) & fail_paths:
                raise RuntimeError("model failure")
            if empty:
                return pd.DataFrame({"image_path": [], "prediction": [], "prediction_score": []})
            return pd.DataFrame({"image_path": pdf["image_path"], "prediction": prediction,
                                 "prediction_score": score})
        return run
    return factory
