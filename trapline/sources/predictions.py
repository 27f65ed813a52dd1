"""Model output as a source.

Two layouts:

* JSON lines, one prediction per line (the scalable form: splits across tasks);
* a single document ``{"predictions": [...]}`` as the model writes it for a
  batch (one record per file, so keep such files batch-sized).

``det_index`` is the position of a prediction in its file; only its order
matters (first wins ties).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField("conf", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
PREDICTION_FIELDS = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("prediction_score", T.StringType()),  # try_cast later (P2)
    T.StructField("prediction_source", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("genus", T.StringType()),
    T.StructField("species", T.StringType()),
    T.StructField("common_name", T.StringType()),
    T.StructField("detections", T.ArrayType(BOX)),
])
PREDICTIONS_DOC = T.StructType([T.StructField("predictions", T.ArrayType(PREDICTION_FIELDS))])


def read_predictions(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Prediction rows with ``image_path`` (= ``filepath``) and ``det_index``."""
    if nested:
        doc = spark.read.schema(PREDICTIONS_DOC).option("multiLine", True).json(path)
        rows = doc.select(F.posexplode("predictions").alias("det_index", "p")).select("det_index", "p.*")
    else:
        rows = (spark.read.schema(PREDICTION_FIELDS).json(path)
                .withColumn("det_index", F.monotonically_increasing_id()))
    return rows.withColumn("image_path", F.col("filepath"))


def best_box(detections_col) -> F.Column:
    """P10 over the ``detections`` array: bbox of the max ``conf`` (first on ties), ``[]`` if none."""
    from trapline.operators.detections import best_in_array

    best = best_in_array(detections_col, "conf")
    return F.coalesce(best["bbox"], F.array().cast(T.ArrayType(T.DoubleType())))
