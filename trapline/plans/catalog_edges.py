"""Registered queries over the edges of routing and of the scorer contract, derived from ``events``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.operators import routing as rt
from trapline.operators.names import names_frame
from trapline.plans.detect import image_rows

FOLDER, FRAME = "/out/Burst", "burst.jpg"
CROW = "u;aves;passeriformes;corvidae;corvus;macrorhynchos;large-billed crow"
THRESHOLD = 0.5


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id")


def q_routing_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 past its limit: three frames of every event have one name and one folder, where files already lie."""
    frames = _events(spark, sf_dir).select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shot"))
    plan = frames.select(F.concat_ws("/", F.lit("/src"), "event_id", "shot", F.lit(FRAME)).alias("image_path"), F.lit(FRAME).alias("image_name"),
                         F.lit(FOLDER).alias("target_dir"), (F.col("event_id") * 3 + F.col("shot")).alias("seen_order"))
    taken = [FRAME, "burst_002.jpg", "burst_005.jpg", "burst_r1_10005.jpg"]
    existing = spark.createDataFrame([(FOLDER, n) for n in taken], "target_dir string, file_name string")
    return rt.dedup_destinations(plan, existing, run_stamp="r1").select("image_path", "dest_name")


SQL_ROUTING_OVERFLOW = """
with frames as (select event_id, unnest([0, 1, 2]) as shot from events),
numbered as (select '/src/' || event_id || '/' || shot || '/burst.jpg' as image_path,
                    row_number() over (order by event_id * 3 + shot) as k from frames),
free as (select image_path, case when k = 1 then 1 when k <= 3 then k + 1 else k + 2 end as n from numbered)
select image_path, case when n <= 9999 then 'burst_' || lpad(cast(n as varchar), cast(greatest(3, length(cast(n as varchar))) as integer), '0') || '.jpg'
                        when n = 10005 then 'burst_r1_r1_10005.jpg'
                        else 'burst_r1_' || n || '.jpg' end as dest_name
from free
"""


def q_detect_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's rows as they come: structured only, empty, text and NaN scores, untidy paths, boxes."""
    e = _events(spark, sf_dir).withColumn("case", F.col("event_id") % 6)
    path = F.concat(F.lit("/arch/"), F.col("event_id") % 50, F.lit("/"), F.col("event_id"), F.lit(".jpg"))
    images = e.select(path.alias("image_path"))
    untidy = F.concat(F.lit("/arch/x//../"), F.col("event_id") % 50, F.lit("/./"), F.col("event_id"), F.lit(".jpg"))
    case = lambda k, v: F.when(F.col("case") == k, F.lit(v))
    box = lambda conf, x: F.struct(F.lit(conf).alias("conf"), F.array(x.cast("double"), F.lit(2.0)).alias("bbox"))
    predictions = e.select(
        F.when(F.col("case") == 4, untidy).otherwise(path).alias("image_path"), F.lit(0).alias("det_index"),
        F.when(F.col("case") >= 2, F.lit(CROW)).alias("prediction"),
        F.coalesce(case(2, "oops"), case(3, "NaN"), F.lit("0.75")).alias("prediction_score"),
        F.lit(None).cast("string").alias("prediction_source"), case(0, "mammalia").alias("class"), F.lit(None).cast("string").alias("class_name"),
        case(0, "sus").alias("genus"), case(0, "scrofa").alias("species"), case(0, "wild boar").alias("common_name"),
        F.when(F.col("case") == 5, F.array(box(0.2, F.lit(-1)), box(0.8, F.col("event_id")))).alias("detections"),
        F.lit(None).cast("string").alias("error"))
    rows = image_rows(images, predictions, names_frame(spark), THRESHOLD)
    return rows.select("image_path", "n_detections", "scientific_name",
                       F.when(F.isnan("confidence"), F.lit(-1.0)).otherwise(F.col("confidence")).alias("confidence"),
                       F.get("bbox", F.lit(0)).alias("box_left"))


SQL_DETECT_SHAPE = """
select '/arch/' || (event_id % 50) || '/' || event_id || '.jpg' as image_path,
       cast(case when event_id % 6 = 2 then 0 else 1 end as bigint) as n_detections,
       case event_id % 6 when 0 then 'Sus scrofa' when 1 then '' when 2 then '' else 'Corvus macrorhynchos' end as scientific_name,
       cast(case event_id % 6 when 2 then 0 when 3 then -1 else 0.75 end as double) as confidence,
       case when event_id % 6 = 5 then cast(event_id as double) end as box_left
from events
"""

QUERIES = {
    "routing_overflow": (q_routing_overflow, SQL_ROUTING_OVERFLOW),
    "detect_shape": (q_detect_shape, SQL_DETECT_SHAPE),
}
