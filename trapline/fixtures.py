"""Shared synthetic camera-trap tables derived from the driver's ``events`` table.

The same SQL text runs in Spark and in DuckDB, so every query built on these
tables has an oracle twin.  Sizes grow with ``events``: one image per three
events, one prediction and one box per event.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

FIXTURE_TABLES = ("images", "predictions", "names", "processed", "boxes", "chunk_log")

# CTE prefix: append "select ... from <table>".
FIXTURE_SQL = """
with tax(tid, prediction) as (
  select * from (values
    (0,  'u00;aves;passeriformes;corvidae;corvus;macrorhynchos;large-billed crow'),
    (1,  'u01;mammalia;carnivora;canidae;nyctereutes;procyonoides;raccoon dog'),
    (2,  'u02;aves;passeriformes;corvidae;corvus;moneduloides;new caledonian crow'),
    (3,  'u03;;;;;;blank'),
    (4,  'u04;aves;;corvidae;;;corvidae family'),
    (5,  'u05;arachnida;araneae;araneidae;argiope;bruennichi;'),
    (6,  'blank'),
    (7,  'no cv result'),
    (8,  'not;enough;parts'),
    (9,  'u09;mammalia;carnivora;felidae;felis;;cat genus'),
    (10, 'u10;aves;x;y;foo;bar;fictional foo'),
    (11, 'u11;reptilia;squamata;colubridae;elaphe;climacophora;japanese rat snake'),
    (12, 'u12;no cv;;;no cv;no cv;no cv')) v(tid, prediction)
),
ev as (
  select cast(floor(event_id / 3) as bigint) as img, event_id, ts, value from events
),
images as (
  select img,
         concat('/archive/cam', cast(img % 7 as string), '/d', cast(cast(floor(img / 50) as bigint) as string),
                '/IMG_', lpad(cast(img % 50 as string), 4, '0'), '.JPG') as image_path,
         concat('IMG_', lpad(cast(img % 50 as string), 4, '0'), '.JPG') as image_name,
         case when img % 11 = 0 then '' else cast(cast(min(ts) as date) as string) end as image_date
  from ev group by img
),
predictions as (
  select i.image_path, e.img, cast(e.event_id % 3 as int) as det_index, t.prediction,
         least(e.value / 100.0, cast(1.0 as double)) as prediction_score,
         case e.event_id % 4 when 0 then '0.95' when 1 then '0.6' when 2 then '0.05'
              else 'not_a_number' end as score_text,
         case when e.img % 4 = 0 then split_part(t.prediction, ';', 2) else '' end as class_key,
         case when e.img % 4 = 0 then split_part(t.prediction, ';', 7) else '' end as common_key
  from ev e join images i on i.img = e.img
            join tax t on t.tid = (e.event_id * 5 + e.img) % 13
),
names(kind, name_key, name_value) as (
  select * from (values
    ('species',  'Corvus macrorhynchos',     'ハシブトガラス'),
    ('species',  'Nyctereutes procyonoides', 'タヌキ'),
    ('species',  'Elaphe climacophora',      'アオダイショウ'),
    ('genus',    'Corvus',                   'カラス属'),
    ('genus',    'Felis',                    'ネコ属'),
    ('category', 'bird',                     '鳥類'),
    ('category', 'mammal',                   '哺乳類'),
    ('category', 'no_detection',             '未検出')) v(kind, name_key, name_value)
),
processed as (
  select image_path from images where img % 3 = 0
),
boxes as (
  select i.image_path, cast(e.event_id % 3 as int) as box_index,
         cast((e.event_id * 37) % 10 as double) / 10 as conf,
         cast(e.event_id % 17 as double) / 17 as x, cast(e.event_id % 19 as double) / 19 as y
  from ev e join images i on i.img = e.img
),
chunk_log as (
  select distinct cast(floor(img / 50) as bigint) as chunk_no,
         cast(floor(img / 50) as bigint) % 7 in (1, 3, 4, 5) as failed
  from images
)
"""

# Rows in the literal ``names`` table (a proven bound for broadcasting).
FIXTURE_NAMES_ROWS = 8


def _events_view_name(sf_dir: str) -> str:
    return "tl_events_" + hashlib.sha1(sf_dir.rstrip("/").encode("utf-8")).hexdigest()[:10]


def _events_view(spark: SparkSession, sf_dir: str) -> str:
    name = _events_view_name(sf_dir)
    if not spark.catalog.tableExists(name):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").createOrReplaceTempView(name)
    return name


_FRAMES: dict[tuple[int, str, str], DataFrame] = {}


def fixture(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One fixture table as a Spark DataFrame (lazy; built from ``events``).

    The analyzed frame is reused within a session: a DataFrame is an
    immutable plan, and re-analyzing the CTE text for every use only costs
    driver time.
    """
    if table not in FIXTURE_TABLES:
        raise ValueError(f"unknown fixture table {table!r}")
    key = (id(spark), sf_dir.rstrip("/"), table)
    df = _FRAMES.get(key)
    if df is None or df.sparkSession is not spark or not spark.catalog.tableExists(_events_view_name(sf_dir)):
        view = _events_view(spark, sf_dir)
        sql = FIXTURE_SQL.replace(" from events", f" from {view}")
        df = spark.sql(f"{sql} select * from {table}")
        _FRAMES[key] = df
    return df


def fixtures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: fixture(spark, sf_dir, t) for t in FIXTURE_TABLES}


def oracle(body: str) -> str:
    """DuckDB text: the fixture prefix followed by extra CTEs / the final select."""
    return FIXTURE_SQL + body
