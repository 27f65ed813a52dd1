"""Registered queries over the shared fixture tables, each with a DuckDB twin.

Spark side: library operators over :mod:`trapline.fixtures` frames.
Oracle side: plain SQL over the same fixture CTEs.  Column names and types
agree on both sides (counts ``bigint``, flags ``int``, scores ``double``).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.constants import DEFAULT_CONFIDENCE_THRESHOLD
from trapline.fixtures import FIXTURE_NAMES_ROWS, fixture, oracle
from trapline.functions.dates import capture_date
from trapline.operators import detections as det
from trapline.operators import incremental as inc
from trapline.operators import labels as lab
from trapline.operators import reports as rep
from trapline.operators import routing as rt
from trapline.operators.names import NAMES_SCHEMA, with_category_label, with_resolved_vernacular
from trapline.session import materialize

THRESHOLD = DEFAULT_CONFIDENCE_THRESHOLD
_LABELS_SQL = "('blank', 'no cv result', 'no_cv_result')"

# ---------------------------------------------------------------------------
# shared Spark building blocks
# ---------------------------------------------------------------------------


_NAMES: dict[tuple[int, str], DataFrame] = {}


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture dictionary as a local relation (a literal table of FIXTURE_NAMES_ROWS rows)."""
    key = (id(spark), sf_dir.rstrip("/"))
    df = _NAMES.get(key)
    if df is None or df.sparkSession is not spark:
        rows = fixture(spark, sf_dir, "names").limit(FIXTURE_NAMES_ROWS + 1).collect()
        assert len(rows) <= FIXTURE_NAMES_ROWS
        # kept a plain local relation: the lookups broadcast their slices themselves
        df = spark.createDataFrame([tuple(r) for r in rows], NAMES_SCHEMA)
        _NAMES[key] = df
    return df


def parsed(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Detection grain: predictions above the threshold, parsed and named."""
    return det.parse_predictions(fixture(spark, sf_dir, "predictions"), names(spark, sf_dir),
                                 threshold=threshold)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image list with its first-seen order (``seen_order``)."""
    return fixture(spark, sf_dir, "images").withColumn("seen_order", F.col("img"))


def detections_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image grain (D5): best detection per image, defaults for images without one."""
    best = det.best_per_image(parsed(spark, sf_dir))
    return det.detections_table(images(spark, sf_dir), best.drop("det_index"))


def labeled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = detections_table(spark, sf_dir)
    return lab.with_report_label(lab.with_report_date(t), names(spark, sf_dir))


# ---------------------------------------------------------------------------
# shared oracle CTEs (DuckDB)
# ---------------------------------------------------------------------------

def parsed_sql(name: str = "parsed", structured: bool = False, score: str = "prediction_score") -> str:
    """Oracle CTEs ``{name}_in … {name}`` reproducing :func:`parse_predictions`."""
    if score == "prediction_score":
        conf, keep = "p.prediction_score", f"p.prediction_score >= {THRESHOLD}"
    else:
        conf = f"coalesce(try_cast(p.{score} as double), cast(0 as double))"
        keep = (f"(p.{score} is null or try_cast(p.{score} as double) is not null) "
                f"and coalesce(try_cast(p.{score} as double), 0) >= {THRESHOLD}")
    st = "(trim(p.class_key) <> '' or trim(p.common_key) <> '')" if structured else "false"

    def part(i, key=None):
        s_ = f"trim(split_part(p.prediction, ';', {i}))"
        if key is None:
            return f"case when {st} then '' else {s_} end"
        return f"case when {st} then trim(p.{key}) else {s_} end"

    return f"""
, {name}_in as (
  select p.image_path, p.img, p.det_index, p.prediction, {conf} as confidence,
         {st} as is_struct,
         {part(2, 'class_key')} as c_class, {part(5)} as c_genus, {part(6)} as c_species,
         {part(7, 'common_key')} as c_common,
         length(p.prediction) - length(replace(p.prediction, ';', '')) + 1 as n_parts
  from predictions p
  where {keep}
),
{name}_kind as (
  select *,
    case when not is_struct and (coalesce(prediction, '') = '' or lower(trim(prediction)) in {_LABELS_SQL}) then 'nodet'
         when not is_struct and n_parts < 7 then 'raw'
         when (c_class <> '' or c_genus <> '' or c_species <> '' or c_common <> '')
              and (c_class = '' or lower(c_class) in {_LABELS_SQL})
              and (c_genus = '' or lower(c_genus) in {_LABELS_SQL})
              and (c_species = '' or lower(c_species) in {_LABELS_SQL})
              and (c_common = '' or lower(c_common) in {_LABELS_SQL}) then 'nodet'
         else 'build' end as kind,
    case when c_genus <> '' and c_species <> '' then upper(left(c_genus, 1)) || lower(substr(c_genus, 2)) || ' ' || c_species
         when c_genus <> '' then upper(left(c_genus, 1)) || lower(substr(c_genus, 2))
         when c_common <> '' and lower(c_common) not in {_LABELS_SQL} then c_common
         else coalesce(nullif(prediction, ''), 'Unknown') end as b_sci,
    case when c_common = '' or lower(c_common) in {_LABELS_SQL} then '' else c_common end as b_common,
    case lower(c_class) when 'aves' then 'bird' when 'mammalia' then 'mammal'
         when 'reptilia' then 'reptile' when 'amphibia' then 'amphibian'
         when 'actinopterygii' then 'fish' when 'insecta' then 'insect'
         else coalesce(nullif(lower(c_class), ''), 'unknown') end as b_category
  from {name}_in
),
{name}_names as (
  select k.*,
         case when k.kind = 'build' then coalesce(sp.name_value, ge.name_value, '') else '' end as japanese_name
  from {name}_kind k
  left join sp_names sp on k.kind = 'build' and sp.name_key = trim(k.b_sci)
  left join ge_names ge on k.kind = 'build' and ge.name_key =
       case when trim(k.b_sci) like '% %' then split_part(trim(k.b_sci), ' ', 1) else trim(k.b_sci) end
),
{name} as (
  select image_path, img, det_index, prediction, confidence,
    case kind when 'nodet' then '' when 'raw' then prediction else b_sci end as scientific_name,
    case kind when 'nodet' then 'no_detection' when 'raw' then 'unknown' else b_category end as category,
    case kind when 'build' then b_common else '' end as common_name,
    japanese_name,
    case kind when 'nodet' then '' when 'raw' then prediction
      else case when (b_common = '' or lower(b_common) = lower(b_sci))
                     and (japanese_name = '' or japanese_name = b_common) then b_sci
                else b_sci || ' (' || concat_ws(' / ',
                       case when b_common <> '' and lower(b_common) <> lower(b_sci) then b_common end,
                       case when japanese_name <> '' and japanese_name <> b_common then japanese_name end) || ')'
           end
    end as species
  from {name}_names
)
"""


ORACLE_NAMES = """
, sp_names as (select name_key, max(name_value) as name_value from names where kind = 'species' group by name_key),
ge_names as (select name_key, max(name_value) as name_value from names where kind = 'genus' group by name_key),
cat_names as (select name_key, max(name_value) as name_value from names where kind = 'category' group by name_key)
"""

ORACLE_PARSED = ORACLE_NAMES + parsed_sql()

ORACLE_TABLE = ORACLE_PARSED + """
, best as (
  select * from (
    select *, row_number() over (partition by image_path order by confidence desc, det_index) as rn
    from parsed) r
  where rn = 1
),
dtable as (
  select i.img, i.image_path, i.image_name, i.image_date,
         coalesce(b.species, '') as species, coalesce(b.scientific_name, '') as scientific_name,
         coalesce(b.confidence, cast(0 as double)) as confidence, coalesce(b.category, '') as category,
         coalesce(b.common_name, '') as common_name, coalesce(b.japanese_name, '') as japanese_name
  from images i left join best b on b.image_path = i.image_path
)
"""

ORACLE_LABELED = ORACLE_TABLE + f"""
, labeled_in as (
  select d.*, trim(d.species) as t_species, trim(d.common_name) as t_common,
         trim(d.japanese_name) as t_jp, trim(d.scientific_name) as t_sci,
         case when trim(d.image_date) <> '' then trim(d.image_date) else 'unknown-date' end as report_date
  from dtable d
),
labeled as (
  select l.*,
    case when l.t_species = '' or (lower(l.t_species) in {_LABELS_SQL}
                                   and (l.t_common = '' or lower(l.t_common) in {_LABELS_SQL}))
           then '撮影無し'
         when l.t_jp <> '' then l.t_jp
         when coalesce(sp.name_value, ge.name_value, '') <> '' then coalesce(sp.name_value, ge.name_value)
         when l.t_common <> '' and lower(l.t_common) not in {_LABELS_SQL} then l.t_common
         else l.t_species end as label
  from labeled_in l
  left join sp_names sp on l.t_jp = '' and l.t_sci <> '' and sp.name_key = l.t_sci
  left join ge_names ge on l.t_jp = '' and l.t_sci <> '' and ge.name_key =
       case when l.t_sci like '% %' then split_part(l.t_sci, ' ', 1) else l.t_sci end
)
"""

# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------


def q_daily_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: date x label image counts with date and label totals."""
    return lab.daily_label_counts(labeled_table(spark, sf_dir))


SQL_DAILY_LABEL_COUNTS = oracle(ORACLE_LABELED + """
select report_date as image_date, label, cast(count(*) as bigint) as n_images,
       cast(grouping(report_date, label) as int) as grouping_id
from labeled
group by grouping sets ((report_date, label), (report_date), (label))
""")



DETECTION_OUT = ["image_path", "det_index", "species", "scientific_name", "confidence", "category",
                 "common_name", "japanese_name"]
_DET_OUT_SQL = ", ".join(DETECTION_OUT)


# --- P1-P9 ------------------------------------------------------------------

def q_parse_predictions(spark, sf_dir):
    return parsed(spark, sf_dir).select(*DETECTION_OUT)


SQL_PARSE_PREDICTIONS = oracle(ORACLE_PARSED + f"select {_DET_OUT_SQL} from parsed")


def q_structured_or_string(spark, sf_dir):
    """Structured keys (class, common name) win over the prediction string."""
    return det.parse_predictions(fixture(spark, sf_dir, "predictions"), names(spark, sf_dir),
                                 threshold=THRESHOLD, class_col="class_key",
                                 common_col="common_key").select(*DETECTION_OUT)


SQL_STRUCTURED_OR_STRING = oracle(ORACLE_NAMES + parsed_sql("sparsed", structured=True)
                                  + f"select {_DET_OUT_SQL} from sparsed")


def q_score_text_filter(spark, sf_dir):
    """Scores given as text; malformed ones are dropped, not failed."""
    return (det.parse_predictions(fixture(spark, sf_dir, "predictions"), names(spark, sf_dir),
                                  threshold=THRESHOLD, score_col="score_text")
            .select("image_path", "det_index", "confidence", "species", "category"))


SQL_SCORE_TEXT_FILTER = oracle(ORACLE_NAMES + parsed_sql("tparsed", score="score_text")
                               + "select image_path, det_index, confidence, species, category from tparsed")


# --- P10-P14 ----------------------------------------------------------------

def q_best_detection(spark, sf_dir):
    return det.best_per_image(parsed(spark, sf_dir)).select(
        "image_path", "det_index", "species", "confidence", "category")


SQL_BEST_DETECTION = oracle(ORACLE_TABLE + "select image_path, det_index, species, confidence, category from best")


def q_best_bbox(spark, sf_dir):
    """P10: per image, the box with the highest confidence, first on ties (partial aggregate)."""
    boxes = fixture(spark, sf_dir, "boxes")
    return det.best_per_image(boxes, order_col="box_index", value_col="conf", fields=("conf", "x", "y")).select(
        "image_path", "box_index", "conf", "x", "y")


SQL_BEST_BBOX = oracle("""
select image_path, box_index, conf, x, y from (
  select *, row_number() over (partition by image_path order by conf desc, box_index) as rn from boxes) b
where rn = 1
""")


def q_detections_per_image(spark, sf_dir):
    """Every image with its detection count, distinct species, best species."""
    d = parsed(spark, sf_dir)
    # one aggregate per image: count, distinct species and the best species
    per = det.best_per_image(d, fields=("species",), count_col="n_detections",
                             extra_aggs=(F.countDistinct("species").alias("n_species"),)).select(
        "image_path", F.col("species").alias("best_species"), "n_detections", "n_species")
    return (images(spark, sf_dir).join(per, "image_path", "left")
            .select("image_path", "image_name",
                    F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
                    F.coalesce("n_species", F.lit(0)).cast("long").alias("n_species"),
                    (F.coalesce("n_detections", F.lit(0)) > 0).alias("has_detections"),
                    F.coalesce("best_species", F.lit("")).alias("best_species")))


SQL_DETECTIONS_PER_IMAGE = oracle(ORACLE_TABLE + """
, per as (
  select image_path, count(*) as n, count(distinct species) as ns from parsed group by image_path
)
select i.image_path, i.image_name, cast(coalesce(per.n, 0) as bigint) as n_detections,
       cast(coalesce(per.ns, 0) as bigint) as n_species, coalesce(per.n, 0) > 0 as has_detections,
       coalesce(b.species, '') as best_species
from images i left join per on per.image_path = i.image_path
              left join best b on b.image_path = i.image_path
""")

_WIDE_FIELDS = ("species", "common_name", "japanese_name", "scientific_name", "confidence", "category_label")


def q_detail_top3(spark, sf_dir):
    """First three detections in model order, side by side, with a remark."""
    nm = names(spark, sf_dir)
    d = with_category_label(with_resolved_vernacular(parsed(spark, sf_dir), nm), F.col("category"), nm)
    wide = det.first_n_wide(d, 3, fields=_WIDE_FIELDS)
    return (images(spark, sf_dir).select("image_path", "image_name").join(wide, "image_path", "left")
            .withColumn("detection_count", F.coalesce("detection_count", F.lit(0)).cast("long"))
            .withColumn("remark", det.detail_remark(F.col("detection_count"))))


def _wide_sql():
    cols = []
    for i in (1, 2, 3):
        for f in _WIDE_FIELDS:
            cols.append(f"max(case when rn = {i} then {f} end) as {f}_{i}")
    return ",\n       ".join(cols)


SQL_DETAIL_TOP3 = oracle(ORACLE_PARSED + f"""
, lab as (
  select p.*, coalesce(c.name_value, p.category) as category_label,
         row_number() over (partition by p.image_path order by p.det_index) as rn
  from parsed p left join cat_names c on c.name_key = p.category
),
w as (
  select image_path, count(*) as n,
       {_wide_sql()}
  from lab group by image_path
)
select i.image_path, i.image_name, cast(coalesce(w.n, 0) as bigint) as detection_count,
       {", ".join(f"w.{f}_{i}" for i in (1, 2, 3) for f in _WIDE_FIELDS)},
       case when coalesce(w.n, 0) = 0 then '野生生物が検出されませんでした'
            when w.n > 3 then '追加で' || cast(w.n - 3 as varchar) || '個の検出があります'
            else '' end as remark
from images i left join w on w.image_path = i.image_path
""")


# --- J3 / J4 / J7 -------------------------------------------------------------

def q_vernacular_names(spark, sf_dir):
    t = detections_table(spark, sf_dir).filter(F.col("scientific_name") != "")
    t = with_resolved_vernacular(t, names(spark, sf_dir))
    return t.groupBy("scientific_name", "japanese_name").agg(F.count(F.lit(1)).alias("n_images"))


SQL_VERNACULAR_NAMES = oracle(ORACLE_LABELED + """
, v as (
  select l.t_sci as scientific_name,
         case when l.t_jp <> '' then l.t_jp else coalesce(sp.name_value, ge.name_value, '') end as japanese_name
  from labeled_in l
  left join sp_names sp on l.t_jp = '' and sp.name_key = l.t_sci
  left join ge_names ge on l.t_jp = '' and ge.name_key =
       case when l.t_sci like '% %' then split_part(l.t_sci, ' ', 1) else l.t_sci end
  where l.scientific_name <> ''
)
select scientific_name, japanese_name, count(*) as n_images from v group by scientific_name, japanese_name
""")


def q_category_labels(spark, sf_dir):
    counts = parsed(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n_detections"))
    return with_category_label(counts, F.col("category"), names(spark, sf_dir))


SQL_CATEGORY_LABELS = oracle(ORACLE_PARSED + """
select p.category, count(*) as n_detections,
       case when p.category = '' then '' else coalesce(c.name_value, p.category) end as category_label
from parsed p left join cat_names c on c.name_key = p.category
group by p.category, c.name_value
""")


# --- J2 / O1-O3 / A2 / A13 ------------------------------------------------------

def q_resume_pending(spark, sf_dir):
    return inc.pending_images(images(spark, sf_dir), fixture(spark, sf_dir, "processed")).select(
        "image_path", "img")


SQL_RESUME_PENDING = oracle("""
select i.image_path, i.img from images i
where not exists (select 1 from processed p
                  where trim(p.image_path) <> '' and trim(p.image_path) = i.image_path)
""")


def _resume_parts(spark, sf_dir):
    table = detections_table(spark, sf_dir)
    processed = fixture(spark, sf_dir, "processed")
    existing = table.join(processed.select("image_path"), "image_path", "left_semi")
    pending = inc.pending_images(images(spark, sf_dir), existing)
    new_rows = table.join(pending.select("image_path"), "image_path", "left_semi")
    return existing, pending, new_rows


def q_resume_union(spark, sf_dir):
    existing, _pending, new_rows = _resume_parts(spark, sf_dir)
    return inc.resume_union(existing.withColumn("run", F.lit("existing")),
                            new_rows.withColumn("run", F.lit("new"))).select(
        "image_path", "species", "confidence", "run")


SQL_RESUME_UNION = oracle(ORACLE_TABLE + """
select d.image_path, d.species, d.confidence,
       case when d.image_path in (select image_path from processed) then 'existing' else 'new' end as run
from dtable d
""")


def q_run_summary(spark, sf_dir):
    _existing, pending, _new = _resume_parts(spark, sf_dir)
    counts = parsed(spark, sf_dir).groupBy("image_path").agg(F.count(F.lit(1)).alias("n_detections"))
    scored = (pending.select("image_path").join(counts, "image_path", "left")
              .withColumn("n_detections", F.coalesce("n_detections", F.lit(0))))
    return inc.run_summary(images(spark, sf_dir), pending, scored)


SQL_RUN_SUMMARY = oracle(ORACLE_PARSED + """
, pend as (select image_path from images where image_path not in (select image_path from processed)),
per as (select image_path, count(*) as n from parsed group by image_path),
s as (
  select (select count(*) from images) as total_images,
         (select count(*) from pend) as pending_images,
         (select count(*) from pend) as total_processed,
         (select count(*) from pend join per using (image_path)) as successful
)
select cast(total_images as bigint) as total_images,
       cast(total_images - pending_images as bigint) as skipped,
       cast(total_processed as bigint) as total_processed,
       cast(successful as bigint) as successful,
       cast(total_processed - successful as bigint) as failed,
       false as stopped,
       case when pending_images = 0 then cast(0 as double)
            else total_processed * 100.0 / pending_images end as progress_pct
from s
""")


# --- A1 / A3 / A4 / A5 / K3 -----------------------------------------------------

def q_summary_totals(spark, sf_dir):
    return rep.summary_totals(detections_table(spark, sf_dir))


_TOTALS_SQL = """
, tot as (
  select count(*) as total_images, count(*) filter (where species <> '') as detected_images from dtable
)
"""

SQL_SUMMARY_TOTALS = oracle(ORACLE_TABLE + _TOTALS_SQL + """
select cast(total_images as bigint) as total_images, cast(detected_images as bigint) as detected_images,
       cast(total_images - detected_images as bigint) as undetected_images,
       cast(detected_images as bigint) as total_detections,
       case when total_images = 0 then cast(0 as double) else detected_images * 100.0 / total_images end
         as success_rate
from tot
""")


def q_species_frequency(spark, sf_dir):
    return rep.species_frequency(detections_table(spark, sf_dir))


_SPECIES_FREQ_SQL = """
, sf as (
  select species, count(*) as n, min(img) as first_seen from dtable where species <> '' group by species
),
sfr as (
  select species, cast(n as bigint) as n, n * 100.0 / sum(n) over () as pct,
         cast(row_number() over (order by n desc, first_seen) as int) as rank
  from sf
)
"""

SQL_SPECIES_FREQUENCY = oracle(ORACLE_TABLE + _SPECIES_FREQ_SQL + "select species, n, pct, rank from sfr")


def q_category_frequency(spark, sf_dir):
    return rep.category_frequency(detections_table(spark, sf_dir), names(spark, sf_dir))


_CATEGORY_FREQ_SQL = """
, cf as (
  select category, count(*) as n, min(img) as first_seen,
         count(*) * 100.0 / sum(count(*)) over () as pct
  from dtable where species <> '' group by category
),
cfr as (
  select cf.category, cast(cf.n as bigint) as n, cf.pct,
         cast(row_number() over (order by cf.n desc, cf.first_seen) as int) as rank,
         coalesce(c.name_value, cf.category) as category_label
  from cf left join cat_names c on c.name_key = cf.category
  where cf.category <> ''
)
"""

SQL_CATEGORY_FREQUENCY = oracle(ORACLE_TABLE + _CATEGORY_FREQ_SQL
                                + "select category, n, pct, rank, category_label from cfr")


def q_confidence_bands(spark, sf_dir):
    return rep.confidence_bands(detections_table(spark, sf_dir))


_BANDS_SQL = """
, bands(band, band_label) as (
  select * from (values (0, '0.9-1.0 (非常に高い)'), (1, '0.7-0.9 (高い)'), (2, '0.5-0.7 (中程度)'),
                        (3, '0.3-0.5 (低い)'), (4, '0.0-0.3 (非常に低い)')) v(band, band_label)
),
bc as (
  select case when isnan(confidence) then 4 when confidence >= 0.9 then 0 when confidence >= 0.7 then 1
              when confidence >= 0.5 then 2 when confidence >= 0.3 then 3 else 4 end as band,
         count(*) as n
  from dtable where species <> '' group by 1
),
bands_out as (
  select b.band, b.band_label, cast(coalesce(bc.n, 0) as bigint) as n
  from bands b left join bc on bc.band = b.band
)
"""

SQL_CONFIDENCE_BANDS = oracle(ORACLE_TABLE + _BANDS_SQL + "select band, band_label, n from bands_out")


def q_summary_report(spark, sf_dir):
    return rep.summary_report(detections_table(spark, sf_dir), names(spark, sf_dir))


SQL_SUMMARY_REPORT = oracle(ORACLE_TABLE + _TOTALS_SQL + _SPECIES_FREQ_SQL + _CATEGORY_FREQ_SQL + _BANDS_SQL + """
select '基本統計' as section, 1 as ord, '総画像数' as item, cast(total_images as bigint) as n,
       cast(null as double) as pct from tot
union all select '基本統計', 2, '検出成功画像数', cast(detected_images as bigint), cast(null as double) from tot
union all select '基本統計', 3, '検出失敗画像数', cast(total_images - detected_images as bigint),
                 cast(null as double) from tot
union all select '基本統計', 4, '総検出数', cast(detected_images as bigint), cast(null as double) from tot
union all select '基本統計', 5, '成功率 (%)', cast(null as bigint),
                 case when total_images = 0 then cast(0 as double) else detected_images * 100.0 / total_images end
          from tot
union all select '検出種別統計', rank, species, n, pct from sfr
union all select 'カテゴリ別統計', rank, category_label, n, pct from cfr
union all select '信頼度統計', band + 1, band_label, n, cast(null as double) from bands_out
""")


# --- A9 ---------------------------------------------------------------------------

# A mean of doubles depends on summation order (engines differ in the last
# digits); the registered query presents it at 9 decimals on both sides.
AVG_DECIMALS = 9


def q_species_list(spark, sf_dir):
    d = parsed(spark, sf_dir).withColumn("seen_order", F.col("img"))
    out = rep.species_list(d, names(spark, sf_dir))
    return out.withColumn("avg_confidence", F.round("avg_confidence", AVG_DECIMALS))


SQL_SPECIES_LIST = oracle(ORACLE_PARSED + """
, g as (
  select species, count(*) as detection_count, greatest(max(confidence), 0.0) as max_confidence,
         avg(confidence) as avg_confidence,
         arg_min(common_name, img * 10 + det_index) as common_name,
         arg_min(japanese_name, img * 10 + det_index) as jp,
         arg_min(scientific_name, img * 10 + det_index) as scientific_name,
         arg_min(category, img * 10 + det_index) as category,
         min(img * 10 + det_index) as first_seen
  from parsed group by species
)
select g.species, g.common_name,
       case when trim(g.jp) <> '' then trim(g.jp)
            when trim(g.scientific_name) <> '' then coalesce(sp.name_value, ge.name_value, '') else '' end
         as japanese_name,
       g.scientific_name, cast(g.detection_count as bigint) as detection_count,
       cast(g.max_confidence as double) as max_confidence, round(g.avg_confidence, 9) as avg_confidence,
       cast(row_number() over (order by g.detection_count desc, g.first_seen) as int) as rank,
       case when g.category = '' then '' else coalesce(c.name_value, g.category) end as category_label
from g
left join sp_names sp on trim(g.jp) = '' and sp.name_key = trim(g.scientific_name)
left join ge_names ge on trim(g.jp) = '' and ge.name_key =
     case when trim(g.scientific_name) like '% %' then split_part(trim(g.scientific_name), ' ', 1)
          else trim(g.scientific_name) end
left join cat_names c on c.name_key = g.category
""")


# --- A6-A8 ------------------------------------------------------------------------

def q_daily_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: date x label image counts with date and label totals."""
    return lab.daily_label_counts(labeled_table(spark, sf_dir))


SQL_DAILY_LABEL_COUNTS = oracle(ORACLE_LABELED + """
select report_date as image_date, label, cast(count(*) as bigint) as n_images,
       cast(grouping(report_date, label) as int) as grouping_id
from labeled
group by grouping sets ((report_date, label), (report_date), (label))
""")

# Pivot columns: an explicit list keeps the schema static (the fixture spans January 2024);
# all other dates are counted in the last column, on both sides.
PIVOT_DATES = [f"2024-01-{d:02d}" for d in range(1, 32)] + ["unknown-date"]


def q_daily_label_pivot(spark, sf_dir):
    return rep.daily_label_pivot(q_daily_label_counts(spark, sf_dir), PIVOT_DATES, other=rep.PIVOT_OTHER_DATES)


def _pivot_sql():
    cells = ",\n       ".join(
        f"cast(count(*) filter (where report_date = '{d}') as bigint) as \"{d}\"" for d in PIVOT_DATES)
    listed = ", ".join(f"'{d}'" for d in PIVOT_DATES)
    columns = [*PIVOT_DATES, rep.PIVOT_OTHER_DATES]
    cells += f",\n       cast(count(*) filter (where report_date not in ({listed})) as bigint) as \"{columns[-1]}\""
    tot_cells = ", ".join(f"\"{d}\"" for d in columns)
    tot_sum = " + ".join(f"\"{d}\"" for d in columns)
    return ORACLE_LABELED + f"""
, lab_rows as (
  select label, case when label = '撮影無し' then 1 else 2 end as block, cast(count(*) as bigint) as total,
       {cells}
  from labeled group by label
),
tot_row as (
  select {cells} from labeled
),
all_rows as (
  select block, label, total, {tot_cells} from lab_rows
  union all select 0, '合計撮影枚数', {tot_sum}, {tot_cells} from tot_row
  union all select 3, '合計', {tot_sum}, {tot_cells} from tot_row
)
select cast(row_number() over (order by block, total desc, label) as int) as row_order,
       block, label, total, {tot_cells}
from all_rows
"""


SQL_DAILY_LABEL_PIVOT = oracle(_pivot_sql())


# --- A12 / L5 -------------------------------------------------------------------------

def q_result_metadata(spark, sf_dir):
    return rep.result_metadata(detections_table(spark, sf_dir))


SQL_RESULT_METADATA = oracle(ORACLE_TABLE + """
select cast(count(*) as bigint) as total_rows,
       cast(count(distinct case when species <> '' then species end) as bigint) as distinct_species,
       cast(greatest(1, ceil(count(*) / 100.0)) as bigint) as page_count
from dtable
""")

RESULT_PAGE_INDEX = 2


def q_result_page(spark, sf_dir):
    page = rep.result_page(detections_table(spark, sf_dir), RESULT_PAGE_INDEX)
    return page.select("row_no", "image_name", "species_display", "common_name", "scientific_name",
                       "confidence", "category")


SQL_RESULT_PAGE = oracle(ORACLE_TABLE + f"""
select * from (
  select cast(row_number() over (order by img) as bigint) as row_no, image_name,
         case when species <> '' then species else '検出なし' end as species_display,
         common_name, scientific_name, confidence, category
  from dtable) r
where row_no > {RESULT_PAGE_INDEX * 100} and row_no <= {RESULT_PAGE_INDEX * 100 + 100}
""")


# --- P17 / P18 -----------------------------------------------------------------------

def _exif_text(spark, sf_dir):
    """EXIF-like text columns derived from ``events`` (valid, blank, malformed, missing)."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts")
    full = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    m = F.col("event_id") % 6
    original = (F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit(""))
                .when(m == 2, full).when(m == 3, F.lit("garbage"))
                .when(m == 4, F.date_format("ts", "yyyy:MM:dd"))
                .otherwise(F.date_format("ts", "yyyy:M:d HH:mm:ss")))
    digitized = F.when(F.col("event_id") % 4 == 0, F.date_format(F.col("ts") - F.expr("INTERVAL 1 DAY"),
                                                                 "yyyy:MM:dd HH:mm:ss"))
    dt = F.when(F.col("event_id") % 3 != 0, F.date_format(F.col("ts") - F.expr("INTERVAL 2 DAYS"),
                                                          "yyyy:MM:dd HH:mm:ss"))
    return ev.select("event_id", original.alias("dt_original"), digitized.alias("dt_digitized"),
                     dt.alias("dt"), F.col("ts").alias("mtime"))


def q_exif_date_text(spark, sf_dir):
    t = _exif_text(spark, sf_dir)
    return t.select("event_id", capture_date("dt_original", "dt_digitized", "dt", "mtime").alias("capture_date"))


_EXIF_P17 = ("case when coalesce({c}, '') <> '' and length(replace(split_part({c}, ' ', 1), ':', '-')) = 10 "
             "and substr(replace(split_part({c}, ' ', 1), ':', '-'), 5, 1) = '-' "
             "and substr(replace(split_part({c}, ' ', 1), ':', '-'), 8, 1) = '-' "
             "then replace(split_part({c}, ' ', 1), ':', '-') end")

SQL_EXIF_DATE_TEXT = oracle(f"""
, ex as (
  select event_id,
    case event_id % 6 when 0 then null when 1 then '' when 2 then strftime(ts, '%Y:%m:%d %H:%M:%S')
         when 3 then 'garbage' when 4 then strftime(ts, '%Y:%m:%d')
         else strftime(ts, '%Y:%-m:%-d %H:%M:%S') end as dt_original,
    case when event_id % 4 = 0 then strftime(ts - interval 1 day, '%Y:%m:%d %H:%M:%S') end as dt_digitized,
    case when event_id % 3 <> 0 then strftime(ts - interval 2 day, '%Y:%m:%d %H:%M:%S') end as dt,
    ts as mtime
  from events
)
select event_id, coalesce({_EXIF_P17.format(c='dt_original')}, {_EXIF_P17.format(c='dt_digitized')},
                          {_EXIF_P17.format(c='dt')}, strftime(mtime, '%Y-%m-%d')) as capture_date
from ex
""")


# --- J5 / P19-P24 / W2 / A10 / A11 ------------------------------------------------------

ROUTE_BASE = "/srv/sorted"
LONG_ROUTE_BASE = "/srv/" + "deep/" * 44


def _listing(spark, sf_dir):
    """Files still present: every image except one in thirteen (removed since the run)."""
    return images(spark, sf_dir).filter(F.col("img") % 13 != 5).select(F.col("image_path").alias("path"))


def q_routing_plan(spark, sf_dir):
    plan = rt.routing_plan(detections_table(spark, sf_dir), names(spark, sf_dir), ROUTE_BASE, by_date=True,
                           listing=_listing(spark, sf_dir))
    return plan.select("image_path", "folder_name", "folder_key", "target_dir")


def _route_sql(base: str, by_date: bool, name: str = "plan") -> str:
    date_expr = ("case when trim(image_date) <> '' then trim(image_date) else 'unknown-date' end"
                 if by_date else "''")
    parent = f"'{base.rstrip('/')}/' || r_date" if by_date else f"'{base.rstrip('/')}'"
    rel = "r_date || '/' || " if by_date else ""
    return ORACLE_LABELED + f"""
, {name}_f as (
  select l.*, {date_expr} as r_date,
    case when l.t_species = '' or (lower(l.t_species) in {_LABELS_SQL}
                                   and (l.t_common = '' or lower(l.t_common) in {_LABELS_SQL}))
           then '未検出_No_Detection'
         else (case when trim(left(translate(
                  case when v.vern <> '' and v.vern <> l.species then v.vern || '_' || l.species
                       when l.common_name <> '' and l.common_name <> l.species then l.common_name || '_' || l.species
                       else l.species end, '<>:"/\\|?*', '_________'), 100)) = '' then 'Unknown_Species'
               else left(translate(
                  case when v.vern <> '' and v.vern <> l.species then v.vern || '_' || l.species
                       when l.common_name <> '' and l.common_name <> l.species then l.common_name || '_' || l.species
                       else l.species end, '<>:"/\\|?*', '_________'), 100) end)
    end as folder_name
  from labeled_in l
  join (select li.image_path,
               case when li.t_jp <> '' then li.t_jp
                    when li.t_sci <> '' then coalesce(sp.name_value, ge.name_value, '') else '' end as vern
        from labeled_in li
        left join sp_names sp on li.t_jp = '' and li.t_sci <> '' and sp.name_key = li.t_sci
        left join ge_names ge on li.t_jp = '' and li.t_sci <> '' and ge.name_key =
             case when li.t_sci like '% %' then split_part(li.t_sci, ' ', 1) else li.t_sci end) v
    on v.image_path = l.image_path
),
{name}_s as (
  select *, {parent} as parent,
    case when length({parent} || '/' || folder_name) >= 240
         then left(folder_name, 40) || '_' || left(sha1(folder_name), 8) else folder_name end as seg
  from {name}_f
),
{name} as (
  select img, image_path, image_name, folder_name, parent || '/' || seg as target_dir,
         {rel}seg as folder_key
  from {name}_s
)
"""


SQL_ROUTING_PLAN = oracle(_route_sql(ROUTE_BASE, True) + """
select image_path, folder_name, folder_key, target_dir from plan
where img % 13 <> 5
""")


def q_routing_long_paths(spark, sf_dir):
    plan = rt.routing_plan(detections_table(spark, sf_dir), names(spark, sf_dir), LONG_ROUTE_BASE)
    return plan.select("image_path", "folder_key", "target_dir")


SQL_ROUTING_LONG_PATHS = oracle(_route_sql(LONG_ROUTE_BASE, False)
                                + "select image_path, folder_key, target_dir from plan")


def _dedup(spark, sf_dir):
    plan = rt.routing_plan(detections_table(spark, sf_dir), names(spark, sf_dir), ROUTE_BASE)
    plan = materialize(plan)  # also the source of the "existing files" below
    # files already in the target folders: the name itself and its _001 twin, for one image in 17
    pre = plan.filter(F.col("img") % 17 == 0)
    existing = pre.select("target_dir", F.col("image_name").alias("file_name")).unionByName(
        pre.select("target_dir", F.regexp_replace("image_name", r"\.JPG$", "_001.JPG").alias("file_name")))
    return rt.dedup_destinations(plan, existing)


def q_routing_dedup(spark, sf_dir):
    return _dedup(spark, sf_dir).select("image_path", "dest_name", "dest_path")


_DEDUP_SQL = _route_sql(ROUTE_BASE, False) + """
, existing as (
  select distinct target_dir, file_name from (
    select target_dir, image_name as file_name from plan where img % 17 = 0
    union all
    select target_dir, regexp_replace(image_name, '\\.JPG$', '_001.JPG') from plan where img % 17 = 0)
),
ranked as (
  select p.*, row_number() over (partition by p.target_dir, p.image_name order by p.img) as k,
         regexp_extract(p.image_name, '^(.+?)(\\.[^.]+)?$', 1) as stem,
         regexp_extract(p.image_name, '^(.+?)(\\.[^.]+)?$', 2) as ext,
         e.file_name is not null as name_exists
  from plan p left join existing e on e.target_dir = p.target_dir and e.file_name = p.image_name
),
kept as (select * from ranked where k = 1 and not name_exists),
claimed as (
  select target_dir, file_name from existing
  union select target_dir, image_name from kept
),
claims as (
  select distinct target_dir,
         regexp_extract(c_stem, '^(.*)_([0-9]+)$', 1) || c_ext as image_name,
         cast(regexp_extract(c_stem, '^(.*)_([0-9]+)$', 2) as bigint) as n
  from (select target_dir, regexp_extract(file_name, '^(.+?)(\\.[^.]+)?$', 1) as c_stem,
               regexp_extract(file_name, '^(.+?)(\\.[^.]+)?$', 2) as c_ext from claimed) c
  where regexp_extract(c_stem, '^(.*)_([0-9]+)$', 2) <> ''
    and printf('%03d', cast(regexp_extract(c_stem, '^(.*)_([0-9]+)$', 2) as bigint))
        = regexp_extract(c_stem, '^(.*)_([0-9]+)$', 2)
),
requests as (
  select r.*, row_number() over (partition by target_dir, image_name order by img) as rq
  from ranked r where not (k = 1 and not name_exists)
),
grp as (
  select q.target_dir, q.image_name, count(*) + coalesce(max(cc.c), 0) as total
  from requests q left join (select target_dir, image_name, count(*) as c from claims group by 1, 2) cc
    on cc.target_dir = q.target_dir and cc.image_name = q.image_name
  group by q.target_dir, q.image_name
),
cands as (
  select target_dir, image_name, unnest(range(1, total + 1)) as n from grp
),
free as (
  select c.target_dir, c.image_name, c.n,
         row_number() over (partition by c.target_dir, c.image_name order by c.n) as rq
  from cands c
  where not exists (select 1 from claims x where x.target_dir = c.target_dir
                    and x.image_name = c.image_name and x.n = c.n)
),
dedup as (
  select img, image_path, target_dir, folder_key, image_name as dest_name from kept
  union all
  select q.img, q.image_path, q.target_dir, q.folder_key,
         case when f.n <= 9999 then q.stem || '_' || printf('%03d', f.n) || q.ext
              else q.stem || '_overflow_' || cast(f.n as varchar) || q.ext end
  from requests q join free f on f.target_dir = q.target_dir and f.image_name = q.image_name and f.rq = q.rq
)
"""

SQL_ROUTING_DEDUP = oracle(_DEDUP_SQL + """
select image_path, dest_name, target_dir || '/' || dest_name as dest_path from dedup
""")


def q_routing_manifest(spark, sf_dir):
    return rt.folder_counts(_dedup(spark, sf_dir))


SQL_ROUTING_MANIFEST = oracle(_DEDUP_SQL + """
select folder_key, cast(count(*) as bigint) as file_count, min(dest_name) as first_file,
       max(dest_name) as last_file, min(img) as first_seen
from dedup group by folder_key
""")


def q_routing_stats(spark, sf_dir):
    return rt.routing_stats(rt.folder_counts(_dedup(spark, sf_dir)))


SQL_ROUTING_STATS = oracle(_DEDUP_SQL + """
, fc as (select folder_key, count(*) as file_count, min(img) as first_seen from dedup group by folder_key)
select cast(count(*) as bigint) as total_folders, cast(sum(file_count) as bigint) as total_files,
       avg(file_count) as average_files_per_folder,
       arg_max(folder_key, file_count * 100000000 - first_seen) as largest_folder,
       cast(max(file_count) as bigint) as largest_folder_files
from fc
""")


# --- W3 --------------------------------------------------------------------------------

BREAKER_LIMIT = 3


def q_circuit_breaker(spark, sf_dir):
    return inc.failure_streaks(fixture(spark, sf_dir, "chunk_log"), BREAKER_LIMIT)


SQL_CIRCUIT_BREAKER = oracle(f"""
, fl as (
  select chunk_no, chunk_no - row_number() over (order by chunk_no) as island from chunk_log where failed
),
runs as (
  select min(chunk_no) as run_start, max(chunk_no) as run_end, cast(count(*) as bigint) as run_length
  from fl group by island
),
r2 as (
  select *, run_length >= {BREAKER_LIMIT} as tripped,
         case when run_length >= {BREAKER_LIMIT} then run_start + {BREAKER_LIMIT - 1} end as trip_chunk
  from runs
)
select run_start, run_end, run_length, tripped, trip_chunk,
       coalesce(trip_chunk = min(trip_chunk) over (), false) as first_trip
from r2
""")


# --- U1 / T1-T6 ----------------------------------------------------------------------------

def q_score_batch(spark, sf_dir):
    """The test scorer applied to every row of ``embeddings`` in Arrow batches."""
    from trapline.operators.scoring import embedding_argmax_factory, score_images

    emb = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    imgs = emb.select(F.concat(F.lit("/emb/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image_path"),
                      "embedding", "label")
    preds = score_images(imgs, embedding_argmax_factory, input_cols=("embedding", "label"))
    return preds.select("image_path", "det_index", "prediction", F.col("prediction_score").cast("double").alias("prediction_score"))


SQL_SCORE_BATCH = """
select '/emb/' || cast(vec_id as varchar) || '.jpg' as image_path, cast(0 as int) as det_index,
       'u' || cast(idx as varchar) || ';mammalia;o;f;genus' || cast(idx as varchar) || ';sp' || cast(label as varchar)
         || ';dim ' || cast(idx as varchar) as prediction,
       least(cast(1 as double), 4 * cast(mx as double)) as prediction_score
from (select vec_id, label, list_position(embedding, list_max(embedding)) - 1 as idx,
             list_max(embedding) as mx from embeddings) e
"""

TABLE_OUT = ["image_path", "image_name", "image_date", "species", "scientific_name", "confidence", "category",
             "common_name", "japanese_name"]


def _shape_stream_batch(sf_dir: str):
    def shape(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        preds = batch.filter(F.col("prediction").isNotNull())
        best = det.best_per_image(det.parse_predictions(preds, names(spark, sf_dir), threshold=THRESHOLD))
        imgs = batch.groupBy("image_path").agg(  # one row per image (partial aggregate)
            *[F.first(c).alias(c) for c in ("img", "image_name", "image_date", "seen_order")])
        return det.detections_table(imgs, best.drop("det_index"))
    return shape


def q_stream_ingest(spark, sf_dir):
    """Model output arriving as files, ingested in micro-batches into the table.

    The source files hold one row per prediction (images without one get a
    row with a null prediction), written by Spark from the fixture and
    partitioned by image so a file holds whole images.  Each micro-batch is
    shaped exactly like the batch job, so the streamed table equals the batch
    detections table.
    """
    from trapline.session import scratch_dir
    from trapline.sinks.tables import read_table
    from trapline.streaming.ingest import ingest_stream

    base = scratch_dir(spark, "stream-ingest")
    src, table, ckpt = f"{base}/source", f"{base}/table", f"{base}/checkpoint"
    preds = fixture(spark, sf_dir, "predictions").select("image_path", "det_index", "prediction",
                                                         "prediction_score")
    (images(spark, sf_dir).join(preds, "image_path", "left")
     .repartition("image_path").write.mode("overwrite").parquet(src))
    schema = spark.read.parquet(src).schema
    ingest_stream(spark, src, schema, _shape_stream_batch(sf_dir), table, ckpt, max_files_per_trigger=4,
                  error_col=None)
    return read_table(spark, table).select(*TABLE_OUT)


SQL_STREAM_INGEST = oracle(ORACLE_TABLE + f"select {', '.join(TABLE_OUT)} from dtable")


# --- A1 / A3 / A4 / A5 over every detection (Q21) -------------------------------------------

def _dets(spark, sf_dir):
    return parsed(spark, sf_dir).withColumn("seen_order", F.col("img"))


def q_all_detections_totals(spark, sf_dir):
    return rep.detection_totals(images(spark, sf_dir), _dets(spark, sf_dir))


SQL_ALL_DETECTIONS_TOTALS = oracle(ORACLE_PARSED + """
, per as (select image_path, count(*) as n from parsed group by image_path),
j as (select i.image_path, per.n from images i left join per on per.image_path = i.image_path)
select cast(count(*) as bigint) as total_images, cast(count(n) as bigint) as detected_images,
       cast(coalesce(sum(n), 0) as bigint) as total_detections,
       cast(count(*) - count(n) as bigint) as undetected_images,
       case when count(*) = 0 then cast(0 as double) else count(n) * 100.0 / count(*) end as success_rate
from j
""")


def q_all_detections_species(spark, sf_dir):
    return rep.detection_species_frequency(_dets(spark, sf_dir))


SQL_ALL_DETECTIONS_SPECIES = oracle(ORACLE_PARSED + """
, f as (select species, count(*) as n, min(img * 10 + det_index) as first_seen from parsed group by species)
select species, cast(n as bigint) as n, n * 100.0 / sum(n) over () as pct,
       cast(row_number() over (order by n desc, first_seen) as int) as rank
from f
""")


def q_all_detections_categories(spark, sf_dir):
    return rep.detection_category_frequency(_dets(spark, sf_dir), names(spark, sf_dir))


SQL_ALL_DETECTIONS_CATEGORIES = oracle(ORACLE_PARSED + """
, f as (select category, count(*) as n, min(img * 10 + det_index) as first_seen from parsed group by category)
select f.category, cast(f.n as bigint) as n, f.n * 100.0 / sum(f.n) over () as pct,
       cast(row_number() over (order by f.n desc, f.first_seen) as int) as rank,
       case when f.category = '' then '' else coalesce(c.name_value, f.category) end as category_label
from f left join cat_names c on c.name_key = f.category
""")


def q_all_detections_bands(spark, sf_dir):
    return rep.confidence_bands(_dets(spark, sf_dir), only_detected=False)


SQL_ALL_DETECTIONS_BANDS = oracle(ORACLE_PARSED + """
, bands(band, band_label) as (
  select * from (values (0, '0.9-1.0 (非常に高い)'), (1, '0.7-0.9 (高い)'), (2, '0.5-0.7 (中程度)'),
                        (3, '0.3-0.5 (低い)'), (4, '0.0-0.3 (非常に低い)')) v(band, band_label)
),
bc as (
  select case when isnan(confidence) then 4 when confidence >= 0.9 then 0 when confidence >= 0.7 then 1
              when confidence >= 0.5 then 2 when confidence >= 0.3 then 3 else 4 end as band,
         count(*) as n
  from parsed group by 1
)
select b.band, b.band_label, cast(coalesce(bc.n, 0) as bigint) as n from bands b left join bc on bc.band = b.band
""")


# --- U2 over bytes Spark builds from events ---------------------------------------------

def _jpeg_bytes(spark, sf_dir):
    """Small JPEGs with an EXIF block (little-endian TIFF, fixed layout) built from ``events``.

    DateTime (306) = ts - 2 days; DateTimeOriginal (36867) = ts - 1 day, or blank
    for every third event; every fifth event has no EXIF at all (file time = ts).
    """
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts")
    fmt = "yyyy:MM:dd HH:mm:ss"
    dt = F.date_format(F.col("ts") - F.expr("INTERVAL 2 DAYS"), fmt)
    orig = F.when(F.col("event_id") % 3 == 0, F.lit(" " * 19)).otherwise(
        F.date_format(F.col("ts") - F.expr("INTERVAL 1 DAY"), fmt))
    tiff = F.concat(
        F.unhex(F.lit("49492A0008000000")),                          # header, IFD0 at 8
        F.unhex(F.lit("0200" "320102001400000038000000" "698704000100000026000000" "00000000")),
        F.unhex(F.lit("0100" "03900200140000004C000000" "00000000")),  # Exif IFD at 38
        F.encode(dt, "US-ASCII"), F.unhex(F.lit("00")),                  # 56: DateTime
        F.encode(orig, "US-ASCII"), F.unhex(F.lit("00")))                # 76: DateTimeOriginal
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE10068")), F.encode(F.lit("Exif"), "US-ASCII"), F.unhex(F.lit("0000")),
                    tiff, F.unhex(F.lit("FFD9")))
    content = F.when(F.col("event_id") % 5 == 0, F.encode(F.lit("no exif here"), "US-ASCII")).otherwise(jpeg)
    return ev.select("event_id", F.col("ts").alias("mtime"), content.alias("content"))


def q_exif_read(spark, sf_dir):
    """U2 + P18: EXIF tags read from image bytes in Arrow batches, then the capture date."""
    from trapline.sources.exif import exif_columns

    tags = exif_columns(_jpeg_bytes(spark, sf_dir), keep=("event_id", "mtime"))
    return tags.select("event_id", capture_date("dt_original", "dt_digitized", "dt", "mtime").alias("capture_date"))


SQL_EXIF_READ = """
select event_id,
       case when event_id % 5 = 0 then strftime(ts, '%Y-%m-%d')
            when event_id % 3 = 0 then strftime(ts - interval 2 day, '%Y-%m-%d')
            else strftime(ts - interval 1 day, '%Y-%m-%d') end as capture_date
from events
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "parse_predictions": (q_parse_predictions, SQL_PARSE_PREDICTIONS),
    "structured_or_string": (q_structured_or_string, SQL_STRUCTURED_OR_STRING),
    "score_text_filter": (q_score_text_filter, SQL_SCORE_TEXT_FILTER),
    "best_detection": (q_best_detection, SQL_BEST_DETECTION),
    "best_bbox": (q_best_bbox, SQL_BEST_BBOX),
    "detections_per_image": (q_detections_per_image, SQL_DETECTIONS_PER_IMAGE),
    "detail_top3": (q_detail_top3, SQL_DETAIL_TOP3),
    "vernacular_names": (q_vernacular_names, SQL_VERNACULAR_NAMES),
    "category_labels": (q_category_labels, SQL_CATEGORY_LABELS),
    "resume_pending": (q_resume_pending, SQL_RESUME_PENDING),
    "resume_union": (q_resume_union, SQL_RESUME_UNION),
    "run_summary": (q_run_summary, SQL_RUN_SUMMARY),
    "summary_totals": (q_summary_totals, SQL_SUMMARY_TOTALS),
    "species_frequency": (q_species_frequency, SQL_SPECIES_FREQUENCY),
    "category_frequency": (q_category_frequency, SQL_CATEGORY_FREQUENCY),
    "confidence_bands": (q_confidence_bands, SQL_CONFIDENCE_BANDS),
    "summary_report": (q_summary_report, SQL_SUMMARY_REPORT),
    "species_list": (q_species_list, SQL_SPECIES_LIST),
    "daily_label_counts": (q_daily_label_counts, SQL_DAILY_LABEL_COUNTS),
    "daily_label_pivot": (q_daily_label_pivot, SQL_DAILY_LABEL_PIVOT),
    "result_metadata": (q_result_metadata, SQL_RESULT_METADATA),
    "result_page": (q_result_page, SQL_RESULT_PAGE),
    "exif_date_text": (q_exif_date_text, SQL_EXIF_DATE_TEXT),
    "routing_plan": (q_routing_plan, SQL_ROUTING_PLAN),
    "routing_long_paths": (q_routing_long_paths, SQL_ROUTING_LONG_PATHS),
    "routing_dedup": (q_routing_dedup, SQL_ROUTING_DEDUP),
    "routing_manifest": (q_routing_manifest, SQL_ROUTING_MANIFEST),
    "routing_stats": (q_routing_stats, SQL_ROUTING_STATS),
    "circuit_breaker": (q_circuit_breaker, SQL_CIRCUIT_BREAKER),
    "all_detections_totals": (q_all_detections_totals, SQL_ALL_DETECTIONS_TOTALS),
    "all_detections_species": (q_all_detections_species, SQL_ALL_DETECTIONS_SPECIES),
    "all_detections_categories": (q_all_detections_categories, SQL_ALL_DETECTIONS_CATEGORIES),
    "all_detections_bands": (q_all_detections_bands, SQL_ALL_DETECTIONS_BANDS),
    "exif_read": (q_exif_read, SQL_EXIF_READ),
    "score_batch": (q_score_batch, SQL_SCORE_BATCH),
    "stream_ingest": (q_stream_ingest, SQL_STREAM_INGEST),
}
