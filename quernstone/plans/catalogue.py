"""Every query of the reference's operators, with its SQL.

A query and its SQL stand together: `@query(name, sql)` registers both. Rounding is half to even
on scaled values in both engines, and patterns are ASCII, so that results agree bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import captions as cap
from quernstone.functions import geometry as geo
from quernstone.functions import pixels, raster
from quernstone.operators import detection, manifest, numbering
from quernstone.plans import fixtures as fx
from quernstone.plans import runs
from quernstone.sources import manifest as files
from quernstone.sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SIZES = (256, 512, 768, 1024)
ID = "image_id, det"


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return detection.by_score(fx.regions(spark, sf), 0.8)


def _tasks(spark: SparkSession, sf: str) -> int | None:
    return fx.tasks(fx.table(spark, sf, "lineitem"))


# -- detections ----------------------------------------------------------------


@query("regions_score_filter", f"WITH {fx.REGIONS} SELECT {ID}, score FROM regions WHERE score >= 0.8e0")
def _(spark, sf):
    return kept(spark, sf).select("image_id", "det", "score")


@query("regions_class_filter", f"WITH {fx.REGIONS} SELECT {ID}, label FROM regions WHERE label IN ('face', 'person')")
def _(spark, sf):
    return detection.by_class(fx.regions(spark, sf), detection.class_names("Face, person", ["face", "person", "dog"])).select("image_id", "det", "label")


_RANKED = fx.KEPT + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, det) - 1 AS rank, count(*) OVER (PARTITION BY image_id) AS n FROM kept)"


@query("regions_area_rank", f"WITH {_RANKED} SELECT {ID}, rank::INTEGER AS rank FROM ranked")
def _(spark, sf):
    return detection.with_rank(kept(spark, sf)).select("image_id", "det", "rank")


@query("multi_largest", f"WITH {_RANKED} SELECT {ID}, w, h FROM ranked WHERE rank = 0")
def _(spark, sf):
    return detection.pick(kept(spark, sf), "largest").select("image_id", "det", "w", "h")


@query("multi_skip", f"WITH {_RANKED} SELECT {ID} FROM ranked WHERE n = 1")
def _(spark, sf):
    return detection.pick(kept(spark, sf), "skip").select("image_id", "det")


@query("multi_skip_log", f"WITH {_RANKED} SELECT image_id, 'multi' AS reason, n || ' detections' AS detail FROM ranked WHERE n > 1 AND rank = 0")
def _(spark, sf):
    return detection.several(kept(spark, sf))


@query("max_per_image", f"WITH {_RANKED} SELECT {ID} FROM ranked WHERE rank < 2")
def _(spark, sf):
    return detection.pick(kept(spark, sf), "all", 2).select("image_id", "det")


@query("no_detection", f"WITH {fx.REGIONS} SELECT image_id, 'no_detection' AS reason FROM images WHERE image_id NOT IN (SELECT image_id FROM regions)")
def _(spark, sf):
    return detection.undetected(fx.images(spark, sf), fx.regions(spark, sf))


@query("one_per_photo", f"WITH {_RANKED} SELECT image_id, n::INTEGER AS n_boxes, w, h FROM ranked WHERE rank = 0")
def _(spark, sf):
    return detection.one_per_photo(kept(spark, sf)).select("image_id", F.size("boxes").alias("n_boxes"), "w", "h")


@query("skip_detection", f"WITH {fx.IMAGES} SELECT image_id, iw AS w, ih AS h, 'image' AS label, 0e0 AS score FROM images")
def _(spark, sf):
    return detection.whole_image(fx.images(spark, sf)).select("image_id", "w", "h", "label", "score")


@query("nms_per_class", f"""WITH RECURSIVE {fx.KEPT}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det) AS k FROM kept),
fold AS (
  SELECT image_id, label, 0::BIGINT AS k, []::STRUCT(det BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS acc FROM (SELECT DISTINCT image_id, label FROM ordered)
  UNION ALL
  SELECT f.image_id, f.label, o.k, CASE WHEN len(list_filter(f.acc, lambda b:
      CASE WHEN b.w * b.h + o.w * o.h - greatest(least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x), 0e0) * greatest(least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y), 0e0) > 0
           THEN greatest(least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x), 0e0) * greatest(least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y), 0e0)
                / (b.w * b.h + o.w * o.h - greatest(least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x), 0e0) * greatest(least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y), 0e0))
           ELSE 0e0 END > 0.45e0)) > 0
      THEN f.acc ELSE list_append(f.acc, {{'det': o.det, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}}) END
  FROM fold f JOIN ordered o ON o.image_id = f.image_id AND o.label = f.label AND o.k = f.k + 1),
final AS (SELECT image_id, label, acc FROM fold QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY k DESC) = 1)
SELECT image_id, label, b.det AS det FROM (SELECT image_id, label, unnest(acc) AS b FROM final)""")
def _(spark, sf):
    return detection.suppress(kept(spark, sf)).select("image_id", "label", "det")


@query("unletterbox_clip", f"""WITH {fx.KEPT}, r AS (SELECT *, least(640e0 / ih, 640e0 / iw) AS ratio FROM kept),
b AS (SELECT image_id, det, greatest(x * ratio / ratio, 0e0) AS "left", greatest(y * ratio / ratio, 0e0) AS top, least((x * ratio + w * ratio) / ratio, iw) AS r0, least((y * ratio + h * ratio) / ratio, ih) AS b0 FROM r)
SELECT image_id, det, "left", top, r0 - "left" AS width, b0 - top AS height FROM b WHERE r0 - "left" >= 1 AND b0 - top >= 1""")
def _(spark, sf):
    rows = kept(spark, sf).withColumn("ratio", detection.letterbox_ratio(F.col("iw"), F.col("ih")))
    scaled = [F.col(c) * F.col("ratio") for c in ("x", "y", "w", "h")]
    box = detection.unletterbox(*scaled, F.col("ratio"), F.col("iw"), F.col("ih"))
    return rows.select("image_id", "det", *[v.alias(k) for k, v in box.items()]).where("width >= 1 and height >= 1")


@query("class_argmax", f"WITH {fx.RASTERS} SELECT vec_id, (list_position(logits, list_max(logits)) - 1)::INTEGER AS class_index, 0.5e0 * list_max(logits) AS confidence FROM rasters")
def _(spark, sf):
    best = detection.best_class(F.lit(0.5), F.col("logits"))
    return fx.rasters(spark, sf).select("vec_id", *[v.alias(k) for k, v in best.items()])


@query("haar_score_squash", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0e0, least(1e0, (l_quantity - 10e0) / 5e0)) AS score FROM lineitem")
def _(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", detection.squash(F.col("l_quantity") - 10.0).alias("score"))


@query("detector_offset", "SELECT r_regionkey, coalesce(CASE WHEN r_regionkey % 2 = 0 THEN NULL END, CASE WHEN r_regionkey < 3 THEN -0.08e0 ELSE 0e0 END) AS offset_y FROM region")
def _(spark, sf):
    default = F.when(F.col("r_regionkey") < 3, -0.08).otherwise(0.0)
    return fx.table(spark, sf, "region").select("r_regionkey", detection.offset_y(None, default).alias("offset_y"))


_ANCHOR = "round_even({0} * 1e6, 0) / 1e6"


@query("anchor_decode", f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS dx, l_tax AS dy, l_quantity / 10e0 - 2e0 AS dw, l_quantity - 25e0 AS dh, l_partkey % 80 AS gx, l_suppkey % 80 AS gy,
  CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ANCHOR.format('(dx + gx) * stride')} AS cx, {_ANCHOR.format('(dy + gy) * stride')} AS cy,
  {_ANCHOR.format('exp(greatest(-20e0, least(20e0, dw))) * stride')} AS w, round_even(exp(greatest(-20e0, least(20e0, dh))) * stride / 1e3, 0) AS h FROM a""")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").withColumn("stride", F.when(F.col("l_linenumber") % 3 == 0, 8).when(F.col("l_linenumber") % 3 == 1, 16).otherwise(32))
    box = detection.decode_anchor(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 10.0 - 2.0, F.col("l_quantity") - 25.0, F.col("l_partkey") % 80, F.col("l_suppkey") % 80, F.col("stride"))
    fine = {k: F.rint(v * 1e6) / 1e6 for k, v in box.items()} | {"h": F.rint(box["h"] / 1e3)}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(k) for k, v in fine.items()])


@query("detect_plug_in", f"""WITH {fx.RASTERS}, p AS (SELECT vec_id, list_transform(luma, lambda v: round_even(v * 255e0, 0)) AS g FROM rasters),
on_px AS (SELECT vec_id, len(list_filter(g, lambda v: v >= 128)) AS n, list_filter(range(64), lambda i: g[i + 1] >= 128) AS px FROM p)
SELECT vec_id, 0 AS det, list_min(list_transform(px, lambda i: i % 8))::DOUBLE AS x, list_min(list_transform(px, lambda i: i // 8))::DOUBLE AS y,
  (list_max(list_transform(px, lambda i: i % 8)) - list_min(list_transform(px, lambda i: i % 8)) + 1)::DOUBLE AS w, (list_max(list_transform(px, lambda i: i // 8)) - list_min(list_transform(px, lambda i: i // 8)) + 1)::DOUBLE AS h,
  n / 64 AS score FROM on_px WHERE n > 0""")
def _(spark, sf):
    detection.register_detector("bright", fx.Bright)
    photos = fx.photos(spark, sf).withColumnRenamed("vec_id", "image_id")
    found = detection.regions_of(detection.detect(photos, "bright", pixels.decode))
    return found.select(F.col("image_id").alias("vec_id"), "det", "x", "y", "w", "h", "score")


# -- geometry ------------------------------------------------------------------


@query("base_side_modes", f"""WITH {fx.KEPT} SELECT {ID}, greatest(w, h) AS "max", (w + h) / 2e0 AS mean, w AS width, h AS height, sqrt(w * w + h * h) / sqrt(2e0) AS diag FROM kept""")
def _(spark, sf):
    w, h = F.col("w"), F.col("h")
    return kept(spark, sf).select("image_id", "det", *[geo.base_side(w, h, m).alias(m) for m in ("max", "mean", "width", "height", "diag")])


@query("choose_tier", f"WITH {fx.KEPT} SELECT {ID}, {fx.tier_sql('greatest(w, h)')} AS tier FROM kept")
def _(spark, sf):
    return kept(spark, sf).select("image_id", "det", geo.choose_tier(geo.base_side(F.col("w"), F.col("h")), SIZES, 0.8).alias("tier"))


@query("choose_tier_theta_join", f"WITH {fx.KEPT}, s AS (SELECT unnest([256, 512, 768, 1024]) AS size) SELECT {ID}, max(size) AS tier FROM kept JOIN s ON greatest(w, h) >= 0.8e0 * size GROUP BY ALL")
def _(spark, sf):
    sizes = spark.createDataFrame([(s,) for s in SIZES], "size int")  # as many rows as configured sizes
    return kept(spark, sf).join(F.broadcast(sizes), F.greatest("w", "h") >= 0.8 * F.col("size")).groupBy("image_id", "det").agg(F.max("size").alias("tier"))


_PLAN = "tier, base_side, padded_side, fitted_side, crop_x, crop_y, clamped, extends, reject"
for _edge in ("shift", "extend", "skip"):

    @query(f"plan_crop_{_edge}", f"WITH {fx.KEPT}, {fx.plan_sql(_edge)} SELECT {ID}, {_PLAN} FROM plans")
    def _(spark, sf, edge=_edge):
        return geo.plan_crops(kept(spark, sf), edge=edge).select("image_id", "det", *_PLAN.split(", "))


@query("retier", f"WITH {fx.KEPT}, {fx.plan_sql('shift')} SELECT {ID}, tier, fitted_side FROM plans WHERE fitted_side < base_side")
def _(spark, sf):
    return geo.plan_crops(kept(spark, sf)).where("fitted_side < base_side").select("image_id", "det", "tier", "fitted_side")


@query("plan_whole", f"WITH {fx.IMAGES} SELECT image_id, {fx.tier_sql('greatest(iw, ih)', (1024, 2048, 3072))} AS tier, greatest(iw, ih) AS base_side, CASE WHEN greatest(iw, ih) < 819.2e0 THEN 'image is ' || round_even(greatest(iw, ih), 0)::BIGINT || 'px, needs >=819px for the 1024 tier' END AS reject FROM images")
def _(spark, sf):
    plan = geo.plan_whole(F.col("iw"), F.col("ih"), (1024, 2048, 3072))
    return fx.images(spark, sf).select("image_id", *[v.alias(k) for k, v in plan.items()])


@query("plan_native", f"WITH {fx.IMAGES} SELECT image_id, CASE WHEN greatest(iw, ih) >= 1500 THEN least(greatest(iw, ih), 3000e0)::INTEGER END AS tier, greatest(iw, ih) AS base_side, CASE WHEN greatest(iw, ih) < 1500 THEN 'image is ' || greatest(iw, ih)::BIGINT || 'px, needs >=1500px' END AS reject FROM images")
def _(spark, sf):
    plan = geo.plan_native(F.col("iw"), F.col("ih"), 1500, 3000)
    return fx.images(spark, sf).select("image_id", *[v.alias(k) for k, v in plan.items()])


_ROUNDED = """rounded AS (SELECT *, round_even(crop_x, 0)::BIGINT AS "left", round_even(crop_y, 0)::BIGINT AS top,
  greatest(round_even(crop_x + fitted_side, 0)::BIGINT, round_even(crop_x, 0)::BIGINT + 1) AS "right", greatest(round_even(crop_y + fitted_side, 0)::BIGINT, round_even(crop_y, 0)::BIGINT + 1) AS bottom
  FROM plans WHERE reject IS NULL)"""


def _rounded(spark, sf):
    plans = geo.plan_crops(kept(spark, sf), edge="extend").where("reject is null")
    box = geo.rounded_box(F.col("crop_x"), F.col("crop_y"), F.col("fitted_side"), F.col("fitted_side"))
    return plans.withColumns(box)


@query("rounded_box", f'WITH {fx.KEPT}, {fx.plan_sql("extend")}, {_ROUNDED} SELECT {ID}, "left", top, "right", bottom FROM rounded')
def _(spark, sf):
    return _rounded(spark, sf).select("image_id", "det", "left", "top", "right", "bottom")


@query("output_size", f"""WITH {fx.IMAGES}, t AS (SELECT *, greatest(iw, ih) AS l, {fx.tier_sql('greatest(iw, ih)')} AS tier FROM images)
SELECT image_id, CASE WHEN iw = l THEN tier::BIGINT ELSE greatest(round_even(iw * tier / l, 0)::BIGINT, 1) END AS out_w, CASE WHEN ih = l THEN tier::BIGINT ELSE greatest(round_even(ih * tier / l, 0)::BIGINT, 1) END AS out_h, tier / l AS scale FROM t""")
def _(spark, sf):
    tier = geo.plan_whole(F.col("iw"), F.col("ih"), SIZES)["tier"]
    size = geo.output_size(F.col("iw"), F.col("ih"), tier)
    return fx.images(spark, sf).select("image_id", *[v.alias(k) for k, v in size.items()], (tier / F.greatest("iw", "ih")).alias("scale"))


@query("project_box", f'WITH {fx.KEPT}, {fx.plan_sql("extend")}, {_ROUNDED} SELECT {ID}, (x - "left") * (tier / ("right" - "left")) AS px, (y - top) * (tier / (bottom - top)) AS py, w * (tier / ("right" - "left")) AS pw, h * (tier / (bottom - top)) AS ph FROM rounded')
def _(spark, sf):
    box = geo.project_box({c: F.col(c) for c in "xywh"}, {c: F.col(c) for c in ("left", "top", "right", "bottom")}, F.col("tier"), F.col("tier"))
    return _rounded(spark, sf).select("image_id", "det", *[v.alias(k) for k, v in box.items()])


@query("reject_reasons", f"WITH {fx.KEPT}, {fx.plan_sql('skip')} SELECT reject, count(*) AS n FROM plans WHERE reject IS NOT NULL GROUP BY reject")
def _(spark, sf):
    return geo.plan_crops(kept(spark, sf), edge="skip").where("reject is not null").groupBy("reject").agg(F.count("*").alias("n"))


# -- crops, numbers, statistics --------------------------------------------------

_CROPS = f"""{fx.KEPT}, {fx.plan_sql('shift')},
crops AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, det) - 1 AS face_index, count(*) OVER (PARTITION BY image_id) AS faces_in_image FROM plans WHERE reject IS NULL AND sharp >= 10e0),
numbered AS (SELECT *, row_number() OVER (ORDER BY image_id, face_index) AS "index" FROM crops),
skips AS (
  SELECT image_id, det, CASE WHEN reject IS NOT NULL THEN 'too_small' ELSE 'blurry' END AS reason, coalesce(reject, '') AS detail FROM plans WHERE reject IS NOT NULL OR sharp < 10e0
  UNION ALL SELECT image_id, NULL, 'no_detection', '' FROM images WHERE image_id NOT IN (SELECT image_id FROM kept))"""


def crops(spark: SparkSession, sf: str) -> DataFrame:
    """Kept crops with their positions in their image."""
    plans = geo.plan_crops(detection.with_rank(kept(spark, sf)))
    return numbering.face_positions(plans.where("reject is null and sharp >= 10.0"))


def skips(spark: SparkSession, sf: str) -> DataFrame:
    plans = geo.plan_crops(kept(spark, sf))
    lost = plans.where("reject is not null or sharp < 10.0").select("image_id", F.col("det").cast("long").alias("det"), F.when(F.col("reject").isNotNull(), "too_small").otherwise("blurry").alias("reason"), F.coalesce("reject", F.lit("")).alias("detail"))
    none = detection.undetected(fx.images(spark, sf), kept(spark, sf))
    return lost.unionByName(none.select("image_id", F.lit(None).cast("long").alias("det"), "reason", F.lit("").alias("detail")))


@query("crop_manifest", f"""WITH {_CROPS} SELECT "index", image_id, CASE WHEN "index" < 1000 THEN lpad("index"::VARCHAR, 4, '0') ELSE "index"::VARCHAR END || '.png' AS image_file,
  CASE WHEN "index" < 1000 THEN lpad("index"::VARCHAR, 4, '0') ELSE "index"::VARCHAR END || '.txt' AS caption_file, tier, label, score, round_even(base_side * 10e0, 0) / 10e0 AS base_side,
  round_even(fitted_side * 10e0, 0) / 10e0 AS fitted_side, round_even(tier / fitted_side * 10000e0, 0) / 10000e0 AS scale, round_even(sharp * 10e0, 0) / 10e0 AS sharpness,
  round_even(crop_x * 10e0, 0) / 10e0 AS crop_x, round_even(crop_y * 10e0, 0) / 10e0 AS crop_y, clamped, extends AS extended, face_index::INTEGER AS face_index, faces_in_image::INTEGER AS faces_in_image FROM numbered""")
def _(spark, sf):
    rows = numbering.number(crops(spark, sf), ["image_id", "face_index"], tasks=_tasks(spark, sf))
    files = numbering.names(F.col("index"), F.col("tier"))
    tenth = numbering.tenth
    return rows.select(
        "index", "image_id", files["image_file"].alias("image_file"), files["caption_file"].alias("caption_file"), "tier", "label", "score",
        tenth(F.col("base_side")).alias("base_side"), tenth(F.col("fitted_side")).alias("fitted_side"), (F.rint(F.col("tier") / F.col("fitted_side") * 10000.0) / 10000.0).alias("scale"),
        tenth(F.col("sharp")).alias("sharpness"), tenth(F.col("crop_x")).alias("crop_x"), tenth(F.col("crop_y")).alias("crop_y"), "clamped", F.col("extends").alias("extended"), "face_index", "faces_in_image",
    )


@query("global_numbering", f'WITH {fx.KEPT} SELECT image_id, det, row_number() OVER (ORDER BY image_id, det) + 99 AS "index" FROM kept')
def _(spark, sf):
    return numbering.number(kept(spark, sf), ["image_id", "det"], start=100, tasks=_tasks(spark, sf)).select("image_id", "det", "index")


@query("skip_log", f"WITH {_CROPS} SELECT image_id, det, reason, detail FROM skips")
def _(spark, sf):
    return skips(spark, sf)


@query("skip_tally", f"WITH {_CROPS} SELECT reason, count(*) AS n FROM skips GROUP BY reason")
def _(spark, sf):
    return skips(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query("run_stats", f"""WITH {_CROPS} SELECT (SELECT count(*) FROM images) AS scanned, (SELECT count(*) FROM crops) AS written, (SELECT count(*) FROM crops WHERE clamped) AS clamped,
  count(*) FILTER (reason = 'no_detection') AS no_detection, 0::BIGINT AS multi, count(*) FILTER (reason = 'too_small') AS too_small, count(*) FILTER (reason = 'blurry') AS blurry, 0::BIGINT AS no_face, 0::BIGINT AS error FROM skips""")
def _(spark, sf):
    fate = F.when(F.col("reject").isNotNull(), "too_small").when(F.col("sharp") < 10.0, "blurry").otherwise("written")
    return numbering.stats_of_fates(fx.images(spark, sf), geo.plan_crops(kept(spark, sf)).select("image_id", fate.alias("fate"), "clamped"))


@query("by_tier", f"WITH {_CROPS} SELECT tier, count(*) AS n FROM crops GROUP BY tier")
def _(spark, sf):
    return numbering.by_tier(crops(spark, sf))


@query("max_index", f'WITH {_CROPS} SELECT max("index") AS max_index FROM numbered')
def _(spark, sf):
    return numbering.number(crops(spark, sf), ["image_id", "face_index"], tasks=_tasks(spark, sf)).agg(F.max("index").alias("max_index"))


@query("mask_tallies", f"""WITH {_CROPS} SELECT count(*) FILTER (image_id % 3 = 0) AS masked, count(*) FILTER (image_id % 3 <> 0) AS unmasked_kept,
  count(*) FILTER (image_id % 3 = 0 AND face_index % 2 = 0) AS background, count(*) FILTER (image_id % 3 = 0 AND face_index % 2 = 0 AND clamped) AS box FROM crops""")
def _(spark, sf):
    masked, ground = F.col("image_id") % 3 == 0, F.col("face_index") % 2 == 0
    return crops(spark, sf).agg(F.count_if(masked).alias("masked"), F.count_if(~masked).alias("unmasked_kept"), F.count_if(masked & ground).alias("background"), F.count_if(masked & ground & F.col("clamped")).alias("box"))


@query("training_config", f"""WITH {_CROPS} SELECT min(tier)::VARCHAR AS resolution, round_even(least(300e0, greatest(10e0, 8000e0 / count(*))), 0)::INTEGER AS epochs, 2 AS batch_size,
  count(*) FILTER (image_id % 3 = 0) > 0 AS masked_training, count(*) FILTER (image_id % 3 = 0) > 0 AND count(*) FILTER (image_id % 3 <> 0) > 0 AS partly_masked FROM crops HAVING count(*) > 0""")
def _(spark, sf):
    rows = crops(spark, sf).select("tier", F.when(F.col("image_id") % 3 == 0, "m.png").alias("mask_file"), F.lit(None).cast("string").alias("mask_dir"))
    return numbering.training_config(rows, SIZES)


# -- rasters and masks -----------------------------------------------------------

_SUM = "list_reduce(list_prepend(0e0, {0}), lambda a, b: a + b)"
_AT = "luma[CASE WHEN {r} < 0 THEN -({r}) WHEN {r} > 7 THEN 14 - ({r}) ELSE {r} END * 8 + CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END + 1]"
_R, _C = "(i // 8)", "(i % 8)"
_LAP = "list_transform(range(64), lambda i: " + " + ".join(_AT.format(r=f"({_R} {dr})", c=f"({_C} {dc})") for dr, dc in (("- 1", "+ 0"), ("+ 1", "+ 0"), ("+ 0", "- 1"), ("+ 0", "+ 1"))) + f" - 4e0 * luma[i + 1])"


@query("sharpness_8x8", f"""WITH {fx.RASTERS}, l AS (SELECT vec_id, {_LAP} AS lap FROM rasters), m AS (SELECT *, {_SUM.format('lap')} / 64 AS m FROM l)
SELECT vec_id, {_SUM.format('list_transform(lap, lambda x: (x - m) * (x - m))')} / 64 AS sharpness FROM m""")
def _(spark, sf):
    return fx.rasters(spark, sf).select("vec_id", raster.variance(raster.laplacian(F.col("luma"), 8, 8)).alias("sharpness"))


@query("inner_window", f"WITH {fx.RASTERS} SELECT vec_id, len(list_filter(range(64), lambda i: i // 8 >= 1 AND i // 8 < 7 AND i % 8 >= 1 AND i % 8 < 7))::INTEGER AS n, {_SUM.format('list_transform(list_filter(range(64), lambda i: i // 8 >= 1 AND i // 8 < 7 AND i % 8 >= 1 AND i % 8 < 7), lambda i: luma[i + 1])')} AS total FROM rasters")
def _(spark, sf):
    window, _, _ = raster.inner(F.col("luma"), 8, 8, raster.inner_fraction(0.2))
    return fx.rasters(spark, sf).select("vec_id", F.size(window).alias("n"), raster.total(window).alias("total"))


_LIGHT = f"""{fx.RASTERS}, lit AS (SELECT vec_id, luma, {_SUM.format('luma')} / 64 AS mean,
  {_SUM.format('list_transform(list_filter(range(64), lambda i: i % 8 < 2), lambda i: luma[i + 1])')} / 16 AS l, {_SUM.format('list_transform(list_filter(range(64), lambda i: i % 8 >= 6), lambda i: luma[i + 1])')} / 16 AS r FROM rasters),
spread AS (SELECT *, sqrt({_SUM.format('list_transform(luma, lambda x: (x - mean) * (x - mean))')} / 64) AS spread FROM lit)"""


@query("luma_stats", f'WITH {_LIGHT} SELECT vec_id, mean, spread, l AS "left", r AS "right" FROM spread')
def _(spark, sf):
    return _light(spark, sf).select("vec_id", "mean", "spread", "left", "right")


def _light(spark, sf):
    luma = F.col("luma")
    return fx.rasters(spark, sf).withColumns({"mean": raster.mean(luma), "spread": raster.spread(luma), "left": raster.mean(raster.columns(luma, 8, 0, 2)), "right": raster.mean(raster.columns(luma, 8, 6, 8))})


_LIGHTING = "CASE WHEN mean < 0.25e0 THEN 'dim low-key lighting' WHEN mean < 0.45e0 THEN 'moody lighting' WHEN mean < 0.68e0 THEN 'even lighting' ELSE 'bright lighting' END || CASE WHEN abs(l - r) > 0.09e0 THEN CASE WHEN l - r > 0 THEN ' from the left' ELSE ' from the right' END WHEN spread > 0.26e0 THEN ' with strong contrast' ELSE '' END"


@query("lighting", f"WITH {_LIGHT} SELECT vec_id, {_LIGHTING} AS lighting FROM spread")
def _(spark, sf):
    return _light(spark, sf).select("vec_id", cap.lighting(F.col("mean"), F.col("spread"), F.col("left"), F.col("right")).alias("lighting"))


_TONE = "CASE WHEN s < 0.05e0 THEN 'black and white' WHEN s < 0.14e0 THEN 'muted desaturated colors' WHEN s < 0.3e0 THEN 'natural colors' ELSE 'vivid saturated colors' END"


@query("tone_range", f"WITH {fx.RASTERS}, t AS (SELECT vec_id, {_SUM.format('list_transform(range(1, 65), lambda i: abs(luma[i] - matte[i]))')} / 64 AS s FROM rasters) SELECT vec_id, s AS saturation, {_TONE} AS tone FROM t")
def _(spark, sf):
    rows = fx.rasters(spark, sf).withColumn("saturation", raster.mean(F.zip_with("luma", "matte", lambda a, b: F.abs(a - b))))
    return rows.select("vec_id", "saturation", cap.tone(F.col("saturation")).alias("tone"))


@query("normalise", f"WITH {fx.RASTERS} SELECT vec_id, list_transform(luma, lambda x: (x - 0.485e0) / 0.229e0) AS tensor FROM rasters")
def _(spark, sf):
    return fx.rasters(spark, sf).select("vec_id", raster.normalised(F.col("luma"), 0.485, 0.229).alias("tensor"))


@query("sigmoid_clip", f"WITH {fx.RASTERS} SELECT vec_id, list_transform(logits, lambda x: round_even(1e0 / (1e0 + exp(-greatest(-80e0, least(80e0, 500e0 * x)))) * 1e9, 0) / 1e9) AS matte FROM rasters")
def _(spark, sf):
    got = raster.sigmoid(F.transform("logits", lambda x: 500.0 * x))
    return fx.rasters(spark, sf).select("vec_id", F.transform(got, lambda x: F.rint(x * 1e9) / 1e9).alias("matte"))


@query("softmax_ramp", f"""WITH {fx.RASTERS}, p AS (SELECT vec_id, list_transform(logits, lambda x: exp(9e0 * x - list_max(list_transform(logits, lambda z: 9e0 * z)))) AS e FROM rasters),
s AS (SELECT *, {_SUM.format('e')} AS t FROM p) SELECT vec_id, list_transform(e, lambda x: round_even(greatest(0e0, least(1e0, (x / t - 0.3e0) / 0.4e0)) * 1e9, 0) / 1e9) AS matte FROM s""")
def _(spark, sf):
    rows = fx.rasters(spark, sf).select("vec_id", F.transform("logits", lambda x: 9.0 * x).alias("v"))
    rows = rows.withColumn("matte", raster.ramp(raster.softmax(F.col("v"))))
    return rows.select("vec_id", F.transform("matte", lambda x: F.rint(x * 1e9) / 1e9).alias("matte"))


_UNIT = "greatest(0e0, least(1e0, {0}))"


@query("mask_compose", f"""WITH {fx.RASTERS} SELECT vec_id, list_transform(range(1, 65), lambda i: round_even(least(least(1e0, 0.1e0 + (1e0 - 0.1e0) * {_UNIT.format('matte[i]')}, 1e0 - (1e0 - 0.25e0) * {_UNIT.format('luma[i]')}), 1e0 - {_UNIT.format('logits[i]')}) * 255e0, 0)::INTEGER) AS weights FROM rasters""")
def _(spark, sf):
    return fx.rasters(spark, sf).select("vec_id", raster.compose(F.col("matte"), F.col("luma"), F.col("logits"), 0.1, 0.25).alias("weights"))


@query("people_union", f"WITH {fx.RASTERS} SELECT vec_id, list_transform(range(1, 65), lambda i: greatest(matte[i], luma[i])) AS matte FROM rasters")
def _(spark, sf):
    return fx.rasters(spark, sf).select("vec_id", raster.union(F.col("matte"), F.col("luma")).alias("matte"))


@query("box_person", "SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 8 >= vec_id % 3 AND i % 8 < 5 + vec_id % 4 AND i // 8 >= 1 AND i // 8 < ceil(4.5e0 + vec_id % 3) THEN 1e0 ELSE 0e0 END) AS box FROM embeddings")
def _(spark, sf):
    v = F.col("vec_id")
    return fx.table(spark, sf, "embeddings").select("vec_id", raster.box(8, 8, v % 3 + 0.7, F.lit(1.2), v % 4 + 4.5, v % 3 + 4.5).alias("box"))


@query("clothing_fraction", f"WITH {fx.RASTERS} SELECT vec_id, round_even(len(list_filter(matte, lambda x: x >= 0.5e0)) / 64 * 1000e0, 0) / 1000e0 AS masked_clothing FROM rasters")
def _(spark, sf):
    return fx.rasters(spark, sf).select("vec_id", raster.share(F.col("matte")).alias("masked_clothing"))


def _pad_sql(mode: str) -> str:
    place = (lambda k: f"greatest(0, least(7, {k}))") if mode == "edge" else (lambda k: f"CASE WHEN {k} < 0 THEN -({k}) WHEN {k} > 7 THEN 14 - ({k}) ELSE {k} END")
    return f"WITH {fx.RASTERS} SELECT vec_id, list_transform(range(144), lambda i: luma[({place('(i // 12 - 2)')}) * 8 + ({place('(i % 12 - 2)')}) + 1]) AS padded FROM rasters"


for _mode in ("edge", "reflect"):

    @query(f"pad_{_mode}", _pad_sql(_mode))
    def _(spark, sf, mode=_mode):
        return fx.rasters(spark, sf).select("vec_id", raster.pad(F.col("luma"), 8, 8, 2, mode).alias("padded"))


@query("oval_core", """WITH b AS (SELECT vec_id, 2e0 + vec_id % 2 AS w, 3e0 AS h FROM embeddings), g AS (SELECT *, w / 2e0 + 0.35e0 * greatest(w, h) AS rx, h / 2e0 + 0.35e0 * greatest(w, h) AS ry, 2e0 + w / 2e0 AS cx, 2e0 + h / 2e0 - 0.12e0 * h AS cy FROM b)
SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN ((i % 8) + 0.5e0 - cx) / rx * (((i % 8) + 0.5e0 - cx) / rx) + ((i // 8) + 0.5e0 - cy) / ry * (((i // 8) + 0.5e0 - cy) / ry) <= 1e0 THEN 0 ELSE 255 END) AS mask FROM g""")
def _(spark, sf):
    w = F.lit(2.0) + F.col("vec_id") % 2
    return fx.table(spark, sf, "embeddings").select("vec_id", raster.oval(8, 8, F.lit(2.0), F.lit(2.0), w, F.lit(3.0)).alias("mask"))


@query("isolate_person", f"""WITH RECURSIVE {fx.RASTERS}, on_px AS (SELECT vec_id, p.i AS i FROM (SELECT vec_id, unnest(list_transform(range(64), lambda i: {{'i': i, 'v': logits[i + 1]}})) AS p FROM rasters) WHERE p.v >= 0),
reach AS (SELECT vec_id, i, i AS root FROM on_px
  UNION SELECT r.vec_id, o.i, r.root FROM reach r JOIN on_px o ON o.vec_id = r.vec_id AND abs(o.i // 8 - r.i // 8) <= 1 AND abs(o.i % 8 - r.i % 8) <= 1),
labels AS (SELECT vec_id, i, max(root) AS label FROM reach GROUP BY vec_id, i)
SELECT vec_id, count(DISTINCT label) AS components, count(*) AS pixels FROM labels GROUP BY vec_id""")
def _(spark, sf):
    on = F.transform("logits", lambda x: F.when(x >= 0, 1).otherwise(0))
    labels = F.filter(raster.components(on, 8, 8), lambda v: v > 0)
    return fx.rasters(spark, sf).select("vec_id", labels.alias("l")).select("vec_id", F.size(F.array_distinct("l")).cast("long").alias("components"), F.size("l").cast("long").alias("pixels"))


_GREY = f"{fx.RASTERS}, grey AS (SELECT vec_id, list_transform(luma, lambda v: round_even(v * 255e0, 0)::INTEGER) AS g FROM rasters)"


@query("png_round_trip", f"WITH {_GREY} SELECT vec_id, g AS pixels FROM grey")
def _(spark, sf):
    return fx.photos(spark, sf).mapInPandas(fx.shown(lambda image: image), "vec_id long, pixels array<int>")


def _window_sql(left: int, top: int, wide: int, high: int, outside: str) -> str:
    at = f"(i // {wide} + {top}) * 8 + i % {wide} + {left} + 1"
    inside = f"i // {wide} + {top} BETWEEN 0 AND 7 AND i % {wide} + {left} BETWEEN 0 AND 7"
    return f"WITH {_GREY} SELECT vec_id, list_transform(range({wide * high}), lambda i: CASE WHEN {inside} THEN g[{at}] ELSE {outside} END) AS pixels FROM grey"


@query("crop_window", _window_sql(2, 1, 4, 5, "0"))
def _(spark, sf):
    return fx.photos(spark, sf).mapInPandas(fx.shown(lambda image: pixels.window(image, 2, 1, 6, 6)), "vec_id long, pixels array<int>")


@query("fill_color", _window_sql(-2, -1, 12, 11, "7"))
def _(spark, sf):
    return fx.photos(spark, sf).mapInPandas(fx.shown(lambda image: pixels.window(image, -2, -1, 10, 10, "color", (7, 8, 9))), "vec_id long, pixels array<int>")


@query("saturation", f"WITH {fx.RASTERS}, s AS (SELECT vec_id, {_SUM.format('list_transform(range(1, 65), lambda i: greatest(luma[i], matte[i], logits[i]) - least(luma[i], matte[i], logits[i]))')} / 64 AS s FROM rasters) SELECT vec_id, s AS saturation FROM s")
def _(spark, sf):
    return fx.rasters(spark, sf).select("vec_id", raster.saturation(F.col("luma"), F.col("matte"), F.col("logits")).alias("saturation"))


@query("person_boxes", """WITH b AS (SELECT vec_id, vec_id % 5 - 1.3e0 AS x, 0.4e0 AS y, 2.5e0 + vec_id % 3 AS w, 4.2e0 AS h FROM embeddings)
SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 8 >= floor(greatest(x, 0)) AND i % 8 < ceil(x + w) AND i // 8 >= 0 AND i // 8 < ceil(y + h) THEN 255 ELSE 26 END) AS weights FROM b""")
def _(spark, sf):
    box = F.array(F.col("vec_id") % 5 - 1.3, F.lit(0.4), 2.5 + F.col("vec_id") % 3, F.lit(4.2))
    return fx.photos(spark, sf).withColumn("box", box.cast("array<double>")).mapInPandas(fx.masked, "vec_id long, weights array<int>")


# -- captions --------------------------------------------------------------------

_PEEL_SQL = cap.PEEL.replace("'", "''")
_WS = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _clean_sql(raw: str) -> str:
    out = _WS.format(f"coalesce({raw}, '')")
    for _ in range(3):
        out = f"ltrim(regexp_replace({out}, '{_PEEL_SQL}', '', 'i'))"
    return out


_CLEAN = f"{fx.CAPTIONS}, peeled AS (SELECT doc_id, trim({_clean_sql('raw')}) AS p FROM captions), clean AS (SELECT doc_id, CASE WHEN substr(p, 1, 1) <> lower(substr(p, 1, 1)) AND NOT regexp_matches(p, '{cap.NAMES}') THEN lower(substr(p, 1, 1)) || substr(p, 2) ELSE p END AS c FROM peeled)"


def _tidy_sql(x: str) -> str:
    step = f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s*,(?:\\s*,)+', ',', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({step}, '^[ ,;]+|[ ,;]+$', '', 'g'), '\\.+$', ''))"


def _dedupe_sql(x: str, source: str) -> str:
    """doc_id, d of a frame with x."""
    return f"""SELECT doc_id, array_to_string(list_filter(p, lambda v, i: list_position(k, k[i]) = i), ', ') AS d
  FROM (SELECT doc_id, p, list_transform(p, lambda v: regexp_replace(lower(v), '\\.+$', '')) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split({x}, ','), lambda v: trim(v)), lambda v: v <> '') AS p FROM {source}))"""


@query("clean_caption", f"WITH {_CLEAN} SELECT doc_id, c AS caption FROM clean")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", cap.clean(F.col("raw")).alias("caption"))


@query("dedupe_phrases", f"WITH {fx.CAPTIONS} SELECT doc_id, d AS caption FROM ({_dedupe_sql('raw', 'captions')})")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", cap.dedupe(F.col("raw")).alias("caption"))


@query("tidy_punctuation", f"WITH {fx.CAPTIONS} SELECT doc_id, {_tidy_sql('raw')} AS caption FROM captions")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", cap.tidy(F.col("raw")).alias("caption"))


@query("caption_drop", f"WITH {fx.CAPTIONS} SELECT doc_id, regexp_replace(regexp_replace(raw, 'the [a-z]+', '', 'gi'), 'ing\\b', '', 'gi') AS caption FROM captions")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", cap.drop(F.col("raw"), [r"the [a-z]+", r"ing\b"]).alias("caption"))


_ASSEMBLED = f"""{_CLEAN}, tidied AS (SELECT doc_id, {_tidy_sql("regexp_replace(c, 'soft ', '', 'gi')")} AS t FROM clean), unique_phrases AS ({_dedupe_sql('t', 'tidied')}),
assembled AS (SELECT doc_id, {_tidy_sql("concat_ws(', ', 'sks subject', nullif(d, ''), 'photo')")} AS a FROM unique_phrases)"""


@query("assemble_caption", f"WITH {_ASSEMBLED} SELECT doc_id, a AS caption FROM assembled")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", cap.assemble(F.col("raw"), trigger="sks subject", suffix="photo", patterns=["soft "]).alias("caption"))


@query("caption_max_chars", f"WITH {_ASSEMBLED} SELECT doc_id, CASE WHEN length(a) > 60 THEN regexp_replace(trim(regexp_replace(substr(a, 1, 60), '(?s)^(.*),[^,]*$', '\\1')), ',+$', '') ELSE a END AS caption FROM assembled")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", cap.assemble(F.col("raw"), trigger="sks subject", suffix="photo", patterns=["soft "], most=60).alias("caption"))


@query("null_captioner", f"WITH {fx.CAPTIONS} SELECT doc_id, '' AS caption FROM captions")
def _(spark, sf):
    return fx.captions(spark, sf).select("doc_id", F.lit("").alias("caption"))


_SHOT = "CASE WHEN label IN ('face', 'head') THEN 'head and shoulders portrait' WHEN label = 'person' THEN 'full body shot' ELSE label || ' shot' END"


@query("shot_type", f"WITH {fx.KEPT} SELECT {ID}, {_SHOT} AS shot FROM kept")
def _(spark, sf):
    return kept(spark, sf).select("image_id", "det", cap.shot_type(F.col("label"), 0.5).alias("shot"))


_POSE = """CASE WHEN l_linenumber % 5 = 0 THEN '' WHEN abs(x + 0.3e0 * w - (x + 0.7e0 * w)) < 1e-3 THEN 'in profile' ELSE CASE WHEN abs(o) < 0.12e0 THEN 'facing the camera'
  WHEN abs(o) < 0.3e0 THEN 'head turned slightly to the ' || s WHEN abs(o) < 0.55e0 THEN 'head turned to the ' || s ELSE 'head in near profile to the ' || s END END"""
_POSED = fx.KEPT + ", posed AS (SELECT *, CASE WHEN o > 0 THEN 'left' ELSE 'right' END AS s FROM (SELECT *, (x + w * (0.1e0 + 8e0 * l_discount) - (x + 0.3e0 * w + (x + 0.7e0 * w)) / 2e0) / abs(x + 0.3e0 * w - (x + 0.7e0 * w)) AS o FROM kept))"


def _pose():
    x, w = F.col("x"), F.col("w")
    nose = F.when(F.col("l_linenumber") % 5 != 0, x + w * (0.1 + 8.0 * F.col("l_discount")))
    return cap.head_pose(F.col("label"), x + 0.3 * w, x + 0.7 * w, nose)


@query("head_pose", f"WITH {_POSED} SELECT {ID}, {_POSE} AS pose FROM posed")
def _(spark, sf):
    return kept(spark, sf).select("image_id", "det", _pose().alias("pose"))


@query("template_caption", f"WITH {_POSED} SELECT {ID}, {_SHOT} || ' of a ' || label || ', ' || {_POSE} || ' (100%)' AS caption FROM posed")
def _(spark, sf):
    text = cap.fill("{shot} of a {label}, {pose} (100%)", {"shot": cap.shot_type(F.col("label"), 0.5), "label": F.col("label"), "pose": _pose()})
    return kept(spark, sf).select("image_id", "det", text.alias("caption"))


# -- paths -----------------------------------------------------------------------

_SEG = "string_split(ltrim(path, '/'), '/')"


@query("path_scan_filter", f"WITH {fx.PATHS} SELECT page_id, path FROM paths WHERE NOT regexp_matches(path, '/\\.') AND regexp_matches(lower(path), '[^/](\\.jpg|\\.jpeg|\\.jpe|\\.png|\\.webp|\\.bmp|\\.tif|\\.tiff|\\.gif|\\.ppm)$') AND NOT regexp_matches(path, '-(mask|cond)label\\.[^./]*$')")
def _(spark, sf):
    path = F.col("path")
    return fx.paths(spark, sf).where(scan.is_visible(path) & scan.is_image(path) & ~scan.is_side_file(path))


@query("side_files", f"WITH {fx.PATHS} SELECT page_id, path FROM paths WHERE regexp_matches(path, '-(mask|cond)label\\.[^./]*$')")
def _(spark, sf):
    return fx.paths(spark, sf).where(scan.is_side_file(F.col("path")))


@query("path_glob_exclude", f"WITH {fx.PATHS} SELECT page_id, path FROM paths WHERE NOT regexp_matches(path, '(^|/)en(/|$)') AND NOT regexp_matches(path, '(^|/)[^/]*\\.txt(/|$)')")
def _(spark, sf):
    return fx.paths(spark, sf).where(~scan.is_excluded(F.col("path"), ["en", "*.txt"]))


@query("skip_folders", f"WITH {fx.PATHS} SELECT page_id, path FROM paths WHERE NOT starts_with(path, '/de/')")
def _(spark, sf):
    return fx.paths(spark, sf).where(~scan.is_below(F.col("path"), ["/de"]))


@query("walk_order", f"""WITH {fx.PATHS}, d AS (SELECT DISTINCT path FROM paths), k AS (SELECT path, list_transform({_SEG}, lambda p, i: CASE WHEN i = len({_SEG}) THEN '0' ELSE '1' END || p) AS key FROM d)
SELECT path, row_number() OVER (ORDER BY key) AS "index" FROM k""")
def _(spark, sf):
    distinct = fx.paths(spark, sf).select("path").distinct()
    return numbering.number(distinct.withColumn("key", scan.walk_key(F.col("path"))), ["key"]).select("path", "index")


_MARKED = f"{fx.PATHS}, marks AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM paths WHERE page_id % 7 = 0)"


@query("marker_pruning", f"WITH {_MARKED} SELECT DISTINCT path FROM paths WHERE NOT EXISTS (SELECT 1 FROM marks WHERE folder <> '' AND starts_with(path, folder || '/'))")
def _(spark, sf):
    paths = fx.paths(spark, sf)
    markers = paths.where("page_id % 7 = 0").select(F.regexp_replace("path", "/[^/]*$", "/manifest.jsonl").alias("path"))
    kept = scan.without_marked(paths.select("path").unionAll(markers).distinct())
    return kept.where(scan.name_of(F.col("path")) != "manifest.jsonl")


@query("scan_limit", f"""WITH {fx.PATHS}, d AS (SELECT DISTINCT path FROM paths) SELECT path FROM (SELECT path, list_transform({_SEG}, lambda p, i: CASE WHEN i = len({_SEG}) THEN '0' ELSE '1' END || p) AS key FROM d) ORDER BY key LIMIT 20""")
def _(spark, sf):
    return fx.paths(spark, sf).select("path").distinct().orderBy(scan.walk_key(F.col("path"))).limit(20)


# -- manifests -------------------------------------------------------------------

_STATE = fx.LOG + ", state AS (SELECT source, max(faces_in_image) AS total, count(DISTINCT CASE WHEN face_index >= 0 AND face_index < faces_in_image THEN face_index END) AS saved, count(*) AS n_rows FROM log GROUP BY source)"


@query("resume_done_sources", f"WITH {_STATE} SELECT source, total, saved, n_rows, coalesce(saved >= total, false) AS done FROM state")
def _(spark, sf):
    return manifest.resume_state(fx.log(spark, sf))


def _sources(spark, sf):
    return fx.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source")).distinct()


@query("resume_antijoin", f"WITH {_STATE} SELECT DISTINCT 'u' || user_id AS source FROM events WHERE 'u' || user_id NOT IN (SELECT source FROM state WHERE saved >= total)")
def _(spark, sf):
    return manifest.remaining(_sources(spark, sf), fx.log(spark, sf))


@query("partial_resume", f"WITH {fx.LOG}, faces AS (SELECT DISTINCT 'u' || user_id AS source, unnest(range(1 + user_id % 7)) AS face_index FROM events) SELECT source, face_index FROM faces f WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.source = f.source AND l.face_index = f.face_index)")
def _(spark, sf):
    users = fx.table(spark, sf, "events").select("user_id").distinct()
    faces = users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 7)).alias("face_index"))
    return manifest.unsaved(faces, fx.log(spark, sf))


@query("next_index", f'WITH {fx.LOG} SELECT greatest(0, coalesce(max("index"), 0)) + 1 AS next_index FROM log')
def _(spark, sf):
    return manifest.next_index(fx.log(spark, sf)).select(F.col("next_index").cast("long").alias("next_index"))


@query("carry_union", f"""WITH {fx.LOG} SELECT 0 AS part, "index", source FROM log WHERE "index" < 5000 UNION ALL SELECT 1, "index", source FROM log WHERE "index" >= 5000""")
def _(spark, sf):
    rows = fx.log(spark, sf).select("index", "source")
    return manifest.carried(rows.where("index < 5000"), rows.where("index >= 5000")).select("part", "index", "source")


_IMAGE_FILE = "lpad(doc_id::VARCHAR, 6, '0') || '.png'"


def _images(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fx.image_file(F.col("doc_id")).alias("image_file"))


@query("pending_captions", f"SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'label ' || l.toxic END, '') AS caption, coalesce(l.quality, 0) <> 1 AS pending FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    texts = fx.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("label "), F.col("toxic").cast("string"))).otherwise("  ").alias("caption_text"))
    return manifest.pending(fx.table(spark, sf, "documents").select("doc_id"), texts, "doc_id")


def _wanted(spark, sf):
    return fx.table(spark, sf, "labels").where("toxic = 1").select(fx.image_file(F.col("doc_id") * 2).alias("image_file"))


_WANTED = "wanted AS (SELECT DISTINCT lpad((doc_id * 2)::VARCHAR, 6, '0') || '.png' AS image_file FROM labels WHERE toxic = 1)"


@query("caption_selection", f"WITH {_WANTED} SELECT doc_id, {_IMAGE_FILE} AS image_file FROM documents WHERE {_IMAGE_FILE} IN (SELECT image_file FROM wanted)")
def _(spark, sf):
    return manifest.selected(_images(spark, sf), _wanted(spark, sf))


@query("unknown_selection", f"WITH {_WANTED} SELECT image_file FROM wanted WHERE image_file NOT IN (SELECT {_IMAGE_FILE} FROM documents)")
def _(spark, sf):
    return manifest.unknown(_images(spark, sf), _wanted(spark, sf))


@query("shared_caption_path", f"WITH {fx.PATHS} SELECT regexp_replace(path, '\\.[^./]*$', '.txt') AS caption_file, count(*) AS n FROM paths GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return manifest.shared_captions(fx.paths(spark, sf).withColumnRenamed("path", "image_file"))


@query("overwrite_targets", f"SELECT DISTINCT unnest([{_IMAGE_FILE}, lpad(doc_id::VARCHAR, 6, '0') || '.txt', lpad(doc_id::VARCHAR, 6, '0') || '-masklabel.png']) AS target FROM documents")
def _(spark, sf):
    return _images(spark, sf).select(F.explode(manifest.side_files(F.col("image_file"))).alias("target")).distinct()




@query("path_escape", f"SELECT page_id, page_id % 4 IN (1, 3) AS escapes FROM pages")
def _(spark, sf):
    key = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, F.concat(F.lit("a/../"), key, F.lit(".png"))).when(kind == 1, F.concat(F.lit("../"), key, F.lit(".png"))).when(kind == 2, "./b/c.png").otherwise(F.concat(F.lit("/abs/"), key))
    return fx.table(spark, sf, "pages").select("page_id", manifest.escapes(path).alias("escapes"))


@query("manifest_json_roundtrip", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def _(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT").alias("r"))
    again = rows.select("event_id", F.to_json("r", {"ignoreNullFields": "false"}).alias("j"))
    return again.select("event_id", F.from_json("j", "k BIGINT").getField("k").alias("k"))


@query("manifest_file", f"""WITH {fx.LOG}, rows AS (SELECT "index", source, face_index, faces_in_image FROM log)
SELECT "index", source, lpad("index"::VARCHAR, 6, '0') || '.png' AS image_file, face_index::INTEGER AS face_index, faces_in_image::INTEGER AS faces_in_image, '' AS caption, false AS recovered FROM rows""")
def _(spark, sf):
    """Written as one JSON-lines file in the place of an older one, and read again with its checks."""
    rows = fx.manifest_rows(spark, sf)
    path = f"{fx.scratch(spark)}/manifest.jsonl"
    files.replace(spark, rows.limit(3), path)
    files.replace(spark, rows, path)
    return files.read(spark, path).select("index", "source", "image_file", "face_index", "faces_in_image", "caption", "recovered")


@query("caption_files", "SELECT l_linenumber::BIGINT AS n, 'caption ' || l_linenumber || ', of it' AS caption FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def _(spark, sf):
    """Written beside each other as text files, and read again."""
    folder = fx.scratch(spark)
    rows = fx.table(spark, sf, "lineitem").select("l_linenumber").distinct()
    texts = rows.select(F.concat(F.col("l_linenumber").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("  caption "), F.col("l_linenumber").cast("string"), F.lit(", of it\n")).cast("binary").alias("body"))
    texts.mapInPandas(runs.writer(folder), "written long").collect()
    return files.captions(spark, folder).select(F.regexp_extract("file", r"(\d+)\.txt$", 1).cast("long").alias("n"), "caption")


@query("required_field_check", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN 'tax' ELSE 'flag' END AS missing FROM lineitem WHERE l_tax = 0 OR l_returnflag = 'N'")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return manifest.missing_fields(rows, ["tax", "flag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "missing")


@query("landmark_round", f"WITH {fx.KEPT} SELECT {ID}, round_even((x + 0.3e0 * w) * 10e0, 0) / 10e0 AS eye_x, CASE WHEN l_linenumber % 5 <> 0 THEN round_even((x + w * (0.1e0 + 8e0 * l_discount)) * 10e0, 0) / 10e0 END AS nose_x FROM kept")
def _(spark, sf):
    nose = F.when(F.col("l_linenumber") % 5 != 0, F.array(F.col("x") + F.col("w") * (0.1 + 8.0 * F.col("l_discount")), F.col("y")))
    marks = F.map_filter(F.create_map(F.lit("left_eye"), F.array(F.col("x") + 0.3 * F.col("w"), F.col("y")), F.lit("nose"), nose), lambda _, v: F.size(v) >= 2)
    tenths = F.transform_values(marks, lambda _, v: F.transform(v, numbering.tenth))
    return kept(spark, sf).withColumn("m", tenths).select("image_id", "det", F.col("m")["left_eye"][0].alias("eye_x"), F.col("m")["nose"][0].alias("nose_x"))


@query("distinct_sizes", "SELECT DISTINCT p_size FROM part")
def _(spark, sf):
    return fx.table(spark, sf, "part").select("p_size").dropDuplicates()
