"""The explainable rules that tell photos from other images, and how they fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.paths import ascii_lower, components, file_name

PHOTO, NON_PHOTO, AMBIGUOUS = "photo", "non_photo", "ambiguous"

#: Screen sizes in pixels, folder names of app assets, and how screenshots are named.
SCREEN_SIZES = (
    (1280, 720), (1280, 800), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1680, 1050),
    (1920, 1080), (1920, 1200), (2560, 1440), (2560, 1600), (3440, 1440), (3840, 2160),
    (750, 1334), (828, 1792), (1080, 1920), (1080, 2340), (1080, 2400), (1170, 2532), (1179, 2556),
    (1284, 2778), (1290, 2796), (1440, 2960), (1440, 3040), (1440, 3200),
)
ASSET_FOLDERS = ("assets", "cache", "thumbnails", ".thumbnails", "icons")
SCREENSHOT_STARTS = ("screenshot", "screen shot", "scrnshot")


def verdict(path: Column, width: Column, height: Column, make: Column, model: Column) -> Column:
    """struct<label, confidence, rule> of the first rule that holds, in the order below."""
    name, lower = ascii_lower(file_name(path)), ascii_lower(path)
    either = (F.greatest(width, height) * 100_000 + F.least(width, height)).isin([max(s) * 100_000 + min(s) for s in SCREEN_SIZES])
    is_screen = width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0) & (F.greatest(width, height) < 100_000) & either
    say = lambda label, confidence, rule: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))
    return (
        F.when(make.isNotNull() | model.isNotNull(), say(PHOTO, 0.95, "exif_camera"))
        .when(name.rlike("^(?:" + "|".join(SCREENSHOT_STARTS) + ")"), say(NON_PHOTO, 0.95, "screenshot_filename"))
        .when(F.exists(components(lower), lambda c: c.isin(*ASSET_FOLDERS)), say(NON_PHOTO, 0.9, "asset_path"))
        .when(is_screen, say(NON_PHOTO, 0.8, "screen_resolution"))
        .when(F.endswith(lower, F.lit(".png")), say(NON_PHOTO, 0.7, "png_no_exif"))
        .otherwise(say(AMBIGUOUS, 0.0, "none"))
    )


def not_manual(rule: Column) -> Column:
    """Rows the rules may label: those without a manual decision, unlabelled ones included."""
    return rule.isNull() | (rule != "manual")


def classified(files: DataFrame) -> DataFrame:
    """(id, label, confidence, rule) of every file without a manual decision."""
    f = files.select("id", "path", "width", "height", "exif_make", "exif_model", "class_rule").filter(not_manual(F.col("class_rule")))
    return f.select("id", verdict(*(F.col(c) for c in ("path", "width", "height", "exif_make", "exif_model"))).alias("_v")).select("id", "_v.*")


def relabelled(files: DataFrame) -> DataFrame:
    """``files`` with the rules' labels written over all but manual ones."""
    v = verdict(*(F.col(c) for c in ("path", "width", "height", "exif_make", "exif_model")))
    free = not_manual(F.col("class_rule"))
    pick = lambda part, old: F.when(free, v[part]).otherwise(F.col(old))
    return files.withColumns({"classification": pick("label", "classification"), "class_confidence": pick("confidence", "class_confidence"), "class_rule": pick("rule", "class_rule")})


def label_counts(labels: DataFrame) -> DataFrame:
    """One row: photo, non_photo, ambiguous."""
    return labels.agg(*[F.count_if(F.col("label") == x).alias(x) for x in (PHOTO, NON_PHOTO, AMBIGUOUS)])


def with_manual_labels(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """``files`` with decisions (id, label) set as manual, at full confidence.  A label other than
    photo or non_photo is an error; of several decisions for a file the greatest label stands."""
    ok = F.when(F.col("label").isin(PHOTO, NON_PHOTO), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("NULL")))))
    d = decisions.select(F.col("id").alias("_id"), ok.alias("_label")).groupBy("_id").agg(F.max("_label").alias("_label"))
    hit = F.col("_label").isNotNull()
    out = files.join(d, files["id"] == d["_id"], "left")
    return out.withColumns({"classification": F.coalesce("_label", "classification"), "class_confidence": F.when(hit, 1.0).otherwise(F.col("class_confidence")), "class_rule": F.when(hit, "manual").otherwise(F.col("class_rule"))}).drop("_id", "_label")


def review_queue(files: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` labelled files the rules are least sure of (no manual ones, none without a rule),
    missing confidence first, then by id: a top-k, never a full sort."""
    f = files.select("id", "path", "classification", "class_confidence", "class_rule")
    return f.filter("classification is not null and class_rule <> 'manual'").orderBy(F.asc_nulls_first("class_confidence"), "id").limit(n)


def manual_label_lines(files: DataFrame) -> DataFrame:
    """(value): ``path,label`` of every manual decision, without header or quotes, for a text file."""
    return files.filter("class_rule = 'manual'").select(F.concat_ws(",", F.col("path"), F.coalesce("classification", F.lit(""))).alias("value"))


def truth_from_lines(lines: DataFrame) -> DataFrame:
    """(path, label) of label lines (value): trimmed, split at the last comma, the label in lower case;
    blank lines, lines that start with # and lines without a comma are left out."""
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    kept = lines.select(text.alias("t")).filter("t <> '' and not startswith(t, '#') and instr(t, ',') > 0")
    part = lambda i: F.regexp_replace(F.regexp_extract("t", r"(?s)^(.*),([^,]*)$", i), r"^\s+|\s+$", "")
    return kept.select(part(1).alias("path"), ascii_lower(part(2)).alias("label"))


def accuracy(truth: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total, missing, correct, wrong, undecided, accuracy, of truth (path, label) against the
    catalogue.  Missing is an unknown path and a known one without a label; accuracy is 0 if nothing
    was decided."""
    got = files.select(F.col("path").alias("_path"), F.col("classification").alias("_got"))
    t = truth.select("path", "label").join(got, F.col("path") == F.col("_path"), "left")
    g = F.col("_got")
    sums = t.agg(
        F.count("*").alias("total"), F.count_if(g.isNull()).alias("missing"), F.count_if(g.isNotNull() & (g != AMBIGUOUS) & (g == F.col("label"))).alias("correct"),
        F.count_if(g.isNotNull() & (g != AMBIGUOUS) & ~F.coalesce(g == F.col("label"), F.lit(False))).alias("wrong"), F.count_if(g == AMBIGUOUS).alias("undecided"),
    )
    decided = F.col("correct") + F.col("wrong")
    return sums.withColumn("accuracy", F.when(decided > 0, F.col("correct") / decided).otherwise(0.0))
