"""Text source: one labelled sample per line, ``label,f1 f2 ... fn``.

The line grammar follows the original tool's parser:

* the label is the text before the first comma;
* the features are the text between the first and the second comma
  (anything after a second comma is ignored);
* features are separated by single spaces; trailing separators are
  dropped (``split`` on the JVM drops trailing empty tokens), so a trailing
  space is accepted while a double space inside is a blank field;
* every token must be a number.

``mode="strict"`` fails the job on the first bad line, as the original
does. ``mode="permissive"`` (default) keeps going and tags each bad line
with a reason, so rejects can be routed and counted. Everything is a
Catalyst expression; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REASON_NO_COMMA = "no_comma"
REASON_BAD_LABEL = "bad_label"
REASON_NO_FEATURES = "no_features"
REASON_BLANK_FIELD = "blank_field"
REASON_NOT_A_NUMBER = "not_a_number"


def _parts(value: Column) -> dict[str, Column]:
    comma = F.instr(value, ",")
    label_txt = F.substring_index(value, ",", 1)
    rest = F.when(comma > 0, value.substr(comma + F.lit(1), F.length(value)))
    feats_txt = F.regexp_replace(F.substring_index(rest, ",", 1), " +$", "")
    tokens = F.split(feats_txt, " ")
    values = F.transform(tokens, lambda t: t.try_cast("double"))
    label = F.trim(label_txt).try_cast("double")
    reason = (
        F.when(comma == 0, F.lit(REASON_NO_COMMA))
        .when(label.isNull(), F.lit(REASON_BAD_LABEL))
        .when(F.length(feats_txt) == 0, F.lit(REASON_NO_FEATURES))
        .when(F.exists(tokens, lambda t: t == F.lit("")), F.lit(REASON_BLANK_FIELD))
        .when(F.exists(values, lambda v: v.isNull()), F.lit(REASON_NOT_A_NUMBER))
    )
    return {"label": label, "values": values, "reason": reason}


def parse_labeled_lines(
    lines: DataFrame,
    value_col: str = "value",
    mode: str = "permissive",
    keep_line: bool = False,
) -> DataFrame:
    """Parse a DataFrame of text lines into ``(label double, features vector)``.

    Permissive mode adds ``reject_reason`` (null for good lines) and keeps
    every line; use :func:`good_lines` / :func:`rejected_lines` to route.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError("mode must be 'strict' or 'permissive'")
    df = lines.withColumn("__line", F.col(value_col))
    p = _parts(F.col("__line"))
    features = F.when(p["reason"].isNull(), array_to_vector(p["values"]))
    cols = [F.col("__line").alias("line")] if keep_line else []
    if mode == "strict":
        checked = F.when(
            p["reason"].isNotNull(),
            F.raise_error(F.concat(F.lit("unparseable line ("), p["reason"], F.lit("): "), F.col("__line"))),
        )
        out = df.select(*cols, checked.alias("__check"), p["label"].alias("label"), features.alias("features"))
        return out.where(F.col("__check").isNull()).drop("__check")
    out = df.select(
        *cols,
        F.when(p["reason"].isNull(), p["label"]).alias("label"),
        features.alias("features"),
        p["reason"].alias("reject_reason"),
    )
    return out


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def read_labeled_text(spark: SparkSession, path: str, mode: str = "permissive", keep_line: bool = False) -> DataFrame:
    """S1 + S2: ``spark.read.text`` (splittable, one task per file block)
    followed by the expression parser."""
    return parse_labeled_lines(spark.read.text(path), "value", mode, keep_line)
