"""Form fields and other page elements, given as a table of their computed properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import spans as sp
from veil.functions.secrets import finish_items
from veil.functions.text import strip
from veil.operators.detect import CORE, all_items

SENSITIVE_AUTOCOMPLETE = "^(cc-|new-password|current-password|one-time-code)"


def visible(elements: DataFrame, width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """Elements a screenshot of the viewport would show."""
    out = elements
    if "own_overlay" in elements.columns:
        out = out.filter(~F.coalesce("own_overlay", F.lit(False)))
    if "tag" in elements.columns:
        out = out.filter(~F.coalesce(F.upper("tag"), F.lit("")).isin("SCRIPT", "STYLE", "NOSCRIPT"))
    shown = (F.col("display") != "none") & (F.col("visibility") != "hidden") & (F.col("opacity") != 0)
    sized = (F.col("width") != 0) & (F.col("height") != 0)
    inside = ((F.col("top_px") + F.col("height") > 0) & (F.col("top_px") < height)
              & (F.col("left_px") + F.col("width") > 0) & (F.col("left_px") < width))
    return out.filter(shown & sized & inside)


def field_label(*, aria: Column, label_for: Column, wrapping: Column, placeholder: Column,
                name: Column, type_: Column) -> Column:
    """The first of the usual places that names a field."""
    said = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(said(aria), said(strip(label_for)),
                      said(F.substring(strip(wrapping), 1, 60)), said(placeholder), said(name),
                      said(type_), F.lit("field"))


def classify_fields(elements: DataFrame) -> DataFrame:
    """Tier 0: password and sensitive fields. Their value column is blanked before any scan."""
    password = F.lower(F.coalesce("type", F.lit(""))) == "password"
    sensitive = F.lower(F.coalesce("autocomplete", F.lit(""))).rlike(SENSITIVE_AUTOCOMPLETE)
    closed = password | sensitive
    return (elements.withColumn("tier", F.when(closed, 0))
            .withColumn("ph", F.when(password, "[PASSWORD]").when(sensitive, "[SENSITIVE]"))
            .withColumn("kind", F.when(password, "Password field").when(sensitive, "Sensitive field"))
            .withColumn("match", F.when(closed, "(never read)"))
            .withColumn("value", F.when(closed, F.lit(None).cast("string")).otherwise(
                F.col("value"))))


def scan_fields(classified: DataFrame) -> DataFrame:
    """Tier 1: ordinary fields. The first hit decides; clean values show 80 characters.

    ``shown`` is what the page summary prints, ``masked`` whether that is a placeholder.
    """
    out = (classified.withColumn("__v", F.coalesce(strip(F.col("value")), F.lit("")))
           .withColumn("__hit", F.expr(f"try_element_at({finish_items(sp.order_items(all_items('__v', CORE)))}, 1)")))
    # The flag is a column of its own: the columns it is made of are overwritten below.
    out = out.withColumn("__tier1", F.col("tier").isNull() & F.col("__hit").isNotNull())
    pick = lambda new, old: F.when(F.col("__tier1"), new).otherwise(F.col(old))
    return (out.withColumn("tier", pick(F.lit(1), "tier"))
            .withColumn("ph", pick(F.col("__hit.ph"), "ph"))
            .withColumn("kind", pick(F.col("__hit.kind"), "kind"))
            .withColumn("match", pick(F.col("__hit.match"), "match"))
            .withColumn("masked", F.col("tier").isNotNull())
            .withColumn("shown", F.when(F.col("tier").isNotNull(), F.col("ph"))
                        .when(F.col("__v") == "", "(empty)")
                        .otherwise(F.substring("__v", 1, 80)))
            .drop("__v", "__hit", "__tier1", "value"))
