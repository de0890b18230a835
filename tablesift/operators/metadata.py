"""Package metadata: nested records to flat attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKAGE = (
    "id string, name string, title string, notes string, jurisdiction string, keywords string, tags array<string>,"
    " organization struct<name:string, title:string, description:string>,"
    " resources array<struct<id:string, name:string, format:string, url:string, language:array<string>>>"
)


def accepted(formats: tuple[str, ...]) -> F.Column:
    """A resource in an accepted format, in English or without a language."""
    return F.col("resource.format").isin(*formats) & (F.col("resource.language").isNull() | F.array_contains("resource.language", "en"))


def resources(packages: DataFrame, formats: tuple[str, ...] = ("CSV",), language: bool = True) -> DataFrame:
    """A row for each accepted resource with its package; of several with one id the last of the last package."""
    each = packages.select("*", F.posexplode("resources").alias("_at", "resource"))
    each = each.where(accepted(formats) if language else F.col("resource.format").isin(*formats))
    last = Window.partitionBy("resource.id").orderBy(F.desc("id"), F.desc("_at"))
    return each.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_at", "resources")


def attributes(packages: DataFrame, formats: tuple[str, ...] = ("CSV",), longest_notes: int = 1000) -> DataFrame:
    """resource_id, resource_name, package_id, package_name, notes, keywords, tags, organisation's name, title and description,
    jurisdiction. Keywords are a list, or a struct whose list `en` counts; missing parts are null, or empty lists."""
    from ..functions.text import strip_tags

    listed = F.from_json("keywords", "array<string>")
    english = F.from_json(F.get_json_object("keywords", "$.en"), "array<string>")
    return resources(packages, formats, False).select(
        F.col("resource.id").alias("resource_id"), F.col("resource.name").alias("resource_name"), F.col("id").alias("package_id"), F.col("name").alias("package_name"),
        strip_tags(F.col("notes"), longest_notes).alias("notes"), F.coalesce(english, listed, F.array().cast("array<string>")).alias("keywords"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("organization.name").alias("organization_name"), F.col("organization.title").alias("organization_title"), F.col("organization.description").alias("organization_description"), "jurisdiction",
    )
