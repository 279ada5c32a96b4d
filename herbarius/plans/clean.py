"""Cleaning of citizen and expert records, identifications and species data."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_or_scalar, json_entries, json_int, json_text, occurrences, ratio, round_half_away, to_int, value_map
from ..operators.relational import append, in_values, not_in_values

#: Codes of annotations (fixed values).
SEX = {"Male": 11, "Female": 10}
REPRODUCTION = {"flower buds": 15, "flowers|flower buds": 15, "no flowers or fruits": 21, "flowers": 13, "fruits or seeds": 14}
LEAVES = {"no live leaves": 40, "green leaves": 38, "breaking leaf buds": 37, "colored leaves": 39}
MONTHS = range(1, 13)


def in_season(df: DataFrame) -> Column:
    return (F.col("taxonRank") == "SPECIES") & (F.col("month") >= 4) & (F.col("month") < 9) & F.col("hasCoordinate").cast("boolean")


def citizen(raw: DataFrame) -> DataFrame:
    """Usable citizen records.  A record has a row for each of its annotations (one without any)."""
    note = F.explode_outer(F.map_values(json_entries("dynamicProperties"))).alias("__note")
    rows = raw.filter(in_season(raw) & F.col("taxonID").isNotNull() & (F.col("institutionCode") == "iNaturalist") & F.col("dateIdentified").isNotNull())
    rows = rows.withColumn("coordinateUncertaintyInMeters", F.coalesce(to_int("coordinateUncertaintyInMeters"), F.lit(0))).filter("coordinateUncertaintyInMeters < 3000")
    return rows.select("*", note).withColumns({
        "pheno_sex": value_map("sex", SEX),
        "pheno_repro": value_map("reproductiveCondition", REPRODUCTION),
        "pheno_leaves": value_map(first_or_scalar(F.col("__note")), LEAVES),
        "media_count": occurrences("mediaType", "StillImage"),
    }).drop("__note", "sex", "reproductiveCondition", "dynamicProperties", "mediaType")


def expert(raw: DataFrame) -> DataFrame:
    """Usable expert records; annotations stay text."""
    return raw.filter(in_season(raw)).withColumnsRenamed({"sex": "pheno_sex", "reproductiveCondition": "pheno_repro", "dynamicProperties": "pheno_leaves", "mediaType": "media_count"})


def research_grade(observations: DataFrame) -> DataFrame:
    return observations.filter("quality_grade = 'research'").select("id", "url", "user_login", "user_id", "num_identification_agreements", "num_identification_disagreements")


def with_identifications(records: DataFrame, observations: DataFrame) -> DataFrame:
    o = observations.filter("num_identification_agreements is not null and num_identification_disagreements is not null").drop("id")
    return records.join(o, records["occurrenceID"] == o["url"]).drop("url")


def observers(joined: DataFrame) -> DataFrame:
    return joined.select("recordedBy", "recordedByID", "user_login", "user_id").distinct()


def experts_among(people: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    return people.filter(F.col("recordedByID").isNotNull() | F.col("recordedBy").isin(list(always)))


def citizens_among(people: DataFrame) -> DataFrame:
    return people.filter(F.col("recordedByID").isNull())


def dealt(joined: DataFrame, expert_records: DataFrame, experts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citizen records, expert records with those that experts among the citizens made)."""
    by_experts = in_values(joined, "recordedBy", experts, "recordedBy")
    extra = ["user_login", "user_id", "num_identification_agreements", "num_identification_disagreements"]
    as_text = [c for c in ("pheno_sex", "pheno_repro", "pheno_leaves", "media_count") if c in expert_records.columns]
    return not_in_values(joined, "recordedBy", experts, "recordedBy"), append(expert_records.withColumns({c: F.col(c).cast("string") for c in as_text}), by_experts, extra)


def people(landed: DataFrame) -> DataFrame:
    """Observer profiles of rank above 1, out of landed responses."""
    whole = ["id", "observations_count", "identifications_count", "species_count", "universal_search_rank", "journal_posts_count", "activity_count", "site_id"]
    text = ["login", "login_autocomplete", "login_exact", "name", "name_autocomplete", "orcid", "roles", "icon", "icon_url", "spam", "suspended", "created_at"]
    rows = landed.select(F.col("item_key").alias("user_id"), *(json_int("json", f"$.{c}").alias(c) for c in whole), *(json_text("json", f"$.{c}").alias(c) for c in text))
    return rows.filter("universal_search_rank > 1")


def _months() -> list[Column]:
    return [json_int("json", f"$.month_of_year.{m}").alias(f"month_{m}") for m in MONTHS]


def histogram(landed: DataFrame) -> DataFrame:
    """Records by month of each taxon; the count is null if a month is."""
    rows = landed.select(F.col("item_key").alias("taxonID"), *_months()).distinct()
    return rows.withColumn("count", reduce(add, [F.col(f"month_{m}") for m in MONTHS]))


def phenology(landed: DataFrame) -> DataFrame:
    """Records by month of each annotated value of each taxon."""
    return landed.distinct().select(
        F.col("item_key").alias("taxonID"), json_int("json", "$.count").alias("count"),
        json_int("json", "$.controlled_attribute.id").alias("attribute_id"), json_text("json", "$.controlled_attribute.label").alias("attribute_label"),
        json_int("json", "$.controlled_value.id").alias("value_id"), json_text("json", "$.controlled_value.label").alias("value_label"), *_months(),
    )


def annotation_types(phenology: DataFrame) -> DataFrame:
    """The different attributes and values of annotations."""
    return phenology.select("attribute_label", "value_label").distinct()


def densities(monthly: DataFrame, places: int | None = None) -> DataFrame:
    """Months as shares of the count; null where the count is 0."""
    share = lambda m: ratio(f"month_{m}", "count")
    return monthly.withColumns({f"month_{m}_density": share(m) if places is None else round_half_away(share(m), places) for m in MONTHS})


def similar_species(landed: DataFrame) -> DataFrame:
    return landed.distinct().select(F.col("item_key").alias("taxonID"), json_int("json", "$.count").alias("count"), json_int("json", "$.taxon.id").alias("similar_taxon"))


def species(records: DataFrame) -> DataFrame:
    return records.select("taxonID", "species", "taxonRank", "phylum", "class", "order", "family", "genus", "iucnRedListCategory").distinct()
