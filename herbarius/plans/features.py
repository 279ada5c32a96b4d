"""Feature tables of the citizen records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import days_between, flag, month_pick, ratio, round_half_away
from ..operators.aggregates import activity, identifications, log_z_scores, percent_rank
from ..operators.relational import merge_all
from ..operators.spatial import with_range

DENSITIES = [f"month_{m}_density" for m in range(1, 13)]


def observer(records: DataFrame) -> DataFrame:
    """Profile of each observer.  The shares of annotated records count different values, as the scores expect."""
    base = activity(records, "recordedBy", "gbifID", "species", "eventDate", "obsv_")
    few = lambda c, p: round_half_away(ratio(F.count_distinct(F.when(p, F.col(c))), F.count_distinct("gbifID")), 3)
    more = records.filter("recordedBy is not null").groupBy("recordedBy").agg(
        few("gbifID", F.col("identifiedByID").isNotNull()).alias("obsv_expert_ids_pct"),
        few("coordinateUncertaintyInMeters", F.col("coordinateUncertaintyInMeters") > 1000).alias("obsv_high_cood_un_pct"),
        round_half_away(F.avg("coordinateUncertaintyInMeters"), 3).alias("obsv_avg_coord_un"),
        round_half_away(F.avg("media_count"), 2).alias("obsv_avg_media_count"),
        *(few(c, F.col(c).isNotNull()).alias(n) for c, n in (("pheno_sex", "obsv_sex_meta_pct"), ("pheno_repro", "obsv_repro_cond_meta_pct"), ("pheno_leaves", "obsv_annot_meta_pct"))),
        F.coalesce(round_half_away(F.avg(F.length("occurrenceRemarks"))), F.lit(0.0)).alias("obsv_avg_descr_len"),
    )
    names = {"obsv_unique_years": "obsv_unique_year_count", "obsv_obs_per_year": "obs_per_year"}
    return base.withColumnsRenamed(names).join(more, "recordedBy")


def identifier(records: DataFrame) -> DataFrame:
    return identifications(records, "identifiedBy", "recordedBy", "species", "eventDate", "dateIdentified")


def observer_standing(people: DataFrame, citizens: DataFrame) -> DataFrame:
    """Standing of citizen observers among all: z-scores of logarithms, and percent rank by observations."""
    z = log_z_scores(people, ["observations_count", "identifications_count", "species_count", "universal_search_rank"])
    joined = z.join(citizens.select("user_id", "recordedBy"), "user_id")
    return percent_rank(joined, "observations_count", "obs_p_rank")


def taxon_identifiers(records: DataFrame) -> DataFrame:
    return records.groupBy("taxonID", "identifiedBy").agg(F.count("gbifID").alias("taxon_id_count"))


def community(records: DataFrame) -> DataFrame:
    agree, other = F.col("num_identification_agreements"), F.col("num_identification_disagreements")
    return records.filter(agree > 0).select("gbifID", (agree + other).alias("cmva_id_count"), round_half_away(ratio(agree, agree + other), 4).alias("cmva_id_agree_rate"), days_between("eventDate", "dateIdentified").alias("cmva_id_time"), flag(F.col("identifiedByID").isNotNull()).alias("cmva_expert_id"))


def metadata(records: DataFrame) -> DataFrame:
    known = [flag(F.col(c).isNotNull()).alias(f"meta_{c}") for c in ("pheno_repro", "pheno_leaves", "pheno_sex")]
    return records.select("gbifID", "species", F.col("media_count").cast("int").alias("meta_media_count"), F.col("coordinateUncertaintyInMeters").alias("meta_coordinateUncertaintyInMeters"), *known, F.coalesce(F.length("occurrenceRemarks"), F.lit(0)).alias("meta_occurrenceRemarks"))


def temporal(records: DataFrame) -> DataFrame:
    return records.select("gbifID", *(F.col(c).alias(f"tempo_{c}") for c in ("day", "month", "year")))


def confusability(records: DataFrame, similar: DataFrame) -> DataFrame:
    """Different similar taxa of each taxon; the sides are made unique before they are joined."""
    pairs = similar.groupBy("taxonID").agg(F.count_distinct("similar_taxon").alias("n"))
    return records.select("taxonID").distinct().join(pairs, "taxonID", "left").select("taxonID", F.coalesce("n", F.lit(0)).alias("taxo_confusability_index"))


def monthly_density(records: DataFrame, histogram: DataFrame) -> DataFrame:
    joined = records.select("gbifID", "taxonID", "month").join(histogram.select("taxonID", "count", *DENSITIES), "taxonID", "left")
    return joined.select("gbifID", F.col("count").alias("histo_taxon_ttl_obs_count"), month_pick("month", DENSITIES).alias("histo_taxon_obs_month_density"))


def annotation_density(records: DataFrame, phenology: DataFrame, column: str) -> DataFrame:
    """The share of the record's month among records of its taxon with its annotation, 0 without."""
    p = phenology.select("taxonID", F.col("value_id").alias(column), *DENSITIES)
    joined = records.select("gbifID", "taxonID", "month", column).join(p, ["taxonID", column], "left")
    return joined.select("gbifID", F.coalesce(month_pick("month", DENSITIES), F.lit(0.0)).alias(f"{column}_month_density"))


def annotations(records: DataFrame, phenology: DataFrame) -> DataFrame:
    leaves, repro, sex = (annotation_density(records, phenology, c) for c in ("pheno_leaves", "pheno_repro", "pheno_sex"))
    return leaves.join(repro, "gbifID").join(sex, "gbifID")


def ranges(records: DataFrame, species_ranges: DataFrame) -> DataFrame:
    points = records.select("gbifID", "taxonID", F.col("geom.x").alias("__x"), F.col("geom.y").alias("__y"))
    return with_range(points, species_ranges.withColumnRenamed("taxon_id", "taxonID").select("taxonID", "edges", *(c for c in ("minx", "miny", "maxx", "maxy") if c in species_ranges.columns)), "taxonID", "__x", "__y", name="range").select("gbifID", "range")


def samples(labelled: DataFrame, *sampled: DataFrame) -> DataFrame:
    """Raster samples of labelled records, out of one table or several of equal columns."""
    rows = [labelled.select("gbifID").join(s.drop("gee_id", "coordinates"), "gbifID") for s in sampled]
    return reduce(lambda a, b: a.unionByName(b), rows)


def combined(records: DataFrame, by_observer: list[DataFrame], by_identifier: DataFrame, by_taxon: list[DataFrame], by_record: list[DataFrame], optional: list[DataFrame] = ()) -> DataFrame:
    """One row per record with all features; identifier profiles are looked up by observer."""
    keys = records.select("gbifID", "recordedBy", "taxonID")
    parts = [(t, "recordedBy", "inner") for t in by_observer]
    parts.append((by_identifier.withColumnRenamed("identifiedBy", "recordedBy"), "recordedBy", "left"))
    parts += [(t, "taxonID", "inner") for t in by_taxon] + [(t, "gbifID", "inner") for t in by_record] + [(t, "gbifID", "left") for t in optional]
    return merge_all(keys, parts).drop("recordedBy", "taxonID")
