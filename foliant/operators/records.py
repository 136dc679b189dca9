"""Facts of a case put together from its parts, and records on their way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stay_days
from .fees import MEDICAL_TYPES, MONEY

RECORDS = ("medical_record", "discharge_summary", "admission_record")
# What a case counts with where nothing else is known.
DEFAULTS = {
    "annual_income": 49283, "annual_consumption": 33382, "monthly_salary": 8500, "nursing_annual_salary": 102000, "daily_food_subsidy": 100, "daily_nutrition": 30,
    "compensation_years": 0, "disability_coefficient": 0, "hospital_days": 0, "lost_wage_days": 0, "nursing_days": 0, "nutrition_days": 0, "nursing_dependency_level": "full", "nursing_person_count": 1, "victim_age": 0,
}


def empty_reasons(cases: DataFrame, materials: DataFrame) -> DataFrame:
    """case_id and why its catalog is empty: no_materials, all_failed (of materials with ocr_status), or null if it need not be."""
    counts = materials.groupBy("case_id").agg(F.count("*").alias("_n"), F.count_if(F.col("ocr_status") == "failed").alias("_failed"))
    rows = cases.select("case_id").join(counts, "case_id", "left")
    return rows.select("case_id", F.when(F.col("_n").isNull(), "no_materials").when(F.col("_failed") == F.col("_n"), "all_failed").alias("empty_reason"))


def hospital_of(known: Column, direct: Column, frequent: Column) -> Column:
    """struct(name, other): a known name that is complete stays; else a longer one from the defendant's papers, then the most frequent one.

    A name that is replaced is the other one.
    """
    known, direct = F.coalesce(known, F.lit("")), F.coalesce(direct, F.lit(""))
    complete = (F.length(known) >= 4) & known.contains("医院")
    better = (direct != "") & (F.length(direct) > F.length(known))
    name = F.when(complete, known).when(better, direct).when(known != "", known).otherwise(frequent)
    return F.struct(name.alias("name"), F.when(~complete & better & (known != ""), known).alias("other"))


def case_stays(materials: DataFrame) -> DataFrame:
    """Per case with one, the days in hospital of its last record (by material_id) that tells them, and that record's file."""
    days = materials.where(F.col("category").isin(*RECORDS)).select("case_id", "material_id", "filename", stay_days(F.col("ocr_text")).alias("days"))
    return days.where("days > 0").groupBy("case_id").agg(F.max_by(F.struct("days", "filename"), "material_id").alias("s")).select("case_id", "s.*")


def medical_fees(cases: DataFrame, items: DataFrame) -> DataFrame:
    """Per case the medical total, its basis in words, whether it has to be entered by hand, and the receipts it is from, in order."""
    kept = items.where(F.col("fee_type").isin(*MEDICAL_TYPES))
    sums = kept.groupBy("case_id").agg(F.sum("amount").cast(MONEY).alias("_sum"), F.sort_array(F.collect_list("material_id")).alias("_sources"))
    rows = cases.select("case_id").join(sums, "case_id", "left")
    n = F.size("_sources")
    basis = F.when(F.col("_sources").isNull(), "需手动输入或从发票提取").otherwise(F.concat(n.cast("string"), F.lit("份发票合计")))
    amount = F.coalesce("_sum", F.lit(0).cast(MONEY))
    return rows.select("case_id", amount.alias("amount"), basis.alias("basis"), (amount == 0).alias("is_manual"), F.coalesce("_sources", F.array().cast("array<bigint>")).alias("sources"))


def params_of(cases: DataFrame, stays: DataFrame, user: DataFrame) -> DataFrame:
    """case_id and the parameters of each case: the user's where not null, then the days of its records, then the defaults."""
    said = [c for c in user.columns if c in DEFAULTS]
    rows = cases.select("case_id").join(stays.select("case_id", F.col("days").alias("_days")), "case_id", "left").join(user.select("case_id", *[F.col(c).alias(f"_{c}") for c in said]), "case_id", "left")
    stay = {"hospital_days": [F.when(F.col("_days") > 0, F.col("_days"))]}
    return rows.select("case_id", *[F.coalesce(*([F.col(f"_{k}")] if k in said else []), *stay.get(k, []), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def shortened(documents: DataFrame, most: int = 30_000, pages: int = 5) -> DataFrame:
    """documents (doc_id, pages: array of strings) as JSON of at most `most` characters for a model: document, and pages_kept.

    Pages whose JSON is longer than half of that are cut to the first `pages`, with a note; what is still too long is cut off and marked.
    """
    long = F.length(F.to_json("pages")) > most // 2
    kept = F.when(long, F.slice("pages", 1, pages)).otherwise(F.col("pages"))
    note = F.when(long, F.format_string(f"仅保留前 {pages} 页（共 %d 页）", F.size("pages")))
    rows = documents.select("doc_id", F.size(kept).alias("pages_kept"), F.to_json(F.struct("doc_id", kept.alias("pages"), note.alias("_note"))).alias("_j"))
    cut = F.concat(F.substring("_j", 1, most), F.lit("\n... (truncated)"))
    return rows.select("doc_id", "pages_kept", F.when(F.length("_j") > most, cut).otherwise(F.col("_j")).alias("document"))


def stored_names(files: DataFrame) -> DataFrame:
    """files (name, error_code, ts) with stored_as: a failed file's code before its name; of good files of a name the first keeps
    it, and later ones have the second of their arrival before it."""
    good = F.col("error_code").isNull()
    w = Window.partitionBy("name", good).orderBy("ts")
    later = F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("_"), "name")
    named = F.when(~good, F.concat("error_code", F.lit("_"), "name")).when(F.col("_k") > 1, later).otherwise(F.col("name"))
    return files.withColumn("_k", F.row_number().over(w)).withColumn("stored_as", named).drop("_k")


def structure_counts(tree: DataFrame) -> DataFrame:
    """Per document what quality scores ask of document_tree(): sections, depth, levels, headings, paragraphs and orphans."""
    none = F.col("section").isNull()
    return tree.groupBy("doc_id").agg(
        F.count("section").alias("sections"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.countDistinct("level").alias("levels"),
        F.sum(F.size("paragraphs")).alias("paragraphs"), F.coalesce(F.sum(F.when(none, F.size("paragraphs"))), F.lit(0)).alias("orphans"),
    )
