"""Queries of this folder, and SQL for those that SQL can state on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.functions.tables import table
from quillrank.llm import calibrated_sample, canonical, encoding, name_links, near_duplicates, packing, rank_fusion, reading_level


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_table(table(spark, sf_dir, "documents"))


QUERIES = {
    "p3_found": name_links.p3_found,
    "p3_organisations": name_links.p3_organisations,
    "p4_found": calibrated_sample.p4_found,
    "p4_strata": calibrated_sample.p4_strata,
    "p4_sample": calibrated_sample.p4_sample,
    "p4_checks": calibrated_sample.p4_checks,
    "p5_found": near_duplicates.p5_found,
    "p5_groups": near_duplicates.p5_groups,
    "p6_found": rank_fusion.p6_found,
    "p6_significance": rank_fusion.p6_significance,
    "p7_found": canonical.p7_found,
    "p8_ids": p8_ids,
    "p9_found": packing.p9_found,
    "p9_fill": packing.p9_fill,
    "p9_checks": packing.p9_checks,
    "p10_found": reading_level.p10_found,
}

SQL = {
    "p4_found": calibrated_sample.P4_FOUND_SQL,
    "p4_checks": calibrated_sample.P4_CHECKS_SQL,
    "p5_found": near_duplicates.P5_FOUND_SQL,
    "p6_found": rank_fusion.P6_FOUND_SQL,
    "p6_significance": rank_fusion.P6_SIGNIFICANCE_SQL,
    "p9_checks": packing.P9_CHECKS_SQL,
    "p10_found": reading_level.P10_SQL,
}
