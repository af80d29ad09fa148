"""Run the whole analysis: load, check keys, publish marts, write reports.

    python -m repurchase --tables /data/retail --out /shared/retention-run \\
        [--cutoff 2018-03-07] [--state MT] [--allow NAME,...]

The session comes from ``SparkSession.builder.getOrCreate()``, so master and
resources are taken from spark-defaults.conf or the environment.

``--tables`` holds one parquet dataset per table, named as in the analysis
(orders, order_items, sellers, customers, ...). Everything is written under
``--out`` (a folder every executor can reach): the cohort stages, the three
dashboard tables, and one folder per report under ``reports/``.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators import cohort, explore, logistics, marts, quality
from .plans.params import REFERENCE
from .plans.pipeline import Analysis, publish
from .sources import (
    REFERENCE_TABLES,
    REQUIRED_COLUMNS,
    cast_losses,
    list_tables,
    load_tables,
    normalize_types,
    table_inventory,
    write_table,
)


def reports(a: Analysis) -> dict:
    """Every report of the exploration and logistics scripts, by ID."""
    p = a.p
    return {
        "V1_pk_duplicates": quality.pk_duplicate_report(a.t),
        "V2_pk_nulls": quality.pk_null_report(a.t),
        "V2_pk_null_rows": quality.pk_null_rows(a.t),
        "V3_fk_orphans": quality.fk_orphan_report(a.t),
        "V4_fk_orphan_summary": quality.fk_summary_report(a.t),
        "V5_constraint_gate": a.constraint_report(),
        "E1_purchase_range": explore.purchase_range(a.orders),
        "E2_delivered_range": explore.purchase_range(a.orders, p.delivered_status),
        "E3_delivered_ratio": explore.status_ratio(a.orders, p.delivered_status),
        "E4_status_counts": explore.status_counts(a.orders),
        "E5_new_customers_by_quarter": explore.new_customers_by_quarter(a.effective),
        "E6_repeat_overall": explore.repeat_overall(a.effective),
        "E7_repeat_by_state": explore.repeat_by_state(a.effective),
        "E8_retention_tiers": explore.retention_tiers(explore.state_repeat_metrics(a.effective), p.tier_edges),
        "E9_repurchase_intervals": explore.repurchase_intervals(a.effective),
        "E10_longest_gaps": explore.longest_gaps(a.effective, a.items, a.products, a.translation, p.top_gaps),
        "E11_items_per_order": explore.items_per_order(a.items),
        "E12_sellers_per_order": explore.sellers_per_order(a.orders, a.items, p.delivered_status),
        "E13_multi_seller_geography": explore.multi_seller_geography(
            a.orders, a.items, a.sellers, a.customers, p.delivered_status
        ),
        "C3_order_count_distribution": cohort.order_count_distribution(a.people),
        "C5b_mature_order_count_distribution": cohort.order_count_distribution(a.mature),
        "C6_cohort_grain_check": cohort.cohort_grain(a.mature_orders),
        "L1_shipping_profile": logistics.shipping_profile(a.mature_orders, p.slow_shipping_days),
        "L2_slow_orders_by_state": logistics.slow_orders_by_state(a.mature_orders, p.slow_delivery_days),
        "L3_orders_without_items": logistics.orders_without_items(a.mature_orders, a.items),
        "L4_freight_profile": logistics.freight_profile(a.mature_orders, a.items, p.high_freight),
        "L5_freight_outliers_by_state": logistics.freight_outliers_by_state(a.mature_orders, a.items, p.high_freight),
        "R1_multi_review_orders": logistics.multi_review_orders(a.reviews),
        "R2_review_distribution": logistics.review_distribution(a.mature_orders, a.reviews),
        "G1_multi_state_people": logistics.multi_state_people(a.mature_orders),
        "G2_cross_state_by_state": logistics.cross_state_by_state(a.mature_orders, a.items, a.sellers),
        "M2b_state_mart_reviews_dedup": a.state_mart_reviews(dedupe=True),
        "M3_mart_consistency": marts.mart_consistency(a.mature, *a.stored_marts),
        "M4_filter_reasons": marts.filter_reasons(a.mature_orders),
        "M6_top_categories": marts.top_categories(
            a.customers, a.orders, a.items, a.products, a.translation, p.focus_state, p.top_categories
        ),
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="repurchase", description=__doc__.split("\n\n")[0])
    ap.add_argument("--tables", required=True, help="folder with one parquet dataset per table")
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--cutoff", default=None, help="maturity cutoff timestamp (default: the reference's)")
    ap.add_argument("--state", default=None, help="state for the top-category report")
    ap.add_argument("--allow", default="", help="comma-separated constraints allowed to fail (besides the default)")
    args = ap.parse_args(argv)

    params = REFERENCE
    if args.cutoff:
        params = replace(params, maturity_cutoff=args.cutoff)
    if args.state:
        params = replace(params, focus_state=args.state)
    extra = {a.strip() for a in args.allow.split(",") if a.strip()}
    if extra:
        params = replace(params, expected_failures=params.expected_failures | extra)

    spark = SparkSession.builder.appName("repurchase").getOrCreate()
    found = list_tables(spark, args.tables)
    absent = sorted(set(REFERENCE_TABLES) - set(found))
    if absent:
        ap.error(f"{args.tables} lacks the tables {', '.join(absent)}")
    loaded = load_tables(spark, args.tables, found, REQUIRED_COLUMNS)
    raw = {name: loaded[name] for name in REFERENCE_TABLES}
    tables = normalize_types(raw)
    checks = {"S1_load_tables": table_inventory(loaded), "S1_cast_losses": cast_losses(raw, tables)}
    tables["product_category_name_translation"] = Analysis(tables, params).translation_filled
    out = args.out.rstrip("/")
    published = publish(tables, params, f"{out}/published")
    tables["order_items"] = published["order_items"]
    staged = Analysis.with_stages(tables, params, published)
    for name, df in (checks | reports(staged)).items():
        write_table(df, f"{out}/reports/{name}")


if __name__ == "__main__":
    main()
