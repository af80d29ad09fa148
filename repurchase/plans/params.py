"""Parameters of the analysis: the reference's values and the fixture values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed labels and day edges of the repurchase-gap tiers, in tier order.
GAP_TIERS = (
    (7, "01. Within 1 Week"),
    (14, "02. 1-2 Weeks"),
    (30, "03. 2 Weeks - 1 Month"),
    (60, "04. 1-2 Months"),
    (90, "05. 2-3 Months"),
    (180, "06. 3-6 Months"),
)
GAP_TIER_REST = "07. Over 6 Months"

# Fixed labels of the seller-count split (1, 2, 3, 4 or more sellers).
SELLER_COUNT_LABELS = (
    "1. Single Seller Order",
    "2. Cross 2 Sellers",
    "3. Cross 3 Sellers",
    "4. Cross 4 or More Sellers",
)

# Fixed labels of the buyer/seller state relation of multi-seller orders.
GEOGRAPHY_LABELS = (
    "1. Same State (Buyer & All Sellers in Same State)",
    "2. Mixed States (Sellers Across States, Part Match with Buyer)",
    "3. Cross States (All Sellers in Same State, But Different from Buyer)",
    "4. Full Cross States (Buyer & All Sellers in Different States)",
)

# Fixed labels of review scores 5..1, then no review (score 0).
REVIEW_LABELS = ((5, "5 Stars"), (4, "4 Stars"), (3, "3 Stars"), (2, "2 Stars"), (1, "1 Star"))
REVIEW_NONE = "0 (No Review)"

# Fixed labels of why a cohort order is kept or dropped by the marts.
FILTER_REASONS = (
    "1. Missing Carrier/Customer Date",
    "2. Negative Shipping Duration",
    "3. 完好活下來的純淨運送訂單",
)

# Fixed names of the three tables compared by the consistency check.
CONSISTENCY_TABLES = (
    "step3_mature_customers",
    "dm_state_logistics_retention_summary",
    "dm_state_logistics_retention_summary_with_reviews",
)


@dataclass(frozen=True)
class Params:
    """Parameters of one run; defaults are the reference's values."""

    delivered_status: str = "delivered"
    maturity_cutoff: str = "2018-03-07 00:00:00"
    tier_edges: tuple[float, float, float] = (4.0, 3.0, 2.0)
    slow_delivery_days: int = 90
    slow_shipping_days: int = 90
    high_freight: int = 150
    focus_state: str = "MT"
    top_gaps: int = 200
    top_categories: int = 10
    low_review_max: int = 2
    # The two category rows the analysis back-fills before
    # adding the category reference.
    backfill_categories: tuple[tuple[str, str], ...] = (
        ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_and_food_preparers"),
        ("pc_gamer", "pc_gamer"),
    )
    expected_failures: frozenset[str] = field(default_factory=lambda: frozenset({"fk_leads_closed_seller_id"}))


REFERENCE = Params()

# Values for the driver's fixture tables (FIXTURES.md §3).
FIXTURE = replace(
    REFERENCE,
    maturity_cutoff="1997-01-01 00:00:00",
    tier_edges=(92.0, 90.0, 88.0),
    high_freight=3000,
    focus_state="S7",
    expected_failures=frozenset(
        {"fk_leads_closed_seller_id", "fk_leads_closed_mql_id", "pk_order_items", "pk_order_payments"}
    ),
)
