"""DuckDB SQL for every registered query, from the definitions in SURVEY §2.

Everything rests on four shared facts over the role-mapped tables: ``sale``
(a delivered order with its person), ``person`` (one row each, with the latest
state), ``cohort`` (sales of people who bought early enough) and ``parcel``
(one row per order with lists of its items' sellers and states). Key lists are
written out here rather than taken from the code under test. Rounding uses
the integer rules of ``repurchase.functions.numeric`` so both engines agree.

Role tables are prefixed ``fx_`` so they never shadow the driver's views.
"""

from __future__ import annotations

from ..plans.params import (
    CONSISTENCY_TABLES,
    FILTER_REASONS,
    FIXTURE,
    GAP_TIER_REST,
    GAP_TIERS,
    GEOGRAPHY_LABELS,
    REVIEW_LABELS,
    REVIEW_NONE,
    SELLER_COUNT_LABELS,
    Params,
)

DAY = 86_400_000_000

# Table, its key columns.
KEYS = (
    ("orders", "order_id"),
    ("order_items", "order_id", "order_item_id"),
    ("sellers", "seller_id"),
    ("customers", "customer_id"),
    ("leads_closed", "mql_id"),
    ("order_payments", "order_id", "payment_sequential"),
    ("products", "product_id"),
    ("product_category_name_translation", "product_category_name"),
    ("order_reviews", "review_id", "order_id"),
    ("geolocation", "geolocation_id"),
    ("leads_qualified", "mql_id"),
)
# Child table, key in both tables, parent table, and whether the
# report lists every orphan row (null keys too) or each orphan key once.
REFERENCES = (
    ("orders", "customer_id", "customers", True),
    ("order_payments", "order_id", "orders", True),
    ("products", "product_category_name", "product_category_name_translation", False),
    ("order_reviews", "order_id", "orders", False),
    ("order_items", "order_id", "orders", False),
    ("order_items", "product_id", "products", False),
    ("order_items", "seller_id", "sellers", False),
    ("leads_closed", "mql_id", "leads_qualified", False),
    ("leads_closed", "seller_id", "sellers", False),
)


# ---------------------------------------------------------------- helpers
def rri(n: str, d: str, dp: int) -> str:
    """round(n/d, dp) * 10**dp as BIGINT, halves away from zero."""
    s = 10**dp
    return (
        f"(CAST(sign(CAST({n} AS HUGEINT)) AS BIGINT) * CAST(sign(CAST({d} AS HUGEINT)) AS BIGINT)"
        f" * CAST((abs(CAST({n} AS HUGEINT)) * {2 * s} + abs(CAST({d} AS HUGEINT)))"
        f" // (abs(CAST(NULLIF({d}, 0) AS HUGEINT)) * 2) AS BIGINT))"
    )


def rrd(n: str, d: str, dp: int) -> str:
    return f"(CAST({rri(n, d, dp)} AS DOUBLE) / {10**dp})"


def pct(n: str, d: str, dp: int = 2) -> str:
    return rrd(f"CAST({n} AS HUGEINT) * 100", d, dp)


def unit(x: str, dp: int) -> str:
    return f"(CAST({x} AS DOUBLE) / {10**dp})"


def round_double(x: str, dp: int) -> str:
    s = float(10**dp)
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def us(a: str, b: str) -> str:
    """b - a in microseconds."""
    return f"(epoch_us({b}) - epoch_us({a}))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(pairs: list[tuple[str, str]], default: str) -> str:
    body = " ".join(f"WHEN {c} THEN {lit(v)}" for c, v in pairs)
    return f"CASE {body} ELSE {lit(default)} END"


def percentiles(src: str, keys: list[str], measures: dict[str, str], requests: dict[str, tuple[str, int]]) -> str:
    """SELECT keys, X... with X = 100 * PERCENTILE_CONT(p) by explicit ranks."""
    kc = ", ".join(keys)
    kpre = kc + ", " if keys else ""
    union = " UNION ALL ".join(
        f"SELECT {kpre}{lit(m)} AS m, CAST({e} AS BIGINT) AS v FROM {src} WHERE ({e}) IS NOT NULL"
        for m, e in measures.items()
    )
    part = f"PARTITION BY {kpre}m"
    ranked = (
        f"SELECT {kpre}m, v, row_number() OVER ({part} ORDER BY v) - 1 AS rk, count(*) OVER ({part}) AS n FROM ({union}) t"
    )
    cols = []
    for out, (m, p) in requests.items():
        pos = f"({p} * (n - 1))"
        lo_r = f"({pos} // 100)"
        hi_r = f"({lo_r} + CASE WHEN {pos} % 100 > 0 THEN 1 ELSE 0 END)"
        lo = f"CAST(max(v) FILTER (WHERE m = {lit(m)} AND rk = {lo_r}) AS HUGEINT)"
        hi = f"CAST(max(v) FILTER (WHERE m = {lit(m)} AND rk = {hi_r}) AS HUGEINT)"
        fr = f"CAST(max({pos} % 100) FILTER (WHERE m = {lit(m)}) AS HUGEINT)"
        cols.append(f"({lo} * 100 + ({hi} - {lo}) * {fr}) AS {out}")
    group = f" GROUP BY {kc}" if keys else ""
    return f"SELECT {kpre}{', '.join(cols)} FROM ({ranked}) r{group}"


# ----------------------------------------------------------- role tables
def roles(p: Params) -> dict[str, str]:
    """The role mapping of FIXTURES.md, one query per CTE."""
    status = "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'processing' END"
    state = "'S' || CAST({} % 8 AS VARCHAR)"
    freight = (
        "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(12,2))"
    )
    extra = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in p.backfill_categories)
    return {
        "fx_dates": """SELECT l_orderkey AS order_id, min(CASE l_linestatus WHEN 'F' THEN l_shipdate END) AS carrier_at,
            max(CASE l_linestatus WHEN 'O' THEN l_shipdate END) AS received_at FROM lineitem GROUP BY ALL""",
        "fx_orders": f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id, {status} AS order_status, o_orderdate AS bought_at,
            carrier_at, received_at FROM orders LEFT JOIN fx_dates ON order_id = o_orderkey""",
        "fx_customers": f"""SELECT c_custkey AS customer_id, c_custkey - CAST(c_custkey % 10 = 1 AS INTEGER) AS person,
            {state.format("c_nationkey")} AS own_state FROM customer""",
        "fx_sellers": f"SELECT s_suppkey AS seller_id, {state.format('s_nationkey')} AS seller_state FROM supplier",
        "fx_order_items": f"""SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
            CAST(p_retailprice AS DECIMAL(12,2)) AS price, {freight} AS freight FROM lineitem JOIN part ON p_partkey = l_partkey""",
        "fx_products": "SELECT p_partkey AS product_id, nullif(p_brand, CASE p_size WHEN 50 THEN p_brand END) AS product_category_name FROM part",
        "fx_product_category_name_translation": """SELECT DISTINCT p_brand AS product_category_name,
            concat('en_', p_brand) AS product_category_name_english FROM part""",
        "fx_filled": f"""FROM fx_product_category_name_translation UNION ALL
            (FROM (VALUES {extra}) v(product_category_name, product_category_name_english)
             ANTI JOIN fx_product_category_name_translation USING (product_category_name))""",
        "fx_order_reviews": """SELECT o_orderkey AS review_id, o_orderkey AS order_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS review_score FROM orders
            UNION ALL SELECT -o_orderkey - 1, o_orderkey, CAST(1 + o_orderkey % 5 AS INTEGER) FROM orders WHERE o_orderkey % 17 = 0""",
        "fx_order_payments": "SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential FROM lineitem",
        "fx_geolocation": "SELECT n_nationkey AS geolocation_id FROM nation",
        "fx_leads_qualified": "SELECT DISTINCT user_id AS mql_id FROM events WHERE event_type = 'signup'",
        "fx_leads_closed": "SELECT DISTINCT user_id AS mql_id, user_id AS seller_id FROM events WHERE event_type = 'purchase'",
    }


def facts(p: Params) -> dict[str, str]:
    late = "TIMESTAMP '9999-12-31'"
    return {
        "sale": f"SELECT order_id, customer_id, person, own_state, bought_at, carrier_at, received_at, order_status "
        f"FROM fx_orders NATURAL JOIN fx_customers WHERE order_status = {lit(p.delivered_status)}",
        # A null time counts as the latest; ties go to the larger order.
        "person": f"""SELECT person, count(*) AS n_orders, min(bought_at) AS first_at,
            arg_max(own_state, {{'t': coalesce(bought_at, {late}), 'o': order_id}}) AS buyer_state FROM sale GROUP BY person""",
        "early": f"FROM person WHERE first_at <= TIMESTAMP {lit(p.maturity_cutoff)}",
        "cohort": "SELECT sale.*, buyer_state, epoch_us(received_at) - epoch_us(carrier_at) AS travel FROM sale JOIN early USING (person)",
        "parcel": """SELECT order_id, count(*) AS n_items, count(DISTINCT i.seller_id) AS n_sellers,
            list(seller_state) FILTER (WHERE s.seller_id IS NOT NULL) AS states,
            CAST(100 * sum(price) FILTER (WHERE s.seller_id IS NOT NULL) AS BIGINT) AS price_cents,
            CAST(100 * sum(freight) FILTER (WHERE s.seller_id IS NOT NULL) AS BIGINT) AS freight_cents,
            CAST(100 * sum(freight) AS BIGINT) AS all_freight_cents
            FROM fx_order_items i LEFT JOIN fx_sellers s ON s.seller_id = i.seller_id GROUP BY order_id""",
        "rated": "SELECT order_id, count(*) AS n_reviews, max(review_score) AS best FROM fx_order_reviews GROUP BY order_id",
        # What the marts are made of. `fan` is how often an order's items
        # count where its reviews are joined without reducing them first.
        "trip": """SELECT order_id, person, buyer_state, price_cents, freight_cents, travel, best, greatest(coalesce(n_reviews, 1), 1) AS fan,
            CAST(len(list_filter(states, lambda x: x <> buyer_state)) > 0 AS INTEGER) AS is_cross
            FROM cohort JOIN parcel USING (order_id) LEFT JOIN rated USING (order_id) WHERE travel >= 0 AND len(states) > 0""",
        "loyalty": f"""SELECT buyer_state, count(*) AS total_customers_mature,
            {pct("count(*) FILTER (WHERE n_orders > 1)", "count(*)")} AS retention_rate_percentage FROM early GROUP BY buyer_state""",
    }


def select(p: Params, body: str, **more: str) -> str:
    ctes = {**roles(p), **facts(p), **more}
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


def share(n: str = "count(*)") -> str:
    return pct(n, f"sum({n}) OVER ()")


# ------------------------------------------------------- keys, references
def table_of(name: str, filled: bool = False) -> str:
    return "fx_filled" if filled and name == "product_category_name_translation" else f"fx_{name}"


def key_text(keys) -> str:
    return " || '|' || ".join(rf"coalesce(regexp_replace(CAST({k} AS VARCHAR), '([\\|<])', '\\\1', 'g'), '<null>')" for k in keys)


def orphans(child: str, key: str, parent: str, filled: bool = False) -> str:
    """Rows of the child without a parent, null keys too."""
    return (
        f"(SELECT {key} AS k FROM {table_of(child, filled)} c WHERE NOT EXISTS "
        f"(FROM {table_of(parent, filled)} x WHERE x.{key} = c.{key}))"
    )


def key_checks(p: Params) -> dict[str, str]:
    union = " UNION ALL ".join
    dup, null, null_rows, lost, summary, gate = [], [], [], [], [], []
    for t, *keys in KEYS:
        name, cols, any_null = lit(f"pk_{t}"), ", ".join(keys), " OR ".join(f"{k} IS NULL" for k in keys)
        dup.append(f"(SELECT {name} AS constraint_name, {key_text(keys)} AS key_value, count(*) AS count_num FROM {table_of(t)} GROUP BY {cols} HAVING count(*) > 1)")
        null.append(f"(SELECT {name} AS constraint_name, count(*) FILTER (WHERE {any_null}) AS null_key_rows FROM {table_of(t)})")
        null_rows.append(f"(SELECT {name} AS constraint_name, {key_text(keys)} AS key_value FROM {table_of(t)} WHERE {any_null})")
        gate.append(
            f"(SELECT {name} AS constraint_name, 'PRIMARY KEY' AS constraint_type, {lit(t)} AS table_name, "
            f"count(*) FILTER (WHERE c > 1) AS duplicate_keys, coalesce(CAST(sum(c) FILTER (WHERE bad) AS BIGINT), 0) AS null_key_rows, 0::BIGINT AS orphan_rows "
            f"FROM (SELECT count(*) AS c, ({any_null}) AS bad FROM {table_of(t, True)} GROUP BY {cols}))"
        )
    for child, key, parent, every in REFERENCES:
        name = lit(f"fk_{child}_{key}")
        what, where = ("", "") if every else ("DISTINCT ", " WHERE k IS NOT NULL")
        lost.append(f"(SELECT {what}{name} AS constraint_name, CAST(k AS VARCHAR) AS orphan_key FROM {orphans(child, key, parent)}{where})")
        summary.append(f"(SELECT {name} AS constraint_name, count(k) AS unmatched_rows, count(DISTINCT k) AS unmatched_key_count FROM {orphans(child, key, parent)})")
        gate.append(f"(SELECT {name}, 'FOREIGN KEY', {lit(child)}, 0, 0, count(k) FROM {orphans(child, key, parent, True)})")
    allowed = "[" + ", ".join(lit(n) for n in sorted(p.expected_failures)) + "]::VARCHAR[]"
    return {
        "V1_pk_duplicates": select(p, union(dup)),
        "V2_pk_nulls": select(p, union(null)),
        "V2_pk_null_rows": select(p, union(null_rows)),
        "V3_fk_orphans": select(p, union(lost)),
        "V4_fk_orphan_summary": select(p, union(summary)),
        "V5_constraint_gate": select(
            p,
            f"""SELECT *, duplicate_keys + null_key_rows + orphan_rows AS violations,
CASE WHEN violations > 0 AND list_contains({allowed}, constraint_name) THEN 'expected_failure' WHEN violations > 0 THEN 'fail' ELSE 'pass' END AS status
FROM gate""",
            gate=union(gate),
        ),
    }


# ------------------------------------------------------------ exploration
def explore(p: Params) -> dict[str, str]:
    done = lit(p.delivered_status)
    span = "SELECT min(bought_at) AS {}, max(bought_at) AS {}, count(bought_at) AS {} FROM {}"
    split = {
        "total_unique_customers": "count(*)",
        "one_time_customers": "sum(CAST(k = 1 AS BIGINT))::BIGINT",
        "repeat_customers": "sum(CAST(k > 1 AS BIGINT))::BIGINT",
        "one_time_customer_ratio_percentage": pct("sum(CAST(k = 1 AS BIGINT))", "count(*)"),
        "repeat_customer_ratio_percentage": pct("sum(CAST(k > 1 AS BIGINT))", "count(*)"),
    }
    repeat = ", ".join(f"{e} AS {n}" for n, e in split.items())
    # People with a dated sale; their state is that of the latest one.
    buyers = "SELECT person, count(*) AS k, arg_max(own_state, {'t': bought_at, 'o': order_id}) AS buyer_state FROM sale WHERE bought_at IS NOT NULL GROUP BY person"
    states = f"SELECT buyer_state, {repeat} FROM buyers GROUP BY buyer_state"
    hi, mid, lo = p.tier_edges
    edge = lambda x: f"{x:g}"
    tiers = [f">= {edge(hi)}%", f"{edge(mid)}%-{edge(hi)}%", f"{edge(lo)}%-{edge(mid)}%", f"< {edge(lo)}%"]
    rate = "repeat_customer_ratio_percentage"
    level = f"CAST({rate} >= {lo} AS INTEGER) + CAST({rate} >= {mid} AS INTEGER) + CAST({rate} >= {hi} AS INTEGER)"
    names = "[" + ", ".join(lit(x) for x in reversed(tiers)) + "]"
    numbered = "SELECT *, row_number() OVER (PARTITION BY person ORDER BY bought_at NULLS LAST, order_id) AS nth FROM sale"
    pairs = """SELECT a.person, a.order_id AS id1, a.bought_at AS t1, b.order_id AS id2, b.bought_at AS t2,
        epoch_us(b.bought_at) - epoch_us(a.bought_at) AS gap FROM numbered a JOIN numbered b ON b.person = a.person AND b.nth = a.nth + 1 WHERE b.bought_at IS NOT NULL"""
    gap_label = case([(f"gap <= {d * DAY}", label) for d, label in GAP_TIERS], GAP_TIER_REST)
    sellers = "[" + ", ".join(lit(x) for x in SELLER_COUNT_LABELS) + "]"
    geo = GEOGRAPHY_LABELS
    return {
        "E1_purchase_range": select(p, span.format("earliest_purchase_time", "latest_purchase_time", "total_orders", "fx_orders")),
        "E2_delivered_range": select(
            p, span.format("earliest_delivered_purchase_time", "latest_delivered_purchase_time", "delivered_orders", f"fx_orders WHERE order_status = {done}")
        ),
        "E3_delivered_ratio": select(
            p,
            f"SELECT total_orders, delivered_orders, {pct('delivered_orders', 'total_orders')} AS delivered_ratio_percentage FROM "
            f"(SELECT count(bought_at) AS total_orders, count(bought_at) FILTER (WHERE order_status = {done}) AS delivered_orders FROM fx_orders)",
        ),
        "E4_status_counts": select(p, "SELECT order_status, count(*) AS order_count FROM fx_orders GROUP BY ALL"),
        "E5_new_customers_by_quarter": select(
            p,
            f"""SELECT concat(year(first_at), '-Q', quarter(first_at)) AS first_purchase_quarter, count(*) AS new_customers_count,
{share()} AS pct_of_total_new_customers FROM person GROUP BY ALL""",
        ),
        "E6_repeat_overall": select(
            p,
            f"SELECT {repeat}, sum(k)::BIGINT AS total_orders, {rrd('sum(k)', 'count(*)', 2)} AS avg_orders_per_customer FROM buyers",
            buyers=buyers,
        ),
        "E7_repeat_by_state": select(p, states, buyers=buyers),
        "E8_retention_tiers": select(
            p,
            f"""SELECT {names}[1 + {level}] AS retention_tier, count(*) AS number_of_states, string_agg(buyer_state, ', ' ORDER BY buyer_state) AS included_states,
sum(total_unique_customers)::BIGINT AS total_customers, sum(s.one_time_customers)::BIGINT AS one_time_customers, sum(s.repeat_customers)::BIGINT AS repeat_customers,
{pct("sum(s.repeat_customers)", "sum(s.total_unique_customers)")} AS weighted_retention_rate_percentage,
{rrd(f"sum(CAST(round({rate} * 100) AS BIGINT))", "count(*) * 100", 2)} AS avg_state_retention_rate_percentage
FROM states s GROUP BY ALL""",
            buyers=buyers,
            states=states,
        ),
        "E9_repurchase_intervals": select(
            p,
            f"""SELECT {gap_label} AS repurchase_interval_tier, count(*) AS repurchase_count,
{rrd("sum(gap)", f"count(*) * {DAY}", 1)} AS avg_days_within_tier, {share()} AS pct_of_total_repurchases FROM pairs GROUP BY ALL""",
            numbered=numbered,
            pairs=pairs,
        ),
        "E10_longest_gaps": select(
            p,
            f"""SELECT person AS buyer_id, id1 AS first_order_id, t1 AS first_order_time, id2 AS second_order_id, t2 AS second_order_time,
tenths::DOUBLE / 10 AS gap_days, name AS first_order_category
FROM (SELECT *, {rri("gap", str(DAY), 1)} AS tenths FROM pairs) LEFT JOIN firsts ON firsts.order_id = id1
ORDER BY tenths DESC, person, id1, id2, name NULLS FIRST LIMIT {p.top_gaps}""",
            numbered=numbered,
            pairs=pairs,
            firsts="""SELECT i.order_id, t.product_category_name_english AS name FROM fx_order_items i NATURAL LEFT JOIN fx_products
                LEFT JOIN fx_product_category_name_translation t USING (product_category_name) WHERE i.order_item_id = 1""",
        ),
        "E11_items_per_order": select(
            p, f"SELECT n_items AS item_count, count(*) AS order_count, {share()} AS pct_of_total_orders FROM parcel GROUP BY n_items"
        ),
        "E12_sellers_per_order": select(
            p,
            f"""SELECT {sellers}[least(n_sellers, 4)] AS order_composition_type, count(*) AS order_count, {share()} AS pct_of_total_delivered_orders
FROM parcel SEMI JOIN (FROM fx_orders WHERE order_status = {done}) USING (order_id) GROUP BY ALL""",
        ),
        "E13_multi_seller_geography": select(
            p,
            f"""SELECT CASE WHEN len(kinds) = 1 THEN (CASE WHEN home THEN {lit(geo[0])} ELSE {lit(geo[2])} END)
WHEN home AND len(kinds) > 1 THEN {lit(geo[1])} ELSE {lit(geo[3])} END AS geographic_distribution_type,
count(*) AS order_count, {share()} AS pct_of_multi_seller_orders
FROM (SELECT list_distinct(states) AS kinds, list_contains(states, own_state) AS home FROM parcel JOIN sale USING (order_id) WHERE n_sellers >= 2) GROUP BY ALL""",
        ),
    }


# ----------------------------------------------------------------- cohort
def cohorts(p: Params) -> dict[str, str]:
    spread = "SELECT n_orders AS total_orders, count(*) AS customer_count, " + share() + " AS pct_of_customers FROM {} GROUP BY ALL"
    people = "person AS customer_unique_id, buyer_state AS customer_state, n_orders AS total_orders"
    return {
        "C1_effective_orders": select(
            p, "SELECT order_id, customer_id, person AS customer_unique_id, own_state AS customer_state, bought_at AS order_purchase_timestamp FROM sale"
        ),
        "C2_unique_customers": select(p, f"SELECT {people}, first_at AS first_purchase_time FROM person"),
        "C3_order_count_distribution": select(p, spread.format("person")),
        "C4_mature_customers": select(p, f"SELECT {people} FROM early"),
        "C5b_mature_order_count_distribution": select(p, spread.format("early")),
        "C6_cohort_grain_check": select(
            p,
            "SELECT len(list(DISTINCT person)) AS unique_customers, len(list(DISTINCT customer_id)) AS customer_records, "
            "len(list(DISTINCT order_id)) AS total_orders, count(*) AS joined_rows FROM cohort",
        ),
        "C7_mature_orders": select(
            p,
            """SELECT order_id, customer_id, person AS customer_unique_id, own_state AS customer_state, buyer_state, order_status,
bought_at AS order_purchase_timestamp, carrier_at AS order_delivered_carrier_date, received_at AS order_delivered_customer_date FROM cohort""",
        ),
    }


# -------------------------------------------------- logistics and reviews
def profile(p: Params, values: str, unit_of: int, kind: str, suffix: str, over: str, limit: int) -> str:
    marks = (("q1", 25), ("median", 50), ("q3", 75), ("p95", 95), ("p99", 99))
    ranks = percentiles("v", [], {"m": "x"}, {f"r_{n}": ("m", q) for n, q in marks})
    middle = ", ".join(f"{rrd(f'any_value(r_{n})', str(100 * unit_of), 2)} AS {n}_{suffix}" for n, _ in marks)
    return select(
        p,
        f"""SELECT count(*) AS total_valid_{kind}_orders, {rrd("min(x)", str(unit_of), 2)} AS min_{suffix}, {middle}, {rrd("max(x)", str(unit_of), 2)} AS max_{suffix},
count(*) FILTER (WHERE x < 0) AS negative_{kind}_orders, count(*) FILTER (WHERE x > {limit}) AS {over} FROM v CROSS JOIN ranks""",
        v=values,
        ranks=ranks,
    )


def outliers(p: Params, values: str, label: str, limit: int) -> str:
    """Per state: outliers, orders, and both shares, in one aggregate."""
    far = f"count(*) FILTER (WHERE x > {limit})"
    return select(
        p,
        f"""SELECT buyer_state, {far} AS {label}, count(*) AS total_state_orders, {pct(far, "count(*)", 4)} AS pct_within_state,
{pct(far, f"nullif(sum({far}) OVER (), 0)")} AS pct_of_total_outliers FROM v GROUP BY buyer_state""",
        v=values,
    )


def logistics(p: Params) -> dict[str, str]:
    freight = "SELECT order_id, buyer_state, all_freight_cents AS x FROM cohort JOIN parcel USING (order_id)"
    stars = case([(f"coalesce(best, 0) = {s}", label) for s, label in REVIEW_LABELS], REVIEW_NONE)
    abroad = "len(list_filter(states, lambda x: x <> buyer_state))"
    home = "len(list_filter(states, lambda x: x = buyer_state))"
    return {
        "L1_shipping_profile": profile(
            p, "SELECT travel AS x FROM cohort", DAY, "shipping", "days", f"over_{p.slow_shipping_days}_days_orders", p.slow_shipping_days * DAY
        ),
        "L2_slow_orders_by_state": outliers(
            p,
            "SELECT buyer_state, epoch_us(received_at) - epoch_us(bought_at) AS x FROM cohort WHERE x IS NOT NULL",
            f"orders_over_{p.slow_delivery_days}_days",
            p.slow_delivery_days * DAY,
        ),
        "L3_orders_without_items": select(
            p,
            """SELECT order_id, person AS customer_unique_id, bought_at AS order_purchase_timestamp, order_status
FROM cohort ANTI JOIN fx_order_items USING (order_id)""",
        ),
        "L4_freight_profile": profile(p, freight, 100, "freight", "freight", f"over_{p.high_freight}_freight_orders", p.high_freight * 100),
        "L5_freight_outliers_by_state": outliers(p, freight, f"orders_over_{p.high_freight}_freight", p.high_freight * 100),
        "R1_multi_review_orders": select(p, "SELECT order_id, n_reviews AS count_num FROM rated WHERE n_reviews > 1"),
        "R2_review_distribution": select(
            p,
            f"SELECT {stars} AS review_score_tier, count(*) AS order_count, {share()} AS pct_of_total_orders "
            "FROM cohort LEFT JOIN rated USING (order_id) GROUP BY ALL",
        ),
        "G1_multi_state_people": select(
            p,
            f"""SELECT count(*) AS total_mature_customers, count(*) FILTER (WHERE low <> high) AS mature_customers_with_multiple_states,
{pct("count(*) FILTER (WHERE low <> high)", "count(*)")} AS multiple_state_customer_percentage
FROM (SELECT min(own_state) AS low, max(own_state) AS high FROM cohort GROUP BY person)""",
        ),
        "G2_cross_state_by_state": select(
            p,
            f"""SELECT buyer_state, count(*) AS total_orders, {pct("count(*) FILTER (WHERE abroad > 0)", "count(*)")} AS any_item_cross_state_order_ratio,
{pct("sum(abroad)", "sum(len(states))")} AS item_level_cross_state_ratio,
{pct("count(*) FILTER (WHERE abroad > 0 AND home > 0)", "count(*)")} AS mixed_order_ratio
FROM (SELECT buyer_state, states, {abroad} AS abroad, {home} AS home FROM cohort JOIN parcel USING (order_id)) GROUP BY buyer_state""",
        ),
    }


# ------------------------------------------------------------------ marts
def _sides(column: str) -> dict[str, str]:
    return {f"all_{column}": column, f"in_{column}": f"CASE is_cross WHEN 0 THEN {column} END", f"out_{column}": f"CASE is_cross WHEN 1 THEN {column} END"}


def state_mart() -> dict[str, str]:
    money, days = "10000", str(100 * DAY)
    middles = {"mid_all_freight_cents": ("all_freight_cents", 50), "q1_all_travel": ("all_travel", 25), "mid_all_travel": ("all_travel", 50), "q3_all_travel": ("all_travel", 75)}
    middles |= {f"mid_{side}_{c}": (f"{side}_{c}", 50) for side in ("in", "out") for c in ("freight_cents", "travel")}
    ratio = "CAST(freight_cents AS DOUBLE) / CAST(nullif(price_cents + freight_cents, 0) AS DOUBLE) * 100.0"
    mean = lambda side: rri(f"sum(travel) FILTER (WHERE is_cross = {side})", f"count(*) FILTER (WHERE is_cross = {side}) * {DAY}", 1)
    return {
        "middles": percentiles("trip", ["buyer_state"], _sides("freight_cents") | _sides("travel"), middles),
        "sums": f"""SELECT buyer_state, count(*) AS total_orders_mature, {rrd("sum(price_cents)", "count(*) * 100", 2)} AS avg_order_price,
            {rrd("sum(freight_cents)", "count(*) * 100", 2)} AS avg_freight_value, {rrd(f"sum(CAST(floor({ratio} * 1e10 + 0.5) AS HUGEINT))", f"count({ratio}) * 10000000000", 2)} AS avg_order_freight_ratio_percentage,
            {pct("count(*) FILTER (WHERE freight_cents > price_cents)", "count(*)")} AS freight_inverse_order_ratio_percentage,
            {pct("sum(is_cross)", "count(*)")} AS cross_state_ratio_percentage, {mean(0)} AS in_mean, {mean(1)} AS out_mean FROM trip GROUP BY buyer_state""",
        "mart": f"""SELECT buyer_state, total_customers_mature, coalesce(total_orders_mature, 0) AS total_orders_mature, avg_order_price, avg_freight_value,
            {rrd("mid_all_freight_cents", money, 2)} AS median_freight_value, avg_order_freight_ratio_percentage, freight_inverse_order_ratio_percentage,
            cross_state_ratio_percentage, {unit("f_in", 2)} AS intra_median_freight, {unit("f_out", 2)} AS cross_median_freight,
            {unit("f_out - f_in", 2)} AS cross_state_freight_diff, {rrd("f_out", "f_in", 2)} AS cross_state_freight_premium_ratio,
            {rrd("q1_all_travel", days, 1)} AS total_q1_days, {rrd("mid_all_travel", days, 1)} AS total_median_days, {rrd("q3_all_travel", days, 1)} AS total_q3_days,
            {unit("in_mean", 1)} AS intra_avg_days, {unit("d_in", 1)} AS intra_median_days, {unit("out_mean", 1)} AS cross_avg_days,
            {unit("d_out", 1)} AS cross_median_days, {unit("d_out - d_in", 1)} AS cross_state_delivery_diff_median,
            {unit("out_mean - in_mean", 1)} AS cross_state_delivery_diff_avg, retention_rate_percentage
            FROM loyalty LEFT JOIN sums USING (buyer_state) LEFT JOIN (SELECT *, {rri("mid_in_freight_cents", money, 2)} AS f_in, {rri("mid_out_freight_cents", money, 2)} AS f_out,
            {rri("mid_in_travel", days, 1)} AS d_in, {rri("mid_out_travel", days, 1)} AS d_out FROM middles) USING (buyer_state)""",
    }


def review_mart(p: Params, fanned: bool) -> dict[str, str]:
    """``fanned``: price and freight count once for each review."""
    money, days = "10000", str(100 * DAY)
    fan = "fan" if fanned else "1"
    middles = {f"mid_{side}_{c}": (f"{side}_{c}", 50) for side in ("in", "out") for c in ("freight_cents", "travel")}
    low = lambda side: rri(f"100 * count(*) FILTER (WHERE best <= {p.low_review_max} AND is_cross = {side})", f"count(best) FILTER (WHERE is_cross = {side})", 2)
    return {
        "seen": f"SELECT order_id, buyer_state, is_cross, travel, best, price_cents * {fan} AS price_cents, freight_cents * {fan} AS freight_cents FROM trip",
        "seen_middles": percentiles("seen", ["buyer_state"], _sides("freight_cents") | _sides("travel"), middles),
        "seen_sums": f"""SELECT buyer_state, count(*) AS total_orders_mature, {pct("sum(is_cross)", "count(*)")} AS cross_state_ratio_percentage,
            {pct("count(*) FILTER (WHERE freight_cents > price_cents)", "count(*)")} AS freight_inverse_order_ratio_percentage,
            {rrd("sum(best)", "count(best)", 2)} AS avg_review_score, {low(0)} AS low_in, {low(1)} AS low_out FROM seen GROUP BY buyer_state""",
        "review_mart": f"""SELECT buyer_state, total_customers_mature, coalesce(total_orders_mature, 0) AS total_orders_mature, cross_state_ratio_percentage,
            freight_inverse_order_ratio_percentage, {rrd("mid_in_freight_cents", money, 2)} AS intra_median_freight, {rrd("mid_out_freight_cents", money, 2)} AS cross_median_freight,
            {rrd("mid_in_travel", days, 1)} AS intra_median_days, {rrd("mid_out_travel", days, 1)} AS cross_median_days, avg_review_score,
            {unit("low_in", 2)} AS intra_low_review_ratio, {unit("low_out", 2)} AS cross_low_review_ratio, {rrd("low_out", "low_in", 2)} AS cross_low_review_ratio_multiplier,
            retention_rate_percentage FROM loyalty LEFT JOIN seen_sums USING (buyer_state) LEFT JOIN seen_middles USING (buyer_state)""",
    }


def marts(p: Params) -> dict[str, str]:
    total = "SELECT {} AS table_name, sum({})::BIGINT AS total_unique_customers, sum({})::BIGINT AS total_orders_contributed FROM {}"
    clean = "carrier_at <= received_at"
    why = case([("travel IS NULL", FILTER_REASONS[0]), ("travel < 0", FILTER_REASONS[1])], FILTER_REASONS[2])
    return {
        "M0_order_base": select(
            p,
            f"""SELECT order_id, person AS customer_unique_id, buyer_state, {unit("price_cents", 2)} AS total_order_price, {unit("freight_cents", 2)} AS total_order_freight,
is_cross AS is_cross_state, travel::DOUBLE / {DAY}::DOUBLE AS shipping_days FROM trip""",
        ),
        "M1_state_mart": select(p, "FROM mart", **state_mart()),
        "M2_state_mart_reviews": select(p, "FROM review_mart", **review_mart(p, True)),
        "M2b_state_mart_reviews_dedup": select(p, "FROM review_mart", **review_mart(p, False)),
        "M3_mart_consistency": select(
            p,
            " UNION ALL ".join(
                (
                    total.format(lit(CONSISTENCY_TABLES[0]), "1", "n_orders", "early"),
                    total.format(lit(CONSISTENCY_TABLES[1]), "total_customers_mature", "total_orders_mature", "mart"),
                    total.format(lit(CONSISTENCY_TABLES[2]), "total_customers_mature", "total_orders_mature", "review_mart"),
                )
            ),
            **state_mart(),
            **review_mart(p, True),
        ),
        "M4_filter_reasons": select(p, f"SELECT {why} AS filter_reason, count(*) AS order_count, {share()} AS pct_of_orders FROM cohort GROUP BY ALL"),
        "M5_customer_order_fact": select(
            p, f"SELECT person AS customer_unique_id, buyer_state, count(DISTINCT order_id) AS total_orders FROM cohort WHERE {clean} GROUP BY ALL"
        ),
        "S2_write_table": select(
            p, "SELECT person AS customer_unique_id, buyer_state, count(*) AS total_orders FROM (SELECT DISTINCT person, buyer_state, order_id FROM cohort WHERE travel >= 0) GROUP BY ALL"
        ),
        "S4_show_fact": select(
            p,
            f"""SELECT person AS customer_unique_id, buyer_state, k AS total_orders
FROM early JOIN (SELECT person, count(DISTINCT order_id) AS k FROM sale WHERE {clean} GROUP BY person) USING (person)""",
        ),
        "M6_top_categories": select(
            p,
            f"""SELECT own_state AS state, product_category_name_english AS product_category, count(*) AS total_purchased
FROM fx_order_items NATURAL JOIN fx_products NATURAL JOIN fx_product_category_name_translation
JOIN (SELECT order_id, own_state FROM fx_orders NATURAL JOIN fx_customers WHERE own_state = {lit(p.focus_state)}) USING (order_id)
GROUP BY ALL ORDER BY total_purchased DESC, product_category LIMIT {p.top_categories}""",
        ),
    }


def oracle_queries(p: Params = FIXTURE) -> dict[str, str]:
    counts = " UNION ALL ".join(f"SELECT {lit(t)} AS table_name, count(*) AS row_count FROM {table_of(t)}" for t, *_ in KEYS)
    loads = {"S1_load_tables": select(p, counts), "S3_backfill_dim": select(p, "FROM fx_filled")}
    return loads | key_checks(p) | explore(p) | cohorts(p) | logistics(p) | marts(p)
