"""How the silver and bronze tables are derived from the generic test tables.

The expressions are portable SQL, so that the independent SQL check can start from the
same input rows. A lookup adds columns from a table by its primary key; it never drops
or multiplies rows, so a lookup no wanted column needs can be left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

AS_OF = "2001-12-31"

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Fixture:
    base: str
    columns: dict[str, str]
    # (table, expression over what is already joined, primary key of the table)
    lookups: tuple[tuple[str, str, str], ...] = ()
    # columns of each looked-up table start with this prefix
    prefix: dict[str, str] = field(
        default_factory=lambda: {
            "customer": "c_", "nation": "n_", "region": "r_", "orders": "o_", "part": "p_"
        }
    )
    # every base row is repeated with slot = 0 … slots - 1
    slots: int = 1


_CUSTOMER_REGION = (
    ("customer", "o_custkey", "c_custkey"),
    ("nation", "c_nationkey", "n_nationkey"),
    ("region", "n_regionkey", "r_regionkey"),
)
_SUPPLIER_REGION = (
    ("nation", "s_nationkey", "n_nationkey"),
    ("region", "n_regionkey", "r_regionkey"),
)
_SIX_CATEGORIES = (
    "case s_suppkey % 6 when 0 then 'STANDARD' when 1 then 'PROMO' when 2 then 'ECONOMY' "
    "when 3 then 'MEDIUM' when 4 then 'SMALL' else 'LARGE' end"
)
_STOCK_REGION = "cast((p_partkey + 2 * slot) % 5 as int)"

SILVER = {
    "financial_transactions": Fixture(
        base="orders",
        lookups=_CUSTOMER_REGION,
        columns={
            "transaction_id": "o_orderkey",
            "transaction_date": "cast(o_orderdate as date)",
            "amount": "cast(o_totalprice as decimal(14,2))",
            "entity": "o_custkey",
            "payment_method": "o_orderpriority",
            "region": "r_name",
        },
    ),
    "customer_demographics": Fixture(
        base="customer",
        lookups=(
            ("nation", "c_nationkey", "n_nationkey"),
            ("region", "n_regionkey", "r_regionkey"),
        ),
        columns={
            "customer_id": "c_custkey",
            "name": "c_name",
            "date_of_birth": "date '1940-01-01' + cast(c_custkey * 37 % 20000 as int)",
            "gender": "case c_custkey % 3 when 0 then 'Female' when 1 then 'Male' else 'Other' end",
            "marital_status": "case c_custkey % 4 when 0 then 'Single' when 1 then 'Married' "
            "when 2 then 'Divorced' else 'Widowed' end",
            "annual_income": "cast(c_acctbal * 10 + 20000 as decimal(14,2))",
            "country": "n_name",
            "region": "r_name",
        },
    ),
    "promotions": Fixture(
        base="part",
        lookups=(("region", "cast(floor(p_partkey / 10) as int) % 5", "r_regionkey"),),
        columns={
            "promotion_id": "p_partkey",
            "product_category": "p_type",
            "promotion_type": "case p_partkey % 3 when 0 then 'BOGO' when 1 then 'Percent' else 'Bundle' end",
            "discount_percentage": "cast((p_size % 12) * 0.05 + case when p_size % 10 = 0 then 0.005 "
            "else 0.000 end as decimal(5,3))",
            "start_date": "date '1995-01-01' + cast(p_partkey * p_size * 13 % 2400 as int)",
            "end_date": "date '1995-01-01' + cast(p_partkey * p_size * 13 % 2400 "
            "+ case when p_size % 5 = 0 then p_size else p_size % 7 end as int)",
            "region": "r_name",
        },
    ),
    "marketing_campaigns": Fixture(
        base="supplier",
        lookups=_SUPPLIER_REGION,
        columns={
            "campaign_id": "s_suppkey",
            "campaign_name": "s_name",
            "campaign_type": "case s_suppkey % 4 when 0 then 'Email' when 1 then 'Social Media' "
            "when 2 then 'Content Marketing' else 'Print' end",
            "target_audience": "case s_suppkey % 3 when 0 then 'Families' when 1 then 'Seniors' "
            "else 'Young Adults' end",
            "product_category": _SIX_CATEGORIES,
            "region": "r_name",
            "budget": "cast(abs(s_acctbal) * 50 as decimal(14,2))",
            "reach": "s_suppkey * 7919 % 1000000",
            "conversion_rate": "cast((s_suppkey % 12) * 0.01 as decimal(6,4))",
            "start_date": "date '1995-01-01' + cast(s_suppkey * 97 % 2300 as int)",
            "end_date": "date '1995-01-01' + cast(s_suppkey * 97 % 2300 + 10 + s_suppkey % 50 as int)",
        },
    ),
    "product_reviews": Fixture(
        base="lineitem",
        lookups=(("part", "l_partkey", "p_partkey"), ("orders", "l_orderkey", "o_orderkey")),
        columns={
            "review_id": "l_orderkey * 10 + l_linenumber",
            "product_id": "l_partkey",
            "rating": "case when l_quantity <= 40 then 1 + l_partkey % 5 "
            "else 1 + cast(l_quantity as int) % 5 end",
            "helpful_votes": "cast(l_quantity as int) % 7",
            "total_votes": "cast(l_quantity as int) % 7 + l_linenumber",
            "review_date": "cast(l_shipdate as date)",
            "product_category": "p_type",
            "reviewer_id": "o_custkey",
        },
    ),
    "inventory": Fixture(
        base="part",
        slots=2,
        lookups=(("region", _STOCK_REGION, "r_regionkey"),),
        columns={
            "product_id": "p_partkey",
            "product_category": "p_type",
            "region": "r_name",
            "country": f"concat('Country ', cast({_STOCK_REGION} as string))",
            "warehouse": f"concat('WH', cast({_STOCK_REGION} as string))",
            "current_stock": f"(p_partkey * 31 + {_STOCK_REGION} * 17) % 400",
            "reorder_point": "p_size * 3",
            "lead_time": "1 + p_partkey % 14",
            "last_restock_date": "date '2001-01-01' + cast(p_partkey % 300 as int)",
        },
    ),
    "logistics_and_shipping": Fixture(
        base="lineitem",
        lookups=(("orders", "l_orderkey", "o_orderkey"), *_CUSTOMER_REGION),
        columns={
            "shipment_id": "l_orderkey * 10 + l_linenumber",
            "ship_date": "cast(l_shipdate as date)",
            "estimated_delivery": "case when l_orderkey % 50 = 0 then null else cast(l_shipdate as date) "
            "+ cast((l_linenumber * 3 + l_partkey) % 15 as int) end",
            "shipping_cost": "cast(cast((l_orderkey * 37 + l_partkey * 11) % 10000 as decimal(14,2)) "
            "* 0.01 as decimal(14,2))",
            "carrier": "case l_suppkey % 4 when 0 then 'DHL' when 1 then 'UPS' when 2 then 'FedEx' else 'Post' end",
            "shipping_method": "case l_linenumber % 3 when 0 then 'Air' when 1 then 'Road' else 'Sea' end",
            "status": "case l_returnflag when 'A' then 'Delivered' when 'N' then 'In Transit' else 'Returned' end",
            "destination_region": "r_name",
            "destination_country": "n_name",
        },
    ),
    "supplier_information": Fixture(
        base="supplier",
        lookups=_SUPPLIER_REGION,
        columns={
            "supplier_id": "s_suppkey",
            "product_category": _SIX_CATEGORIES,
            "region": "r_name",
            "reliability_score": "cast((s_suppkey * 13 % 100) * 0.01 as decimal(4,2))",
            "lead_time": "1 + s_suppkey % 20",
            "quality_rating": "case s_suppkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end",
        },
    ),
    "customer_service_interactions": Fixture(
        base="events",
        columns={
            "interaction_id": "event_id",
            "interaction_date": "cast(ts as date)",
            "interaction_type": "event_type",
            "issue_category": "concat('Issue ', cast(event_id % 6 as string))",
            "duration_minutes": "cast(floor(value) as int)",
            "customer_satisfaction": "1 + (event_id * 7 + cast(floor(value) as int)) % 5",
            "resolution_status": "case event_id % 3 when 0 then 'Pending' else 'Resolved' end",
            "follow_up_required": "case event_id % 4 when 0 then 'Yes' else 'No' end",
        },
    ),
    "employee_records": Fixture(
        base="supplier",
        lookups=_SUPPLIER_REGION,
        columns={
            "employee_id": "s_suppkey",
            "name": "s_name",
            "date_of_birth": "date '1950-01-01' + cast(s_suppkey * 41 % 16000 as int)",
            "hire_date": "date '1985-01-01' + cast(s_suppkey * 53 % 7000 as int)",
            "department": "case s_suppkey % 3 when 0 then 'Sales' when 1 then 'Logistics' else 'Support' end",
            "status": "case s_suppkey % 2 when 0 then 'active' else 'on leave' end",
            "salary": "cast(abs(s_acctbal) * 5 + 20000 as decimal(14,2))",
            "country": "n_name",
            "region": "r_name",
        },
    ),
    "store_locations": Fixture(
        base="supplier",
        lookups=_SUPPLIER_REGION,
        columns={
            "store_id": "s_suppkey",
            "store_name": "concat('Store ', cast(s_suppkey as string))",
            "store_type": "case s_suppkey % 2 when 0 then 'Flagship' else 'Corner' end",
            "square_footage": "cast(s_suppkey * 131 % 5000 as int)",
            "employee_count": "cast(s_suppkey % 40 as int)",
            "country": "n_name",
            "region": "r_name",
        },
    ),
}

# Bronze: every silver row twice, slot 0 the current version and slot 1 an older one,
# with the faults that cleaning has to repair. Columns not named are passed through.
BRONZE = {
    "financial_transactions": {
        "transaction_date": "transaction_date - slot",
        "amount": "cast(case when transaction_id % 7 = 0 then -amount else amount end + slot as decimal(14,2))",
        "region": "concat(' ', region, '  ')",
        "payment_method": "concat(payment_method, ' ')",
    },
    "customer_demographics": {
        "name": "concat('  Éloïse 🛒 ', name, ' ')",
        "email": "concat('  User', cast(customer_id as string), '@Example.COM ')",
        "annual_income": "cast(annual_income + slot as decimal(14,2))",
        "gender": "concat(gender, '  ')",
        "region": "concat(' ', region)",
    },
    "promotions": {
        "discount_percentage": "cast(case when promotion_id % 11 = 0 then -5 when promotion_id % 13 = 0 then 130 "
        "when promotion_id % 17 = 0 then null else discount_percentage end as decimal(8,3))",
        "start_date": "start_date - slot",
        "end_date": "case when promotion_id % 9 = 0 then start_date - 2 when promotion_id % 19 = 0 then null "
        "else end_date end",
        "promotion_type": "concat(' ', promotion_type)",
    },
    "marketing_campaigns": {
        "campaign_name": "concat(campaign_name, '  ')",
        "conversion_rate": "cast(case when campaign_id % 11 = 0 then -1 when campaign_id % 13 = 0 then 101 "
        "else conversion_rate end as decimal(8,4))",
        "start_date": "start_date - slot",
        "end_date": "case when campaign_id % 9 = 0 then start_date - 2 else end_date end",
    },
    "product_reviews": {
        "review_date": "review_date - slot",
        "product_category": "concat(' ', product_category, ' ')",
    },
    "inventory": {
        "last_restock_date": "last_restock_date - slot",
        "current_stock": "case when product_id % 23 = 0 then -current_stock - 1 "
        "when product_id % 29 = 0 then null else current_stock end",
        "warehouse": "case when slot = 0 then concat(' ', warehouse) else warehouse end",
    },
    "logistics_and_shipping": {
        "ship_date": "ship_date - slot",
        "status": "concat(' ', status, ' ')",
        "carrier": "concat(carrier, ' ')",
    },
    "supplier_information": {
        "reliability_score": "cast(reliability_score + slot as decimal(4,2))",
        "quality_rating": "concat(' ', quality_rating)",
    },
    "customer_service_interactions": {
        "interaction_date": "interaction_date - slot",
        "customer_satisfaction": "case when interaction_id % 11 = 0 then -1 when interaction_id % 13 = 0 then 9 "
        "else customer_satisfaction end",
        "resolution_status": "concat(' ', resolution_status)",
    },
    "employee_records": {
        "name": "concat('  ', name)",
        "email": "concat(' Staff', cast(employee_id as string), '@Example.COM')",
        "date_of_birth": "case when employee_id % 9 = 0 then hire_date + 1 when employee_id % 17 = 0 then null "
        "else date_of_birth end",
        "hire_date": "case when employee_id % 13 = 0 then date '2005-01-01' else hire_date - slot end",
        "status": "concat(' ', status)",
    },
    "store_locations": {
        "store_name": "concat(' ', store_name, ' ')",
        "square_footage": "square_footage + slot",
    },
}

# Transactions as raw text, some of it malformed, for typing.
RAW_TEXT_COLUMNS = {
    "transaction_id": "cast(transaction_id as string)",
    "transaction_date": "case when transaction_id % 31 = 0 then 'not a date' "
    "else cast(transaction_date as string) end",
    "amount": "case when transaction_id % 37 = 0 then 'n/a' when transaction_id % 41 = 0 then null "
    "else cast(amount as string) end",
    "online": "case when transaction_id % 43 = 0 then 'maybe' when transaction_id % 2 = 0 then 'true' "
    "else 'false' end",
}
