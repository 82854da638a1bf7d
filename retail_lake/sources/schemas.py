"""Schemas of the raw files. Columns are those the reports and the cleaning use."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(14, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_TEXT, _DAY, _LONG, _INT = T.StringType(), T.DateType(), T.LongType(), T.IntegerType()

SCHEMAS = {
    "financial_transactions": _schema(
        transaction_id=_LONG,
        transaction_date=_DAY,
        amount=_MONEY,
        entity=_LONG,
        payment_method=_TEXT,
        region=_TEXT,
    ),
    "customer_demographics": _schema(
        customer_id=_LONG,
        name=_TEXT,
        email=_TEXT,
        date_of_birth=_DAY,
        gender=_TEXT,
        marital_status=_TEXT,
        annual_income=_MONEY,
        country=_TEXT,
        region=_TEXT,
    ),
    "promotions": _schema(
        promotion_id=_LONG,
        product_category=_TEXT,
        promotion_type=_TEXT,
        discount_percentage=T.DecimalType(8, 3),
        start_date=_DAY,
        end_date=_DAY,
        region=_TEXT,
    ),
    "marketing_campaigns": _schema(
        campaign_id=_LONG,
        campaign_name=_TEXT,
        campaign_type=_TEXT,
        target_audience=_TEXT,
        product_category=_TEXT,
        region=_TEXT,
        budget=_MONEY,
        reach=_LONG,
        conversion_rate=T.DecimalType(8, 4),
        start_date=_DAY,
        end_date=_DAY,
    ),
    "product_reviews": _schema(
        review_id=_LONG,
        product_id=_LONG,
        reviewer_id=_LONG,
        product_category=_TEXT,
        rating=_LONG,
        helpful_votes=_INT,
        total_votes=_INT,
        review_date=_DAY,
    ),
    "inventory": _schema(
        product_id=_LONG,
        product_category=_TEXT,
        region=_TEXT,
        country=_TEXT,
        warehouse=_TEXT,
        current_stock=_LONG,
        reorder_point=_INT,
        lead_time=_LONG,
        last_restock_date=_DAY,
    ),
    "logistics_and_shipping": _schema(
        shipment_id=_LONG,
        ship_date=_DAY,
        estimated_delivery=_DAY,
        shipping_cost=_MONEY,
        carrier=_TEXT,
        shipping_method=_TEXT,
        status=_TEXT,
        destination_region=_TEXT,
        destination_country=_TEXT,
    ),
    "supplier_information": _schema(
        supplier_id=_LONG,
        product_category=_TEXT,
        region=_TEXT,
        reliability_score=T.DecimalType(4, 2),
        lead_time=_LONG,
        quality_rating=_TEXT,
    ),
    "customer_service_interactions": _schema(
        interaction_id=_LONG,
        interaction_date=_DAY,
        interaction_type=_TEXT,
        issue_category=_TEXT,
        duration_minutes=_INT,
        customer_satisfaction=_LONG,
        resolution_status=_TEXT,
        follow_up_required=_TEXT,
    ),
    "employee_records": _schema(
        employee_id=_LONG,
        name=_TEXT,
        email=_TEXT,
        date_of_birth=_DAY,
        hire_date=_DAY,
        department=_TEXT,
        status=_TEXT,
        salary=_MONEY,
        country=_TEXT,
        region=_TEXT,
    ),
    "store_locations": _schema(
        store_id=_LONG,
        store_name=_TEXT,
        store_type=_TEXT,
        square_footage=_INT,
        employee_count=_INT,
        country=_TEXT,
        region=_TEXT,
    ),
}

_DOUBLE, _STAMP = T.DoubleType(), T.TimestampNTZType()

# The generic test tables the fixtures start from.
TEST_TABLES = {
    "region": _schema(r_regionkey=_INT, r_name=_TEXT),
    "nation": _schema(n_nationkey=_INT, n_name=_TEXT, n_regionkey=_INT),
    "customer": _schema(
        c_custkey=_LONG, c_name=_TEXT, c_nationkey=_INT, c_acctbal=_DOUBLE, c_mktsegment=_TEXT
    ),
    "supplier": _schema(s_suppkey=_LONG, s_name=_TEXT, s_nationkey=_INT, s_acctbal=_DOUBLE),
    "part": _schema(
        p_partkey=_LONG, p_name=_TEXT, p_brand=_TEXT, p_type=_TEXT, p_size=_INT, p_retailprice=_DOUBLE
    ),
    "orders": _schema(
        o_orderkey=_LONG,
        o_custkey=_LONG,
        o_orderstatus=_TEXT,
        o_totalprice=_DOUBLE,
        o_orderdate=_STAMP,
        o_orderpriority=_TEXT,
    ),
    "lineitem": _schema(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_DOUBLE,
        l_extendedprice=_DOUBLE,
        l_discount=_DOUBLE,
        l_tax=_DOUBLE,
        l_returnflag=_TEXT,
        l_linestatus=_TEXT,
        l_shipdate=_STAMP,
    ),
    "events": _schema(
        event_id=_LONG, ts=_STAMP, user_id=_LONG, event_type=_TEXT, value=_DOUBLE, props=_TEXT
    ),
}

# How each raw file is laid out; the rest is comma-separated.
FORMATS = {"product_reviews": "tsv", "inventory": "json", "store_locations": "json"}
