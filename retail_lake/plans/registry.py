"""Every named query as a function of the lake."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_lake.functions.exprs import dbl
from retail_lake.plans import features, gold, profiling, silver
from retail_lake.plans.reports import (
    customers,
    experience,
    logistics,
    marketing,
    products,
    promotions,
    sales,
)
from retail_lake.session import scratch_dir
from retail_lake.sources import readers, sinks
from retail_lake.sources.fixture_spec import RAW_TABLES, SILVER
from retail_lake.sources.lake import ParquetLake
from retail_lake.sources.schemas import FORMATS, SCHEMAS

Query = Callable[[ParquetLake], DataFrame]

# columns each kind of report reads
DAY_AMOUNT = ("transaction_date", "amount")
REGION_DAY = ("region", "transaction_date", "amount")
SALE = ("transaction_id", "region", "transaction_date", "amount", "entity")
PROMO = ("promotion_id", "product_category", "region", "discount_percentage", "start_date", "end_date")
PERIOD = ("region", "start_date", "end_date")
CAMPAIGN = (
    "campaign_id",
    "campaign_name",
    "campaign_type",
    "target_audience",
    "product_category",
    "region",
    "budget",
    "reach",
    "conversion_rate",
    "start_date",
    "end_date",
)
FILTERS = ("campaign_type", "target_audience", "region")
SHIPMENT = ("ship_date", "estimated_delivery", "shipping_cost", "carrier", "status")
STOCK = ("product_id", "product_category", "region", "current_stock", "reorder_point")

# filter values the filtered variants use
ONE_REGION, ONE_CATEGORY = "ASIA", "PROMO"
ONE_TYPE, ONE_AUDIENCE = "Email", "Seniors"

TEXT_TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("transaction_date", T.DateType()),
        T.StructField("amount", T.DecimalType(14, 2)),
        T.StructField("online", T.BooleanType()),
    ]
)


def _sales() -> dict[str, Query]:
    def tx(*columns: str):
        return lambda lake: lake.transactions(*columns)

    day = tx(*DAY_AMOUNT)
    region_day = tx(*REGION_DAY)
    return {
        "sales_kpis": lambda k: sales.kpis(k.transactions("amount", "entity")),
        "sales_kpis_one_region": lambda k: sales.kpis(
            k.transactions("amount", "entity", "region"), ONE_REGION
        ),
        "sales_by_month": lambda k: sales.by_period(day(k), "month"),
        "sales_by_month_one_region": lambda k: sales.by_period(region_day(k), "month", region=ONE_REGION),
        "sales_by_quarter": lambda k: sales.by_period(day(k), "quarter"),
        "sales_by_year": lambda k: sales.by_period(day(k), "year"),
        "sales_by_quarter_one_region": lambda k: sales.by_period(region_day(k), "quarter", region=ONE_REGION),
        "sales_by_year_one_region": lambda k: sales.by_period(region_day(k), "year", region=ONE_REGION),
        "sales_by_month_name_one_region": lambda k: sales.by_month_name(region_day(k), ONE_REGION),
        "sales_month_customers": lambda k: sales.by_period(
            k.transactions(*DAY_AMOUNT, "entity"), "month", "month", average="avg_basket", customers=True
        ),
        "sales_quarter_basic": lambda k: sales.by_period(day(k), "quarter", "quarter", average=None),
        "sales_year_basic": lambda k: sales.by_period(day(k), "year", "year", average=None),
        "sales_mom_growth": lambda k: sales.growth(day(k), "month"),
        "sales_mom_growth_one_region": lambda k: sales.growth(region_day(k), "month", ONE_REGION),
        "sales_mom_change": lambda k: sales.growth(day(k), "month", change=True),
        "sales_qoq_growth": lambda k: sales.growth(day(k), "quarter"),
        "sales_yoy_growth": lambda k: sales.growth(day(k), "year"),
        "sales_month_yoy_growth": lambda k: sales.growth(
            day(k), "month", lag=12, previous="same_month_last_year"
        ),
        "sales_next_month": lambda k: sales.next_month(day(k)),
        "sales_by_weekday": lambda k: sales.by_weekday(day(k)),
        "sales_by_weekday_one_region": lambda k: sales.by_weekday(region_day(k), ONE_REGION),
        "sales_weekday_avg": lambda k: sales.by_weekday(day(k), average=True),
        "sales_by_month_name": lambda k: sales.by_month_name(day(k)),
        "sales_month_name_avg": lambda k: sales.month_name_average(day(k)),
        "sales_moving_avg_3m": lambda k: sales.moving_average(day(k), 3),
        "sales_moving_avg_6m": lambda k: sales.moving_average(day(k), 6),
        "sales_moving_avg_12m": lambda k: sales.moving_average(day(k), 12),
        "sales_peak_days": lambda k: sales.peak_days(day(k)),
        "sales_by_region": lambda k: sales.by_region(k.transactions("region", "amount")),
        "sales_region_customers": lambda k: sales.region_customers(
            k.transactions("region", "amount", "entity")
        ),
        "sales_region_marketing": lambda k: sales.region_marketing(
            k.transactions("region", "amount"), k.campaigns("campaign_id", "region", "budget")
        ),
        "sales_region_marketing_once": lambda k: sales.region_marketing(
            k.transactions("region", "amount"), k.campaigns("campaign_id", "region", "budget"), True
        ),
        "sales_cohorts": lambda k: sales.cohorts(k.transactions("entity", "transaction_date")),
        "sales_regions_list": lambda k: sales.distinct_values(k.transactions("region"), "region"),
    }


def _products() -> dict[str, Query]:
    return {
        "prod_top_reviewed": lambda k: products.top_reviewed(
            k.reviews("product_id", "rating", "helpful_votes", "total_votes"), k.inventory("product_id")
        ),
        "prod_top_reviewed_once": lambda k: products.top_reviewed(
            k.reviews("product_id", "rating", "helpful_votes", "total_votes"),
            k.inventory("product_id"),
            fanout_safe=True,
        ),
        "prod_best_rated": lambda k: products.best_rated(k.reviews("product_id", "rating")),
        "prod_category_ratings": lambda k: products.category_ratings(
            k.reviews("product_category", "rating", "product_id"), k.reviews("product_category", "reviewer_id")
        ),
        "prod_category_stock": lambda k: products.category_stock(
            k.inventory("product_category", "product_id", "current_stock", "warehouse")
        ),
        "prod_category_promos": lambda k: products.category_promos(
            k.promotions("product_category", "discount_percentage", "start_date", "end_date")
        ),
        "prod_category_campaigns": lambda k: products.category_campaigns(
            k.campaigns("product_category", "budget", "conversion_rate", "reach")
        ),
        "prod_rank_in_category": lambda k: products.rank_in_category(
            k.reviews("product_category", "product_id")
        ),
        "cx_rating_vs_stock": lambda k: products.rating_vs_stock(
            k.reviews("review_id", "product_id", "product_category", "rating"),
            k.inventory("product_id", "current_stock", "reorder_point"),
        ),
        "cx_popular_vs_stock": lambda k: products.popular_vs_stock(
            k.reviews("product_id", "product_category", "rating"),
            k.inventory("product_id", "current_stock", "reorder_point", "warehouse", "region"),
        ),
        "cx_negative_reviews": lambda k: products.negative_reviews(k.reviews("product_category", "rating")),
    }


def _logistics() -> dict[str, Query]:
    def review_ids(k):
        return k.reviews("product_id", "review_id", "rating")

    def supply(k):
        return k.suppliers(
            "supplier_id", "product_category", "region", "reliability_score", "lead_time", "quality_rating"
        )

    def stock(k):
        return k.inventory(*STOCK)

    return {
        "ops_stockouts": lambda k: logistics.stockouts(stock(k)),
        "ops_critical_products": lambda k: logistics.critical_products(
            k.inventory(*STOCK, "warehouse", "lead_time", "last_restock_date"), review_ids(k), k.as_of
        ),
        "ops_warehouse_perf": lambda k: logistics.warehouse_performance(
            k.inventory(*STOCK, "warehouse", "country", "lead_time", "last_restock_date"), k.as_of
        ),
        "ops_supplier_vs_stockout": lambda k: logistics.supplier_vs_stockout(supply(k), stock(k)),
        "ops_supplier_vs_stockout_once": lambda k: logistics.supplier_vs_stockout(supply(k), stock(k), True),
        "ops_stock_vs_reviews": lambda k: logistics.stock_vs_reviews(stock(k), review_ids(k)),
        "ops_carrier_delays": lambda k: logistics.carrier_delays(k.shipping(*SHIPMENT, "shipping_method")),
        "ops_region_delays": lambda k: logistics.region_delays(
            k.shipping(*SHIPMENT, "destination_region", "destination_country")
        ),
        "ops_speed_vs_cost": lambda k: logistics.speed_vs_cost(k.shipping(*SHIPMENT)),
        "ops_status_share": lambda k: logistics.status_share(k.shipping(*SHIPMENT)),
    }


def _experience() -> dict[str, Query]:
    return {
        "cx_issue_satisfaction": lambda k: experience.issue_satisfaction(k.interactions()),
        "cx_channel_satisfaction": lambda k: experience.channel_satisfaction(k.interactions()),
        "cx_resolution_time": lambda k: experience.resolution_time(k.interactions()),
    }


def _customers() -> dict[str, Query]:
    return {
        "cust_by_gender": lambda k: customers.by_gender(k.customers("gender", "annual_income")),
        "cust_by_age_group": lambda k: customers.by_age_group(
            k.customers("date_of_birth", "age_group", "annual_income")
        ),
        "cust_by_marital": lambda k: customers.by_marital_status(
            k.customers("marital_status", "annual_income")
        ),
        "cust_by_income": lambda k: customers.by_income(k.customers("annual_income")),
        "cust_top_countries": lambda k: customers.top_countries(k.customers("country", "annual_income")),
        "cust_age_income_matrix": lambda k: customers.age_income_matrix(k.customers("age", "annual_income")),
        "cust_region_persona": lambda k: customers.region_persona(
            k.customers("age", "annual_income", "gender", "marital_status", "country", "region")
        ),
    }


def _promotions() -> dict[str, Query]:
    def tx(k):
        return k.transactions(*REGION_DAY)

    def lift(k):
        return promotions.sensitivity(tx(k), k.promotions(*PROMO), k.inventory("product_category"))

    return {
        "promo_kpis": lambda k: promotions.kpis(k.promotions(*PROMO[:4])),
        "promo_kpis_filtered": lambda k: promotions.kpis(k.promotions(*PROMO[:4]), ONE_CATEGORY, ONE_REGION),
        "promo_vs_nopromo": lambda k: promotions.vs_no_promotion(tx(k), k.promotions(*PERIOD)),
        "promo_vs_nopromo_one_category": lambda k: promotions.vs_no_promotion(
            tx(k), k.promotions(*PERIOD, "product_category"), ONE_CATEGORY
        ),
        "promo_by_discount": lambda k: promotions.by_discount(tx(k), k.promotions(*PROMO)),
        "promo_by_discount_one_category": lambda k: promotions.by_discount(
            tx(k), k.promotions(*PROMO), ONE_CATEGORY
        ),
        "promo_sensitivity": lift,
        "promo_top_lift": lambda k: promotions.top_lift(lift(k)),
        "promo_low_lift": lambda k: promotions.low_lift(lift(k)),
        "promo_roi_category": lambda k: promotions.roi_by_category(tx(k), k.promotions(*PROMO)),
        "promo_roi_category_one_region": lambda k: promotions.roi_by_category(
            tx(k), k.promotions(*PROMO), ONE_REGION
        ),
        "promo_duration": lambda k: promotions.durations(
            k.promotions("product_category", "discount_percentage", "start_date", "end_date")
        ),
        "promo_best_discount": lambda k: promotions.best_discount(tx(k), k.promotions(*PROMO)),
        "promo_categories": lambda k: sales.distinct_values(
            k.promotions("product_category"), "product_category"
        ),
        "promo_regions": lambda k: sales.distinct_values(k.promotions("region"), "region"),
    }


def _marketing() -> dict[str, Query]:
    chosen = {"campaign_type": ONE_TYPE, "target_audience": ONE_AUDIENCE, "region": ONE_REGION}

    def tx(k):
        return k.transactions(*REGION_DAY)

    def ads(k):
        return k.campaigns(*CAMPAIGN)

    def roi(k, **filters):
        return marketing.campaign_roi(tx(k), ads(k), **filters)

    def by_type(k):
        return marketing.by_type(k.campaigns(*FILTERS, "budget", "reach", "conversion_rate"))

    def by_audience(k):
        return marketing.by_audience(k.campaigns(*FILTERS, "budget", "reach", "conversion_rate"))

    def exported(k):
        path = f"{scratch_dir(k.spark)}/export-{uuid4().hex}"
        report = roi(k)
        sinks.export_csv(report, path)
        return readers.read_csv(k.spark, path, report.schema)

    return {
        "mkt_kpis": lambda k: marketing.kpis(ads(k)),
        "mkt_kpis_filtered": lambda k: marketing.kpis(ads(k), **chosen),
        "mkt_campaign_roi": roi,
        "mkt_campaign_roi_filtered": lambda k: roi(k, campaign_type=ONE_TYPE, region=ONE_REGION),
        "mkt_top15_roi": lambda k: marketing.top_rows(roi(k)),
        "mkt_by_type": by_type,
        "mkt_by_type_one_region": lambda k: marketing.by_type(ads(k), region=ONE_REGION),
        "mkt_reach_conversion_one_region": lambda k: marketing.reach_vs_conversion(ads(k), region=ONE_REGION),
        "mkt_by_audience_one_region": lambda k: marketing.by_audience(ads(k), region=ONE_REGION),
        "mkt_by_region_one_type": lambda k: marketing.by_region(tx(k), ads(k), campaign_type=ONE_TYPE),
        "mkt_top_campaigns_one_region": lambda k: marketing.top_campaigns(tx(k), ads(k), region=ONE_REGION),
        "mkt_by_month_one_region": lambda k: marketing.by_month(ads(k), region=ONE_REGION),
        "mkt_reach_conversion": lambda k: marketing.reach_vs_conversion(ads(k)),
        "mkt_by_audience": by_audience,
        "mkt_by_region": lambda k: marketing.by_region(tx(k), ads(k)),
        "mkt_by_region_once": lambda k: marketing.by_region(tx(k), ads(k), fanout_safe=True),
        "mkt_top_campaigns": lambda k: marketing.top_campaigns(tx(k), ads(k)),
        "mkt_by_month": lambda k: marketing.by_month(k.campaigns(*FILTERS, "budget", "conversion_rate", "start_date")),
        "mkt_best_types": lambda k: marketing.best_conversion(by_type(k), "campaign_type"),
        "mkt_best_audiences": lambda k: marketing.best_conversion(by_audience(k), "target_audience"),
        "mkt_low_roi": lambda k: marketing.low_roi(roi(k)),
        "mkt_types": lambda k: sales.distinct_values(k.campaigns("campaign_type"), "campaign_type"),
        "mkt_audiences": lambda k: sales.distinct_values(k.campaigns("target_audience"), "target_audience"),
        "mkt_regions": lambda k: sales.distinct_values(k.campaigns("region"), "region"),
        "mkt_export": exported,
        "mkt_acquisition_cost": lambda k: marketing.acquisition_cost(
            k.transactions("region", "transaction_date", "entity"), ads(k)
        ),
        "mkt_budget_revenue_corr": lambda k: marketing.budget_revenue_correlation(tx(k), ads(k)),
    }


def _gold() -> dict[str, Query]:
    def sale(k):
        return k.transactions(*SALE)

    def rfm(k):
        return gold.rfm(sale(k), k.promotions(*PERIOD), k.campaigns(*PERIOD), k.as_of)

    return {
        "gold_sales_enriched": lambda k: gold.sales_enriched(
            k.transactions(*SALE, "payment_method"), k.customers(), k.promotions(), k.campaigns()
        ),
        "gold_rfm": rfm,
        "gold_rfm_segments": lambda k: gold.rfm_segment_share(rfm(k)),
        "gold_clv": lambda k: gold.lifetime_value(sale(k), k.promotions(*PERIOD), k.campaigns(*PERIOD)),
        "gold_churn": lambda k: gold.churn(k.transactions("entity", "transaction_date"), k.as_of),
        "gold_client_profile": profile,
        "gold_enriched_rows": lambda k: gold.enriched_rows(
            k.transactions("transaction_id", *REGION_DAY),
            k.promotions(*PROMO),
            k.campaigns("campaign_id", *PERIOD),
        ),
        "gold_daily_sales": lambda k: daily(k).withColumn("ca_jour", dbl(F.col("ca_jour"))),
        "gold_product_performance": product_performance,
        "gold_promotion_analysis": promotion_analysis,
        "gold_campaign_performance": campaign_performance,
        "gold_spend_rank": lambda k: gold.spend_rank_in_region(k.transactions("region", "entity", "amount")),
        "gold_spend_quartiles": lambda k: gold.spend_quartiles(k.transactions("entity", "amount")),
    }


def profile(k: ParquetLake) -> DataFrame:
    return gold.client_profile(k.transactions(*SALE), k.customers(), k.promotions(*PERIOD), k.as_of)


def daily(k: ParquetLake) -> DataFrame:
    return gold.daily_sales(k.transactions(*REGION_DAY), k.promotions(*PROMO), k.campaigns(*PERIOD))


def product_performance(k: ParquetLake) -> DataFrame:
    return gold.product_performance(
        k.reviews("product_id", "rating"),
        k.inventory(*STOCK, "lead_time", "last_restock_date"),
        k.as_of,
    )


def promotion_analysis(k: ParquetLake) -> DataFrame:
    return gold.promotion_analysis(k.transactions(*REGION_DAY), k.promotions())


def campaign_performance(k: ParquetLake) -> DataFrame:
    return gold.campaign_performance(k.transactions(*REGION_DAY, "entity"), k.campaigns(*CAMPAIGN))


def _features() -> dict[str, Query]:
    f = features

    def clients(k):
        return f.clients(profile(k))

    def ventes(k):
        return f.sales(daily(k))

    def produits(k):
        return f.products(product_performance(k))

    def promos(k):
        return f.promotions(promotion_analysis(k))

    def campagnes(k):
        return f.campaigns(campaign_performance(k))

    return {
        "feat_clients": clients,
        "feat_clients_count": lambda k: f.row_count(clients(k), "clients"),
        "feat_clients_rfm_dist": lambda k: f.clients_rfm_dist(clients(k)),
        "feat_clients_rfm_top": lambda k: f.clients_rfm_top(clients(k)),
        "feat_clients_flags": lambda k: f.clients_flags(clients(k)),
        "feat_clients_age": lambda k: f.clients_age(clients(k)),
        "feat_clients_preview": lambda k: f.preview(clients(k), "client"),
        "feat_sales": ventes,
        "feat_sales_count": lambda k: f.row_count(ventes(k), "ventes"),
        "feat_sales_weekday": lambda k: f.sales_weekday(ventes(k)),
        "feat_sales_season": lambda k: f.sales_season(ventes(k)),
        "feat_sales_promo_level": lambda k: f.sales_promo_level(ventes(k)),
        "feat_sales_spikes": lambda k: f.sales_spikes(ventes(k)),
        "feat_sales_preview": lambda k: f.preview(ventes(k), "transaction_date", "region", "categorie_promo"),
        "feat_products": produits,
        "feat_products_count": lambda k: f.row_count(produits(k), "produits"),
        "feat_products_popularity": lambda k: f.products_popularity(produits(k)),
        "feat_products_flags": lambda k: f.products_flags(produits(k)),
        "feat_products_action": lambda k: f.products_action(produits(k)),
        "feat_products_preview": lambda k: f.preview(produits(k), "product_id", "region"),
        "feat_promos": promos,
        "feat_promos_count": lambda k: f.row_count(promos(k), "promotions"),
        "feat_promos_discount": lambda k: f.promos_discount(promos(k)),
        "feat_promos_duration": lambda k: f.promos_duration(promos(k)),
        "feat_promos_season": lambda k: f.promos_season(promos(k)),
        "feat_promos_flags": lambda k: f.promos_flags(promos(k)),
        "feat_promos_combos": lambda k: f.promos_combos(promos(k)),
        "feat_promos_preview": lambda k: f.preview(promos(k), "promotion_id"),
        "feat_campaigns": campagnes,
        "feat_campaigns_count": lambda k: f.row_count(campagnes(k), "campagnes"),
        "feat_campaigns_type": lambda k: f.campaigns_type(campagnes(k)),
        "feat_campaigns_audience": lambda k: f.campaigns_audience(campagnes(k)),
        "feat_campaigns_budget": lambda k: f.campaigns_budget(campagnes(k)),
        "feat_campaigns_season": lambda k: f.campaigns_season(campagnes(k)),
        "feat_campaigns_flags": lambda k: f.campaigns_flags(campagnes(k)),
        "feat_campaigns_combos": lambda k: f.campaigns_combos(campagnes(k)),
        "feat_campaigns_preview": lambda k: f.preview(campagnes(k), "campaign_id"),
        "feat_summary": lambda k: f.summary(clients(k), produits(k), promos(k), campagnes(k)),
    }


def _written_csv(k: ParquetLake, df: DataFrame) -> str:
    """The rows as a delimited file with a header and doubled quotes."""
    path = f"{scratch_dir(k.spark)}/raw-{uuid4().hex}"
    writer = df.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _reordered(k: ParquetLake) -> DataFrame:
    names = SCHEMAS["financial_transactions"].names
    path = _written_csv(k, k.bronze("financial_transactions").select(*reversed(names)))
    return readers.read_table_file(k.spark, "financial_transactions", path).withColumn("amount", dbl(F.col("amount")))


def _surplus(k: ParquetLake) -> DataFrame:
    names = SCHEMAS["financial_transactions"].names
    df = k.bronze("financial_transactions").select(names[0], F.lit("EUR").alias("currency"), *names[1:])
    out = readers.read_table_file(k.spark, "financial_transactions", _written_csv(k, df))
    return out.withColumn("amount", dbl(F.col("amount")))


def _quoted(k: ParquetLake) -> DataFrame:
    text = F.concat(F.lit('"'), F.trim("name"), F.lit('", or\n'), F.col("customer_id"))
    df = k.bronze("customer_demographics").select("customer_id", text.alias("name"))
    schema = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("name", T.StringType())])
    return readers.read_csv(k.spark, _written_csv(k, df), schema, multi_line=True)


def _ingest_rejects(k: ParquetLake) -> DataFrame:
    raw = readers.read_delimited(k.spark, _written_csv(k, k.raw_text_transactions()), TEXT_TRANSACTIONS)
    return readers.rejects(raw, TEXT_TRANSACTIONS).drop(readers.BROKEN)


def _table_round_trip(k: ParquetLake, **layout) -> DataFrame:
    name = f"round_trip_{uuid4().hex}"
    sinks.create_or_replace_table(k.transactions("transaction_id", "region", "transaction_date"), name, **layout)
    return readers.scan(k.spark, name)


def _cleaned_by_discount(k: ParquetLake) -> DataFrame:
    cleaned = silver.clean_promotions(k.bronze("promotions", spread=True), k.as_of)
    return promotions.by_discount(k.transactions(*REGION_DAY), cleaned.select(*PROMO))


def _json_array(k: ParquetLake) -> DataFrame:
    path = f"{scratch_dir(k.spark)}/json-{uuid4().hex}"
    schema = T.StructType([f for f in SCHEMAS["store_locations"].fields if f.name in ("store_id", "store_name", "region")])
    rows = k.bronze("store_locations").select(F.to_json(F.struct(*schema.names)).alias("value"))
    rows.withColumn("value", F.concat("value", F.lit(","))).write.text(path)
    return readers.read_json_lines_array(k.spark, path, schema)


def _in_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of a task as the lines of one array, a line per batch."""
    sign = "["
    for batch in batches:
        if batch.num_rows:
            line = sign + ",\n  ".join(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([line])], ["value"])
            sign = ","
    if sign == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def _json_rejects(k: ParquetLake) -> DataFrame:
    """The rejects of one big array a file, whose objects are not on lines of their own."""
    path = f"{scratch_dir(k.spark)}/json-{uuid4().hex}"
    objects = k.raw_text_transactions().select(F.to_json(F.struct("*")).alias("value"))
    objects.mapInArrow(_in_arrays, "value string").write.text(path)
    raw = readers.json_text(k.spark, path, TEXT_TRANSACTIONS)
    return readers.rejects(raw, TEXT_TRANSACTIONS).drop(readers.BROKEN)


def _nested_json(k: ParquetLake) -> DataFrame:
    nested = F.format_string('{"a": {"b": [%s]}}', "props")
    df = k.raw("events").select("event_id", nested.alias("props"))
    return readers.json_fields(df, "props", {"k": ("a.b[0].k", "int")}).select("event_id", "k")


def _raw_file(k: ParquetLake, table: str) -> DataFrame:
    """The bronze rows of a table written as its raw text file and read back."""
    path = f"{scratch_dir(k.spark)}/raw-{uuid4().hex}"
    sep = "\t" if FORMATS.get(table) == "tsv" else ","
    writer = k.bronze(table).select(*SCHEMAS[table].names).write.option("header", True).option("sep", sep).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_table_file(k.spark, table, path)


def _cleaning() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for table, cleaner in silver.CLEANERS.items():
        out[f"clean_{table}"] = lambda k, t=table, c=cleaner: c(k.bronze(t, spread=True), k.as_of)
    for table in SILVER:
        out[f"profile_{table}"] = lambda k, t=table: profiling.profile(k.bronze(t))
    for table in ("financial_transactions", "product_reviews", "inventory"):
        out[f"quartiles_{table}"] = lambda k, t=table: profiling.quartiles(profiling.sketches(k.bronze(t)))
    out["quartiles_merged"] = lambda k: profiling.quartiles(
        profiling.merged(profiling.sketches(k.bronze("financial_transactions"), "transaction_date"))
    )
    for table in silver.RULES:
        out[f"quarantine_{table}"] = lambda k, t=table: silver.refused(t, k.bronze(t, spread=True), k.as_of)
    for table, rules in profiling.FAULTS.items():
        out[f"faults_{table}"] = lambda k, t=table, r=rules: profiling.violations(k.bronze(t), r())
    out |= {
        "csv_transactions": lambda k: _raw_file(k, "financial_transactions").withColumn(
            "amount", dbl(F.col("amount"))
        ),
        "csv_customers": lambda k: _raw_file(k, "customer_demographics").withColumn(
            "annual_income", dbl(F.col("annual_income"))
        ),
        "csv_reordered": _reordered,
        "csv_surplus_columns": _surplus,
        "csv_quoted": _quoted,
        "ingest_rejects": _ingest_rejects,
        "table_round_trip": lambda k: _table_round_trip(k, bucket_by=(8, ["transaction_id"])),
        "table_partitioned": lambda k: _table_round_trip(k, partition_by=["region"]),
        "cleaned_promo_by_discount": _cleaned_by_discount,
        "json_array_stores": _json_array,
        "json_nested": _nested_json,
        "json_rejects": _json_rejects,
        "tsv_reviews": lambda k: _raw_file(k, "product_reviews"),
        "distribution_status": lambda k: profiling.distribution(k.shipping("status"), "status"),
        "duplicates_transactions": lambda k: profiling.duplicates(
            k.bronze("financial_transactions"), ["transaction_id"]
        ),
        "load_counts": lambda k: sinks.load_counts({t: k.raw(t) for t in RAW_TABLES}),
        "json_fields": lambda k: readers.json_fields(
            k.raw("events"), "props", {"k": ("k", "int"), "missing": ("a.b[0]", "string")}
        ).select("event_id", "k", "missing"),
        "typed_transactions": lambda k: readers.typed(k.raw_text_transactions(), TEXT_TRANSACTIONS).selectExpr(
            "transaction_id", "transaction_date", "cast(amount as double) as amount", "online"
        ),
        "rejected_transactions": lambda k: readers.rejects(k.raw_text_transactions(), TEXT_TRANSACTIONS),
    }
    return out


def all_queries() -> dict[str, Query]:
    parts = (
        _sales, _products, _logistics, _experience, _customers,
        _promotions, _marketing, _gold, _features, _cleaning,
    )
    out: dict[str, Query] = {}
    for part in parts:
        out |= part()
    return out
