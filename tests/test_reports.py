"""Traps and corner cases on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from retail_lake.plans import features, gold
from retail_lake.plans.reports import logistics, marketing, products, promotions, sales
from tests.helpers import bag, day, dec, rows

TX = "transaction_id long, transaction_date date, amount decimal(14,2), entity long, region string"
PROMO = (
    "promotion_id long, product_category string, promotion_type string, discount_percentage decimal(5,3), "
    "start_date date, end_date date, region string"
)
CAMP = (
    "campaign_id long, campaign_name string, campaign_type string, target_audience string, "
    "product_category string, region string, budget decimal(14,2), reach long, conversion_rate decimal(6,4), "
    "start_date date, end_date date"
)


@pytest.fixture(scope="module")
def tx(spark):
    data = [
        (1, "2000-01-01", "10.00", 1, "n"),
        (2, "2000-01-02", "20.00", 1, "n"),
        (3, "2000-01-02", None, 2, "n"),
        (4, "2000-02-01", "0.00", 2, "n"),
        (5, "2000-03-01", "40.00", 3, "s"),
        (6, "2000-01-02", "50.00", 4, None),
    ]
    return spark.createDataFrame([(i, day(d), dec(a), e, r) for i, d, a, e, r in data], TX)


@pytest.fixture(scope="module")
def promos(spark):
    data = [
        (1, "A", "0.100", "2000-01-02", "2000-01-02", "n"),
        (2, "A", "0.300", "2000-01-01", "2000-01-02", "n"),
        (3, "B", "0.205", "2000-01-02", "2000-01-03", "n"),
        (4, None, None, "2000-02-01", "2000-02-01", "n"),
        (5, "C", "0.500", "2001-01-01", "2001-01-31", "s"),
    ]
    return spark.createDataFrame([(i, c, "t", dec(d), day(s), day(e), r) for i, c, d, s, e, r in data], PROMO)


@pytest.fixture(scope="module")
def camps(spark):
    data = [
        (1, "Email", "X", "n", "100.00", 10, "0.1000", "2000-01-01", "2000-01-31"),
        (2, "Print", "Y", "n", "0.00", 0, None, "2000-01-02", "2000-01-02"),
        (3, "Email", "Y", "s", "80.00", 40, "0.2000", "2005-01-01", "2005-01-31"),
    ]
    return spark.createDataFrame(
        [(i, f"c{i}", t, a, "A", r, dec(b), h, dec(c), day(s), day(e)) for i, t, a, r, b, h, c, s, e in data], CAMP
    )


def test_filters_of_none_do_nothing(tx):
    assert sales.kpis(tx).first()["total_transactions"] == 6
    assert sales.kpis(tx, "s").first()["total_revenue"] == 40.0
    assert sales.kpis(tx, "nowhere").first()["avg_transaction_value"] is None


def test_growth_after_a_month_without_revenue(tx):
    got = rows(sales.growth(tx, "month", change=True))
    assert [(r["revenue"], r["revenue_change"], r["growth_percentage"]) for r in got] == [
        (80.0, None, None), (0.0, -80.0, -100.0), (40.0, 40.0, None)
    ]


def test_moving_average_counts_rows(tx):
    assert [r["moving_avg_3months"] for r in rows(sales.moving_average(tx))] == [80.0, 40.0, 40.0]


def test_weekdays_sort_from_monday(tx):
    assert [r["day_of_week"] for r in rows(sales.by_weekday(tx))] == [
        "Tuesday", "Wednesday", "Saturday", "Sunday"
    ]


def test_promotion_comparison(tx, promos):
    got = {r["promo_status"]: r for r in rows(promotions.vs_no_promotion(tx, promos))}
    # day 1: promo 2; day 2: promos 1, 2, 3 for two sales; February: promo 4
    assert got["Avec promotion"]["nb_transactions"] == 1 + 3 * 2 + 1
    assert got["Avec promotion"]["total_revenue"] == 10.0 + 60.0 + 0.0
    assert got["Sans promotion"]["nb_transactions"] == 2
    assert sum(r["percentage_of_transactions"] for r in got.values()) == 100.0


def test_category_filter_loses_sales_covered_by_others_only(tx, promos):
    got = {r["promo_status"]: r["nb_transactions"] for r in rows(promotions.vs_no_promotion(tx, promos, "B"))}
    # day 2: promo 3 twice; February: the promotion without a category; day 1 is in neither group
    assert got == {"Avec promotion": 3, "Sans promotion": 2}


def test_discount_gap(tx, promos):
    got = {r["discount_range"]: r["nb_transactions"] for r in rows(promotions.by_discount(tx, promos))}
    assert got == {"10-20%": 2, "21-30%": 3, "> 50%": 3}


def test_sensitivity(spark, tx, promos):
    stock = spark.createDataFrame([("A",), ("A",), ("Z",), (None,)], "product_category string")
    got = {r["category"]: r for r in rows(promotions.sensitivity(tx, promos, stock))}
    assert set(got) == {"A", "B", "Z"}
    a = got["A"]
    assert (a["transactions_no_promo"], a["transactions_with_promo"]) == (3, 3)
    assert a["avg_value_no_promo"] == 30.0 and a["avg_value_with_promo"] == rounded(50 / 3)
    # in no stock list: no base, so no lift
    assert (got["B"]["transactions_no_promo"], got["B"]["lift_percentage"]) == (0, None)
    assert got["B"]["sensitivity_level"] == "Peu sensible"
    # never promoted: a lift of -100
    assert (got["Z"]["transactions_with_promo"], got["Z"]["lift_percentage"]) == (0, -100.0)


def rounded(x, digits=2):
    return round(x + 1e-9, digits)


def test_promotion_roi_counts_idle_promotions(tx, promos):
    got = {r["product_category"]: r for r in rows(promotions.roi_by_category(tx, promos))}
    assert got["C"]["avg_discount"] == 50.0 and got["C"]["revenue_during_promo"] is None
    # pairs: promo 1 two sales, promo 2 three sales
    assert got["A"]["avg_discount"] == rounded(100 * (2 * 0.1 + 3 * 0.3) / 5)
    assert got["A"]["transactions_during_promo"] == 3
    assert got["A"]["revenue_during_promo"] == 20.0 + 30.0


def test_campaign_roi_guards(tx, camps):
    got = {r["campaign_id"]: r for r in rows(marketing.campaign_roi(tx, camps))}
    assert got[1]["roi"] == 0.3 and got[1]["transactions_during_campaign"] == 3
    assert got[2]["roi"] is None and got[2]["revenue_per_reach"] is None and got[2]["revenue_during_campaign"] == 20.0
    assert got[3]["roi"] is None and got[3]["transactions_during_campaign"] == 0
    assert rows(marketing.campaign_roi(tx, camps))[0]["campaign_id"] == 1
    assert [r["campaign_id"] for r in rows(marketing.campaign_roi(tx, camps, target_audience="Y"))] == [2, 3]


def test_region_report_multiplies_budgets(tx, camps):
    wide = {r["region"]: r for r in rows(marketing.by_region(tx, camps))}
    once = {r["region"]: r for r in rows(marketing.by_region(tx, camps, fanout_safe=True))}
    assert wide["n"]["total_budget"] == 300.0 and once["n"]["total_budget"] == 100.0
    assert wide["n"]["total_transactions"] == 3 and wide["n"]["total_revenue"] == 50.0
    assert wide["s"]["roi"] is None and wide["s"]["total_transactions"] == 0


def test_region_marketing(tx, camps):
    got = {r["region"]: r for r in rows(sales.region_marketing(tx, camps))}
    assert got["n"]["total_revenue"] == 60.0 and got["n"]["marketing_budget"] == 400.0
    assert got[None]["campaign_count"] == 0 and got[None]["revenue_per_marketing_euro"] is None


def test_acquisition_cost(tx, camps):
    got = {r["campaign_id"]: (r["new_customers"], r["acquisition_cost"]) for r in rows(marketing.acquisition_cost(tx, camps))}
    assert got == {1: (2, 50.0), 2: (1, 0.0), 3: (0, None)}


def test_cohorts(tx):
    got = {(str(r["cohort_month"]), r["months_since"]): r["customers"] for r in rows(sales.cohorts(tx))}
    assert got == {("2000-01-01", 0): 3, ("2000-01-01", 1): 1, ("2000-03-01", 0): 1}


def test_wide_table_and_the_scores_agree(spark, tx, promos, camps):
    people = spark.createDataFrame(
        [(1, "Ann", 30, "26-35", "F", "Single", dec("1000.00"), "k")],
        "customer_id long, name string, age int, age_group string, gender string, marital_status string, "
        "annual_income decimal(14,2), country string",
    )
    sold = tx.withColumn("payment_method", F.lit("card"))
    wide = gold.sales_enriched(sold, people, promos, camps)
    assert wide.count() == 1 + 2 * 6 + 1 + 1 + 1
    per_customer = wide.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    expected = {r["customer_id"]: (r["n"], r["s"]) for r in rows(per_customer)}
    clv = {r["customer_id"]: (r["purchase_count"], r["total_spent"]) for r in rows(gold.lifetime_value(tx, promos, camps))}
    assert clv == expected
    scored = {r["customer_id"]: (r["frequency"], r["monetary"]) for r in rows(gold.rfm(tx, promos, camps, "2000-12-31"))}
    assert scored == expected
    plain = {r["customer_id"]: r["purchase_count"] for r in rows(gold.lifetime_value(tx, promos, camps, True))}
    assert plain == {1: 2, 2: 2, 3: 1, 4: 1}
    assert {r["customer_id"]: r["is_churned"] for r in rows(gold.churn(tx, "2000-05-30"))} == {1: 1, 2: 1, 3: 0, 4: 1}


def test_enriched_rows_match_daily_sales(tx, promos, camps):
    keys = ["transaction_date", "region", "categorie_promo"]
    row_level = gold.enriched_rows(tx, promos, camps).groupBy(*keys).agg(
        F.count("*").alias("nb"),
        F.sum("amount").alias("ca"),
        F.count_if(F.col("avec_promo") == "Oui").alias("p"),
        F.avg("taux_reduction").alias("taux"),
        F.count_if(F.col("avec_campagne") == "Oui").alias("c"),
    )
    daily = gold.daily_sales(tx, promos, camps).select(
        *keys,
        F.col("nb_ventes_jour").alias("nb"),
        F.col("ca_jour").cast("double").alias("ca"),
        F.col("nb_ventes_avec_promo").alias("p"),
        F.col("taux_reduction_moyen").alias("taux"),
        F.col("nb_ventes_avec_campagne").alias("c"),
    )
    assert bag(daily) == bag(row_level)


def test_stock_reports(spark):
    reviews = spark.createDataFrame(
        [(i, 1, "A", r) for i, r in enumerate([5, 5, 1, 4, None, 5])] + [(9, 2, "A", 2), (9, 3, "B", 3)],
        "review_id long, product_id long, product_category string, rating int",
    )
    inventory = spark.createDataFrame(
        [
            (1, "A", "n", "k", "w1", 0, 5, 2, day("2001-12-01")),
            (1, "A", "s", "k", "w2", 9, 5, 2, None),
            (4, "A", "n", "k", "w1", None, 5, 2, day("2001-12-30")),
            (3, "B", "n", "k", "w1", 30, 5, 2, day("2001-12-30")),
        ],
        "product_id long, product_category string, region string, country string, warehouse string, "
        "current_stock long, reorder_point int, lead_time int, last_restock_date date",
    )
    critical = rows(logistics.critical_products(inventory, reviews, "2001-12-31"))
    assert [(r["product_id"], r["review_count"], r["days_since_restock"]) for r in critical] == [(1, 6, 30)]
    mix = {r["product_category"]: r for r in rows(logistics.stock_vs_reviews(inventory, reviews))}
    assert (mix["A"]["total_products"], mix["A"]["products_low_stock"], mix["A"]["negative_reviews"]) == (2, 6, 2)
    assert mix["A"]["total_reviews"] == 6 and mix["B"]["negative_review_rate"] == 0.0
    stars = {r["rating_category"]: r for r in rows(products.rating_vs_stock(reviews, inventory))}
    assert stars["4.0-4.5 (Bon)"]["products_low_stock"] == 1 and stars["< 3.0 (Faible)"]["avg_stock_level"] is None
    popular = rows(products.popular_vs_stock(reviews, inventory, min_reviews=2))
    assert {(r["warehouse"], r["stock_status"]) for r in popular} == {("w1", "⚠️ Risque rupture"), ("w2", "⚡ Stock faible")}
    perf = {(r["product_id"], r["region"]): r for r in rows(gold.product_performance(reviews, inventory, "2001-12-31"))}
    assert perf[1, "n"]["niveau_stock"] == "RUPTURE" and perf[4, "n"]["niveau_stock"] == "Stock élevé"
    assert perf[4, "n"]["note_moyenne"] is None and perf[4, "n"]["qualite"] == "Produit moyen"
    table = {(r["product_id"], r["region"]): r for r in rows(features.products(gold.product_performance(reviews, inventory, "2001-12-31")))}
    assert table[4, "n"]["score_popularite"] == 0.0 and table[4, "n"]["pct_avis_positifs"] is None
    assert table[4, "n"]["couverture_stock_approx"] == 0 and table[1, "n"]["ratio_positif_negatif"] == 4.0


def test_supplier_rate_may_pass_100(spark):
    suppliers = spark.createDataFrame(
        [(i, "A", "n", dec("0.50"), 3, q) for i, q in enumerate("ABC")] + [(9, "Z", "n", None, 3, "A")],
        "supplier_id long, product_category string, region string, reliability_score decimal(4,2), "
        "lead_time int, quality_rating string",
    )
    stock = spark.createDataFrame(
        [(1, "A", "n", 0, 5), (2, "A", "n", 9, 5)],
        "product_id long, product_category string, region string, current_stock int, reorder_point int",
    )
    wide = {r["product_category"]: r for r in rows(logistics.supplier_vs_stockout(suppliers, stock))}
    assert (wide["A"]["products_low_stock"], wide["A"]["stockout_rate"], wide["A"]["high_quality_suppliers"]) == (3, 150.0, 4)
    assert (wide["Z"]["products_in_category"], wide["Z"]["stockout_rate"], wide["Z"]["high_quality_suppliers"]) == (0, None, 1)
    once = {r["product_category"]: r for r in rows(logistics.supplier_vs_stockout(suppliers, stock, True))}
    assert (once["A"]["products_low_stock"], once["A"]["stockout_rate"]) == (1, 50.0)


def test_mode_takes_the_lowest_of_ties(spark):
    shipping = spark.createDataFrame(
        [("n", "k", day("2000-01-01"), day("2000-01-03"), dec("1.00"), "c", s) for s in ["b", "a", "b", "a", None]],
        "destination_region string, destination_country string, ship_date date, estimated_delivery date, "
        "shipping_cost decimal(14,2), carrier string, status string",
    )
    got = rows(logistics.region_delays(shipping, min_shipments=1))
    assert got[0]["most_common_status"] == "a" and got[0]["avg_delivery_days"] == 2.0


def test_feature_invariants(lake):
    from retail_lake.plans import registry

    table = features.clients(registry.profile(lake))
    flags = [c for c in table.columns if c.startswith("flag_")]
    assert {v for r in table.select(*flags).collect() for v in r} <= {0, 1}
    assert len(table.columns) == 33
    sold = features.promotions(registry.promotion_analysis(lake))
    assert sold.filter("nb_ventes <= 0").count() == 0 and len(set(sold.columns)) == len(sold.columns)
    assert features.campaigns(registry.campaign_performance(lake)).filter("performance = 'N/A'").count() == 0


def test_campaign_performance_without_a_known_status_is_dropped(spark, lake):
    from retail_lake.plans import registry

    perf = registry.campaign_performance(lake).withColumn("performance", F.lit(None).cast("string"))
    assert features.campaigns(perf).count() == 0


def test_calendar_frame_counts_days(spark):
    from retail_lake.operators.timeseries import calendar_frame, rolling, rolling_mean

    df = spark.createDataFrame([(day("2000-01-01"), 1), (day("2000-01-20"), 3)], "d date, v int")
    by_rows = [r[0] for r in df.select(rolling_mean("v", rolling("d", 7))).collect()]
    by_days = [r[0] for r in df.select(rolling_mean("v", calendar_frame("d", 7))).collect()]
    assert by_rows == [1.0, 2.0] and by_days == [1.0, 3.0]


def test_category_ratings_copy_no_row_per_count(spark):
    reviews = spark.createDataFrame(
        [("a", 1, 5, 10), ("a", 1, 4, 10), ("a", 2, None, 11), ("a", None, 3, None), (None, 3, 1, 10), (None, 3, 2, 12)],
        "product_category string, product_id long, rating int, reviewer_id long",
    )
    report = products.category_ratings(reviews)
    assert [tuple(r) for r in report.collect()] == [("a", 4, 4.0, 2, 2), (None, 2, 1.5, 1, 2)]
    apart = products.category_ratings(reviews.drop("reviewer_id"), reviews.select("product_category", "reviewer_id"))
    assert bag(apart) == bag(report)
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
