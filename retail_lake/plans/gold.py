"""Gold tables: the wide sales table, customer scores and the inputs of the features.

Where no formula is given for a column, the one used here is named in the docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import avg, days_between, dbl, mean, pct, ratio, rnd, rows
from retail_lake.operators.baseline import promoted_days
from retail_lake.operators.intervals import (
    active_days,
    daily_totals,
    distinct_in_intervals,
    interval_join,
    interval_joins,
    interval_sums,
)
from retail_lake.operators.ranking import exact_ntiles, ranks
from retail_lake.plans.silver import Day, day
from retail_lake.session import freeze


def sales_enriched(
    tx: DataFrame,
    customers: DataFrame,
    promotions: DataFrame,
    campaigns: DataFrame,
    strategy: str = "days",
    salts: int = 1,
) -> DataFrame:
    """Transactions with their customer, the promotions and the campaigns of region and day.

    One row per open promotion and open campaign; a transaction without either keeps one row.
    A row of the result takes over what is worked out once per sale, promotion and campaign.
    """
    people = customers.select(
        F.col("customer_id").alias("_customer"),
        F.col("name").alias("customer_name"),
        "age",
        "age_group",
        "gender",
        "marital_status",
        dbl(F.col("annual_income")).alias("annual_income"),
        F.col("annual_income").alias("_income"),
        "country",
    )
    promos = promotions.select(
        "promotion_id",
        "promotion_type",
        F.col("product_category").alias("promo_category"),
        dbl(F.col("discount_percentage")).alias("discount_percentage"),
        F.col("start_date").alias("promo_start_date"),
        F.col("end_date").alias("promo_end_date"),
        "region",
    )
    ads = campaigns.select(
        "campaign_id",
        "campaign_name",
        "campaign_type",
        "target_audience",
        dbl(F.col("budget")).alias("budget"),
        "reach",
        dbl(F.col("conversion_rate")).alias("conversion_rate"),
        F.col("start_date").alias("campaign_start_date"),
        F.col("end_date").alias("campaign_end_date"),
        rnd(ratio(F.col("budget"), F.col("reach")), 4).alias("cost_per_reach"),
        "region",
    )
    sales = tx.join(people, F.col("entity") == F.col("_customer"), "left").select(
        "transaction_id",
        F.col("entity").alias("customer_id"),
        "transaction_date",
        F.trunc("transaction_date", "month").alias("month"),
        F.trunc("transaction_date", "quarter").alias("quarter"),
        F.year("transaction_date").alias("year"),
        "region",
        "payment_method",
        dbl(F.col("amount")).alias("amount"),
        "customer_name",
        "age",
        "age_group",
        "gender",
        "marital_status",
        "annual_income",
        "country",
        rnd(ratio(F.col("amount"), F.col("_income")) * 100.0, 4).alias("pct_of_annual_income"),
    )
    campaign = (ads, "campaign_start_date", "campaign_end_date")
    promotion = (promos, "promo_start_date", "promo_end_date")
    return _widened(sales, [campaign, promotion], strategy=strategy, salts=salts).select(
        "transaction_id",
        "customer_id",
        "promotion_id",
        "campaign_id",
        "transaction_date",
        "month",
        "quarter",
        "year",
        "region",
        "payment_method",
        "amount",
        "customer_name",
        "age",
        "age_group",
        "gender",
        "marital_status",
        "annual_income",
        "country",
        "promotion_type",
        "promo_category",
        "discount_percentage",
        "promo_start_date",
        "promo_end_date",
        "campaign_name",
        "campaign_type",
        "target_audience",
        "budget",
        "reach",
        "conversion_rate",
        "campaign_start_date",
        "campaign_end_date",
        F.col("promotion_id").isNotNull().alias("has_promotion"),
        F.col("campaign_id").isNotNull().alias("has_campaign"),
        "pct_of_annual_income",
        "cost_per_reach",
    )


def _widened(sales: DataFrame, dims: list[tuple[DataFrame, str, str]], **options) -> DataFrame:
    """Sales with the intervals of their region and day, those of fewest open intervals first.

    What has been joined is written anew for each row of the next join.
    """
    options = {"strategy": "days", "salts": 1, "salt_on": "transaction_id", **options}
    if options["strategy"] == "days" and options["salts"] == 1:
        return interval_joins(sales, dims, ["region"], "transaction_date", options["salt_on"])
    for dim, start, end in dims:
        sales = interval_join(sales, dim, ["region"], "transaction_date", start, end, **options)
    return sales


def _fanout(promotions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """How many rows of the wide table a transaction of a region and day has, where not one."""
    promos = active_days(promotions).select("region", "day", F.col("active").alias("p"))
    ads = active_days(campaigns).select(
        F.col("region").alias("_r"), F.col("day").alias("_d"), F.col("active").alias("c")
    )
    both = promos.join(ads, (F.col("region") == F.col("_r")) & (F.col("day") == F.col("_d")), "full")
    copies = F.coalesce("p", F.lit(1)) * F.coalesce("c", F.lit(1))
    return both.select(
        F.coalesce("region", "_r").alias("_r"),
        F.coalesce("day", "_d").alias("_d"),
        copies.alias("copies"),
    ).filter(F.col("copies") > 1)


def _on_day(tx: DataFrame, days: DataFrame) -> DataFrame:
    """Left join to a frame with at most one row per region (_r) and day (_d).

    It is written first: by its true size Spark can broadcast it and leave the sales unshuffled.
    """
    same = (F.col("region") == F.col("_r")) & (F.col("transaction_date") == F.col("_d"))
    return tx.join(freeze(days), same, "left")


def _purchases(tx: DataFrame, promotions: DataFrame, campaigns: DataFrame, fanout_safe: bool) -> DataFrame:
    """Per customer: count and spend over the wide table's rows, first and last day.

    Each transaction is weighted by its number of rows there; the rows are not built.
    """
    if fanout_safe:
        weighted = tx.withColumn("w", F.lit(1).cast("long"))
    else:
        weighted = _on_day(tx, _fanout(promotions, campaigns)).withColumn("w", F.coalesce("copies", F.lit(1)))
    return weighted.groupBy(F.col("entity").alias("customer_id")).agg(
        F.sum("w").alias("frequency"),
        F.sum(F.when(F.col("amount").isNotNull(), F.col("w"))).alias("valued"),
        F.sum(F.col("amount") * F.col("w")).alias("spend"),
        F.min("transaction_date").alias("first_day"),
        F.max("transaction_date").alias("last_day"),
    )


def rfm(
    tx: DataFrame, promotions: DataFrame, campaigns: DataFrame, as_of: Day, fanout_safe: bool = False
) -> DataFrame:
    """Recency, frequency, monetary value, their quintiles and the segment."""
    base = _purchases(tx, promotions, campaigns, fanout_safe).select(
        "customer_id",
        days_between("last_day", day(as_of)).alias("recency"),
        "frequency",
        F.col("spend").alias("monetary"),
    )
    scored = exact_ntiles(
        base,
        5,
        "customer_id",
        {
            "recency_score": ("recency", True),
            "frequency_score": ("frequency", False),
            "monetary_score": ("monetary", False),
        },
    )
    r, f = F.col("recency_score"), F.col("frequency_score")
    champions, loyal, promising, at_risk, attention = labels.RFM_SEGMENTS
    segment = (
        F.when((r >= 4) & (f >= 4), champions)
        .when((r >= 3) & (f >= 3), loyal)
        .when((r >= 4) & (f <= 2), promising)
        .when(r <= 2, at_risk)
        .otherwise(attention)
    )
    return scored.withColumn("rfm_segment", segment).withColumn("monetary", dbl(F.col("monetary")))


def rfm_segment_share(rfm_table: DataFrame) -> DataFrame:
    """Share of customers and of spend per segment."""
    grouped = rfm_table.groupBy("rfm_segment").agg(
        rows().alias("customers"), F.sum(F.col("monetary").cast("decimal(28,2)")).alias("_spend")
    )
    everything = Window.partitionBy()  # five rows
    return grouped.select(
        "rfm_segment",
        "customers",
        pct(F.col("customers"), F.sum("customers").over(everything)).alias("pct_customers"),
        rnd(F.col("_spend")).alias("revenue"),
        pct(F.col("_spend"), F.sum("_spend").over(everything)).alias("pct_revenue"),
    ).orderBy(F.col("customers").desc(), "rfm_segment")


def lifetime_value(
    tx: DataFrame, promotions: DataFrame, campaigns: DataFrame, fanout_safe: bool = False
) -> DataFrame:
    """Spend, purchases, tenure and spend times the retention factor."""
    return _purchases(tx, promotions, campaigns, fanout_safe).select(
        "customer_id",
        dbl(F.col("spend")).alias("total_spent"),
        F.col("frequency").alias("purchase_count"),
        mean(F.col("spend"), F.col("valued")).alias("avg_purchase"),
        days_between("first_day", "last_day").alias("customer_tenure_days"),
        dbl(F.col("spend") * F.lit(labels.CLV_RETENTION).cast("decimal(2,1)")).alias("estimated_clv"),
    )


def churn(tx: DataFrame, as_of: Day) -> DataFrame:
    """Last purchase and whether it is more than 90 days ago."""
    idle = days_between("last_purchase", day(as_of))
    return (
        tx.groupBy(F.col("entity").alias("customer_id"))
        .agg(F.max("transaction_date").alias("last_purchase"))
        .withColumn("days_since_last_purchase", idle)
        .withColumn(
            "is_churned",
            F.when(F.col("days_since_last_purchase") > labels.CHURN_DAYS, 1).otherwise(0),
        )
    )


def client_profile(tx: DataFrame, customers: DataFrame, promotions: DataFrame, as_of: Day) -> DataFrame:
    """One row per buyer: purchases, scores, person and segments.

    Scores are quintiles over buyers; the promotion share is the share of transactions with
    at least one open promotion; segments follow the fixed cuts in ``labels``.
    """
    days = active_days(promotions).select(F.col("region").alias("_r"), F.col("day").alias("_d"))
    bought = (
        _on_day(tx, days)
        .groupBy(F.col("entity").alias("client"))
        .agg(
            rows().alias("nb_achats"),
            F.sum("amount").alias("total_depense"),
            avg("amount").alias("panier_moyen"),
            F.min("transaction_date").alias("premier_achat"),
            F.max("transaction_date").alias("dernier_achat"),
            pct(F.count_if(F.col("_r").isNotNull()), rows()).alias("pct_achats_promo"),
        )
        .withColumn("jours_depuis_dernier_achat", days_between("dernier_achat", day(as_of)))
    )
    plan = {
        "score_recence": ("jours_depuis_dernier_achat", True),
        "score_frequence": ("nb_achats", False),
        "score_monetaire": ("total_depense", False),
    }
    scored = exact_ntiles(bought, 5, "client", plan)
    people = customers.select(
        F.col("customer_id").alias("_customer"),
        "name",
        "age",
        "gender",
        dbl(F.col("annual_income")).alias("annual_income"),
        "marital_status",
        "region",
        "country",
    )
    return scored.join(people, F.col("client") == F.col("_customer"), "left").select(
        "client",
        "name",
        "score_recence",
        "score_frequence",
        "score_monetaire",
        "nb_achats",
        dbl(F.col("total_depense")).alias("total_depense"),
        "panier_moyen",
        "jours_depuis_dernier_achat",
        "pct_achats_promo",
        "premier_achat",
        "dernier_achat",
        "age",
        "gender",
        "annual_income",
        "marital_status",
        "region",
        "country",
        labels.VALUE_SEGMENT.of("total_depense").alias("segment_valeur"),
        labels.ACTIVITY_SEGMENT.of("jours_depuis_dernier_achat").alias("segment_activite"),
    )


def enriched_rows(tx: DataFrame, promotions: DataFrame, campaigns: DataFrame, **options) -> DataFrame:
    """Transactions with promotion category, discount in percent and yes/no marks."""
    promos = promotions.select(
        "promotion_id",
        F.col("product_category").alias("categorie_promo"),
        dbl(F.col("discount_percentage") * 100).alias("taux_reduction"),
        F.col("start_date").alias("_ps"),
        F.col("end_date").alias("_pe"),
        "region",
    )
    ads = campaigns.select(
        "campaign_id", F.col("start_date").alias("_cs"), F.col("end_date").alias("_ce"), "region"
    )
    sold = tx.withColumn("amount", dbl(F.col("amount")))  # once per sale, not per row of the result
    out = _widened(sold, [(ads, "_cs", "_ce"), (promos, "_ps", "_pe")], **options)

    def mark(key: str) -> Column:
        return F.when(F.col(key).isNotNull(), labels.YES).otherwise(labels.NO)

    return out.select(
        "transaction_id",
        "transaction_date",
        "region",
        "amount",
        "promotion_id",
        "categorie_promo",
        mark("promotion_id").alias("avec_promo"),
        "taux_reduction",
        "campaign_id",
        mark("campaign_id").alias("avec_campagne"),
    )


def daily_sales(tx: DataFrame, promotions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """The rows of ``enriched_rows`` counted per day, region and promotion category.

    Computed from daily totals and the numbers of open promotions and campaigns.
    """
    promos = promoted_days(promotions).select(
        F.col("product_category").alias("categorie_promo"),
        F.col("region").alias("_pr"),
        F.col("day").alias("_pd"),
        F.col("active").alias("promos"),
        "discounts",
        "discounted",
    )
    ads = active_days(campaigns).select(
        F.col("region").alias("_cr"), F.col("day").alias("_cd"), F.col("active").alias("ads")
    )
    copies = F.coalesce("promos", F.lit(1)) * F.coalesce("ads", F.lit(1))
    promoted, advertised = F.col("promos").isNotNull(), F.col("ads").isNotNull()
    nb = F.col("n") * F.col("copies")
    return (
        daily_totals(tx)
        .join(promos, (F.col("region") == F.col("_pr")) & (F.col("day") == F.col("_pd")), "left")
        .join(ads, (F.col("region") == F.col("_cr")) & (F.col("day") == F.col("_cd")), "left")
        .withColumn("copies", copies)
        .select(
            F.col("day").alias("transaction_date"),
            "region",
            "categorie_promo",
            nb.alias("nb_ventes_jour"),
            (F.col("total") * F.col("copies")).cast("decimal(38,2)").alias("ca_jour"),
            mean(F.col("total"), F.col("n_value")).alias("panier_moyen_jour"),
            F.when(promoted, nb).otherwise(0).alias("nb_ventes_avec_promo"),
            ratio(F.col("discounts") * 100, F.col("discounted")).alias("taux_reduction_moyen"),
            F.when(advertised, nb).otherwise(0).alias("nb_ventes_avec_campagne"),
        )
    )


def product_performance(reviews: DataFrame, inventory: DataFrame, as_of: Day) -> DataFrame:
    """One row per stock row with the reviews of its product, quality, stock level and alert."""
    stars = F.col("rating")
    per_product = reviews.groupBy(F.col("product_id").alias("_p")).agg(
        rows().alias("nb"),
        avg(stars).alias("note_moyenne"),
        F.count_if(stars >= 4).alias("plus"),
        F.count_if(stars <= 2).alias("minus"),
    )
    note, nb = F.col("note_moyenne"), F.col("nb_avis")
    stock, reorder = F.col("current_stock"), F.col("reorder_point")
    excellent, good, problem, medium = labels.QUALITY_LABELS
    empty, low, fair, high = labels.STOCK_LEVELS
    urgent, quality, surplus, fine = labels.ALERTS
    return (
        inventory.join(per_product, F.col("product_id") == F.col("_p"), "left")
        .withColumn("nb_avis", F.coalesce("nb", F.lit(0)))
        .select(
            "product_id",
            F.col("product_category").alias("categorie"),
            "region",
            "nb_avis",
            "note_moyenne",
            F.coalesce("plus", F.lit(0)).alias("avis_positifs"),
            F.coalesce("minus", F.lit(0)).alias("avis_negatifs"),
            "current_stock",
            "reorder_point",
            "lead_time",
            days_between("last_restock_date", day(as_of)).alias("jours_depuis_restock"),
            F.when(note >= 4.5, excellent)
            .when(note >= 4.0, good)
            .when(note < 3.0, problem)
            .otherwise(medium)
            .alias("qualite"),
            F.when(stock == 0, empty)
            .when(stock < reorder, low)
            .when(stock <= reorder * 3, fair)
            .otherwise(high)
            .alias("niveau_stock"),
            F.when((stock < reorder) & (note >= 4.0) & (nb >= 10), urgent)
            .when((note < 3.0) & (nb >= 10), quality)
            .when(stock > reorder * 5, surplus)
            .otherwise(fine)
            .alias("alerte"),
        )
    )


def _status(roi_pct: Column, sold: Column, names: tuple[str, ...]) -> Column:
    excellent, good, standard, none = names
    return (
        F.when(sold == 0, none).when(roi_pct > 100, excellent).when(roi_pct > 50, good).otherwise(standard)
    )


def promotion_analysis(tx: DataFrame, promotions: DataFrame) -> DataFrame:
    """Every promotion with the sales of its region during it.

    ROI compares the revenue per day of the promotion with the revenue per day of its region
    between the region's first and last sale, in percent above it.
    """
    daily = freeze(daily_totals(tx))
    known = daily.filter(F.col("day").isNotNull())
    usual = known.groupBy(F.col("region").alias("_r")).agg(
        ratio(F.sum("total"), days_between(F.min("day"), F.max("day")) + 1).alias("_usual")
    )
    sold = interval_sums(
        promotions, daily, "region", "start_date", "end_date",
        {"n": "nb_ventes", "n_value": "_valued", "total": "_total"},
    )
    length = days_between("start_date", "end_date")
    revenue = F.when(F.col("_valued") > 0, F.col("_total"))
    roi = rnd((ratio(ratio(F.col("_revenue"), F.col("duree_jours") + 1), F.col("_usual")) - 1.0) * 100.0)
    return (
        sold.join(usual, F.col("region") == F.col("_r"), "left")
        .withColumn("duree_jours", length)
        .withColumn("_revenue", revenue)
        .withColumn("roi_promo_pct", roi)
        .select(
            "promotion_id",
            "product_category",
            "promotion_type",
            "region",
            dbl(F.col("discount_percentage") * 100).alias("discount_percentage"),
            "duree_jours",
            "nb_ventes",
            dbl(F.col("_revenue")).alias("ca_genere"),
            mean(F.col("_revenue"), F.col("_valued")).alias("panier_moyen"),
            "roi_promo_pct",
            "start_date",
            "end_date",
            _status(F.col("roi_promo_pct"), F.col("nb_ventes"), labels.PROMO_STATUS).alias("statut"),
        )
    )


def campaign_performance(tx: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Every campaign with the sales of its region during it.

    ROI is revenue over budget; its percent form is the gain over the budget. The real
    conversion is distinct buyers over reach.
    """
    sold = interval_sums(
        campaigns, freeze(daily_totals(tx)), "region", "start_date", "end_date",
        {"n": "nb_ventes", "n_value": "_valued", "total": "_total"},
    )
    sold = distinct_in_intervals(
        tx, sold, "region", "transaction_date", "entity", "start_date", "end_date", "_clients"
    )
    revenue = F.when(F.col("_valued") > 0, F.col("_total"))
    budget = F.col("budget")
    return (
        sold.withColumn("_revenue", revenue)
        .withColumn("roi_pct", rnd(ratio(dbl(F.col("_revenue")) - dbl(budget), budget) * 100.0))
        .select(
            "campaign_id",
            "campaign_name",
            "campaign_type",
            "product_category",
            "target_audience",
            "region",
            dbl(budget).alias("budget"),
            "reach",
            dbl(F.col("conversion_rate")).alias("taux_conversion_prevu"),
            rnd(ratio(F.col("_clients"), F.col("reach")), 6).alias("taux_conversion_reel"),
            "nb_ventes",
            dbl(F.col("_revenue")).alias("ca_genere"),
            rnd(ratio(F.col("_revenue"), budget)).alias("roi"),
            "roi_pct",
            "start_date",
            "end_date",
            days_between("start_date", "end_date").alias("duree_jours"),
            rnd(ratio(budget, F.col("nb_ventes"))).alias("cout_par_vente"),
            rnd(ratio(budget, F.col("_clients"))).alias("cout_par_client"),
            _status(F.col("roi_pct"), F.col("nb_ventes"), labels.CAMPAIGN_STATUS).alias("performance"),
        )
    )


def spend_rank_in_region(tx: DataFrame) -> DataFrame:
    """Customers of a region by spend: percent rank from the lowest."""
    spend = tx.groupBy("region", F.col("entity").alias("customer_id")).agg(F.sum("amount").alias("spend"))
    ranked = ranks(spend, "region", "spend", "customer_id", descending=False, dense=False)
    return ranked.select("region", "customer_id", dbl(F.col("spend")).alias("spend"), "percent_rank")


def spend_quartiles(tx: DataFrame) -> DataFrame:
    """Customers in four groups of equal size by spend."""
    spend = tx.groupBy(F.col("entity").alias("customer_id")).agg(F.sum("amount").alias("spend"))
    out = exact_ntiles(spend, 4, "customer_id", {"quartile": ("spend", False)})
    return out.select("customer_id", dbl(F.col("spend")).alias("spend"), "quartile")
