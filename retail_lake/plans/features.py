"""The five feature tables and the queries that check them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.bands import position
from retail_lake.functions.exprs import (
    avg,
    day_name,
    days_between,
    dbl,
    flag,
    iso_weekday,
    lookup,
    mean,
    pct,
    rnd,
    rows,
    season,
)
from retail_lake.operators.ranking import top_k
from retail_lake.operators.timeseries import calendar_frame, rolling


def _exact_mean(name: str, digits: int = 2):
    """Mean of a column of doubles that hold at most four decimals, summed exactly."""
    return avg(F.col(name).cast("decimal(28,6)"), digits)


def _exact_sum(name: str):
    return rnd(F.sum(F.col(name).cast("decimal(28,6)")))


def _per(value, days, otherwise):
    """Value per day, or as it is where there is no positive number of days."""
    return F.when(days > 0, rnd(dbl(value) / dbl(days))).otherwise(dbl(otherwise))


def clients(profile: DataFrame) -> DataFrame:
    span = days_between("premier_achat", "dernier_achat")
    scores = ("score_recence", "score_frequence", "score_monetaire")
    spend, bought = F.col("total_depense"), F.col("nb_achats")
    idle, income = F.col("jours_depuis_dernier_achat"), F.col("annual_income")
    return profile.select(
        "client",
        "name",
        *scores,
        sum((F.col(s) for s in scores[1:]), F.col(scores[0])).alias("score_rfm_total"),
        F.concat(*[F.col(s).cast("string") for s in scores]).alias("rfm_segment"),
        "nb_achats",
        "total_depense",
        "panier_moyen",
        "jours_depuis_dernier_achat",
        "pct_achats_promo",
        F.when(span > 0, rnd(dbl(bought) * 30.0 / dbl(span))).otherwise(dbl(bought)).alias(
            "frequence_mensuelle"
        ),
        span.alias("duree_vie_client_jours"),
        rnd(dbl(span) / 30.0, 1).alias("duree_vie_client_mois"),
        "age",
        "gender",
        "annual_income",
        "marital_status",
        "region",
        "country",
        labels.AGE_BAND.of("age").alias("tranche_age"),
        labels.INCOME_BAND.of("annual_income").alias("tranche_revenu"),
        F.when(span > 0, rnd(spend / (dbl(span) / 365.0))).otherwise(spend).alias("clv_annuelle_estimee"),
        labels.BUYING_TREND.of("jours_depuis_dernier_achat").alias("tendance_achat"),
        F.when(income > 0, pct(spend, income)).alias("ratio_depense_revenu"),
        flag((spend >= labels.PREMIUM_SPEND) & (bought >= labels.PREMIUM_PURCHASES)).alias(
            "flag_client_premium"
        ),
        flag((idle > labels.CHURN_DAYS) & (bought >= labels.CHURN_PURCHASES)).alias("flag_risque_churn"),
        flag(F.col("pct_achats_promo") >= labels.PROMO_SENSITIVE_PCT).alias("flag_sensible_promo"),
        "segment_valeur",
        "segment_activite",
        lookup(F.col("segment_valeur"), labels.VALUE_SEGMENT_CODE).alias("segment_valeur_num"),
        lookup(F.col("segment_activite"), labels.ACTIVITY_SEGMENT_CODE).alias("segment_activite_num"),
    )


def sales(daily: DataFrame, calendar_days: bool = False) -> DataFrame:
    """Features per day, region and promotion category over ``gold.daily_sales``.

    The rolling mean takes the last seven rows of a region and category, the current one
    included, or with ``calendar_days`` the last seven days; a series is as long as the
    calendar.
    """
    day, n = F.col("transaction_date"), F.col("nb_ventes_jour")
    frame = calendar_frame if calendar_days else rolling
    week = frame("transaction_date", 7, ("region", "categorie_promo"))
    trend = mean(F.sum("ca_jour").over(week), F.count("ca_jour").over(week), None)
    out = daily.withColumn("ca_moyenne_7j", trend).withColumn("ca_jour", dbl(F.col("ca_jour")))

    def share(part: str):
        return F.when(n > 0, pct(F.col(part), n)).otherwise(0.0)

    return out.select(
        "transaction_date",
        "region",
        "categorie_promo",
        "nb_ventes_jour",
        "ca_jour",
        "panier_moyen_jour",
        "nb_ventes_avec_promo",
        "nb_ventes_avec_campagne",
        "taux_reduction_moyen",
        F.year(day).alias("annee"),
        F.month(day).alias("mois"),
        F.dayofmonth(day).alias("jour_du_mois"),
        iso_weekday(day).alias("jour_semaine_num"),
        day_name(day).alias("jour_semaine"),
        flag(iso_weekday(day).isin(6, 7)).alias("is_weekend"),
        labels.MONTH_PART.of(F.dayofmonth(day)).alias("periode_mois"),
        season(day).alias("saison"),
        share("nb_ventes_avec_promo").alias("pct_ventes_avec_promo"),
        share("nb_ventes_avec_campagne").alias("pct_ventes_avec_campagne"),
        "ca_moyenne_7j",
        rnd(F.col("ca_jour") - F.col("ca_moyenne_7j")).alias("ecart_vs_moyenne_7j"),
        flag(F.col("ca_jour") > labels.SPIKE_FACTOR * F.col("ca_moyenne_7j")).alias("flag_jour_exceptionnel"),
    )


def products(performance: DataFrame) -> DataFrame:
    nb, note = F.col("nb_avis"), F.col("note_moyenne")
    good, bad = F.col("avis_positifs"), F.col("avis_negatifs")
    stock, reorder = F.col("current_stock"), F.col("reorder_point")
    return performance.select(
        "product_id",
        "categorie",
        "region",
        "nb_avis",
        "note_moyenne",
        "avis_positifs",
        "avis_negatifs",
        F.when(bad > 0, rnd(dbl(good) / dbl(bad))).alias("ratio_positif_negatif"),
        F.when(nb > 0, pct(good, nb)).alias("pct_avis_positifs"),
        F.when((nb > 0) & note.isNotNull(), rnd(dbl(nb) * note)).otherwise(0.0).alias("score_popularite"),
        "current_stock",
        "reorder_point",
        "lead_time",
        "jours_depuis_restock",
        F.when(reorder > 0, rnd(dbl(stock) / dbl(reorder))).alias("ratio_stock_seuil"),
        F.when(stock > 0, stock * F.col("lead_time")).otherwise(0).alias("couverture_stock_approx"),
        "qualite",
        lookup(F.col("qualite"), labels.QUALITY_CODE, labels.QUALITY_CODE_ELSE).alias("qualite_num"),
        "niveau_stock",
        lookup(F.col("niveau_stock"), labels.STOCK_LEVEL_CODE).alias("niveau_stock_num"),
        flag((nb >= 20) & (note >= 4.0)).alias("flag_populaire"),
        flag((stock < reorder) & (note >= 4.0) & (nb >= 10)).alias("flag_urgent_reappro"),
        flag((note < 3.0) & (nb >= 10)).alias("flag_probleme"),
        flag(stock > reorder * 5).alias("flag_surstock"),
        "alerte",
    )


def promotions(analysis: DataFrame) -> DataFrame:
    """Promotions with sales only."""
    length, sold, revenue = F.col("duree_jours"), F.col("nb_ventes"), F.col("ca_genere")
    discount, roi = F.col("discount_percentage"), F.col("roi_promo_pct")
    return analysis.filter(sold > 0).select(
        "promotion_id",
        "product_category",
        "promotion_type",
        "region",
        "discount_percentage",
        "duree_jours",
        "nb_ventes",
        "ca_genere",
        "panier_moyen",
        "roi_promo_pct",
        "start_date",
        "end_date",
        F.month("start_date").alias("mois_debut"),
        iso_weekday("start_date").alias("jour_semaine_debut"),
        season("start_date").alias("saison_promo"),
        labels.DISCOUNT_BAND.of("discount_percentage").alias("categorie_reduction"),
        labels.DURATION_BAND.of("duree_jours").alias("categorie_duree"),
        _per(sold, length, sold).alias("ventes_par_jour"),
        _per(revenue, length, revenue).alias("ca_par_jour"),
        F.when(discount > 0, rnd(roi / discount)).alias("efficacite_par_pct_reduction"),
        flag(roi > 50).alias("flag_promo_reussie"),
        flag(roi > 100).alias("flag_promo_excellente"),
        flag(length > 20).alias("flag_longue_duree"),
        flag(discount >= 25).alias("flag_forte_reduction"),
        "statut",
    )


def campaigns(performance: DataFrame) -> DataFrame:
    """Campaigns with a known performance only."""
    length, budget, reach = F.col("duree_jours"), F.col("budget"), F.col("reach")
    planned, real, roi = F.col("taux_conversion_prevu"), F.col("taux_conversion_reel"), F.col("roi_pct")
    return performance.filter(F.col("performance") != labels.CAMPAIGN_STATUS[-1]).select(
        "campaign_id",
        "campaign_name",
        "campaign_type",
        "product_category",
        "target_audience",
        "region",
        "budget",
        "reach",
        "taux_conversion_prevu",
        "taux_conversion_reel",
        "nb_ventes",
        "ca_genere",
        "roi",
        "roi_pct",
        "start_date",
        "end_date",
        "duree_jours",
        F.month("start_date").alias("mois_debut"),
        season("start_date").alias("saison"),
        "cout_par_vente",
        "cout_par_client",
        _per(budget, length, budget).alias("budget_par_jour"),
        _per(F.col("nb_ventes"), length, F.col("nb_ventes")).alias("ventes_par_jour"),
        _per(F.col("ca_genere"), length, F.col("ca_genere")).alias("ca_par_jour"),
        F.when(budget > 0, rnd(dbl(reach) / budget)).alias("reach_par_euro"),
        F.when(planned > 0, rnd((real - planned) / planned * 100.0)).alias("ecart_conversion_pct"),
        labels.BUDGET_BAND.of("budget").alias("categorie_budget"),
        labels.REACH_BAND.of("reach").alias("categorie_reach"),
        flag(roi > 50).alias("flag_campagne_reussie"),
        flag(roi > 100).alias("flag_campagne_excellente"),
        flag(real > planned).alias("flag_depasse_objectif"),
        flag(budget > 400000).alias("flag_gros_investissement"),
        "performance",
    )


# --- checks -------------------------------------------------------------------


def row_count(table: DataFrame, name: str) -> DataFrame:
    return table.agg(rows().alias("valeur")).select(F.lit(labels.CHECK_LABELS[name]).alias("info"), "valeur")


def flag_sums(table: DataFrame, **names: str) -> DataFrame:
    """Sum of each flag; ``names`` is output name -> flag column."""
    return table.agg(*[F.sum(flag_col).cast("long").alias(out) for out, flag_col in names.items()])


def preview(table: DataFrame, *key: str, k: int = 10) -> DataFrame:
    """The first rows by key."""
    return top_k(table, [F.col(c).asc_nulls_last() for c in key], k)


def _desc(name: str):
    return F.col(name).desc_nulls_last()


def clients_rfm_dist(table: DataFrame, k: int = 15) -> DataFrame:
    return top_k(table.groupBy("score_rfm_total").agg(rows().alias("nb_clients")), [_desc("score_rfm_total")], k)


def clients_rfm_top(table: DataFrame, k: int = 10) -> DataFrame:
    out = table.groupBy("rfm_segment").agg(
        rows().alias("nb_clients"), _exact_mean("total_depense").alias("depense_moy")
    )
    return top_k(out, [_desc("nb_clients"), F.col("rfm_segment")], k)


def clients_flags(table: DataFrame) -> DataFrame:
    return flag_sums(
        table,
        nb_clients_premium="flag_client_premium",
        nb_clients_risque_churn="flag_risque_churn",
        nb_clients_sensibles_promo="flag_sensible_promo",
    )


def clients_age(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("tranche_age")
        .agg(rows().alias("nb_clients"), _exact_mean("panier_moyen").alias("panier_moy"))
        .orderBy(labels.AGE_BAND.order("tranche_age"))
    )


def sales_weekday(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("jour_semaine", "jour_semaine_num")
        .agg(
            rows().alias("nb_jours"),
            _exact_mean("ca_jour").alias("ca_moyen_par_jour"),
            _exact_sum("ca_jour").alias("ca_total"),
        )
        .orderBy("jour_semaine_num")
        .drop("jour_semaine_num")
    )


def sales_season(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("saison")
        .agg(
            rows().alias("nb_jours"),
            _exact_mean("ca_jour").alias("ca_moyen"),
            _exact_sum("ca_jour").alias("ca_total"),
        )
        .orderBy(position("saison", labels.SEASONS))
    )


def sales_promo_level(table: DataFrame) -> DataFrame:
    return (
        table.groupBy(labels.PROMO_LEVEL.of("pct_ventes_avec_promo").alias("niveau_promo"))
        .agg(rows().alias("nb_jours"), _exact_mean("ca_jour").alias("ca_moyen"))
        .orderBy(_desc("ca_moyen"), "niveau_promo")
    )


def sales_spikes(table: DataFrame, k: int = 20) -> DataFrame:
    out = table.filter(F.col("flag_jour_exceptionnel") == 1)
    order = [_desc("ca_jour"), F.col("transaction_date"), F.col("region"), F.col("categorie_promo").asc_nulls_last()]
    return top_k(out, order, k).select(
        "transaction_date", "region", "ca_jour", "ca_moyenne_7j", "ecart_vs_moyenne_7j"
    )


def products_popularity(table: DataFrame) -> DataFrame:
    return (
        table.filter(F.col("nb_avis") > 0)
        .groupBy(labels.POPULARITY.of("score_popularite").alias("categorie_popularite"))
        .agg(rows().alias("nb_produits"), _exact_mean("note_moyenne").alias("note_moy"))
        .orderBy(labels.POPULARITY.order("categorie_popularite"))
    )


def products_flags(table: DataFrame) -> DataFrame:
    return flag_sums(
        table,
        nb_populaires="flag_populaire",
        nb_urgents_reappro="flag_urgent_reappro",
        nb_produits_probleme="flag_probleme",
        nb_surstock="flag_surstock",
    )


def products_action(table: DataFrame, k: int = 20) -> DataFrame:
    out = table.filter((F.col("flag_urgent_reappro") == 1) | (F.col("flag_probleme") == 1))
    order = [_desc("score_popularite"), F.col("product_id"), F.col("region").asc_nulls_last()]
    return top_k(out, order, k).select(
        "product_id",
        "categorie",
        "score_popularite",
        "niveau_stock",
        "flag_urgent_reappro",
        "flag_probleme",
        "alerte",
    )


def promos_discount(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("categorie_reduction")
        .agg(
            rows().alias("nb_promos"),
            _exact_mean("roi_promo_pct").alias("roi_moyen"),
            _exact_mean("ventes_par_jour").alias("ventes_jour_moy"),
        )
        .orderBy(labels.DISCOUNT_BAND.order("categorie_reduction"))
    )


def promos_duration(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("categorie_duree")
        .agg(
            rows().alias("nb_promos"),
            _exact_mean("roi_promo_pct").alias("roi_moyen"),
            _exact_mean("ca_par_jour").alias("ca_jour_moy"),
        )
        .orderBy(labels.DURATION_BAND.order("categorie_duree"))
    )


def promos_season(table: DataFrame) -> DataFrame:
    return table.groupBy("saison_promo").agg(
        rows().alias("nb_promos"),
        _exact_mean("roi_promo_pct").alias("roi_moyen"),
        _exact_mean("discount_percentage").alias("reduction_moy"),
    )


def promos_flags(table: DataFrame) -> DataFrame:
    return flag_sums(
        table,
        nb_promos_reussies="flag_promo_reussie",
        nb_promos_excellentes="flag_promo_excellente",
        nb_promos_longues="flag_longue_duree",
        nb_fortes_reductions="flag_forte_reduction",
    )


def promos_combos(table: DataFrame, k: int = 15, min_promos: int = 3) -> DataFrame:
    out = (
        table.groupBy("categorie_reduction", "categorie_duree")
        .agg(rows().alias("nb_promos"), _exact_mean("roi_promo_pct").alias("roi_moyen"))
        .filter(F.col("nb_promos") >= min_promos)
    )
    return top_k(out, [_desc("roi_moyen"), F.col("categorie_reduction"), F.col("categorie_duree")], k)


def campaigns_type(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("campaign_type")
        .agg(
            rows().alias("nb_campagnes"),
            _exact_mean("roi_pct").alias("roi_moyen"),
            _exact_mean("reach_par_euro").alias("reach_par_euro_moy"),
        )
        .orderBy(_desc("roi_moyen"), "campaign_type")
    )


def campaigns_audience(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("target_audience")
        .agg(
            rows().alias("nb_campagnes"),
            _exact_mean("roi_pct").alias("roi_moyen"),
            _exact_mean("taux_conversion_reel", 4).alias("taux_conv_moy"),
        )
        .orderBy(_desc("roi_moyen"), "target_audience")
    )


def campaigns_budget(table: DataFrame) -> DataFrame:
    return (
        table.groupBy("categorie_budget")
        .agg(
            rows().alias("nb_campagnes"),
            _exact_mean("roi_pct").alias("roi_moyen"),
            _exact_sum("budget").alias("budget_total"),
            _exact_sum("ca_genere").alias("ca_total"),
        )
        .orderBy(labels.BUDGET_BAND.order("categorie_budget"))
    )


def campaigns_season(table: DataFrame) -> DataFrame:
    return table.groupBy("saison").agg(
        rows().alias("nb_campagnes"), _exact_mean("roi_pct").alias("roi_moyen")
    )


def campaigns_flags(table: DataFrame) -> DataFrame:
    return flag_sums(
        table,
        nb_campagnes_reussies="flag_campagne_reussie",
        nb_campagnes_excellentes="flag_campagne_excellente",
        nb_depassent_objectif="flag_depasse_objectif",
        nb_gros_investissements="flag_gros_investissement",
    )


def campaigns_combos(table: DataFrame, k: int = 15, min_campaigns: int = 2) -> DataFrame:
    out = (
        table.groupBy("campaign_type", "target_audience")
        .agg(rows().alias("nb_campagnes"), _exact_mean("roi_pct").alias("roi_moyen"))
        .filter(F.col("nb_campagnes") >= min_campaigns)
    )
    return top_k(out, [_desc("roi_moyen"), F.col("campaign_type"), F.col("target_audience")], k)


def summary(
    clients_table: DataFrame,
    products_table: DataFrame,
    promotions_table: DataFrame,
    campaigns_table: DataFrame,
) -> DataFrame:
    """Six flag totals, one row each; the three of the client table come from one pass."""
    premium, at_risk, promo, popular, good_promos, good_campaigns = labels.SUMMARY_METRICS
    plan = [
        (clients_table, {premium: "flag_client_premium", at_risk: "flag_risque_churn", promo: "flag_sensible_promo"}),
        (products_table, {popular: "flag_populaire"}),
        (promotions_table, {good_promos: "flag_promo_reussie"}),
        (campaigns_table, {good_campaigns: "flag_campagne_reussie"}),
    ]
    parts = []
    for table, metrics in plan:
        sums = table.agg(*[dbl(F.sum(c)).alias(c) for c in metrics.values()])
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("valeur")) for m, c in metrics.items()]
        parts.append(sums.select(F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, parts)
