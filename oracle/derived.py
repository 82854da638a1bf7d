"""Gold inputs spelled out row by row: every join is made, nothing is pre-aggregated."""

from __future__ import annotations

from oracle.preamble import TODAY, case_of, d, days, mean, month, pct, quarter, quot, r, season, small
from retail_lake.functions import labels

_OPEN = "t.transaction_date >= {x}.start_date and t.transaction_date <= {x}.end_date and t.region = {x}.region"
PROMO_OPEN, CAMP_OPEN = _OPEN.format(x="p"), _OPEN.format(x="c")


def _flag(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def _status(names: tuple[str, ...], roi: str) -> str:
    best, good, plain, none = names
    return (
        f"case when nb_ventes = 0 then '{none}' when {roi} > 100 then '{best}' "
        f"when {roi} > 50 then '{good}' else '{plain}' end"
    )


def _code(value: str, codes: dict[str, int], default: int | None = None) -> str:
    out = f"case {value} " + " ".join(f"when '{k}' then {v}" for k, v in codes.items())
    return out + (f" else {default} end" if default is not None else " end")


def _per_day(value: str) -> str:
    return f"case when duree_jours > 0 then {r(f'{d(value)} / duree_jours')} else {d(value)} end"


def tables() -> dict[str, str]:
    q_excellent, q_good, q_problem, q_medium = labels.QUALITY_LABELS
    s_empty, s_low, s_fair, s_high = labels.STOCK_LEVELS
    a_urgent, a_quality, a_surplus, a_fine = labels.ALERTS
    span = days("premier_achat", "dernier_achat")
    week = "over (partition by region, categorie_promo order by transaction_date rows between 6 preceding and current row)"
    return {
        "wide": f"""
            select t.transaction_id, t.entity as customer_id, p.promotion_id, c.campaign_id,
                   t.transaction_date, {month('t.transaction_date')} as month,
                   {quarter('t.transaction_date')} as quarter, {small('year(t.transaction_date)')} as year,
                   t.region, t.payment_method, t.amount as amount_exact, {d('t.amount')} as amount,
                   k.name as customer_name, k.age, k.age_group, k.gender, k.marital_status,
                   {d('k.annual_income')} as annual_income, k.country,
                   p.promotion_type, p.product_category as promo_category,
                   {d('p.discount_percentage')} as discount_percentage,
                   p.start_date as promo_start_date, p.end_date as promo_end_date,
                   c.campaign_name, c.campaign_type, c.target_audience, {d('c.budget')} as budget, c.reach,
                   {d('c.conversion_rate')} as conversion_rate,
                   c.start_date as campaign_start_date, c.end_date as campaign_end_date,
                   p.promotion_id is not null as has_promotion, c.campaign_id is not null as has_campaign,
                   {r(quot('t.amount', 'k.annual_income') + ' * 100.0', 4)} as pct_of_annual_income,
                   {r(quot('c.budget', 'c.reach'), 4)} as cost_per_reach
            from tx t left join cust k on t.entity = k.customer_id
            left join promo p on {PROMO_OPEN} left join camp c on {CAMP_OPEN}""",
        "rfm_base": f"""
            select customer_id, {days('max(transaction_date)', TODAY)} as recency, count(*) as frequency,
                   sum(amount_exact) as monetary from wide group by customer_id""",
        "rfm": f"""
            select *, case when recency_score >= 4 and frequency_score >= 4 then 'Champions'
                when recency_score >= 3 and frequency_score >= 3 then 'Loyal Customers'
                when recency_score >= 4 and frequency_score <= 2 then 'Promising'
                when recency_score <= 2 then 'At Risk' else 'Needs Attention' end as rfm_segment
            from (select customer_id, recency, frequency, {d('monetary')} as monetary,
                {small('ntile(5) over (order by recency desc nulls last, customer_id)')} as recency_score,
                {small('ntile(5) over (order by frequency, customer_id)')} as frequency_score,
                {small('ntile(5) over (order by rfm_base.monetary nulls last, customer_id)')} as monetary_score
                from rfm_base)""",
        "buyers": f"""
            select entity as client, count(*) as nb_achats, sum(amount) as depense,
                   {mean('amount')} as panier_moyen, min(transaction_date) as premier_achat,
                   max(transaction_date) as dernier_achat,
                   {pct('count(*) filter (where promoted)', 'count(*)')} as pct_achats_promo,
                   {days('max(transaction_date)', TODAY)} as jours_depuis_dernier_achat
            from (select t.*, exists (select 1 from promo p where {PROMO_OPEN}) as promoted from tx t)
            group by entity""",
        "profil": f"""
            select client, name,
                   {small('ntile(5) over (order by jours_depuis_dernier_achat desc, client)')} as score_recence,
                   {small('ntile(5) over (order by nb_achats, client)')} as score_frequence,
                   {small('ntile(5) over (order by depense nulls last, client)')} as score_monetaire,
                   nb_achats, {d('depense')} as total_depense, panier_moyen, jours_depuis_dernier_achat,
                   pct_achats_promo, premier_achat, dernier_achat, age, gender,
                   {d('annual_income')} as annual_income, marital_status, region, country,
                   {case_of(labels.VALUE_SEGMENT, 'depense')} as segment_valeur,
                   {case_of(labels.ACTIVITY_SEGMENT, 'jours_depuis_dernier_achat')} as segment_activite
            from buyers left join cust on client = customer_id""",
        "f_clients": f"""
            select client, name, score_recence, score_frequence, score_monetaire,
                   score_recence + score_frequence + score_monetaire as score_rfm_total,
                   score_recence || '' || score_frequence || '' || score_monetaire as rfm_segment,
                   nb_achats, total_depense, panier_moyen, jours_depuis_dernier_achat, pct_achats_promo,
                   case when {span} > 0 then {r(f'{d("nb_achats")} * 30.0 / {d(span)}')}
                        else {d('nb_achats')} end as frequence_mensuelle,
                   {span} as duree_vie_client_jours, {r(f'{d(span)} / 30.0', 1)} as duree_vie_client_mois,
                   age, gender, annual_income, marital_status, region, country,
                   {case_of(labels.AGE_BAND, 'age')} as tranche_age,
                   {case_of(labels.INCOME_BAND, 'annual_income')} as tranche_revenu,
                   case when {span} > 0 then {r(f'total_depense / ({d(span)} / {d("365.0")})')}
                        else total_depense end as clv_annuelle_estimee,
                   {case_of(labels.BUYING_TREND, 'jours_depuis_dernier_achat')} as tendance_achat,
                   case when annual_income > 0 then {pct('total_depense', 'annual_income')} end
                        as ratio_depense_revenu,
                   {_flag('total_depense >= 30000 and nb_achats >= 15')} as flag_client_premium,
                   {_flag('jours_depuis_dernier_achat > 90 and nb_achats >= 3')} as flag_risque_churn,
                   {_flag('pct_achats_promo >= 50')} as flag_sensible_promo,
                   segment_valeur, segment_activite,
                   {_code('segment_valeur', labels.VALUE_SEGMENT_CODE)} as segment_valeur_num,
                   {_code('segment_activite', labels.ACTIVITY_SEGMENT_CODE)} as segment_activite_num
            from profil""",
        "enriched": f"""
            select t.transaction_id, t.transaction_date, t.region, t.amount as amount_exact,
                   {d('t.amount')} as amount, p.promotion_id, p.product_category as categorie_promo,
                   case when p.promotion_id is null then 'Non' else 'Oui' end as avec_promo,
                   p.discount_percentage * 100 as taux_exact, {d('p.discount_percentage * 100')} as taux_reduction,
                   c.campaign_id, case when c.campaign_id is null then 'Non' else 'Oui' end as avec_campagne
            from tx t left join promo p on {PROMO_OPEN} left join camp c on {CAMP_OPEN}""",
        "jours": f"""
            select transaction_date, region, categorie_promo, count(*) as nb_ventes_jour,
                   sum(amount_exact) as ca_exact, {mean('amount_exact')} as panier_moyen_jour,
                   count(*) filter (where avec_promo = 'Oui') as nb_ventes_avec_promo,
                   {mean('taux_exact', None)} as taux_reduction_moyen,
                   count(*) filter (where avec_campagne = 'Oui') as nb_ventes_avec_campagne
            from enriched group by all""",
        "f_ventes": f"""
            select *, {r('ca_jour - ca_moyenne_7j')} as ecart_vs_moyenne_7j,
                   {_flag('ca_jour > 1.5 * ca_moyenne_7j')} as flag_jour_exceptionnel
            from (select transaction_date, region, categorie_promo, nb_ventes_jour, {d('ca_exact')} as ca_jour,
                   panier_moyen_jour, nb_ventes_avec_promo, nb_ventes_avec_campagne, taux_reduction_moyen,
                   {small('year(transaction_date)')} as annee, {small('month(transaction_date)')} as mois,
                   {small('day(transaction_date)')} as jour_du_mois,
                   {small('isodow(transaction_date)')} as jour_semaine_num,
                   dayname(transaction_date) as jour_semaine,
                   {_flag('isodow(transaction_date) > 5')} as is_weekend,
                   {case_of(labels.MONTH_PART, 'day(transaction_date)')} as periode_mois,
                   {season('transaction_date')} as saison,
                   {pct('nb_ventes_avec_promo', 'nb_ventes_jour')} as pct_ventes_avec_promo,
                   {pct('nb_ventes_avec_campagne', 'nb_ventes_jour')} as pct_ventes_avec_campagne,
                   {quot(f'sum(ca_exact) {week}', f'count(ca_exact) {week}')} as ca_moyenne_7j
                  from jours)""",
        "perf_produits": f"""
            select product_id, categorie, region, nb_avis, note_moyenne, avis_positifs, avis_negatifs,
                   current_stock, reorder_point, lead_time, jours_depuis_restock,
                   case when note_moyenne >= 4.5 then '{q_excellent}' when note_moyenne >= 4.0 then '{q_good}'
                        when note_moyenne < 3.0 then '{q_problem}' else '{q_medium}' end as qualite,
                   case when current_stock = 0 then '{s_empty}' when current_stock < reorder_point then '{s_low}'
                        when current_stock <= reorder_point * 3 then '{s_fair}' else '{s_high}' end as niveau_stock,
                   case when current_stock < reorder_point and note_moyenne >= 4.0 and nb_avis >= 10 then '{a_urgent}'
                        when note_moyenne < 3.0 and nb_avis >= 10 then '{a_quality}'
                        when current_stock > reorder_point * 5 then '{a_surplus}' else '{a_fine}' end as alerte
            from (select i.product_id, i.product_category as categorie, i.region, count(v.product_id) as nb_avis,
                         {mean('v.rating')} as note_moyenne,
                         count(*) filter (where v.rating >= 4) as avis_positifs,
                         count(*) filter (where v.rating <= 2) as avis_negatifs,
                         i.current_stock, i.reorder_point, i.lead_time,
                         {days('i.last_restock_date', TODAY)} as jours_depuis_restock
                  from inv i left join rev v on i.product_id = v.product_id
                  group by i.product_id, i.product_category, i.region, i.warehouse, i.current_stock,
                           i.reorder_point, i.lead_time, i.last_restock_date)""",
        "f_produits": f"""
            select product_id, categorie, region, nb_avis, note_moyenne, avis_positifs, avis_negatifs,
                   case when avis_negatifs > 0 then {r(quot('avis_positifs', 'avis_negatifs'))} end
                        as ratio_positif_negatif,
                   case when nb_avis > 0 then {pct('avis_positifs', 'nb_avis')} end as pct_avis_positifs,
                   case when nb_avis > 0 and note_moyenne is not null
                        then {r(f'{d("nb_avis")} * note_moyenne')} else 0.0::double end as score_popularite,
                   current_stock, reorder_point, lead_time, jours_depuis_restock,
                   case when reorder_point > 0 then {r(quot('current_stock', 'reorder_point'))} end
                        as ratio_stock_seuil,
                   case when current_stock > 0 then current_stock * lead_time else 0 end as couverture_stock_approx,
                   qualite, {_code('qualite', labels.QUALITY_CODE, labels.QUALITY_CODE_ELSE)} as qualite_num,
                   niveau_stock, {_code('niveau_stock', labels.STOCK_LEVEL_CODE)} as niveau_stock_num,
                   {_flag('nb_avis >= 20 and note_moyenne >= 4.0')} as flag_populaire,
                   {_flag('current_stock < reorder_point and note_moyenne >= 4.0 and nb_avis >= 10')}
                        as flag_urgent_reappro,
                   {_flag('note_moyenne < 3.0 and nb_avis >= 10')} as flag_probleme,
                   {_flag('current_stock > reorder_point * 5')} as flag_surstock, alerte
            from perf_produits""",
        "promo_sales": f"""
            select p.promotion_id, p.product_category, p.promotion_type, p.region,
                   {d('p.discount_percentage * 100')} as discount_percentage,
                   {days('p.start_date', 'p.end_date')} as duree_jours,
                   count(distinct t.transaction_id) as nb_ventes, sum(t.amount) as ca,
                   {mean('t.amount')} as panier_moyen, p.start_date, p.end_date
            from promo p left join tx t on {PROMO_OPEN}
            group by p.promotion_id, p.product_category, p.promotion_type, p.region, p.discount_percentage,
                     p.start_date, p.end_date""",
        "usual": f"""
            select region, {quot('sum(amount)', 'max(transaction_date) - min(transaction_date) + 1')} as per_day
            from tx group by region""",
        "analyse_promos": f"""
            select *, {_status(labels.PROMO_STATUS, 'roi_promo_pct')} as statut
            from (select promotion_id, product_category, promotion_type, s.region, discount_percentage,
                         duree_jours, nb_ventes, {d('ca')} as ca_genere, panier_moyen,
                         {r(f"({quot(quot('ca', 'duree_jours + 1'), 'per_day')} - 1.0) * 100.0")} as roi_promo_pct,
                         start_date, end_date
                  from promo_sales s left join usual u on s.region = u.region)""",
        "f_promos": f"""
            select promotion_id, product_category, promotion_type, region, discount_percentage, duree_jours,
                   nb_ventes, ca_genere, panier_moyen, roi_promo_pct, start_date, end_date,
                   {small('month(start_date)')} as mois_debut, {small('isodow(start_date)')} as jour_semaine_debut,
                   {season('start_date')} as saison_promo,
                   {case_of(labels.DISCOUNT_BAND, 'discount_percentage')} as categorie_reduction,
                   {case_of(labels.DURATION_BAND, 'duree_jours')} as categorie_duree,
                   {_per_day('nb_ventes')} as ventes_par_jour, {_per_day('ca_genere')} as ca_par_jour,
                   case when discount_percentage > 0 then {r('roi_promo_pct / discount_percentage')} end
                        as efficacite_par_pct_reduction,
                   {_flag('roi_promo_pct > 50')} as flag_promo_reussie,
                   {_flag('roi_promo_pct > 100')} as flag_promo_excellente,
                   {_flag('duree_jours > 20')} as flag_longue_duree,
                   {_flag('discount_percentage >= 25')} as flag_forte_reduction, statut
            from analyse_promos where nb_ventes > 0""",
        "camp_sales": f"""
            select c.campaign_id, c.campaign_name, c.campaign_type, c.product_category, c.target_audience,
                   c.region, c.budget, c.reach, c.conversion_rate, c.start_date, c.end_date,
                   count(distinct t.transaction_id) as n, count(distinct t.entity) as clients,
                   sum(t.amount) as ca
            from camp c left join tx t on {CAMP_OPEN} group by all""",
        "perf_campagnes": f"""
            select *, {_status(labels.CAMPAIGN_STATUS, 'roi_pct')} as performance
            from (select campaign_id, campaign_name, campaign_type, product_category, target_audience, region,
                         {d('budget')} as budget, reach, {d('conversion_rate')} as taux_conversion_prevu,
                         {r(quot('clients', 'reach'), 6)} as taux_conversion_reel, n as nb_ventes,
                         {d('ca')} as ca_genere, {r(quot('ca', 'budget'))} as roi,
                         {r(quot(f'({d("ca")} - {d("budget")})', 'budget') + ' * 100.0')} as roi_pct,
                         start_date, end_date, {days('start_date', 'end_date')} as duree_jours,
                         {r(quot('budget', 'n'))} as cout_par_vente,
                         {r(quot('budget', 'clients'))} as cout_par_client from camp_sales)""",
        "f_campagnes": f"""
            select campaign_id, campaign_name, campaign_type, product_category, target_audience, region, budget,
                   reach, taux_conversion_prevu, taux_conversion_reel, nb_ventes, ca_genere, roi, roi_pct,
                   start_date, end_date, duree_jours, {small('month(start_date)')} as mois_debut,
                   {season('start_date')} as saison, cout_par_vente, cout_par_client,
                   {_per_day('budget')} as budget_par_jour, {_per_day('nb_ventes')} as ventes_par_jour,
                   {_per_day('ca_genere')} as ca_par_jour,
                   case when budget > 0 then {r(quot('reach', 'budget'))} end as reach_par_euro,
                   case when taux_conversion_prevu > 0 then
                        {r('(taux_conversion_reel - taux_conversion_prevu) / taux_conversion_prevu * 100.0')} end
                        as ecart_conversion_pct,
                   {case_of(labels.BUDGET_BAND, 'budget')} as categorie_budget,
                   {case_of(labels.REACH_BAND, 'reach')} as categorie_reach,
                   {_flag('roi_pct > 50')} as flag_campagne_reussie,
                   {_flag('roi_pct > 100')} as flag_campagne_excellente,
                   {_flag('taux_conversion_reel > taux_conversion_prevu')} as flag_depasse_objectif,
                   {_flag('budget > 400000')} as flag_gros_investissement, performance
            from perf_campagnes where performance <> 'N/A'""",
    }
