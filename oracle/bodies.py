"""SQL bodies by query name; inputs are the tables of ``preamble`` and ``derived``."""

from __future__ import annotations

import re

from oracle.derived import CAMP_OPEN, PROMO_OPEN
from oracle.preamble import (
    SHORT,
    TODAY,
    big,
    bronze_columns,
    case_of,
    d,
    days,
    mean,
    mean_of,
    month,
    pct,
    quarter,
    quot,
    r,
    share,
    small,
    total,
    with_inputs,
)
from retail_lake.functions import labels
from retail_lake.plans.registry import ONE_AUDIENCE, ONE_CATEGORY, ONE_REGION, ONE_TYPE
from retail_lake.sources.fixture_spec import RAW_TABLES

LOW = "current_stock < reorder_point"


def _sales() -> dict[str, str]:
    year = small("year(transaction_date)")

    def periods(period: str, name: str, extra: str = "", where: str = "") -> str:
        return (
            f"select {period} as {name}, count(*) as nb_transactions, {total('amount')} as total_revenue{extra} "
            f"from tx {where} group by 1"
        )

    def growth(period: str, name: str, previous: str, change: bool = False, lag: int = 1, where: str = "") -> str:
        before = f"lag(revenue, {lag}) over (order by {name})"
        extra = f", {r(f'revenue - {before}')} as revenue_change" if change else ""
        return (
            f"with s as (select {period} as {name}, {total('amount')} as revenue from tx {where} group by 1) "
            f"select {name}, revenue, {before} as {previous}{extra}, "
            f"{r(f'(revenue - {before}) / nullif({before}, 0) * 100.0')} as growth_percentage from s"
        )

    def moving(k: int) -> str:
        frame = f"over (order by month rows between {k - 1} preceding and current row)"
        return (
            f"with s as (select {month('transaction_date')} as month, sum(amount) as total from tx group by 1) "
            f"select month, {d('total')} as revenue, "
            f"{mean_of(f'sum(total) {frame}', f'count(total) {frame}')} as moving_avg_{k}months from s"
        )

    avg = f", {mean('amount')} as avg_transaction_value"
    asia = f"where region = '{ONE_REGION}'"
    m, q = month("transaction_date"), quarter("transaction_date")

    def by_region(n: str, s: str, a: str, extra: str = "") -> str:
        return f"select region, count(*) as {n}, {total('amount')} as {s}, {mean('amount')} as {a}{extra} from tx group by region"

    def kpis(where: str = "") -> str:
        return (
            f"select count(*) as total_transactions, {total('amount')} as total_revenue{avg}, "
            f"count(distinct entity) as unique_customers from tx {where}"
        )

    return {
        "sales_kpis": kpis(),
        "sales_kpis_one_region": kpis(asia),
        "sales_by_month": periods(m, "period", avg),
        "sales_by_month_one_region": periods(m, "period", avg, asia),
        "sales_by_quarter": periods(q, "period", avg),
        "sales_by_year": periods(year, "period", avg),
        "sales_month_customers": periods(
            m, "month", f", {mean('amount')} as avg_basket, count(distinct entity) as unique_customers"
        ),
        "sales_quarter_basic": periods(q, "quarter"),
        "sales_year_basic": periods(year, "year"),
        "sales_mom_growth": growth(m, "month", "previous_month_revenue"),
        "sales_mom_growth_one_region": growth(m, "month", "previous_month_revenue", where=asia),
        "sales_mom_change": growth(m, "month", "previous_month_revenue", True),
        "sales_qoq_growth": growth(q, "quarter", "previous_quarter_revenue"),
        "sales_yoy_growth": growth(year, "year", "previous_year_revenue"),
        "sales_month_yoy_growth": growth(m, "month", "same_month_last_year", lag=12),
        "sales_next_month": f"""
            with s as (select {m} as month, {total('amount')} as revenue from tx group by 1)
            select month, revenue, lead(revenue) over (order by month) as next_month_revenue from s""",
        "sales_by_weekday": periods("dayname(transaction_date)", "day_of_week"),
        "sales_by_weekday_one_region": periods("dayname(transaction_date)", "day_of_week", where=asia),
        "sales_weekday_avg": periods("dayname(transaction_date)", "day_of_week", avg),
        "sales_by_month_name": f"""
            select monthname(transaction_date) as month_name, {small('month(transaction_date)')} as month_num,
                   {total('amount')} as total_revenue from tx group by 1, 2""",
        "sales_month_name_avg": periods("monthname(transaction_date)", "month_name", avg),
        "sales_moving_avg_3m": moving(3),
        "sales_moving_avg_6m": moving(6),
        "sales_moving_avg_12m": moving(12),
        "sales_peak_days": f"""
            select transaction_date, count(*) as nb_transactions, {total('amount')} as daily_revenue
            from tx group by 1 order by sum(amount) desc nulls last, 1 limit 20""",
        "sales_by_region": by_region("transaction_count", "total_amount", "avg_amount"),
        "sales_region_customers": by_region(
            "nb_transactions", "total_revenue", "avg_transaction_value",
            ", count(distinct entity) as unique_customers",
        ),
        "sales_region_marketing": f"""
            select t.region, {total('t.amount')} as total_revenue, count(distinct c.campaign_id) as campaign_count,
                   {total('c.budget')} as marketing_budget,
                   {r(quot('sum(t.amount)', 'sum(c.budget)'))} as revenue_per_marketing_euro
            from tx t left join camp c on t.region = c.region group by t.region""",
        "sales_region_marketing_once": f"""
            with s as (select region, sum(amount) as a from tx group by region),
            m as (select region, count(distinct campaign_id) as c, sum(budget) as b from camp group by region)
            select s.region, {r('a')} as total_revenue, coalesce(c, 0) as campaign_count,
                   {r('b')} as marketing_budget, {r(quot('a', 'b'))} as revenue_per_marketing_euro
            from s left join m on s.region = m.region""",
        "sales_cohorts": f"""
            with b as (select distinct entity, {m} as mon from tx),
            f as (select entity, mon, min(mon) over (partition by entity) as cohort_month from b)
            select cohort_month, {small("date_diff('month', cohort_month, mon)")} as months_since,
                   count(*) as customers from f group by 1, 2""",
        "sales_regions_list": "select distinct region from tx",
    }


def _products() -> dict[str, str]:
    return {
        "prod_top_reviewed": f"""
            select v.product_id, count(*) as review_count, {mean('v.rating')} as avg_rating,
                   {big('sum(v.helpful_votes)')} as total_helpful_votes, {big('sum(v.total_votes)')} as total_votes
            from rev v left join inv i on v.product_id = i.product_id group by 1
            order by review_count desc, product_id limit 20""",
        "prod_top_reviewed_once": f"""
            select product_id, count(*) as review_count, {mean('rating')} as avg_rating,
                   {big('sum(helpful_votes)')} as total_helpful_votes, {big('sum(total_votes)')} as total_votes
            from rev group by 1 order by review_count desc, product_id limit 20""",
        "prod_best_rated": f"""
            select product_id, count(*) as review_count, {mean('rating')} as avg_rating from rev group by 1
            having count(*) >= 10 order by avg_rating desc nulls last, review_count desc, product_id limit 20""",
        "prod_category_ratings": f"""
            select product_category as category, count(*) as review_count, {mean('rating')} as avg_rating,
                   count(distinct product_id) as unique_products, count(distinct reviewer_id) as unique_reviewers
            from rev group by 1""",
        "prod_category_stock": f"""
            select product_category, count(distinct product_id) as product_count,
                   {big('sum(current_stock)')} as total_stock, {mean('current_stock', 0)} as avg_stock_per_product,
                   count(distinct warehouse) as warehouse_count from inv group by 1""",
        "prod_category_promos": f"""
            select product_category, count(*) as promo_count, {mean('discount_percentage')} as avg_discount,
                   min(start_date) as first_promo, max(end_date) as last_promo from promo group by 1""",
        "prod_category_campaigns": f"""
            select product_category, count(*) as campaign_count, {total('budget')} as total_budget,
                   {mean('conversion_rate')} as avg_conversion_rate, {mean('reach', 0)} as avg_reach
            from camp group by 1""",
        "cx_rating_vs_stock": f"""
            with pp as (select v.product_id, v.product_category, count(distinct v.review_id) as n,
                    {mean('v.rating')} as note, i.current_stock, i.reorder_point
                from rev v left join inv i on v.product_id = i.product_id
                group by v.product_id, v.product_category, i.current_stock, i.reorder_point)
            select {case_of(labels.RATING_BUCKET, 'note')} as rating_category, count(*) as product_count,
                   {mean('n', 0)} as avg_reviews_per_product, {mean('current_stock', 0)} as avg_stock_level,
                   count(*) filter (where {LOW}) as products_low_stock
            from pp where note is not null group by 1""",
        "cx_popular_vs_stock": f"""
            select v.product_id, v.product_category, count(*) as review_count, {mean('v.rating')} as avg_rating,
                   i.current_stock, i.reorder_point,
                   case when {LOW} then '{labels.STOCK_RISK}' when current_stock < 2 * reorder_point
                        then '{labels.STOCK_LOW}' else '{labels.STOCK_OK}' end as stock_status,
                   i.warehouse, i.region
            from rev v left join inv i on v.product_id = i.product_id group by 1, 2, 5, 6, 7, 8, 9
            having count(*) >= 10
            order by review_count desc, avg_rating desc nulls last, 1, 2, 5 nulls last, 6 nulls last,
                     8 nulls last, 9 nulls last limit 30""",
        "cx_negative_reviews": f"""
            select product_category, count(*) filter (where rating <= 2) as negative_reviews,
                   count(*) filter (where rating >= 4) as positive_reviews, count(*) as total_reviews,
                   {share('rating <= 2')} as negative_review_rate, {mean('rating')} as avg_rating
            from rev group by 1""",
        "prod_rank_in_category": """
            with n as (select product_category, product_id, count(*) as review_count from rev group by 1, 2)
            select product_category, product_id, review_count,
                   row_number() over (partition by product_category order by review_count desc, product_id) as row_num,
                   rank() over (partition by product_category order by review_count desc) as review_rank,
                   dense_rank() over (partition by product_category order by review_count desc)
                       as review_dense_rank from n""",
    }


def _logistics() -> dict[str, str]:
    trip = "date_diff('day', ship_date, estimated_delivery)"
    dated = "where ship_date is not null and estimated_delivery is not null"
    rest = f"date_diff('day', last_restock_date, {TODAY})"
    return {
        "ops_stockouts": f"""
            select product_category, region, count(*) as total_products,
                   count(*) filter (where {LOW}) as products_below_reorder,
                   count(*) filter (where current_stock = 0) as products_out_of_stock,
                   {share(LOW)} as stockout_rate, {mean('current_stock', 0)} as avg_stock_level,
                   {mean('reorder_point', 0)} as avg_reorder_point from inv group by all""",
        "ops_critical_products": f"""
            select i.product_id, i.product_category, i.region, i.warehouse, i.current_stock, i.reorder_point,
                   i.lead_time, i.last_restock_date, count(v.review_id) as review_count,
                   {mean('v.rating')} as avg_rating, {small(rest)} as days_since_restock
            from inv i left join rev v on i.product_id = v.product_id where {LOW}
            group by 1, 2, 3, 4, 5, 6, 7, 8 having count(v.review_id) >= 5
            order by review_count desc, 5, 1, 2, 3, 4, 6, 7, 8 limit 30""",
        "ops_warehouse_perf": f"""
            select warehouse, region, country, count(distinct product_id) as product_count,
                   {big('sum(current_stock)')} as total_stock, {mean('lead_time', 1)} as avg_lead_time_days,
                   count(*) filter (where {LOW}) as products_below_reorder, {share(LOW)} as stockout_risk_rate,
                   {mean(rest, 0)} as avg_days_since_restock from inv group by 1, 2, 3""",
        "ops_supplier_vs_stockout": f"""
            select s.product_category, s.region, count(distinct s.supplier_id) as supplier_count,
                   {mean('s.reliability_score')} as avg_supplier_reliability,
                   {mean('s.lead_time', 1)} as avg_supplier_lead_time,
                   count(*) filter (where s.quality_rating in ('A', 'B')) as high_quality_suppliers,
                   count(distinct i.product_id) as products_in_category,
                   count(*) filter (where {LOW}) as products_low_stock,
                   {pct(f'count(*) filter (where {LOW})', 'count(distinct i.product_id)')} as stockout_rate
            from supp s left join inv i on s.product_category = i.product_category and s.region = i.region
            group by 1, 2""",
        "ops_supplier_vs_stockout_once": f"""
            with s as (select product_category, region, count(distinct supplier_id) as supplier_count,
                    {mean('reliability_score')} as avg_supplier_reliability,
                    {mean('lead_time', 1)} as avg_supplier_lead_time,
                    count(*) filter (where quality_rating in ('A', 'B')) as high_quality_suppliers
                from supp group by 1, 2),
            i as (select product_category, region, count(distinct product_id) as p,
                    count(*) filter (where {LOW}) as low from inv group by 1, 2)
            select s.*, coalesce(p, 0) as products_in_category, coalesce(low, 0) as products_low_stock,
                   {pct('coalesce(low, 0)', 'p')} as stockout_rate
            from s left join i on s.product_category = i.product_category and s.region = i.region""",
        "ops_stock_vs_reviews": f"""
            select i.product_category, count(distinct i.product_id) as total_products,
                   count(*) filter (where {LOW}) as products_low_stock,
                   count(distinct v.review_id) as total_reviews,
                   count(*) filter (where v.rating <= 2) as negative_reviews, {mean('v.rating')} as avg_rating,
                   {pct('count(*) filter (where v.rating <= 2)', 'count(distinct v.review_id)')}
                       as negative_review_rate
            from inv i left join rev v on i.product_id = v.product_id group by 1""",
        "ops_carrier_delays": f"""
            select carrier, shipping_method, count(*) as shipment_count, {mean(trip, 1)} as avg_delivery_days,
                   {small(f'min({trip})')} as min_delivery_days, {small(f'max({trip})')} as max_delivery_days,
                   {mean('shipping_cost')} as avg_shipping_cost,
                   count(*) filter (where status = 'Delivered') as delivered_count,
                   {share("status = 'Delivered'")} as delivery_success_rate from ship {dated} group by 1, 2""",
        "ops_region_delays": f"""
            with s as (select * from ship {dated}),
            often as (select destination_region as r, destination_country as c, status, row_number() over
                (partition by destination_region, destination_country order by count(*) desc, status) as rn
                from s group by 1, 2, status)
            select destination_region, destination_country, count(*) as shipment_count,
                   {mean(trip, 1)} as avg_delivery_days, {mean('shipping_cost')} as avg_shipping_cost,
                   count(distinct carrier) as carrier_diversity, any_value(often.status) as most_common_status
            from s left join often on rn = 1 and r is not distinct from destination_region
                 and c is not distinct from destination_country
            group by 1, 2 having count(*) >= 10 order by avg_delivery_days desc nulls last, 1, 2 limit 20""",
        "ops_speed_vs_cost": f"""
            select {case_of(labels.DELIVERY_SPEED, trip)} as delivery_speed_category, count(*) as shipment_count,
                   {mean(trip, 1)} as avg_days, {mean('shipping_cost')} as avg_cost,
                   {d('min(shipping_cost)')} as min_cost, {d('max(shipping_cost)')} as max_cost,
                   count(distinct carrier) as carrier_count from ship {dated} group by 1""",
        "ops_status_share": f"""
            select status, count(*) as shipment_count, {pct('count(*)', 'sum(count(*)) over ()')} as percentage,
                   {mean(trip, 1)} as avg_delivery_days, {mean('shipping_cost')} as avg_cost,
                   count(distinct carrier) as carriers_involved from ship group by 1""",
    }


def _experience() -> dict[str, str]:
    solved = "resolution_status = 'Resolved'"
    common = f"count(*) as interaction_count, {mean('customer_satisfaction')} as avg_satisfaction"
    resolved = f"count(*) filter (where {solved}) as resolved_count, {share(solved)} as resolution_rate"
    return {
        "cx_issue_satisfaction": f"""
            select issue_category, {common}, {mean('duration_minutes', 1)} as avg_duration_minutes, {resolved},
                   count(*) filter (where follow_up_required = 'Yes') as follow_ups_needed from serv group by 1""",
        "cx_channel_satisfaction": f"""
            select interaction_type, {common}, {mean('duration_minutes', 1)} as avg_duration, {resolved}
            from serv group by 1""",
        "cx_resolution_time": f"""
            select issue_category, {common}, {mean('duration_minutes', 1)} as avg_resolution_time_minutes,
                   {d('min(duration_minutes)')} as min_time, {d('max(duration_minutes)')} as max_time
            from serv where {solved} group by 1""",
    }


def _customers() -> dict[str, str]:
    part = f"count(*) as customer_count, {pct('count(*)', 'sum(count(*)) over ()')} as percentage"
    income = f", {mean('annual_income')} as avg_income"

    def mode(column: str) -> str:
        return (
            f"(select {column} from cust m where m.region is not distinct from c.region and age is not null "
            f"and {column} is not null group by 1 order by count(*) desc, 1 limit 1)"
        )

    return {
        "cust_by_gender": f"select gender, {part}{income} from cust group by 1",
        "cust_by_age_group": f"select age_group, {part}{income} from cust where date_of_birth is not null group by 1",
        "cust_by_marital": f"select marital_status, {part}{income} from cust group by 1",
        "cust_by_income": f"""
            select {case_of(labels.INCOME_BRACKET, 'annual_income')} as income_bracket, {part}
            from cust where annual_income is not null group by 1""",
        "cust_top_countries": f"""
            select country, {part}{income} from cust group by 1 order by customer_count desc, country limit 20""",
        "cust_age_income_matrix": f"""
            select {case_of(labels.AGE_SEGMENT, 'age')} as age_segment,
                   {case_of(labels.INCOME_SEGMENT, 'annual_income')} as income_segment,
                   count(*) as customer_count, {pct('count(*)', 'sum(count(*)) over ()')} as percentage_of_total
            from cust where age is not null and annual_income is not null group by 1, 2""",
        "cust_region_persona": f"""
            select region, customer_count, avg_age, avg_income, {mode('gender')} as dominant_gender,
                   {mode('marital_status')} as dominant_marital_status, country_diversity
            from (select region, count(*) as customer_count, {mean('age', 0)} as avg_age,
                         {mean('annual_income')} as avg_income, count(distinct country) as country_diversity
                  from cust where age is not null group by 1) c""",
    }


def _promotions() -> dict[str, str]:
    def kpis(where: str = "") -> str:
        return (
            f"select count(distinct promotion_id) as total_promos, "
            f"{r(mean('discount_percentage', None) + ' * 100.0', 1)} as avg_discount, "
            "count(distinct product_category) as categories_with_promos, "
            f"count(distinct region) as regions_with_promos from promo {where}"
        )

    def with_or_without(where: str = "") -> str:
        return f"""
            select case when p.promotion_id is null then '{labels.WITHOUT_PROMO}' else '{labels.WITH_PROMO}' end
                       as promo_status, count(*) as nb_transactions, {total('t.amount')} as total_revenue,
                   {mean('t.amount')} as avg_transaction_value,
                   {pct('count(*)', 'sum(count(*)) over ()')} as percentage_of_transactions,
                   {pct('sum(t.amount)', 'sum(sum(t.amount)) over ()')} as percentage_of_revenue
            from tx t left join promo p on {PROMO_OPEN} {where} group by 1"""

    def by_discount(where: str = "") -> str:
        return f"""
            select {case_of(labels.DISCOUNT_RANGE, 'p.discount_percentage * 100')} as discount_range,
                   count(*) as nb_transactions, {total('t.amount')} as total_revenue,
                   {mean('t.amount')} as avg_transaction_value,
                   {mean('p.discount_percentage * 100')} as avg_discount_pct
            from tx t join promo p on {PROMO_OPEN} {where} group by 1"""

    def roi(where: str = "") -> str:
        return f"""
            select p.product_category, count(distinct p.promotion_id) as promo_count,
                   {r(mean('p.discount_percentage', None) + ' * 100.0')} as avg_discount,
                   count(distinct t.transaction_id) as transactions_during_promo,
                   {total('t.amount')} as revenue_during_promo, {mean('t.amount')} as avg_transaction_value
            from promo p left join tx t on {PROMO_OPEN} {where} group by 1
            order by revenue_during_promo desc nulls last, 1 nulls last limit 10"""

    lift = (
        "(coalesce(with_promo.v, 0.0::double) - coalesce(base.v, 0.0::double)) / nullif(base.v, 0) * 100.0"
    )
    sensitivity = f"""
        with cats as (select distinct product_category from inv),
        base as (select c.product_category, count(distinct t.transaction_id) as n, {mean('t.amount')} as v
            from tx t cross join cats c where not exists (select 1 from promo p where {PROMO_OPEN}
                and p.product_category = c.product_category) group by 1),
        with_promo as (select p.product_category, count(distinct t.transaction_id) as n, {mean('t.amount')} as v,
                {r(mean('p.discount_percentage', None) + ' * 100.0')} as off
            from tx t join promo p on {PROMO_OPEN} group by 1),
        lifts as (select coalesce(base.product_category, with_promo.product_category) as category,
                coalesce(base.n, 0) as transactions_no_promo, coalesce(base.v, 0) as avg_value_no_promo,
                coalesce(with_promo.n, 0) as transactions_with_promo,
                coalesce(with_promo.v, 0) as avg_value_with_promo, coalesce(off, 0) as avg_discount, {lift} as lift
            from base full join with_promo on base.product_category = with_promo.product_category),
        report as (select category, transactions_no_promo, avg_value_no_promo, transactions_with_promo,
                avg_value_with_promo, avg_discount, {r('lift')} as lift_percentage,
                case when lift > 20 then 'Très sensible' when lift >= 5 then 'Sensible'
                     when lift >= -5 and lift <= 5 then 'Neutre' else 'Peu sensible' end as sensitivity_level
            from lifts where category is not null order by lift_percentage desc nulls last, category limit 15)
        select * from report"""
    return {
        "promo_kpis": kpis(),
        "promo_kpis_filtered": kpis(f"where product_category = '{ONE_CATEGORY}' and region = '{ONE_REGION}'"),
        "promo_vs_nopromo": with_or_without(),
        "promo_vs_nopromo_one_category": with_or_without(
            f"where p.product_category = '{ONE_CATEGORY}' or p.product_category is null"
        ),
        "promo_by_discount": by_discount(),
        "promo_by_discount_one_category": by_discount(f"where p.product_category = '{ONE_CATEGORY}'"),
        "promo_sensitivity": sensitivity,
        "promo_top_lift": f"{sensitivity} order by lift_percentage desc nulls last, category limit 3",
        "promo_low_lift": f"{sensitivity} order by lift_percentage nulls last, category limit 3",
        "promo_roi_category": roi(),
        "promo_roi_category_one_region": roi(f"where p.region = '{ONE_REGION}'"),
        "promo_duration": f"""
            select {days('start_date', 'end_date')} as promo_duration_days, count(*) as promo_count,
                   {r(mean('discount_percentage', None) + ' * 100.0')} as avg_discount,
                   count(distinct product_category) as categories_count from promo group by 1 having count(*) >= 5""",
        "promo_best_discount": f"""
            with ranges as ({by_discount()}),
            plain as (select {mean('t.amount')} as v from tx t
                where not exists (select 1 from promo p where {PROMO_OPEN}))
            select discount_range, nb_transactions, avg_transaction_value, v as avg_value_no_promo,
                   {r('(avg_transaction_value - v) / nullif(v, 0) * 100.0')} as uplift_percentage
            from ranges, plain order by uplift_percentage desc nulls last, discount_range limit 1""",
        "promo_categories": "select distinct product_category from promo",
        "promo_regions": "select distinct region from promo",
    }


def _marketing() -> dict[str, str]:
    rate = f"{r(mean('conversion_rate', None) + ' * 100.0')} as avg_conversion_rate"
    chosen = (
        f"where campaign_type = '{ONE_TYPE}' and target_audience = '{ONE_AUDIENCE}' and region = '{ONE_REGION}'"
    )

    def kpis(where: str = "") -> str:
        return (
            f"select count(distinct campaign_id) as total_campaigns, {total('budget')} as total_budget, "
            f"{big('sum(reach)')} as total_reach, {rate} from camp {where}"
        )

    def all_roi(where: str = "") -> str:
        return f"""
            select c.campaign_id, c.campaign_name, c.campaign_type, c.region, {d('c.budget')} as budget, c.reach,
                   {r(f'{d("c.conversion_rate")} * 100.0')} as conversion_rate_pct,
                   count(distinct t.transaction_id) as transactions_during_campaign,
                   {d('sum(t.amount)')} as revenue_during_campaign,
                   {r(quot('sum(t.amount)', 'c.budget'))} as roi,
                   {r(quot('sum(t.amount)', 'c.reach'), 4)} as revenue_per_reach
            from camp c left join tx t on {CAMP_OPEN} {where}
            group by c.campaign_id, c.campaign_name, c.campaign_type, c.region, c.budget, c.reach,
                     c.conversion_rate, c.start_date, c.end_date"""

    def top(k: int, where: str = "") -> str:
        return f"{all_roi(where)} order by roi desc nulls last, campaign_id limit {k}"

    by_type = f"""
        select campaign_type, count(*) as campaign_count, {total('budget')} as total_budget, {rate},
               {mean('reach', 0)} as avg_reach, {mean('budget')} as avg_budget from camp group by 1"""
    by_audience = f"""
        select target_audience, count(*) as campaign_count, {rate}, {total('budget')} as total_budget,
               {big('sum(reach)')} as total_reach from camp group by 1"""
    return {
        "mkt_kpis": kpis(),
        "mkt_kpis_filtered": kpis(chosen),
        "mkt_campaign_roi": top(20),
        "mkt_campaign_roi_filtered": top(
            20, f"where c.campaign_type = '{ONE_TYPE}' and c.region = '{ONE_REGION}'"
        ),
        "mkt_top15_roi": top(15),
        "mkt_by_type": by_type,
        "mkt_reach_conversion": f"""
            select campaign_name, campaign_type, reach, {r(f'{d("conversion_rate")} * 100.0')} as conversion_rate_pct,
                   {d('budget')} as budget, region from camp order by reach desc nulls last, campaign_id limit 50""",
        "mkt_by_audience": by_audience,
        "mkt_by_region": f"""
            select *, total_revenue / nullif(total_budget, 0) as roi from (
            select c.region, count(distinct c.campaign_id) as campaign_count, {total('c.budget')} as total_budget,
                   {rate}, {big('sum(c.reach)')} as total_reach,
                   count(distinct t.transaction_id) as total_transactions, {total('t.amount')} as total_revenue
            from camp c left join tx t on {CAMP_OPEN} group by 1)""",
        "mkt_by_region_once": f"""
            with b as (select region, count(distinct campaign_id) as campaign_count, {total('budget')} as total_budget,
                    {rate}, {big('sum(reach)')} as total_reach from camp group by 1),
            s as (select c.region, count(distinct t.transaction_id) as n, {total('t.amount')} as total_revenue
                from camp c left join tx t on {CAMP_OPEN} group by 1)
            select b.*, n as total_transactions, total_revenue, total_revenue / nullif(total_budget, 0) as roi
            from b join s on b.region = s.region""",
        "mkt_top_campaigns": f"""
            select campaign_name, campaign_type, budget, reach, conversion_rate_pct,
                   transactions_during_campaign as transactions, revenue_during_campaign as revenue, roi
            from ({top(10)})""",
        "mkt_by_month": f"""
            select {month('start_date')} as month, count(*) as campaign_count, {total('budget')} as monthly_budget,
                   {rate} from camp group by 1""",
        "mkt_best_types": f"{by_type} order by avg_conversion_rate desc nulls last, campaign_type limit 3",
        "mkt_best_audiences": f"{by_audience} order by avg_conversion_rate desc nulls last, target_audience limit 3",
        "mkt_low_roi": f"select * from ({top(20)}) order by roi nulls last, campaign_id limit 3",
        "mkt_types": "select distinct campaign_type from camp",
        "mkt_audiences": "select distinct target_audience from camp",
        "mkt_regions": "select distinct region from camp",
        "mkt_export": top(20),
        "mkt_acquisition_cost": f"""
            with first as (
                select region, entity, transaction_date as day from (
                    select *, row_number() over (partition by entity order by transaction_date, region nulls last) as k
                    from tx where entity is not null and transaction_date is not null) where k = 1)
            select campaign_id, campaign_name, {d('budget')} as budget, count(entity) as new_customers,
                   {r(quot('budget', 'count(entity)'))} as acquisition_cost
            from camp c left join first f on f.region = c.region and day >= start_date and day <= end_date
            group by campaign_id, campaign_name, c.budget""",
        "mkt_budget_revenue_corr": f"""
            select count(*) as campaign_count,
                   {r('corr(budget, revenue_during_campaign)', 6)} as budget_revenue_correlation
            from ({all_roi()})""",
    }


def _gold() -> dict[str, str]:
    return {
        "gold_sales_enriched": "select * exclude (amount_exact) from wide",
        "gold_rfm": "select * from rfm",
        "gold_rfm_segments": f"""
            select rfm_segment, count(*) as customers, {pct('count(*)', 'sum(count(*)) over ()')} as pct_customers,
                   {r('sum(cast(monetary as decimal(28,2)))')} as revenue,
                   {pct('sum(cast(monetary as decimal(28,2)))',
                        'sum(sum(cast(monetary as decimal(28,2)))) over ()')} as pct_revenue
            from rfm group by 1""",
        "gold_clv": f"""
            select customer_id, {d('sum(amount_exact)')} as total_spent, count(*) as purchase_count,
                   {mean('amount_exact')} as avg_purchase,
                   {days('min(transaction_date)', 'max(transaction_date)')} as customer_tenure_days,
                   {d('sum(amount_exact) * 1.5')} as estimated_clv from wide group by 1""",
        "gold_churn": f"""
            select customer_id, max(transaction_date) as last_purchase,
                   {days('max(transaction_date)', TODAY)} as days_since_last_purchase,
                   case when {days('max(transaction_date)', TODAY)} > 90 then 1 else 0 end as is_churned
            from wide group by 1""",
        "gold_client_profile": "select * from profil",
        "gold_enriched_rows": "select * exclude (amount_exact, taux_exact) from enriched",
        "gold_daily_sales": f"select * exclude (ca_exact), {d('ca_exact')} as ca_jour from jours",
        "gold_product_performance": "select * from perf_produits",
        "gold_promotion_analysis": "select * from analyse_promos",
        "gold_campaign_performance": "select * from perf_campagnes",
        "gold_spend_rank": f"""
            with s as (select region, entity, sum(amount) as v from tx group by 1, 2)
            select region, entity as customer_id, {d('v')} as spend,
                   percent_rank() over (partition by region order by v) as percent_rank from s""",
        "gold_spend_quartiles": f"""
            with s as (select entity, sum(amount) as v from tx group by 1)
            select entity as customer_id, {d('v')} as spend, {small('ntile(4) over (order by v, entity)')} as quartile
            from s""",
    }


def _features() -> dict[str, str]:
    def exact(value: str, digits: int = 2) -> str:
        return mean(f"cast({value} as decimal(28,6))", digits)

    def exact_total(value: str) -> str:
        return r(f"sum(cast({value} as decimal(28,6)))")

    def counted(name: str, table: str) -> str:
        return f"select '{labels.CHECK_LABELS[name]}' as info, count(*) as valeur from {table}"

    def flags(table: str, **names: str) -> str:
        return "select " + ", ".join(f"{big(f'sum({c})')} as {n}" for n, c in names.items()) + f" from {table}"

    def first(table: str, *key: str) -> str:
        order = ", ".join(f"{k} nulls last" for k in key)
        return f"select * from {table} order by {order} limit 10"

    def band(table: str, column: str, n: str, extra: str) -> str:
        return f"select {column}, count(*) as {n}, {extra} from {table} group by 1"

    roi = f"{exact('roi_promo_pct')} as roi_moyen"
    croi = f"{exact('roi_pct')} as roi_moyen"
    level = case_of(labels.PROMO_LEVEL, "pct_ventes_avec_promo")
    premium, risk, promo, popular, good_promos, good_campaigns = labels.SUMMARY_METRICS
    return {
        "feat_clients": "select * from f_clients",
        "feat_clients_count": counted("clients", "f_clients"),
        "feat_clients_rfm_dist": """
            select score_rfm_total, count(*) as nb_clients from f_clients group by 1 order by 1 desc limit 15""",
        "feat_clients_rfm_top": f"""
            select rfm_segment, count(*) as nb_clients, {exact('total_depense')} as depense_moy
            from f_clients group by 1 order by nb_clients desc, rfm_segment limit 10""",
        "feat_clients_flags": flags(
            "f_clients", nb_clients_premium="flag_client_premium", nb_clients_risque_churn="flag_risque_churn",
            nb_clients_sensibles_promo="flag_sensible_promo",
        ),
        "feat_clients_age": band("f_clients", "tranche_age", "nb_clients", f"{exact('panier_moyen')} as panier_moy"),
        "feat_clients_preview": first("f_clients", "client"),
        "feat_sales": "select * from f_ventes",
        "feat_sales_count": counted("ventes", "f_ventes"),
        "feat_sales_weekday": band(
            "f_ventes", "jour_semaine", "nb_jours",
            f"{exact('ca_jour')} as ca_moyen_par_jour, {exact_total('ca_jour')} as ca_total",
        ),
        "feat_sales_season": band(
            "f_ventes", "saison", "nb_jours", f"{exact('ca_jour')} as ca_moyen, {exact_total('ca_jour')} as ca_total"
        ),
        "feat_sales_promo_level": f"""
            select {level} as niveau_promo, count(*) as nb_jours, {exact('ca_jour')} as ca_moyen
            from f_ventes group by 1""",
        "feat_sales_spikes": """
            select transaction_date, region, ca_jour, ca_moyenne_7j, ecart_vs_moyenne_7j from f_ventes
            where flag_jour_exceptionnel = 1
            order by ca_jour desc nulls last, transaction_date, region, categorie_promo nulls last limit 20""",
        "feat_sales_preview": first("f_ventes", "transaction_date", "region", "categorie_promo"),
        "feat_products": "select * from f_produits",
        "feat_products_count": counted("produits", "f_produits"),
        "feat_products_popularity": f"""
            select {case_of(labels.POPULARITY, 'score_popularite')} as categorie_popularite, count(*) as nb_produits,
                   {exact('note_moyenne')} as note_moy from f_produits where nb_avis > 0 group by 1""",
        "feat_products_flags": flags(
            "f_produits", nb_populaires="flag_populaire", nb_urgents_reappro="flag_urgent_reappro",
            nb_produits_probleme="flag_probleme", nb_surstock="flag_surstock",
        ),
        "feat_products_action": """
            select product_id, categorie, score_popularite, niveau_stock, flag_urgent_reappro, flag_probleme, alerte
            from f_produits where flag_urgent_reappro + flag_probleme > 0
            order by score_popularite desc nulls last, product_id, region nulls last limit 20""",
        "feat_products_preview": first("f_produits", "product_id", "region"),
        "feat_promos": "select * from f_promos",
        "feat_promos_count": counted("promotions", "f_promos"),
        "feat_promos_discount": band(
            "f_promos", "categorie_reduction", "nb_promos", f"{roi}, {exact('ventes_par_jour')} as ventes_jour_moy"
        ),
        "feat_promos_duration": band(
            "f_promos", "categorie_duree", "nb_promos", f"{roi}, {exact('ca_par_jour')} as ca_jour_moy"
        ),
        "feat_promos_season": band(
            "f_promos", "saison_promo", "nb_promos", f"{roi}, {exact('discount_percentage')} as reduction_moy"
        ),
        "feat_promos_flags": flags(
            "f_promos", nb_promos_reussies="flag_promo_reussie", nb_promos_excellentes="flag_promo_excellente",
            nb_promos_longues="flag_longue_duree", nb_fortes_reductions="flag_forte_reduction",
        ),
        "feat_promos_combos": f"""
            select categorie_reduction, categorie_duree, count(*) as nb_promos, {roi} from f_promos group by 1, 2
            having count(*) >= 3 order by roi_moyen desc nulls last, 1, 2 limit 15""",
        "feat_promos_preview": first("f_promos", "promotion_id"),
        "feat_campaigns": "select * from f_campagnes",
        "feat_campaigns_count": counted("campagnes", "f_campagnes"),
        "feat_campaigns_type": band(
            "f_campagnes", "campaign_type", "nb_campagnes", f"{croi}, {exact('reach_par_euro')} as reach_par_euro_moy"
        ),
        "feat_campaigns_audience": band(
            "f_campagnes", "target_audience", "nb_campagnes",
            f"{croi}, {exact('taux_conversion_reel', 4)} as taux_conv_moy",
        ),
        "feat_campaigns_budget": band(
            "f_campagnes", "categorie_budget", "nb_campagnes",
            f"{croi}, {exact_total('budget')} as budget_total, {exact_total('ca_genere')} as ca_total",
        ),
        "feat_campaigns_season": band("f_campagnes", "saison", "nb_campagnes", croi),
        "feat_campaigns_flags": flags(
            "f_campagnes", nb_campagnes_reussies="flag_campagne_reussie",
            nb_campagnes_excellentes="flag_campagne_excellente", nb_depassent_objectif="flag_depasse_objectif",
            nb_gros_investissements="flag_gros_investissement",
        ),
        "feat_campaigns_combos": f"""
            select campaign_type, target_audience, count(*) as nb_campagnes, {croi} from f_campagnes group by 1, 2
            having count(*) >= 2 order by roi_moyen desc nulls last, 1, 2 limit 15""",
        "feat_campaigns_preview": first("f_campagnes", "campaign_id"),
        "feat_summary": f"""
            select '{premium}' as metric, {d('sum(flag_client_premium)')} as valeur from f_clients
            union all select '{risk}', {d('sum(flag_risque_churn)')} from f_clients
            union all select '{promo}', {d('sum(flag_sensible_promo)')} from f_clients
            union all select '{popular}', {d('sum(flag_populaire)')} from f_produits
            union all select '{good_promos}', {d('sum(flag_promo_reussie)')} from f_promos
            union all select '{good_campaigns}', {d('sum(flag_campagne_reussie)')} from f_campagnes""",
    }


def _bounded(column: str, high: int) -> str:
    return f"case when {column} < 0 then 0 when {column} > {high} then {high} else {column} end"


def _cleaning() -> dict[str, str]:
    age = small(f"year({TODAY}) - year(date_of_birth)")
    length = days("start_date", "end_date")

    def cleaned(name: str, keys: str, latest: str = "", changes: dict | None = None, extra: str = "",
                where: str = "") -> str:
        changes = changes or {}
        columns = bronze_columns(name)
        rest = [c for c in columns if c not in keys.split(", ") and c != latest]
        order = ", ".join(f"{c} desc nulls last" for c in ([latest] if latest else []) + rest)
        picked = ", ".join(f"{changes[c]} as {c}" if c in changes else c for c in columns)
        return f"""
            select {picked}{extra} from (select *, row_number() over (partition by {keys} order by {order}) as version
            from b_{name}) where version = 1 {where}"""

    def trims(*columns: str) -> dict[str, str]:
        return {c: f"trim({c})" for c in columns}

    def profile(name: str) -> str:
        numeric = {
            "amount", "annual_income", "transaction_id", "entity", "customer_id", "promotion_id",
            "discount_percentage", "campaign_id", "budget", "reach", "conversion_rate", "review_id", "product_id",
            "reviewer_id", "rating", "helpful_votes", "total_votes", "current_stock", "reorder_point", "lead_time",
            "shipment_id", "shipping_cost", "supplier_id", "reliability_score", "interaction_id",
            "duration_minutes", "customer_satisfaction", "employee_id", "salary", "store_id", "square_footage",
            "employee_count",
        }
        parts = []
        for c in bronze_columns(name):
            average = mean(c, 4) if c in numeric else "cast(null as double)"
            parts.append(
                f"select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, "
                f"cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value, "
                f"{average} as mean_value from b_{name}"
            )
        return " union all ".join(parts)

    def faults(name: str, **rules: str) -> str:
        return " union all ".join(
            f"select '{rule}' as rule, count(*) filter (where {condition}) as row_count from b_{name}"
            for rule, condition in rules.items()
        )

    email = {"email": "lower(trim(email))"}
    ordered = "and end_date >= start_date"
    out = {
        "clean_financial_transactions": cleaned(
            "tx", "transaction_id", "transaction_date",
            {"amount": "abs(amount)", **trims("region", "payment_method")},
        ),
        "clean_customer_demographics": cleaned(
            "cust0", "customer_id", "", email | trims("name", "gender", "marital_status", "country", "region"),
            f", {age} as age, {case_of(labels.AGE_GROUP, age)} as age_group",
        ),
        "clean_promotions": cleaned(
            "promo", "promotion_id", "start_date",
            {"discount_percentage": f"cast({_bounded('discount_percentage', 1)} as decimal(8,3))",
             **trims("product_category", "promotion_type", "region")},
            f", {length} as duration_days", ordered,
        ),
        "clean_marketing_campaigns": cleaned(
            "camp", "campaign_id", "start_date",
            {"conversion_rate": f"cast({_bounded('conversion_rate', 1)} as decimal(8,4))",
             **trims("campaign_name", "campaign_type", "target_audience", "region")},
            f", {length} as duration_days", ordered,
        ),
        "clean_product_reviews": cleaned("rev", "review_id", "review_date", trims("product_category")),
        "clean_inventory": cleaned(
            "inv", "product_id, trim(warehouse)", "last_restock_date",
            trims("product_category", "region", "country", "warehouse"),
            ", coalesce(current_stock <= reorder_point, false) as needs_reorder", "and (current_stock is null or current_stock >= 0)",
        ),
        "clean_logistics_and_shipping": cleaned(
            "ship", "shipment_id", "ship_date",
            trims("status", "carrier", "shipping_method", "destination_region", "destination_country"),
            f", {days('ship_date', 'estimated_delivery')} as delivery_days",
        ),
        "clean_supplier_information": cleaned(
            "supp", "supplier_id", "", trims("product_category", "region", "quality_rating")
        ),
        "clean_customer_service_interactions": cleaned(
            "serv", "interaction_id", "interaction_date",
            {"customer_satisfaction": _bounded("customer_satisfaction", 5),
             **trims("interaction_type", "issue_category", "resolution_status", "follow_up_required")},
        ),
        "clean_employee_records": cleaned(
            "emp", "employee_id", "hire_date",
            email | {"status": "upper(trim(status))"} | trims("name", "department", "country", "region"),
            f", {age} as age", f"and date_of_birth < hire_date and hire_date <= {TODAY}",
        ),
        "clean_store_locations": cleaned(
            "store", "store_id", "", trims("store_name", "store_type", "country", "region")
        ),
        "faults_financial_transactions": faults("tx", negative_amount="amount < 0"),
        "faults_promotions": faults(
            "promo", discount_out_of_range="discount_percentage < 0 or discount_percentage > 1",
            reversed_period="end_date < start_date", open_period="end_date is null",
        ),
        "faults_marketing_campaigns": faults(
            "camp", conversion_out_of_range="conversion_rate < 0 or conversion_rate > 1",
            reversed_period="end_date < start_date",
        ),
        "faults_inventory": faults("inv", negative_stock="current_stock < 0", unknown_stock="current_stock is null"),
        "faults_customer_service_interactions": faults(
            "serv", satisfaction_out_of_range="customer_satisfaction < 0 or customer_satisfaction > 5"
        ),
        "faults_employee_records": faults(
            "emp", hired_before_birth="date_of_birth >= hire_date", unknown_birth="date_of_birth is null"
        ),
        "csv_transactions": f"select * replace ({d('amount')} as amount) from b_tx",
        "csv_customers": f"select * replace ({d('annual_income')} as annual_income) from b_cust0",
        "csv_reordered": f"select * replace ({d('amount')} as amount) from b_tx",
        "csv_surplus_columns": f"select *  replace ({d('amount')} as amount), 'EUR' as currency from b_tx",
        "csv_quoted": """
            select customer_id, concat('"', trim(name), '", or', chr(10), cast(customer_id as varchar)) as name
            from b_cust0""",
        "table_round_trip": "select transaction_id, region, transaction_date from tx",
        "table_partitioned": "select transaction_id, region, transaction_date from tx",
        "json_array_stores": "select store_id, store_name, region from b_store",
        "json_nested": "select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k from events",
        "tsv_reviews": "select * from b_rev",
        "distribution_status": f"""
            select status as value, count(*) as row_count, {pct('count(*)', 'sum(count(*)) over ()')} as percentage
            from ship group by 1""",
        "duplicates_transactions": """
            select copies, count(*) as key_count from
            (select transaction_id, count(*) as copies from b_tx group by 1) group by 1""",
        "load_counts": " union all ".join(
            f"select '{t}' as table_name, count(*) as row_count from {t}" for t in RAW_TABLES
        ),
        "json_fields": """
            select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k,
                   json_extract_string(props, '$.a.b[0]') as missing from events""",
    }
    for name, table in SHORT.items():
        out[f"profile_{table}"] = profile(name)
    kinds = {"transaction_id": "bigint", "transaction_date": "date", "amount": "decimal(14,2)", "online": "boolean"}
    bad = {c: f"{c} is not null and try_cast({c} as {k}) is null" for c, k in kinds.items()}
    any_bad = " or ".join(f"({b})" for b in bad.values())
    named = ", ".join(f"case when {b} then '{c}' end" for c, b in bad.items())
    out["typed_transactions"] = f"""
        select cast(transaction_id as bigint) as transaction_id, cast(transaction_date as date) as transaction_date,
               cast(cast(amount as decimal(14,2)) as double) as amount, cast(online as boolean) as online
        from raw_text where not ({any_bad})"""
    out["cleaned_promo_by_discount"] = f"""
        select {case_of(labels.DISCOUNT_RANGE, 'p.discount_percentage * 100')} as discount_range,
               count(*) as nb_transactions, {total('t.amount')} as total_revenue,
               {mean('t.amount')} as avg_transaction_value, {mean('p.discount_percentage * 100')} as avg_discount_pct
        from tx t join ({out["clean_promotions"]}) p on {PROMO_OPEN} group by 1"""
    out["ingest_rejects"] = f"select *, concat_ws(',', {named}) as faults from raw_text where {any_bad}"
    out["json_rejects"] = out["ingest_rejects"]
    refusals = {
        "promotions": ("promo", "promotion_id", "start_date", {"reversed_or_open_period": ordered}),
        "marketing_campaigns": ("camp", "campaign_id", "start_date", {"reversed_or_open_period": ordered}),
        "inventory": (
            "inv", "product_id, trim(warehouse)", "last_restock_date",
            {"negative_stock": "and (current_stock is null or current_stock >= 0)"},
        ),
        "employee_records": (
            "emp", "employee_id", "hire_date",
            {"hired_before_birth": "and date_of_birth < hire_date", "hired_in_the_future": f"and hire_date <= {TODAY}"},
        ),
    }
    for table, (short, keys, latest, rules) in refusals.items():
        tests = [f"case when ({rule.removeprefix('and ')}) is not true then '{name}' end" for name, rule in rules.items()]
        why = f", concat_ws(',', {', '.join(tests)}) as refused_by"
        rows = cleaned(short, keys, latest, trims("warehouse") if short == "inv" else {}, why)
        out[f"quarantine_{table}"] = f"select * from ({rows}) where refused_by <> ''"
    out["rejected_transactions"] = f"select *, concat_ws(',', {named}) as faults from raw_text where {any_bad}"
    return out


def _filtered(out: dict[str, str]) -> dict[str, str]:
    """Reports over a part of their table: the same SQL over the rows of one region or type."""

    def part(name: str, table: str, condition: str) -> str:
        return re.sub(rf"\b{table}\b", f"(select * from {table} where {condition})", out[name])

    region, kind = f"region = '{ONE_REGION}'", f"campaign_type = '{ONE_TYPE}'"
    found = {
        f"{name}_one_region": part(name, "tx", region)
        for name in ("sales_by_quarter", "sales_by_year", "sales_by_month_name")
    }
    found |= {
        f"{name}_one_region": part(name, "camp", region)
        for name in ("mkt_by_type", "mkt_reach_conversion", "mkt_by_audience", "mkt_top_campaigns", "mkt_by_month")
    }
    return found | {"mkt_by_region_one_type": part("mkt_by_region", "camp", kind)}


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (
        _sales, _products, _logistics, _experience, _customers, _promotions, _marketing, _gold, _features, _cleaning
    ):
        out |= part()
    out |= _filtered(out)
    return {name: with_inputs(body.strip()) for name, body in out.items()}

