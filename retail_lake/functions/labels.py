"""Labels and cuts that results must show exactly."""

from retail_lake.functions.bands import Bands, atleast, below, upto, within

# --- fixed values -----------------------------------------------------------

# customers
AGE_GROUP = Bands(
    (
        below(18, "Minor"),
        within(18, 25, "18-25"),
        within(26, 35, "26-35"),
        within(36, 50, "36-50"),
        within(51, 65, "51-65"),
    ),
    "65+",
)
AGE_BAND = Bands(
    (below(25, "18-25"), within(25, 35, "25-35"), within(36, 50, "36-50"), within(51, 65, "51-65")),
    "65+",
)
AGE_SEGMENT = Bands(
    (below(25, "Young"), within(25, 45, "Adult"), within(46, 65, "Middle-aged")), "Senior"
)
INCOME_BRACKET = Bands(
    (
        below(20000, "< 20K"),
        within(20000, 40000, "20K-40K"),
        within(40001, 60000, "40K-60K"),
        within(60001, 80000, "60K-80K"),
        within(80001, 100000, "80K-100K"),
    ),
    "> 100K",
)
INCOME_SEGMENT = Bands((below(40000, "Low"), within(40000, 80000, "Medium")), "High")
INCOME_BAND = Bands((below(30000, "Bas"), within(30000, 70000, "Moyen")), "Élevé")
BUYING_TREND = Bands((upto(90, "Actif récent"), within(91, 180, "Ralenti")), "Inactif")
ACTIVITY_SEGMENT = Bands((upto(90, "Actif"), upto(180, "A risque"), upto(365, "Inactif")), "Perdu")
VALUE_SEGMENT = Bands(
    (atleast(30000, "VIP"), atleast(15000, "Gros client"), atleast(5000, "Client moyen")),
    "Petit client",
)
VALUE_SEGMENT_CODE = {"VIP": 4, "Gros client": 3, "Client moyen": 2, "Petit client": 1}
ACTIVITY_SEGMENT_CODE = {"Actif": 4, "A risque": 3, "Inactif": 2, "Perdu": 1}
PREMIUM_SPEND, PREMIUM_PURCHASES = 30000, 15
CHURN_DAYS, CHURN_PURCHASES = 90, 3
PROMO_SENSITIVE_PCT = 50
CLV_RETENTION = "1.5"

# calendar
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SEASON_MONTHS = {"Hiver": (12, 1, 2), "Printemps": (3, 4, 5), "Été": (6, 7, 8)}
SEASON_ELSE = "Automne"
SEASONS = (*SEASON_MONTHS, SEASON_ELSE)
MONTH_PART = Bands((upto(10, "Début"), upto(20, "Milieu")), "Fin")
SPIKE_FACTOR = 1.5

# products and stock
RATING_BUCKET = Bands(
    (atleast(4.5, "4.5-5 (Excellent)"), atleast(4.0, "4.0-4.5 (Bon)"), atleast(3.0, "3.0-4.0 (Moyen)")),
    "< 3.0 (Faible)",
)
LOW_STOCK, NORMAL_STOCK, HIGH_STOCK = "Low stock", "Normal stock", "High stock"
STOCK_RISK, STOCK_LOW, STOCK_OK = "⚠️ Risque rupture", "⚡ Stock faible", "✅ Stock OK"
QUALITY_LABELS = ("Excellent produit", "Bon produit", "Problème qualité", "Produit moyen")
QUALITY_CODE = {"Excellent produit": 4, "Bon produit": 3, "Problème qualité": 1}
QUALITY_CODE_ELSE = 2
STOCK_LEVELS = ("RUPTURE", "Stock faible", "Stock correct", "Stock élevé")
STOCK_LEVEL_CODE = {"RUPTURE": 0, "Stock faible": 1, "Stock correct": 2, "Stock élevé": 3}
ALERTS = ("Réapprovisionnement urgent", "Problème qualité", "Surstock", "OK")
POPULARITY = Bands(
    (
        atleast(100, "Très populaire"),
        atleast(50, "Populaire"),
        atleast(20, "Moyennement populaire"),
    ),
    "Peu populaire",
)

# shipping
DELIVERY_SPEED = Bands(
    (
        upto(2, "Express (≤2 jours)"),
        within(3, 5, "Standard (3-5 jours)"),
        within(6, 10, "Économique (6-10 jours)"),
    ),
    "Lent (>10 jours)",
)

# promotions
WITH_PROMO, WITHOUT_PROMO = "Avec promotion", "Sans promotion"
DISCOUNT_RANGE = Bands(
    (
        below(10, "< 10%"),
        within(10, 20, "10-20%"),
        within(21, 30, "21-30%"),
        within(31, 50, "31-50%"),
    ),
    "> 50%",
)
DISCOUNT_BAND = Bands(
    (
        below(10, "Faible (<10%)"),
        within(10, 20, "Moyenne (10-20%)"),
        within(21, 30, "Forte (21-30%)"),
    ),
    "Très forte (>30%)",
)
DURATION_BAND = Bands(
    (
        upto(7, "Courte (≤7j)"),
        within(8, 14, "Moyenne (8-14j)"),
        within(15, 30, "Longue (15-30j)"),
    ),
    "Très longue (>30j)",
)
SENSITIVITY = ("Très sensible", "Sensible", "Neutre", "Peu sensible")
PROMO_LEVEL = Bands((atleast(50, "Beaucoup de promos"), atleast(20, "Promos moyennes")), "Peu de promos")
PROMO_STATUS = ("Excellente", "Réussie", "Standard", "Sans vente")
YES, NO = "Oui", "Non"

# campaigns
BUDGET_BAND = Bands((below(100000, "Petit budget"), within(100000, 300000, "Budget moyen")), "Gros budget")
REACH_BAND = Bands((below(300000, "Faible reach"), within(300000, 700000, "Reach moyen")), "Fort reach")
CAMPAIGN_STATUS = ("Excellente", "Réussie", "Standard", "N/A")

# RFM
RFM_SEGMENTS = ("Champions", "Loyal Customers", "Promising", "At Risk", "Needs Attention")

# summary of the feature tables
SUMMARY_METRICS = (
    "Clients premium",
    "Clients à risque de churn",
    "Clients sensibles aux promos",
    "Produits populaires",
    "Promos réussies",
    "Campagnes réussies",
)
CHECK_LABELS = {
    "clients": "Nombre de clients avec features",
    "ventes": "Nombre de jours avec ventes",
    "produits": "Nombre de produits avec features",
    "promotions": "Nombre de promos avec features",
    "campagnes": "Nombre de campagnes avec features",
}
