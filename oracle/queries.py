"""DuckDB oracle SQL per query name (same column names as the Spark results)."""

from __future__ import annotations

from .fixture import mean_money, money_sum, rr, sum_money, with_fixture

BODIES: dict[str, str] = {}

BODIES["kpis"] = f"""
SELECT CAST(count(*) AS BIGINT) AS total_customers,
  CAST(coalesce(sum(Churn), 0) AS BIGINT) AS churn_count,
  {rr("coalesce(sum(Churn), 0) * 100", "count(*)", 2)} AS churn_rate,
  {mean_money("MonthlyCharges")} AS arpu,
  {mean_money("TotalCharges")} AS clv,
  CAST(count(*) - coalesce(sum(Churn), 0) AS BIGINT) AS active_customers
FROM subs
"""

BODIES["churn_rate"] = f"""
SELECT CAST(sum(Churn) AS DOUBLE) / CAST(count(Churn) AS DOUBLE) * 100 AS churn_rate,
  {rr("sum(Churn) * 100", "count(Churn)", 2)} AS churn_rate_2dp
FROM subs
"""


BODIES["churn_by_tenure"] = f"""
, b AS (
  SELECT CASE WHEN tenure > 0 AND tenure <= 6 THEN 1 WHEN tenure > 6 AND tenure <= 12 THEN 2
              WHEN tenure > 12 AND tenure <= 24 THEN 3 WHEN tenure > 24 AND tenure <= 36 THEN 4
              WHEN tenure > 36 AND tenure <= 48 THEN 5 WHEN tenure > 48 AND tenure <= 60 THEN 6
              WHEN tenure > 60 AND tenure <= 72 THEN 7 END AS ordinal, Churn, customerID
  FROM subs)
SELECT (['0-6','7-12','13-24','25-36','37-48','49-60','61-72'])[ordinal] AS tenure_band,
  CAST(ordinal AS INTEGER) AS ordinal,
  {rr("sum(Churn) * 100", "count(Churn)", 2)} AS churn_rate,
  CAST(count(customerID) AS BIGINT) AS customers
FROM b WHERE ordinal IS NOT NULL GROUP BY ordinal
"""

BODIES["revenue_by_band"] = f"""
, b AS (
  SELECT CASE WHEN MonthlyCharges > 0 AND MonthlyCharges <= 30 THEN 1
              WHEN MonthlyCharges > 30 AND MonthlyCharges <= 50 THEN 2
              WHEN MonthlyCharges > 50 AND MonthlyCharges <= 70 THEN 3
              WHEN MonthlyCharges > 70 AND MonthlyCharges <= 90 THEN 4
              WHEN MonthlyCharges > 90 AND MonthlyCharges <= 120 THEN 5 END AS ordinal,
         TotalCharges, customerID
  FROM subs)
SELECT (['Basic','Standard','Plus','Premium','Enterprise'])[ordinal] AS segment,
  CAST(ordinal AS INTEGER) AS ordinal,
  {sum_money("TotalCharges")} AS revenue,
  CAST(count(customerID) AS BIGINT) AS customers
FROM b WHERE ordinal IS NOT NULL GROUP BY ordinal
"""

BODIES["retention_by_offer"] = f"""
SELECT Contract AS offer,
  {rr("(count(Churn) - sum(Churn)) * 100", "count(Churn)", 2)} AS retention_rate,
  CAST(count(customerID) AS BIGINT) AS customers
FROM subs WHERE Contract IS NOT NULL GROUP BY Contract
"""

_REASONS = f"""
, churned AS (SELECT Contract, InternetService FROM subs WHERE Churn = 1),
cnt AS (
  SELECT 'Contract' AS category, Contract AS value, count(*) AS n FROM churned
  WHERE Contract IS NOT NULL GROUP BY Contract
  UNION ALL
  SELECT 'Service' AS category, InternetService AS value, count(*) AS n FROM churned
  WHERE InternetService IS NOT NULL GROUP BY InternetService),
tot AS (SELECT category, sum(n) AS t FROM cnt GROUP BY category),
sh AS (SELECT cnt.category, value, n, {rr("n * 100", "t", 1)} AS percentage
       FROM cnt JOIN tot ON cnt.category = tot.category),
kept AS (
  SELECT CASE WHEN category = 'Contract' THEN 'Contrat ' ELSE 'Internet ' END || value AS reason,
         category, percentage, n
  FROM sh WHERE NOT (category = 'Service' AND value = 'No')),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY percentage DESC,
           CASE WHEN category = 'Contract' THEN 0 ELSE 1 END, n DESC, reason) AS INTEGER) AS rank,
         reason, category, percentage, CAST(n AS BIGINT) AS customers
  FROM kept)
SELECT * FROM ranked WHERE rank <= {{k}}
"""
BODIES["churn_reasons"] = _REASONS.replace("{k}", "10")
BODIES["churn_reasons_top5"] = _REASONS.replace("{k}", "5")

BODIES["segments"] = f"""
, c AS (
  SELECT count(*) AS total,
    count_if(MonthlyCharges > 90 AND tenure > 24) AS c1,
    count_if(InternetService = 'Fiber optic') AS c2,
    count_if(InternetService = 'No' AND PhoneService = 'Yes') AS c3,
    count_if(MonthlyCharges < 40) AS c4,
    count_if(Contract = 'Month-to-month' AND tenure < 12) AS c5,
    count_if(Contract IN ('One year', 'Two year') AND tenure > 36) AS c6
  FROM subs),
seg AS (SELECT * FROM (VALUES
  (1, 'Premium Users', '#2563eb', 'ARPU > 90€ | Ancienneté > 24 mois | Services multiples | Faible taux de churn',
      'Programme VIP exclusif | Offres early access | Support prioritaire'),
  (2, 'Heavy Data Users', '#10b981', 'Abonnement Fibre | Streaming actif | Usage data élevé | Sensible à la vitesse',
      'Upgrade vers fibre premium | Bundle streaming | Garantie de débit'),
  (3, 'Voice Only', '#f59e0b', 'Téléphone uniquement | Pas d''internet | Usage traditionnel | Profil senior',
      'Offre internet simplifiée | Formation digitale | Tarifs voix avantageux'),
  (4, 'Low ARPU', '#8b5cf6', 'ARPU < 40€ | Services basiques | Sensible au prix | Potentiel d''upsell',
      'Offres bundle attractives | Promotions ciblées | Montée en gamme progressive'),
  (5, 'At-Risk', '#ef4444', 'Contrat mensuel | Ancienneté < 12 mois | Pas d''engagement | Risque de churn élevé',
      'Programme de rétention | Offre d''engagement | Appel proactif | Remise fidélité'),
  (6, 'Loyal Base', '#06b6d4', 'Contrat long terme | Ancienneté > 3 ans | Faible churn | Ambassadeurs potentiels',
      'Programme parrainage | Récompenses fidélité | Renouvellement anticipé')
  ) t(ordinal, name, color, characteristics, actions)),
j AS (
  SELECT seg.*, total,
    CAST(CASE ordinal WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 WHEN 4 THEN c4
                      WHEN 5 THEN c5 ELSE c6 END AS BIGINT) AS count
  FROM seg CROSS JOIN c)
SELECT CAST(ordinal AS INTEGER) AS ordinal, name, count, {rr("count * 100", "total", 1)} AS percentage,
  color, characteristics, actions
FROM j
"""

BODIES["segment_members"] = """
SELECT customerID, 1 AS ordinal, 'Premium Users' AS segment FROM subs WHERE MonthlyCharges > 90 AND tenure > 24
UNION ALL SELECT customerID, 2, 'Heavy Data Users' FROM subs WHERE InternetService = 'Fiber optic'
UNION ALL SELECT customerID, 3, 'Voice Only' FROM subs WHERE InternetService = 'No' AND PhoneService = 'Yes'
UNION ALL SELECT customerID, 4, 'Low ARPU' FROM subs WHERE MonthlyCharges < 40
UNION ALL SELECT customerID, 5, 'At-Risk' FROM subs WHERE Contract = 'Month-to-month' AND tenure < 12
UNION ALL SELECT customerID, 6, 'Loyal Base' FROM subs WHERE Contract IN ('One year', 'Two year') AND tenure > 36
"""

_OVERVIEW = f"""
SELECT CAST(count(*) AS BIGINT) AS total_customers,
  CAST(coalesce(sum(Churn), 0) AS BIGINT) AS churned_customers,
  CAST(count(*) - coalesce(sum(Churn), 0) AS BIGINT) AS active_customers,
  coalesce({rr("coalesce(sum(Churn), 0) * 100", "count(*)", 2)}, 0.0) AS churn_rate,
  {rr("sum(tenure)", "count(tenure)", 1)} AS average_tenure,
  {mean_money("MonthlyCharges")} AS average_monthly_charges,
  {sum_money("TotalCharges")} AS total_revenue,
  coalesce({rr(money_sum("TotalCharges"), "10000000000000000", 1)}, 0.0) AS total_revenue_millions
FROM {{src}}
"""
BODIES["overview"] = _OVERVIEW.replace("{src}", "subs")
BODIES["overview_active"] = _OVERVIEW.replace("{src}", "subs WHERE Churn = 0")
BODIES["overview_churned"] = _OVERVIEW.replace("{src}", "subs WHERE Churn = 1")
BODIES["overview_filtered"] = _OVERVIEW.replace(
    "{src}", "subs JOIN subs_dim USING (customerID) WHERE region = 'EUROPE' "
             "AND signup_date BETWEEN DATE '1995-03-01' AND DATE '1995-12-31'")

BODIES["distributions"] = """
, vc AS (
  SELECT 'Contract' AS dimension, Contract AS key, count(*) AS n FROM subs WHERE Contract IS NOT NULL GROUP BY Contract
  UNION ALL
  SELECT 'InternetService', InternetService, count(*) FROM subs WHERE InternetService IS NOT NULL GROUP BY InternetService
  UNION ALL
  SELECT 'PaymentMethod', PaymentMethod, count(*) FROM subs WHERE PaymentMethod IS NOT NULL GROUP BY PaymentMethod)
SELECT dimension, key, CAST(n AS BIGINT) AS customers,
  CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS INTEGER) AS rank
FROM vc
"""

BODIES["contract_counts"] = """
, vc AS (SELECT Contract, count(*) AS n FROM subs WHERE Contract IS NOT NULL GROUP BY Contract)
SELECT Contract AS contract, CAST(n AS BIGINT) AS customers,
  CAST(row_number() OVER (ORDER BY n DESC, Contract) AS INTEGER) AS rank
FROM vc
"""


BODIES["score_requests"] = "SELECT * FROM score_requests"

_VALID = """
, v AS (
  SELECT * FROM score_requests
  WHERE tenure IS NOT NULL AND voice_usage IS NOT NULL AND NOT isnan(voice_usage) AND voice_usage > 0
    AND data_usage IS NOT NULL AND NOT isnan(data_usage) AND data_usage > 0
    AND complaints IS NOT NULL AND complaints >= 0 AND contract_type IS NOT NULL),
p AS (
  SELECT customerID, tenure, complaints, contract_type, data_usage,
    coalesce(monthly_charges, 50.0) AS mc, coalesce(internet_service, 'Fiber optic') AS inet,
    coalesce(online_security, 'No') AS sec, coalesce(tech_support, 'No') AS sup,
    CASE WHEN tenure < 6 THEN 30 WHEN tenure < 12 THEN 20 WHEN tenure < 24 THEN 10 ELSE 0 END
    + CASE WHEN complaints >= 3 THEN 25 WHEN complaints >= 1 THEN 15 ELSE 0 END
    + CASE WHEN lower(contract_type) = 'prepaid' THEN 20 ELSE 5 END
    + CASE WHEN coalesce(monthly_charges, 50.0) > 80 THEN 10 ELSE 0 END
    + CASE WHEN data_usage < 2.0 THEN 15 ELSE 0 END
    + CASE WHEN coalesce(internet_service, 'Fiber optic') = 'Fiber optic' THEN 10 ELSE 0 END
    + CASE WHEN coalesce(online_security, 'No') = 'No' AND coalesce(tech_support, 'No') = 'No'
           THEN 10 ELSE 0 END AS raw_score
  FROM v)
"""

BODIES["score_batch"] = _VALID + """
SELECT customerID, CAST(raw_score AS INTEGER) AS raw_score, CAST(least(raw_score, 100) AS INTEGER) AS score,
  CAST(least(raw_score, 100) AS DOUBLE) / 100 AS probability,
  CASE WHEN least(raw_score, 100) >= 70 THEN 'Élevé' WHEN least(raw_score, 100) >= 40 THEN 'Moyen'
       ELSE 'Faible' END AS risk_level
FROM p
"""

BODIES["score_factors"] = _VALID + """
, f AS (
  SELECT customerID, 1 AS o, 'tenure' AS factor, CAST(tenure AS VARCHAR) AS value,
    CASE WHEN tenure < 6 THEN 'high' WHEN tenure < 12 THEN 'medium' WHEN tenure < 24 THEN 'low' ELSE 'positive' END AS impact,
    CASE WHEN tenure < 6 THEN 'Client nouveau (< 6 mois)' WHEN tenure < 12 THEN 'Client récent (6-12 mois)'
         WHEN tenure < 24 THEN 'Client établi (1-2 ans)' ELSE 'Client fidèle (> 2 ans)' END AS message,
    CASE WHEN tenure < 6 THEN 30 WHEN tenure < 12 THEN 20 WHEN tenure < 24 THEN 10 ELSE 0 END AS points
  FROM p
  UNION ALL
  SELECT customerID, 2, 'complaints', CAST(complaints AS VARCHAR),
    CASE WHEN complaints >= 3 THEN 'high' WHEN complaints >= 1 THEN 'medium' ELSE 'positive' END,
    CASE WHEN complaints >= 3 THEN 'Nombreuses réclamations' WHEN complaints >= 1 THEN 'Quelques réclamations'
         ELSE 'Aucune réclamation' END,
    CASE WHEN complaints >= 3 THEN 25 WHEN complaints >= 1 THEN 15 ELSE 0 END
  FROM p
  UNION ALL
  SELECT customerID, 3, 'contract', contract_type,
    CASE WHEN lower(contract_type) = 'prepaid' THEN 'high' ELSE 'low' END,
    CASE WHEN lower(contract_type) = 'prepaid' THEN 'Contrat prépayé (sans engagement)' ELSE 'Contrat postpayé' END,
    CASE WHEN lower(contract_type) = 'prepaid' THEN 20 ELSE 5 END
  FROM p
  UNION ALL
  SELECT customerID, 4, 'charges', printf('%.2f', mc), 'medium', 'Facture élevée', 10 FROM p WHERE mc > 80
  UNION ALL
  SELECT customerID, 5, 'data_usage', printf('%.2f', data_usage), 'medium', 'Faible consommation data', 15
  FROM p WHERE data_usage < 2.0
  UNION ALL
  SELECT customerID, 6, 'internet', inet, 'medium', 'Fibre optique (plus volatile)', 10 FROM p WHERE inet = 'Fiber optic'
  UNION ALL
  SELECT customerID, 7, 'services', 'Aucun service additionnel', 'medium', 'Pas de services de sécurité', 10
  FROM p WHERE sec = 'No' AND sup = 'No')
SELECT customerID, CAST(row_number() OVER (PARTITION BY customerID ORDER BY o) AS INTEGER) AS position,
  factor, value, impact, message, CAST(points AS INTEGER) AS points
FROM f
"""

BODIES["score_recommendations"] = _VALID + """
, r AS (
  SELECT customerID, 1 AS o, 'Programme d''onboarding personnalisé pour les nouveaux clients' AS text FROM p WHERE tenure < 12
  UNION ALL SELECT customerID, 2, 'Contacter le client pour résoudre les problèmes signalés' FROM p WHERE complaints >= 1
  UNION ALL SELECT customerID, 3, 'Proposer une offre d''engagement avec avantages' FROM p WHERE lower(contract_type) = 'prepaid'
  UNION ALL SELECT customerID, 4, 'Offrir une réduction ou un upgrade de services' FROM p WHERE mc > 80
  UNION ALL SELECT customerID, 5, 'Proposer des forfaits adaptés à l''usage' FROM p WHERE data_usage < 2.0
  UNION ALL SELECT customerID, 6, 'Offrir un essai gratuit des services premium' FROM p WHERE sec = 'No' AND sup = 'No'),
none AS (SELECT customerID FROM p WHERE customerID NOT IN (SELECT customerID FROM r)),
allr AS (
  SELECT * FROM r
  UNION ALL SELECT customerID, 7, 'Maintenir la relation client avec des communications régulières' FROM none
  UNION ALL SELECT customerID, 8, 'Proposer le programme de fidélité' FROM none)
SELECT customerID, CAST(row_number() OVER (PARTITION BY customerID ORDER BY o) AS INTEGER) AS position, text
FROM allr
"""

BODIES["score_rejects"] = """
SELECT customerID,
  CASE WHEN tenure IS NULL THEN 'tenure: missing'
       WHEN voice_usage IS NULL THEN 'voice_usage: missing'
       WHEN isnan(voice_usage) OR NOT voice_usage > 0 THEN 'voice_usage: must be > 0'
       WHEN data_usage IS NULL THEN 'data_usage: missing'
       WHEN isnan(data_usage) OR NOT data_usage > 0 THEN 'data_usage: must be > 0'
       WHEN complaints IS NULL THEN 'complaints: missing'
       WHEN NOT complaints >= 0 THEN 'complaints: must be >= 0'
       WHEN contract_type IS NULL THEN 'contract_type: missing' END AS reason
FROM score_requests
WHERE tenure IS NULL OR voice_usage IS NULL OR isnan(voice_usage) OR NOT voice_usage > 0
   OR data_usage IS NULL OR isnan(data_usage) OR NOT data_usage > 0
   OR complaints IS NULL OR NOT complaints >= 0 OR contract_type IS NULL
"""


_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
         "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
         "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
         "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn"]
_TYPES = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}

BODIES["clean_zero"] = "SELECT * FROM subs"

_MEDIAN = """
, parsed AS (SELECT *, try_cast(TotalCharges AS DOUBLE) AS tc FROM raw),
med AS (SELECT CAST(median(CAST(tc AS DECIMAL(28,10))) AS DOUBLE) AS m FROM parsed),
wh AS (
  SELECT gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines, InternetService,
    OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies, Contract,
    PaperlessBilling, PaymentMethod, MonthlyCharges, coalesce(tc, m) AS TotalCharges,
    CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INT) AS Churn
  FROM parsed CROSS JOIN med)
"""
BODIES["clean_median"] = _MEDIAN + "SELECT * FROM wh"
BODIES["churned_customers"] = _MEDIAN + "SELECT * FROM wh WHERE Churn = 1"

BODIES["head"] = "SELECT * FROM subs ORDER BY customerID LIMIT 5"

BODIES["structure_profile"] = "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{_TYPES.get(c, 'string')}' AS data_type, "
    f"CAST(count({c}) AS BIGINT) AS non_null_count, CAST(count(*) AS BIGINT) AS total_rows FROM raw"
    for i, c in enumerate(_COLS, start=1))

BODIES["null_profile"] = "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{_TYPES.get(c, 'string')}' AS data_type, "
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM raw"
    for i, c in enumerate(_COLS, start=1))

BODIES["charge_histogram"] = """
, v AS (SELECT CAST(round(MonthlyCharges * 100) AS BIGINT) AS c FROM subs WHERE MonthlyCharges IS NOT NULL),
st AS (
  SELECT CASE WHEN min(c) = max(c) THEN min(c) - 50 ELSE min(c) END AS lo,
         CASE WHEN min(c) = max(c) THEN max(c) + 50 ELSE max(c) END AS hi
  FROM v),
cnt AS (
  SELECT CAST(least((c - lo) * 30 // (hi - lo), 29) AS INTEGER) AS bin, count(*) AS n
  FROM v CROSS JOIN st GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin, CAST(lo * 30 + g.bin * (hi - lo) AS DOUBLE) / 3000 AS bin_start,
  CAST(lo * 30 + (g.bin + 1) * (hi - lo) AS DOUBLE) / 3000 AS bin_end,
  CAST(coalesce(n, 0) AS BIGINT) AS count
FROM g CROSS JOIN st LEFT JOIN cnt ON g.bin = cnt.bin
"""

BODIES["charge_kde"] = """
, st AS (
  SELECT count(MonthlyCharges) AS n, min(MonthlyCharges) AS lo, max(MonthlyCharges) AS hi,
         stddev_samp(MonthlyCharges) * pow(CAST(count(MonthlyCharges) AS DOUBLE), -0.2) AS h
  FROM subs),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(200)),
s AS (
  SELECT g.point, sum(exp(-0.5 * ((st.lo + g.point * ((st.hi - st.lo) / 199) - MonthlyCharges) / st.h)
                        * ((st.lo + g.point * ((st.hi - st.lo) / 199) - MonthlyCharges) / st.h))) AS s
  FROM subs CROSS JOIN st CROSS JOIN g WHERE MonthlyCharges IS NOT NULL GROUP BY g.point)
SELECT s.point, lo + s.point * ((hi - lo) / 199) AS x,
  CAST(round(CAST(s / (n * h * sqrt(2 * pi())) AS DECIMAL(38,18)), 10) AS DOUBLE) AS density,
  CAST(round(CAST(s / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 30 AS DECIMAL(38,18)), 6) AS DOUBLE) AS count_density
FROM s CROSS JOIN st
"""


_TRENDS = f"""
, osnap AS (SELECT max(o_orderdate) AS snap FROM orders),
pc AS (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
       FROM orders GROUP BY o_custkey),
rev AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               {money_sum("o_totalprice")} AS rc
        FROM orders GROUP BY 1),
nw AS (SELECT CAST(date_trunc('month', first_order) AS DATE) AS month, count(*) AS n FROM pc GROUP BY 1),
ch AS (SELECT CAST(date_trunc('month', last_order) AS DATE) AS month, count(*) AS n
       FROM pc CROSS JOIN osnap WHERE last_order < snap - INTERVAL 290 DAY GROUP BY 1),
m AS (SELECT CAST(unnest(range((SELECT min(month) FROM rev), (SELECT max(month) FROM rev) + INTERVAL 1 MONTH,
                              INTERVAL 1 MONTH)) AS DATE) AS month),
j AS (SELECT m.month, coalesce(rev.rc, 0) AS rc, coalesce(nw.n, 0) AS nnew, coalesce(ch.n, 0) AS nch
      FROM m LEFT JOIN rev ON m.month = rev.month LEFT JOIN nw ON m.month = nw.month
      LEFT JOIN ch ON m.month = ch.month),
w AS (SELECT *, sum(nnew) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)
        - coalesce(sum(nch) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
      FROM j),
tr AS (
  SELECT month, CAST(nnew AS BIGINT) AS new_customers, CAST(nch AS BIGINT) AS churned_customers,
    CAST(base AS BIGINT) AS base_customers, {rr("rc", "10000000000", 2)} AS revenue,
    {rr("nch * 100", "base", 2)} AS churn_rate, rc // 100000000 AS rc
  FROM w)
"""
BODIES["monthly_trends"] = _TRENDS + """
SELECT month, new_customers, churned_customers, base_customers, revenue, churn_rate FROM tr
"""
BODIES["kpi_monthly_delta"] = _TRENDS + f"""
, lg AS (
  SELECT *, lag(rc) OVER (ORDER BY month) AS prev_rc, lag(new_customers) OVER (ORDER BY month) AS prev_new,
    lag(CAST(round(churn_rate * 100) AS BIGINT)) OVER (ORDER BY month) AS prev_rate
  FROM tr)
SELECT month, revenue, {rr("(rc - prev_rc) * 100", "prev_rc", 1)} AS revenue_change_pct,
  new_customers, new_customers - prev_new AS new_customers_delta, churn_rate,
  CAST(CAST(round(churn_rate * 100) AS BIGINT) - prev_rate AS DOUBLE) / 100 AS churn_rate_delta
FROM lg
"""


BODIES["csv_roundtrip"] = "SELECT * FROM subs"
BODIES["store_roundtrip"] = "SELECT * FROM subs"
BODIES["warehouse_append"] = BODIES["clean_median"]
BODIES["score_stream"] = BODIES["score_batch"]


def _sub(body: str) -> str:
    body = body.strip()
    return f"(WITH {body[1:]})" if body.startswith(",") else f"({body})"


BODIES["report_summary"] = f"""
, k AS {_sub(BODIES["kpis"])}
SELECT total_customers, churn_rate, arpu,
  'Ce rapport présente une analyse complète de la base clients télécom avec ' || format('{{:,}}', total_customers)
  || ' clients. Le taux de churn actuel est de ' || CAST(churn_rate AS VARCHAR)
  || '%, avec un revenu moyen par utilisateur (ARPU) de ' || CAST(arpu AS VARCHAR) || '€.' AS summary
FROM k
"""


BODIES["report_sections"] = f"""
, rk AS {_sub(BODIES["kpis"])},
rb AS {_sub(BODIES["churn_by_tenure"])},
rq AS {_sub(BODIES["churn_reasons"])},
rs AS {_sub(BODIES["segments"])},
rt AS {_sub(BODIES["monthly_trends"])},
rc AS {_sub(BODIES["contract_counts"])},
sm AS {_sub(BODIES["report_summary"])},
u AS (
  SELECT 'kpis' AS section, 1 AS position, 'total_customers' AS label, CAST(total_customers AS DOUBLE) AS value,
         CAST(NULL AS VARCHAR) AS text FROM rk
  UNION ALL SELECT 'kpis', 2, 'churn_rate', churn_rate, NULL FROM rk
  UNION ALL SELECT 'kpis', 3, 'arpu', arpu, NULL FROM rk
  UNION ALL SELECT 'kpis', 4, 'clv', clv, NULL FROM rk
  UNION ALL SELECT 'kpis', 5, 'churn_count', CAST(churn_count AS DOUBLE), NULL FROM rk
  UNION ALL SELECT 'kpis', 6, 'active_customers', CAST(active_customers AS DOUBLE), NULL FROM rk
  UNION ALL SELECT 'churn', ordinal, tenure_band, churn_rate, CAST(customers AS VARCHAR) FROM rb
  UNION ALL SELECT 'churn', rank + 100, reason, percentage, category FROM rq
  UNION ALL SELECT 'segments', ordinal, name, percentage, CAST(count AS VARCHAR) || ' | '
    || replace(characteristics, ' | ', ', ') || ' | ' || replace(actions, ' | ', ', ') FROM rs
  UNION ALL SELECT 'header', 1, 'Rapport Telco Analytics', NULL, 'Généré le 31/12/1998'
  UNION ALL SELECT 'summary', 1, 'summary', NULL, summary FROM sm
  UNION ALL SELECT 'trends', year(month) * 100 + month(month), strftime(month, '%Y-%m'), churn_rate, NULL FROM rt
  UNION ALL SELECT 'contracts', rank, contract, CAST(customers AS DOUBLE), NULL FROM rc
  UNION ALL SELECT * FROM (VALUES
    ('recommendations', 1, 'Programme de rétention pour clients At-Risk', CAST(NULL AS DOUBLE), 'Haute | -3% churn'),
    ('recommendations', 2, 'Campagne d''engagement pour nouveaux clients', NULL, 'Haute | +15% rétention'),
    ('recommendations', 3, 'Offres d''upsell pour Low ARPU', NULL, 'Moyenne | +10% ARPU'),
    ('recommendations', 4, 'Programme VIP pour Premium Users', NULL, 'Moyenne | +5% satisfaction')))
SELECT section, CAST(position AS INTEGER) AS position, label, CAST(value AS DOUBLE) AS value, text FROM u
"""

BODIES["distributions_churned"] = BODIES["distributions"].replace(
    "FROM subs WHERE", "FROM subs WHERE Churn = 1 AND")
BODIES["segment_lookup"] = BODIES["segments"].strip() + "\nWHERE name = 'At-Risk'"


_PREDICATES = {
    1: ("Premium Users", "MonthlyCharges > 90 AND tenure > 24"), 2: ("Heavy Data Users", "InternetService = 'Fiber optic'"),
    3: ("Voice Only", "InternetService = 'No' AND PhoneService = 'Yes'"), 4: ("Low ARPU", "MonthlyCharges < 40"),
    5: ("At-Risk", "Contract = 'Month-to-month' AND tenure < 12"),
    6: ("Loyal Base", "Contract IN ('One year', 'Two year') AND tenure > 36")}

BODIES["segment_overlaps"] = "\nUNION ALL\n".join(
    f"SELECT {i} AS first, {j} AS second, '{a}' AS first_segment, '{b}' AS second_segment, "
    f"CAST(count_if(({p}) AND ({q})) AS BIGINT) AS customers, "
    f"{rr(f'count_if(({p}) AND ({q})) * 100', f'count_if(({p}) OR ({q}))', 1)} AS share FROM subs"
    for i, (a, p) in _PREDICATES.items() for j, (b, q) in _PREDICATES.items() if i < j)

BODIES["subscriber_cube"] = f"""
, c AS (
  SELECT CASE WHEN tenure > 0 AND tenure <= 6 THEN 1 WHEN tenure > 6 AND tenure <= 12 THEN 2
              WHEN tenure > 12 AND tenure <= 24 THEN 3 WHEN tenure > 24 AND tenure <= 36 THEN 4
              WHEN tenure > 36 AND tenure <= 48 THEN 5 WHEN tenure > 48 AND tenure <= 60 THEN 6
              WHEN tenure > 60 AND tenure <= 72 THEN 7 END AS tenure_band,
         CASE WHEN MonthlyCharges > 0 AND MonthlyCharges <= 30 THEN 1
              WHEN MonthlyCharges > 30 AND MonthlyCharges <= 50 THEN 2
              WHEN MonthlyCharges > 50 AND MonthlyCharges <= 70 THEN 3
              WHEN MonthlyCharges > 70 AND MonthlyCharges <= 90 THEN 4
              WHEN MonthlyCharges > 90 AND MonthlyCharges <= 120 THEN 5 END AS charge_band,
         {" + ".join(f"CASE WHEN {p} THEN {1 << (i - 1)} ELSE 0 END" for i, (_, p) in _PREDICATES.items())} AS segments, *
  FROM subs)
SELECT CAST(tenure_band AS INTEGER) AS tenure_band, CAST(charge_band AS INTEGER) AS charge_band, Contract AS contract,
  InternetService AS internet, PaymentMethod AS payment, Churn AS churn, CAST(segments AS INTEGER) AS segments,
  CAST(count(*) AS BIGINT) AS customers, CAST(count(customerID) AS BIGINT) AS ids,
  CAST(coalesce(sum(Churn), 0) AS BIGINT) AS churned, CAST(count(Churn) AS BIGINT) AS churn_known,
  CAST(coalesce(sum(tenure), 0) AS BIGINT) AS tenure_sum, CAST(count(tenure) AS BIGINT) AS tenure_known,
  CAST(coalesce(sum(CAST(MonthlyCharges AS DECIMAL(28,10))), 0) AS DOUBLE) AS monthly_sum,
  CAST(count(MonthlyCharges) AS BIGINT) AS monthly_known,
  CAST(coalesce(sum(CAST(TotalCharges AS DECIMAL(28,10))), 0) AS DOUBLE) AS total_sum,
  CAST(count(TotalCharges) AS BIGINT) AS total_known
FROM c GROUP BY tenure_band, charge_band, c.Contract, InternetService, PaymentMethod, c.Churn, segments
"""

BODIES["cube_overview"] = BODIES["overview"]


BODIES["overview_from_store"] = BODIES["overview_filtered"]
BODIES["warehouse_rerun"] = f"""
SELECT {", ".join(_COLS[1:])}, 'first' AS run_id FROM subs
UNION ALL SELECT {", ".join(_COLS[1:])}, 'second' FROM subs WHERE Churn = 1
"""
BODIES["score_quarantine"] = f"""
, plain AS ({BODIES["score_rejects"].replace("FROM score_requests", "FROM score_requests", 1)}),
readable AS (SELECT plain.* FROM plain JOIN subs USING (customerID) WHERE tenure % 10 NOT IN (3, 7))
SELECT customerID, reason, CAST(NULL AS VARCHAR) AS raw FROM readable
UNION ALL
SELECT NULL, 'unreadable', '{{"customerID":"' || customerID || '","tenure":' || CASE WHEN tenure % 10 = 7 THEN '"many"}}' ELSE '' END
FROM score_requests WHERE tenure % 10 IN (3, 7)
"""
_TEXT = ["CASE WHEN tenure % 10 = 3 THEN 'many' ELSE CAST(tenure AS VARCHAR) END" if c == "tenure" else
         "CASE WHEN tenure % 10 = 7 THEN 'n/a' ELSE CAST(MonthlyCharges AS VARCHAR) END" if c == "MonthlyCharges" else
         f"CAST({c} AS VARCHAR)" for c in _COLS]
BODIES["csv_quarantine"] = f"""
SELECT 'unreadable: ' || CASE WHEN tenure % 10 = 3 THEN 'tenure' ELSE 'MonthlyCharges' END AS reason,
  concat_ws(',', {", ".join(_TEXT)}) AS raw
FROM raw WHERE tenure % 10 IN (3, 7)
"""
BODIES["trends_incremental"] = BODIES["monthly_trends"]
BODIES["price_kde"] = """
, v AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
st AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), -0.2) AS h FROM v),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(200)),
s AS (
  SELECT g.point, sum(exp(-0.5 * pow((st.lo + g.point * ((st.hi - st.lo) / 199) - x) / st.h, 2))) AS s
  FROM v CROSS JOIN st CROSS JOIN g GROUP BY g.point)
SELECT s.point, lo + s.point * ((hi - lo) / 199) AS x,
  CAST(round(CAST(s / (n * h * sqrt(2 * pi())) AS DECIMAL(38,18)), 11) AS DOUBLE) AS density,
  CAST(round(CAST(s / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 30 AS DECIMAL(38,18)), 3) AS DOUBLE) AS count_density
FROM s CROSS JOIN st
"""
BODIES["score_stream_repeats"] = BODIES["score_batch"]


def oracle_sql() -> dict[str, str]:
    return {name: with_fixture(body) for name, body in BODIES.items()}
