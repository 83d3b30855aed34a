"""Fixture views as DuckDB common table expressions.

The oracle for every query is ``WITH <these CTEs>, <query CTEs> SELECT ...``,
run by DuckDB on the same Parquet tables.  The text follows the derivation
SQL of FIXTURES.md (views raw, subs, subs_dim, score_requests), flattened into
one WITH list.
"""

CTES = r"""
oa AS (
  SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey),
snap AS (SELECT max(o_orderdate) AS snap FROM orders),
h AS (
  SELECT c.*, oa.n_orders, oa.last_order, snap.snap,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'Fiber optic'
         WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'DSL' ELSE 'No' END AS inet,
    CASE WHEN (c_custkey * 7919 + 12345) % 10007 % 100 < 90 THEN 'Yes' ELSE 'No' END AS phone,
    1800 + CAST(floor((CAST(round(c_acctbal * 100) AS BIGINT) + 100000) * 10200 / 1100000) AS BIGINT) AS monthly_cents,
    CAST((c_custkey * 503 + 12345) % 10007 % 73 AS INT) AS tenure
  FROM customer c LEFT JOIN oa ON c.c_custkey = oa.o_custkey CROSS JOIN snap),
raw AS (
SELECT c_name AS customerID,
  CASE WHEN (c_custkey * 101 + 12345) % 10007 % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(CASE WHEN (c_custkey * 211 + 12345) % 10007 % 100 < 16 THEN 1 ELSE 0 END AS INT) AS SeniorCitizen,
  CASE WHEN (c_custkey * 307 + 12345) % 10007 % 100 < 50 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN (c_custkey * 401 + 12345) % 10007 % 100 < 30 THEN 'Yes' ELSE 'No' END AS Dependents,
  tenure,
  phone AS PhoneService,
  CASE WHEN phone = 'No' THEN 'No phone service' WHEN (c_custkey * 601 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS MultipleLines,
  inet AS InternetService,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN (c_custkey * 701 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN (c_custkey * 809 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN (c_custkey * 907 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN (c_custkey * 1009 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS TechSupport,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN (c_custkey * 1103 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS StreamingTV,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN (c_custkey * 1201 + 12345) % 10007 % 100 < 45 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
  CASE WHEN coalesce(n_orders, 0) <= 10 THEN 'Month-to-month' WHEN n_orders <= 12 THEN 'One year' ELSE 'Two year' END AS Contract,
  CASE WHEN (c_custkey * 1301 + 12345) % 10007 % 100 < 60 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  CASE (c_custkey * 1409 + 12345) % 10007 % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
       WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
  CAST(monthly_cents AS DOUBLE) / 100 AS MonthlyCharges,
  CASE WHEN tenure = 0 THEN ' '
       ELSE CAST(CAST(CAST(monthly_cents * tenure AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS STRING) END AS TotalCharges,
  CASE WHEN last_order IS NULL OR last_order < snap - INTERVAL 290 DAY THEN 'Yes' ELSE 'No' END AS Churn
FROM h),
subs AS (
SELECT customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
  InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies,
  Contract, PaperlessBilling, PaymentMethod, MonthlyCharges,
  coalesce(try_cast(TotalCharges AS DOUBLE), 0.0) AS TotalCharges,
  CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INT) AS Churn
FROM raw),
subs_dim AS (
SELECT c.c_name AS customerID, r.r_name AS region, CAST(min(o.o_orderdate) AS DATE) AS signup_date
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_name, r.r_name),
ev_snap AS (SELECT max(ts) AS snap FROM events),
usage AS (
  SELECT user_id,
    CAST(sum(CASE WHEN event_type = 'error' AND ts > snap - INTERVAL 31 DAY THEN 1 ELSE 0 END) AS INT) AS complaints,
    CAST(sum(CASE WHEN event_type = 'click' AND ts > snap - INTERVAL 31 DAY THEN 10 ELSE 0 END) AS DOUBLE) AS voice_usage,
    CAST(floor(CAST(sum(CASE WHEN event_type = 'view' AND ts > snap - INTERVAL 31 DAY
      THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 50) AS DOUBLE) / 100 AS data_usage
  FROM events CROSS JOIN ev_snap GROUP BY user_id),
score_requests AS (
SELECT b.customerID, b.tenure, u.voice_usage, u.data_usage, u.complaints,
  CASE WHEN b.Contract = 'Month-to-month' THEN 'Prepaid' ELSE 'postpaid' END AS contract_type,
  CASE WHEN b.SeniorCitizen = 1 THEN NULL ELSE b.MonthlyCharges END AS monthly_charges,
  b.InternetService AS internet_service, b.OnlineSecurity AS online_security,
  b.TechSupport AS tech_support, b.StreamingTV AS streaming_tv
FROM usage u JOIN customer k ON u.user_id = k.c_custkey JOIN subs b ON b.customerID = k.c_name)
"""


def rr(num: str, den: str, digits: int) -> str:
    """SQL for num/den (integers) rounded half away from zero to ``digits`` decimals."""
    scale = 10 ** digits
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    q = f"((abs({n}) * {2 * scale} + {d}) // ({d} * 2))"
    return (f"(CASE WHEN {d} > 0 THEN CAST(CASE WHEN {n} < 0 THEN -{q} ELSE {q} END AS DOUBLE)"
            f" / {scale} END)")


def money_sum(x: str) -> str:
    """Aggregate SQL: the unrounded sum as an integer of ten decimals (no value is rounded)."""
    return f"CAST(replace(CAST(sum(CAST({x} AS DECIMAL(28,10))) AS VARCHAR), '.', '') AS HUGEINT)"


def mean_money(x: str, digits: int = 2) -> str:
    return rr(money_sum(x), f"count({x}) * 10000000000", digits)


def sum_money(x: str) -> str:
    return f"coalesce({rr(money_sum(x), '10000000000', 2)}, 0.0)"


def with_fixture(body: str) -> str:
    """Prefix the fixture CTEs; ``body`` is ``SELECT ...`` or ``, more AS (...) SELECT ...``."""
    return f"WITH {CTES.strip()}\n{body.strip()}"
