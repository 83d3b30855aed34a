"""Rule-based churn scoring of request rows, with explained factors and recommendations.

``score`` is one projection of built-in expressions (no UDF, no shuffle), so
the same function serves a batch DataFrame and a Structured Streaming one.
``tag_requests`` validates rows first; rejected rows carry the reason of the
first failing check (field order) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import quote
from ..schema import CORRUPT

# Defaults of the optional request fields.
DEFAULT_MONTHLY_CHARGES = 50.0
DEFAULT_INTERNET_SERVICE = "Fiber optic"
DEFAULT_ONLINE_SECURITY = "No"
DEFAULT_TECH_SUPPORT = "No"
DEFAULT_STREAMING_TV = "No"

# Factor messages.
MSG_TENURE_NEW = "Client nouveau (< 6 mois)"
MSG_TENURE_RECENT = "Client récent (6-12 mois)"
MSG_TENURE_ESTABLISHED = "Client établi (1-2 ans)"
MSG_TENURE_LOYAL = "Client fidèle (> 2 ans)"
MSG_COMPLAINTS_MANY = "Nombreuses réclamations"
MSG_COMPLAINTS_SOME = "Quelques réclamations"
MSG_COMPLAINTS_NONE = "Aucune réclamation"
MSG_CONTRACT_PREPAID = "Contrat prépayé (sans engagement)"
MSG_CONTRACT_POSTPAID = "Contrat postpayé"
MSG_CHARGES_HIGH = "Facture élevée"
MSG_DATA_LOW = "Faible consommation data"
MSG_FIBER = "Fibre optique (plus volatile)"
MSG_NO_SERVICES = "Pas de services de sécurité"
VALUE_NO_SERVICES = "Aucun service additionnel"

# Risk levels.
LEVEL_HIGH = "Élevé"
LEVEL_MEDIUM = "Moyen"
LEVEL_LOW = "Faible"

# Recommendations, in output order, and the two fallbacks.
REC_ONBOARDING = "Programme d'onboarding personnalisé pour les nouveaux clients"
REC_CONTACT = "Contacter le client pour résoudre les problèmes signalés"
REC_COMMITMENT = "Proposer une offre d'engagement avec avantages"
REC_DISCOUNT = "Offrir une réduction ou un upgrade de services"
REC_PLANS = "Proposer des forfaits adaptés à l'usage"
REC_TRIAL = "Offrir un essai gratuit des services premium"
REC_FALLBACK = ("Maintenir la relation client avec des communications régulières",
                "Proposer le programme de fidélité")

SCORE_CAP = 100
REJECT_COLUMN = "reject_reason"
UNREADABLE = "unreadable"


_FMT2 = "'%.2f'"  # factor values of money/usage: two decimals


def _factor(name: str, value: str, impact: str, message: str, points: int) -> str:
    return (f"named_struct('factor', {quote(name)}, 'value', {value}, 'impact', {quote(impact)}, "
            f"'message', {quote(message)}, 'points', {points})")


def reject_reason() -> Column:
    """First failing check in field order, or NULL for a valid request."""
    def bad_positive(c: Column) -> Column:
        return F.isnan(c) | ~(c > 0)
    t, v, d = F.col("tenure"), F.col("voice_usage"), F.col("data_usage")
    c, k = F.col("complaints"), F.col("contract_type")
    return (F.when(t.isNull(), "tenure: missing")
            .when(v.isNull(), "voice_usage: missing")
            .when(bad_positive(v), "voice_usage: must be > 0")
            .when(d.isNull(), "data_usage: missing")
            .when(bad_positive(d), "data_usage: must be > 0")
            .when(c.isNull(), "complaints: missing")
            .when(~(c >= 0), "complaints: must be >= 0")
            .when(k.isNull(), "contract_type: missing"))


def tag_requests(requests: DataFrame) -> DataFrame:
    """The requests with the reason why each is rejected, or NULL.  Requests read from text
    (``io.read_requests``) that could not be read are rejected whatever their other columns say."""
    reason = reject_reason()
    if CORRUPT in requests.columns:
        reason = F.when(F.col(CORRUPT).isNotNull(), UNREADABLE).otherwise(reason)
    return requests.withColumn(REJECT_COLUMN, reason)


def valid_requests(requests: DataFrame) -> DataFrame:
    return tag_requests(requests).where(F.col(REJECT_COLUMN).isNull()).drop(REJECT_COLUMN, CORRUPT)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """(customerID, reason), and ``raw``, the text of an unreadable request, where the requests
    were read from text.  What is left of an unreadable request is not trusted: it has no id."""
    bad = tag_requests(requests).where(F.col(REJECT_COLUMN).isNotNull())
    reason = F.col(REJECT_COLUMN).alias("reason")
    if CORRUPT not in requests.columns:
        return bad.select("customerID", reason)
    return bad.select(F.when(F.col(CORRUPT).isNull(), F.col("customerID")).alias("customerID"), reason,
                      F.col(CORRUPT).alias("raw"))


def score(requests: DataFrame) -> DataFrame:
    """Add raw_score, score (capped at 100), probability, risk_level, factors (ordered array),
    factor_map (MAP factor -> value/impact/message) and recommendations (ordered array).

    Expects validated rows (see :func:`valid_requests`).  Optional inputs that are
    NULL take their defaults.
    """
    cols = [f"`{c}`" for c in requests.columns]
    mc = f"coalesce(nanvl(monthly_charges, CAST(NULL AS DOUBLE)), {DEFAULT_MONTHLY_CHARGES}D)"
    inet = f"coalesce(internet_service, {quote(DEFAULT_INTERNET_SERVICE)})"
    security = f"coalesce(online_security, {quote(DEFAULT_ONLINE_SECURITY)})"
    support = f"coalesce(tech_support, {quote(DEFAULT_TECH_SUPPORT)})"
    tv, cv = "CAST(tenure AS STRING)", "CAST(complaints AS STRING)"
    factors = {
        "_f_tenure": f"CASE WHEN tenure < 6 THEN {_factor('tenure', tv, 'high', MSG_TENURE_NEW, 30)} "
                     f"WHEN tenure < 12 THEN {_factor('tenure', tv, 'medium', MSG_TENURE_RECENT, 20)} "
                     f"WHEN tenure < 24 THEN {_factor('tenure', tv, 'low', MSG_TENURE_ESTABLISHED, 10)} "
                     f"ELSE {_factor('tenure', tv, 'positive', MSG_TENURE_LOYAL, 0)} END",
        "_f_complaints":
            f"CASE WHEN complaints >= 3 THEN {_factor('complaints', cv, 'high', MSG_COMPLAINTS_MANY, 25)} "
            f"WHEN complaints >= 1 THEN {_factor('complaints', cv, 'medium', MSG_COMPLAINTS_SOME, 15)} "
            f"ELSE {_factor('complaints', cv, 'positive', MSG_COMPLAINTS_NONE, 0)} END",
        "_f_contract":
            f"CASE WHEN lower(contract_type) = 'prepaid' "
            f"THEN {_factor('contract', 'contract_type', 'high', MSG_CONTRACT_PREPAID, 20)} "
            f"ELSE {_factor('contract', 'contract_type', 'low', MSG_CONTRACT_POSTPAID, 5)} END",
        "_f_charges": f"CASE WHEN {mc} > 80 THEN "
                      f"{_factor('charges', f'format_string({_FMT2}, {mc})', 'medium', MSG_CHARGES_HIGH, 10)} END",
        "_f_data": f"CASE WHEN data_usage < 2.0D THEN "
                   f"{_factor('data_usage', f'format_string({_FMT2}, data_usage)', 'medium', MSG_DATA_LOW, 15)} END",
        "_f_internet": f"CASE WHEN {inet} = 'Fiber optic' THEN "
                       f"{_factor('internet', inet, 'medium', MSG_FIBER, 10)} END",
        "_f_services": f"CASE WHEN {security} = 'No' AND {support} = 'No' THEN "
                       f"{_factor('services', quote(VALUE_NO_SERVICES), 'medium', MSG_NO_SERVICES, 10)} END",
    }
    staged = requests.selectExpr("*", *[f"{e} AS {k}" for k, e in factors.items()])

    points = " + ".join(f"coalesce({k}.points, 0)" for k in factors)
    fired = ", ".join([
        f"CASE WHEN _f_tenure.impact IN ('high', 'medium') THEN {quote(REC_ONBOARDING)} END",
        f"CASE WHEN _f_complaints.impact IN ('high', 'medium') THEN {quote(REC_CONTACT)} END",
        f"CASE WHEN _f_contract.impact = 'high' THEN {quote(REC_COMMITMENT)} END",
        f"CASE WHEN _f_charges.impact = 'medium' THEN {quote(REC_DISCOUNT)} END",
        f"CASE WHEN _f_data.impact = 'medium' THEN {quote(REC_PLANS)} END",
        f"CASE WHEN _f_services.impact = 'medium' THEN {quote(REC_TRIAL)} END",
    ])
    summed = staged.selectExpr(
        *cols, f"CAST({points} AS INT) AS raw_score",
        f"array_compact(array({', '.join(factors)})) AS factors",
        f"array_compact(array({fired})) AS _fired")
    capped = f"LEAST(raw_score, {SCORE_CAP})"
    fallback = ", ".join(quote(x) for x in REC_FALLBACK)
    return summed.selectExpr(
        *cols, "raw_score", f"CAST({capped} AS INT) AS score",
        f"CAST({capped} AS DOUBLE) / 100 AS probability",
        f"CASE WHEN {capped} >= 70 THEN {quote(LEVEL_HIGH)} WHEN {capped} >= 40 THEN {quote(LEVEL_MEDIUM)} "
        f"ELSE {quote(LEVEL_LOW)} END AS risk_level",
        "factors",
        "map_from_entries(transform(factors, x -> struct(x.factor, named_struct("
        "'value', x.value, 'impact', x.impact, 'message', x.message)))) AS factor_map",
        f"CASE WHEN size(_fired) = 0 THEN array({fallback}) ELSE _fired END AS recommendations")


def factor_rows(scored: DataFrame, key: str = "customerID") -> DataFrame:
    """Long form of the factors: key, position (1-based), factor, value, impact, message, points."""
    return scored.select(key, F.posexplode("factors").alias("pos", "f")).select(
        key, (F.col("pos") + 1).alias("position"), "f.factor", "f.value", "f.impact", "f.message",
        "f.points")


def recommendation_rows(scored: DataFrame, key: str = "customerID") -> DataFrame:
    """Long form of the recommendations: key, position (1-based), text."""
    return scored.select(key, F.posexplode("recommendations").alias("pos", "text")).select(
        key, (F.col("pos") + 1).alias("position"), "text")
