"""Overlapping subscriber segments.

All six predicates are evaluated in one scan (six ``count_if`` in one aggregate);
the one-row result is turned into six rows with literal segment attributes, so
no dimension join is needed.  Membership is a per-row array of matching
segments, exploded: a narrow transformation without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_ratio_sql
from ..functions.sql import quote, string_array


@dataclass(frozen=True)
class Segment:
    ordinal: int
    name: str
    predicate: str
    color: str
    characteristics: tuple[str, ...]
    actions: tuple[str, ...]

    def condition(self) -> Column:
        return F.expr(self.predicate)


# Segment names, rules, colours, characteristics and actions.
SEGMENTS = (
    Segment(1, "Premium Users", "MonthlyCharges > 90 AND tenure > 24", "#2563eb",
            ("ARPU > 90€", "Ancienneté > 24 mois", "Services multiples", "Faible taux de churn"),
            ("Programme VIP exclusif", "Offres early access", "Support prioritaire")),
    Segment(2, "Heavy Data Users", "InternetService = 'Fiber optic'", "#10b981",
            ("Abonnement Fibre", "Streaming actif", "Usage data élevé", "Sensible à la vitesse"),
            ("Upgrade vers fibre premium", "Bundle streaming", "Garantie de débit")),
    Segment(3, "Voice Only", "InternetService = 'No' AND PhoneService = 'Yes'", "#f59e0b",
            ("Téléphone uniquement", "Pas d'internet", "Usage traditionnel", "Profil senior"),
            ("Offre internet simplifiée", "Formation digitale", "Tarifs voix avantageux")),
    Segment(4, "Low ARPU", "MonthlyCharges < 40", "#8b5cf6",
            ("ARPU < 40€", "Services basiques", "Sensible au prix", "Potentiel d'upsell"),
            ("Offres bundle attractives", "Promotions ciblées", "Montée en gamme progressive")),
    Segment(5, "At-Risk", "Contract = 'Month-to-month' AND tenure < 12", "#ef4444",
            ("Contrat mensuel", "Ancienneté < 12 mois", "Pas d'engagement", "Risque de churn élevé"),
            ("Programme de rétention", "Offre d'engagement", "Appel proactif", "Remise fidélité")),
    Segment(6, "Loyal Base", "Contract IN ('One year', 'Two year') AND tenure > 36", "#06b6d4",
            ("Contrat long terme", "Ancienneté > 3 ans", "Faible churn", "Ambassadeurs potentiels"),
            ("Programme parrainage", "Récompenses fidélité", "Renouvellement anticipé")),
)


def segment_counts(subs: DataFrame, name: str | None = None) -> DataFrame:
    """ordinal, name, count, percentage (1 dp of all rows), color, characteristics, actions.

    ``name`` selects one segment (lookup by name).
    """
    wide = subs.agg(
        F.expr("count(1) AS total"),
        *[F.expr(f"count_if({s.predicate}) AS _c{s.ordinal}") for s in SEGMENTS])
    items = ", ".join(
        f"named_struct('ordinal', {s.ordinal}, 'name', {quote(s.name)}, 'count', _c{s.ordinal}, "
        f"'color', {quote(s.color)}, 'characteristics', {string_array(s.characteristics)}, "
        f"'actions', {string_array(s.actions)})"
        for s in SEGMENTS)
    long = wide.selectExpr("total", f"inline(array({items}))")
    out = long.selectExpr("ordinal", "name", "count",
                          f"{round_ratio_sql('count * 100', 'total', 1)} AS percentage",
                          "color", "characteristics", "actions")
    return out.where(F.col("name") == name) if name is not None else out


def segment_members(subs: DataFrame) -> DataFrame:
    """Long form subscriber x segment: customerID, ordinal, segment (a row may be in several)."""
    tags = ", ".join(
        f"CASE WHEN {s.predicate} THEN named_struct('ordinal', {s.ordinal}, 'segment', {quote(s.name)}) END"
        for s in SEGMENTS)
    return subs.selectExpr("customerID", f"inline(array_compact(array({tags})))")
