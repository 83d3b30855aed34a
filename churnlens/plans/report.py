"""Report dataset: the contents of the PDF report as one long table.

Rows are (section, position, label, value, text).  Sections follow the report options: kpis,
churn (tenure bands and top reasons), segments (share, size, characteristics and actions), trends
(monthly churn rate); header (title and date), summary, contracts and recommendations are always
present.  All sections over subscribers are projected from one cube.  The table is written
 with ``partitionBy("section")`` so a reader of one section prunes the others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.bands import TENURE_LABELS, band_label_sql
from ..functions.rounding import round_ratio_sql
from ..functions.sql import quote
from ..operators import cube, reasons, segments
from .trends import monthly_trends

DEFAULT_SECTIONS = ("kpis", "churn", "segments", "trends")
ALWAYS_SECTIONS = ("header", "summary", "contracts", "recommendations")

# Default title of the report, its date line and date format.
TITLE = "Rapport Telco Analytics"
DATE_LINE = "Généré le "
DATE_FORMAT = "dd/MM/yyyy"

# The report's recommendation table (priority, action, expected impact).
RECOMMENDATIONS = (
    ("Haute", "Programme de rétention pour clients At-Risk", "-3% churn"),
    ("Haute", "Campagne d'engagement pour nouveaux clients", "+15% rétention"),
    ("Moyenne", "Offres d'upsell pour Low ARPU", "+10% ARPU"),
    ("Moyenne", "Programme VIP pour Premium Users", "+5% satisfaction"),
)

# Fixed value: the executive summary; the gaps take the subscribers, the churn rate and the ARPU.
SUMMARY = ("Ce rapport présente une analyse complète de la base clients télécom avec %s clients. "
           "Le taux de churn actuel est de %s%%, avec un revenu moyen par utilisateur (ARPU) de %s€.")

TOP_REASONS = 10
KPI_ORDER = ("total_customers", "churn_rate", "arpu", "clv", "churn_count", "active_customers")


def _row(section: str, position: str, label: str, value: str = "NULL", text: str = "NULL") -> str:
    """SQL: one row of the report; SQL operands."""
    return (f"named_struct('section', '{section}', 'position', CAST({position} AS INT), 'label', CAST({label} AS STRING), "
            f"'value', CAST({value} AS DOUBLE), 'text', CAST({text} AS STRING))")


def _summary_sql() -> str:
    """SQL: the executive summary over the ``all`` row of the totals."""
    # two decimals at most, never in scientific notation
    plain = [f"regexp_replace(CAST(CAST({cube.KPIS[c]} AS DECIMAL(20,2)) AS STRING), '0$', '')" for c in ("churn_rate", "arpu")]
    return f"format_string({quote(SUMMARY)}, format_number({cube.KPIS['total_customers']}, 0), {', '.join(plain)})"


def _subscriber_sections(subs: DataFrame, wanted: set[str]) -> DataFrame:
    """The rows of all sections over subscribers: one cube, its totals, and per total the rows that
    it gives.  The windows run over the totals, a few per category."""
    whole = {"summary": [_row("summary", "1", "'summary'", text=_summary_sql())]}
    whole["kpis"] = [_row("kpis", str(i), quote(k), cube.KPIS[k]) for i, k in enumerate(KPI_ORDER, start=1)]
    whole["segments"] = [
        _row("segments", str(s.ordinal), quote(s.name),
             round_ratio_sql(f"in_segment[{i}] * 100", "customers", 1),
             f"concat_ws(' | ', CAST(in_segment[{i}] AS STRING), {quote(', '.join(s.characteristics))}, "
             f"{quote(', '.join(s.actions))})") for i, s in enumerate(segments.SEGMENTS)]
    of_all = ", ".join(row for name, rows in whole.items() if name in wanted for row in rows)
    tenure = _row("churn", "key", band_label_sql("CAST(key AS INT)", TENURE_LABELS),
                  round_ratio_sql("churned * 100", "churn_known", 2), "ids")
    reason = _row("churn", "reason_rank + 100", "reason", "percentage", "category")
    contract = _row("contracts", "contract_rank", "key", "customers")

    found = cube.totals(cube.subscriber_cube(subs)).where("dimension IN ('all', 'tenure_band', 'contract', 'internet')")
    share = round_ratio_sql("gone * 100", "sum(gone) OVER (PARTITION BY dimension)", 1)
    found = found.selectExpr(
        "*", f"{share} AS percentage", "row_number() OVER (PARTITION BY dimension ORDER BY customers DESC, key) AS contract_rank",
        f"CASE dimension WHEN 'contract' THEN {quote(reasons.CONTRACT_CATEGORY)} WHEN 'internet' THEN "
        f"{quote(reasons.SERVICE_CATEGORY)} END AS category",
        f"CASE dimension WHEN 'contract' THEN concat({quote(reasons.CONTRACT_PREFIX)}, key) WHEN 'internet' THEN "
        f"concat({quote(reasons.SERVICE_PREFIX)}, key) END AS reason",
        f"dimension IN ('contract', 'internet') AND gone > 0 AND NOT (dimension = 'internet' AND key = "
        f"{quote(reasons.EXCLUDED_SERVICE)}) AS is_reason")
    found = found.selectExpr(
        "*", "row_number() OVER (PARTITION BY is_reason ORDER BY percentage DESC, CASE WHEN dimension = 'contract' THEN 0 "
             "ELSE 1 END, gone DESC, reason) AS reason_rank")
    rows = [f"CASE WHEN dimension = 'contract' THEN {contract} END"]
    if "churn" in wanted:
        rows += [f"CASE WHEN dimension = 'tenure_band' THEN {tenure} END",
                 f"CASE WHEN is_reason AND reason_rank <= {TOP_REASONS} THEN {reason} END"]
    return found.selectExpr(f"inline(CASE WHEN dimension = 'all' THEN array({of_all}) ELSE array_compact(array({', '.join(rows)})) END)")


def _fixed_sections(spark: SparkSession, title: str, report_date: str | None) -> DataFrame:
    """Header and recommendations, which need no data."""
    day = f"DATE {quote(report_date)}" if report_date else "current_date()"
    line = f"concat({quote(DATE_LINE)}, date_format({day}, {quote(DATE_FORMAT)}))"
    rows = [_row("header", "1", quote(title), text=line)]
    rows += [_row("recommendations", str(i), quote(action), text=quote(f"{priority} | {impact}"))
             for i, (priority, action, impact) in enumerate(RECOMMENDATIONS, start=1)]
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def report_sections(subs: DataFrame, orders: DataFrame | None,
                    include_sections: Iterable[str] = DEFAULT_SECTIONS, title: str = TITLE,
                    report_date: str | None = None) -> DataFrame:
    """The report's rows for ``include_sections`` and the sections that are always present.

    ``orders`` feeds the trends only.  ``report_date`` (ISO) is the date in the header, today if
    omitted.  One lazy plan, in which the subscribers are derived and read once."""
    wanted = set(include_sections) | set(ALWAYS_SECTIONS)
    out = _subscriber_sections(subs, wanted).unionByName(_fixed_sections(subs.sparkSession, title, report_date))
    if "trends" in wanted:
        row = _row("trends", "year(month) * 100 + month(month)", "date_format(month, 'yyyy-MM')", "churn_rate")
        out = out.unionByName(monthly_trends(orders).selectExpr(f"inline(array({row}))"))
    return out


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").partitionBy("section").parquet(path)


def report_summary(subs: DataFrame) -> DataFrame:
    """total_customers, churn_rate, arpu and the executive-summary sentence."""
    whole = cube.totals(cube.subscriber_cube(subs)).where("dimension = 'all'")
    return whole.selectExpr(*[f"{cube.KPIS[c]} AS {c}" for c in ("total_customers", "churn_rate", "arpu")],
                            f"{_summary_sql()} AS summary")
