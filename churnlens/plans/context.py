"""The subscriber tables of one input: derived from order-entry tables, or read from a CSV."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean
from ..operators.clean import clean_subscribers
from ..schema import SUBSCRIBER_COLUMNS
from ..sources import fixture
from ..sources.tables import Tables


class Workspace:
    """Lazy plans over one data directory: subscribers (``base``, ``raw``, ``subs``), their
    batch-cleaned rows (``warehouse``) and the scoring requests (``requests``).

    Nothing is stored or remembered between workspaces: every query that is built from a
    workspace is one plan over the source tables as they are when it runs, and Catalyst
    prunes it to what the query needs.
    """

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir
        self.tables = Tables(spark, data_dir)

    @cached_property
    def base(self) -> DataFrame:
        """Raw subscriber rows plus keys, derived from customer and orders."""
        return fixture.subscriber_base(self.tables.customer, self.tables.orders)

    @cached_property
    def raw(self) -> DataFrame:
        return self.base.select(*SUBSCRIBER_COLUMNS)

    @cached_property
    def subs(self) -> DataFrame:
        return clean_subscribers(self.raw, fill="zero")

    @cached_property
    def subs_with_region(self) -> DataFrame:
        """Clean rows plus ``region`` and ``signup_date`` (for the overview filters)."""
        wide = fixture.with_region(self.base, self.tables.nation, self.tables.region)
        return clean_subscribers(wide, fill="zero")

    @cached_property
    def warehouse(self) -> DataFrame:
        """The warehouse rows (batch cleaning: median fill, no id)."""
        return clean.warehouse_rows(self.raw)

    @cached_property
    def dim(self) -> DataFrame:
        return fixture.subscriber_dim(self.base, self.tables.nation, self.tables.region)

    @cached_property
    def requests(self) -> DataFrame:
        """Scoring requests (events aggregated per user, joined to the subscriber base)."""
        return fixture.score_requests(self.base, self.tables.events)

    @property
    def orders(self) -> DataFrame:
        return self.tables.orders

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose the derived tables to SQL as temporary views: raw, subs, subs_dim,
        score_requests (names optionally prefixed).  Returns the view names."""
        views = {"raw": self.raw, "subs": self.subs, "subs_dim": self.dim,
                 "score_requests": self.requests}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]
