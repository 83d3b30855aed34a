"""Sources and sinks: CSV files, a Parquet subscriber store, a warehouse table.

All writes are whole-dataset distributed writes (no row-at-a-time inserts);
paths should live on the cluster's shared storage (see ``session.scratch_path``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.sql import quote
from ..schema import CORRUPT, RAW_SCHEMA, REQUEST_SCHEMA, SUBSCRIBER_COLUMNS, WAREHOUSE_COLUMNS
from .snapshots import SnapshotStore

# Keep blanks as they are: a blank TotalCharges is data (a new subscriber).
_CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false",
                "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA, corrupt: bool = False) -> DataFrame:
    """CSV with a header row, columns bound by name: the files' own order and further columns do
    not matter, a missing column fails.  Types come from ``schema`` (no inference pass); all
    files of ``path`` share the first one's header.

    With ``corrupt`` the column :data:`CORRUPT` holds the text of rows with a cell that is not of
    its type, or with too few or too many cells (see :func:`readable_rows` and
    :func:`unreadable_rows`); without it such cells are NULL."""
    header = spark.read.options(**_CSV_OPTIONS).csv(path).columns
    if missing := [f.name for f in schema.fields if f.name not in header]:
        raise ValueError(f"{path} lacks the columns {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    in_order = StructType([StructField(c, types.get(c, StringType())) for c in header])
    kept = [f.name for f in schema.fields]
    reader = spark.read.options(**_CSV_OPTIONS, enforceSchema="false")
    if corrupt:
        in_order = in_order.add(CORRUPT, StringType())
        # all cells are parsed, whatever columns a query takes, so that a row is judged the same each time
        reader = reader.options(columnNameOfCorruptRecord=CORRUPT, columnPruning="false")
        kept = [*kept, CORRUPT]
    # enforceSchema=false: a file with another header fails instead of shifting columns
    return reader.schema(in_order).csv(path).select(*kept)


def read_requests(spark: SparkSession, path: str, fmt: str = "json", schema: StructType = REQUEST_SCHEMA) -> DataFrame:
    """Scoring requests from files; what cannot be read keeps its text in :data:`CORRUPT` (JSON
    lines and CSV; other formats have no text to keep)."""
    if fmt == "csv":
        return read_csv(spark, path, schema, corrupt=True)
    if fmt == "json":
        held = StructType([*schema.fields, StructField(CORRUPT, StringType())])
        return spark.read.schema(held).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(schema).format(fmt).load(path)


def readable_rows(rows: DataFrame) -> DataFrame:
    """The rows of a read with :data:`CORRUPT` that could be read, without that column."""
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def unreadable_rows(rows: DataFrame) -> DataFrame:
    """(reason, raw): the text of the rows that could not be read, and which typed columns hold
    nothing in them."""
    typed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, StringType)]
    lost = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in typed])
    return rows.where(F.col(CORRUPT).isNotNull()).select(
        F.concat(F.lit("unreadable: "), F.when(lost == "", "row").otherwise(lost)).alias("reason"),
        F.col(CORRUPT).alias("raw"))


def store_has_rows(spark: SparkSession, path: str) -> bool:
    """Non-empty probe of the newest published version of a store (a limit-1 job, not a full
    count); a store without one counts as empty."""
    store = SnapshotStore(spark, path)
    version = store.newest()
    return version is not None and not store.read(version=version).isEmpty()


def write_store(df: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """Replace the store's content with ``df``: readers see the old rows until the new ones are
    whole.  Earlier versions stay until :meth:`SnapshotStore.vacuum`."""
    SnapshotStore(df.sparkSession, path).write({"rows": df}, sources)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return SnapshotStore(spark, path).read().select(*SUBSCRIBER_COLUMNS)


def load_subscribers(spark: SparkSession, store_path: str, derive: Callable[[], DataFrame],
                     sources: DataFrame | None = None) -> DataFrame:
    """Read-through load: the newest version of the store if it holds rows, otherwise ``derive()``
    (source read and cleaning), written to the store, then read back from it.

    With ``sources`` (:func:`snapshots.source_files`) the store must also have been made from
    just these files as they are now; a changed, added or removed file makes a new version."""
    store = SnapshotStore(spark, store_path)
    fresh = store.is_made_from(sources) if sources is not None else store_has_rows(spark, store_path)
    if not fresh:
        write_store(derive().select(*SUBSCRIBER_COLUMNS), store_path, sources)
    return read_store(spark, store_path)


# Layout of the store that filtered overviews read.
REGION_LAYOUT = ("region", "signup_month")


def write_region_store(rows: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """Store rows with ``region`` and ``signup_date`` by region and month of signup.

    Rows are dealt by range, so each folder is written by few tasks, and a region and month that
    many rows share is still split (by customer).  Within a file rows lie by date, so file
    statistics narrow a filter further.  Rows without a signup date lie in a folder of their own."""
    laid = rows.withColumn("signup_month", F.trunc("signup_date", "MM"))
    laid = laid.repartitionByRange(*REGION_LAYOUT, "customerID").sortWithinPartitions(*REGION_LAYOUT, "signup_date")
    SnapshotStore(rows.sparkSession, path).write({"rows": laid}, sources, REGION_LAYOUT)


def read_region_store(spark: SparkSession, path: str, region: str | None = None, date_start: str | None = None,
                      date_end: str | None = None) -> DataFrame:
    """The rows of :func:`write_region_store`, opened so that only folders which a filter on region
    and signup date can match are listed and read."""
    rows = SnapshotStore(spark, path).read()
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if date_start is not None:
        rows = rows.where(F.col("signup_month") >= F.trunc(F.lit(date_start).cast("date"), "MM"))
        rows = rows.where(F.col("signup_date") >= F.lit(date_start).cast("date"))
    if date_end is not None:
        rows = rows.where((F.col("signup_month") <= F.lit(date_end).cast("date"))
                          & (F.col("signup_date") <= F.lit(date_end).cast("date")))
    return rows


WAREHOUSE_DDL = """CREATE TABLE IF NOT EXISTS {name} (
  gender STRING, SeniorCitizen INT, Partner STRING, Dependents STRING, tenure INT,
  PhoneService STRING, MultipleLines STRING, InternetService STRING, OnlineSecurity STRING,
  OnlineBackup STRING, DeviceProtection STRING, TechSupport STRING, StreamingTV STRING,
  StreamingMovies STRING, Contract STRING, PaperlessBilling STRING, PaymentMethod STRING,
  MonthlyCharges DOUBLE, TotalCharges DOUBLE, Churn INT{run}
) USING parquet{parted}{location}"""


def create_warehouse_table(spark: SparkSession, name: str, location: str | None = None, by_run: bool = False) -> None:
    """``by_run``: the table keeps which run appended a row, so that a run can be repeated."""
    loc = f" LOCATION '{location}'" if location else ""
    run, parted = (", run_id STRING", " PARTITIONED BY (run_id)") if by_run else ("", "")
    spark.sql(WAREHOUSE_DDL.format(name=name, location=loc, run=run, parted=parted))


def append_to_warehouse(df: DataFrame, name: str, run_id: str | None = None) -> None:
    """Append (no key: appending the same rows twice stores them twice).

    With ``run_id`` (a table created ``by_run``) the rows take the place of those that the same
    run appended before; all other runs' rows stay."""
    rows = df.select(*WAREHOUSE_COLUMNS)
    if run_id is None:
        rows.write.insertInto(name)
    else:
        df.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {name} PARTITION (run_id = {quote(run_id)}) SELECT * FROM {{rows}}", rows=rows)


def scan_warehouse(spark: SparkSession, name: str, where: str | None = None) -> DataFrame:
    """``SELECT * FROM name [WHERE ...]``; the predicate is pushed into the Parquet scan."""
    sql = f"SELECT * FROM {name}" + (f" WHERE {where}" if where else "")
    return spark.sql(sql)


def scan_then_drop(spark: SparkSession, name: str, location: str, where: str | None = None) -> DataFrame:
    """:func:`scan_warehouse` of an external table that is no longer needed as a table: it leaves the
    catalog, its files stay for the scan."""
    sql = scan_warehouse(spark, name, where)
    out = spark.read.schema(sql.schema).parquet(location)
    spark.sql(f"DROP TABLE {name}")
    return out.where(where) if where else out


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str],
                batch_size: int = 10000, num_partitions: int | None = None) -> None:
    """Append rows to an external SQL table over JDBC (the warehouse sink's external form).

    Rows go in batches of ``batch_size`` per statement from every task in parallel
    (at most ``num_partitions`` connections).  The driver jar must be on the classpath.
    Not exercised by the tests: no database server runs in the test environment.
    """
    out = df.select(*WAREHOUSE_COLUMNS) if set(WAREHOUSE_COLUMNS) <= set(df.columns) else df
    writer = out.write.option("batchsize", str(batch_size))
    if num_partitions:
        writer = writer.option("numPartitions", str(num_partitions))
    writer.jdbc(url, table, mode="append", properties=properties)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int = 1) -> DataFrame:
    """Read an external SQL table over JDBC; with a numeric ``partition_column`` and bounds
    the read is split into ``num_partitions`` parallel range queries."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions, properties=properties)
