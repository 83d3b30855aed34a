"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its text.  The ledger holds, for each
blob, the rules (name and version) that have scanned it and the spans that they found.  A scan
looks up which pairs of blob and rule version are new, scans the text of one version of each such
blob with just these rules, and adds a batch to the ledger; findings are joined back to all paths
that hold the blob.  So a text that is copied, moved, or met again in a later run is scanned once,
and a new version of one rule makes that rule alone scan the old blobs.

All work is Spark's own expressions.  A ledger row is a fact on its own ("these rules scanned this
blob and found this"), so batches written twice, or in part by a job that died, do no harm.

Null texts count as empty; an empty text has no finding.  Rows with repeated or null ids are kept,
each with the findings of its text.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import shared_folder, stored

_ROW = ("blob string, rules array<struct<rule:string,version:int>>, "
        "spans array<struct<rule:string,version:int,start:long,end:long>>")


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group ``group`` (0: the whole
    match) has at least ``least`` characters.  A change of the rule needs a new ``version``."""
    name: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1


def either_case(word: str) -> str:
    """A pattern for an ASCII word whose letters may be in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ["password", "passwd", "secret", "token", "api_?key"]))
# The base rules.  A run of hex digits shorter than the least size is no match in
# the first place, which spares an array of all short runs.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=8, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
# Shapes of further secrets.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def blob_of(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _struct_of(rule: Rule) -> Column:
    return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"))


def _holds(rule: Rule):
    return lambda match: F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least


def matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, start, end): the findings in ``texts`` (blob, text, todo: the rules to
    apply).  Offsets count code points.

    A rule cuts the text into gaps and matches in turn; their lengths, added up, are the offsets.
    Only lengths leave the projection that reads the text, and a blob that occurs twice in
    ``texts`` counts once."""
    text = F.col("text")
    found = texts.select("blob", "text", *[
        F.when(F.array_contains("todo", _struct_of(r)), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).alias(f"m{k}")
        for k, r in enumerate(rules)])
    parts = [F.when(F.size(f"m{k}") > 0, F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
        F.transform(f"m{k}", F.length).alias("size"),
        F.transform(F.split(text, r.pattern, -1), F.length).alias("gap"),
        F.transform(f"m{k}", _holds(r)).alias("held")))
        for k, r in enumerate(rules)]
    lengths = found.select("blob", F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    lengths = lengths.dropDuplicates(["blob", "rule"])
    each = lengths.select("blob", "rule", "version", F.posexplode(F.arrays_zip("gap", "size", "held")).alias("pos", "p"))
    each = each.select("blob", "rule", "version", "pos", F.col("p.gap").cast("long").alias("gap"),
                       F.col("p.size").cast("long").alias("size"), F.col("p.held").alias("held")).where("size IS NOT NULL")
    upto = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return (each.withColumn("end", upto).where("held")
            .selectExpr("blob", "rule", "version", "end - size AS start", "end"))


class Ledger:
    """The ledger in the folder ``path``, which the executors must share; a missing folder is an
    empty ledger.  Two jobs may add to one ledger at a time: at worst both scan the same blob."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        """All rows, or None for an empty ledger."""
        try:
            return self.spark.read.schema(_ROW).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, id_cols: tuple[str, ...] = ("doc_id",),
               text_col: str = "text") -> DataFrame:
        """(blob, key, todo): the blobs that some of ``rules`` have not scanned, the key of one
        version that holds the blob, and these rules.  Texts are hashed, not moved."""
        blobs = versions.select(blob_of(F.col(text_col)).alias("blob"), F.xxhash64(*id_cols).alias("key"))
        blobs = blobs.groupBy("blob").agg(F.min("key").alias("key"))
        every = F.array(*map(_struct_of, rules))
        if (rows := self.rows()) is None:
            return blobs.withColumn("todo", every)
        done = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = F.array_except(every, F.coalesce("done", F.array().cast("array<struct<rule:string,version:int>>")))
        return blobs.join(done, "blob", "left").select("blob", "key", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, id_cols: tuple[str, ...] = ("doc_id",),
             text_col: str = "text") -> DataFrame:
        """Scan what is new in ``versions`` and add it to the ledger; the rows that were added.

        The text of a blob is found by the key of one of its versions too, so that a blob which a
        third of all rows hold is not brought to one task."""
        unseen = stored(self.unseen(versions, rules, id_cols, text_col))
        texts = versions.select(blob_of(F.col(text_col)).alias("blob"), F.xxhash64(*id_cols).alias("key"),
                                F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        found = matches(texts.join(unseen.hint("shuffle_hash"), ["blob", "key"]), rules)
        spans = found.groupBy("blob").agg(F.collect_list(F.struct("rule", "version", "start", "end")).alias("spans"))
        batch = f"{self.path}/batch-{uuid.uuid4().hex}"
        (unseen.join(spans, "blob", "left").select("blob", F.col("todo").alias("rules"), "spans")
         .write.parquet(batch))
        return self.spark.read.schema(_ROW).parquet(batch)

    def spans(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans array<struct<start, place, end, rule>>): by blob with a finding of ``rules``, all of
        them by start, then in the order of ``rules``."""
        place = F.array_position(F.array(*map(_struct_of, rules)), F.struct("s.rule", "s.version"))
        found = self.rows().where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
        found = found.select("blob", F.struct(F.col("s.start").alias("start"), place.alias("place"),
                                              F.col("s.end").alias("end"), F.col("s.rule").alias("rule")).alias("s"))
        return (found.where("s.place > 0").groupBy("blob")
                .agg(F.array_sort(F.collect_set("s")).alias("spans")))


def joined(spans: Column) -> Column:
    """``rule:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def findings(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES,
             id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per version (``id_cols``) and finding: rule, start, end.  What the ledger does not
    know yet is scanned first."""
    ledger.scan(versions, rules, id_cols, text_col)
    rows = versions.select(*id_cols, blob_of(F.col(text_col)).alias("_blob"))
    known = ledger.spans(rules).select(F.col("blob").alias("_blob"), F.inline("spans"))
    return rows.join(known, "_blob").select(*id_cols, "rule", "start", "end")


def report(versions: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text",
           base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per version: how often each base rule matched, the digest of the base spans, and all spans as
    text.  These are made once per blob and joined to all versions that hold it."""
    rules = (*base, *more)
    ledger.scan(versions, rules, (id_col,), text_col)

    def of(names):
        return F.filter("spans", lambda s: s["rule"].isin(*names))
    by_blob = ledger.spans(rules).select(
        F.col("blob").alias("_blob"), *[F.size(of([r.name])).cast("long").alias(f"_{r.name}") for r in base],
        joined(of([r.name for r in base])).alias("_base"), joined(F.col("spans")).alias("_all"))
    rows = versions.select(F.col(id_col).alias("_id"), blob_of(F.col(text_col)).alias("_blob"))
    return rows.join(by_blob, "_blob", "left").select(
        F.col("_id").alias(id_col), *[F.coalesce(f"_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in base],
        F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("_all", F.lit("")).alias("spans"))


def fresh_report(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`report` over a new ledger of its own."""
    spark = versions.sparkSession
    return report(versions, Ledger(spark, shared_folder(spark)), id_col, text_col)


def report_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The same rows as DuckDB SQL over the table ``documents``, scanning every row."""
    each = " UNION ALL ".join(
        f"""SELECT r, {k} AS place, '{rule.name}' AS rule, {rule.least} AS least,
            [length(regexp_extract(x, p, {rule.group})) for x in m] AS held, m, regexp_split_to_array(t, p) AS g
        FROM (SELECT r, t, p, regexp_extract_all(t, p) AS m FROM docs, (SELECT '{rule.pattern.replace("'", "''")}' AS p))"""
        for k, rule in enumerate(rules))
    names = ", ".join(f"'{r.name}'" for r in base)
    span = "rule || ':' || (stop - size) || ':' || stop"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS ({each}),
    each AS (SELECT r, place, rule, least, unnest(m) AS x, unnest(held) AS held, unnest(g[:len(m)]) AS gap,
                    generate_subscripts(m, 1) AS i FROM cut WHERE len(m) > 0),
    placed AS (SELECT *, length(x) AS size, sum(length(gap) + length(x)) OVER (PARTITION BY r, place ORDER BY i) AS stop FROM each),
    spans AS (SELECT r, {", ".join(f"count(*) FILTER (rule = '{b.name}') AS n_{b.name}" for b in base)},
                     string_agg({span}, ',' ORDER BY stop - size, place) FILTER (rule IN ({names})) AS base,
                     string_agg({span}, ',' ORDER BY stop - size, place) AS every
              FROM placed WHERE held >= least GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{b.name}, 0) AS n_{b.name}" for b in base)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
    FROM docs LEFT JOIN spans USING (r)"""
