"""Management reports kept current from changes (A2-A4, A9 over W1, W3-W6).

The state behind the reports is a few partial aggregates (counts and sums by a key) and the class rows, stored as
Parquet. A change of the model is a signed delta per table: the rows that come with sign +1 and those that go with -1 (an
update is both). ``fold`` adds a delta to the state: stored and signed values are united and aggregated again by the same
key, so the work is that of the state and the batch, never that of the tables. A report is then read from the state.

Counts and sums are exact in any order, a group whose rows are all gone disappears, and a hot key costs one row a task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.functions import text
from roster.operators.reports import SUM_MONEY
from roster.sources.tables import Tables

SIGN = "sign"
WIDE_MONEY = "decimal(28,2)"


@dataclass(frozen=True)
class Total:
    """Rows of a table counted by a key column (none: all together), with the sum of a column."""
    table: str
    key: str | None = None
    measure: str | None = None
    counted: str | None = None      # count only rows where this column isn't null

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for c in (self.key, self.measure, self.counted) if c))


TOTALS = {
    "students": Total("student", counted="person_id"),
    "instructors": Total("instructor", counted="person_id"),
    "sports": Total("sport", counted="id"),
    "enrolled": Total("enrollment", "class_id", counted="student_id"),
    "classes": Total("class_group", "sport_id", "capacity"),
    "invoices": Total("invoice", "status_id", "amount"),
    "plans": Total("plan", "period_id", "amount"),
    "load": Total("teaches", "instructor_id", counted="class_id"),
}
CLASS_ROWS = ("id", "name", "capacity", "sport_id")


def delta(gone: DataFrame | None = None, come: DataFrame | None = None) -> DataFrame:
    """The signed delta of a table."""
    parts = [df.withColumn(SIGN, F.lit(s)) for df, s in ((gone, -1), (come, 1)) if df is not None]
    return reduce(DataFrame.unionByName, parts)


def _signed(total: Total, rows: DataFrame) -> DataFrame:
    """(key, rows, n, amount) of signed rows: all rows, those counted, and the measure."""
    n = F.when(F.col(total.counted).isNotNull(), F.col(SIGN)) if total.counted else F.col(SIGN)
    amount = F.col(SIGN) * F.col(total.measure) if total.measure else F.lit(0)
    key = F.col(total.key).cast("bigint") if total.key else F.lit(None).cast("bigint")
    return rows.select(key.alias("key"), F.col(SIGN).cast("bigint").alias("rows"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
                       amount.cast(WIDE_MONEY).alias("amount"), F.lit(total.measure is not None).alias("measured"))


def _added(parts: DataFrame) -> DataFrame:
    return (parts.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("amount").cast(WIDE_MONEY).alias("amount"))
            .filter("rows <> 0"))


def _class_rows(parts: DataFrame) -> DataFrame:
    """The class rows that stay: the newest of each id, if it has more +1 than -1."""
    newest = F.max_by(F.struct(*CLASS_ROWS[1:]), F.struct(SIGN, "batch"))
    return (parts.groupBy("id").agg(F.sum(SIGN).alias("alive"), newest.alias("row")).filter("alive > 0")
            .select("id", "row.*"))


class ReportState:
    """The stored state, a folder per total and one for the class rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def total(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"key bigint, rows bigint, n bigint, amount {WIDE_MONEY}").parquet(f"{self.root}/{name}")

    def class_rows(self) -> DataFrame:
        return self.spark.read.schema("id bigint, name string, capacity int, sport_id int").parquet(f"{self.root}/class_rows")

    @classmethod
    def build(cls, t: Tables, root: str) -> "ReportState":
        """The state of whole tables."""
        state = cls(t.spark, root)
        for name, total in TOTALS.items():
            rows = t.get(total.table, *total.columns).withColumn(SIGN, F.lit(1))
            _added(_signed(total, rows)).write.parquet(f"{state.root}/{name}")
        t.get("class_group", *CLASS_ROWS).write.parquet(f"{state.root}/class_rows")
        return state

    def fold(self, deltas: Mapping[str, DataFrame], root: str) -> "ReportState":
        """The state after a change, in a new folder. Tables without a delta keep their totals."""
        new = ReportState(self.spark, root)
        for name, total in TOTALS.items():
            stored = self.total(name)
            if total.table in deltas:
                stored = _added(stored.unionByName(_signed(total, deltas[total.table]).drop("measured")))
            stored.write.parquet(f"{new.root}/{name}")
        rows = self.class_rows()
        if "class_group" in deltas:
            stored = rows.withColumn(SIGN, F.lit(1)).withColumn("batch", F.lit(0))
            batch = deltas["class_group"].select(*CLASS_ROWS, SIGN).withColumn("batch", F.lit(1))
            rows = _class_rows(stored.unionByName(batch))
        rows.write.parquet(f"{new.root}/class_rows")
        return new

    # ------------------------------------------------------------ reports

    def _all(self, name: str, column: str = "n"):
        return self.total(name).agg(F.coalesce(F.sum(column), F.lit(0)).cast("bigint")).scalar()

    def kpi(self, t: Tables) -> DataFrame:
        """As ``reports.kpi``; only the names of statuses come from the tables."""
        status = (t.dim("invoice_status", "id", "name").filter(F.col("name").isin(*text.OPEN_STATUSES))
                  .select(F.col("id").cast("bigint").alias("key")))
        still_open = self.total("invoices").join(status, "key").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).scalar()
        return self.spark.range(1).select(
            self._all("students").alias("students"), self._all("instructors").alias("instructors"),
            self._all("classes").alias("classes"), self._all("sports").alias("sports"),
            self._all("enrolled", "rows").alias("enrollments"), still_open.alias("open_invoices"),
            self._all("plans").alias("plans"), self._all("classes", "amount").alias("seats"))

    def occupancy(self, t: Tables, ordered: bool = True) -> DataFrame:
        """As ``reports.occupancy``; only the names of sports come from the tables."""
        sport = t.dim("sport", "id", "name").select(F.col("id").alias("sport_id"), F.col("name").alias("sport_name"))
        taken = self.total("enrolled").select(F.col("key").alias("class_id"), "n")
        rows = self.class_rows().join(sport, "sport_id").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"),
                                                                "sport_name", "capacity")
        out = rows.join(taken, "class_id", "left").select("class_id", "class_name", "sport_name", "capacity",
                                                          F.coalesce("n", F.lit(0)).alias("enrolled"))
        return out.orderBy(F.col("enrolled").desc(), "class_id") if ordered else out

    def _money(self, name: str, lookup: DataFrame, key: str, label: str, counted: str, ordered: bool) -> DataFrame:
        names = lookup.select(F.col("id").alias(key), F.col("name").alias(label))
        out = self.total(name).join(names, F.col("key") == F.col(key)).select(
            key, label, F.col("n").alias(counted), F.col("amount").cast(SUM_MONEY).alias("total"),
            text.brl(F.col("amount").cast(SUM_MONEY)).alias("total_brl"))
        return out.orderBy(F.col("total").desc_nulls_last(), key) if ordered else out

    def invoice_summary(self, t: Tables, ordered: bool = True) -> DataFrame:
        return self._money("invoices", t.dim("invoice_status", "id", "name"), "status_id", "status", "invoices", ordered)

    def plan_revenue(self, t: Tables, ordered: bool = True) -> DataFrame:
        return self._money("plans", t.dim("billing_period", "id", "name"), "period_id", "period", "plans", ordered)

    def instructor_load(self, t: Tables) -> DataFrame:
        """(instructor_id, classes) of instructors with classes."""
        return self.total("load").filter("n > 0").select(F.col("key").alias("instructor_id"), F.col("n").alias("classes"))
