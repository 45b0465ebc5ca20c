"""Manual entries (S9) and recurring rules (S10) as ledger rows.

Recurring expansion is one ``sequence`` + ``explode`` per spec row (no driver loop). A spec is a few
bytes and may stand for hundreds of rows, so that a scan task's specs would make a task of any size:
specs are counted by the steps they make and spread over tasks of about ``TASK_STEPS``. Monthly
steps are ``add_months(start, k)`` from the start date, so Jan 31 gives Feb 28 then Mar 31.
The end defaults to ``as_of`` (today) even when ``count`` is set; ``count`` caps the rows.
Invalid specs (unknown cadence, count <= 0, missing start) go to a quarantine frame (D14).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.schema import MONEY

SPEC_SCHEMA = ("description STRING, merchant STRING, amount DOUBLE, cadence STRING, start_date STRING, "
               "end_date STRING, count BIGINT")
TASK_STEPS = 250_000  # steps that a task expands, on average
MANUAL_SCHEMA = "date STRING, description STRING, merchant STRING, amount DOUBLE"


def _to_date(c):
    return F.coalesce(F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd"), F.try_to_date(F.trim(c), "yyyy-M-d"))


def manual_entries(spark: SparkSession, entries) -> tuple[DataFrame, DataFrame]:
    """A list of dicts (or a DataFrame with MANUAL_SCHEMA columns) -> (ledger rows, bad rows).
    Defaults: description '', merchant '', amount 0.0; provider ``manual``; missing date -> bad."""
    if isinstance(entries, DataFrame):
        df = entries
    else:
        rows = [(None if e.get("date") in (None, "") else str(e.get("date")), e.get("description", ""),
                 e.get("merchant", ""), float(e.get("amount", 0.0) or 0.0), i) for i, e in enumerate(entries or [])]
        df = spark.createDataFrame(rows, MANUAL_SCHEMA + ", seq BIGINT")
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.lit(0).cast("bigint"))
    parsed = df.select(
        _to_date(F.col("date").cast("string")).alias("date"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("merchant"), F.lit("")).alias("merchant"),
        F.coalesce(F.col("amount").cast(MONEY), F.lit(0).cast(MONEY)).alias("amount"),
        F.lit(None).cast("string").alias("category"), F.lit("manual").alias("provider"),
        "seq", F.col("date").cast("string").alias("raw_date"))
    good = parsed.filter(F.col("date").isNotNull()).drop("raw_date")
    bad = parsed.filter(F.col("date").isNull()).select("description", "merchant", "raw_date",
                                                       F.lit("missing or unparsable date").alias("reason"))
    return good, bad


def recurring_specs(spark: SparkSession, specs) -> DataFrame:
    if isinstance(specs, DataFrame):
        return specs
    rows = [(s.get("description", ""), s.get("merchant", ""), float(s.get("amount", 0.0) or 0.0), s.get("cadence"),
             None if s.get("start_date") is None else str(s.get("start_date")),
             None if s.get("end_date") is None else str(s.get("end_date")),
             None if s.get("count") is None else int(s.get("count")), i) for i, s in enumerate(specs or [])]
    return spark.createDataFrame(rows, SPEC_SCHEMA + ", spec_id BIGINT")


def expand_recurring(specs: DataFrame, as_of: date | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Spec rows -> (ledger rows with provider ``recurring``, bad specs)."""
    as_of_col = F.lit(str(as_of or date.today())).cast("date")
    if "spec_id" not in specs.columns:
        specs = specs.withColumn("spec_id", F.xxhash64(*[F.col(c) for c in specs.columns]))
    s = specs
    s = s.select("*", _to_date(F.col("start_date").cast("string")).alias("__start"),
                 F.coalesce(_to_date(F.col("end_date").cast("string")), as_of_col).alias("__end"))
    cadence = F.col("cadence")
    reason = (F.when(cadence.isNull(), F.lit("missing cadence"))
              .when(~cadence.isin("daily", "weekly", "monthly"), F.concat(F.lit("unsupported cadence "), cadence))
              .when(F.col("__start").isNull(), F.lit("missing start_date"))
              .when(F.col("count").isNotNull() & (F.col("count") <= 0), F.lit("count must be > 0")))
    s = s.withColumn("__reason", reason)
    good = s.filter(F.col("__reason").isNull())
    n_days = F.datediff("__end", "__start")
    # candidate steps between start and end (monthly gets one spare: a clamped month end can
    # still fit); the date filter below is the exact rule, then count caps the rows
    n_cand = (F.when(cadence == "daily", n_days + 1)
              .when(cadence == "weekly", F.floor(n_days / 7) + 1)
              .otherwise(F.floor(F.months_between("__end", "__start")) + 2).cast("int"))
    # no step from ``count`` on is made
    if_valid = F.when(F.col("__start") <= F.col("__end"), F.least(n_cand, F.col("count")).cast("int")).otherwise(F.lit(0))
    good = good.withColumn("__steps", if_valid).filter(F.col("__steps") > 0)
    tasks = -(-(good.agg(F.sum("__steps")).first()[0] or 0) // TASK_STEPS)
    if tasks > 1:
        good = good.repartition(tasks)
    stepped = good.select("*", F.explode(F.sequence(F.lit(0), F.col("__steps") - 1)).alias("k"))
    day = (F.when(cadence == "daily", F.date_add("__start", F.col("k")))
           .when(cadence == "weekly", F.date_add("__start", F.col("k") * 7))
           .otherwise(F.add_months("__start", F.col("k"))))
    rows = (stepped.withColumn("date", day)
            .filter((F.col("date") <= F.col("__end")) & (F.col("count").isNull() | (F.col("k") < F.col("count"))))
            .select("date", F.coalesce("description", F.lit("")).alias("description"),
                    F.coalesce("merchant", F.lit("")).alias("merchant"),
                    F.coalesce(F.col("amount").cast(MONEY), F.lit(0).cast(MONEY)).alias("amount"),
                    F.lit(None).cast("string").alias("category"), F.lit("recurring").alias("provider"),
                    "spec_id", F.col("k").cast("bigint").alias("seq")))
    bad = s.filter(F.col("__reason").isNotNull()).select("spec_id", "description", "merchant", "cadence",
                                                         F.col("__reason").alias("reason"))
    return rows, bad
