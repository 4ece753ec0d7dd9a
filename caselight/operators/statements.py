"""Checks of bank statements: running and closing balances, digit statistics, amounts in sequence."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import DATED_LINE, amounts

STEP, CLOSE = Decimal("0.50"), Decimal("1.00")


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("page", "row_no")


def statement_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, amount, balance, raw) of lines that begin with a date: the last amount is the balance, the one before it the amount."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line")).where(F.col("line").rlike(DATED_LINE))
    found = lines.withColumn("found", amounts(F.col("line"))).where(F.size("found") > 0)
    return found.select("doc_id", F.lit(1).alias("page"), "row_no", F.try_element_at("found", F.lit(-2)).alias("amount"), F.try_element_at("found", F.lit(-1)).alias("balance"), F.trim("line").alias("raw"))


def checked_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kind``: debit or credit if the balance follows from the one before, error if neither, null without amount or predecessor."""
    before = F.lag("balance").over(in_order())
    debit, credit = F.abs(before - F.col("amount") - F.col("balance")) <= F.lit(STEP), F.abs(before + F.col("amount") - F.col("balance")) <= F.lit(STEP)
    return rows.withColumn("kind", F.when(before.isNull() | F.col("amount").isNull(), None).when(debit, "debit").when(credit, "credit").otherwise("error"))


def balance_errors(rows: DataFrame) -> DataFrame:
    """(doc_id, n_errors, first_rows): statements with rows that do not follow, and the first three of these rows."""
    bad = checked_rows(rows).where("kind = 'error'")
    return bad.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_errors"), F.slice(F.array_sort(F.collect_list("row_no")), 1, 3).alias("first_rows"))


def closing_check(rows: DataFrame) -> DataFrame:
    """(doc_id, expected, shown, difference): the opening balance and all movements against the closing balance; without movements nothing."""
    place = F.struct("page", "row_no")
    sums = checked_rows(rows).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min_by("balance", place).alias("opening"), F.max_by("balance", place).alias("shown"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(Decimal(0))).alias(k) for k in ("credit", "debit")],
    )
    moved = sums.where("n >= 2 AND NOT (credit = 0 AND debit = 0)").withColumn("expected", F.col("opening") + F.col("credit") - F.col("debit"))
    return moved.select("doc_id", F.col("expected").cast("decimal(18,2)").alias("expected"), "shown", F.abs(F.col("expected") - F.col("shown")).cast("decimal(18,2)").alias("difference"))


def balance_findings(rows: DataFrame) -> DataFrame:
    """(doc_id, name, severity) of both checks."""
    step = balance_errors(rows).select("doc_id", F.lit("Balance Calculation Error").alias("name"), F.lit("CRITICAL").alias("severity"))
    close = closing_check(rows).where(F.col("difference") > F.lit(CLOSE)).select("doc_id", F.lit("Opening/Closing Balance Mismatch").alias("name"), F.lit("HIGH").alias("severity"))
    return step.unionByName(close)


def first_digit(amount: Column) -> Column:
    return F.nullif(F.regexp_extract(F.abs(amount).cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def digit_table(rows: DataFrame) -> DataFrame:
    """(doc_id, digit_1 .. digit_9): how often amounts begin with each digit."""
    d = first_digit(F.col("amount"))
    return rows.groupBy("doc_id").agg(*[F.count_if(d == k).alias(f"digit_{k}") for k in range(1, 10)])


def amount_statistics(rows: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, n, ones, whole): the shares of amounts that begin with 1 and that are whole, and both verdicts."""
    whole = (F.col("amount") % 1 == 0).cast("double")
    ones = F.coalesce((first_digit(F.col("amount")) == 1).cast("double"), F.lit(0.0))
    sums = rows.where("amount IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(ones), 9).alias("ones"), F.round(F.avg(whole), 9).alias("whole"))
    return sums.withColumn("benford_anomaly", (F.col("n") >= least) & (F.col("ones") < 0.05)).withColumn("round_anomaly", F.col("whole") > 0.4)


def statistic_findings(rows: DataFrame) -> DataFrame:
    stats = amount_statistics(rows)
    kinds = F.array(F.when(F.col("benford_anomaly"), F.lit("Statistical Anomaly")), F.when(F.col("round_anomaly"), F.lit("Round Number Anomaly")))
    return stats.select("doc_id", F.explode(F.array_compact(kinds)).alias("name"), F.lit("MEDIUM").alias("severity"))


def triple_check(rows: DataFrame, share: float = 0.5, least_checks: int = 3, least_amounts: int = 5) -> DataFrame:
    """(doc_id, checks, mismatches, flagged) over every three amounts in sequence (doc_id, pos, amount)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    b, c = F.lead("amount", 1).over(w), F.lead("amount", 2).over(w)
    three = rows.withColumn("b", b).withColumn("c", c)
    a, b, c = F.col("amount"), F.col("b"), F.col("c")
    counted = (b > 0) & (c > 0)
    off = F.least(F.abs(a + b - c), F.abs(a - b - c), F.abs(b - a - c)) > F.lit(STEP)
    sums = three.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(counted).alias("checks"), F.count_if(counted & off).alias("mismatches"))
    return sums.where(F.col("n") >= least_amounts).select("doc_id", "checks", "mismatches", ((F.col("checks") >= least_checks) & (F.col("mismatches") > F.col("checks") * F.lit(share))).alias("flagged"))
