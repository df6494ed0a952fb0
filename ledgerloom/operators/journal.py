"""Deterministic two-line journal: a cash leg and a booking leg per row, with a suspense lane for what did not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.emit import row_id, signed_amount


def build(rows: DataFrame, booking: dict[str, str], cash: str = "Cash", suspense: str = "Suspense") -> DataFrame:
    """Add ``journal_lines``: positive amounts, direction only in ``is_debit``; the cash leg of a debit row is a credit.

    ``booking`` maps classifications (lower case) to accounts; other classifications go to ``suspense``.  A row without an amount gets no lines.
    """
    kind = F.lower(F.trim(F.coalesce(F.col("classification"), F.lit(""))))
    account = F.lit(suspense)
    for label, name in booking.items():
        account = F.when(kind == label.lower(), name).otherwise(account)
    value = signed_amount(rows)
    out = value < 0
    line = lambda debit, name: F.struct(row_id().alias("batch"), F.abs(value).cast("string").alias("amount"), debit.alias("is_debit"), name.alias("transaction_type"))
    return rows.withColumn("journal_lines", F.when(value.isNotNull() & (value != 0), F.array(line(~out, F.lit(cash)), line(out, account))))
