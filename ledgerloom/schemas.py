"""Record types, which the parser's output is held against, and status vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 2)
STATUSES = ("MATCH", "PROBABLE", "UNRESOLVED", "CANNOT_VERIFY", "FAIL")
NAMES_A_TARGET = ("MATCH", "PROBABLE")
SETTLED = ("MATCH", "CANNOT_VERIFY")
FINDING_ORDER = ("DISCREPANCY", "CANNOT_VERIFY", "UNSUPPORTED", "MATCH")

PROVENANCE = T.StructType().add("page", T.IntegerType()).add("x0", T.DoubleType()).add("top", T.DoubleType()).add("x1", T.DoubleType()).add("bottom", T.DoubleType())
RESOLUTION = T.StructType().add("status", "string").add("matched_name", "string").add("table", "string").add("confidence", T.DoubleType()).add("why", "string")
JOURNAL_LINE = T.StructType().add("batch", "string").add("amount", "string").add("is_debit", "boolean").add("transaction_type", "string")
EVENT = T.StructType().add("kind", "string").add("label", "string").add("detail", "string").add("status", "string").add("body", "string").add("meta", T.MapType(T.StringType(), T.StringType())).add("at", T.DoubleType())
STATEMENT_ROW = (
    T.StructType()
    .add("scope", "string").add("row_index", T.IntegerType())
    .add("account_number", "string").add("currency", "string").add("bank_reference", "string").add("customer_reference", "string")
    .add("trn_type", "string").add("value_date", "string").add("post_date", "string").add("time", "string")
    .add("credit", MONEY).add("debit", MONEY).add("balance", MONEY).add("narrative", "string").add("provenance", PROVENANCE).add("narrative_provenance", PROVENANCE)
)
STATEMENT = (
    T.StructType()
    .add("scope", "string").add("source_file", "string").add("account_name", "string").add("account_number", "string").add("currency", "string")
    .add("bank_name", "string").add("iban", "string").add("bic", "string").add("date_range", "string").add("closing_balance", MONEY)
    .add("printed_openings", T.MapType(T.StringType(), MONEY)).add("page_text", T.ArrayType(T.StringType()))
)
EXCEPTION = T.StructType().add("scope", "string").add("row_index", T.IntegerType()).add("kind", "string").add("detail", "string")
RUN_SUMMARY = (
    T.StructType()
    .add("run_id", "string").add("account", "string").add("source_file", "string").add("profile", "string").add("model", "string")
    .add("summary", "string").add("attempts", T.LongType()).add("accepted", "boolean").add("rows", T.LongType()).add("seconds", T.DoubleType())
)
EXTRACTED_METRIC = (
    T.StructType()
    .add("metric", "string", False).add("value", T.DoubleType(), False).add("unit", "string").add("period", "string").add("entity", "string")
    .add("document", "string", False).add("page", T.IntegerType(), False).add("snippet", "string").add("confidence", T.DoubleType(), False).add("notes", "string")
)
