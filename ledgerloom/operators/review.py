"""Review workspace: fee recalculation, finding status, versions, evidence order, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import finding_priority

# Roles of files by extension and name, and of evidence by role and locator; the first hit counts.
DATA, PDF, ANY = r"\.(xlsx|csv)$", r"\.pdf$", ""
ROLES = (
    ("NAV_WORKBOOK", DATA, r"\bnav\b|administrator"), ("LPA", PDF, r"(^|[^a-z0-9])lpa([^a-z0-9]|$)|partnership.agreement"),
    ("SIDE_LETTER", ANY, r"side.?letter"), ("INVESTOR_REGISTER", DATA, r"investor|register|input"),
)
EVIDENCE = (
    (0, "SIDE_LETTER", r"section 3\.1"), (1, "NAV_WORKBOOK", r"![a-z]*f\d+\b"), (2, "INVESTOR_REGISTER", r"fee_base"),
    (3, "INVESTOR_REGISTER", r"side_letter_(expected|filename)"), (4, "LPA", r"section 8\.1"), (5, "INVESTOR_REGISTER", r"investor_name"),
)
UNREVIEWED, OTHER, LAST = "UNREVIEWED", "SUPPORTING", 10
EXTENSIONS, MAX_BYTES = ("pdf", "xlsx", "xls", "csv", "docx"), 25 << 20


def fee(findings: DataFrame) -> DataFrame:
    """A quarter of the yearly rate on the base against the administrator's figure; half a cent is no difference."""
    expected = (F.col("base").cast("decimal(20,2)") * F.col("rate").cast("decimal(10,4)") / 100 * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(30,8)")
    out = findings.withColumn("expected", expected).withColumn("difference", F.abs(F.col("administrator").cast("decimal(20,2)") - F.col("expected")).cast("decimal(30,8)"))
    return out.withColumn("status", F.when(F.col("difference") < F.lit("0.005").cast("decimal(10,8)"), "MATCH").otherwise("DISCREPANCY"))


def recomputed(findings: DataFrame) -> DataFrame:
    """Recalculate; the version goes up and the human state starts again."""
    return fee(findings).withColumn("version", F.coalesce("version", F.lit(0)) + 1).withColumn("human_state", F.lit(UNREVIEWED))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("human_state") == UNREVIEWED).alias("pending"))


def ready(findings: DataFrame) -> DataFrame:
    """One row: exceptions that nobody has decided on, and whether there are none."""
    open_ = F.count_if((F.col("status") != "MATCH") & (F.col("human_state") == UNREVIEWED))
    return findings.agg(open_.alias("pending_exceptions"), (open_ == 0).alias("ready"))


def _display(findings: DataFrame) -> list[Column | str]:
    """By status, then investor (where there is one), then id."""
    return [finding_priority("status"), *(c for c in ("investor_id", "id") if c in findings.columns)]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*_display(findings))


def next_exception(findings: DataFrame, after: str | None = None) -> DataFrame:
    """The first undecided exception after a finding, in display order; from the top if there is none after it."""
    w = Window.orderBy(*_display(findings))  # findings of one review
    f = findings.withColumn("k", F.row_number().over(w))
    here = f.where(F.col("id") == F.lit(after)).select("k").first() if after is not None else None
    at = here["k"] if here else 0
    return f.where((F.col("status") != "MATCH") & (F.col("human_state") == UNREVIEWED)).orderBy(F.col("k") <= at, "k").limit(1).drop("k")


def direction_text(difference: Column | str) -> Column:
    d = F.col(difference) if isinstance(difference, str) else difference
    shown = F.format_number(F.abs(d), 2)
    return F.when(d > 0, F.concat(shown, F.lit(" above"))).when(d < 0, F.concat(shown, F.lit(" below"))).otherwise(shown)


def exportable(findings: DataFrame, version: int) -> DataFrame:
    """Findings of the version that an export was asked for; raises if a finding has moved on."""
    stale = F.raise_error(F.concat(F.lit("finding "), F.col("id"), F.lit(" is at version "), F.col("version").cast("string")))
    return findings.where(F.when(F.col("version") == version, True).otherwise(stale.cast("boolean")))


def evidence_priority(evidence: DataFrame) -> Column:
    """Rank of evidence by role and locator: what a finding rests on comes first; a null role or locator is last."""
    rank = F.lit(LAST)
    for k, role, pattern in reversed(EVIDENCE):
        rank = F.when((F.col("role") == role) & F.lower("locator").rlike(pattern), k).otherwise(rank)
    return rank


def evidence_order(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("priority", evidence_priority(evidence)).orderBy("finding_id", "priority", "position")


def role_guess(name: Column | str) -> Column:
    """Role of a file by its name; ``SUPPORTING`` where no rule knows it."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F.lit(OTHER)
    for role, extension, pattern in reversed(ROLES):
        out = F.when(n.rlike(extension) & n.rlike(pattern), role).otherwise(out)
    return out


def recognised(role: Column | str) -> Column:
    return (F.col(role) if isinstance(role, str) else role) != OTHER


def label_text(code: Column | str) -> Column:
    """A check's code in words: what a prefix with a colon says goes, underscores become spaces, and the first letter is large."""
    c = F.col(code) if isinstance(code, str) else code
    words = F.trim(F.replace(F.regexp_replace(c, r"^[^:]+:\s*", ""), F.lit("_"), F.lit(" ")))
    shown = F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("Verification check"))


def accepted_files(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Uploads with ``problem``: extension, size, or a copy (name and size) of an existing or earlier file."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    k = F.row_number().over(Window.partitionBy("name", "bytes").orderBy("position"))
    f = files.withColumn("k", k)
    if existing is not None:
        f = f.join(existing.select("name", "bytes").distinct().withColumn("there", F.lit(True)), ["name", "bytes"], "left")
    else:
        f = f.withColumn("there", F.lit(None).cast("boolean"))
    copy = F.coalesce("there", F.lit(False)) | (F.col("k") > 1)
    problem = F.when(~ext.isin(*EXTENSIONS), "EXTENSION").when(F.col("bytes") > MAX_BYTES, "SIZE").when(copy, "DUPLICATE")
    return f.withColumn("problem", problem).drop("k", "there")


def missing_roles(required: DataFrame, documents: DataFrame) -> DataFrame:
    """Required roles that no recognised document has."""
    return required.join(documents.where("recognised").select("role").distinct(), "role", "left_anti")


def can_start(required: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: no role is missing and every document is confirmed."""
    from ledgerloom.operators.corpus_checks import one_row

    one = one_row(missing_roles(required, documents).agg(F.count(F.lit(1)).alias("missing")), documents.agg(F.count_if(~F.col("confirmed")).alias("unconfirmed")))
    return one.withColumn("can_start", (F.col("missing") == 0) & (F.col("unconfirmed") == 0))


def manifest(files: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected roles joined by client id, with ``valid``: as many as files, and all ids distinct."""
    n = detected.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("client_id").alias("d")).first()
    valid = n["n"] == n["d"] == files.count()
    return files.join(detected, "client_id", "left").withColumn("valid", F.lit(bool(valid)))


def reviewed(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply human updates (``id, state, note``): version up, note kept if not blank, the computed status untouched."""
    u = updates.select("id", F.col("state").alias("__s"), F.trim(F.coalesce("note", F.lit(""))).alias("__n"))
    j = findings.join(u, "id", "left")
    notes = F.coalesce("notes", F.array().cast("array<string>"))
    return (
        j.withColumn("version", F.col("version") + F.col("__s").isNotNull().cast("int")).withColumn("human_state", F.coalesce("__s", "human_state"))
        .withColumn("notes", F.when(F.coalesce(F.col("__n") != "", F.lit(False)), F.concat(notes, F.array("__n"))).otherwise(notes)).drop("__s", "__n")
    )


def progress(polls: DataFrame, stages: list[str]) -> DataFrame:
    """State of each stage from the number of polls."""
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("stage")) for i, s in enumerate(stages)])
    state = F.when(F.col("k") < F.col("polls"), "complete").when(F.col("k") == F.col("polls"), "active").otherwise("pending")
    return polls.select("*", F.inline(pairs)).withColumn("state", state)


def metric_problems(metrics: DataFrame) -> DataFrame:
    """Extracted metrics that break their schema: a required field is missing or the confidence is out of range."""
    required = ("metric", "value", "document", "page", "confidence")
    bad = F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required], F.when(~F.col("confidence").between(0, 1), F.lit("confidence is out of range")))
    return metrics.select("*", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("problem"))


