"""From positioned words to statement rows.

Input is a words table: ``doc, page, text, x0, x1, top, bottom``.  A page holds a few hundred words, so work that depends on the order within
a page is an array fold per page; everything else is joins and aggregations by ``(doc, page)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import amount, let
from ledgerloom.schemas import MONEY, STATEMENT, STATEMENT_ROW

TOLERANCE = 1.5
# The words that open the statement's columns, and the account block of page 1.
HEADERS = {
    "bank_reference": "Bank", "customer_reference": "Customer", "trn_type": "TRN", "value_date": "Value",
    "credit": "Credit", "debit": "Debit", "balance": "Balance", "time": "Time", "post_date": "Post",
}
DETAILS = {
    "Account name": "account_name", "Account number": "account_number", "Bank name": "bank_name", "Currency": "currency", "IBAN": "iban", "BIC": "bic",
    "Specified date range": "date_range", "Closing ledger balance brought forward": "closing_balance",
}
BLOCKS = (((30, 175), (175, 450)), ((450, 650), (650, 10_000)))
DATE = r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"
MARKER = r"^Balance (as at close|brought forward) (\d{1,2} [A-Z][a-z]{2} \d{4})"
AMOUNT = r"-?[\d,]+\.\d{2}"


def pages_of(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: ``doc, page`` and ``lines``, arrays of words; a word joins the line whose *first* word is within ``tolerance`` of its top."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, w: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(w["top"] - acc["anchor"]) > tolerance)
        at = F.when(new, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"])
        return F.struct(F.when(new, w["top"].cast("double")).otherwise(acc["anchor"]).alias("anchor"), (acc["i"] + 1).cast("int").alias("i"), at.alias("at"))

    cut = lambda w, at: F.transform(at, lambda s, k: F.slice(w, s + 1, F.coalesce(F.get(at, k + 1), F.size(w)) - s))
    every = F.array_sort(F.collect_list(F.struct("top", "x0", "text", "x1", "bottom")))
    return words.groupBy("doc", "page").agg(let(every, lambda w: let(F.aggregate(w, start, step, lambda acc: acc["at"]), lambda at: cut(w, at))).alias("lines"))


def lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Words with ``line`` numbers, as ``pages_of`` cuts them."""
    each = pages_of(words, tolerance).select("doc", "page", F.posexplode("lines").alias("line", "words"))
    return each.select("doc", "page", "line", F.inline("words")).select("doc", "page", "line", "text", "x0", "x1", "top", "bottom")


def _joined(order: str = "x0") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")


def line_texts(lined: DataFrame) -> DataFrame:
    """Text and box of every line."""
    return lined.groupBy("doc", "page", "line").agg(_joined().alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def bands(lined: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Column bands of each page, from the first line that has all header words: ``doc, page, name, k, lo, hi`` (the last one is open)."""
    names = F.create_map(*[x for name, word in headers.items() for x in (F.lit(word), F.lit(name))])
    order = F.create_map(*[x for i, name in enumerate(headers) for x in (F.lit(name), F.lit(i))])
    at = lined.withColumn("name", F.try_element_at(names, F.col("text"))).where("name IS NOT NULL")
    starts = at.groupBy("doc", "page", "line", "name").agg((F.max("x0") - 1.0).alias("lo"))  # a word that is there twice: the last
    per_line = starts.groupBy("doc", "page", "line").agg(F.collect_list(F.struct(F.try_element_at(order, F.col("name")).alias("k"), "name", "lo")).alias("s"))
    first = per_line.where(F.size("s") == len(headers)).groupBy("doc", "page").agg(F.array_sort(F.min_by("s", "line")).alias("s"))
    edges = F.transform("s", lambda b, i: F.struct(b["name"].alias("name"), b["k"].alias("k"), b["lo"].alias("lo"), F.coalesce(F.get("s", i + 1)["lo"], F.lit(float("inf"))).alias("hi")))
    return first.select("doc", "page", F.inline(edges))


def column_positions(lined: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Where the columns of each page start; pages without a header line have none."""
    return bands(lined, headers).select("doc", "page", "name", (F.col("lo") + 1.0).alias("x0"))


def cells(lined: DataFrame, page_bands: DataFrame) -> DataFrame:
    """Text of each line in each band, by left edges (half open): ``doc, page, line, name, value``.

    A page's bands, as many as its columns, come to its words as one array; of several that hold a word the first counts.
    """
    of_page = page_bands.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi", "name"))).alias("bands"))
    hit = F.get(F.filter("bands", lambda b: (F.col("x0") >= b["lo"]) & (F.col("x0") < b["hi"])), F.lit(0))
    found = lined.join(of_page, ["doc", "page"]).withColumn("name", hit["name"]).where("name IS NOT NULL")
    return found.groupBy("doc", "page", "line", "name").agg(_joined().alias("value"))


def between(lined: DataFrame, lo: float, hi: float) -> DataFrame:
    """Text of each line within a half-open x range."""
    return lined.where((F.col("x0") >= lo) & (F.col("x0") < hi)).groupBy("doc", "page", "line").agg(_joined().alias("text"))


def page_texts(lined: DataFrame) -> DataFrame:
    """Text of every page, and how many pages each document has."""
    per_line = line_texts(lined)
    page = per_line.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return page.withColumn("pages", F.max("page").over(Window.partitionBy("doc")))


def _text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _edges(page_lines: Column, headers: dict[str, str]) -> Column:
    """``lo, hi`` of a page's columns, in the order of ``headers``, from its first line that has all their words; null without one."""
    asked = F.array(*map(F.lit, headers.values()))
    header = F.get(F.filter(page_lines, lambda line: F.size(F.array_except(asked, F.transform(line, lambda w: w["text"]))) == 0), F.lit(0))
    starts = lambda line: F.transform(asked, lambda word: F.array_max(F.transform(F.filter(line, lambda w: w["text"] == word), lambda w: w["x0"])) - 1.0)
    bounds = lambda lo: F.transform(lo, lambda x, i: F.struct(x.alias("lo"), F.coalesce(F.get(lo, i + 1), F.lit(float("inf"))).alias("hi")))
    return F.when(header.isNotNull(), let(let(header, starts), bounds))


def _cells(line: Column, edges: Column, n: int) -> Column:
    """Texts of a line (words from left to right) in each of ``n`` columns; null if no column holds a word.  Of several that hold one, the first counts."""
    column = lambda w: F.array_position(F.transform(edges, lambda b: F.coalesce((w["x0"] >= b["lo"]) & (w["x0"] < b["hi"]), F.lit(False))), True)
    held = F.filter(F.transform(line, lambda w: F.struct(column(w).alias("k"), w["text"].alias("text"))), lambda w: w["k"] > 0)
    each = lambda ws: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: _text(F.filter(ws, lambda w: w["k"] == k)))
    return let(held, lambda ws: F.when(F.size(ws) > 0, each(ws)))


def _details(page_lines: Column, fields: dict[str, str], blocks=BLOCKS) -> Column:
    """The account block as a struct of ``fields``; of equal labels the last counts, blocks from left to right."""
    within = lambda line, lo, hi: _text(F.filter(line, lambda w: (w["x0"] >= lo) & (w["x0"] < hi)))
    pair = lambda line, label, value: F.struct(within(line, *label).alias("label"), within(line, *value).alias("value"))
    pairs = F.flatten(F.transform(page_lines, lambda line: F.array(*[pair(line, *b) for b in blocks])))
    found = F.filter(pairs, lambda p: p["label"].isin(*fields) & (p["value"] != ""))
    last = lambda ps, label: F.try_element_at(F.filter(ps, lambda p: p["label"] == label), F.lit(-1))["value"]
    return let(found, lambda ps: F.struct(*[last(ps, label).alias(name) for label, name in fields.items()]))


def _openings(page_lines: Column) -> Column:
    """Printed openings among a page's lines: ``day, page, line, value``."""
    printed = F.filter(page_lines, lambda x: x["cells"].isNotNull() & x["text"].startswith("Balance brought forward") & x["text"].rlike(MARKER))
    value = lambda x: amount(F.try_element_at(F.regexp_extract_all(x["text"], F.lit(AMOUNT), F.lit(0)), F.lit(-1))).cast(MONEY)
    all_ = F.transform(printed, lambda x: F.struct(F.regexp_extract(x["text"], MARKER, 2).alias("day"), F.col("page").alias("page"), x["line"].alias("line"), value(x).alias("value")))
    return F.filter(all_, lambda x: x["value"].isNotNull())


def _page_table(words: DataFrame, headers: dict[str, str]) -> DataFrame:
    """One row per page: ``doc, page`` and ``lines`` with number, text, box, cells and (the first line of page 1) the account block as ``info``.

    Words move once, to the task of their document; all else happens where they are.
    """
    sides = lambda line: F.array_sort(F.transform(line, lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"), w["top"].alias("top"), w["x1"].alias("x1"), w["bottom"].alias("bottom"))))
    of = lambda line, f, c: f(F.transform(line, lambda w: w[c])).alias(c)
    shown = lambda ls, edges: F.transform(ls, lambda line, i: F.struct(
        i.alias("line"), _text(line).alias("text"), of(line, F.array_min, "x0"), of(line, F.array_min, "top"), of(line, F.array_max, "x1"), of(line, F.array_max, "bottom"),
        F.when(edges.isNotNull(), _cells(line, edges, len(headers))).alias("cells"), F.when((F.col("page") == 1) & (i == 0), _details(ls, DETAILS)).alias("info"),
    ))
    whole = lambda ls: let(_edges(ls, headers), lambda edges: shown(ls, edges))
    return pages_of(words.repartition("doc")).select("doc", "page", let(F.transform("lines", sides), whole).alias("lines"))


def _rows(pages: DataFrame, headers: dict[str, str], scope: Column, stem: Column) -> DataFrame:
    """Statement rows: a line that starts one, and the narrative lines that follow while it is open."""
    each = pages.select("doc", "page", F.inline("lines"))
    each = each.select("doc", "page", "line", "info", "text", "x0", "top", "x1", "bottom", F.col("cells").isNotNull().alias("held"), *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(headers)])
    marker = F.col("held") & F.col("text").rlike(MARKER)
    each = each.withColumn("marker", marker).withColumn("starts", F.col("held") & ~marker & F.col("value_date").rlike(DATE) & amount("balance").isNotNull())
    each = each.withColumn("told", F.col("held") & ~F.col("marker") & ~F.col("starts") & (F.trim("bank_reference") == "Narrative"))
    each = each.where("marker OR starts OR told OR info IS NOT NULL")
    # The row that is open at a line: the last start, unless a marker came after it.
    order = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("starts"), F.struct("page", "line")).when(F.col("marker"), F.struct(F.lit(-1).alias("page"), F.lit(-1).alias("line")))
    whole = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("open", F.last(event, ignorenulls=True).over(order)).withColumn("info", F.first("info", ignorenulls=True).over(whole))
    box = F.struct(F.col("page").cast("int").alias("page"), "x0", "top", "x1", "bottom")
    rest = F.concat_ws(" ", *[F.nullif(F.col(h), F.lit("")) for h in headers if h != "bank_reference"])
    head = F.first(F.when(F.col("starts"), F.struct(box.alias("box"), "info", *headers)), ignorenulls=True)
    told = F.when(F.col("told"), F.struct("page", "line", rest.alias("t"), box.alias("box")))
    per_row = each.where("starts OR (told AND open.page >= 0)").groupBy("doc", F.col("open.page").alias("page"), F.col("open.line").alias("line")).agg(head.alias("head"), F.array_sort(F.collect_list(told)).alias("told"))
    rows = per_row.withColumn("row_index", (F.row_number().over(Window.partitionBy("doc").orderBy("page", "line")) - 1).cast("int"))
    rows = rows.select("doc", "row_index", "head.*", "told")
    return rows.select(
        scope.alias("scope"), "row_index", F.col("info.account_number").alias("account_number"), F.coalesce("info.currency", F.try_element_at(stem, F.lit(-2))).alias("currency"), "bank_reference", "customer_reference", "trn_type", "value_date",
        "post_date", "time", amount("credit").alias("credit"), amount("debit").alias("debit"), amount("balance").alias("balance"), F.trim(F.array_join(F.transform("told", lambda x: x["t"]), " ")).alias("narrative"),
        F.col("box").alias("provenance"), F.try_element_at("told", F.lit(-1))["box"].alias("narrative_provenance"),
    )


def _statements(pages: DataFrame, scope: Column) -> DataFrame:
    """One row per document: account block, openings (of a day, the last) and the text of every page."""
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    per_page = pages.select("doc", "page", F.get("lines", F.lit(0))["info"].alias("info"), text.alias("text"), _openings(F.col("lines")).alias("opened"))
    per_doc = per_page.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"), F.first("info", ignorenulls=True).alias("info"), F.array_sort(F.flatten(F.collect_list("opened"))).alias("opened"))
    last = F.filter("opened", lambda x, i: ~x["day"].eqNullSafe(F.get("opened", i + 1)["day"]))
    openings = F.map_from_entries(F.transform(last, lambda x: F.struct(x["day"], x["value"])))
    return per_doc.select(
        scope.alias("scope"), F.col("doc").alias("source_file"), *[F.col(f"info.{c}").alias(c) for c in ("account_name", "account_number", "currency", "bank_name", "iban", "bic", "date_range")],
        amount("info.closing_balance").cast(MONEY).alias("closing_balance"), openings.alias("printed_openings"), F.transform("pages", lambda x: x["text"]).alias("page_text"),
    )


def parse(words: DataFrame, headers: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Statements and rows of a words table.  ``scope`` is the last two ``_`` parts of the document's file stem."""
    headers = headers or HEADERS
    pages = _page_table(words, headers)
    stem = F.split(F.regexp_replace("doc", r"\.[^.]*$", ""), "_")
    scope = F.concat_ws("_", F.try_element_at(stem, F.lit(-2)), F.element_at(stem, -1))
    return _statements(pages, scope).to(STATEMENT), _rows(pages, headers, scope, stem).to(STATEMENT_ROW)
