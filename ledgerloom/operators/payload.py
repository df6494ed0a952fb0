"""Validation of review payloads: JSON text against a declared nested schema, with the path of every violation.

A payload is parsed once into a VARIANT, which keeps what was written: a number stays a number, a null is not a missing field.  The schema becomes one
expression over it, so documents are judged where they are read, without a shuffle and without stopping at the first fault.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import WHITE


@dataclass(frozen=True)
class Rule:
    """What a value must be: ``kind``, and what that takes; an optional field may be missing, but not null."""

    kind: str
    choices: tuple[str, ...] = ()
    fields: tuple[tuple[str, Rule], ...] = ()
    item: Rule | None = None
    least: int = 0
    needed: bool = True


TEXT, STRING, NUMBER, POSITIVE, COUNT, FLAG = (Rule(k) for k in ("text", "string", "number", "positive", "count", "flag"))
#: What is said of a value that breaks a rule.
SAID = {
    "text": "not a text", "string": "not a string", "number": "not a number", "positive": "not a positive whole number", "count": "not a whole number from 0 on", "flag": "not true or false",
    "choice": "not one of the choices", "record": "not an object", "items": "not a list", "least": "an empty list", "json": "not JSON",
}


def choice(*names: str) -> Rule:
    return Rule("choice", choices=names)


def record(**fields: Rule) -> Rule:
    return Rule("record", fields=tuple(fields.items()))


def items(item: Rule, least: int = 0) -> Rule:
    return Rule("items", item=item, least=least)


def optional(rule: Rule) -> Rule:
    return Rule(rule.kind, rule.choices, rule.fields, rule.item, rule.least, needed=False)


# Fields of a review and the names that they may take.
ROLES = choice("NAV_WORKBOOK", "LPA", "SIDE_LETTER", "INVESTOR_REGISTER", "SUPPORTING")
SUM = record(amount=NUMBER, currency=TEXT)
DOCUMENT = record(id=TEXT, filename=TEXT, role=ROLES, recognition=choice("RECOGNISED", "NEEDS_CONFIRMATION", "MISSING"), fileCount=optional(COUNT))
EVIDENCE = record(
    id=TEXT, documentId=TEXT, filename=TEXT, documentRole=ROLES, sourceKind=choice("PDF", "SPREADSHEET", "CSV", "TEXT"), locator=TEXT,
    quote=optional(STRING), value=optional(STRING), context=optional(STRING),
)
FINDING = record(
    id=TEXT, investorId=TEXT, investorName=optional(STRING), checkName=TEXT, administratorValue=optional(SUM), expectedValue=optional(SUM), difference=optional(SUM),
    status=choice("MATCH", "DISCREPANCY", "CANNOT_VERIFY", "UNSUPPORTED"), severity=optional(choice("NONE", "INFO", "WARNING", "CRITICAL")),
    confidence=optional(record(label=choice("HIGH", "MEDIUM", "LOW", "NOT_SCORED"), score=optional(NUMBER), basis=TEXT)),
    humanReviewState=choice("UNREVIEWED", "REVIEWED", "NEEDS_FOLLOW_UP", "TERM_CONFIRMED"), explanation=TEXT,
    calculation=optional(record(inputs=items(record(label=TEXT, value=STRING)), expression=TEXT, result=SUM)), evidence=items(EVIDENCE),
    checksPerformed=items(record(id=TEXT, label=TEXT, state=choice("COMPLETE", "CONCERN", "UNRESOLVED"))), challengerConcern=optional(STRING), verifierStatement=optional(STRING),
    requiredAction=optional(record(label=TEXT, documentRole=optional(ROLES))), notes=items(record(id=TEXT, author=TEXT, body=TEXT, createdAt=TEXT)),
    versions=items(record(version=POSITIVE, createdAt=TEXT, reason=TEXT, applicableRate=optional(NUMBER), expectedValue=optional(SUM)), least=1),
)
REVIEW = record(
    id=TEXT, version=POSITIVE, mode=choice("SYNTHETIC_DEMO", "LIVE_OFFLINE", "LIVE_MODEL"), source=choice("ATLAS", "DEVELOPMENT_FIXTURE"), sourceNotice=optional(STRING), fundName=TEXT, periodLabel=TEXT,
    createdAt=TEXT, documents=items(DOCUMENT), findings=items(FINDING),
    outputCapabilities=record(pdf=FLAG, excel=FLAG, json=FLAG, emailPrepare=FLAG, emailSend=FLAG, termCorrection=optional(FLAG)),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Does a value that is there (a VARIANT ``v`` of type ``k``) keep its rule?
NUMERIC = "(k rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' AND abs(try_variant_get(v, '$', 'double')) < double('infinity'))"
WHOLE = f"({NUMERIC} AND rint(try_variant_get(v, '$', 'double')) = try_variant_get(v, '$', 'double'))"
HOLDS = {
    "text": "k = 'STRING' AND regexp_replace(try_variant_get(v, '$', 'string'), " + _quoted(f"^(\ufeff|{WHITE})+$") + ", '') <> ''", "string": "k = 'STRING'", "number": NUMERIC,
    "positive": f"{WHOLE} AND try_variant_get(v, '$', 'double') > 0", "count": f"{WHOLE} AND try_variant_get(v, '$', 'double') >= 0", "flag": "k = 'BOOLEAN'",
    "choice": "k = 'STRING' AND try_variant_get(v, '$', 'string') IN (@)", }
FOUND = "array<struct<path:string,problem:string>>"


def _violations(rule: Rule, value: str, path: str) -> str:
    """``violations`` as the text of an expression; ``value`` and ``path`` are such texts too.  Names of an outer value are hidden by an inner one."""
    say = lambda what: f"array(named_struct('path', {path}, 'problem', {_quoted(SAID[what])}))"
    none = f"cast(array() AS {FOUND})"
    inside = none
    # Objects and lists are opened once, one level deep: that tells what they are without walking through all that they hold.
    if rule.kind in ("record", "items"):
        if rule.kind == "record":
            kind = "struct<" + ", ".join(f"`{name}`: variant" for name, _ in rule.fields) + ">"
            parts = (_violations(r, f"o.`{name}`", f"concat({path}, '.{name}')") for name, r in rule.fields)
            inside = f"concat({none}, {', '.join(parts)})"
        else:
            kind, depth = "array<variant>", path.count("string(i")
            each = f"transform(o, (x, i{depth}) -> {_violations(rule.item, 'x', f"concat({path}, '[', string(i{depth}), ']')")})"
            few = f"WHEN size(o) < {rule.least} THEN {say('least')}" if rule.least else ""
            inside = f"CASE {few} WHEN true THEN flatten({each}) END"
        missing = say(rule.kind) if rule.needed else none
        opened = f"get(transform(array(try_variant_get(v, '$', '{kind}')), o -> CASE WHEN o IS NULL THEN {say(rule.kind)} ELSE {inside} END), 0)"
        return f"get(transform(array({value}), v -> CASE WHEN v IS NULL THEN {missing} ELSE {opened} END), 0)"
    holds = HOLDS[rule.kind].replace("@", ", ".join(map(_quoted, rule.choices)))
    judged = f"CASE WHEN v IS NULL THEN {say(rule.kind) if rule.needed else none} WHEN get(transform(array(schema_of_variant(v)), k -> {holds}), 0) THEN {inside} ELSE {say(rule.kind)} END"
    return f"get(transform(array({value}), v -> {judged}), 0)"


def violations(rule: Rule, payload: str) -> Column:
    """``path, problem`` of everything in a column of JSON text that breaks a rule; a null and a text that is not JSON are one violation of the whole."""
    whole = f"array(named_struct('path', '$', 'problem', {_quoted(SAID['json'])}))"
    judged = _violations(rule, "p", "'$'")
    return F.expr(f"get(transform(array(try_parse_json(`{payload}`)), p -> CASE WHEN p IS NULL THEN {whole} ELSE {judged} END), 0)")


def payload_problems(payloads: DataFrame, column: str = "payload", rule: Rule = REVIEW) -> DataFrame:
    """Every violation of every payload, as a row with ``path`` and ``problem`` beside the other columns; sound payloads have none."""
    return payloads.select(*[c for c in payloads.columns if c != column], F.inline(violations(rule, column)))


def accepted(payloads: DataFrame, column: str = "payload", rule: Rule = REVIEW) -> DataFrame:
    """Payloads that keep every rule."""
    return payloads.where(F.size(violations(rule, column)) == 0)
