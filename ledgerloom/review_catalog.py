"""Registered queries of the review workspace: payloads with every kind of fault, and readiness."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import query, table
from ledgerloom.operators import payload
from ledgerloom.operators.payload import SAID, Rule

SOUND = {
    "id": "R", "version": 3, "mode": "LIVE_MODEL", "source": "ATLAS", "fundName": "F", "periodLabel": "Q1", "createdAt": "2026-01-01", "sourceNotice": "",
    "documents": [{"id": "d", "filename": "a.pdf", "role": "LPA", "recognition": "MISSING", "fileCount": 0}],
    "findings": [{
        "id": "f", "investorId": "i", "investorName": "n", "checkName": "c", "administratorValue": {"amount": 1.5, "currency": "EUR"}, "expectedValue": {"amount": -2, "currency": "EUR"}, "difference": {"amount": 0, "currency": "EUR"},
        "status": "MATCH", "severity": "INFO", "confidence": {"label": "HIGH", "score": 0.5, "basis": "b"}, "humanReviewState": "REVIEWED", "explanation": "e",
        "calculation": {"inputs": [{"label": "l", "value": ""}], "expression": "x", "result": {"amount": 1, "currency": "EUR"}},
        "evidence": [{"id": "e", "documentId": "d", "filename": "a", "documentRole": "LPA", "sourceKind": "PDF", "locator": "p1", "quote": "q", "value": "v", "context": ""}],
        "checksPerformed": [{"id": "k", "label": "l", "state": "COMPLETE"}], "challengerConcern": "", "verifierStatement": "s", "requiredAction": {"label": "l", "documentRole": "LPA"},
        "notes": [{"id": "n", "author": "a", "body": "b", "createdAt": "c"}], "versions": [{"version": 1, "createdAt": "c", "reason": "r", "applicableRate": 2.0, "expectedValue": {"amount": 3, "currency": "EUR"}}],
    }],
    "outputCapabilities": {"pdf": True, "excel": False, "json": True, "emailPrepare": True, "emailSend": False, "termCorrection": True},
}


def leaves(rule: Rule, at: tuple = ()) -> list[tuple[tuple, Rule]]:
    """Every value of the sound payload with its rule; of a list, the first item."""
    out = [(at, rule)]
    for name, r in rule.fields:
        out += leaves(r, (*at, name))
    return out + (leaves(rule.item, (*at, 0)) if rule.item else [])


WRONG = {
    "text": [" \t", 5, None], "string": [7, None, []], "number": ["1", True, None], "positive": [0, 1.5, "2", None], "count": [-1, 0.5, "0"], "flag": ["true", 1, None], "choice": ["OTHER", 3, None], "record": [[], "x", None], "items": [{}, "x", None],
}
GONE = object()


def _changed(at: tuple, value: object) -> str:
    doc = json.loads(json.dumps(SOUND))
    if not at:
        return json.dumps(value)
    inner = doc
    for step in at[:-1]:
        inner = inner[step]
    if value is GONE:
        del inner[at[-1]]
    else:
        inner[at[-1]] = value
    return json.dumps(doc)


def payloads() -> list[str]:
    """The sound payload, and one for each value with each fault it can have: of another kind, out of range, null, or missing."""
    out = [json.dumps(SOUND), "{", ""]
    for at, rule in leaves(payload.REVIEW):
        faults = WRONG[rule.kind] + ([GONE] if at and isinstance(at[-1], str) else []) + ([[]] if rule.least else [])
        out += [_changed(at, f) for f in faults]
    return out


def _dotted(at: tuple) -> str:
    return "$" + "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in at)


def _rules() -> str:
    rows = [(_dotted(at), _dotted(at[:-1]) if at else None, r.kind, r.needed, r.least, "|" + "|".join(r.choices) + "|") for at, r in leaves(payload.REVIEW)]
    show = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).upper()
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


PAYLOADS = payloads()
TEXTS = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PAYLOADS) + "]"
PROBLEM = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAID.items()) + " END"


@query(
    f"""WITH f AS (SELECT unnest({TEXTS}) AS text, generate_subscripts({[0] * len(PAYLOADS)}, 1) - 1 AS n),
    s AS (SELECT n, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM f),
    r AS (SELECT * FROM (VALUES {_rules()}) AS t(path, parent, kind, needed, least, choices)),
    x AS (SELECT n, path, kind, needed, least, choices, json_extract(j, path) AS v, coalesce(json_type(j, path), 'NONE') AS t, parent, coalesce(json_type(j, parent), 'NONE') AS above FROM s CROSS JOIN r WHERE j IS NOT NULL),
    y AS (SELECT *, json_extract_string(v, '$') AS txt, t IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS num, TRY_CAST(json_extract_string(v, '$') AS DOUBLE) AS d FROM x),
    z AS (SELECT *, CASE kind WHEN 'text' THEN t = 'VARCHAR' AND trim(txt, ' ' || chr(9)) <> '' WHEN 'string' THEN t = 'VARCHAR' WHEN 'number' THEN num WHEN 'positive' THEN num AND d > 0 AND d = floor(d) WHEN 'count' THEN num AND d >= 0 AND d = floor(d)
        WHEN 'flag' THEN t = 'BOOLEAN' WHEN 'choice' THEN t = 'VARCHAR' AND contains(choices, '|' || txt || '|') WHEN 'record' THEN t = 'OBJECT' ELSE t = 'ARRAY' END AS holds FROM y),
    b AS (SELECT n, path, {PROBLEM} AS problem FROM z WHERE (parent IS NULL OR (above = 'OBJECT' AND NOT path LIKE '%]') OR (above = 'ARRAY' AND path LIKE '%]' AND t <> 'NONE')) AND (CASE WHEN t = 'NONE' THEN needed ELSE NOT holds END)
      UNION ALL SELECT n, path, '{SAID["least"]}' FROM z WHERE t = 'ARRAY' AND json_array_length(v) < least UNION ALL SELECT n, '$', '{SAID["json"]}' FROM s WHERE j IS NULL)
    SELECT o_orderkey, path, problem FROM orders JOIN b ON o_orderkey % {len(PAYLOADS)} = n"""
)
def review_payload_problems(spark: SparkSession, sf: str) -> DataFrame:
    shapes = F.array(*map(F.lit, PAYLOADS))
    made = table(spark, sf, "orders").select("o_orderkey", F.element_at(shapes, (F.col("o_orderkey") % len(PAYLOADS) + 1).cast("int")).alias("payload"))
    return payload.payload_problems(made)
