"""Review payloads: paths of violations in lists, numbers as written, texts that are not JSON."""

import copy
import json

import pytest

from ledgerloom.operators import payload
from ledgerloom.review_catalog import SOUND


def found(spark, *docs):
    rows = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, payload string")
    return sorted(map(tuple, payload.payload_problems(rows).collect())), [r.id for r in payload.accepted(rows).select("id").collect()]


def changed(**fields):
    return copy.deepcopy(SOUND) | fields


def test_paths_in_lists_and_several_faults(spark):
    doc = copy.deepcopy(SOUND)
    doc["findings"] = [doc["findings"][0], {**doc["findings"][0], "evidence": [], "notes": [{"id": "x"}, 5], "versions": []}, "odd"]
    doc["documents"] = []
    got, sound = found(spark, SOUND, doc, changed(version="1", outputCapabilities=None))
    assert got == sorted([
        (1, "$.findings[1].notes[0].author", "not a text"), (1, "$.findings[1].notes[0].body", "not a text"), (1, "$.findings[1].notes[0].createdAt", "not a text"), (1, "$.findings[1].notes[1]", "not an object"),
        (1, "$.findings[1].versions", "an empty list"), (1, "$.findings[2]", "not an object"), (2, "$.outputCapabilities", "not an object"), (2, "$.version", "not a positive whole number"),
    ])
    assert sound == [0]


@pytest.mark.parametrize("text,ok", [("3", True), ("3.0", True), ("30e-1", True), ("3.5", False), ("0", False), ("-1", False), ('"3"', False), ("true", False), ("null", False), ("12345678901234567890123", True)])
def test_whole_numbers_as_written(spark, text, ok):
    assert found(spark, json.dumps(changed(version="@")).replace('"@"', text))[0] == ([] if ok else [(0, "$.version", payload.SAID["positive"])])


def test_unknown_fields_missing_options_and_texts_that_are_no_json(spark):
    doc = changed(extra={"a": [1]})
    del doc["sourceNotice"], doc["findings"][0]["calculation"], doc["documents"][0]["fileCount"]
    got, sound = found(spark, doc, None, "", "{", "[]", "5", changed(id="﻿  "))
    assert got == [(1, "$", "not JSON"), (2, "$", "not JSON"), (3, "$", "not JSON"), (4, "$", "not an object"), (5, "$", "not an object"), (6, "$.id", "not a text")] and sound == [0]


def test_only_leaves_are_asked_for_their_schema():
    """An object's schema takes a walk through all that it holds, so asking at each level takes one walk per level."""
    leaves = lambda rule: sum(map(leaves, [r for _, r in rule.fields] + [rule.item] * (rule.item is not None))) or 1
    assert payload._violations(payload.REVIEW, "p", "'$'").count("schema_of_variant") == leaves(payload.REVIEW)
