"""Column functions, parsers and votes on edge rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import fixed, prompts
from textloom.functions import text as tx
from textloom.operators import consensus, context, design, order, parse


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("out")).first()["out"]


def test_templates(spark):
    s = F.lit('Pat says, "The room is [modifier] cold," and waits.')
    assert one(spark, tx.unmodified(s)) == 'Pat says, "The room is cold," and waits.'
    assert one(spark, tx.modified(s, F.lit("kind of"))) == 'Pat says, "The room is kind of cold," and waits.'
    assert one(spark, tx.quoted(s)) == "The room is [modifier] cold,"
    assert one(spark, tx.quoted(F.lit("none"))) == ""
    assert one(spark, tx.word(F.lit("How cold is Terry feeling?"), 3)) == "Terry"
    assert one(spark, tx.word(F.lit("too short"), 3)) is None


@pytest.mark.parametrize("text", ["A. B!  C? D; E", "A.　B. C! D", "line.\nnext. ", "", "no end"])
def test_sentences_as_python(spark, text):
    assert one(spark, tx.sentences(F.lit(text))) == re.split(r"(?<=[.!?;])\s+", text)


@pytest.mark.parametrize("text", ["  a ", "　a ", "\n\ta b\n", "", "\u0085x"])
def test_strip_as_python(spark, text):
    assert one(spark, tx.stripped(F.lit(text))) == text.strip()


def test_filters(spark):
    rows = spark.createDataFrame([("a bit x",), ("x a bit",), ("none",), (None,)], "t string")
    t = F.col("t")
    assert [tuple(r) for r in rows.select(tx.contains_phrase(t, "A BIT"), tx.matches(t, "a bit"), tx.found_filter(t, "a bit"), tx.found_filter(t, "a bit", True)).collect()] == [
        (True, True, True, False), (True, True, True, True), (False, False, False, True), (False, False, None, None)]


def test_keys(spark):
    rows = spark.createDataFrame([("request-12-3",), ("request-hedge-2",), ("request-7-True",), ("other",), (None,)], "k string")
    assert [r[0] for r in rows.select(tx.request_number(F.col("k"))).collect()] == [12, 2, 7, None, None]
    assert one(spark, tx.without_suffix(F.lit("request-12-3"))) == "request-12"


def test_numbered_lines(spark):
    prompt = "Read:\n1. one\n2. two\n\n3.  three\nfooter"
    assert one(spark, tx.numbered_lines(F.lit(prompt))) == ["one", "two", "three", "footer"]
    assert one(spark, tx.numbered_lines(F.lit("nothing"))) == []
    assert one(spark, tx.line_at(F.lit(prompt), F.lit(1))) == "two"
    assert one(spark, tx.line_at(F.lit(prompt), F.lit(9))) == ""


@pytest.mark.parametrize("raw, want, literal", [
    ('```\n{"sentence_1": (False, "NA"), "sentence_2": (True, "a bit"), "sentence_3":(True,"The Only")}\n```', [(False, "NA"), (True, "a bit"), (True, "The Only")], [(False, "NA"), (True, "a bit"), (True, "the Only")]),
    ('{"s1": (False, NA), "s2":(True,NA)}', [(False, "NA"), (True, "NA")], [(False, "NA"), (True, "NA")]),
    ('{"s1": [1, "x"]}', [(True, "x")], [(True, "x")]),
    ('{"s1":(True,"x"),"s1":(False,"NA")}', [(False, "NA")], [(False, "NA")]),
    ('{"s1": (True, "NASA NA ok")}', [(True, "NASA NA ok")], None),
    ("no json", None, None), ('{"s1": (True)}', None, None), ('{"s1": 5}', None, None), (None, None, None),
])
def test_labels(spark, raw, want, literal):
    for mode, expected in ((False, want), (True, literal)):
        found = one(spark, parse.labels(F.col("r"), mode), r=raw)
        assert (None if found is None else [tuple(x) for x in found]) == expected


def test_answers(spark):
    raws = ['{"scenario_answer": "(A)"}', '{"scenario_answer": "((A))"}', '```{"scenario_answer": 5}```', "nothing", '{"other": "A"}', '{"scenario_answer": null}', None, '{"scenario_answer": "(A) Much colder"}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    found = parse.answers(rows).orderBy("i").collect()
    assert [r["scenario_answer"] for r in found] == ["A", "A", "5", None, None, None, None, "A) Much colder"]
    assert [r["scenario_answer_typed"] for r in found] == ["A", "A", "5", None, None, None, None, "A"]
    assert [r["parse_error"] is None for r in found] == [True, True, True, False, False, False, False, True]


def test_array_answers(spark):
    rows = spark.createDataFrame([("k", "so: [ 1, 22, 3 ]"), ("m", "no list"), ("n", "[1]")], "key string, raw string")
    found = {(r["key"], r["place"]): (r["answer"], r["parse_error"]) for r in parse.array_answers(rows, 3).collect()}
    assert found == {("k", 0): ("1", None), ("k", 1): ("22", None), ("k", 2): ("3", None), ("m", None): (None, "no list"), ("n", 0): ("1", "wrong length")}


def test_envelopes(spark):
    good = json.dumps({"key": "request-3", "response": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}})
    rows = spark.createDataFrame([(good,), ('{"key": "request-4", "response": {"candidates": []}}',), ("{broken",)], "line string")
    found = [(r["key"], r["request_no"], r["raw"], r["parse_error"] is None) for r in parse.envelopes(rows).collect()]
    assert found == [("request-3", 3, "hi", True), ("request-4", 4, None, False), (None, None, None, False)]


def test_votes(spark):
    rows = [(None, True, None), (None, None, True), (True, None, None), (None, None, None), (False, True, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    votes = df.select(consensus.any_true(*[F.col(c) for c in "abc"]), consensus.any_true(*[F.col(c) for c in "abc"], literal=True)).collect()
    assert [tuple(v) for v in votes] == [(True, False), (True, True), (True, True), (False, False), (True, True)]
    words = [("NA", "a bit", "really"), (None, "NA", "only"), ("NA", "NA", "NA"), (None, None, None), ("just", "NA", "very"), ("", "NA", "x")]
    df = spark.createDataFrame(words, "a string, b string, c string")
    assert [r[0] for r in df.select(consensus.first_word(*[F.col(c) for c in "abc"])).collect()] == ["a bit", "only", "NA", "NA", "just", ""]


def test_keep_first(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["p", "q", "p", None, None])], "seq int, t string")
    for n in (1, 4):
        assert sorted(r["seq"] for r in consensus.keep_first(df.repartition(n), ["t"]).collect()) == [0, 1, 3]


def test_request_numbers(spark):
    scenarios = spark.createDataFrame([(r, fixed.PREDICATES[r // 5], f'X{r} says, "It is [modifier] y"', f'X{r} says, "Sorry, [modifier] y"', f"How cold is X{r} feeling?", f"How polite is X{r} being?") for r in range(20)],
                                      "scenario_id long, predicate string, baseline string, hedged_baseline string, predicate_question string, politeness_question string")
    single = design.single_requests(scenarios, 20, prompts.choice_prompt).collect()
    assert sorted(r["request_no"] for r in single) == list(range(1, 601))
    keys = {r["request_no"]: r["key"] for r in single}
    assert keys[1] == "request-1" and keys[2] == "request-hedge-2" and keys[599] == "request-599" and keys[600] == "request-hedge-600"
    first = next(r for r in single if r["request_no"] == 1)["prompt"]
    assert first.startswith("\nPlease read") and 'If X0 was more polite and had said "It is slightly y" (adding "slightly") instead' in first and first.endswith("else.\n    ")
    paired = design.paired_requests(scenarios, 20).collect()
    assert sorted(r["request_no"] for r in paired) == list(range(1, 301)) and {r["swapped"] for r in paired} == {True, False}
    assert all(r["key"] == f"request-{r['request_no']}-{r['swapped']}" for r in paired)


@pytest.mark.parametrize("n, kept, literal", [(0, 0, 0), (29, 1, 0), (30, 1, 1), (31, 2, 1), (60, 2, 2)])
def test_chunks(spark, n, kept, literal):
    df = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("text"))
    assert design.chunks(df).count() == kept and design.chunks(df, keep_tail=False).count() == literal


def test_seq(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("v")).repartition(7)
    assert all(r["v"] == r["seq"] for r in order.with_seq(df, "v").collect())


def test_context_edges(spark):
    texts = ["Hit the. B. C. D. E.", "A. B. C. D. E the.", "one the", "a th. e b", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r["i"]: r for r in context.keyword_in_context(df, "the").collect()}
    assert set(found) == {0, 1, 2}
    assert (found[0]["before_context"], found[0]["after_context"], found[0]["sentence_position"]) == ("", "B. C. D.", "1/5")
    assert (found[1]["before_context"], found[1]["after_context"], found[1]["sentence_position"]) == ("B. C. D.", "", "5/5")
    assert found[2]["full_context"] == "one the"


def test_unswap(spark):
    df = spark.createDataFrame([(True, "A", "B"), (False, "A", "B")], "swapped boolean, scenario_1_answer string, scenario_2_answer string")
    assert [(r["baseline_answer"], r["hedged_answer"]) for r in consensus.unswapped(df).collect()] == [("B", "A"), ("A", "B")]
