"""Readers, writers, judges, jobs and the stream of results."""

import bz2
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.operators import judge, order
from textloom.plans import round_trips, studies
from textloom.sources import readers, sinks
from textloom.streaming import results

XML = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title>User talk:A</title><ns>3</ns><id>1</id><revision><timestamp>2024-01-01T00:00:00Z</timestamp><contributor><username>U</username></contributor><text bytes="5">hello</text></revision></page>
<page><title>Main</title><ns>0</ns><id>2</id><revision><text>x</text></revision></page>
<page><title>User talk:B</title><ns>3</ns><id>3</id><revision><contributor><ip>1.2.3.4</ip></contributor><text/></revision></page>
<page><title>User talk:C</title><ns>3</ns><id>4</id></page>
</mediawiki>"""


def scenario_file(path):
    head = 'baseline,c1,hedged_baseline,c2,politeness question,left of slider,right of slider,predicate question,,"Speaker,S1,S2"\r\n'
    rows = [f'"P{i} says, ""It is [modifier] cold,""\r\nand waits.","P{i} tells, ""It is [modifier] cold""","P{i} says, ""Sorry [modifier] cold""",,How polite is P{i} being?,l,r,How cold is P{i} feeling?,,"P{i},{",".join(str(k) for k in range(10))}"\r\n' for i in range(3)]
    path.write_bytes((head + "".join(rows)).encode())


def test_scenarios(spark, tmp_path):
    scenario_file(tmp_path / "s.csv")
    rows = readers.scenarios(spark, str(tmp_path / "s.csv")).orderBy("scenario_id").collect()
    assert [r["scenario_id"] for r in rows] == [0, 1, 2] and rows[0]["baseline"] == 'P0 says, "It is [modifier] cold,"\r\nand waits.'
    assert rows[1]["predicate"] == "cold" and rows[0]["c2"] is None
    packed = readers.slider_settings(readers.scenarios(spark, str(tmp_path / "s.csv")))
    assert packed.count() == 30 and packed.filter("scenario_id = 1 and modifier = 'quite' and setting = 2").first()["value"] == 5


def test_talk_pages(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(XML.encode()))
    pages = studies.extract_talk_pages(spark, str(tmp_path / "d.xml.bz2"))
    assert {tuple(r) for r in pages.collect()} == {("1", "User talk:A", "2024-01-01T00:00:00Z", "U", "hello"), ("3", "User talk:B", None, None, None)}
    sinks.write_json_lines(pages, str(tmp_path / "out"), bzip2=True)
    again = readers.talk_page_lines(spark, str(tmp_path / "out"))
    assert set(map(tuple, again.collect())) == set(map(tuple, pages.collect()))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.bz2") for x in bz2.decompress(f.read_bytes()).decode().splitlines()]
    assert all(set(x) == {"page_id", "title", "timestamp", "last_editor", "text"} for x in lines)
    assert {r["page_id"] for r in readers.typed_talk_pages(again).collect()} == {1, 3}


def test_utterances(spark, tmp_path):
    rows = [{"id": "u1", "text": "a bit x", "meta": {"Normalized Score": "0.5"}}, {"id": "u2", "text": "none", "meta": {}}]
    (tmp_path / "u.jsonl").write_text("\n".join(map(json.dumps, rows)))
    read = readers.utterances(spark, str(tmp_path / "u.jsonl"))
    assert [tuple(r) for r in studies.utterance_list(read).collect()] == [("a bit x", 0.5)]
    assert [r[0] for r in studies.utterance_list(read, literal=True).collect()] == ["none"]
    sinks.write_csv(studies.utterance_list(read), str(tmp_path / "csv"), one_file=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "Utterance,Normalized Score\na bit x,0.5\n"


def requests_of(spark, tmp_path):
    from textloom.operators import design

    scenario_file(tmp_path / "s.csv")
    return design.single_requests(readers.scenarios(spark, str(tmp_path / "s.csv")), 3, prompts.choice_prompt)


def test_jobs_replay_and_callable(spark, tmp_path):
    asked = requests_of(spark, tmp_path)
    provider = judge.FolderProvider(spark, judge.StubJudge())
    name = judge.submit(provider, asked, str(tmp_path / "r"), "study")
    table = judge.job_table(spark, provider).collect()
    assert [(r["job_name"], r["display_name"], r["ended"]) for r in table] == [(name, "study", True)]
    fetched = judge.fetch(spark, provider, name)
    assert fetched.count() == asked.count() == 90
    scenarios = readers.scenarios(spark, str(tmp_path / "s.csv"))
    stub = {tuple(r) for r in studies.choice_study(scenarios, 3, judge.StubJudge()).collect()}
    assert {tuple(r) for r in studies.choice_study(scenarios, 3, judge.ReplayJudge(fetched)).collect()} == stub
    # a missing, a malformed and a repeated answer change nothing else
    bad = fetched.filter("request_no <> 1").withColumn("raw", F.when(F.col("request_no") == 3, "oops").otherwise(F.col("raw")))
    broken = {(r["modifier"], r["scenario_id"]): (r["baseline"], r["hedge_baseline"]) for r in studies.choice_study(scenarios, 3, judge.ReplayJudge(bad.union(bad))).collect()}
    whole = {(r[2], r[1]): (r[4], r[5]) for r in stub}
    assert broken[("slightly", 0)] == (whole[("slightly", 0)][0][2:], whole[("slightly", 0)][1])
    assert {k: v for k, v in broken.items() if k != ("slightly", 0)} == {k: v for k, v in whole.items() if k != ("slightly", 0)}
    answered = judge.CallableJudge(lambda prompts: ['{"scenario_answer": "B"}'] * len(prompts), str(tmp_path / "asked"), 2).judge(asked)
    assert answered.filter("raw is not null").count() == 90


def test_result_stream(spark, tmp_path):
    line = lambda k, a: json.dumps({"key": k, "response": {"candidates": [{"content": {"parts": [{"text": json.dumps({"scenario_answer": a})}]}}]}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(f"{line('request-1', '(A)')}\n\n{line('request-2', 'B')}\n")
    (tmp_path / "in/b.jsonl").write_text(f"{line('request-1', '(A)')}\n")
    for _ in range(2):
        query = results.write_answers(results.result_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["key"], r["scenario_answer"]) for r in found) == [("request-1", "A"), ("request-2", "B")]


def test_rating_shuffle_is_mapped_back(spark, tmp_path):
    scenario_file(tmp_path / "s.csv")
    scenarios = readers.scenarios(spark, str(tmp_path / "s.csv"))

    class Echo:
        def judge(self, requests):
            return requests.withColumn("raw", F.concat(F.lit("["), F.array_join("order", ","), F.lit("]")))

    plain, shuffled = (sorted(map(tuple, studies.rating_study(scenarios, 3, Echo(), seed=s).collect())) for s in (None, "x"))
    assert plain == shuffled and plain[0][4] == "0, 0, 0, "
    assert sorted(r["modifier"] for r in studies.rating_study(scenarios, 3, Echo(), literal=True).collect()) == sorted("extre" * 3)


def test_counts_and_lines(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2 == 0).alias("even"))
    watched, seen = sinks.counted(df, even=F.col("even"))
    watched.write.parquet(str(tmp_path / "w"))
    assert seen.get == {"rows": 10, "even": 5}
    assert sinks.shown(df, "id", 2) == ["0 True", "1 False"]
    bars = {r["label"]: r["frequency"] for r in sinks.frequency_bars(df.select(F.col("even").cast("string").alias("even")), "even").collect()}
    assert bars == {"true": 0.5, "false": 0.5}
    flags = spark.createDataFrame([(2, False), (1, True)], "request_no int, swapped boolean")
    assert sinks.swap_flags(flags).first()["swapped"] == [True, False]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name, folder", [("utterance_scan", "utterances"), ("first_contexts", "talk")])
def test_files_grow_in_number(spark, monkeypatch, tmp_path, name, folder):
    monkeypatch.setattr(round_trips, "_path", lambda spark, name: str(tmp_path / name))
    dealt = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in dealt}
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        getattr(round_trips, name)(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list(Path(tmp_path, folder).glob("part-*.json"))) > 5  # as many as Spark deals, not a fixed number that each get more


def test_seq_is_dealt_once(spark, capsys):
    rows = spark.createDataFrame([(k % 50 if k % 7 else None, k) for k in range(300)], "a int, b int").repartition(5)
    numbered = order.with_seq(rows, "a", "b", start=3)
    numbered.explain()
    assert "row_number" not in capsys.readouterr().out  # which would shuffle all rows once more, some partitions into one task
    found = sorted((r["seq"], r["a"], r["b"]) for r in numbered.collect())
    want = sorted(((k % 50 if k % 7 else None, k) for k in range(300)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == [(i + 3, *r) for i, r in enumerate(want)]
    assert [r["seq"] for r in order.with_seq(rows.selectExpr("b", "null as none"), "b").orderBy("b").collect()] == list(range(300))
