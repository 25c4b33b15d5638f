"""Strict parsing, side tables, early stop, malformed files, ledgers, dynamic meta and votes on streams."""

import bz2
import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import whole_json
from textloom.operators import consensus, judge, parse
from textloom.plans import studies
from textloom.sources import numbering, readers
from textloom.streaming import votes

from .test_sources import scenario_file

PAYLOADS = [
    '{"scenario_answer":"A"}', '{"scenario_answer":"A"}] [{"b":2}', '{"scenario_answer":"A"}, "x": {"b":2}', '{"scenario_answer":"A"}} {"b":{"c":1}', '{"a":"A","a":"B"}', "{'a':'A'}", '{"a":"A"} y {"b":2}',
    '{"a":"A",}', '{"a":"x\ny"}', '{"a":01}', "{}", '{"a":{"b":[1,2}}', '{"a":1}{"b":1}', '{"a":1}/*x*/', "", "  ", '{"a":"\\u00e9"}', '{"a":"\\x"}', "[1,2] x [3]", '[1,[2],"a",null]', "[1 2]", "[]", '[1,2],"v":[3]',
    '{"a":tru}', '{"a":1e5,"b":-0.0,"c":[]}', '"s"', "5", "nul", "null", ' \n{"a": 1}\t', '{"v":1,"w":2}', "{", "}", "]", '1,"v":2', '{"a":"}"}', '["]"]', "[1,2", "1]", "{a:1}",
]


def test_whole_json_is_as_strict_as_a_decoder(spark):
    def loads(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(p,) for p in [*PAYLOADS, None]], "p string")
    found = {r["p"]: r["w"] for r in rows.select("p", whole_json(F.col("p")).alias("w")).collect()}
    assert {p: w is not None for p, w in found.items()} == {p: loads(p) for p in PAYLOADS} | {None: False}
    assert all(w in (None, p) for p, w in found.items())


def test_reasons(spark):
    rows = spark.createDataFrame([("k1", '{"scenario_answer":"A"}] [{"b":2}'), ("k2", '{"scenario_answer":"A","scenario_answer":"(B)"}'), ("k3", '{"x":1}'), ("k4", None), ("k5", '{"scenario_answer":"(C)"}')], "key string, raw string")
    found = {r["key"]: (r["scenario_answer"], r["parse_error"]) for r in parse.answers(rows).collect()}
    assert found == {"k1": (None, parse.NO_OBJECT), "k2": ("B", None), "k3": (None, parse.NO_FIELD), "k4": (None, parse.NO_ANSWER), "k5": ("C", None)}
    lists = spark.createDataFrame([("a", "[1, 2] x [3]"), ("b", "[1, 2]"), ("c", "[1, 2, 3]"), ("d", "[1]")], "key string, raw string")
    assert {r["key"]: (r["answers"], r["parse_error"]) for r in parse.list_answers(lists, 2).collect()} == {"a": (None, parse.NO_LIST), "b": (["1", "2"], None), "c": (None, parse.WRONG_LENGTH), "d": (None, parse.WRONG_LENGTH)}
    assert {r["key"]: r["answers"] for r in parse.list_answers(lists, 2, cut=True).collect()} == {"a": None, "b": ["1", "2"], "c": ["1", "2"], "d": None}
    labels = spark.createDataFrame([("a", '{"s1": 5}'), ("b", "none"), ("c", '{"s1": (True, "x")}'), ("d", None)], "key string, raw string")
    assert {r["key"]: r["parse_error"] for r in parse.label_answers(labels).collect()} == {"a": parse.NO_PAIR, "b": parse.NO_OBJECT, "c": None, "d": parse.NO_ANSWER}
    lines = spark.createDataFrame([('{"key":"request-1"} x',), ('{"key":"request-1"}',)], "line string")
    assert [r["parse_error"] for r in parse.envelopes(lines).collect()] == [parse.NOT_JSON, parse.NO_ANSWER]


def test_two_outputs_of_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", '{"scenario_answer":"A"}' if i % 3 else "none", i) for i in range(30)], "key string, raw string, rejected int")
    out = parse.with_rejects(parse.answers(rows), "answers", str(tmp_path / "out"))
    assert (out.n_good, out.n_rejected) == (20, 10) == (out.good.count(), out.rejected.count())
    assert {tuple(r) for r in out.rejected.collect()} == {("answers", f"k{i}", "none", parse.NO_OBJECT) for i in range(0, 30, 3)}
    assert sorted(r["rejected"] for r in out.good.collect()) == [i for i in range(30) if i % 3] and "parse_error" not in out.good.columns
    empty = parse.with_rejects(parse.answers(rows.limit(0)), "answers", str(tmp_path / "none"))
    assert (empty.n_good, empty.n_rejected, empty.good.count(), empty.rejected.count()) == (0, 0, 0, 0)


def test_ratings_of_another_length_are_rejected(spark, tmp_path):
    scenario_file(tmp_path / "s.csv")
    scenarios = readers.scenarios(spark, str(tmp_path / "s.csv"))

    class Odd:
        """The first attempt's list is one short, the second's one too long."""
        def judge(self, requests):
            listed = F.transform("order", lambda s: s.cast("string"))
            short = F.when(F.col("attempt") == 0, F.slice(listed, 1, F.size(listed) - 1)).when(F.col("attempt") == 1, F.concat(listed, F.array(F.lit("9")))).otherwise(listed)
            return requests.withColumn("raw", F.concat(F.lit("["), F.array_join(short, ","), F.lit("]")))

    from textloom.operators import design

    items = design.rating_items(scenarios, 3)
    parsed = parse.with_rejects(studies.rating_answers(studies.rating_requests(items), Odd()), "ratings", str(tmp_path / "r"))
    assert {(r["key"], r["reason"]) for r in parsed.rejected.collect()} == {("rating-1", parse.WRONG_LENGTH), ("rating-2", parse.WRONG_LENGTH)}
    table = {tuple(r) for r in studies.rating_table(items, parsed.good).collect()}
    assert table == {tuple(r) for r in studies.rating_study(scenarios, 3, Odd()).collect()} and all(r[4].count(", ") == 1 for r in table)
    assert all(r[4].count(", ") == 2 for r in studies.rating_study(scenarios, 3, Odd(), literal=True).collect())


def test_good_answers_make_the_same_table(spark, tmp_path):
    from textloom.functions import prompts
    from textloom.operators import design

    scenario_file(tmp_path / "s.csv")
    scenarios = readers.scenarios(spark, str(tmp_path / "s.csv"))
    requests = design.single_requests(scenarios, 3, prompts.choice_prompt)

    class Some:
        def judge(self, asked):
            return asked.withColumn("raw", F.when(F.col("scenario_id") == 1, "none").otherwise(judge.stub_answer(F.col("key"))))

    parsed = parse.with_rejects(studies.choice_answers(requests, Some()), "choices", str(tmp_path / "c"))
    assert parsed.n_rejected == 30
    assert {tuple(r) for r in studies.choice_table(requests, parsed.good).collect()} == {tuple(r) for r in studies.choice_study(scenarios, 3, Some()).collect()}


def talk_line(i, text):
    return json.dumps({"page_id": str(i), "title": "t", "timestamp": "x", "last_editor": None, "text": text})


def test_search_ends_with_the_files_it_needs(spark, tmp_path):
    for f in range(8):
        lines = [talk_line(10 * f + i, f"One. The phrase here {i}. Two.") for i in range(3)]
        (tmp_path / f"part-{f}.json").write_text("\n".join(lines if f < 3 else ["{broken"]) + "\n")
    found = studies.first_contexts(spark, str(tmp_path), "phrase", 6).orderBy("place").collect()
    assert [r["page_id"] for r in found] == ["0", "1", "2", "10", "11", "12"]
    assert [r["page_id"] for r in studies.first_contexts(spark, str(tmp_path), "phrase", 2).collect()] == ["0", "1"]
    with pytest.raises(Exception, match="malformed line in .*part-[3-6].json"):
        studies.first_contexts(spark, str(tmp_path), "phrase", 10).collect()


def test_first_pages_of_a_dump(spark, tmp_path):
    page = "<page><title>User talk:{0}</title><ns>3</ns><id>{0}</id>{1}</page>"
    revision = "<revision><timestamp>t</timestamp><text>x</text></revision>"
    for f in range(4):
        pages = "".join(page.format(10 * f + i, revision if i else "") for i in range(3))
        (tmp_path / f"d{f}.xml.bz2").write_bytes(bz2.compress((f"<mediawiki>{pages}</mediawiki>" if f < 3 else "<mediawiki><page><ns>3</id></page></mediawiki>").encode()))
    assert sorted(r["page_id"] for r in studies.extract_talk_pages(spark, str(tmp_path), max_pages=5).collect()) == ["1", "11", "2"]
    with pytest.raises(Exception):
        readers.wiki_pages(spark, str(tmp_path)).collect()
    kept = readers.wiki_pages(spark, str(tmp_path), corrupt="bad").collect()
    assert sum(r["bad"] is not None for r in kept) == 1 and len(kept) == 10


def test_malformed_lines(spark, tmp_path):
    good = talk_line(1, "x")
    (tmp_path / "a.json").write_text(f"{good}\n\n{{broken\n{good}\n{good} {{}}\n")
    with bz2.open(tmp_path / "b.json.bz2", "wt") as f:
        f.write(f"[1]\n{good}\n")
    found = {(os.path.basename(r["file"]), r["line_no"], r["line"]) for r in readers.malformed_lines(spark, str(tmp_path)).collect()}
    assert found == {("a.json", 3, "{broken"), ("a.json", 5, good + " {}"), ("b.json.bz2", 1, "[1]")}
    rows = readers.talk_page_records(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["file"]), r["line_no"]) for r in rows if r["corrupt_record"] is None) == [("a.json", 1), ("a.json", 4), ("b.json.bz2", 2)]
    assert all((r["page_id"] is None) == (r["corrupt_record"] is not None) for r in rows)
    with pytest.raises(Exception, match=r"malformed line in file:.*(a.json: \{broken|b.json.bz2: \[1\])"):
        readers.talk_page_lines(spark, str(tmp_path)).select("title").collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    (tmp_path / "b.txt").write_text("x\n\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = [(os.path.basename(r["file"]), r["line_no"], r["value"]) for r in readers.in_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == sorted([("a.txt", i, f"line {i}") for i in range(1, 2001)] + [("b.txt", 1, "x"), ("b.txt", 2, ""), ("b.txt", 3, "y")])


def test_appended_files_keep_old_numbers(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    assert numbering.numbered_lines(spark, str(folder), ledger).count() == 0
    (folder / "m.txt").write_text("a\nb\n")
    (folder / "n.txt").write_text("c\n")
    seen = lambda: {r["value"]: r["seq"] for r in numbering.numbered_lines(spark, str(folder), ledger).collect()}
    assert seen() == {"a": 0, "b": 1, "c": 2}
    (folder / "a.txt").write_text("d\ne\n")
    assert seen() == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4} == seen()
    assert numbering.ledger(spark, ledger).count() == 3
    (folder / "n.txt").write_text("c\nnew\n")
    with pytest.raises(ValueError, match="n.txt has changed"):
        seen()


def test_stopped_run_asks_only_what_is_missing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    requests = spark.createDataFrame([(f"k{i}", f"prompt {i}") for i in range(40)] + [("k1", "prompt 1")], "key string, prompt string")

    def answer(prompts, folder=str(calls)):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        if "prompt 7" in prompts and not os.path.exists(f"{folder}/again"):
            open(f"{folder}/again", "w").close()
            raise ConnectionError("gone")
        return [f"answer to {p}" for p in prompts]

    def asked():
        return [line for f in calls.iterdir() for line in f.read_text().splitlines()]

    asker = judge.LedgerJudge(answer, str(tmp_path / "ledger"), parallel=2, attempts=3, waves=3, batch=5)
    half = requests.filter("cast(substr(key, 2) as int) < 20")
    assert asker.ask(half) == 20 and sorted(asked()) == sorted(f"prompt {i}" for i in range(20))
    failed = asker.ledger(spark).filter("raw is null").collect()
    assert 1 <= len(failed) <= 5 and all("ConnectionError: gone" in r["error"] for r in failed)
    found = {(r["key"], r["raw"]) for r in asker.judge(requests).collect()}
    assert found == {(f"k{i}", f"answer to prompt {i}") for i in range(40)}
    assert len(asked()) == 40 + len(failed)
    assert asker.judge(requests).count() == 41 and len(asked()) == 40 + len(failed)
    changed = spark.createDataFrame([("k1", "another prompt")], "key string, prompt string")
    assert asker.judge(changed).first()["raw"] == "answer to another prompt" and asked().count("another prompt") == 1


def test_retries_are_bounded(spark, tmp_path):
    def answer(prompts):
        raise ValueError("never")

    requests = spark.createDataFrame([("a", "x"), (None, "y"), ("b", None)], "key string, prompt string")
    asker = judge.LedgerJudge(answer, str(tmp_path / "ledger"), parallel=1, attempts=2, waves=1)
    assert {r["raw"] for r in asker.judge(requests).collect()} == {None}
    assert asker.ledger(spark).count() == 6 and asker.ask(requests) == 0
    short = judge.LedgerJudge(lambda prompts: [], str(tmp_path / "short"), parallel=1, attempts=1, waves=1)
    assert short.ask(requests) == 3 and {r["error"] for r in short.ledger(spark).collect()} == {"0 answers to 3 prompts"}


def result(key, text):
    return json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}})


def run_votes(spark, tmp_path):
    query = votes.write_votes(votes.votes(votes.judged_questions(votes.label_stream(spark, str(tmp_path / "in"), 1))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(180)
    assert query.exception() is None
    return sorted((r["question"], r["place"], r["is_modifier"], r["modifier_word"], r["complete"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_votes_on_arriving_results(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, day, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / "in" / name, (1_700_000_000 + 86_400 * day,) * 2)

    put("a", 0, result("request-1-1", '{"s1": (False, "NA"), "s2": (True, "a bit")}'), result("request-4-1", '{"s1": (True, "only")}'), "{broken")
    put("b", 0.1, result("request-2-2", '{"s1": (True, "just"), "s2": (True, "quite")}'), result("request-2-2", '{"s1": (False, "NA")}'))
    assert run_votes(spark, tmp_path) == []
    put("c", 0.2, result("request-3-3", "no labels"), result("request-5-2", '{"s1": (False, "NA")}'))
    first = [(0, 0, True, "just", True), (0, 1, True, "a bit", True)]
    assert run_votes(spark, tmp_path) == first
    put("d", 0.3, result("request-1-1", '{"s1": (True, "again")}'))
    assert run_votes(spark, tmp_path) == first
    put("e", 5, result("request-7-1", '{"s1": (False, "NA")}'))
    put("f", 9, result("request-10-1", '{"s1": (False, "NA")}'))
    assert [r for r in run_votes(spark, tmp_path) if r[0] < 2] == first + [(1, 0, True, "only", False)]


def test_dynamic_meta(spark, tmp_path):
    rows = [{"id": "u1", "text": "x", "meta": {"Normalized Score": 0.5, "user": {"n": [1, {"deep": "y"}]}}}, {"id": "u2", "text": "z", "meta": {"Normalized Score": "0.25"}}, {"id": "u3", "text": None, "meta": None}, {"id": "u4"}]
    (tmp_path / "u.jsonl").write_text("\n".join(map(json.dumps, rows)))
    read = readers.utterances(spark, str(tmp_path / "u.jsonl"), dynamic=True)
    field = readers.meta_field
    found = read.orderBy("seq").select(field("$['Normalized Score']", "double"), field("$.user.n[1].deep", "string"), field("$.user.n[0]", "int"), field("$.user", "int")).collect()
    assert [tuple(r) for r in found] == [(0.5, "y", 1, None), (0.25, None, None, None), (None,) * 4, (None,) * 4]
    assert {(r["field"], r["n"]) for r in readers.meta_fields(read).collect()} == {("Normalized Score", 2), ("user", 1)}


def test_keep_first_by_hash(spark):
    texts = ["p" * 50, "q", "p" * 50, None, None, "", "r", "q", ""]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "seq int, t string, _values int")
    for keys in (consensus.hashed_keys, lambda by: [F.length(by[0])], lambda by: [F.lit(1)]):
        for n in (1, 4):
            assert sorted(tuple(r) for r in consensus.keep_first(df.repartition(n), ["t"], keys=keys, part=keys is not consensus.hashed_keys).collect()) == [(i, texts[i], i % 2) for i in (0, 1, 3, 5, 6)]
    with pytest.raises(Exception, match="different values share a key"):
        consensus.keep_first(df, ["t"], keys=lambda by: [F.lit(1)]).collect()
    both = consensus.keep_first(df.drop("_values").withColumn("u", F.col("seq") % 2), ["t", "u"]).collect()
    assert sorted(r["seq"] for r in both) == [0, 1, 3, 4, 5, 6, 8]


def test_texts_are_no_shuffle_keys(spark):
    df = spark.createDataFrame([(1, "x")], "seq int, t string")
    plan = consensus.keep_first(df, ["t"], part=True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert exchanges and not any("hashpartitioning(t#" in line for line in exchanges)


def test_prompts_by_key(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "key string, n int")
    prompts = spark.createDataFrame([("a", "z"), ("a", "y"), (None, "w"), ("c", "v")], "key string, prompt string")
    assert sorted((r["n"], r["prompt"]) for r in studies.keyed_prompts(rows, prompts).collect()) == [(1, "y"), (2, None), (3, None), (4, "y")]
