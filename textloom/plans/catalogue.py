"""The driver's queries over its tables, each with the SQL that says what it must give.

The tables stand in for the studies' inputs: documents for utterances and talk pages, labels for
judgements, benchmark items for scenarios, conversations for replicates.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, prompts
from ..functions import text as tx
from ..operators import consensus, context, design, parse
from ..operators.judge import StubJudge
from ..operators.order import with_seq
from ..sources import readers
from . import studies

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios made of benchmark items: templates with a slot and two quotes, questions, predicates in blocks of five, in a cycle."""
    items = _table(spark, sf_dir, "benchmark")
    said = F.concat(F.replace("text", F.lit('"'), F.lit("")), F.lit('" today.'))
    predicate = F.get(F.array(*[F.lit(p) for p in fixed.PREDICATES]), F.expr(f"cast((item_id div 5) % {len(fixed.PREDICATES)} as int)"))
    name = F.concat(F.lit("Ann"), F.col("item_id").cast("string"))
    made = {
        "scenario_id": F.col("item_id"), "predicate": predicate,
        "baseline": F.concat(name, F.lit(' says, "It is [modifier] so: '), said),
        "c1": F.concat(name, F.lit(' tells a guest, "It is [modifier] so: '), said),
        "hedged_baseline": F.concat(name, F.lit(' says, "Sorry but it is [modifier] so: '), said),
        "predicate_question": F.concat(F.lit("How "), predicate, F.lit(" is "), name, F.lit(" feeling?")),
        "politeness_question": F.concat(F.lit("How polite is "), name, F.lit(" being?")),
    }
    return items.select(*[c.alias(k) for k, c in made.items()])


def n_scenarios(spark: SparkSession, sf_dir: str) -> int:
    """How many numbers the scenarios take: one more than the largest id, which is their count where ids have no gaps."""
    return _table(spark, sf_dir, "benchmark").agg(F.coalesce(F.max("item_id") + 1, F.lit(0))).first()[0]


_SCENARIOS = f"""
sc AS (
  SELECT item_id AS scenario_id, ({fixed.PREDICATES})[item_id // 5 % {len(fixed.PREDICATES)} + 1] AS predicate, 'Ann' || CAST(item_id AS VARCHAR) AS name,
         replace(text, '"', '') || '" today.' AS said FROM benchmark
), scenarios AS (
  SELECT scenario_id, predicate, name || ' says, "It is [modifier] so: ' || said AS baseline, name || ' tells a guest, "It is [modifier] so: ' || said AS c1,
         name || ' says, "Sorry but it is [modifier] so: ' || said AS hedged_baseline, 'How ' || predicate || ' is ' || name || ' feeling?' AS predicate_question,
         'How polite is ' || name || ' being?' AS politeness_question FROM sc
), modifiers AS (SELECT * FROM (VALUES {', '.join(map(str, enumerate(fixed.MODIFIERS)))}) AS t(modifier_no, modifier)),
attempts AS (SELECT * FROM (VALUES (0), (1), (2)) AS t(attempt)),
scales AS (SELECT * FROM (VALUES {', '.join(str((p, *o)) for p, o in fixed.SCALES.items())}) AS t(predicate, a, b, c, d, e))
"""
_SAID = "replace(regexp_extract({s}, '(?s)\"(.*)\"', 1), '[modifier]', modifier)"
_SPEAKER = "string_split({q}, ' ')[4]"


def _sql_text(value: str) -> str:
    """A SQL expression for a Python text."""
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in value.split("\n"))


def _filled_sql(form: str, **values: str) -> str:
    """A prompt format of ``fixed`` as SQL, each ``{name}`` replaced by an expression."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", form)
    return " || ".join(values[p] if i % 2 else _sql_text(p) for i, p in enumerate(parts) if i % 2 or p)


_OPTIONS = " || ".join(_filled_sql("({letter}) {option}\n", letter=f"'{c}'", option=c.lower()) for c in "ABCDE")
_POLITE = _sql_text("".join(f"({c}) {o}\n" for c, o in zip("ABCDE", fixed.POLITENESS)))
_PLAIN = "replace({s}, '[modifier] ', '')"


def _asked(question: str, s: str) -> dict[str, str]:
    return {"speaker": _SPEAKER.format(q=question), "quote": _SAID.format(s=s), "modifier": "modifier"}


def _single_sql(form: str, question: str, tail: str, options: str = "") -> str:
    values = {**_asked("question", "s"), "plain": _PLAIN.format(s="s"), "predicate": "predicate", "low": "lower(a)", "high": "lower(e)", "options": options}
    prompt = _filled_sql(fixed.SINGLE_HEAD + form + tail, **values)
    return f"""
WITH {_SCENARIOS}, f AS (
  SELECT modifier_no, modifier, scenario_id, attempt, v, predicate, {question} AS question, CASE WHEN v = 0 THEN baseline ELSE hedged_baseline END AS s,
         ((modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 3 + attempt) * 2 + v + 1 AS request_no
  FROM scenarios, modifiers, attempts, (VALUES (0), (1)) AS t(v)
)
SELECT CAST(request_no AS BIGINT) AS request_no, CASE WHEN v = 0 THEN 'request-' ELSE 'request-hedge-' END || CAST(request_no AS VARCHAR) AS key, modifier, scenario_id, CAST(attempt AS INTEGER) AS attempt,
       CASE WHEN v = 0 THEN 'baseline' ELSE 'hedge_baseline' END AS variant, md5({prompt}) AS prompt_md5
FROM f JOIN scales USING (predicate)"""


def _single(prompt, question: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = design.single_requests(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), prompt, question)
        return made.select("request_no", "key", "modifier", "scenario_id", "attempt", "variant", F.md5("prompt").alias("prompt_md5"))

    return query


def _pair_sql(question: str, ask: str, options: str, tail: str) -> str:
    values = {**_asked(question, "baseline"), "first": _PLAIN.format(s="one"), "second": _PLAIN.format(s="two"), "options": options}
    prompt = _filled_sql(fixed.PAIR_HEAD + ask + tail + fixed.PAIR_JSON, **values)
    return f"""
WITH {_SCENARIOS}, f AS (
  SELECT *, (modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 3 + attempt + 1 AS request_no FROM scenarios, modifiers, attempts
), g AS (
  SELECT *, instr('02468ace', right(md5(CAST(request_no AS VARCHAR)), 1)) > 0 AS swapped FROM f
), h AS (
  SELECT *, CASE WHEN swapped THEN hedged_baseline ELSE baseline END AS one, CASE WHEN swapped THEN baseline ELSE hedged_baseline END AS two FROM g JOIN scales USING (predicate)
)
SELECT CAST(request_no AS BIGINT) AS request_no, 'request-' || CAST(request_no AS VARCHAR) || CASE WHEN swapped THEN '-True' ELSE '-False' END AS key, swapped,
  md5({prompt}) AS prompt_md5
FROM h"""


def _pair(polite: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return design.paired_requests(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), polite).select("request_no", "key", "swapped", F.md5("prompt").alias("prompt_md5"))

    return query


_SPLIT = r"string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1))"


def kwic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first "the" of each document in its context."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return context.keyword_in_context(docs, "the").drop("full_page_text")


def sentence_explode(spark, sf_dir):
    return context.exploded_sentences(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("position").cast("long").alias("position"), F.col("n_sentences").cast("long").alias("n_sentences"), "sentence")


def _utterances(spark, sf_dir) -> DataFrame:
    """Documents as utterances; ``seq`` is the doc_id where the ids are 0, 1, 2, ..., and else the place in their order, as chunks need it."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", "source", "lang")
    n, last = docs.agg(F.count("*"), F.max("seq")).first()
    return docs if n in (0, last + 1) else with_seq(docs.withColumnRenamed("seq", "_id"), "_id").drop("_id")


def chunk30_prompts(spark, sf_dir):
    made = design.label_requests(design.chunks(_utterances(spark, sf_dir)))
    return made.select("request_no", "key", "chunk", "n", F.md5("prompt").alias("prompt_md5"))


def contains_prompts(spark, sf_dir):
    return studies.contains_requests(_utterances(spark, sf_dir)).select("chunk", "n", F.md5("prompt").alias("prompt_md5"))


def polite_prompt(spark, sf_dir):
    return studies.polite_request(_utterances(spark, sf_dir)).select(F.md5("prompt").alias("prompt_md5"))


def quoted_span_speaker(spark, sf_dir):
    return scenario_table(spark, sf_dir).select("scenario_id", tx.word(F.col("predicate_question"), 3).alias("speaker"), tx.quoted(F.col("hedged_baseline")).alias("quoted"))


def _three(spark, sf_dir) -> DataFrame:
    """Documents with three nullable judgements made of their labels and ids."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    third = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return docs.join(labels, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", (F.col("quality") == 1).alias("is_modifier_1"), (F.col("toxic") == 1).alias("is_modifier_2"), third.alias("is_modifier_3"),
        F.when(F.col("quality").isNull(), "NA").otherwise(F.col("lang")).alias("modifier_word_1"), F.when(F.col("toxic") == 1, F.col("source")).alias("modifier_word_2"), F.when(F.col("doc_id") % 2 == 0, "NA").otherwise("x").alias("modifier_word_3"))


def judge_vote(spark, sf_dir):
    wide = _three(spark, sf_dir)
    literal = consensus.any_true(*[F.col(f"is_modifier_{j}") for j in (1, 2, 3)], literal=True)
    return consensus.consensus(wide.withColumn("literal_vote", literal)).select("doc_id", "is_modifier", "modifier_word", "literal_vote")


def dedup_keep_first(spark, sf_dir):
    return consensus.keep_first(_utterances(spark, sf_dir), ["text"]).select(F.col("seq").alias("doc_id"), F.md5("text").alias("text_md5"))


def replicate_concat(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return consensus.replicates(turns, ["conv_id"], "role", ["system", "user", "assistant"], "turn", "text")


def payload_extract(spark, sf_dir):
    wrapped = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done"))
    return _table(spark, sf_dir, "events").select("event_id", F.from_json(tx.object_part(wrapped), "k string", tx.STRICT)["k"].alias("k"))


def number_prefix_roundtrip(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    chunked = design.chunks(turns, by=["conv_id"])
    return chunked.select("conv_id", F.posexplode(tx.numbered_lines(F.concat(F.lit("Read:\n"), F.col("lines")))).alias("place", "sentence")).withColumn("place", F.col("place").cast("long"))


def markup_fields(spark, sf_dir):
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select(
        "page_id", F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract(html, '<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"),
        F.regexp_count(html, F.lit("<a href=")).cast("long").alias("n_links"))


def substring_filters(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    text, n = F.col("text"), lambda c: F.count_if(c)
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), n(tx.contains_phrase(text, "THE ")).alias("any_case"), n(tx.matches(text, "the? [a-z]+\\.")).alias("by_pattern"),
        n(tx.found_filter(text, "The")).alias("found"), n(tx.found_filter(text, "The", literal=True)).alias("found_literally"))


def tail2(spark, sf_dir):
    rows = studies.pages_with(_utterances(spark, sf_dir), "the")
    return studies.last_pages(rows).select(F.col("seq").alias("doc_id"), "source", "text")


def rating_pivot(spark, sf_dir):
    """Ratings of all scenarios in one prompt, three attempts, by a stub that answers a list of hashed numbers."""
    class Listed:
        def judge(self, requests):
            number = lambda s: F.conv(F.substring(F.md5(F.concat(F.col("key"), F.lit("/"), s.cast("string"))), 1, 2), 16, 10)
            return requests.withColumn("raw", F.concat(F.lit("Ratings:\n[ "), F.array_join(F.transform("order", number), ", "), F.lit(" ]")))

    return studies.rating_study(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), Listed()).drop("modifier_no")


def rating_items(spark, sf_dir):
    return design.rating_items(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir)).select("seq", "modifier", "question", "scenario")


def answer_parse(spark, sf_dir):
    """Result lines made of events: fenced answers, answers without an object, envelopes without an answer."""
    e = _table(spark, sf_dir, "events")
    letter = F.substring(F.lit("ABCDE"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))
    payload = F.when(F.col("event_id") % 7 == 0, F.lit("I cannot say.")).otherwise(F.concat(F.lit('```json\n{"scenario_answer": "('), letter, F.lit(')"}\n```')))
    response = F.struct(F.array(F.struct(F.struct(F.array(F.struct(payload.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    key = F.concat(F.lit("request-"), F.when(F.col("event_id") % 2 == 1, "hedge-").otherwise(""), F.col("event_id").cast("string"))
    whole = F.to_json(F.struct(key.alias("key"), F.when(F.col("event_id") % 11 != 0, response).alias("response")))
    lines = e.select(F.concat(F.lit("  "), whole).alias("line"))
    parsed = parse.answers(parse.envelopes(lines))
    return parsed.select("request_no", "key", "scenario_answer", parsed.parse_error.isNotNull().alias("failed"))


def label_parse(spark, sf_dir):
    """Label payloads made of documents, with tuples as models write them, parsed and exploded."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    pair = F.concat(F.lit('```\n{"sentence_1": (False, "NA"), "sentence_2":(True, "'), F.col("source"), F.lit(' The Fit"), "sentence_3": ('), F.when(F.col("doc_id") % 2 == 0, "True").otherwise("0"), F.lit(', NA), "sentence_2": (False, "'), F.col("lang"), F.lit('")}\n```'))
    raw = F.when(F.col("doc_id") % 9 == 0, F.lit("no json")).otherwise(pair)
    return rows.select("doc_id", F.posexplode(parse.labels(raw)).alias("place", "label")).select("doc_id", F.col("place").cast("long").alias("place"), "label.is_modifier", "label.word")


def triplet_group(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    keyed = turns.withColumn("key", F.concat(F.lit("request-"), (F.col("conv_id") * 8 + F.col("turn") + 1).cast("string"), F.lit("-1"))).withColumn("request_no", tx.request_number(F.col("key")))
    return consensus.triplets(keyed)


def namespace_filter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.filter("lang = 'en'").groupBy("source").agg(F.count("*").alias("matched"), F.count_if(F.col("n_chars") > 500).alias("emitted"))


def limits(spark, sf_dir):
    docs = _utterances(spark, sf_dir).select("seq")
    sizes = {"contexts": 6, "jobs": 7, "first_ten": 10, "chunk": 30, "shown": 102}
    parts = [docs.orderBy("seq").limit(n).agg(F.lit(k).alias("what"), F.count("*").alias("n"), F.max("seq").alias("last")) for k, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def distinct_first_seen(spark, sf_dir):
    return consensus.distinct_first_seen(_utterances(spark, sf_dir), "source").withColumnRenamed("first", "first_doc_id")


def left_join_prompts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("full", F.concat(F.lit("request-"), F.col("doc_id").cast("string"), F.lit("-2")))
    labels = _table(spark, sf_dir, "labels").select(F.concat(F.lit("request-"), F.col("doc_id").cast("string")).alias("key"), "quality")
    return docs.withColumn("key", tx.without_suffix(F.col("full"))).join(labels, "key", "left").select("doc_id", "key", "quality")


def predicate_scale_lookup(spark, sf_dir):
    made = scenario_table(spark, sf_dir).join(readers.scales(spark), "predicate")
    return made.select("scenario_id", "predicate", F.col("option_no").cast("long").alias("option_no"), "label")


def stub_judged_pipeline(spark, sf_dir):
    """The choice study from scenarios to concatenated answers, judged by a hash."""
    return studies.choice_study(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), StubJudge()).drop("modifier_no")


def stub_labelling(spark, sf_dir):
    """The labelling study: a stub that labels by place and judge; sentences with a modifier, first of equal ones."""
    class Placed:
        def judge(self, requests):
            def one(i):
                yes = (i + F.col("judge")) % 4 == 0
                return F.concat(F.lit('"sentence_'), i.cast("string"), F.lit('": ('), F.when(yes, "True").otherwise("False"), F.lit(', "'), F.when(yes, F.concat(F.lit("w"), F.col("judge").cast("string"))).otherwise("NA"), F.lit('")'))
            return requests.withColumn("raw", F.when(F.col("request_no") % 7 != 0, F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), one), ", "), F.lit("}"))))

    labelled = studies.labelling_study(_utterances(spark, sf_dir).select("seq", "text"), Placed())
    return studies.modifier_sentences(labelled).select("seq", "modifier_word", F.md5("sentence_text").alias("text_md5"))


def context_prompts(spark, sf_dir):
    pages = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("title"), "text")
    return studies.context_requests(studies.talk_page_contexts(pages, "the", most=None)).select("page_id", F.md5("prompt").alias("prompt_md5"))


def utterance_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("text", F.create_map(F.lit("Normalized Score"), (F.col("doc_id") / 8).cast("string")).alias("meta"))
    return studies.utterance_list(rows, "the").select(F.md5("Utterance").alias("utterance_md5"), F.col("Normalized Score").alias("score"))


def swapped_answers(spark, sf_dir):
    """Paired answers put back in the scenarios' order."""
    class Pairs:
        def judge(self, requests):
            at = lambda k: F.substring(F.lit("ABCDE"), (F.col("request_no") * k % 5 + 1).cast("int"), F.lit(1))
            return requests.withColumn("raw", F.concat(F.lit('{"scenario_1_answer": "('), at(1), F.lit(')", "scenario_2_answer": "('), at(2), F.lit(')"}')))

    return studies.paired_study(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), Pairs()).select("request_no", "swapped", "baseline_answer", "hedged_answer")


_NUMBERED = "string_agg(CAST(seq % 30 + 1 AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY seq)"
_RUNNING = "string_agg(CAST(seq + 1 AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY seq)"
_KWIC_SQL = f"""
WITH s AS (SELECT doc_id, source, {_SPLIT} AS a FROM documents WHERE contains(lower(text), 'the')),
t AS (SELECT *, list_position(list_transform(a, lambda x: contains(lower(x), 'the')), true) AS i FROM s)
SELECT doc_id, source, 'the' AS phrase, a[i] AS target_sentence, array_to_string(a[greatest(1, i - 3):i - 1], ' ') AS before_context, array_to_string(a[i + 1:i + 3], ' ') AS after_context,
       array_to_string(a[greatest(1, i - 3):i + 3], ' ') AS full_context, CAST(i AS VARCHAR) || '/' || CAST(len(a) AS VARCHAR) AS sentence_position FROM t WHERE i > 0"""


QUERIES: dict[str, tuple[Query, str]] = {
    "kwic_context": (kwic_context, f"SELECT * EXCLUDE (source) FROM ({_KWIC_SQL})"),
    "sentence_explode": (sentence_explode, f"""
SELECT doc_id, CAST(i AS BIGINT) AS position, CAST(len(a) AS BIGINT) AS n_sentences, a[i] AS sentence FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {_SPLIT} AS a FROM documents))"""),
    "chunk30_prompts": (chunk30_prompts, f"""
WITH u AS (SELECT doc_id AS seq, text FROM documents), c AS (SELECT seq // 30 AS chunk, count(*) AS n, {_NUMBERED} AS lines FROM u GROUP BY 1)
SELECT CAST(3 * chunk + judge AS BIGINT) AS request_no, 'request-' || CAST(3 * chunk + judge AS VARCHAR) || '-' || CAST(judge AS VARCHAR) AS key, chunk, n,
       md5({_sql_text(fixed.LABEL_HEAD)} || lines || {_sql_text(fixed.LABEL_TAIL)}) AS prompt_md5 FROM c, (VALUES (1), (2), (3)) AS t(judge)"""),
    "contains_prompts": (contains_prompts, f"""
WITH u AS (SELECT doc_id AS seq, text FROM documents), c AS (SELECT seq // 30 AS chunk, count(*) AS n, {_RUNNING} AS lines FROM u GROUP BY 1)
SELECT chunk, n, md5(CASE WHEN n < 30 THEN {_sql_text(fixed.CONTAINS_TAIL_HEAD)} ELSE {_sql_text(fixed.CONTAINS_HEAD)} END || lines) AS prompt_md5 FROM c"""),
    "polite_prompt": (polite_prompt, f"""
WITH u AS (SELECT doc_id AS seq, text FROM documents WHERE doc_id < 30) SELECT md5({_sql_text(fixed.POLITE_HEAD)} || {_NUMBERED}) AS prompt_md5 FROM u"""),
    "factorial_requests": (_single(prompts.choice_prompt, "predicate_question"), _single_sql(fixed.CHOICE_QUESTION, "predicate_question", fixed.SINGLE_CHOICE_TAIL, _OPTIONS)),
    "rating_requests": (_single(prompts.rating_prompt, "predicate_question"), _single_sql(fixed.RATING_QUESTION, "predicate_question", fixed.SINGLE_NUMBER_TAIL)),
    "politeness_prompts": (_single(prompts.politeness_prompt, "politeness_question"), _single_sql(fixed.POLITENESS_QUESTION, "politeness_question", fixed.SINGLE_CHOICE_TAIL, _POLITE)),
    "paired_requests": (_pair(False), _pair_sql("predicate_question", fixed.PAIR_CHOICE_QUESTION, _OPTIONS, fixed.PAIR_CHOICE_TAIL)),
    "paired_politeness": (_pair(True), _pair_sql("politeness_question", fixed.POLITENESS_QUESTION, _POLITE, fixed.PAIR_POLITENESS_TAIL)),
    "quoted_span_speaker": (quoted_span_speaker, f"""
WITH {_SCENARIOS} SELECT scenario_id, string_split(predicate_question, ' ')[4] AS speaker, regexp_extract(hedged_baseline, '(?s)"(.*)"', 1) AS quoted FROM scenarios"""),
    "judge_vote": (judge_vote, """
WITH j AS (
  SELECT d.doc_id, l.quality = 1 AS a, l.toxic = 1 AS b, CASE d.doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c,
         CASE WHEN l.quality IS NULL THEN 'NA' ELSE d.lang END AS w1, CASE WHEN l.toxic = 1 THEN d.source END AS w2, CASE WHEN d.doc_id % 2 = 0 THEN 'NA' ELSE 'x' END AS w3
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)
SELECT doc_id, coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false) AS is_modifier, coalesce(nullif(w1, 'NA'), nullif(w2, 'NA'), nullif(w3, 'NA'), 'NA') AS modifier_word,
       CASE WHEN a IS NULL THEN coalesce(c, false) ELSE a OR coalesce(b, false) OR coalesce(c, false) END AS literal_vote FROM j"""),
    "dedup_keep_first": (dedup_keep_first, "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text"),
    "replicate_concat": (replicate_concat, """
SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS user,
       coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS assistant FROM conversations GROUP BY conv_id"""),
    "payload_extract": (payload_extract, "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "number_prefix_roundtrip": (number_prefix_roundtrip, r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(replace(text, chr(10), ' '), '^\d+\.\s+', '') AS sentence FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS place, sentence FROM t"""),
    "markup_fields": (markup_fields, """
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
       CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages"""),
    "substring_filters": (substring_filters, r"""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'the ')) AS any_case, count(*) FILTER (WHERE regexp_matches(text, 'the? [a-z]+\.')) AS by_pattern,
       count(*) FILTER (WHERE contains(text, 'The')) AS found, count(*) FILTER (WHERE NOT starts_with(text, 'The')) AS found_literally FROM documents GROUP BY lang"""),
    "tail2": (tail2, "SELECT doc_id, source, text FROM documents WHERE regexp_matches(text, 'the') ORDER BY doc_id DESC LIMIT 2"),
    "rating_items": (rating_items, f"""
WITH {_SCENARIOS} SELECT CAST((modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 4 + k AS BIGINT) AS seq, modifier, predicate_question AS question,
  CASE k WHEN 0 THEN replace(baseline, '[modifier] ', '') WHEN 1 THEN replace(baseline, '[modifier]', modifier) WHEN 2 THEN replace(c1, '[modifier] ', '') ELSE replace(c1, '[modifier]', modifier) END AS scenario
FROM scenarios, modifiers, (VALUES (0), (1), (2), (3)) AS t(k)"""),
    "rating_pivot": (rating_pivot, f"""
WITH {_SCENARIOS}, i AS (SELECT modifier, scenario_id, predicate_question AS question, k, attempt, (modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 4 + k AS seq FROM scenarios, modifiers, attempts, (VALUES (0), (1), (2), (3)) AS t(k)),
r AS (SELECT *, CAST(CAST('0x' || substr(md5('rating-' || CAST(attempt + 1 AS VARCHAR) || '/' || CAST(seq AS VARCHAR)), 1, 2) AS INTEGER) AS VARCHAR) || ', ' AS answer FROM i)
SELECT scenario_id, modifier, question, string_agg(answer, '' ORDER BY attempt) FILTER (WHERE k = 0) AS baseline_unmodified, string_agg(answer, '' ORDER BY attempt) FILTER (WHERE k = 1) AS baseline_modified,
       string_agg(answer, '' ORDER BY attempt) FILTER (WHERE k = 2) AS c1_unmodified, string_agg(answer, '' ORDER BY attempt) FILTER (WHERE k = 3) AS c1_modified
FROM r GROUP BY scenario_id, modifier, question"""),
    "answer_parse": (answer_parse, """
SELECT event_id AS request_no, 'request-' || CASE WHEN event_id % 2 = 1 THEN 'hedge-' ELSE '' END || CAST(event_id AS VARCHAR) AS key,
       CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN substr('ABCDE', event_id % 5 + 1, 1) END AS scenario_answer, event_id % 11 = 0 OR event_id % 7 = 0 AS failed FROM events"""),
    "label_parse": (label_parse, """
SELECT doc_id, CAST(place AS BIGINT) AS place, CASE place WHEN 2 THEN doc_id % 2 = 0 ELSE false END AS is_modifier, CASE place WHEN 1 THEN lang ELSE 'NA' END AS word
FROM documents, (VALUES (0), (1), (2)) AS t(place) WHERE doc_id % 9 <> 0"""),
    "triplet_group": (triplet_group, """
WITH k AS (SELECT conv_id * 8 + turn + 1 AS request_no FROM conversations)
SELECT (request_no - 1) // 3 AS triplet, count(*) AS n, string_agg('request-' || CAST(request_no AS VARCHAR) || '-1', ',' ORDER BY request_no) AS keys FROM k GROUP BY 1"""),
    "namespace_filter": (namespace_filter, "SELECT source, count(*) AS matched, count(*) FILTER (WHERE n_chars > 500) AS emitted FROM documents WHERE lang = 'en' GROUP BY source"),
    "limits": (limits, """
WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
SELECT what, count(*) AS n, max(doc_id) AS last FROM s JOIN (VALUES ('contexts', 6), ('jobs', 7), ('first_ten', 10), ('chunk', 30), ('shown', 102)) AS t(what, most) ON r <= most GROUP BY what"""),
    "distinct_first_seen": (distinct_first_seen, "SELECT source, min(doc_id) AS first_doc_id FROM documents GROUP BY source"),
    "left_join_prompts": (left_join_prompts, "SELECT d.doc_id, 'request-' || CAST(d.doc_id AS VARCHAR) AS key, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "predicate_scale_lookup": (predicate_scale_lookup, f"""
WITH {_SCENARIOS} SELECT scenario_id, predicate, CAST(k AS BIGINT) AS option_no, CASE k WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c WHEN 3 THEN d ELSE e END AS label
FROM scenarios JOIN scales USING (predicate), (VALUES (0), (1), (2), (3), (4)) AS t(k)"""),
    "stub_judged_pipeline": (stub_judged_pipeline, f"""
WITH {_SCENARIOS}, f AS (SELECT modifier, scenario_id, predicate_question AS question, attempt, v, ((modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 3 + attempt) * 2 + v + 1 AS n FROM scenarios, modifiers, attempts, (VALUES (0), (1)) AS t(v)),
a AS (SELECT *, substr('ABCDE', CAST('0x' || substr(md5(CASE WHEN v = 0 THEN 'request-' ELSE 'request-hedge-' END || CAST(n AS VARCHAR)), 1, 6) AS INTEGER) % 5 + 1, 1) AS answer FROM f)
SELECT scenario_id, modifier, question, string_agg(answer, '' ORDER BY attempt) FILTER (WHERE v = 0) AS baseline, string_agg(answer, '' ORDER BY attempt) FILTER (WHERE v = 1) AS hedge_baseline
FROM a GROUP BY scenario_id, modifier, question"""),
    "stub_labelling": (stub_labelling, """
WITH u AS (SELECT doc_id AS seq, text, doc_id // 30 AS chunk, doc_id % 30 + 1 AS i FROM documents),
j AS (SELECT u.*, judge, (i + judge) % 4 = 0 AND (3 * chunk + judge) % 7 <> 0 AS yes FROM u, (VALUES (1), (2), (3)) AS t(judge)),
v AS (SELECT seq, any_value(text) AS text, 'w' || CAST(min(judge) AS VARCHAR) AS modifier_word FROM j WHERE yes GROUP BY seq)
SELECT seq, modifier_word, md5(text) AS text_md5 FROM v QUALIFY row_number() OVER (PARTITION BY text ORDER BY seq) = 1"""),
    "context_prompts": (context_prompts, f"""
WITH k AS ({_KWIC_SQL}) SELECT CAST(doc_id AS VARCHAR) AS page_id, md5({_filled_sql(fixed.CONTEXT_PROMPT, phrase="'the'", title="source", before="before_context", target="target_sentence", after="after_context")}) AS prompt_md5 FROM k"""),
    "utterance_scores": (utterance_scores, "SELECT md5(text) AS utterance_md5, doc_id / 8 AS score FROM documents WHERE contains(text, 'the')"),
    "swapped_answers": (swapped_answers, f"""
WITH {_SCENARIOS}, f AS (SELECT (modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 3 + attempt + 1 AS n FROM scenarios, modifiers, attempts),
g AS (SELECT n, instr('02468ace', right(md5(CAST(n AS VARCHAR)), 1)) > 0 AS swapped, substr('ABCDE', n % 5 + 1, 1) AS one, substr('ABCDE', n * 2 % 5 + 1, 1) AS two FROM f)
SELECT CAST(n AS BIGINT) AS request_no, swapped, CASE WHEN swapped THEN two ELSE one END AS baseline_answer, CASE WHEN swapped THEN one ELSE two END AS hedged_answer FROM g"""),
}

from .intake import queries as _intake  # noqa: E402 - their SQL is made of the SQL above
from .round_trips import queries as _round_trips  # noqa: E402

QUERIES |= _round_trips() | _intake()
