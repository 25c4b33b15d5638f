"""Driver queries over answers and files as they come: malformed, late, nested, or only half there.

Each makes its input of the driver's tables, puts it through the library, and has the SQL of what must come out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import consensus, design, judge, parse
from ..sources import numbering, readers
from ..sources.scratch import shared_path, stored
from ..streaming import votes
from . import studies
from .round_trips import _table

#: What a model may send instead of {"scenario_answer": "(A)"}: text around it, a second value, brackets that close early, other quotes.
_OBJECTS = ["@", "```json\n@\n```", "@ y {\"b\": 2}", "@, {\"b\": 2}", "@] [{\"b\": 2}", "@}", "none", "{'scenario_answer': 'A'}", '{"scenario_answer": "A", "scenario_answer": "(B)"}', '{"other": "A"}', '{"scenario_answer": null}', '{"scenario_answer": 7}']
#: The same for [1, 2].
_LISTS = ["[1, 2]", "so: [1, 2].", "[1, 2] x [3]", "[1, 2], [3]", "[1 2]", "none", "[1]", "[1, 2, 3]", "[\"1\", 2.5]", "[1, 2,]"]
#: The same for label pairs.
_LABELS = ['{"s1": (True, "a bit"), "s2": (False, NA)}', '{"s1": [1, "x"], "s2": ["false", "y"]}', '{"s1": (True, "a")} {"s2": (True, "b")}', '{"s1": (True)}', '{"s1": 5}', "none"]


def _turns(spark, sf_dir, forms: list[str], key: str) -> DataFrame:
    """Answers of all turns, in the forms by turn."""
    number = F.col("conv_id") * 8 + F.col("turn")
    ok = F.concat(F.lit('{"scenario_answer": "('), F.substring(F.lit("ABCDE"), (number % 5 + 1).cast("int"), F.lit(1)), F.lit(')"}'))
    form = F.element_at(F.array(*map(F.lit, forms)), (number % len(forms) + 1).cast("int"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(f"{key}-"), number.cast("string")).alias("key"), F.replace(form, F.lit("@"), ok).alias("raw"))


def strict_answers(spark, sf_dir):
    """Answers with an object alone, in a fence, and with more than an object: only a whole one is an answer."""
    parsed = parse.answers(_turns(spark, sf_dir, _OBJECTS, "request"))
    return parsed.select("conv_id", "turn", "scenario_answer", F.col("parse_error").alias("reason"))


def strict_lists(spark, sf_dir):
    """Lists of two answers, and what isn't one; a list of another length is rejected whole."""
    parsed = parse.list_answers(_turns(spark, sf_dir, _LISTS, "rating"), 2)
    return parsed.select("conv_id", "turn", F.col("parse_error").alias("reason"), F.posexplode_outer("answers").alias("place", "answer")).withColumn("place", F.col("place").cast("long"))


def _parsed(spark, sf_dir) -> list[parse.Parsed]:
    """Every parser's answers to all turns, each parsed and parted in one pass."""
    lines = _turns(spark, sf_dir, _OBJECTS, "line").withColumn("line", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("{broken "), "raw")).otherwise(F.to_json(F.struct("key", F.lit(1).alias("x")))))
    tables = {
        "envelopes": parse.envelopes(lines.select("line")),
        "answers": parse.answers(_turns(spark, sf_dir, _OBJECTS, "request")),
        "lists": parse.list_answers(_turns(spark, sf_dir, _LISTS, "rating"), 2),
        "labels": parse.label_answers(_turns(spark, sf_dir, _LABELS, "label")),
    }
    return [parse.with_rejects(t, name, shared_path(spark, name)) for name, t in tables.items()]


def rejected_answers(spark, sf_dir):
    """The side table of all parsers: what couldn't be read, and why."""
    out = None
    for p in _parsed(spark, sf_dir):
        out = p.rejected if out is None else out.unionByName(p.rejected)
    return out.select("parser", "key", F.md5("line").alias("line_md5"), "reason")


def reject_counts(spark, sf_dir):
    """For each parser the rows of both outputs, as counted while they were written and as read."""
    out = None
    for p in _parsed(spark, sf_dir):
        one = p.good.agg(F.count("*").alias("n_good")).join(F.broadcast(p.rejected.agg(F.max("parser").alias("parser"), F.count("*").alias("n_rejected"))))  # one row each
        one = one.withColumns({"counted_good": F.lit(p.n_good).cast("long"), "counted_rejected": F.lit(p.n_rejected).cast("long")})
        out = one if out is None else out.unionByName(one)
    return out.select("parser", "n_good", "n_rejected", "counted_good", "counted_rejected")


def _lines_with_faults(spark, sf_dir) -> str:
    """Talk pages as JSON lines, a file for each hundred documents; every seventh is cut short, every eleventh followed by another object."""
    path, id_ = shared_path(spark, "faults"), F.col("doc_id")
    page = F.to_json(F.struct(id_.cast("string").alias("page_id"), F.col("source").alias("title"), F.lit("t").alias("timestamp"), F.lit("e").alias("last_editor"), "text"))
    line = F.when(id_ % 7 == 0, F.expr("left(page, length(page) - 2)")).when(id_ % 11 == 0, F.concat("page", F.lit(' {"page_id": "x"}'))).otherwise(F.col("page"))
    rows = _table(spark, sf_dir, "documents").withColumn("page", page).select(F.expr("doc_id div 100").alias("file_no"), "doc_id", line.alias("value"))
    rows.repartition("file_no").sortWithinPartitions("file_no", "doc_id").select("file_no", "value").write.partitionBy("file_no").text(path)
    return path


def malformed_lines(spark, sf_dir):
    """The lines that aren't one JSON object, by file and line number."""
    found = readers.malformed_lines(spark, _lines_with_faults(spark, sf_dir))
    return found.select(F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("long").alias("file_no"), "line_no", F.length("line").cast("long").alias("n_chars"))


def corrupt_records(spark, sf_dir):
    """Good and malformed lines in one table: nulls and the text where a line can't be read."""
    rows = readers.talk_page_records(spark, _lines_with_faults(spark, sf_dir))
    return rows.select(F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("long").alias("file_no"), "line_no", "page_id", F.md5("text").alias("text_md5"), F.col("corrupt_record").isNotNull().alias("corrupt"))


def _result_lines(requests: DataFrame, raw) -> DataFrame:
    """Results of label requests as the lines of a result file."""
    text = F.struct(F.array(F.struct(F.struct(F.array(F.struct(raw.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    return requests.select(F.to_json(F.struct("key", text.alias("response"))).alias("value"))


def streaming_vote(spark, sf_dir):
    """Three judges' label results that arrive as files, voted on as soon as all three are there."""
    utterances = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    requests = design.label_requests(design.chunks(utterances))

    def one(i):
        yes = (i + F.col("judge")) % 4 == 0
        return F.concat(F.lit('"sentence_'), i.cast("string"), F.lit('": ('), F.when(yes, "True").otherwise("False"), F.lit(', "'), F.when(yes, F.concat(F.lit("w"), F.col("judge").cast("string"))).otherwise("NA"), F.lit('")'))

    raw = F.when(F.col("request_no") % 7 != 0, F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), one), ", "), F.lit("}"))).otherwise("I can't say.")
    folder, out = shared_path(spark, "results"), shared_path(spark, "votes")
    _result_lines(requests, raw).write.text(folder)
    query = votes.write_votes(votes.votes(votes.judged_questions(votes.label_stream(spark, folder))), out, shared_path(spark, "votes-state"))
    query.awaitTermination()
    found = spark.read.schema("question long, complete boolean, place int, is_modifier boolean, modifier_word string").parquet(out)
    return found.select((F.col("question") * 30 + F.col("place")).alias("doc_id"), "is_modifier", "modifier_word", "complete")


def resumed_answers(spark, sf_dir):
    """A study asked in two runs: the first half alone, then all; the second run asks only what the first hasn't."""
    from .catalogue import n_scenarios, scenario_table

    def answer(asked: list[str]) -> list[str]:
        return ['{"scenario_answer": "' + "ABCDE"[int(hashlib.md5(p.encode()).hexdigest()[:6], 16) % 5] + '"}' for p in asked]

    requests = design.single_requests(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), prompts.choice_prompt)
    asker = judge.LedgerJudge(answer, shared_path(spark, "ledger"), parallel=2, waves=2)
    first = asker.ask(requests.filter("request_no % 2 = 1"))
    judged = parse.answers(asker.judge(requests))
    asked = asker.ledger(spark).groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("times_asked"))
    return judged.join(asked, F.col("key") == F.col("_key"), "left").select("request_no", F.col("scenario_answer").alias("answer"), "times_asked", F.lit(first).cast("long").alias("asked_first"))


def rating_chunks(spark, sf_dir):
    """All scenarios rated in prompts of sixteen, three attempts, by a stub that answers hashed numbers; every fifth list is short, and rejected."""
    from .catalogue import n_scenarios, scenario_table

    class Listed:
        def judge(self, requests):
            number = lambda s: F.conv(F.substring(F.md5(s.cast("string")), 1, 2), 16, 10)
            first = F.get("order", F.lit(0))
            found = F.when(first % 5 == 0, F.slice("order", 1, F.size("order") - 1)).otherwise(F.col("order"))
            return requests.withColumn("raw", F.concat(F.lit("Ratings:\n["), F.array_join(F.transform(found, number), ", "), F.lit("]")))

    return studies.rating_study(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), Listed(), size=16).drop("modifier_no")


def keyed_prompts(spark, sf_dir):
    """Labelled documents with the prompts of their keys: a left join in which repeated and missing keys neither add nor lose a row."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    key = F.concat(F.lit("request-"), F.col("doc_id").cast("string"))
    prompts_by_key = labels.select(key.alias("key"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("prompt"))
    twice = prompts_by_key.unionByName(prompts_by_key.withColumn("prompt", F.concat(F.col("prompt"), F.lit(" again"))))
    return studies.keyed_prompts(docs.select("doc_id", key.alias("key")), twice).select("doc_id", "key", "prompt")


def nested_meta(spark, sf_dir):
    """Utterances whose meta has numbers, lists and objects, read back by type."""
    path, id_ = shared_path(spark, "dynamic"), F.col("doc_id")
    user = F.struct(F.concat(F.lit("u"), (id_ % 5).cast("string")).alias("name"), F.array(id_, id_ * 2).alias("counts"))
    meta = F.struct((id_ / 8).alias("Normalized Score"), (id_ % 3 == 0).alias("root"), F.when(id_ % 4 != 0, user).alias("user"), F.when(id_ % 2 == 0, "text").alias("kind"))
    rows = _table(spark, sf_dir, "documents").select(id_.cast("string").alias("id"), "text", meta.alias("meta"))
    rows.write.option("ignoreNullFields", "true").json(path)
    field = readers.meta_field
    return readers.utterances(spark, path, dynamic=True).select(
        F.col("id").cast("long").alias("doc_id"), field("$['Normalized Score']", "double").alias("score"), field("$.root", "boolean").alias("root"), field("$.user.name", "string").alias("user"),
        field("$.user.counts[1]", "long").alias("second_count"), field("$.kind", "double").alias("kind_as_number"))


def meta_kinds(spark, sf_dir):
    """What fields a dynamic meta has, of what kind, and in how many rows."""
    path, id_ = shared_path(spark, "dynamic"), F.col("doc_id")
    meta = F.struct(F.when(id_ % 2 == 0, id_).alias("n"), F.col("source").alias("source"), F.when(id_ % 3 == 0, F.array(F.lit(1.5), F.lit(2.5))).alias("pair"))
    _table(spark, sf_dir, "documents").select(id_.cast("string").alias("id"), "text", meta.alias("meta")).write.option("ignoreNullFields", "true").json(path)
    return readers.meta_fields(readers.utterances(spark, path, dynamic=True))


def appended_numbers(spark, sf_dir):
    """Lines numbered in two rounds: files that come later, under names that sort earlier, leave the numbers of the first alone."""
    folder, ledger = shared_path(spark, "arriving"), shared_path(spark, "numbers")
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    first = None
    for name, part in (("b", "doc_id % 2 = 0"), ("a", "doc_id % 2 = 1")):
        docs.filter(part).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string").alias("value")).write.text(f"{folder}/{name}")
        lines = numbering.numbered_lines(spark, folder, ledger).select(F.col("value").cast("long").alias("doc_id"), "seq")
        first = stored(lines, "numbered") if first is None else first
    before = first.select(F.col("doc_id").alias("_id"), F.col("seq").alias("seq_before"))
    return lines.join(before, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "seq", "seq_before")


def collided_texts(spark, sf_dir):
    """First of equal texts when the keys collide (here: by length): texts are still told apart."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return consensus.keep_first(rows, ["text"], "doc_id", lambda by: [F.length(by[0])], part=True).select("doc_id", F.md5("text").alias("text_md5"))


def queries() -> dict:
    """name: (query, SQL)."""
    from . import catalogue as c

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    number, letter = "(conv_id * 8 + turn)", "substr('ABCDE', (conv_id * 8 + turn) % 5 + 1, 1)"
    objects = f"""CASE {number} % {len(_OBJECTS)} WHEN 0 THEN {letter} WHEN 1 THEN {letter} WHEN 8 THEN 'B' WHEN 11 THEN '7' END"""
    object_reason = f"CASE WHEN {number} % {len(_OBJECTS)} IN (0, 1, 8, 11) THEN NULL WHEN {number} % {len(_OBJECTS)} IN (9, 10) THEN '{parse.NO_FIELD}' ELSE '{parse.NO_OBJECT}' END"
    list_reason = f"CASE WHEN {number} % {len(_LISTS)} IN (0, 1, 8) THEN NULL WHEN {number} % {len(_LISTS)} IN (6, 7) THEN '{parse.WRONG_LENGTH}' ELSE '{parse.NO_LIST}' END"
    label_reason = f"CASE WHEN {number} % {len(_LABELS)} IN (0, 1) THEN NULL WHEN {number} % {len(_LABELS)} = 4 THEN {quoted(parse.NO_PAIR)} ELSE '{parse.NO_OBJECT}' END"

    def form(forms: list[str]) -> str:
        ok = f"""'{{"scenario_answer": "(' || {letter} || ')"}}'"""
        return f"replace([{', '.join(map(quoted, forms))}][{number} % {len(forms)} + 1], '@', {ok})"

    bad = f"""
WITH e AS (
  SELECT 'envelopes' AS parser, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'line-' || CAST({number} AS VARCHAR) END AS key,
         CASE WHEN turn % 3 = 0 THEN '{{broken ' || {form(_OBJECTS)} ELSE '{{"key":"line-' || CAST({number} AS VARCHAR) || '","x":1}}' END AS line,
         CASE WHEN turn % 3 = 0 THEN {quoted(parse.NOT_JSON)} ELSE '{parse.NO_ANSWER}' END AS reason FROM conversations
  UNION ALL SELECT 'answers', 'request-' || CAST({number} AS VARCHAR), {form(_OBJECTS)}, {object_reason} FROM conversations
  UNION ALL SELECT 'lists', 'rating-' || CAST({number} AS VARCHAR), {form(_LISTS)}, {list_reason} FROM conversations
  UNION ALL SELECT 'labels', 'label-' || CAST({number} AS VARCHAR), {form(_LABELS)}, {label_reason} FROM conversations
)"""
    faults = """
WITH l AS (
  SELECT doc_id // 100 AS file_no, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS line_no, doc_id, text, source, doc_id % 7 = 0 OR doc_id % 11 = 0 AS corrupt,
         CAST(to_json({'page_id': CAST(doc_id AS VARCHAR), 'title': source, 'timestamp': 't', 'last_editor': 'e', 'text': text}) AS VARCHAR) AS page FROM documents
)"""
    return {
        "strict_answers": (strict_answers, f"SELECT conv_id, turn, {objects} AS scenario_answer, {object_reason} AS reason FROM conversations"),
        "strict_lists": (strict_lists, f"""
WITH r AS (SELECT *, {list_reason} AS reason FROM conversations)
SELECT conv_id, turn, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS answer, reason FROM r WHERE reason IS NOT NULL
UNION ALL SELECT conv_id, turn, CAST(p AS BIGINT), CASE WHEN {number} % {len(_LISTS)} = 8 AND p = 1 THEN '2.5' ELSE CAST(p + 1 AS VARCHAR) END, NULL FROM r, (VALUES (0), (1)) AS t(p) WHERE reason IS NULL"""),
        "rejected_answers": (rejected_answers, f"{bad} SELECT parser, key, md5(line) AS line_md5, reason FROM e WHERE reason IS NOT NULL"),
        "reject_counts": (reject_counts, f"""{bad}
SELECT parser, count(*) FILTER (WHERE reason IS NULL) AS n_good, count(reason) AS n_rejected, count(*) - count(reason) AS counted_good, count(*) - count(*) FILTER (WHERE reason IS NULL) AS counted_rejected FROM e GROUP BY parser"""),
        "malformed_lines": (malformed_lines, f"""{faults}
SELECT file_no, line_no, CASE WHEN doc_id % 7 = 0 THEN length(page) - 2 ELSE length(page) + 17 END AS n_chars FROM l WHERE corrupt"""),
        "corrupt_records": (corrupt_records, f"""{faults}
SELECT file_no, line_no, CASE WHEN NOT corrupt THEN CAST(doc_id AS VARCHAR) END AS page_id, CASE WHEN NOT corrupt THEN md5(text) END AS text_md5, corrupt FROM l"""),
        "streaming_vote": (streaming_vote, """
WITH u AS (SELECT doc_id, doc_id // 30 AS chunk, doc_id % 30 + 1 AS i FROM documents),
j AS (SELECT u.*, judge, (i + judge) % 4 = 0 AND (3 * chunk + judge) % 7 <> 0 AS yes FROM u, (VALUES (1), (2), (3)) AS t(judge))
SELECT doc_id, bool_or(yes) AS is_modifier, coalesce('w' || CAST(min(judge) FILTER (WHERE yes) AS VARCHAR), 'NA') AS modifier_word, true AS complete FROM j GROUP BY doc_id"""),
        "resumed_answers": (resumed_answers, f"""
SELECT request_no, substr('ABCDE', CAST('0x' || substr(prompt_md5, 1, 6) AS INTEGER) % 5 + 1, 1) AS answer, CAST(1 AS BIGINT) AS times_asked, count(*) FILTER (WHERE request_no % 2 = 1) OVER () AS asked_first
FROM ({c.QUERIES['factorial_requests'][1]})"""),
        "rating_chunks": (rating_chunks, f"""
WITH {c._SCENARIOS}, i AS (SELECT modifier, scenario_id, predicate_question AS question, k, attempt, (modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 4 + k AS seq FROM scenarios, modifiers, attempts, (VALUES (0), (1), (2), (3)) AS t(k)),
g AS (SELECT *, min(seq) OVER (PARTITION BY seq // 16) AS first FROM i),
r AS (SELECT *, CASE WHEN first % 5 <> 0 THEN CAST(CAST('0x' || substr(md5(CAST(seq AS VARCHAR)), 1, 2) AS INTEGER) AS VARCHAR) || ', ' END AS answer FROM g)
SELECT scenario_id, modifier, question, coalesce(string_agg(answer, '') FILTER (WHERE k = 0), '') AS baseline_unmodified, coalesce(string_agg(answer, '') FILTER (WHERE k = 1), '') AS baseline_modified,
       coalesce(string_agg(answer, '') FILTER (WHERE k = 2), '') AS c1_unmodified, coalesce(string_agg(answer, '') FILTER (WHERE k = 3), '') AS c1_modified
FROM r GROUP BY scenario_id, modifier, question"""),
        "keyed_prompts": (keyed_prompts, """
SELECT d.doc_id, 'request-' || CAST(d.doc_id AS VARCHAR) AS key, 'quality ' || CAST(l.quality AS VARCHAR) AS prompt FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
        "nested_meta": (nested_meta, """
SELECT doc_id, doc_id / 8 AS score, doc_id % 3 = 0 AS root, CASE WHEN doc_id % 4 <> 0 THEN 'u' || CAST(doc_id % 5 AS VARCHAR) END AS user,
       CASE WHEN doc_id % 4 <> 0 THEN doc_id * 2 END AS second_count, CAST(NULL AS DOUBLE) AS kind_as_number FROM documents"""),
        "appended_numbers": (appended_numbers, """
WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS r, count(*) FILTER (WHERE doc_id % 2 = 0) OVER () AS evens FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN r ELSE evens + r END AS seq, CASE WHEN doc_id % 2 = 0 THEN r END AS seq_before FROM n"""),
        "collided_texts": (collided_texts, "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text"),
        "meta_kinds": (meta_kinds, """
SELECT 'n' AS field, 'BIGINT' AS kind, count(*) AS n FROM documents WHERE doc_id % 2 = 0 HAVING count(*) > 0
UNION ALL SELECT 'source', 'STRING', count(*) FROM documents WHERE source IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'pair', 'ARRAY<DECIMAL(2,1)>', count(*) FROM documents WHERE doc_id % 3 = 0 HAVING count(*) > 0"""),
    }
