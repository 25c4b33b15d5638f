"""Driver queries over files: each writes a table with the library's writers, reads it back with its readers, and has the table's SQL.

Files go to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, prompts
from ..functions import text as tx
from ..operators import consensus, design, judge, parse
from ..operators.order import with_seq
from ..sources import readers, sinks
from ..sources.scratch import shared_path as _path
from . import studies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenario_scan(spark, sf_dir):
    """Scenarios written as a scenario file and read in file order."""
    from .catalogue import scenario_table

    path = _path(spark, "scenarios")
    sinks.write_scenarios(scenario_table(spark, sf_dir).drop("predicate"), path, 4)
    return readers.scenarios(spark, path).select("scenario_id", "predicate", "baseline", "c1", "hedged_baseline", "c2", "politeness_question", "predicate_question")


def slider_scan(spark, sf_dir):
    """Packed slider cells of scenarios, written and unpacked."""
    from .catalogue import scenario_table

    path = _path(spark, "sliders")
    cells = F.concat_ws(",", F.concat(F.lit("S"), F.col("scenario_id").cast("string")), *[F.when((F.col("scenario_id") + k) % 3 != 0, (F.col("scenario_id") * k).cast("string")).otherwise("") for k in range(2 * len(fixed.MODIFIERS))])
    sinks.write_scenarios(scenario_table(spark, sf_dir).withColumn("packed", F.when(F.col("scenario_id") % 4 != 3, cells)), path, 4)
    return readers.slider_settings(readers.scenarios(spark, path))


def csv_round_trip(spark, sf_dir):
    """The utterance list written as CSV with a header and read back."""
    rows = _table(spark, sf_dir, "documents").select("text", F.create_map(F.lit("Normalized Score"), (F.col("doc_id") / 8).cast("string")).alias("meta"))
    path = _path(spark, "utterances-csv")
    sinks.write_csv(studies.utterance_list(rows, "the"), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="`Utterance` string, `Normalized Score` double", lineSep="\n", enforceSchema=False)
    return back.select(F.md5("Utterance").alias("utterance_md5"), F.col("Normalized Score").alias("score"))


def utterance_scan(spark, sf_dir):
    """Utterances as JSON lines in as many files as their size needs; ``seq`` is their place over all files, and chunks follow it."""
    path = _path(spark, "utterances")
    docs = _table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    sinks.write_json_lines(docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("Normalized Score"), (F.col("doc_id") / 8).cast("string")).alias("meta")), path)
    return readers.utterances(spark, path).select(F.col("id").cast("long").alias("doc_id"), "seq", F.expr(f"seq div {fixed.CHUNK}").alias("chunk"), F.md5("text").alias("text_md5"), readers.score().alias("score"))


def row_numbers(spark, sf_dir):
    """Gapless numbers in the order of source and doc_id, without a one-task window."""
    return with_seq(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", name="number", start=1).select("doc_id", F.col("number").cast("long").alias("number"))


def _dump(spark, sf_dir) -> str:
    path, docs = _path(spark, "dump"), _table(spark, sf_dir, "documents").orderBy("doc_id")
    text = F.struct(F.col("text").alias("_VALUE"), F.lit("x").alias("_bytes"))
    editor = F.struct(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("username"))
    revision = F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), editor.alias("contributor"), text.alias("text"))
    pages = docs.select(F.concat(F.lit("User talk:"), F.col("source")).alias("title"), F.when(F.col("lang") == "en", "3").otherwise("0").alias("ns"), F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.array(revision)).alias("revision"))
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").option("compression", "bzip2").save(path)
    return path


def xml_talk_pages(spark, sf_dir):
    """Talk pages of one namespace that have a revision, out of a compressed XML dump."""
    found = studies.extract_talk_pages(spark, _dump(spark, sf_dir))
    return found.select("page_id", "title", "timestamp", "last_editor", F.length("text").cast("long").alias("n_chars"), F.md5(F.trim("text")).alias("text_md5"))


def xml_first_pages(spark, sf_dir):
    """The dump's first pages of the namespace, in file order: the limit comes before the test for a revision."""
    return studies.extract_talk_pages(spark, _dump(spark, sf_dir), max_pages=12).select("page_id")


def talk_page_lines(spark, sf_dir):
    """Talk pages as compressed JSON lines, read and typed."""
    path, id_ = _path(spark, "talk"), F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select(F.when(id_ % 4 == 0, "none").otherwise(id_.cast("string")).alias("page_id"), F.col("source").alias("title"), F.when(id_ % 6 != 0, "2024-01-02T03:04:05Z").alias("timestamp"), F.lit(None).cast("string").alias("last_editor"), "text")
    sinks.write_json_lines(rows, path, bzip2=True)
    return readers.typed_talk_pages(readers.talk_page_lines(spark, path)).select("page_id", "title", F.year("timestamp").alias("year"), "last_editor", F.md5("text").alias("text_md5"))


def first_contexts(spark, sf_dir):
    """The first six contexts of a phrase in the order of the files' lines."""
    path = _path(spark, "talk")
    rows = _table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("title"), F.lit("t").alias("timestamp"), F.lit("e").alias("last_editor"), "text")
    sinks.write_json_lines(rows, path)
    return studies.first_contexts(spark, path, "the").select("page_id", "sentence_position")


def request_file(spark, sf_dir):
    """Label requests written as request lines and read back."""
    path = _path(spark, "requests")
    utterances = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    sinks.write_requests(design.label_requests(design.chunks(utterances)), path)
    return readers.requests(spark, path).select("key", F.md5("prompt").alias("prompt_md5"))


def prompt_sentences(spark, sf_dir):
    """Label requests read back from their file: each prompt's numbered lines, and the line at a place (empty beyond the end)."""
    path = _path(spark, "requests")
    utterances = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    sinks.write_requests(design.label_requests(design.chunks(utterances), 1).withColumn("prompt", F.split("prompt", "sentences:\n")[1]), path)
    read = readers.requests(spark, path)
    line = lambda n: F.md5(tx.line_at(F.col("prompt"), F.lit(n)))
    return read.select("key", line(0).alias("first_md5"), line(7).alias("eighth_md5"), (tx.line_at(F.col("prompt"), F.lit(99)) == "").alias("beyond"))


def _job(spark, sf_dir):
    from .catalogue import n_scenarios, scenario_table

    provider = judge.FolderProvider(spark, judge.StubJudge())
    asked = design.single_requests(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), prompts.choice_prompt)
    return provider, judge.submit(provider, asked, _path(spark, "job"), "choices")


def job_answers(spark, sf_dir):
    """Requests submitted as a job; its results fetched, parsed and typed."""
    provider, name = _job(spark, sf_dir)
    return parse.answers(judge.fetch(spark, provider, name)).select("request_no", "key", "scenario_answer", "parse_error")


def job_list(spark, sf_dir):
    """The provider's jobs and which of them have ended."""
    provider, _ = _job(spark, sf_dir)
    return judge.job_table(spark, provider, 7).select("job_name", "state", "display_name", "ended")


def callable_answers(spark, sf_dir):
    """Every request asked once of a Python function, in batches."""
    from .catalogue import n_scenarios, scenario_table

    def answer(asked: list[str]) -> list[str]:
        return ['{"scenario_answer": "' + "ABCDE"[int(hashlib.md5(p.encode()).hexdigest()[:6], 16) % 5] + '"}' for p in asked]

    asked = design.single_requests(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir), prompts.choice_prompt)
    judged = judge.CallableJudge(answer, _path(spark, "asked"), 2).judge(asked)
    return parse.answers(judged).select("request_no", F.col("scenario_answer_typed").alias("answer"))


def swap_flag_list(spark, sf_dir):
    """The paired requests' flags in request order, with their places."""
    from .catalogue import n_scenarios, scenario_table

    flags = sinks.swap_flag_rows(design.paired_requests(scenario_table(spark, sf_dir), n_scenarios(spark, sf_dir)))
    return flags.select(F.col("place").cast("long").alias("place"), "swapped")


def frequency_frame(spark, sf_dir):
    return sinks.frequency_bars(_table(spark, sf_dir, "documents"), "lang")


def json_counts(spark, sf_dir):
    """Rows counted while they are written as JSON lines, and again when read."""
    path = _path(spark, "turns")
    watched, seen = sinks.counted(_table(spark, sf_dir, "conversations"), user=F.col("role") == "user")
    sinks.write_json_lines(watched, path)
    back = spark.read.schema("conv_id long, turn long, role string, text string").json(path)
    return back.agg(F.count("*").alias("n_read"), F.sum(F.length("text")).alias("n_chars")).select(F.lit(seen.get["rows"]).cast("long").alias("n_written"), F.lit(seen.get["user"]).cast("long").alias("n_user"), "n_read", "n_chars")


def exact_words(spark, sf_dir):
    """Voted sentences whose word is exactly one of the judges' words."""
    from .catalogue import _three

    return consensus.with_word(consensus.consensus(_three(spark, sf_dir)), "x").select("doc_id", "is_modifier")


def queries() -> dict:
    """name: (query, SQL)."""
    from . import catalogue as c

    def crlf(cell: str) -> str:
        return f"replace({cell}, chr(10), chr(13) || chr(10))"

    numbered = "'request-' || CASE WHEN v = 0 THEN '' ELSE 'hedge-' END || CAST(n AS VARCHAR)"
    jobs = f"""
WITH {c._SCENARIOS}, f AS (SELECT v, ((modifier_no * (SELECT max(item_id) + 1 FROM benchmark) + scenario_id) * 3 + attempt) * 2 + v + 1 AS n FROM scenarios, modifiers, attempts, (VALUES (0), (1)) AS t(v))"""
    choices = c.QUERIES["factorial_requests"][1]
    return {
        "scenario_scan": (scenario_scan, f"""
WITH {c._SCENARIOS} SELECT row_number() OVER (ORDER BY scenario_id) - 1 AS scenario_id, predicate, {crlf('baseline')} AS baseline, {crlf('c1')} AS c1, {crlf('hedged_baseline')} AS hedged_baseline,
  CAST(NULL AS VARCHAR) AS c2, politeness_question, predicate_question FROM scenarios"""),
        "slider_scan": (slider_scan, f"""
WITH {c._SCENARIOS}, k AS (SELECT unnest(range(10)) AS k)
SELECT scenario_id, 'S' || CAST(scenario_id AS VARCHAR) AS speaker, modifier, CAST(k % 2 + 1 AS INTEGER) AS setting, CAST(scenario_id * k AS INTEGER) AS value
FROM scenarios, k JOIN modifiers ON modifier_no = k // 2 WHERE scenario_id % 4 <> 3 AND (scenario_id + k) % 3 <> 0"""),
        "csv_round_trip": (csv_round_trip, "SELECT md5(text) AS utterance_md5, doc_id / 8 AS score FROM documents WHERE contains(text, 'the')"),
        "utterance_scan": (utterance_scan, """
WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents)
SELECT doc_id, seq, seq // 30 AS chunk, md5(text) AS text_md5, doc_id / 8 AS score FROM s"""),
        "row_numbers": (row_numbers, "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS number FROM documents"),
        "xml_talk_pages": (xml_talk_pages, """
SELECT CAST(doc_id AS VARCHAR) AS page_id, 'User talk:' || source AS title, '2024-01-01T00:00:00Z' AS timestamp, CASE WHEN doc_id % 3 <> 0 THEN 'u' || CAST(doc_id AS VARCHAR) END AS last_editor,
       length(text) AS n_chars, md5(trim(text)) AS text_md5 FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0"""),
        "xml_first_pages": (xml_first_pages, """
WITH p AS (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 12) SELECT CAST(doc_id AS VARCHAR) AS page_id FROM p WHERE doc_id % 5 <> 0"""),
        "talk_page_lines": (talk_page_lines, """
SELECT CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS page_id, source AS title, CASE WHEN doc_id % 6 <> 0 THEN CAST(2024 AS INTEGER) END AS year, CAST(NULL AS VARCHAR) AS last_editor, md5(text) AS text_md5 FROM documents"""),
        "first_contexts": (first_contexts, f"WITH k AS ({c._KWIC_SQL}) SELECT CAST(doc_id AS VARCHAR) AS page_id, sentence_position FROM k ORDER BY doc_id LIMIT 6"),
        "request_file": (request_file, f"SELECT key, prompt_md5 FROM ({c.QUERIES['chunk30_prompts'][1]})"),
        "prompt_sentences": (prompt_sentences, r"""
WITH s AS (SELECT doc_id // 30 AS chunk, min_by(replace(text, chr(10), ' '), doc_id) AS first, max(replace(text, chr(10), ' ')) FILTER (WHERE doc_id % 30 = 7) AS eighth FROM documents GROUP BY 1)
SELECT 'request-' || CAST(chunk + 1 AS VARCHAR) || '-1' AS key, md5(first) AS first_md5, md5(coalesce(eighth, '')) AS eighth_md5, true AS beyond FROM s"""),
        "job_answers": (job_answers, f"""{jobs} SELECT n AS request_no, {numbered} AS key, substr('ABCDE', CAST('0x' || substr(md5({numbered}), 1, 6) AS INTEGER) % 5 + 1, 1) AS scenario_answer, CAST(NULL AS VARCHAR) AS parse_error FROM f"""),
        "job_list": (job_list, f"SELECT 'batches/1' AS job_name, '{fixed.ENDED_STATES[0]}' AS state, 'choices' AS display_name, true AS ended"),
        "callable_answers": (callable_answers, f"SELECT request_no, substr('ABCDE', CAST('0x' || substr(prompt_md5, 1, 6) AS INTEGER) % 5 + 1, 1) AS answer FROM ({choices})"),
        "swap_flag_list": (swap_flag_list, f"SELECT row_number() OVER (ORDER BY request_no) - 1 AS place, swapped FROM ({c.QUERIES['paired_requests'][1]})"),
        "frequency_frame": (frequency_frame, "SELECT lang AS label, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) AS frequency FROM documents GROUP BY lang"),
        "json_counts": (json_counts, "SELECT count(*) AS n_written, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) AS n_read, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations"),
        "exact_words": (exact_words, f"SELECT doc_id, is_modifier FROM ({c.QUERIES['judge_vote'][1]}) WHERE modifier_word = 'x'"),
    }
