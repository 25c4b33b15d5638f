"""Whole studies as plans: choices, labelling, keyword in context, ratings, utterance list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, prompts
from ..functions.text import contains_phrase, found_filter, matches
from ..operators import consensus, context, design, parse
from ..operators.judge import Judge
from ..sources import readers


def choice_answers(requests: DataFrame, judge: Judge) -> DataFrame:
    """The requests with their parsed answers and parse_error, as ``parse.with_rejects`` takes them."""
    return parse.answers(judge.judge(requests))


def choice_table(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """modifier, question, baseline, hedge_baseline: the attempts' answers of each scenario, joined by key and concatenated; a request without an answer adds nothing."""
    by = ["modifier_no", "modifier", "scenario_id", "question"]
    joined = requests.select("key", *by, "variant", "attempt").join(answered.select("key", "scenario_answer"), "key", "left")
    wide = consensus.replicates(joined, by, "variant", ["baseline", "hedge_baseline"])
    return wide.select("modifier_no", "scenario_id", "modifier", "question", "baseline", "hedge_baseline")


def choice_study(scenarios: DataFrame, n_scenarios: int, judge: Judge, prompt=prompts.choice_prompt, question: str = "predicate_question") -> DataFrame:
    """modifier, question, baseline, hedge_baseline: the attempts' answers of each scenario, joined by key and concatenated."""
    requests = design.single_requests(scenarios, n_scenarios, prompt, question)
    answered = choice_answers(requests, judge)
    by = ["modifier_no", "modifier", "scenario_id", "question"]
    wide = consensus.replicates(answered, by, "variant", ["baseline", "hedge_baseline"])
    return wide.select("modifier_no", "scenario_id", "modifier", "question", "baseline", "hedge_baseline")


def paired_study(scenarios: DataFrame, n_scenarios: int, judge: Judge, polite: bool = False) -> DataFrame:
    """The paired answers in the scenarios' own order, with errors."""
    requests = design.paired_requests(scenarios, n_scenarios, polite)
    return consensus.unswapped(parse.answers(judge.judge(requests), ("scenario_1_answer", "scenario_2_answer")))


def rating_requests(items: DataFrame, attempts: int = fixed.ATTEMPTS, seed: str | None = None, size: int | None = None) -> DataFrame:
    """(attempt, key, prompt, order): each attempt asks about all items in one prompt, or about each ``size`` in one; ``order`` has their ``seq`` as the prompt shows them."""
    asked = None
    for a in range(attempts):
        made = design.rating_prompt(items, None if seed is None else f"{seed}-{a}", size)
        key = F.lit(f"rating-{a + 1}") if size is None else F.concat(F.lit(f"rating-{a + 1}-"), (F.col("chunk") + 1).cast("string"))
        one = made.select(F.lit(a).alias("attempt"), key.alias("key"), "prompt", "order")
        asked = one if asked is None else asked.unionByName(one)
    return asked


def rating_answers(requests: DataFrame, judge: Judge, literal: bool = False) -> DataFrame:
    """The requests with the list of answers and parse_error.

    Answers are joined by place, so a list of another length than the prompt's items is rejected whole; literally, what a longer one has beyond them is ignored.
    """
    return parse.list_answers(judge.judge(requests), F.size("order"), cut=literal)


def rating_table(items: DataFrame, answered: DataFrame, literal: bool = False) -> DataFrame:
    """modifier, question and the four forms' ratings, each attempt followed by ", "; a rejected attempt adds nothing."""
    each = answered.filter("answers is not null").select("attempt", "order", F.posexplode("answers").alias("place", "answer"))
    placed = each.select("attempt", F.get("order", F.col("place")).alias("seq"), "answer")
    forms = ["baseline_unmodified", "baseline_modified", "c1_unmodified", "c1_modified"]
    joined = items.join(placed, "seq", "left")
    columns = [consensus.ordered_concat("attempt", F.when(F.col("form") == f, F.col("answer")), after=", ").alias(f) for f in forms]
    wide = joined.groupBy("modifier_no", "modifier", "scenario_id", "question").agg(*columns)
    if literal:
        wide = wide.withColumn("modifier", F.substring(F.lit(fixed.MODIFIERS[-1]), F.col("modifier_no") + 1, F.lit(1)))
    return wide.select("modifier_no", "scenario_id", "modifier", "question", *forms)


def rating_study(scenarios: DataFrame, n_scenarios: int, judge: Judge, attempts: int = fixed.ATTEMPTS, seed: str | None = None, literal: bool = False, size: int | None = None) -> DataFrame:
    """The ratings of all scenarios, asked in one prompt or in prompts of ``size`` items.  Literally, the label is a letter of the last modifier instead of the modifier."""
    items = design.rating_items(scenarios, n_scenarios)
    return rating_table(items, rating_answers(rating_requests(items, attempts, seed, size), judge, literal), literal)


def labelling_study(utterances: DataFrame, judge: Judge, keep_tail: bool = True, literal: bool = False) -> DataFrame:
    """seq, sentence_text, is_modifier, modifier_word of utterances with gapless ``seq``, by three judges.

    Sentences stay in their table; prompts are never read back.
    """
    chunked = design.chunks(utterances, keep_tail=keep_tail)
    judged = parse.label_answers(judge.judge(design.label_requests(chunked)), literal)
    rows = utterances.select(F.expr(f"seq div {fixed.CHUNK}").alias("chunk"), (F.col("seq") % fixed.CHUNK).cast("int").alias("place"), "seq", F.col("text").alias("sentence_text"))
    rows = rows if keep_tail else rows.join(chunked.select("chunk"), "chunk", "left_semi")
    return consensus.consensus(consensus.wide_judgements(rows, judged.select("chunk", "judge", "labels")), literal).drop("chunk", "place")


def modifier_sentences(labelled: DataFrame) -> DataFrame:
    """The sentences with a modifier, the first of equal ones."""
    return consensus.keep_first(labelled.filter("is_modifier"), ["sentence_text"])


def read_prompt_sentences(requests: DataFrame) -> DataFrame:
    """(request_no, place, sentence) read back from label prompts of foreign files; the prompt's footer counts as a line."""
    from ..functions.text import numbered_lines, request_number

    return requests.select(request_number(F.col("key")).alias("request_no"), F.posexplode(numbered_lines(F.col("prompt"))).alias("place", "sentence"))


def talk_page_contexts(pages: DataFrame, phrase: str, around: int = 3, most: int | None = 6, order: str = "place") -> DataFrame:
    """Contexts of a phrase in talk pages; the first ``most`` in order, by default that of the files, as the study stops after six."""
    found = context.keyword_in_context(pages, phrase, around)
    return found.orderBy(order).limit(most) if most else found


def first_contexts(spark: SparkSession, path: str, phrase: str, most: int = 6, around: int = 3) -> DataFrame:
    """The first ``most`` contexts in the files of talk pages; the search ends with the files that have them."""
    def find(files: list[str]) -> DataFrame:
        return context.keyword_in_context(readers.talk_page_lines(spark, files, placed=True), phrase, around)

    return readers.first_found(spark, path, find, most)


def context_requests(contexts: DataFrame) -> DataFrame:
    """A request about each context, keyed by its page."""
    text = prompts.context_prompt(F.col("phrase"), F.col("title"), F.col("before_context"), F.col("target_sentence"), F.col("after_context"))
    return contexts.withColumns({"key": F.concat(F.lit("context-"), F.col("page_id")), "prompt": text})


def pages_with(pages: DataFrame, pattern: str) -> DataFrame:
    """Pages whose text has the pattern (case counts; null text doesn't match)."""
    return pages.filter(matches(F.col("text"), pattern))


def last_pages(pages: DataFrame, n: int = 2, order: str = "seq") -> DataFrame:
    """The last n rows, in their own order."""
    return pages.orderBy(F.desc(order)).limit(n).orderBy(order)


def utterance_list(utterances: DataFrame, phrase: str = "a bit", literal: bool = False) -> DataFrame:
    """(Utterance, Normalized Score) of utterances with the phrase."""
    return utterances.filter(found_filter(F.col("text"), phrase, literal)).select(F.col("text").alias("Utterance"), readers.score().alias("Normalized Score"))


def polite_request(utterances: DataFrame, first: int = fixed.CHUNK) -> DataFrame:
    """One prompt about the first utterances."""
    return design.chunks(utterances.filter(F.col("seq") < first), first).select(prompts.polite_prompt(F.col("lines")).alias("prompt"))


def contains_requests(utterances: DataFrame) -> DataFrame:
    """Prompts over chunks with running numbers; a partial last chunk has the other heading."""
    chunked = design.chunks(utterances, restart=False)
    return chunked.select("chunk", "n", prompts.contains_prompt(F.col("lines"), F.col("n") < fixed.CHUNK).alias("prompt"))


def extract_talk_pages(spark: SparkSession, dump: str, namespace: str = "3", max_pages: int | None = None) -> DataFrame:
    """Talk pages of a dump; with ``max_pages``, the dump's files are read only as far as these pages need."""
    if max_pages:
        return readers.first_talk_pages(spark, dump, max_pages, namespace)
    return readers.talk_pages(readers.wiki_pages(spark, dump), namespace)


def keyed_prompts(rows: DataFrame, prompts_by_key: DataFrame, key: str = "key") -> DataFrame:
    """The rows with the columns of ``prompts_by_key`` that have their key, nulls where none has; of repeated keys there the least prompt counts.

    Each row stays one row, whatever the other table repeats; a null key has no prompt.
    """
    others = [c for c in prompts_by_key.columns if c != key]
    one = prompts_by_key.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*others)).alias("_one"))
    return rows.join(one, rows[key] == one["_key"], "left").select(*[rows[c] for c in rows.columns], "_one.*")


def mentions(df: DataFrame, phrase: str) -> DataFrame:
    return df.filter(contains_phrase(F.col("text"), phrase))
