"""Prompts as Column expressions over the fixed formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import modified, quoted, unmodified, word


def filled(form: str, **values: Column) -> Column:
    """The format with each ``{name}`` replaced by a column; other braces stay."""
    names = "|".join(values)
    parts = re.split(r"\{(" + names + r")\}", form) if names else [form]
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def lettered(options: list[str]) -> Column:
    return F.lit("".join(f"({c}) {o}\n" for c, o in zip("ABCDE", options)))


def _scale(predicate: Column, make) -> Column:
    """One value for each predicate; null for unknown ones."""
    out = F.lit(None).cast("string")
    for name, options in fixed.SCALES.items():
        out = F.when(predicate == name, make(options)).otherwise(out)
    return out


def predicate_options(predicate: Column) -> Column:
    return _scale(predicate, lettered)


def _said(scenario: Column, question: Column, modifier: Column) -> dict[str, Column]:
    return {"speaker": word(question, 3), "quote": modified(quoted(scenario), modifier), "modifier": modifier}


def choice_prompt(scenario: Column, predicate: Column, question: Column, modifier: Column) -> Column:
    """Magnitude, one of five."""
    form = fixed.SINGLE_HEAD + fixed.CHOICE_QUESTION
    return F.concat(filled(form, plain=unmodified(scenario), options=predicate_options(predicate), **_said(scenario, question, modifier)), F.lit(fixed.SINGLE_CHOICE_TAIL))


def rating_prompt(scenario: Column, predicate: Column, question: Column, modifier: Column) -> Column:
    """Magnitude, 1 to 7."""
    low, high = (_scale(predicate, lambda o, k=k: F.lit(o[k].lower())) for k in (0, 4))
    form = fixed.SINGLE_HEAD + fixed.RATING_QUESTION
    return F.concat(filled(form, plain=unmodified(scenario), predicate=predicate, low=low, high=high, **_said(scenario, question, modifier)), F.lit(fixed.SINGLE_NUMBER_TAIL))


def politeness_prompt(scenario: Column, predicate: Column, question: Column, modifier: Column) -> Column:
    """Politeness, one of five; the predicate isn't used."""
    form = fixed.SINGLE_HEAD + fixed.POLITENESS_QUESTION
    return F.concat(filled(form, plain=unmodified(scenario), options=lettered(fixed.POLITENESS), **_said(scenario, question, modifier)), F.lit(fixed.SINGLE_CHOICE_TAIL))


def _pair(one: Column, two: Column, swap: Column, question: Column, modifier: Column, ask: str, options: Column, tail: str) -> Column:
    first, second = F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)
    body = filled(fixed.PAIR_HEAD + ask, first=unmodified(first), second=unmodified(second), options=options, **_said(one, question, modifier))
    return F.concat(body, F.lit(tail + fixed.PAIR_JSON))


def paired_choice_prompt(one: Column, two: Column, swap: Column, predicate: Column, question: Column, modifier: Column) -> Column:
    """Magnitude of two scenarios; swapped ones change places, but the quote is always the first one's."""
    return _pair(one, two, swap, question, modifier, fixed.PAIR_CHOICE_QUESTION, predicate_options(predicate), fixed.PAIR_CHOICE_TAIL)


def paired_politeness_prompt(one: Column, two: Column, swap: Column, predicate: Column, question: Column, modifier: Column) -> Column:
    return _pair(one, two, swap, question, modifier, fixed.POLITENESS_QUESTION, lettered(fixed.POLITENESS), fixed.PAIR_POLITENESS_TAIL)


def scenario_entry(number: Column, scenario: Column, question: Column) -> Column:
    """One scenario in the prompt that asks about all of them."""
    return F.concat(F.lit("Scenario "), number.cast("string"), F.lit(":\n"), scenario, F.lit("\nQuestion: "), question, F.lit("\n\n"))


def all_rating_prompt(entries: Column) -> Column:
    return F.concat(F.lit(fixed.ALL_RATING_HEAD + "\n\n"), entries, F.lit(fixed.ALL_RATING_TAIL))


def contains_prompt(lines: Column, tail: Column) -> Column:
    """True/False over numbered sentences; the last, partial chunk is asked a little differently."""
    return F.concat(F.when(tail, F.lit(fixed.CONTAINS_TAIL_HEAD)).otherwise(F.lit(fixed.CONTAINS_HEAD)), lines)


def label_prompt(lines: Column) -> Column:
    return F.concat(F.lit(fixed.LABEL_HEAD), lines, F.lit(fixed.LABEL_TAIL))


def polite_prompt(lines: Column) -> Column:
    return F.concat(F.lit(fixed.POLITE_HEAD), lines)


def context_prompt(phrase: Column, title: Column, before: Column, target: Column, after: Column) -> Column:
    return filled(fixed.CONTEXT_PROMPT, phrase=phrase, title=title, before=before, target=target, after=after)
