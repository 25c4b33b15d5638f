"""Column functions over text, arrays and loosely formatted answers.

All are expressions of built-in functions, so Catalyst sees through them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import SLOT

#: JSON as the standard has it.
STRICT = {"allowSingleQuotes": "false"}
TERMINATED = r"(?U)(?<=[.!?;])\s+"


def unmodified(template: Column) -> Column:
    """The template without its slot and the blank after it."""
    return F.replace(template, F.lit(SLOT + " "), F.lit(""))


def modified(template: Column, modifier: Column) -> Column:
    return F.replace(template, F.lit(SLOT), modifier)


def quoted(text: Column) -> Column:
    """What stands between the first and the last double quote; empty where there aren't two."""
    return F.regexp_extract(text, '(?s)"(.*)"', 1)


def word(text: Column, n: int) -> Column:
    """Word number n (from 0) of a text split at single blanks; null if there are fewer."""
    return F.get(F.split(text, " "), F.lit(n))


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stripped_of(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def sentences(text: Column) -> Column:
    """Split after ``. ! ? ;`` and white space; the terminators stay, and so does an empty last part."""
    return F.split(text, TERMINATED)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase occurs, whatever its case; false for null."""
    return F.coalesce(F.lower(text).contains(phrase.lower()), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def found_filter(text: Column, phrase: str, literal: bool = False) -> Column:
    """The phrase occurs; in literal mode, the truth of a find position: false only at position 0."""
    return ~text.startswith(phrase) if literal else text.contains(phrase)


def object_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty if there are none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def list_part(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\[.*\]", 0)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value as a lambda's variable, so that it is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_END = "end of the payload"


def _whole(text: Column, kind: str, end: Callable[[Column], Column], seen: Callable[[Column], Column]) -> Column:
    """The text as one JSON value of a kind, and nothing else; otherwise null.

    The text is put into a list before an element that tells its own MD5.  Only a whole value makes a list of these two: a text that closes the list early leaves that element
    out, one that adds values makes the list longer, and none can hold its own MD5.
    """
    def read(t: Column, md5: Column) -> Column:
        pair = F.from_json(F.concat(F.lit("["), t, F.lit(","), end(md5), F.lit("]")), f"array<{kind}>", STRICT)
        return once(pair, lambda p: F.when((F.size(p) == 2) & (seen(F.get(p, F.lit(1))) == md5), F.get(p, F.lit(0))))

    return once(text, lambda t: once(F.md5(t), lambda md5: read(t, md5)))


def _quoted_json(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def strict_object(text: Column, fields: str) -> Column:
    """The text as one JSON object with these fields (DDL); of repeated keys the last counts.  Null if it is anything else, such as an object and something after it."""
    end = lambda md5: F.concat(F.lit(f'{{"{_END}":'), _quoted_json(md5), F.lit("}"))
    return _whole(text, f"struct<{fields}, `{_END}`: string>", end, lambda e: e[_END])


def parsed_type(fields: T.StructType) -> T.StructType:
    """The type of what ``strict_object`` gives."""
    return T.StructType([*fields.fields, T.StructField(_END, T.StringType())])


def strict_lists_by_key(text: Column) -> Column:
    """The text as one JSON object of lists: map<string, array<string>>, repeated keys included; null if it is anything else."""
    end = lambda md5: F.concat(F.lit(f'{{"{_END}":['), _quoted_json(md5), F.lit("]}"))
    return _whole(text, "map<string,array<string>>", end, lambda e: F.get(F.get(F.map_values(e), F.lit(0)), F.lit(0)))


def strict_list(text: Column) -> Column:
    """The text as one JSON list: array<string>; null if it is anything else."""
    return _whole(text, "array<string>", lambda md5: F.concat(F.lit("["), _quoted_json(md5), F.lit("]")), lambda e: F.get(e, F.lit(0)))


def whole_json(text: Column) -> Column:
    """The text if it is one JSON value and nothing else; otherwise null."""
    return F.when(_whole(text, "string", _quoted_json, lambda e: e).isNotNull() | (stripped(text) == "null"), text)


def without_number(line: Column) -> Column:
    return F.regexp_replace(line, r"^\d+\.\s+", "")


def numbered_lines(prompt: Column) -> Column:
    """The lines of a prompt from ``1. `` on, without blank lines and numbers; empty array if there is no ``1. ``."""
    at = F.instr(prompt, "1. ")
    lines = F.split(F.substring(prompt, at, F.length(prompt)), "\n")
    kept = F.transform(F.filter(lines, lambda x: stripped(x) != ""), without_number)
    return F.when(at > 0, kept).otherwise(F.array().cast("array<string>"))


def line_at(prompt: Column, index: Column) -> Column:
    """Numbered line ``index`` (from 0), or an empty string beyond the end."""
    return F.coalesce(F.get(numbered_lines(prompt), index), F.lit(""))


def request_number(key: Column) -> Column:
    """The number in ``request-12``, ``request-hedge-12``, ``request-12-3`` and the like."""
    return F.regexp_extract(key, r"^request-(?:hedge-)?(\d+)", 1).try_cast("long")


def without_suffix(key: Column, n: int = 2) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - n)


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1", "1.0"), F.lit(False))


def answer_letter(raw: Column) -> Column:
    """The typed answer: the first A-E or number in a raw answer, null if there is none."""
    return F.nullif(F.regexp_extract(raw, r"[A-E]|\d+", 0), F.lit(""))


def hashed_swap(number: Column) -> Column:
    """A fair coin for each request that retries and reruns agree on."""
    return F.instr(F.lit("02468ace"), F.right(F.md5(number.cast("string")), F.lit(1))) > 0
