"""Answer extraction and span scoring (PRJ-11 … PRJ-15) as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X
from caresift.functions.rules import bound

CHOICE = r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"
LINE = r"(?i)Answer\s*:\s*([^\n]+)"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def choice_letter(response: Column) -> Column:
    """PRJ-11."""
    return found(response, CHOICE)


def without_markup(response: Column) -> Column:
    """PRJ-12: markdown and LaTeX wrappers removed, in order."""
    for piece in K.MARKUP_TO_DROP:
        response = F.replace(response, F.lit(piece), F.lit(""))
    return response


def multilingual_letter(response: Column, prefixes: Sequence[str] = K.ANSWER_PREFIXES, letters: str = K.ANSWER_LETTERS) -> Column:
    """PRJ-12: letter after the first prefix (in list order) that is found, as A–D; null without any.

    ``response`` should be a column made with ``without_markup`` (it is read once per prefix).  Patterns that cannot match are skipped by one cheap test: no
    prefix matches a text without its last character, a colon of one kind or another.
    """
    hits = [found(response, f"(?i){p}[ \\t]*({letters})") for p in prefixes]
    letter = F.coalesce(*hits)
    return F.when(response.rlike("[:：ঃ]"), X.strip(F.translate(letter, "".join(K.LETTER_FORMS), "".join(K.LETTER_FORMS.values()))))


def answer_line(response: Column) -> Column:
    """PRJ-13."""
    return found(response, LINE)


def number_answer(response: Column, prefix: Column) -> Column:
    """PRJ-14: the last number after the last ``prefix`` ('' when there is no prefix or no number after it)."""
    # the text after the last prefix is the text before the first reversed prefix of the reversed text
    tail = F.reverse(F.split_part(F.reverse(response), F.reverse(prefix), F.lit(1)))
    numbers = F.regexp_extract_all(F.replace(tail, F.lit(","), F.lit("")), F.lit(r"\d+\.?\d*"), 0)
    last = F.regexp_replace(F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit("")), r"\.+$", "")
    return F.when(F.contains(response, prefix), last).otherwise(F.lit(""))


def same_number(target: Column, predicted: Column) -> Column:
    """PRJ-14: equal after removing thousands separators and trailing zeros after a point of the prediction."""
    comma = lambda c: F.replace(c, F.lit(","), F.lit(""))
    trimmed = F.when(
        F.contains(predicted, F.lit(".")), F.regexp_replace(F.regexp_replace(predicted, "0+$", ""), r"\.+$", "")
    ).otherwise(predicted)
    return comma(target) == comma(trimmed)


PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def normalized_answer(c: Column) -> Column:
    """PRJ-15: lower case; per blank- or dash-separated part: no punctuation (unless a number), no articles."""
    def part(t: Column) -> Column:
        bare = F.when(_is_number(t), t).otherwise(F.regexp_replace(t, PUNCTUATION, ""))
        number = F.when(_is_number(bare), bare.try_cast("double").cast("string")).otherwise(bare)
        plain = F.regexp_replace(number, r"\b(a|an|the)\b", " ")
        return X.strip(F.regexp_replace(plain, r"\s+", " "))

    parts = F.filter(F.transform(F.split(F.lower(c), " |-"), part), lambda t: t != "")
    return F.concat_ws(" ", parts)


def _bag(normalised: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised, r"\s+"), lambda t: t != ""))


def _answer_parts(c: Column) -> Column:
    def with_bag(text: Column) -> Column:
        bag = _bag(text)
        return F.struct(text.alias("text"), bag.alias("bag"), F.filter(bag, _is_number).alias("numbers"))

    return bound(normalized_answer(c), with_bag)


def _scored(p: Column, g: Column) -> Column:
    def of(common: Column) -> Column:
        precision = F.when(F.size(p["bag"]) == 0, F.lit(1.0)).otherwise(common / F.size(p["bag"]))
        recall = F.when(F.size(g["bag"]) == 0, F.lit(1.0)).otherwise(common / F.size(g["bag"]))
        f1 = F.when((precision == 0) & (recall == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall)) * 100
        gate = (F.size(g["numbers"]) == 0) | F.arrays_overlap(g["numbers"], p["numbers"])
        return F.struct(
            F.when(p["text"] == g["text"], 1.0).otherwise(0.0).alias("em"), F.when(gate, F.round(f1, 2)).otherwise(F.lit(0.0)).alias("f1")
        )

    return bound(F.size(F.array_intersect(p["bag"], g["bag"])).cast("double"), of)


def span_scores(predicted: Column, gold: Column) -> Column:
    """PRJ-15: ``struct<em, f1>`` of one prediction against one reference.

    F1 of the token sets, times 100, zero when the reference has numbers and none of them is predicted.
    """
    return bound(_answer_parts(predicted), lambda p: bound(_answer_parts(gold), lambda g: _scored(p, g)))


def loosely_normalized(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), PUNCTUATION, "")
    return X.strip(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def fuzzy_match(a: Column, b: Column) -> Column:
    """PRJ-15: one contains the other after normalisation; blank only matches blank."""
    x, y = loosely_normalized(a), loosely_normalized(b)
    return F.when((x == "") | (y == ""), x == y).otherwise(F.contains(x, y) | F.contains(y, x))


def best_span(predicted: Column, references: Column) -> Column:
    """PRJ-15: best exact match and best F1 over the non-blank references."""
    def against(p: Column) -> Column:
        return F.transform(F.filter(references, X.filled), lambda r: bound(_answer_parts(r), lambda g: _scored(p, g)))

    def best(scores: Column) -> Column:
        return F.struct(
            F.array_max(F.transform(scores, lambda s: s["em"])).alias("em"),
            F.array_max(F.transform(scores, lambda s: s["f1"])).alias("f1"),
        )

    return bound(bound(_answer_parts(predicted), against), best)


def judged_yes(judgement: Column) -> Column:
    """AG-22: the judge's line says ``correct: yes``."""
    return F.lower(F.regexp_extract(judgement, r"(?i)correct:\s*(yes|no)", 1)) == "yes"
