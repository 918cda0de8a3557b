"""Keyword rules compiled to Column expressions.

A rule is a category and its keywords; a rule set is ordered and the first rule that hits wins.  Rule sets are data:
callers build them in code or read them from a table (``read_rules``).

Keywords are looked up with ``exists(array(...), k -> contains(text, k))``.  The keyword array folds to one literal, so
the generated code stays small however many keywords there are, and the byte search inside ``contains`` needs no regex:
measured on 10,000 documents with 20 rules of 13 keywords it took 2.5 s against 12 s for one alternation regex per rule
and 4 s for chains of OR.  The text is bound to a lambda variable first (``bound``), so it is lower-cased once and not
once per keyword.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULE_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    category: str
    keywords: tuple[str, ...]


def rule_set(pairs: Iterable[tuple[Sequence[str], str]]) -> list[Rule]:
    """Rules from ``(keywords, category)`` pairs, in order."""
    return [Rule(category, tuple(k.lower() for k in keywords)) for keywords, category in pairs]


def read_rules(table: DataFrame, name: str) -> list[Rule]:
    """Rules of one name from a table ``(rule_set, rule_idx, category, keyword)``.

    Rules become part of the query text, so the table must be small; more than ``MAX_RULE_ROWS`` rows is an error.
    ``operators.classify.first_rules`` takes tables of any size.
    """
    rows = table.where(F.col("rule_set") == name).orderBy("rule_idx", "keyword").limit(MAX_RULE_ROWS + 1).collect()
    if len(rows) > MAX_RULE_ROWS:
        raise ValueError(f"rule set {name!r} has more than {MAX_RULE_ROWS} keywords")
    grouped: dict[tuple[int, str], list[str]] = {}
    for row in rows:
        grouped.setdefault((row.rule_idx, row.category), []).append(row.keyword)
    return rule_set((keywords, category) for (_, category), keywords in grouped.items())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Expressions inside lambdas are evaluated at every step and know no common subexpressions; a lambda variable is the
    only thing that stays computed.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyword_array(keywords: Iterable[str]) -> Column:
    return F.array(*[F.lit(k) for k in keywords])


def _hits(text: Column, keywords: Iterable[str]) -> Column:
    return F.exists(keyword_array(keywords), lambda k: F.contains(text, k))


def any_keyword(lowered: Column, keywords: Iterable[str]) -> Column:
    """CLS-01: true when any keyword is a substring; ``lowered`` must be lower-cased already."""
    return bound(lowered, lambda t: _hits(t, keywords))


def count_keywords(lowered: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords are substrings."""
    return bound(lowered, lambda t: F.size(F.filter(keyword_array(keywords), lambda k: F.contains(t, k))))


def _first(text: Column, rules: Sequence[Rule], guard: Callable[[Rule], Column] | None = None) -> Column:
    chain = None
    for rule in rules:
        hit = _hits(text, rule.keywords)
        if guard is not None:
            hit = guard(rule) & hit
        chain = F.when(hit, rule.category) if chain is None else chain.when(hit, rule.category)
    return F.lit(None).cast("string") if chain is None else chain


def first_match(lowered: Column, rules: Sequence[Rule]) -> Column:
    """CLS-02: category of the first rule that hits, else null; later rules are not evaluated."""
    return bound(lowered, lambda t: _first(t, rules))


def first_match_other_than(lowered: Column, rules: Sequence[Rule], category: Column) -> Column:
    """Category of the first rule that hits and whose category differs from ``category``."""
    return bound(lowered, lambda t: _first(t, rules, lambda rule: category != F.lit(rule.category)))


def _rule_table(rules: Sequence[Rule]) -> Column:
    return F.array(*[keyword_array(r.keywords) for r in rules])


def hit_array(lowered: Column, rules: Sequence[Rule]) -> Column:
    """One boolean per rule."""
    return bound(lowered, lambda t: F.transform(_rule_table(rules), lambda ks: F.exists(ks, lambda k: F.contains(t, k))))


def count_array(lowered: Column, rules: Sequence[Rule]) -> Column:
    """One keyword count per rule."""
    return bound(lowered, lambda t: F.transform(_rule_table(rules), lambda ks: F.size(F.filter(ks, lambda k: F.contains(t, k)))))


def ranked_categories(parts: Sequence[tuple[Sequence[Rule], Column, int]]) -> Column:
    """Categories by score, best first, as ``array<struct<score, neg_seen, category>>`` (zero scores left out).

    Each part is ``(rules, counts, weight)`` where ``counts`` is an int or boolean array aligned with ``rules``.  Ties
    go to the category scored first: parts in order, rules in order within a part.
    """
    score: dict[str, Column] = {}
    seen: dict[str, list[Column]] = {}
    position = 0
    for rules, counts, weight in parts:
        for index, rule in enumerate(rules):
            points = counts[index].cast("int") * F.lit(weight)
            score[rule.category] = score[rule.category] + points if rule.category in score else points
            seen.setdefault(rule.category, []).append(F.when(points > 0, F.lit(-position)))
            position += 1
    entries = [
        F.struct(
            score[c].alias("score"), F.coalesce(*seen[c], F.lit(-position)).alias("neg_seen"), F.lit(c).alias("category")
        )
        for c in score
    ]
    return F.sort_array(F.filter(F.array(*entries), lambda e: e["score"] > 0), asc=False)


def scored_categories(parts: Sequence[tuple[Sequence[Rule], Column, int]], default: str, runner_up_from: int = 2) -> Column:
    """``struct<primary, secondary>``: best scored category (else ``default``) and the runner-up with enough points.

    Everything happens in one expression: a filter on a category that the optimizer pushes below it repeats the
    expression once, and not once per rule.
    """
    hits = F.struct(*[counts.alias(f"p{i}") for i, (_, counts, _) in enumerate(parts)])

    def ranked(h: Column) -> Column:
        return ranked_categories([(rules, h[f"p{i}"], weight) for i, (rules, _, weight) in enumerate(parts)])

    def chosen(r: Column) -> Column:
        best, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        return F.struct(
            F.coalesce(best["category"], F.lit(default)).alias("primary"),
            F.when(second["score"] >= runner_up_from, second["category"]).alias("secondary"),
        )

    return bound(hits, lambda h: bound(ranked(h), chosen))
