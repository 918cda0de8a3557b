"""The stem rules as SQL: one subquery per step over ``(word, w, r1, r2)``."""

from __future__ import annotations

from caresift.functions import stemming as S


def _cut(n: int, to: str = "w") -> str:
    return f"substr({to}, 1, length({to}) - {n})"


def _step(source: str, cases: list[str], keep: str = "w") -> str:
    guard = f"word IN ({', '.join(repr(k) for k in S.IRREGULAR)}) OR length(word) <= 2"
    return f"(SELECT word, r1, r2, CASE WHEN {guard} THEN w {' '.join(cases)} ELSE {keep} END AS w FROM {source})"


def _rules(rules: list[tuple[str, str]], region, extra: dict[str, str]) -> list[str]:
    return [f"WHEN ends_with(w, '{s}') THEN CASE WHEN length(w) - {len(s)} >= {region(s)} AND {extra.get(s, 'TRUE')} THEN {_cut(len(s))} || '{new}' ELSE w END" for s, new in rules]


def stems(words: str) -> str:
    """A subquery ``word, stem`` for the distinct words of a subquery with the column ``word``."""
    kept = f"w IN ({', '.join(repr(k) for k in S.KEPT)})"
    q = f"(SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({S.VOWEL})y', '\\1Y', 'g') AS w FROM {words})"
    q = f"(SELECT *, regexp_extract(w, '^({'|'.join(S.PREFIXES)})|{S.REGION}') AS h1 FROM {q})"
    q = f"(SELECT word, w, CASE WHEN h1 = '' THEN length(w) ELSE length(h1) END AS r1 FROM {q})"
    q = f"(SELECT *, regexp_extract(substr(w, r1 + 1), '{S.REGION}') AS h2 FROM {q})"
    q = f"(SELECT word, w, r1, CASE WHEN h2 = '' THEN length(w) ELSE r1 + length(h2) END AS r2 FROM {q})"
    q = _step(q, [
        f"WHEN ends_with(w, 'sses') THEN {_cut(2)}", f"WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END",
        "WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w", f"WHEN regexp_matches(w, '{S.VOWEL}.+s$') THEN {_cut(1)}",
    ])
    q = f"(SELECT *, CASE WHEN {kept} THEN 0 WHEN ends_with(w, 'eedly') THEN -5 WHEN ends_with(w, 'ingly') THEN 5 WHEN ends_with(w, 'edly') THEN 4 WHEN ends_with(w, 'eed') THEN -3 WHEN ends_with(w, 'ing') THEN 3 WHEN ends_with(w, 'ed') THEN 2 ELSE 0 END AS n, {kept} AS kept FROM {q})"
    q = f"(SELECT word, r1, r2, kept, CASE WHEN n < 0 AND length(w) + n >= r1 THEN substr(w, 1, length(w) + n) || 'ee' ELSE w END AS w, n > 0 AND regexp_matches(substr(w, 1, length(w) - n), '{S.VOWEL}') AS mend, substr(w, 1, length(w) - greatest(n, 0)) AS v FROM {q})"
    q = f"""(SELECT word, r1, r2, kept, CASE WHEN NOT mend THEN w WHEN regexp_matches(v, '(at|bl|iz)$') THEN v || 'e' WHEN regexp_matches(v, '({'|'.join(S.DOUBLES)})$') THEN {_cut(1, 'v')}
        WHEN regexp_matches(v, '{S.SHORT}') AND length(v) <= r1 THEN v || 'e' ELSE v END AS w FROM {q})"""
    q = f"(SELECT word, CASE WHEN kept THEN 0 ELSE r1 END AS r1, CASE WHEN kept THEN 0 ELSE r2 END AS r2, CASE WHEN kept THEN upper(w) ELSE regexp_replace(w, '^(.+{S.CONSONANT})[yY]$', '\\1i') END AS w FROM {q})"
    q = _step(q, _rules(S.DERIVATIONS, lambda s: "r1", {"ogi": "ends_with(w, 'logi')", "li": f"regexp_matches(w, '{S.LI_ENDINGS}li$')"}))
    q = _step(q, _rules(S.ENDINGS, lambda s: "r2" if s == "ative" else "r1", {}))
    q = _step(q, _rules([(s, "") for s in S.REMOVED], lambda s: "r2", {"ion": "regexp_matches(w, '[st]ion$')"}))
    q = _step(q, [
        f"WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches({_cut(1)}, '{S.SHORT}')) THEN {_cut(1)} ELSE w END",
        f"WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {_cut(1)}",
    ])
    own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.IRREGULAR.items())
    return f"(SELECT word, CASE word {own} ELSE CASE WHEN length(word) <= 2 THEN word ELSE lower(w) END END AS stem FROM {q})"
