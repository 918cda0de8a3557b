"""English word stems: the Porter2 suffix rules as one column expression.

The rules are data; a step is one ``CASE`` over suffixes, longest first.  Between steps a value passes through a lambda
over one element, so that every step is computed once however often the next one looks at it.  Where a suffix may go is
a matter of two positions, found once per word: R1 and R2 begin behind the first consonant that follows a vowel.  The
expression is put together as text and parsed once: as single column calls it would take seconds to build.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the published rules of the algorithm --------------------------------------------------------------
#: Words with a stem of their own, and words that are left alone.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words left alone once a plural ending has gone.
KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
#: R1 begins behind these.
PREFIXES = ["gener", "commun", "arsen"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
LI_ENDINGS = "[cdeghkmnrt]"
DERIVATIONS = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
ENDINGS = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
REMOVED = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
REGION = f"^{CONSONANT}*{VOWEL}+{CONSONANT}"
#: A word that ends in a short syllable.
SHORT = f"(^{VOWEL}{CONSONANT}|{CONSONANT}{VOWEL}[^aeiouywxY])$"


def _let(name: str, value: str, then: str) -> str:
    return f"transform(array({value}), {name} -> {then})[0]"


def _cut(word: str, n: int) -> str:
    return f"substring({word}, 1, length({word}) - {n})"


def _first(word: str, cases: list[tuple[str, str]]) -> str:
    return f"CASE {' '.join(f'WHEN {when} THEN {then}' for when, then in cases)} ELSE {word} END"


def _behind(word: str, suffix: str, begin: str) -> str:
    return f"length({word}) - {len(suffix)} >= {begin}"


def _swap(word: str, suffix: str, new: str, where: str) -> tuple[str, str]:
    """A case: the longest suffix that fits decides, whether or not it may go."""
    return f"endswith({word}, '{suffix}')", f"if({where}, concat({_cut(word, len(suffix))}, '{new}'), {word})"


def _plurals(w: str) -> str:
    return _first(w, [
        (f"endswith({w}, 'sses')", _cut(w, 2)),
        (f"endswith({w}, 'ied') OR endswith({w}, 'ies')", f"if(length({w}) > 4, {_cut(w, 2)}, {_cut(w, 1)})"),
        (f"endswith({w}, 'us') OR endswith({w}, 'ss')", w),
        (f"endswith({w}, 's') AND {w} RLIKE '{VOWEL}.+s$'", _cut(w, 1)),
    ])


def _participles(w: str) -> str:
    mended = _first("v", [
        ("v RLIKE '(at|bl|iz)$'", "concat(v, 'e')"),
        (f"v RLIKE '({'|'.join(DOUBLES)})$'", _cut("v", 1)),
        (f"length(v) <= r1 AND v RLIKE '{SHORT}'", "concat(v, 'e')"),
    ])

    def cut(suffix: str) -> tuple[str, str]:
        rest = _cut(w, len(suffix))
        return f"endswith({w}, '{suffix}')", f"if({rest} RLIKE '{VOWEL}', {_let('v', rest, mended)}, {w})"

    return _first(w, [_swap(w, "eedly", "ee", _behind(w, "eedly", "r1")), cut("ingly"), cut("edly"), _swap(w, "eed", "ee", _behind(w, "eed", "r1")), cut("ing"), cut("ed")])


def _rules(w: str, rules: list[tuple[str, str]], region: Callable[[str], str], extra: dict[str, str]) -> str:
    return _first(w, [_swap(w, s, new, f"{_behind(w, s, region(s))} AND {extra[s]}" if s in extra else _behind(w, s, region(s))) for s, new in rules])


def _last_letter(w: str) -> str:
    rest = _cut(w, 1)
    return _first(w, [
        (f"endswith({w}, 'e')", f"if({_behind(w, 'e', 'r2')} OR ({_behind(w, 'e', 'r1')} AND NOT {rest} RLIKE '{SHORT}'), {rest}, {w})"),
        (f"endswith({w}, 'll') AND {_behind(w, 'l', 'r2')}", rest),
    ])


@lru_cache(maxsize=1)
def _regular() -> str:
    """The stem of ``w`` by the rules, as text."""
    steps = f"replace({_last_letter('w9')}, 'Y', 'y')"
    steps = _let("w9", _rules("w8", [(s, "") for s in REMOVED], lambda s: "r2", {"ion": "w8 RLIKE '[st]ion$'"}), steps)
    steps = _let("w8", _rules("w7", ENDINGS, lambda s: "r2" if s == "ative" else "r1", {}), steps)
    steps = _let("w7", _rules("w6", DERIVATIONS, lambda s: "r1", {"ogi": "endswith(w6, 'logi')", "li": f"w6 RLIKE '{LI_ENDINGS}li$'"}), steps)
    steps = _let("w6", f"regexp_replace(w5, '^(.+{CONSONANT})[yY]$', '$1i')", steps)
    steps = _let("w5", _participles("w4"), steps)
    kept = ", ".join(f"'{k}'" for k in KEPT)
    steps = _let("w4", _plurals("w1"), f"if(w4 IN ({kept}), w4, {steps})")
    steps = _let("r2", "if(h2 = '', length(w1), r1 + length(h2))", steps)
    steps = _let("h2", f"regexp_extract(substring(w1, r1 + 1), '{REGION}', 0)", steps)
    steps = _let("r1", "if(h1 = '', length(w1), length(h1))", steps)
    steps = _let("h1", f"regexp_extract(w1, '^({'|'.join(PREFIXES)})|{REGION}', 0)", steps)
    return _let("w1", f"regexp_replace(regexp_replace(w, '^y', 'Y'), '({VOWEL})y', '$1Y')", steps)


def stem(column: str) -> Column:
    """The stem of the lower-cased word in a column; words of up to two letters are their own stem, and null stays null."""
    own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    return F.expr(_let("w", f"`{column}`", f"if(length(w) <= 2, w, CASE w {own} ELSE {_regular()} END)"))
