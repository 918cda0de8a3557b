"""Text predicates, keys, chunk builders and parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caresift import constants as K


def strip(c: Column) -> Column:
    """Trim every whitespace character, not only blanks."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def filled(c: Column) -> Column:
    """FLT-01: not null and not blank."""
    return F.length(strip(F.coalesce(c, F.lit("")))) > 0


def has_explanation(c: Column) -> Column:
    """FLT-02: not null, not blank, not the word ``null``."""
    return ~F.lower(strip(F.coalesce(c, F.lit("")))).isin("", "null")


def single_turn(prompt: Column) -> Column:
    """FLT-03: an array of turns without any assistant turn."""
    return ~F.exists(prompt, lambda m: m["role"] == "assistant")


def looks_english(c: Column) -> Column:
    """FLT-04: at least 85 % ASCII letters and at least one common English word."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    ascii_letters = F.length(F.regexp_replace(letters, "[^A-Za-z]", ""))
    total = F.length(letters)
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), 0)
    return F.coalesce(
        filled(c)
        & ((total == 0) | (ascii_letters / total >= 0.85))
        & F.arrays_overlap(words, F.array(*[F.lit(w) for w in K.ENGLISH_WORDS])),
        F.lit(False),
    )


def only_user_and_assistant(prompt: Column) -> Column:
    """FLT-05."""
    return F.forall(prompt, lambda m: m["role"].isin("user", "assistant"))


def option_letter(cop: Column, base: int = 1) -> Column:
    """PRJ-01: option number to letter; other numbers as text; null and (with base 1) zero give null."""
    number = cop if base == 1 else cop + (1 - base)
    return (
        F.when(number.isNull() | (number == 0), F.lit(None).cast("string"))
        .when(number.between(1, 4), F.element_at(F.array(*[F.lit(x) for x in "abcd"]), F.when(number.between(1, 4), number).otherwise(1).cast("int")))
        .otherwise(number.cast("string"))
    )


def composite_key(source: Column, key: Column) -> Column:
    """PRJ-02."""
    return F.concat_ws("::", source, key)


# PRJ-03: how many characters each kind of text keeps.
CUTS = {"question": 200, "embed": 8000, "snippet": 200, "evidence": 400, "preview": 300, "response": 500}


def cut(c: Column, kind: str) -> Column:
    return F.substring(c, 1, CUTS[kind])


def chunk_text(question: Column, answer: Column | None, category: Column, limit: int | None = None) -> Column:
    """PRJ-04: the text that is embedded, cut to ``limit`` if given; a null answer column leaves its line out."""
    def line(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))

    lines = [line("Question", question)]
    if answer is not None:
        lines.append(answer)
    lines.append(line("Category", category))
    text = F.concat_ws("\n", *lines)
    return text if limit is None else F.substring(text, 1, limit)


def answer_line(answer: Column) -> Column:
    return F.concat(F.lit("Answer: "), F.coalesce(answer, F.lit("")))


def explained_answer_line(explained: Column, explanation: Column) -> Column:
    """The answer line of an exam record: only when there is an explanation."""
    return F.when(explained & (F.coalesce(explanation, F.lit("")) != ""), answer_line(explanation))


WORD_GAP = r"[^\p{L}\p{N}_\s]"


def normalized(c: Column) -> Column:
    """PRJ-05: lower case with every character that is neither word nor space turned into a blank."""
    return F.regexp_replace(F.lower(c), WORD_GAP, " ")


def words(c: Column) -> Column:
    """PRJ-05: the words of a query, in order."""
    return F.filter(F.split(normalized(c), r"\s+"), lambda w: w != "")


def phrase_tokens(phrase: Column) -> Column:
    """PRJ-06: index tokens of a knowledge-base phrase."""
    raw = F.split(F.lower(strip(phrase)), r"[\s/\-,]+")
    bare = F.transform(raw, lambda t: F.btrim(t, F.lit("()[].'\"")))
    stop = F.array(*[F.lit(w) for w in K.QUERY_STOP_WORDS])
    return F.filter(bare, lambda t: (F.length(t) >= K.TOKEN_MIN_LENGTH) & ~F.array_contains(stop, t))


def slugify(name: Column) -> Column:
    """PRJ-07: display name to identifier."""
    s = F.lower(name)
    s = F.regexp_replace(s, "&", "and")
    s = F.regexp_replace(s, "[/(),]", " ")
    s = F.regexp_replace(s, r"[^a-z0-9\s]", "")
    s = F.regexp_replace(strip(s), r"\s+", "_")
    s = F.replace(s, F.lit("_and_"), F.lit("_"))
    return F.btrim(F.regexp_replace(s, "_+", "_"), F.lit("_"))


FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
OBJECT = r"(?s)\{[^{}]*\}"


def lenient_json(c: Column, schema: str) -> Column:
    """PRJ-08: an object from model text: fenced or whole, else the first flat ``{…}``; null when neither parses."""
    text = strip(c)
    fenced = F.regexp_extract(text, FENCE, 1)
    whole = F.when(text.rlike(FENCE), strip(fenced)).otherwise(text)
    inner = F.regexp_extract(c, OBJECT, 0)

    def parse(t: Column) -> Column:
        shaped = F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), t)
        return F.when(F.try_parse_json(shaped).isNotNull(), F.from_json(shaped, schema))

    return F.coalesce(parse(whole), parse(inner))


def grade_from_text(c: Column) -> Column:
    """PRJ-08 for graders: score and explanation, score 0 with a message when the text holds no object."""
    parsed = lenient_json(c, "score double, explanation string")
    blank = ~filled(c)
    return F.struct(
        F.when(blank, F.lit(0.0)).otherwise(F.coalesce(parsed["score"], F.lit(0.0))).alias("score"),
        F.when(blank, F.lit("Empty grader response."))
        .when(parsed.isNull(), F.concat(F.lit("Failed to parse grader output: "), F.substring(c, 1, 200)))
        .otherwise(F.coalesce(parsed["explanation"], F.lit(""))).alias("explanation"),
    )


def tag_prefix(tag: Column) -> Column:
    """PRJ-09: the part before the first colon ('' without colon)."""
    return F.when(tag.contains(":"), F.substring_index(tag, ":", 1)).otherwise(F.lit(""))


def tag_label(tag: Column) -> Column:
    """PRJ-09: readable label: prefix removed, separators to blanks, first letter upper case, rest lower."""
    bare = F.when(tag.contains(":"), F.element_at(F.split(tag, ":", 2), 2)).otherwise(tag)
    spaced = F.lower(F.translate(bare, "_-", "  "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))


def last_user_text(prompt: Column) -> Column:
    """PRJ-10: content of the last user turn of an array of turns ('' if none)."""
    return F.coalesce(F.try_element_at(F.filter(prompt, lambda m: m["role"] == "user"), F.lit(-1))["content"], F.lit(""))


def result_id(prompt_id: Column, response: Column) -> Column:
    """PRJ-16."""
    return F.sha2(F.concat(prompt_id, response), 256)


def retrieval_items(tool: Column, result: Column) -> Column:
    """PRJ-17: items found by a retrieval tool, as ``array<struct<source, content, relevance_score>>``."""
    pattern = r"(?m)^- (PMID \d+): (.+)$"
    cited = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(result, F.lit(pattern), 1).alias("source"),
            F.regexp_extract_all(result, F.lit(pattern), 2).alias("content"),
        ),
        lambda x: F.struct(x["source"].alias("source"), x["content"].alias("content"), F.lit(1.0).alias("relevance_score")),
    )
    label = F.array(F.struct(F.lit("openfda").alias("source"), result.alias("content"), F.lit(1.0).alias("relevance_score")))
    none = F.filter(label, lambda _: F.lit(False))
    return (
        F.when(result.startswith("Error"), none)
        .when(tool == "pubmed_search", cited)
        .when(tool == "drug_interaction_db", label)
        .otherwise(none)
    )


def usage(u: Column) -> Column:
    """PRJ-19: token counts from either of two layouts."""
    return F.struct(
        F.coalesce(u["input_tokens"], u["prompt_tokens"]).alias("input_tokens"),
        F.coalesce(u["output_tokens"], u["completion_tokens"]).alias("output_tokens"),
        u["total_tokens"].alias("total_tokens"),
    )


def shuffled_options(key: Column, options: Column, seed: int) -> Column:
    """PRJ-20: the options of a question in a seeded order (the first one is the correct one)."""
    keyed = F.transform(
        options, lambda o, i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), key, i)).alias("h"), i.alias("i"), o.alias("option"))
    )
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["option"].alias("option"), s["i"].alias("original")))


def correct_letter(shuffled: Column) -> Column:
    """PRJ-20: the letter under which the correct option went."""
    place = F.array_position(F.transform(shuffled, lambda s: s["original"]), F.lit(0))
    return F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), place.cast("int"))


def split_rubrics(rubrics: Column) -> Column:
    """PRJ-21: rubric items with points ≥ 0, those below, and the points that can be had."""
    positive = F.filter(rubrics, lambda r: r["points"] >= 0)
    return F.struct(
        positive.alias("positive"),
        F.filter(rubrics, lambda r: r["points"] < 0).alias("negative"),
        F.aggregate(positive, F.lit(0.0), lambda acc, r: acc + r["points"]).alias("total_possible"),
    )


def clip01(c: Column) -> Column:
    """PRJ-29."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def appended_terms(existing: Column, new: Column) -> Column:
    """SET-05: new terms after the existing ones, none twice, order kept."""
    return F.array_distinct(F.concat(existing, new))
