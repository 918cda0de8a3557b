"""Knowledge-base documents to tables (SRC-05), condition registry (CLS-14), lookups (JN-19) and context (WN-07).

Documents are cut by nested splitting — document, section, block, line — so a line carries its section without any
window or shuffle (WN-04).  The pieces are exploded with ``…_outer`` and a null test, because for a plain ``explode`` the
optimizer adds a ``size > 0`` filter below it and cuts every text twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X

LINK = r"\[([^\]]+)\]\(([^)]+?)\.md\)"


#: Parts into which the sections of a key are dealt before its budget is applied.
SHARES = 32


def documents(files: DataFrame) -> DataFrame:
    """``(slug, name, text)`` from ``(path, text)``; the name is the first ``# `` heading."""
    return files.select(
        F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1).alias("slug"),
        X.strip(F.regexp_extract("text", r"(?m)^# (.*)$", 1)).alias("name"),
        "text",
    )


def sections(docs: DataFrame) -> DataFrame:
    """``(slug, sec, section, body)``: one row per ``## `` section."""
    cuts = F.split("text", r"(?m)^(?=[ \t]*## )")
    return (
        docs.select("slug", F.posexplode_outer(cuts).alias("sec", "body")).where(F.col("body").isNotNull())
        .withColumn("section", X.strip(F.regexp_extract("body", r"^[ \t]*## (.*)", 1)))
        .select("slug", "sec", "section", "body")
    )


def lines(parts: DataFrame, *carried: str) -> DataFrame:
    """Non-blank lines of ``body``, trimmed, with their position."""
    return (
        parts.select(*carried, F.posexplode_outer(F.split("body", "\n")).alias("pos", "raw"))
        .withColumn("line", X.strip(F.col("raw"))).where(F.col("line") != "").drop("raw")
    )


def links(docs: DataFrame) -> DataFrame:
    """``(category, target, link_type, cross_hits, reason)`` of the Links sections; both dash forms are read."""
    blocks = (
        sections(docs).where(F.col("section") == "Links")
        .select("slug", "sec", F.posexplode_outer(F.split("body", r"(?=\*\*(?:Strong|Weak) links:\*\*)")).alias("blk", "body"))
        .withColumn("link_type", F.lower(F.regexp_extract("body", r"^\*\*(Strong|Weak) links:\*\*", 1)))
        .where(F.col("link_type") != "")
    )
    rest = F.regexp_extract("line", LINK + r"(.*)$", 3)
    dashed = X.strip(F.regexp_extract(rest, r"(?:--|—)\s*(.+)", 1))
    reason = F.when(dashed != "", dashed).otherwise(X.strip(F.regexp_extract(rest, r"\(([^)]+)\)", 1)))
    hits = F.regexp_extract(reason, r"(\d+)\s+cross-hits?", 1)
    return (
        lines(blocks, "slug", "sec", "blk", "link_type")
        .where(F.col("line").startswith("- ") & F.col("line").rlike(LINK))
        .select(
            F.col("slug").alias("category"), F.regexp_extract("line", LINK, 2).alias("target"), "link_type",
            F.when(hits != "", hits.cast("bigint")).otherwise(F.lit(1).cast("bigint")).alias("cross_hits"),
            reason.alias("reason"), "sec", "blk", "pos",
        )
    )


def terms(docs: DataFrame) -> DataFrame:
    """``(category, consumer_term, medical_term, notes, pos)`` of the Terminology Map tables."""
    rows = (
        lines(sections(docs).where(F.col("section").rlike("(?i)^terminology map")), "slug", "sec")
        .where(F.col("line").startswith("|"))
        .where(~F.col("line").contains("Consumer Term") & ~F.col("line").rlike(r"^\|[-:\s|]+\|?$"))
        .withColumn("cells", F.transform(F.split("line", r"\|"), X.strip))
    )
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return rows.where(cell(1) != "").select(
        F.col("slug").alias("category"), cell(1).alias("consumer_term"), cell(2).alias("medical_term"),
        cell(3).alias("notes"), (F.col("sec") * 1_000_000 + F.col("pos")).alias("pos"),
    )


def subcategories(docs: DataFrame) -> DataFrame:
    """``(category, subcategory, name, pos, body)`` of the Subcategory Details sections."""
    return (
        sections(docs).where(F.col("section") == "Subcategory Details")
        .select("slug", F.posexplode_outer(F.split("body", r"(?m)^(?=[ \t]*### )")).alias("pos", "body"))
        .withColumn("name", X.strip(F.regexp_extract("body", r"^[ \t]*### (.*)", 1)))
        .where(F.col("name") != "")
        .select(F.col("slug").alias("category"), X.slugify(F.col("name")).alias("subcategory"), "name", "pos", "body")
    )


def related(docs: DataFrame) -> DataFrame:
    """``(category, subcategory, target, reason)`` of the Related lines."""
    one = r"\[[^\]]+\]\(([^)]+?)\.md\)\s*\(([^)]+)\)"
    pairs = F.arrays_zip(
        F.regexp_extract_all("line", F.lit(one), 1).alias("target"),
        F.regexp_extract_all("line", F.lit(one), 2).alias("reason"),
    )
    return (
        lines(subcategories(docs), "category", "subcategory")
        .where(F.col("line").startswith("- **Related:**"))
        .select("category", "subcategory", F.explode_outer(pairs).alias("r")).where(F.col("r").isNotNull())
        .select("category", "subcategory", "r.target", X.strip(F.col("r.reason")).alias("reason"))
    )


def _word_set(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in K.REGISTRY_STOP_WORDS])
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)), stop)


def _best_subcategory(term: Column, subs: Column) -> Column:
    """Subcategory of ``subs`` (in document order) that contains or is contained in the term, else best word overlap."""
    lowered = F.lower(term)
    contained = F.filter(
        subs, lambda s: F.contains(F.lower(s["name"]), lowered) | F.contains(lowered, F.lower(s["name"]))
    )
    own = _word_set(term)

    def score(s: Column) -> Column:
        theirs = _word_set(s["name"])
        overlap = F.size(F.array_intersect(own, theirs))
        return F.when(overlap > 0, overlap / F.least(F.size(own), F.size(theirs))).otherwise(0.0)

    # largest score; the first in document order wins ties
    scored = F.transform(subs, lambda s: F.struct(score(s).alias("score"), (-s["pos"]).alias("neg"), s["subcategory"].alias("subcategory")))
    best = F.array_max(scored)
    return F.coalesce(
        F.get(contained, F.lit(0))["subcategory"], F.when(best["score"] > 0.3, best["subcategory"])
    )


def condition_registry(docs: DataFrame) -> DataFrame:
    """CLS-14: ``(name, category, subcategory)``; later entries overwrite earlier ones of the same name.

    Order of writing: documents by slug; within one, subcategories in order with their variants, then terms.  The
    subcategories of one category (a document's headings) are gathered into one array.
    """
    subs = subcategories(docs)
    name = F.col("name")
    simple = X.strip(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    base = F.lower(simple)
    inside = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    items = F.when(inside != "", F.transform(F.split(inside, ","), lambda i: F.lower(X.strip(i)))).otherwise(F.array().cast("array<string>"))
    before_amp = F.regexp_extract(name, r"^(.+?)\s*&\s*.+$", 1)
    halves = F.split(name, "/")
    left, right = X.strip(F.get(halves, F.lit(0))), X.strip(F.get(halves, F.lit(1)))
    right_words = F.split(right, r"\s+")
    slashed = (F.size(halves) == 2) & (F.size(right_words) >= 2)
    suffix = F.concat_ws(" ", F.slice(right_words, 2, F.greatest(F.size(right_words) - 1, F.lit(0))))
    variants = F.concat(
        F.array(F.lower(name), base),
        F.when(before_amp != "", F.array(F.lower(X.strip(before_amp)))).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(items, lambda i: F.array(F.concat_ws(" ", i, base), F.concat_ws(" ", base, i)))),
        F.when(slashed, F.array(F.lower(F.concat_ws(" ", left, suffix)), F.lower(right))).otherwise(F.array().cast("array<string>")),
    )
    named = subs.select(
        "category", "subcategory", F.posexplode(variants).alias("v", "key"), F.col("pos").alias("p")
    ).select(F.col("key").alias("name"), "category", "subcategory", F.struct("category", F.lit(0).alias("kind"), F.col("p").cast("long").alias("p"), F.col("v").cast("long").alias("v")).alias("written"))

    per_category = subs.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("pos", "subcategory", "name"))).alias("subs")
    )
    matched = terms(docs).where(F.col("medical_term") != "").join(per_category, "category")
    matched = matched.withColumn(
        "subcategory",
        F.coalesce(_best_subcategory(F.col("medical_term"), F.col("subs")), _best_subcategory(F.col("consumer_term"), F.col("subs"))),
    ).where(F.col("subcategory").isNotNull())
    from_terms = matched.select(
        "category", "subcategory", "pos",
        F.posexplode(F.array(F.lower("consumer_term"), F.lower("medical_term"))).alias("v", "name"),
    ).select("name", "category", "subcategory", F.struct("category", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("p"), F.col("v").cast("long").alias("v")).alias("written"))
    last = F.max_by(F.struct("category", "subcategory"), "written").alias("e")
    return named.unionByName(from_terms).groupBy("name").agg(last).select("name", "e.category", "e.subcategory")


def lookup(requests: DataFrame, docs: DataFrame, slug: str = "slug") -> DataFrame:
    """JN-19: knowledge text for requested slugs; unknown ones are flagged and get the list of known slugs.

    There is one document per category, so the list is short.
    """
    known = docs.select(F.col("slug").alias("_known"), F.col("text").alias("content"))
    names = docs.agg(F.array_join(F.sort_array(F.collect_set("slug")), ", ").alias("names")).scalar()
    return (
        requests.join(known, F.col(slug) == F.col("_known"), "left")
        .withColumn("found", F.col("_known").isNotNull())
        .withColumn("known_slugs", F.when(~F.col("found"), names)).drop("_known")
    )


def context_sections(queries: DataFrame, plan: DataFrame, docs: DataFrame, general: str = "") -> DataFrame:
    """JN-19, WN-07: the sections a query may read, as ``(query_id, ord, text)`` for ``budgeted``.

    The primary category first, then must-load and may-load categories by weight, general rules last.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("bucket") != "must", F.desc("weight"), "category")
    loaded = plan.where(F.col("bucket").isNotNull()).select("query_id", F.row_number().over(order).alias("ord"), F.col("category").alias("slug"))
    primary = queries.select("query_id", F.lit(0).alias("ord"), F.col("category").alias("slug"))
    texts = primary.unionByName(loaded).join(docs.select("slug", "text"), "slug").select("query_id", "ord", "text")
    if not general:
        return texts
    return texts.unionByName(queries.select("query_id", F.lit(1_000_000).alias("ord"), F.lit(general).alias("text")))


def budgeted(parts: DataFrame, key: str = "query_id", order: str = "ord", text: str = "text", budget: int = K.CONTEXT_BUDGET) -> DataFrame:
    """WN-07: sections of each key in order, cut where the character budget is used up.

    A section whose predecessors within one of ``SHARES`` hashed parts of its key use up the budget is beyond it for
    sure.  So each part is cut first, in a task of its own, and at most ``SHARES`` times the budget of a key's text
    meets in one task, whatever the number and length of its sections.
    """
    shares = Window.partitionBy(key, "_share").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = lambda over: F.coalesce(F.sum(F.length(text)).over(over), F.lit(0))
    return (
        parts.where(F.length(text) > 0).withColumn(text, F.substring(text, 1, budget))
        .withColumn("_share", F.pmod(F.xxhash64(order), F.lit(SHARES)))
        .withColumn("_used", used(shares)).where(F.col("_used") < budget)
        .withColumn("_used", used(running)).where(F.col("_used") < budget)
        .withColumn(text, F.expr(f"substring(`{text}`, 1, int({budget} - _used))"))
        .drop("_share", "_used")
    )


def joined_context(sections_: DataFrame, key: str = "query_id", order: str = "ord", text: str = "text", separator: str = "\n\n---\n\n") -> DataFrame:
    """The budgeted sections of a key as one text (bounded by the budget)."""
    ordered = F.sort_array(F.collect_list(F.struct(order, text)))
    return sections_.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s[text]), separator).alias("context")
    )
