"""Concordance operators on a long table of attestations: (text_id, ref_id, source, confidence, note, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import ConcordanceParams

LINK = ["text_id", "ref_id"]
# Sources of links that establish a parallel, that are computed, and that only derive others' links.
# Any other source is scholarly; a name ending in ":error" marks a recorded error.
CATALOG = (
    "lancaster", "lancaster_full", "acmuller_tohoku", "cbeta_tibetan", "cbeta_sanskrit", "84000_tei_refs", "rkts", "existing",
    "silk2019", "li2021", "peking_only", "suttacentral_parallels",
)
COMPUTATIONAL = ("mitra", "sanskrit_title_match")
INFRASTRUCTURE = ("rkts_concordance",)


def resolve_first(numbers: DataFrame, texts: DataFrame) -> DataFrame:
    """The smallest text id of each number, null where none has it."""
    return numbers.join(texts.groupBy("number").agg(F.min("text_id").alias("text_id")), "number", "left")


def resolve_all(numbers: DataFrame, texts: DataFrame) -> DataFrame:
    return numbers.join(texts, "number")


def waterfall(left: DataFrame, right: DataFrame, steps: list[tuple[str, list[str]]]) -> DataFrame:
    """(id, ref, method): each step joins on its columns what no earlier step matched; of several the smallest ref."""
    out = None
    rest = left
    for method, keys in steps:
        found = rest.join(right.select("ref", *keys), keys).groupBy("id").agg(F.min("ref").alias("ref")).withColumn("method", F.lit(method))
        rest = rest.join(found.select("id"), "id", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def source_kind(source: Column) -> Column:
    return (
        F.when(source.isin(*CATALOG), "catalog").when(source.isin(*COMPUTATIONAL), "computational").when(source.isin(*INFRASTRUCTURE), "infra")
        .when(source.endswith(":error"), "error").otherwise("scholarly")
    )


def merge(attestations: DataFrame) -> DataFrame:
    """One row for each (text, ref, source): the highest confidence and the first note that is not null."""
    return attestations.groupBy(*LINK, "source").agg(F.max("confidence").alias("confidence"), F.min_by("note", F.when(F.col("note").isNotNull(), F.col("seq"))).alias("note"))


def attestations_of(sources: dict[str, DataFrame], strong: float) -> DataFrame:
    """The long table of all sources' links, in the order of ``sources``: adds source (unless it has one), seq and active.

    Every frame has (text_id, ref_id) and may have source, confidence, note and active. Links of computed sentence pairs
    below ``strong``, contradicted title matches and recorded errors are attested without being active: they do not make a
    link, but count for one that another source makes.
    """
    out = None
    for seq, (name, rows) in enumerate(sources.items()):
        has = rows.columns
        own = rows.select(
            *LINK, (F.col("source") if "source" in has else F.lit(name)).alias("source"), (F.col("confidence") if "confidence" in has else F.lit(None)).cast("double").alias("confidence"),
            (F.col("note") if "note" in has else F.lit(None)).cast("string").alias("note"), F.lit(seq).alias("seq"), (F.col("active") if "active" in has else F.lit(True)).alias("active"),
        )
        out = own if out is None else out.unionByName(own)
    weak = (F.col("source") == "mitra") & (F.coalesce("confidence", F.lit(0.0)) < strong)
    return out.withColumn("active", F.col("active") & ~weak & ~F.col("source").endswith(":error"))


def enriched(attestations: DataFrame, otani: DataFrame, source: str = "rkts_concordance") -> DataFrame:
    """Adds the other edition's numbers (ref_id, otani) of every active link as links of the same texts, each once."""
    own = attestations.where("active").select(*LINK).distinct().join(otani, "ref_id").select("text_id", F.col("otani").alias("ref_id")).distinct()
    last = F.lit(1 << 20)
    more = own.select(*LINK, F.lit(source).alias("source"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("note"), last.cast("int").alias("seq"), F.lit(True).alias("active"))
    return attestations.unionByName(more)


def active_links(attestations: DataFrame) -> DataFrame:
    """(text_id, ref_id, n_sources) of links that some source makes, counting every source that attests them."""
    return attestations.groupBy(*LINK).agg(F.max("active").alias("_on"), F.count_distinct("source").alias("n_sources")).where("_on").drop("_on")


def corpus_ids(relations: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """(text_id): both sides of all relations, and the texts of the cross references so far."""
    sides = relations.select(F.explode(F.array("digest_id", "source_id")).alias("text_id"))
    return sides.unionByName(crossrefs.select("text_id")).where("text_id is not null").distinct()


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """(text_id, n_before, n_now, added, status): texts of either table; new, gone, grown or same, by the links that were added."""
    flag = lambda df, name: df.select(*LINK).distinct().withColumn(name, F.lit(True))
    both = flag(now, "_now").join(flag(before, "_before"), LINK, "full")
    out = both.groupBy("text_id").agg(F.count("_before").alias("n_before"), F.count("_now").alias("n_now"), F.count_if(F.col("_before").isNull()).alias("added"))
    return out.withColumn("status", F.when(F.col("n_before") == 0, "new").when(F.col("n_now") == 0, "gone").when(F.col("added") > 0, "grown").otherwise("same"))


def exported_sources(flagged: DataFrame, links: DataFrame) -> DataFrame:
    """(text_id, ref_id, sources: array) of the links: their unflagged attestations, or ``unknown`` where none is left."""
    own = flagged.where("not flagged_error and not source like '%:error'").groupBy(*LINK).agg(F.array_sort(F.collect_set("source")).alias("_own"))
    return links.select(*LINK).distinct().join(own, LINK, "left").select(*LINK, F.coalesce("_own", F.array(F.lit("unknown"))).alias("sources"))


def source_counts(attestations: DataFrame) -> DataFrame:
    """(source, n_texts, n_links) of every source."""
    return attestations.groupBy("source").agg(F.count_distinct("text_id").alias("n_texts"), F.count_distinct(*LINK).alias("n_links"))


def range_counts(links: DataFrame, number: str, limit: int = 1108) -> DataFrame:
    """(part, n_texts, n_refs) of links with a number: scripture up to ``limit``, commentary above."""
    part = F.when(F.col(number).between(1, limit), "scripture").when(F.col(number) > limit, "commentary")
    return links.withColumn("part", part).where("part is not null").groupBy("part").agg(F.count_distinct("text_id").alias("n_texts"), F.count_distinct(number).alias("n_refs"))


def text_coverage(relations: DataFrame, parallels: DataFrame) -> DataFrame:
    """(role, n_texts, n_covered) of the texts of all relations, each once: digests, sources, and any of both."""
    side = lambda c, role: relations.select(F.col(c).alias("text_id"), F.lit(role).alias("role"))
    each = side("digest_id", "digest").unionByName(side("source_id", "source"))
    each = each.unionByName(each.select("text_id", F.lit("any").alias("role"))).distinct()
    known = parallels.select("text_id").distinct().withColumn("_known", F.lit(True))
    return each.join(known, "text_id", "left").groupBy("role").agg(F.count("*").alias("n_texts"), F.count("_known").alias("n_covered"))


def overlap(attestations: DataFrame, first: str, second: str) -> DataFrame:
    """(kind, n_links): links that only one of two sources, or both, and whether any other source attests."""
    by = attestations.groupBy(*LINK).agg(F.max(F.col("source") == first).alias("a"), F.max(F.col("source") == second).alias("b"), F.max(~F.col("source").isin(first, second)).alias("other"))
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").when(F.col("b"), "second")
    return by.withColumn("kind", kind).where("kind is not null").groupBy("kind", "other").agg(F.count("*").alias("n_links"))


def orphans(known: DataFrame, mapped: DataFrame) -> DataFrame:
    """(ref_id, texts) of references that the concordance has and the edition map lacks."""
    return known.join(mapped.select("ref_id"), "ref_id", "left_anti").groupBy("ref_id").agg(F.array_sort(F.collect_set("text_id")).alias("texts"))


def with_base_id(relations: DataFrame, parallels: DataFrame, column: str) -> DataFrame:
    """Adds ``refs`` of ``column``'s text, or else those of its id without a suffix; null where both lack any."""
    base = F.regexp_replace(F.col(column), "[-_].*$|[A-Za-z]+$", "")
    own = parallels.select(F.col("text_id").alias(column), F.col("refs").alias("_own"))
    stem = parallels.select(F.col("text_id").alias("_base"), F.col("refs").alias("_stem"))
    return relations.join(own, column, "left").withColumn("_base", base).join(stem, "_base", "left").withColumn("refs", F.coalesce("_own", "_stem")).drop("_own", "_stem", "_base")


def verdicts_or_uncertain(pairs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Adds verdict and certainty (0 to 100) of an outside judgement by (entry_id, text_id); without one, uncertain at 50."""
    out = pairs if verdicts is None else pairs.join(verdicts.select("entry_id", "text_id", "verdict", "certainty"), ["entry_id", "text_id"], "left")
    none = F.lit(None) if verdicts is None else F.col("verdict")
    return out.withColumn("certainty", F.coalesce(F.lit(None).cast("int") if verdicts is None else F.col("certainty"), F.lit(50))).withColumn("verdict", F.coalesce(none.cast("string"), F.lit("UNCERTAIN")))


def verdict_summary(judged: DataFrame, known: DataFrame) -> DataFrame:
    """One row of counts: verdicts, tiers of the matches (from 90, from 60, below), and matches of texts known or new."""
    own = known.select("text_id").distinct().withColumn("_known", F.lit(True))
    j = judged.join(own, "text_id", "left")
    hit, sure = F.col("verdict") == "MATCH", F.coalesce("certainty", F.lit(0))
    fresh = hit & F.col("_known").isNull()
    return j.agg(
        F.count("*").alias("candidates"), F.count_if(hit).alias("matches"), F.count_if(F.col("verdict") == "NO_MATCH").alias("no_match"), F.count_if(F.col("verdict").isin("UNCERTAIN", "ERROR")).alias("uncertain"),
        F.count_if(hit & (sure >= 90)).alias("high"), F.count_if(hit & (sure >= 60) & (sure < 90)).alias("medium"), F.count_if(hit & (sure < 60)).alias("low"),
        F.count_if(hit & F.col("_known")).alias("validated"), F.count_if(fresh).alias("new"), F.count_distinct(F.when(fresh, F.col("text_id"))).alias("new_texts"), F.count_distinct(F.when(fresh, F.col("entry_id"))).alias("new_entries"),
    )


def flag_errors(attestations: DataFrame, errors: DataFrame) -> DataFrame:
    """Adds flagged_error and correct_ref; ``errors`` is (text_id, ref_id, source, correct_ref), a null source means all."""
    some = errors.where("source is not null").groupBy(*LINK, "source").agg(F.min("correct_ref").alias("_some"), F.lit(True).alias("_hit"))
    every = errors.where("source is null").groupBy(*LINK).agg(F.min("correct_ref").alias("_every"), F.lit(True).alias("_all"))
    joined = attestations.join(some, [*LINK, "source"], "left").join(every, LINK, "left")
    return joined.withColumn("correct_ref", F.coalesce("_some", "_every")).withColumn("flagged_error", F.coalesce("_hit", "_all", F.lit(False))).drop("_some", "_every", "_hit", "_all")


def classify_links(flagged: DataFrame, relations: DataFrame, p: ConcordanceParams) -> DataFrame:
    """(text_id, ref_id, link_class) of every link.

    ``relations``: (digest_id, source_id) of excerpts and digests among the text-reuse results. Order of the rules: all
    attestations flagged as errors, translations out of Chinese, catalogued parallels, links inherited from a text that
    this one digests, quotations in texts with many computed links, confident computed ones, the rest uncertain.
    """
    kind = source_kind(F.col("source"))
    per_link = flagged.groupBy(*LINK).agg(
        F.min("flagged_error").alias("flagged"),
        F.max(F.col("source") == "rkts").alias("from_chinese"),
        F.max(kind.isin("catalog", "scholarly")).alias("catalogued"),
        F.max(kind == "computational").alias("computed"),
        F.max(F.when(kind == "computational", F.coalesce("confidence", F.lit(0.0)))).alias("best"),
    )
    per_link = per_link.withColumn("only_computed", F.col("computed") & ~F.col("catalogued"))
    many = F.sum(F.when(F.col("only_computed"), 1).otherwise(0)).over(Window.partitionBy("text_id"))
    links = per_link.withColumn("n_computed", many)
    catalogued = links.where("catalogued").select(F.col("text_id").alias("source_id"), "ref_id")
    inherited = relations.join(catalogued, "source_id").select(F.col("digest_id").alias("text_id"), "ref_id").distinct().withColumn("inherits", F.lit(True))
    links = links.join(inherited, LINK, "left")
    return links.select(
        *LINK,
        F.when(F.col("flagged"), "error:flagged").when(F.col("from_chinese"), "chinese_to_tibetan").when(F.col("catalogued"), "parallel").when(F.col("inherits"), "indirect:inherited")
        .when(F.col("only_computed") & (F.col("n_computed") >= p.encyclopedic_links), "indirect:quotation")
        .when(F.col("only_computed") & (F.col("best") >= p.computational_confidence), "parallel:computational").otherwise("uncertain").alias("link_class"),
    )


def inherit_class(derived: DataFrame, parents: DataFrame, classes: DataFrame) -> DataFrame:
    """Derived references take the class of their first parent in the same text: (text_id, ref_id, link_class).

    ``derived``: (text_id, ref_id); ``parents``: (ref_id, parent_id), of several the smallest counts.
    """
    first = parents.groupBy("ref_id").agg(F.min("parent_id").alias("parent_id"))
    own = classes.select("text_id", F.col("ref_id").alias("parent_id"), "link_class")
    return derived.join(first, "ref_id").join(own, ["text_id", "parent_id"]).select(*LINK, "link_class")


def verified(classes: DataFrame, flagged: DataFrame) -> DataFrame:
    """Links classed as parallels or translations, with the sources that are not computational."""
    own = flagged.where(source_kind(F.col("source")) != "computational")
    kept = classes.where(F.col("link_class").isin("parallel", "chinese_to_tibetan"))
    return kept.join(own.groupBy(*LINK).agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources")), LINK)


def source_agreement(attestations: DataFrame) -> DataFrame:
    """(text_id, n_sources, n_refs, agreement) of texts with several sources: full, partial or conflict."""
    pairs = attestations.select("text_id", "ref_id", "source").distinct()
    per_ref = pairs.groupBy(*LINK).agg(F.count("*").alias("by"))
    total = pairs.groupBy("text_id").agg(F.count_distinct("source").alias("n_sources")).where("n_sources >= 2")
    out = per_ref.join(total, "text_id").groupBy("text_id", "n_sources").agg(F.count("*").alias("n_refs"), F.min("by").alias("least"), F.max("by").alias("most"))
    kind = F.when(F.col("least") == F.col("n_sources"), "full").when(F.col("most") == F.col("n_sources"), "partial").otherwise("conflict")
    return out.select("text_id", "n_sources", "n_refs", kind.alias("agreement"))


def band_coverage(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """Share of covered texts in each band (name, low, high); a text outside all bands counts nowhere.

    Bands are a fixed list of a few rows, so the range join is a broadcast one.
    """
    joined = texts.join(F.broadcast(bands), F.col("volume").between(F.col("low"), F.col("high")))
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.count_if("covered").alias("n_covered")).withColumn("percent", F.col("n_covered") * 100.0 / F.col("n"))


def bridge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n:m join of two catalogues on a shared kernel id, each pair once."""
    return left.join(right, key).drop(key).distinct()


def coalesce_by_priority(rows: DataFrame, key: str, fields: list[str], priority: str) -> DataFrame:
    """For each field the value of the best-ranked source that has one (1 is best)."""
    return rows.groupBy(key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(priority))).alias(f) for f in fields))
