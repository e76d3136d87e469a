"""Sinks: stage tables with a manifest, JSON, CSV and TEI exports, the summary."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("excerpt", "digest", "retranslation", "commentary", "shared_tradition")


class StageStore:
    """Tables of a run by stage, valid while version, parameters and the input's fingerprint stay the same."""

    VERSION = 1

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    @staticmethod
    def fingerprint(files: DataFrame) -> str:
        """Of path, length and time of all input files; independent of their order."""
        row = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()

    def _manifest(self, params: dict, fingerprint: str) -> dict:
        return {"version": self.VERSION, "params": json.dumps(params, sort_keys=True), "fingerprint": fingerprint}

    def save(self, stage: str, df: DataFrame, params: dict, fingerprint: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{stage}")
        row = self._manifest(params, fingerprint)
        self.spark.createDataFrame([tuple(row.values())], "version int, params string, fingerprint string").write.mode("overwrite").json(f"{self.base}/{stage}.manifest")

    def load(self, stage: str, params: dict, fingerprint: str) -> DataFrame | None:
        """The table, or nothing if it is missing, damaged or made from something else."""
        try:
            row = self.spark.read.schema("version int, params string, fingerprint string").json(f"{self.base}/{stage}.manifest").first()
            if row is None or row.asDict() != self._manifest(params, fingerprint):
                return None
            df = self.spark.read.parquet(f"{self.base}/{stage}")
            df.limit(1).collect()
            return df
        except Exception as e:  # noqa: BLE001  whatever is wrong with it, the stage runs anew
            if "PATH_NOT_FOUND" in str(e) or "CORRUPT" in str(e).upper() or "UNABLE_TO_INFER" in str(e) or "FAILED_READ" in str(e):
                return None
            raise


def certainty(n_sources: Column) -> Column:
    return F.when(n_sources >= 3, "high").when(n_sources == 2, "medium").otherwise("low")


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tei_links(links: DataFrame) -> DataFrame:
    """(text_id, xml): one linkGrp for each text of (text_id, ref_id, sources: array), links in order of reference."""
    link = F.concat(
        F.lit('<link target="#'), _escaped(F.col("text_id").cast("string")), F.lit(" #"), _escaped(F.col("ref_id").cast("string")), F.lit('" cert="'),
        certainty(F.size("sources")), F.lit('" source="'), _escaped(F.array_join(F.array_sort("sources"), " ")), F.lit('"/>'),
    )
    own = links.select("text_id", F.struct("ref_id", link.alias("xml")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["xml"]), "")
    return own.groupBy("text_id").agg(F.concat(F.lit('<linkGrp type="parallels">'), body, F.lit("</linkGrp>")).alias("xml"))


def relationships(scores: DataFrame) -> DataFrame:
    """The relationship rows as they are published, rounded to even: shares to 4, averages to 2, spans to 6 places."""
    places = {"coverage": 4, "novel_fraction": 4, "phonetic_coverage": 4, "confidence": 4, "avg_segment_length": 2, "source_span": 6}
    return scores.withColumns({c: F.bround(c, n) for c, n in places.items() if c in scores.columns})


def csv_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def text_export(texts: DataFrame, path: str, text: str = "full_text") -> None:
    """The texts, each under its id, and a table of all other columns as JSON."""
    texts.select("text_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("text_id").text(f"{path}/texts")
    texts.drop(text).write.mode("overwrite").json(f"{path}/metadata")


def alignment_rows(segments: DataFrame, scores: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """(digest_id, source_id, segments: array): the segments, in order, of scored pairs alone.

    ``mappings``: (digest_id, source_id, segment, mapping) of phonetic segments; others have none.
    """
    own = segments.join(scores.select("digest_id", "source_id").distinct(), ["digest_id", "source_id"], "left_semi")
    if mappings is not None:
        own = own.join(mappings, ["digest_id", "source_id", "segment"], "left").withColumn("mapping", F.when(F.col("match_type") == "phonetic", F.col("mapping")))
    fields = [c for c in own.columns if c not in ("digest_id", "source_id")]
    return own.groupBy("digest_id", "source_id").agg(F.array_sort(F.collect_list(F.struct("segment", *(c for c in fields if c != "segment")))).alias("segments"))


def alignment_export(segments: DataFrame, scores: DataFrame, path: str) -> None:
    """JSON rows of each pair, in folders by digest."""
    alignment_rows(segments, scores).write.mode("overwrite").partitionBy("digest_id").json(path)


def visualised(segments: list[dict], digest: str, source: str, preview: int = 30, mapped: int = 15) -> str:
    """A pair's segments as lines of fixed width: places, kind, and how both sides begin; of phonetic ones some of the mapping."""
    short = lambda t: t if len(t) <= preview else t[:preview] + "…"
    lines = []
    for x in segments:
        d = short(digest[x["digest_start"] : x["digest_end"]])
        head = f"[{x['digest_start']:>6}-{x['digest_end']:>6}] {x['match_type']:<8} {d:<{preview + 1}}"
        if x["match_type"] == "novel":
            lines.append(head.rstrip())
            continue
        lines.append(f"{head} [{x['source_start']:>6}-{x['source_end']:>6}] {short(source[x['source_start'] : x['source_end']])}")
        pairs = x.get("mapping") or []
        if x["match_type"] == "phonetic" and pairs:
            more = f" and {len(pairs) - mapped} more" if len(pairs) > mapped else ""
            lines.append("    " + " ".join(f"{a}~{b}({s})" for a, s, b in pairs[:mapped]) + more)
    return "\n".join(lines) + "\n"


def validation_page(checks: DataFrame) -> str:
    """A page of (name, status) checks, a bounded list; it passes if all of them do."""
    rows = sorted((r["name"], r["status"]) for r in checks.select("name", "status").collect())
    passed = sum(status == "PASS" for _, status in rows)
    lines = ["# Validation", "", f"Result: {'PASS' if passed == len(rows) else 'FAIL'}, {passed} passed, {len(rows) - passed} failed", "", *(f"- {name}: {status}" for name, status in rows)]
    return "\n".join(lines) + "\n"


def concordance_rows(attestations: DataFrame, links: DataFrame, classes: DataFrame, sections: dict[str, str]) -> DataFrame:
    """One row a text: its references by section, each with what attests it and its class; everything in key order.

    ``links``: the active (text_id, ref_id); ``sections``: name and prefix of references, such as tibetan and ``Toh ``.
    """
    ids = ["text_id", "ref_id"]
    found = attestations.groupBy(*ids).agg(F.array_sort(F.collect_set(F.struct("source", "confidence", "note"))).alias("attested"))
    own = links.select(*ids).distinct().join(found, ids, "left").join(classes.select(*ids, "link_class"), ids, "left")
    entries = own.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "link_class", "attested"))).alias("links"))
    section = lambda prefix: F.transform(F.filter("links", lambda x: x["ref_id"].startswith(prefix)), lambda x: x["ref_id"])
    named = [section(prefix).alias(name) for name, prefix in sections.items()]
    return entries.select("text_id", *named, F.map_from_entries(F.transform("links", lambda x: F.struct(x["ref_id"], x["attested"]))).alias("link_provenance"), F.map_from_entries(F.transform("links", lambda x: F.struct(x["ref_id"], x["link_class"]))).alias("link_classifications"))


def concordance_export(rows: DataFrame, path: str) -> None:
    """Rows of :func:`concordance_rows`, or of its verified part, as JSON in order of their ids."""
    rows.orderBy("text_id").write.mode("overwrite").json(path)


def verified_rows(attestations: DataFrame, classes: DataFrame, sections: dict[str, str]) -> DataFrame:
    """The concordance of links classed as parallels or translations, without computed attestations."""
    from ..operators.concordance import source_kind

    kept = classes.where(F.col("link_class").isin("parallel", "chinese_to_tibetan"))
    return concordance_rows(attestations.where(source_kind(F.col("source")) != "computational"), kept, kept, sections)


def tei_document(links: DataFrame, title: str, path: str) -> None:
    """The whole TEI file: a header, then the groups of :func:`tei_links` in order of their ids, written as one part."""
    head = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>{title}</title></titleStmt></fileDesc></teiHeader><standOff>'
    body = tei_links(links).select(F.lit(1).alias("part"), F.col("text_id").cast("string").alias("key"), F.col("xml").alias("value"))
    ends = links.sparkSession.createDataFrame([(0, "", head), (2, "", "</standOff></TEI>")], "part int, key string, value string")
    # a range sort keeps tasks small; the one writer at the end only streams sorted rows
    body.unionByName(ends).orderBy("part", "key").select("value").coalesce(1).write.mode("overwrite").text(path)


def escaped_markdown(text: Column) -> Column:
    """Signs that would start markup, or end a table cell, get a backslash."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>|#])", r"\\$1")


def readable_pages(scores: DataFrame, titles: DataFrame) -> DataFrame:
    """(classification, page): Markdown tables of each class, surest first; texts by title where one is known."""
    named = lambda c: F.coalesce(escaped_markdown(F.col(f"{c}_title")), F.col(f"{c}_id").cast("string"))
    d, s = titles.toDF("digest_id", "digest_title"), titles.toDF("source_id", "source_title")
    own = scores.join(d, "digest_id", "left").join(s, "source_id", "left")
    line = F.concat(F.lit("| "), named("digest"), F.lit(" | "), named("source"), F.lit(" | "), F.format_number("confidence", 4), F.lit(" |"))
    rows = own.groupBy("classification").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "digest_id", "source_id", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return rows.select("classification", F.concat(F.lit("## "), F.col("classification"), F.lit("\n\n| digest | source | confidence |\n|---|---|---|\n"), body, F.lit("\n")).alias("page"))


def review_page(judged: DataFrame, counts: DataFrame, top: int = 20) -> str:
    """A page for reviewers of judged catalogue pairs: counts, then the surest pairs of each tier, ``top`` of each."""
    row = counts.first().asDict()
    lines = ["# Review", "", *(f"- {k}: {v}" for k, v in row.items())]
    for name, low, high in (("High", 90, 101), ("Medium", 60, 90), ("Low", 0, 60)):
        own = judged.where((F.col("verdict") == "MATCH") & (F.col("certainty") >= low) & (F.col("certainty") < high)).orderBy(F.desc("certainty"), "entry_id", "text_id").limit(top).collect()
        lines += ["", f"## {name}", *(f"- {r['entry_id']} is {r['text_id']}: {r['certainty']}" for r in own)]
    return "\n".join(lines) + "\n"


def summary(scores: DataFrame, stats: dict[str, int], top: int = 50, clusters: DataFrame | None = None, multi: DataFrame | None = None, drawn: list[tuple[str, str]] = ()) -> str:
    """A page of counts by class in fixed order, run statistics, the surest relationships, and, where given, the sources of
    several digests, digests of several sources, and drawn alignments (heading, text), each up to ``top``."""
    counts = {r["classification"]: r["count"] for r in scores.groupBy("classification").count().collect()}
    lines = ["# Summary", "", "## Relationships", *(f"- {c}: {counts[c]}" for c in CLASSES if counts.get(c)), "", "## Run", *(f"- {k}: {v}" for k, v in stats.items()), "", "## Surest"]
    best = scores.where("classification <> 'no_relationship'").orderBy(F.desc("confidence"), "digest_id", "source_id").limit(top)
    lines += [f"{i}. {r['digest_id']} from {r['source_id']}: {r['classification']}, {r['confidence']:.4f}" for i, r in enumerate(best.collect(), 1)]
    if clusters is not None:
        lines += ["", "## Sources of several digests", *(f"- {r['source_id']}: {r['n']} ({r['digests']})" for r in clusters.orderBy(F.desc("n"), "source_id").limit(top).collect())]
    if multi is not None:
        own = multi.orderBy(F.desc("combined_coverage"), "digest_id").limit(top).collect()
        lines += ["", "## Digests of several sources", *(f"- {r['digest_id']}: {r['n_sources']} sources, {r['combined_coverage']:.4f} against {r['best_coverage']:.4f}" for r in own)]
    for heading, text in drawn[:top]:
        lines += ["", f"### {heading}", "", "```", text.rstrip("\n"), "```"]
    return "\n".join(lines) + "\n"
