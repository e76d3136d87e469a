"""Queries on stored pages and the flat export, and the run log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html
from .concordance import ATT, classes, flagged
from .registry import query, shared_dir, table


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '<[^>]+>', '', 'g')) AS heading, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_paragraphs FROM pages""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", html.field(page, r"<title>([^<]*)</title>").alias("title"), html.field(page, r'<html lang="([a-z]*)"').alias("lang"),
        F.trim(html.no_tags(html.field(page, r"<h1[^>]*>([^<]*)</h1>"))).alias("heading"), F.regexp_count(page, F.lit("<p[ >]")).cast("long").alias("n_paragraphs"),
    )


@query(r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html.all_fields(F.col("html"), r'<a href="([^"]*)"')
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"""WITH {ATT}, good AS (SELECT c.text_id, c.ref_id, c.link_class, string_agg(DISTINCT k.source, '; ' ORDER BY k.source) AS sources FROM classes c JOIN kinds k USING (text_id, ref_id) WHERE link_class <> 'error:flagged' GROUP BY ALL),
universe AS (SELECT DISTINCT o_orderkey % 4000 AS text_id FROM orders)
SELECT text_id, ref_id, link_class, sources, 'link' AS branch FROM good
UNION ALL SELECT text_id, NULL, NULL, '', 'bare' FROM universe WHERE text_id < 3500 AND text_id NOT IN (SELECT text_id FROM good)
UNION ALL SELECT text_id, NULL, NULL, 'pali', 'pali' FROM universe WHERE text_id >= 3500""")
def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each link, one for texts without any, one for those that another canon alone has."""
    sources = flagged(spark, sf_dir).groupBy("text_id", "ref_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"))
    good = classes(spark, sf_dir).where("link_class <> 'error:flagged'").join(sources, ["text_id", "ref_id"]).withColumn("branch", F.lit("link"))
    universe = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("text_id")).distinct()
    empty = lambda df, sources, branch: df.select("text_id", F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("string").alias("link_class"), F.lit(sources).alias("sources"), F.lit(branch).alias("branch"))
    bare = universe.where("text_id < 3500").join(good.select("text_id").distinct(), "text_id", "left_anti")
    return good.select("text_id", "ref_id", "link_class", "sources", "branch").unionByName(empty(bare, "", "bare")).unionByName(empty(universe.where("text_id >= 3500"), "pali", "pali"))


@query()
def run_stats_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: one JSON row a run, appended, read back."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    for stage in ("documents", "benchmark"):
        stats = json.dumps({"stage": stage, "table": f"{stage}.parquet"})
        row = table(spark, sf_dir, stage).agg(F.count("*").alias("n_rows")).withColumn("run", F.lit(stats))
        row.write.mode("append").json(path)
    return spark.read.schema("n_rows long, run string").json(path)
