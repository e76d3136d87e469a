"""Text-reuse queries on documents and benchmark passages: grams, candidates, seeds, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import alignment, candidates, grams, intervals, phonetic, scoring
from ..params import PhoneticParams, ReuseParams, ScoreParams
from .registry import query, table

P = ReuseParams()
PH = PhoneticParams()

WORDS_SQL = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
GRAMS_SQL = f"list_distinct(list_transform(range(1, len(w) - {P.gram - 2}), lambda i: array_to_string(list_slice(w, i, i + {P.gram - 1}), ' ')))"
DOC_GRAMS = f"""
docs AS (SELECT doc_id AS id, n_chars, {WORDS_SQL} AS w FROM documents),
g0 AS (SELECT id, n_chars, unnest({GRAMS_SQL}) AS gram FROM docs),
stops AS (SELECT gram, count(*) AS df FROM g0 GROUP BY gram HAVING count(*) > floor((SELECT count(*) FROM documents) * {P.stop_share})),
g AS (SELECT * FROM g0 ANTI JOIN stops USING (gram))
"""
CANDIDATES = f"""
{DOC_GRAMS},
totals AS (SELECT id AS digest_id, count(*) AS total FROM g GROUP BY id),
pairs AS (SELECT d.id AS digest_id, s.id AS source_id, count(*) AS matching FROM g d JOIN g s
    ON d.gram = s.gram AND d.id <> s.id AND s.n_chars >= {P.size_ratio} * d.n_chars AND d.n_chars <= {P.max_digest_chars} GROUP BY ALL),
found AS (SELECT digest_id, source_id, matching, total, matching / total AS containment FROM pairs JOIN totals USING (digest_id)
    WHERE matching / total >= {P.min_containment})
"""
CROSSREFS = """
keyed AS (SELECT doc_id AS id, n_chars, lang || ':' || n_chars AS key FROM documents),
crossrefs AS (SELECT DISTINCT CASE WHEN a.n_chars <= b.n_chars THEN a.id ELSE b.id END AS digest_id,
    CASE WHEN a.n_chars <= b.n_chars THEN b.id ELSE a.id END AS source_id FROM keyed a JOIN keyed b ON a.key = b.key AND a.id < b.id)
"""


def document_grams(spark: SparkSession, sf_dir: str, hashes: bool) -> DataFrame:
    """(id, size, n_grams) of documents, stop-grams gone; with ``hashes`` a row for each gram."""
    docs = table(spark, sf_dir, "documents")
    stops = grams.stops_of(docs, "text", P.gram, P.stop_share).toArrow()["gram"].to_pylist()
    return grams.sets_of(docs, {"id": F.col("doc_id"), "size": F.col("n_chars")}, "text", P.gram, stops, hashes)


def found_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = document_grams(spark, sf_dir, True).withColumnRenamed("n_grams", "total")
    return candidates.in_longer(g, ["h", "g"], P.min_containment, P.size_ratio, P.max_digest_chars)


def crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select(F.col("doc_id").alias("id"), "n_chars", F.concat_ws(":", "lang", F.col("n_chars").cast("string")).alias("key"))
    return candidates.crossref_pairs(keyed)


@query(rf"""SELECT doc_id, length(kept) AS n_kept, md5(kept) AS kept_md5 FROM
(SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]', '', 'g') AS kept FROM documents) WHERE length(kept) >= {P.min_text_length}""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tx.keep_only(F.coalesce("text", F.lit("")), tx.LATIN)
    out = table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept")).where(F.length("kept") >= P.min_text_length)
    return out.select("doc_id", F.length("kept").cast("long").alias("n_kept"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


@query(f"WITH {DOC_GRAMS}, df AS (SELECT gram, count(*) AS df FROM g0 GROUP BY gram) SELECT df, count(*) AS n_grams, min(gram) AS first_gram FROM df GROUP BY df")
def gram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = grams.document_frequency(grams.gram_table(table(spark, sf_dir, "documents"), "doc_id", "text", P.gram))
    return df.groupBy("df").agg(F.count("*").alias("n_grams"), F.min("gram").alias("first_gram"))


@query(f"WITH {DOC_GRAMS} SELECT gram, df FROM stops")
def stop_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.stops_of(table(spark, sf_dir, "documents"), "text", P.gram, P.stop_share)


@query(f"WITH {DOC_GRAMS} SELECT id AS doc_id, count(*) AS n_grams FROM g GROUP BY id")
def gram_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_grams(spark, sf_dir, False).groupBy(F.col("id").alias("doc_id")).agg(F.sum("n_grams").alias("n_grams"))


@query(f"WITH {CANDIDATES} SELECT * FROM found")
def containment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_candidates(spark, sf_dir)


@query(f"""WITH {DOC_GRAMS},
items AS (SELECT item_id AS id, {WORDS_SQL} AS w FROM benchmark),
b AS (SELECT id, unnest({GRAMS_SQL}) AS gram FROM items), bg AS (SELECT * FROM b ANTI JOIN stops USING (gram)),
totals AS (SELECT id, count(*) AS total FROM bg GROUP BY id),
m AS (SELECT bg.id, g.id AS doc_id, count(*) AS matching FROM bg JOIN g USING (gram) GROUP BY ALL)
SELECT id AS item_id, doc_id, matching, total, matching / total AS containment,
CASE WHEN matching / total >= 0.8 THEN 'whole' WHEN matching / total >= 0.3 THEN 'part' ELSE 'trace' END AS extent
FROM m JOIN totals USING (id) WHERE matching / total >= {P.min_containment}""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark passages do documents contain, and how much of them?"""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = grams.gram_table(items, "item_id", "text", P.gram)
    # only grams of the passages can be shared, so only their frequencies are counted
    # and the few rows that are left are kept, so that documents are read once
    few = grams.sent(asked)
    made = grams.gram_table(docs, "doc_id", "text", P.gram, kept=few)
    near = (made if few is not None else made.join(asked.select("gram").distinct(), "gram", "left_semi")).persist()
    stops = grams.stop_grams(grams.document_frequency(near), docs.select("doc_id"), P.stop_share)
    found = candidates.containment(grams.without(asked, stops), near, P.min_containment)
    extent = F.when(F.col("containment") >= 0.8, "whole").when(F.col("containment") >= 0.3, "part").otherwise("trace")
    return found.select(F.col("digest_id").alias("item_id"), F.col("source_id").alias("doc_id"), "matching", "total", "containment", extent.alias("extent"))


@query(f"WITH {CROSSREFS} SELECT * FROM crossrefs")
def crossref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrefs(spark, sf_dir)


UNION = f"""{CANDIDATES}, {CROSSREFS},
merged AS (SELECT digest_id, source_id, coalesce(matching, 0) AS matching, coalesce(total, 0) AS total, coalesce(containment, 0.0) AS containment,
    x.digest_id IS NOT NULL AS from_docnumber FROM found FULL JOIN (SELECT digest_id, source_id, true AS hit FROM crossrefs) x USING (digest_id, source_id))"""
UNION = UNION.replace("x.digest_id IS NOT NULL", "coalesce(hit, false)")


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_union(found_candidates(spark, sf_dir), crossrefs(spark, sf_dir))


@query(f"WITH {UNION} SELECT * FROM merged")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_candidates(spark, sf_dir)


@query(f"""WITH {UNION} SELECT digest_id, source_id, containment, from_docnumber FROM merged
JOIN documents d ON d.doc_id = digest_id JOIN documents s ON s.doc_id = source_id
WHERE NOT (containment = 0 AND from_docnumber AND d.n_chars > {P.prefilter_chars} AND s.n_chars > {P.prefilter_chars})""")
def docnumber_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents")
    d = sizes.select(F.col("doc_id").alias("digest_id"), F.col("n_chars").alias("digest_chars"))
    s = sizes.select(F.col("doc_id").alias("source_id"), F.col("n_chars").alias("source_chars"))
    # only cross references can be hopeless, so only they need the sizes
    merged = candidates.candidate_union(found_candidates(spark, sf_dir), crossrefs(spark, sf_dir).join(d, "digest_id").join(s, "source_id"))
    return merged.where(~F.coalesce(candidates.hopeless(P.prefilter_chars), F.lit(False))).select("digest_id", "source_id", "containment", "from_docnumber")


RANGES = ("[Nos. 251-255, 257]", "No. 250 [No. 252]", "[Nos. 7, 10-12; 15]", "No. 99", "", "[Nos. 1000-1003]", "[Nos. 5-4, 8]")
_VALUES = ", ".join(f"('{r}')" for r in RANGES)


@query(rf"""WITH refs(ref) AS (VALUES {_VALUES}),
inside AS (SELECT ref, unnest(regexp_extract_all(regexp_extract(ref, '\[([^\]]*)\]', 1), '\d+(?:-\d+)?')) AS part FROM refs),
bounds AS (SELECT ref, CAST(split_part(part, '-', 1) AS INT) AS a, CAST(CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END AS INT) AS b FROM inside)
SELECT ref, unnest(range(a, b + 1))::BIGINT AS number FROM bounds WHERE a <= b
UNION SELECT ref, CAST(regexp_extract(ref, '^No\. (\d+)', 1) AS BIGINT) FROM refs WHERE regexp_matches(ref, '^No\. \d+')""")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.references import numbers_in

    refs = spark.createDataFrame([(r,) for r in RANGES], "ref string")
    return refs.select("ref", F.explode(numbers_in(F.col("ref"))).alias("number"))


TOKENS = f"""
items AS (SELECT item_id AS digest_id, {WORDS_SQL} AS w FROM benchmark), docs AS (SELECT doc_id AS source_id, {WORDS_SQL} AS w FROM documents),
dk AS (SELECT digest_id, i AS d_pos, array_to_string(list_slice(w, i, i + {P.seed_length - 1}), ' ') AS kgram FROM items, unnest(range(1, len(w) - {P.seed_length - 2})) t(i)),
sk AS (SELECT source_id, i AS s_pos, array_to_string(list_slice(w, i, i + {P.seed_length - 1}), ' ') AS kgram FROM docs, unnest(range(1, len(w) - {P.seed_length - 2})) t(i)),
hits AS (SELECT digest_id, source_id, d_pos - 1 AS d_pos, s_pos - 1 AS s_pos FROM dk JOIN sk USING (kgram)),
isl AS (SELECT *, d_pos - row_number() OVER (PARTITION BY digest_id, source_id, s_pos - d_pos ORDER BY d_pos) AS grp FROM hits),
runs AS (SELECT digest_id, source_id, min(d_pos) AS d_start, max(d_pos) + {P.seed_length} AS d_end, min(s_pos) AS s_start, max(s_pos) + {P.seed_length} AS s_end
    FROM isl GROUP BY digest_id, source_id, s_pos - d_pos, grp)
"""


def seed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return alignment.diagonal_runs(alignment.seed_hits(items, docs, P.seed_length), P.seed_length)


@query(f"""WITH {TOKENS}, best AS (SELECT h.digest_id, h.source_id, h.d_pos, r.d_end - h.d_pos AS len, h.s_pos,
    row_number() OVER (PARTITION BY h.digest_id, h.source_id, h.d_pos ORDER BY r.d_end - h.d_pos DESC, h.s_pos) AS n
    FROM hits h JOIN runs r ON h.digest_id = r.digest_id AND h.source_id = r.source_id AND h.s_pos - h.d_pos = r.s_start - r.d_start AND h.d_pos >= r.d_start AND h.d_pos < r.d_end)
SELECT digest_id, source_id, d_pos, s_pos, len FROM best WHERE n = 1""")
def kgram_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest exact match that starts at each position, ties to the earliest place in the source."""
    return alignment.longest_seeds(seed_runs(spark, sf_dir), P.seed_length)


@query(f"WITH {TOKENS} SELECT * FROM runs")
def diagonal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_runs(spark, sf_dir)


def passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def passage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_contamination(spark, sf_dir).select(F.col("item_id").alias("digest_id"), F.col("doc_id").alias("source_id"))


@query()
def align_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed-and-extend alignment of each passage with each document that shares enough of it."""
    return alignment.align_pairs(passage_pairs(spark, sf_dir), *passages(spark, sf_dir), P)


@query(f"""WITH {DOC_GRAMS},
items AS (SELECT item_id AS id, {WORDS_SQL} AS w FROM benchmark), dw AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT id, unnest({GRAMS_SQL}) AS gram FROM items), bg AS (SELECT * FROM b ANTI JOIN stops USING (gram)),
totals AS (SELECT id, count(*) AS total FROM bg GROUP BY id),
m AS (SELECT bg.id, g.id AS doc_id, count(*) AS matching FROM bg JOIN g USING (gram) GROUP BY ALL),
pairs AS (SELECT id, doc_id FROM m JOIN totals USING (id) WHERE matching / total >= {P.min_containment})
SELECT id AS digest_id, doc_id AS source_id, CAST(len(w) AS BIGINT) AS tiled, CAST(0 AS BIGINT) AS first_start, CAST(0 AS BIGINT) AS gaps, true AS exact_ok FROM pairs JOIN items USING (id)""")
def alignment_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each pair cover its passage once, without gaps, and exact ones say the same on both sides."""
    pairs, (items, docs) = passage_pairs(spark, sf_dir), passages(spark, sf_dir)
    segments = alignment.align_pairs(pairs, items, docs, P)
    before = F.lag("digest_end").over(Window.partitionBy("digest_id", "source_id").orderBy("segment"))
    docs = docs.join(pairs.select(F.col("source_id").alias("id")).distinct(), "id")  # before they are split into words
    items, docs = (x.select(F.col("id").alias(i), tx.words(F.col("text")).alias(w)) for x, i, w in zip((items, docs), ("digest_id", "source_id"), ("d", "s")))
    marked = segments.withColumn("gap", F.coalesce(F.col("digest_start") - before, F.lit(0))).join(items, "digest_id").join(docs, "source_id")
    part = lambda w, a, b: F.slice(F.col(w), F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    same = (F.col("match_type") != "exact") | (part("d", "digest_start", "digest_end") == part("s", "source_start", "source_end"))
    out = marked.groupBy("digest_id", "source_id").agg(F.sum(F.col("digest_end") - F.col("digest_start")).alias("tiled"), F.min("digest_start").alias("first_start"), F.sum(F.abs("gap")).alias("gaps"), F.min(F.coalesce(same, F.lit(True))).alias("exact_ok"))
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored relations of passages and documents: candidates, alignment, statistics of segments, classes and confidence."""
    items, docs = passages(spark, sf_dir)
    pairs = benchmark_contamination(spark, sf_dir).select(F.col("item_id").alias("digest_id"), F.col("doc_id").alias("source_id"), F.col("extent"))
    statistics = scoring.segment_statistics(alignment.align_pairs(pairs, items, docs, P), P.region_gap)
    known = docs.select(F.col("id").alias("source_id"), F.size(tx.words(F.col("text"))).alias("s_len"))
    own = items.select(F.col("id").alias("digest_id"), F.size(tx.words(F.col("text"))).alias("d_len"))
    return scoring.score_pairs(statistics, own, known, pairs.where("extent = 'whole'"), ScoreParams())


@query()
def relationship_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From candidates to published relations, on passages and documents."""
    columns = ("digest_id", "source_id", "classification", "confidence", "coverage", "effective", "phonetic_fraction", "avg_segment_length", "longest_segment", "num_source_regions", "crossref")
    return relations(spark, sf_dir).select(*columns)


SEGMENTS = """seg AS (SELECT l_orderkey AS digest_id, l_suppkey % 4 AS source_id, CAST(l_linenumber - 1 AS BIGINT) * 50 AS a, CAST(l_linenumber - 1 AS BIGINT) * 50 + CAST(l_quantity AS BIGINT) AS b, l_partkey % 900 AS sa, l_partkey % 900 + CAST(l_quantity AS BIGINT) AS sb,
    CASE WHEN l_returnflag = 'R' THEN 'novel' WHEN l_returnflag = 'A' THEN 'phonetic' WHEN l_linestatus = 'F' THEN 'fuzzy' ELSE 'exact' END AS kind FROM lineitem)"""


@query(f"""WITH {SEGMENTS}, own AS (SELECT digest_id, source_id, max(b) AS digest_length, CAST(coalesce(sum(b - a) FILTER (WHERE kind <> 'novel'), 0) AS BIGINT) AS matched, coalesce(avg(b - a) FILTER (WHERE kind <> 'novel'), 0.0) AS avg_segment_length,
    coalesce(max(b - a) FILTER (WHERE kind <> 'novel'), 0) AS longest_segment, CAST(coalesce(sum(b - a) FILTER (WHERE kind = 'phonetic'), 0) AS BIGINT) AS phonetic, CAST(count(*) FILTER (WHERE kind = 'phonetic') AS BIGINT) AS n_phonetic, CAST(count(*) FILTER (WHERE kind <> 'novel') AS BIGINT) AS n_matched FROM seg GROUP BY ALL),
m AS (SELECT *, max(sb) OVER (PARTITION BY digest_id, source_id ORDER BY sa, sb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM seg WHERE kind <> 'novel'),
r AS (SELECT digest_id, source_id, CAST(sum(greatest(0, sb - greatest(sa, coalesce(seen, sa)))) AS BIGINT) AS source_span, CAST(sum(CASE WHEN seen IS NULL OR sa - seen > {P.region_gap} THEN 1 ELSE 0 END) AS BIGINT) AS num_source_regions FROM m GROUP BY ALL)
SELECT own.*, coalesce(source_span, 0) AS source_span, coalesce(num_source_regions, 0) AS num_source_regions, matched / digest_length AS coverage, CASE WHEN matched > 0 THEN phonetic / matched ELSE 0.0 END AS phonetic_fraction, 1 - matched / digest_length AS novel_fraction FROM own LEFT JOIN r USING (digest_id, source_id)""")
def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, longest, phonetic share and regions of segments; here line items as segments of orders in four sources."""
    n, flag = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    a, sa = (F.col("l_linenumber") - 1).cast("long") * 50, F.col("l_partkey") % 900
    kind = F.when(flag == "R", "novel").when(flag == "A", "phonetic").when(F.col("l_linestatus") == "F", "fuzzy").otherwise("exact")
    seg = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("digest_id"), (F.col("l_suppkey") % 4).alias("source_id"), a.alias("digest_start"), (a + n).alias("digest_end"), sa.alias("source_start"), (sa + n).alias("source_end"), kind.alias("match_type")
    )
    return scoring.segment_statistics(seg, P.region_gap)


@query(f"""WITH {TOKENS}, sizes AS (SELECT source_id, len(w) AS n FROM docs), dsizes AS (SELECT digest_id, len(w) AS n FROM items),
dm AS (SELECT *, max(d_end) OVER (PARTITION BY digest_id, source_id ORDER BY d_start, d_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM runs),
dcov AS (SELECT digest_id, source_id, sum(greatest(0, d_end - greatest(d_start, coalesce(seen, 0)))) AS covered FROM dm GROUP BY ALL),
sm AS (SELECT *, max(s_end) OVER (PARTITION BY digest_id, source_id ORDER BY s_start, s_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM runs),
scov AS (SELECT digest_id, source_id, sum(greatest(0, s_end - greatest(s_start, coalesce(seen, 0)))) AS spanned,
    sum(CASE WHEN seen IS NULL OR s_start - seen > {P.region_gap} THEN 1 ELSE 0 END) AS regions FROM sm GROUP BY ALL)
SELECT digest_id, source_id, covered / dsizes.n AS coverage, 1 - covered / dsizes.n AS novel_fraction, spanned / sizes.n AS source_span, CAST(regions AS BIGINT) AS num_source_regions
FROM dcov JOIN scov USING (digest_id, source_id) JOIN sizes USING (source_id) JOIN dsizes USING (digest_id)""")
def alignment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = seed_runs(spark, sf_dir)
    count = lambda t, i, o: table(spark, sf_dir, t).select(F.col(i).alias(o), F.size(tx.words(F.col("text"))).alias("_n"))
    pair = ["digest_id", "source_id"]
    covered = intervals.merged_length(runs, pair, "d_start", "d_end", "covered")
    spanned = intervals.merged_length(runs, pair, "s_start", "s_end", "spanned")
    regions = intervals.regions(runs, pair, "s_start", "s_end", P.region_gap, "num_source_regions")
    out = covered.join(spanned, pair).join(regions, pair)
    out = out.join(count("benchmark", "item_id", "digest_id").withColumnRenamed("_n", "d_n"), "digest_id").join(count("documents", "doc_id", "source_id").withColumnRenamed("_n", "s_n"), "source_id")
    share = F.col("covered") / F.col("d_n")
    return out.select(*pair, share.alias("coverage"), (1 - share).alias("novel_fraction"), (F.col("spanned") / F.col("s_n")).alias("source_span"), "num_source_regions")


@query("""WITH m AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + 60 AS e FROM events),
seen AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)
SELECT user_id, CAST(sum(CASE WHEN seen IS NULL OR s - seen > 3600 THEN 1 ELSE 0 END) AS BIGINT) AS n_regions, count(*) AS n_events FROM seen GROUP BY user_id""")
def source_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions on a line of positions: here the sessions of users, more than an hour apart."""
    ev = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ev = ev.select("user_id", (F.col("us") / 1e6).alias("s"), (F.col("us") / 1e6 + 60).alias("e"))
    return intervals.regions(ev, ["user_id"], "s", "e", 3600, "n_regions").join(ev.groupBy("user_id").agg(F.count("*").alias("n_events")), "user_id")


@query("""WITH m AS (SELECT l_orderkey, CAST(l_partkey % 500 AS BIGINT) AS s, CAST(l_partkey % 500 + l_quantity AS BIGINT) AS e FROM lineitem),
seen AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)
SELECT l_orderkey, CAST(sum(greatest(0, e - greatest(s, coalesce(seen, 0)))) AS BIGINT) AS merged FROM seen GROUP BY l_orderkey""")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    spans = li.select("l_orderkey", (F.col("l_partkey") % 500).alias("s"), (F.col("l_partkey") % 500 + F.col("l_quantity").cast("long")).alias("e"))
    return intervals.merged_length(spans, ["l_orderkey"], "s", "e", "merged")


TABLE_CHARS = "aeioulnrst"
REGION_SQL = f"""
chars AS (SELECT doc_id, i - 1 AS pos, contains('{TABLE_CHARS}', lower(text[i])) AS hit FROM documents, unnest(range(1, length(text) + 1)) t(i)),
starts AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, sum(CAST(hit AS INT)) OVER w AS n, count(*) OVER w AS m FROM chars
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {PH.window - 1} FOLLOWING)) WHERE m = {PH.window} AND n >= {int(PH.density * PH.window) + 4}),
isl AS (SELECT doc_id, pos, max(pos + {PH.window}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM starts),
marks AS (SELECT doc_id, pos, sum(CASE WHEN seen IS NULL OR pos > seen THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM isl),
regions AS (SELECT doc_id, min(pos) AS start, max(pos) + {PH.window} AS stop FROM marks GROUP BY doc_id, grp HAVING max(pos) + {PH.window} - min(pos) >= {PH.min_region})
"""
#: Latin prose is dense in any ten letters, so the Latin queries ask for four more hits in a window.
DENSE = int(PH.density * PH.window) + 4


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return phonetic.dense_regions(docs, TABLE_CHARS, PH.window, DENSE, PH.min_region)


@query(f"WITH {REGION_SQL} SELECT * FROM regions")
def transliteration_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions_of(spark, sf_dir).select(F.col("id").alias("doc_id"), "start", "stop")


SYLLABLES = f"""{REGION_SQL},
inside AS (SELECT r.doc_id, r.start, c.pos, lower(d.text[c.pos + 1]) AS syl FROM regions r JOIN chars c ON c.doc_id = r.doc_id AND c.pos >= r.start AND c.pos < r.stop AND c.hit JOIN documents d ON d.doc_id = r.doc_id),
syl AS (SELECT doc_id, syl || lead(syl) OVER w || lead(syl, 2) OVER w AS gram FROM inside WINDOW w AS (PARTITION BY doc_id, start ORDER BY pos)),
p0 AS (SELECT DISTINCT doc_id AS id, gram FROM syl WHERE gram IS NOT NULL)
"""


def syllables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return phonetic.syllable_grams(docs, regions_of(spark, sf_dir), {c: c for c in TABLE_CHARS}, PH.gram)


@query(f"WITH {SYLLABLES} SELECT gram, count(*) AS df FROM p0 GROUP BY gram")
def syllable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.document_frequency(syllables_of(spark, sf_dir))


PHONETIC = f"""WITH {SYLLABLES}, pstops AS (SELECT gram FROM p0 GROUP BY gram HAVING count(*) > greatest(floor((SELECT count(DISTINCT id) FROM p0) * {PH.stop_share}), {PH.least_stop})),
pg AS (SELECT id, gram, n_chars FROM p0 ANTI JOIN pstops USING (gram) JOIN documents ON doc_id = id),
totals AS (SELECT id AS digest_id, count(*) AS total FROM pg GROUP BY id),
pairs AS (SELECT d.id AS digest_id, s.id AS source_id, count(*) AS matching FROM pg d JOIN pg s ON d.gram = s.gram AND d.id <> s.id AND s.n_chars >= {P.size_ratio} * d.n_chars GROUP BY ALL)
SELECT digest_id, source_id, matching, total, matching / total AS containment FROM pairs JOIN totals USING (digest_id) WHERE matching / total >= {PH.min_containment}"""


@query(PHONETIC)
def phonetic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = syllables_of(spark, sf_dir)
    stops = grams.stop_grams(grams.document_frequency(made), made.select("id").distinct(), PH.stop_share, PH.least_stop)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    g = grams.without(made, stops).join(sizes, "id")
    return candidates.containment(g, g, PH.min_containment, (F.col("d.id") != F.col("s.id")) & (F.col("s.n_chars") >= P.size_ratio * F.col("d.n_chars")))


@query(f"""WITH {UNION}, sound AS ({PHONETIC})
SELECT digest_id, source_id, containment, from_docnumber, false AS from_phonetic FROM merged
UNION ALL SELECT digest_id, source_id, containment, false, true FROM sound ANTI JOIN merged USING (digest_id, source_id)""")
def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by grams and cross references, and those by sound that they lack."""
    return candidates.with_phonetic(merged_candidates(spark, sf_dir), phonetic_candidates(spark, sf_dir)).select("digest_id", "source_id", "containment", "from_docnumber", "from_phonetic")
