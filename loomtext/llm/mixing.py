"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
#: A source's documents are ordered by a keyed digest; running sums are taken in this many digest buckets of each.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, order: str) -> DataFrame:
    """Adds ``position`` (from 0) in the order of ``order``: a range sort and one offset for each of its partitions."""
    sorted_ = written(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row a partition
    offset, total = F.lit(0).cast("long"), 0
    if counts:
        pairs = []
        for p, n in counts:
            pairs += [F.lit(p).cast("long"), F.lit(total).cast("long")]
            total += n
        offset = F.create_map(*pairs)[part]
    return sorted_.withColumn("position", F.col("_at").bitwiseAND((1 << 33) - 1) + offset).drop("_at")


def water_level(sources: DataFrame, share: float) -> float:
    """Words for each unit of weight once every source above its cap is held there and the rest shared anew.

    ``sources`` has weight and cap; only a sum and a level leave the cluster in each round.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    goal = share * total
    level, open_ = goal / weights, weights
    while True:
        above = F.col("cap") <= level * F.col("weight")
        held, rest = sources.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if rest in (open_, 0):  # no further source is held
            return level
        level, open_ = (goal - held) / rest, rest


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row.

    Sources stand in code-point order, null last, and take ``weights`` in turn. A source's words are repeated whole as
    often as its target allows; the rest goes to its documents in the order of a digest of seed and id, the last of
    them in part. Null and empty texts have size 0 and take 0; repeated rows count each; rows with equal id are
    ordered by size; an empty table gives no rows; other columns are ignored.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sized = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("key"),
            F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary")).alias("digest"),
        ).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS)),
        "sized",
    )
    by_bucket = written(sized.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "buckets")
    ranked = positions(by_bucket.groupBy("key").agg(F.sum("words").alias("source_size")), "key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = ranked.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    level = water_level(sources, share)
    share_of = F.lit(level) * F.col("weight")
    target = F.when(F.col("cap") <= share_of, F.col("cap").cast("double")).otherwise(share_of)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = (
        sources.select("key", "source_size", target.alias("target"))
        .withColumn("whole", epochs)
        .withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    before = F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_bucket.withColumn("start", F.coalesce(before, F.lit(0))).join(targets, "key").drop("words")
    running = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - (F.col("running") - F.col("size"))))
    return (
        sized.withColumn("running", running)
        .join(starts, ["key", "bucket"])
        .select("id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: whole repetitions as repeated rows, a part as a shortened text.

    Null, empty and wordless texts are never taken; very long texts may be cut like others; repeated rows count each;
    null ids and sources stay; all columns are kept, whatever their names; an empty table gives no rows.
    """
    doc, size, taken, twin, turn = (free_name(docs, x) for x in ("doc", "size", "taken", "twin", "turn"))
    amounts = mix(docs, **options).where("taken > 0").select(F.col("id").alias(doc), F.col("size").alias(size), F.col("taken").alias(taken))
    same = Window.partitionBy(doc, size)
    amounts = amounts.withColumn(twin, F.row_number().over(same.orderBy(taken))).alias("a")  # rows with equal id and size stay apart
    text = F.col("text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    own = docs.withColumn(doc, F.col("doc_id")).withColumn(size, word_count(text)).where(F.col(size) > 0)
    own = own.withColumn(twin, F.row_number().over(same.orderBy("text"))).alias("d")
    met = F.col(f"d.{doc}").eqNullSafe(F.col(f"a.{doc}")) & (F.col(f"d.{size}") == F.col(f"a.{size}")) & (F.col(f"d.{twin}") == F.col(f"a.{twin}"))
    out = own.join(amounts, met).select("d.*", f"a.{taken}")
    out = out.withColumn(turn, F.explode(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)).cast("int") - 1)))
    rest = (F.col(taken) - F.col(turn) * F.col(size)).cast("int")
    out = out.withColumn("text", F.when((F.col(turn) + 1) * F.col(size) <= F.col(taken), text).otherwise(F.array_join(F.slice(words, 1, F.greatest(rest, F.lit(1))), " ")))
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(n_chars).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = r"""WITH
sized AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, 2 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per_source),
filled AS (SELECT *,
    coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS goal,
    row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source) AS n FROM ranked),
level AS (SELECT coalesce(arg_min(CAST(goal - held AS DOUBLE) / CAST(open_weight AS DOUBLE), n) FILTER (
    WHERE CAST(cap AS DOUBLE) > CAST(goal - held AS DOUBLE) / CAST(open_weight AS DOUBLE) * weight), 0) AS water FROM filled),
targets AS (SELECT source, source_size, CASE WHEN cap <= water * weight THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target
    FROM ranked, level),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(whole * size
    + greatest(0, least(size, floor(target - whole * source_size) - before)) AS BIGINT) AS taken FROM placed
"""
