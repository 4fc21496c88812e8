"""Mixing sources to target weights.

Temperature mixing: source token shares are raised to an exponent, which is
bisected until the mixture has the target entropy, and on towards 1 until no
source is repeated too often. The normalised weights are realised under a token
budget as permutations of blocks of each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import WORD, materialise

#: Sections of the exponent's interval tried in one pass, and passes: 32 ** 9 = 2 ** 45; the largest exponent tried.
SECTIONS, PASSES, MOST_EXPONENT = 32, 9, 64.0
#: Decimals of the exponent, and what rounding may take off a quota before it counts as a token less.
DECIMALS, ULPS = 9, 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def _bisect(lo: float, hi: float, holds) -> float:
    """The least x of (lo, hi] for which ``holds`` is true, which it is for ``hi`` and all x from some x on."""
    for _ in range(PASSES):
        points = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)] + [hi]
        first = next((i for i, ok in enumerate(holds(points[:-1])) if ok), SECTIONS - 1)
        lo, hi = (points[first - 1] if first else lo), points[first]
    return hi


def solve_exponent(totals: DataFrame, budget: float, entropy: float, repetition: float) -> float:
    """The exponent with the target entropy, or the nearest to it on the way to 1 that repeats no source too often.

    ``totals`` has a row for each source with ``total`` > 0. ``entropy`` is the
    target as a fraction of the logarithm of the number of sources, 1 for equal
    weights. The entropy falls as the exponent rises, from 0 on; where shares
    are more even than the target, the exponent is over 1. The most repeated
    source is the smallest for exponents under 1 and the largest for those
    over 1. Sources of equal size, and others whose entropy stays over the
    target however large the exponent, keep their own shares: the exponent is
    1. Only sums come to the driver, so the number of sources isn't bounded.
    """
    n, top, least, total = totals.agg(F.count("*"), F.max("total"), F.min("total"), F.sum("total")).first()
    if budget > repetition * total:
        raise ValueError("the budget needs more repetition than the limit allows")
    if n > 1 and top == least:
        return 1.0
    most = entropy * math.log(n)

    def sums(points: list[float]) -> list[tuple[float, float]]:
        x = F.log(F.col("total") / F.lit(float(top)))
        rows = totals.select(x.alias("x"), F.posexplode(F.array(*map(F.lit, points))).alias("i", "a"))
        found = rows.groupBy("i").agg(F.sum(F.exp(F.col("x") * F.col("a"))).alias("z"), F.sum(F.exp(F.col("x") * F.col("a")) * F.col("x") * F.col("a")).alias("zx"))
        return [(r.z, r.zx) for r in sorted(found.collect(), key=lambda r: r.i)]

    def even_enough(points: list[float]) -> list[bool]:
        return [math.log(z) - zx / z <= most + 1e-12 for z, zx in sums(points)]

    def seldom_enough(points: list[float]) -> list[bool]:
        parts = zip(points, sums(points), strict=True)
        return [budget / z * max((least / top) ** a / least, 1 / top) <= repetition * (1 + 1e-12) for a, (z, _) in parts]

    lo, hi = 0.0, 1.0
    if even_enough([0.0])[0]:
        found = 0.0
    else:
        while not even_enough([hi])[0]:
            lo, hi = hi, 2 * hi
            if hi > MOST_EXPONENT:
                return 1.0
        found = round(_bisect(lo, hi, even_enough), DECIMALS)
    if not seldom_enough([found])[0]:
        side = 1.0 if found < 1 else -1.0
        away = abs(1.0 - found)
        found = round(found + side * _bisect(0.0, away, lambda steps: seldom_enough([found + side * s for s in steps])), DECIMALS)
    return found


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float = 1.0,
    entropy: float = 0.95,
    repetition: float = 4.0,
    block_tokens: int = 4096,
    most_blocks: int = 4096,
    seed: str = "mix",
) -> DataFrame:
    """Rows of the mixture: which documents to read, how often and in which order.

    The budget is shared out by weight in whole tokens, which add up to it
    (largest remainders, ties by name). A source gets its quota as
    whole epochs and a rest. An epoch is a permutation of the source's blocks;
    of the last one, whole blocks are taken while they fit and the next block
    gives documents, in its own permuted order, while they fit. ``budget`` is
    a multiple of the corpus's tokens. Documents are dealt to blocks by hash;
    a source has at most ``most_blocks``, so that running sums are over blocks
    and, in one block, over documents: a source that holds a third of all rows
    is spread like any other.

    Returns id, source, epoch (from 0), block, block_rank (place in the
    epoch's permutation, from 1), n_tokens, quota, source_tokens, exponent.
    Texts without words, nulls included, have no tokens and are in no epoch. A
    null source is a source of its own. Rows with a null id are dealt by their
    texts. Rows are counted as they come: a repeated row counts twice and is
    dealt twice. An empty table gives no rows. See ``solve_exponent`` for
    targets that can't be met.
    """
    spark: SparkSession = docs.sparkSession
    source = F.col(source_col).cast("string")
    counted = docs.select(
        F.col(id_col).alias("id"),
        source.alias("src"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.col(text_col).cast("string")))).alias("name"),
        word_count(F.col(text_col)).alias("n"),
    ).filter("n > 0")
    counted = materialise(counted, "mix-counts")
    totals = materialise(counted.groupBy("key").agg(F.sum("n").alias("total")), "mix-totals")
    whole = totals.agg(F.sum("total")).first()[0]
    names = "id, src as source, epoch, block, block_rank, n as n_tokens, quota, total as source_tokens, exponent"
    if not whole:
        empty = counted.selectExpr("id", "src", "0L epoch", "0L block", "0L block_rank", "n", "0L quota", "0L total", "0D exponent")
        return empty.filter("false").selectExpr(*names.split(", ")).withColumnRenamed("id", id_col)
    tokens = math.floor(budget * whole)
    alpha = solve_exponent(totals, tokens, entropy, repetition)
    top = totals.agg(F.max("total")).first()[0]
    z = totals.agg(F.sum(F.exp(F.log(F.col("total") / F.lit(float(top))) * alpha))).first()[0]
    share = F.exp(F.log(F.col("total") / F.lit(float(top))) * alpha) / z * tokens
    floors = totals.withColumn("share", share).withColumn("base", F.floor(F.col("share") + ULPS)).withColumn("left_over", F.round(F.col("share") - F.col("base"), 6))
    over = tokens - floors.agg(F.sum("base")).first()[0]
    # A row for each source; what is left of the budget is less than one token for each.
    rank = F.row_number().over(Window.orderBy(F.desc("left_over"), "key"))
    plan = (
        floors.withColumn("quota", F.col("base") + (rank <= over).cast("long"))
        .drop("share", "base", "left_over")
        .withColumn("whole_epochs", F.floor(F.col("quota") / F.col("total")))
        .withColumn("rest", F.col("quota") - F.col("whole_epochs") * F.col("total"))
        .withColumn("blocks", F.least(F.lit(most_blocks), F.ceil(F.col("total") / block_tokens)))
    )
    dealt = counted.join(plan, "key").withColumn(
        "block", F.conv(F.substring(_ranked(F.lit(seed), F.col("name")), 1, 12), 16, 10).cast("long") % F.col("blocks")
    )

    # Places of the blocks in each epoch: at most most_blocks rows a source and epoch.
    sized = dealt.groupBy("key", "block", "whole_epochs", "rest").agg(F.sum("n").alias("size"))
    epochs = sized.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole_epochs"))))
    order = Window.partitionBy("key", "epoch").orderBy(_ranked(F.lit(seed), F.col("key"), F.col("epoch").cast("string"), F.col("block").cast("string")), "block")
    placed = (
        epochs.withColumn("block_rank", F.row_number().over(order).cast("long"))
        .withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left", F.when(F.col("epoch") < F.col("whole_epochs"), F.col("size")).otherwise(F.col("rest") - F.coalesce("before", F.lit(0))))
        .filter("left > 0")
        .select("key", "block", "epoch", "block_rank", "left", (F.col("left") < F.col("size")).alias("cut"))
    )
    rows = dealt.join(placed, ["key", "block"]).withColumn("exponent", F.lit(alpha))
    inside = Window.partitionBy("key", "epoch", "block").orderBy(_ranked(F.lit(seed), F.col("epoch").cast("string"), F.col("name")), "name", "n")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.filter("cut").withColumn("upto", F.sum("n").over(running)).filter("upto <= left").drop("upto")
    return rows.filter("not cut").unionByName(cut).selectExpr(*names.split(", ")).withColumnRenamed("id", id_col)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus's worth of tokens at 0.95 of the most possible entropy, no source more than 4 times."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id AS id, source AS src, coalesce('=' || source, 'null') AS key, coalesce(doc_id::VARCHAR, 'null ' || md5(text)) AS name,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM documents WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 0
), totals AS (SELECT key, sum(n)::BIGINT AS total FROM counted GROUP BY key),
facts AS (SELECT count(*) AS k, max(total)::DOUBLE AS top, min(total)::DOUBLE AS least, sum(total)::BIGINT AS whole FROM totals),
grown(a, h) AS (
  SELECT 1.0::DOUBLE, (SELECT ln(sum(total / top)) - sum(total / top * ln(total / top)) / sum(total / top) FROM totals, facts)
  UNION ALL
  SELECT 2 * a, (SELECT ln(sum(pow(total / top, 2 * a))) - sum(pow(total / top, 2 * a) * ln(total / top) * 2 * a) / sum(pow(total / top, 2 * a)) FROM totals, facts)
  FROM grown, facts WHERE h > 0.95 * ln(k) + 1e-12 AND a < 64
), bracket AS (SELECT max(a) AS hi, CASE WHEN max(a) > 1 THEN max(a) / 2 ELSE 0.0 END AS lo, min(h) <= 0.95 * any_value(ln(k)) + 1e-12 AS met FROM grown, facts),
steps(i, lo, hi) AS (
  SELECT 0, lo::DOUBLE, hi::DOUBLE FROM bracket
  UNION ALL
  SELECT i + 1, CASE WHEN h <= 0.95 * ln(k) + 1e-12 THEN lo ELSE mid END, CASE WHEN h <= 0.95 * ln(k) + 1e-12 THEN mid ELSE hi END
  FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           (SELECT ln(sum(pow(total / top, (lo + hi) / 2))) - sum(pow(total / top, (lo + hi) / 2) * ln(total / top) * (lo + hi) / 2) / sum(pow(total / top, (lo + hi) / 2))
            FROM totals, facts) AS h
    FROM steps WHERE i < 46
  ), facts
), even AS (SELECT CASE WHEN k > 1 AND top = least OR NOT met THEN 1.0 WHEN k = 1 THEN 0.0 ELSE round(steps.hi, 9) END AS e FROM steps, facts, bracket WHERE i = 46),
turns(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, abs(1 - e)::DOUBLE FROM even
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT i, lo, hi, mid, whole / (SELECT sum(pow(total / f.top, a)) FROM totals) * greatest(pow(f.least / f.top, a) / f.least, 1 / f.top) <= 4 * (1 + 1e-12) AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, e + CASE WHEN e < 1 THEN 1 ELSE -1 END * (lo + hi) / 2 AS a FROM turns, even WHERE i < 46), facts f
  )
), solved AS (
  SELECT CASE WHEN whole / (SELECT sum(pow(total / f.top, e)) FROM totals) * greatest(pow(f.least / f.top, e) / f.least, 1 / f.top) <= 4 * (1 + 1e-12) THEN e
              ELSE round(e + CASE WHEN e < 1 THEN 1 ELSE -1 END * hi, 9) END AS a
  FROM turns, even, facts f WHERE i = 46
), shares AS (
  SELECT key, total, a, share, floor(share + 1e-6)::BIGINT AS base, whole
  FROM (SELECT key, total, a, whole, exp(ln(total / top) * a) / (SELECT sum(exp(ln(total / top) * a)) FROM totals) * whole AS share FROM totals, facts, solved)
), plan AS (
  SELECT key, total, quota, quota // total AS whole_epochs, quota % total AS rest, least(4096, ceil(total / 4096.0))::BIGINT AS blocks, a
  FROM (
    SELECT *, base + CASE WHEN row_number() OVER (ORDER BY round(share - base, 6) DESC, key) <= whole - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares
  )
), dealt AS (
  SELECT c.*, p.* EXCLUDE (key), ('0x' || md5('mix:' || name)[1:12])::BIGINT % blocks AS block
  FROM counted c JOIN plan p USING (key)
), placed AS (
  SELECT *, CASE WHEN epoch < whole_epochs THEN size ELSE rest - coalesce(before, 0) END AS left_over
  FROM (
    SELECT *, row_number() OVER w AS block_rank, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (
      SELECT *, unnest(range(0, whole_epochs + 1)) AS epoch
      FROM (SELECT key, block, whole_epochs, rest, sum(n) AS size FROM dealt GROUP BY ALL)
    ) WINDOW w AS (PARTITION BY key, epoch ORDER BY md5('mix:' || key || ':' || epoch || ':' || block), block)
  )
), chosen AS (
  SELECT d.*, p.epoch, p.block_rank, p.left_over, p.size,
         sum(n) OVER (PARTITION BY d.key, p.epoch, d.block ORDER BY md5('mix:' || p.epoch || ':' || name), name, n ROWS UNBOUNDED PRECEDING) AS upto
  FROM dealt d JOIN placed p ON d.key = p.key AND d.block = p.block WHERE left_over > 0
)
SELECT id AS doc_id, src AS source, epoch::BIGINT AS epoch, block::BIGINT AS block, block_rank::BIGINT AS block_rank,
       n AS n_tokens, quota::BIGINT AS quota, total AS source_tokens, a::DOUBLE AS exponent
FROM chosen WHERE left_over >= size OR upto <= left_over
"""
