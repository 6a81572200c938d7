"""Mixing of sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate_s) times, where rate_s brings the source to its target share.
The draw inverts the Poisson distribution at a uniform number made from a hash of the seed and the id, so a
replayed task draws the same number. Copies are dealt out by a hash of (seed, id, copy): a global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table, text_of
from tremorframe.session import durable

SEED = 20
#: Rates above this are drawn as a sum of equal parts: exp(-rate) stays far from underflow.
PART_RATE = 32.0
#: Length of a part's distribution table; at a mean of 32 what lies beyond is below 1e-50.
TABLE = 150
#: A rates table up to this many sources is broadcast; a larger one is joined by key, salted.
BROADCAST_SOURCES = 10_000
SALTS = 64


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5,
                 size_factor: float = 1.0) -> DataFrame:
    """``source, rate``: the mean number of copies that gives each source its share of the characters.

    ``weights`` are target shares by source (a source without one gets none); without ``weights`` a source's
    share is proportional to its characters to the power of ``exponent``. ``size_factor`` is the size of the
    mixture relative to the input. A null source is a source of its own. Sources without characters get rate 0.
    """
    sizes = docs.select(F.col("source").cast("string").alias("source"), F.char_length(text_of()).alias("chars")) \
        .groupBy("source").agg(F.sum("chars").cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.pow("chars", F.lit(float(exponent)))).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left") \
            .select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = durable(sizes)
    # one row, whatever the input
    total = sizes.filter("chars > 0").agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    scale = (total.chars or 0.0) * size_factor / total.weight if total.weight else 0.0
    rate = F.when(F.col("chars") > 0, F.round(F.col("weight") * F.lit(float(scale)) / F.col("chars"), 9)).otherwise(0.0)
    return sizes.select("source", rate.alias("rate"))


def _uniform(seed: int, *parts: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0.. of a Poisson variable; the last entry is 1."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("table"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"),
                        F.concat(acc["table"], F.array(acc["total"] + term)).alias("table"))

    filled = F.aggregate(F.sequence(F.lit(1), F.lit(TABLE)), start, step)["table"]
    return F.concat(filled, F.array(F.lit(1.0)))


def poisson_counts(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with the long column ``_copies``: the inverse of the source's distribution at the document's number."""
    spark = docs.sparkSession
    tables = durable(rates.select(
        F.col("source").alias("_source"), F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).alias("_parts"), "rate",
    ).select("_source", "_parts", _distribution(F.col("rate") / F.col("_parts")).alias("_table")))
    source = F.col("source").cast("string")
    if tables.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(tables), source.eqNullSafe(F.col("_source")), "left")
    else:
        salted = tables.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, source.eqNullSafe(F.col("_source")) & (F.col("_deal") == F.col("_salt")), "left")
    draws = F.transform(
        F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)).cast("int") - 1),
        lambda part: F.transform(F.array(_uniform(seed, F.col("doc_id"), part)), lambda u: F.size(
            F.filter(F.col("_table"), lambda p: p < u)))[0])
    copies = F.aggregate(draws, F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    return joined.withColumn("_copies", copies).select(*[F.col(f"`{c}`") for c in docs.columns], "_copies")


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_copy`` (1..n) and ``_order`` (hex), dealt out at random and sorted by ``_order`` in each partition."""
    copies = poisson_counts(docs, rates, seed).filter("_copies > 0") \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")
    key = F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_copy"))
    return copies.withColumn("_order", F.md5(key)).repartition("_order").sortWithinPartitions("_order")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, size_factor: float = 1.0,
        seed: int = SEED) -> DataFrame:
    """The mixture: every row of ``docs`` as often as drawn, with its own columns and ``_copy``, ``_order``.

    A draw depends on seed, id and rate only: repeated rows are drawn alike, rows with a null id share one
    draw per source. Null and empty texts weigh nothing but are drawn like their source. Extra columns pass
    through; names that begin with ``_copy``, ``_copies``, ``_order``, ``_source``, ``_parts``, ``_table``, ``_salt``
    or ``_deal`` are renamed by the caller first. An empty table gives an empty mixture.
    """
    return replicate(docs, source_rates(docs, weights, exponent, size_factor), seed)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_order").alias("order_key"), "text")


OP10_SQL = f"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, round(pow(chars, 0.5) * ((SELECT sum(chars) FROM sizes) / (SELECT sum(pow(chars, 0.5)) FROM sizes)) / chars, 9) AS rate
  FROM sizes WHERE chars > 0
), parts AS (
  SELECT source, rate, greatest(ceil(rate / {PART_RATE}), 1)::INT AS parts FROM rates
), tables AS (
  SELECT source, parts, j, sum(exp(-rate / parts + j * ln(rate / parts) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS p
  FROM parts, generate_series(0, {TABLE}) AS g(j)
), listed AS (
  SELECT source, parts, list(p ORDER BY j) AS p FROM tables GROUP BY ALL
), counted AS (
  SELECT doc_id, d.source, text, list_sum(list_transform(range(parts), lambda i: len(list_filter(p, lambda c: c <
    (('0x' || substr(md5('{SEED}:' || doc_id || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0))))::BIGINT AS n
  FROM documents d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, source, copy, md5('{SEED}:order:' || doc_id || ':' || copy) AS order_key, text
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM counted)
"""
