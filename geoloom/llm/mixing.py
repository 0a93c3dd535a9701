"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target weight times the total size, over its own size. Every
document draws a uniform number from a keyed hash of its id, inverts the Poisson distribution of its
source's rate with it, and is exploded by that count. The copies are then dealt out by a keyed hash
of id and copy number, which is a global shuffle that any rerun repeats. JVM functions only.

Sizes are counted with map-side aggregation, so a hot source costs no more than another. The table of
rates has a row for each source and count; it is broadcast only if it was counted to be small, else
joined by source, where Spark splits a hot one.

Defined results: a null source is a source of its own, a null text has size 0. Sources of size 0 and
sources that the weights leave out are not drawn. A null id draws as the text "null". Rows that repeat
an id draw the same count each. An empty table gives no rows. Other columns are returned as
they are, but for ones named copy_no or mix_key, which are replaced.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import shared_folder

#: A source's weight is its share to this power, unless weights are given.
TEMPERATURE = 0.5
SEED = 42
#: Entries of the table of counts up to which it is sent to every task; a larger one is joined by source.
MOST_SENT = 500_000
#: Hash values have so many bits: what a double holds exactly.
BITS = 52


def _hashed(seed: int, *what) -> F.Column:
    """A number of BITS bits from the text "seed:what:..."."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *what)), 1, BITS // 4), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict | None = None, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """source, size, rate of each source with a size."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(text_col, F.lit("")))).alias("size")).where("size > 0")
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, weight double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").where("weight > 0")
    total = weighed.agg(F.sum("weight").alias("_weight"))
    volume = sizes.agg(F.sum("size").alias("_size"))
    return weighed.join(total).join(volume).select("source", "size", (F.col("weight") / F.col("_weight") * F.col("_size") * F.lit(float(epochs)) / F.col("size")).alias("rate"))


def poisson_steps(rate: DataFrame) -> DataFrame:
    """source, copies, low: the uniform number from which on a source's documents get that count.

    Terms are taken in logarithms, as running sums of the ratios of neighbours, from 12 deviations below
    the mean to where a tail is below 2 ** -BITS, and scaled to add up to 1. Counts that no number of BITS
    bits can draw are left out.
    """
    reach = 12 * F.sqrt("rate") + 30
    first = F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("bigint")
    terms = rate.select("source", "rate", first.alias("first"), F.explode(F.sequence(first, F.ceil(F.col("rate") + reach).cast("bigint"))).alias("copies"))
    sofar = Window.partitionBy("source").orderBy("copies").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source")
    ratio = F.when(F.col("copies") > F.col("first"), F.log(F.col("rate") / F.col("copies"))).otherwise(F.lit(0e0))
    terms = terms.withColumn("log", F.sum(ratio).over(sofar))
    terms = terms.withColumn("p", F.exp(F.col("log") - F.max("log").over(whole)))
    terms = terms.withColumn("p", F.col("p") / F.sum("p").over(whole))
    steps = terms.withColumn("low", F.coalesce(F.sum("p").over(sofar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0e0)))
    return steps.where(F.col("p") > F.lit(2.0**-BITS)).select("source", "copies", "low")


def _drawn() -> F.Column:
    """The copies of the last of a row's steps that begins at or below its number, by halving; 0 if none does."""
    half = "cast((s.x + s.y) div 2 as int)"
    step = f"if(get(__mix_steps, {half}).low <= __mix_u, named_struct('x', {half}, 'y', s.y), named_struct('x', s.x, 'y', {half}))"
    turns = "sequence(1, cast(ceil(log2(size(__mix_steps) + 1)) as int))"
    place = f"aggregate({turns}, named_struct('x', -1, 'y', size(__mix_steps)), (s, i) -> if(s.y - s.x > 1, {step}, s), s -> s.x)"
    return F.expr(f"coalesce(get(__mix_steps, {place}).copies, 0L)")


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, temperature: float = TEMPERATURE, epochs: float = 1.0, most_sent: int = MOST_SENT) -> DataFrame:
    """The documents' columns with copy_no (from 1) and mix_key, dealt out by range of mix_key and sorted by it."""
    shared_folder(docs.sparkSession)
    table = poisson_steps(rates(docs, weights, source_col, text_col, temperature, epochs)).where("copies > 0").checkpoint()
    small = table.count() <= most_sent
    steps = table.groupBy(F.col("source").alias("__mix_source")).agg(F.sort_array(F.collect_list(F.struct("low", "copies"))).alias("__mix_steps"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = docs.withColumn("__mix_u", _hashed(seed, F.lit("draw"), key) / F.lit(float(1 << BITS)))
    drawn = drawn.join(F.broadcast(steps) if small else steps, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    count = _drawn()
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.nullif(count, F.lit(0).cast("bigint")))))
    keyed = copies.withColumn("mix_key", _hashed(seed, F.lit("place"), key, F.col("copy_no").cast("string")))
    return keyed.drop("__mix_u", "__mix_source", "__mix_steps").sort("mix_key", id_col, "copy_no")
