"""Weighted fair queueing of sources: virtual finish times, one global order, a total budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.llm.common import WORD, rows_per, stage, text_of
from regimeweave.operators.ordering import with_running_sums

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
BLOCK_ROWS = 20_000


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: its size, weight and target.

    Targets share the total size by weight; none exceeds ``epochs`` times its source, and the
    excess goes to the others by weight until none is above. Sorted by the level at which a source is full,
    the water level is the first that lies below its own source's. Windows here run over one
    row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") - 1) % len(weights))
    full = ranked.withColumn("weight", weight).withColumn("_full", F.col("source_size") * F.lit(float(epochs)) / F.col("weight"))
    order = everyone.orderBy("_full", "_rank")
    levels = full.withColumns(
        {
            "_total": F.sum("source_size").over(everyone),
            "_capped": F.coalesce(F.sum(F.col("source_size") * epochs).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("_level", (F.col("_total") - F.col("_capped")).cast("double") / F.col("_open"))
    first = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(everyone)
    return levels.withColumn("_v", F.coalesce(first["_level"], F.lit(0.0))).select(
        "source",
        F.col("_rank").alias("source_rank"),
        "source_size",
        "weight",
        F.least(F.col("source_size") * F.lit(float(epochs)), F.col("weight") * F.col("_v")).alias("target"),
        F.col("_total").alias("budget"),
    )


def queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` with its size, its source's target and the words the mix takes of it.

    Documents are shuffled by a hash of their id. Copy ``e`` of a document finishes at (e times
    the source's size + words of the source up to it) / weight. All copies are range-sorted by
    finish time, and the order is cut where its words would pass the budget, the total size. A
    source stops after ``epochs`` copies, so it is never over its cap. A null text has size 0;
    a null source is a source; rows that repeat an id are queued one by one. Reruns agree.
    ``carry`` names further columns to return.

    Running sums are taken in blocks of shuffled rows and carried across by one row per block,
    so a source of any share is spread over many tasks.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = stage(docs.select("doc_id", "source", *[c for c in carry if c not in ("doc_id", "source")], F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"), key.alias("_key")))
    targets = stage(source_targets(sized, weights, epochs))
    known = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # hexadecimal digits of the key that cut the rows into blocks of about BLOCK_ROWS
    digits = max(1, len(f"{rows_per(sized, BLOCK_ROWS) * 16 - 1:x}") - 1)
    cumulated = stage(with_running_sums(known, ["source_rank"], ["_key", "doc_id", "size"], F.substring("_key", 1, digits), {"_cum": F.col("size")}))
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("_cum")).cast("double") / F.col("weight")
    copies = cumulated.where("size > 0").select(
        F.explode(F.array(*[finish(e) for e in range(epochs)])).alias("_finish"), "source_rank", "_cum", "size", "budget"
    )
    order = ["_finish", "source_rank", "_cum"]
    ranged = stage(copies.repartitionByRange(rows_per(cumulated, BLOCK_ROWS) * epochs, *order).withColumn("_part", F.spark_partition_id()))
    last = (
        with_running_sums(ranged, [], order, F.col("_part"), {"_words": F.col("size")})
        .where("_words <= budget")
        .agg(F.max(F.struct(*order)).alias("_last"))
    )
    taken = sum(
        (F.coalesce(F.struct(finish(e).alias("_finish"), F.col("source_rank"), F.col("_cum")) <= F.col("_last"), F.lit(False))).cast("bigint")
        for e in range(epochs)
    )
    return cumulated.crossJoin(F.broadcast(last)).select(
        "doc_id", *[c for c in carry if c != "doc_id"], "size", "source_size", "target", (F.col("size") * taken).alias("taken"), finish(0).alias("finish")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once for every copy.

    The queue itself moves narrow rows only; texts move once, dealt together with the queue's rows by
    (doc_id, hash of the text, source). Among rows equal in these, the n-th meets the n-th of the queue.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    keys = ["_id", "_hash", "source"]
    key_columns = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64(text_of()).alias("_hash"), F.col("source")]
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    queued = queue(docs.select("doc_id", "text", *key_columns), carry=keys).select(*keys, F.lit(0).alias("_kind"), times.alias("_times"), "finish")
    rows = docs.select(*key_columns, F.lit(1).alias("_kind"), row)
    met = queued.unionByName(rows, allowMissingColumns=True).repartition(*keys)
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy("finish")))
    met = met.withColumn("_take", F.lag("_times").over(Window.partitionBy(*keys).orderBy("_n", "_kind"))).where("_kind = 1 and _take > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_take")))).select("_doc.*")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS k FROM documents),
s AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS wt, sum(ss) OVER () AS total FROM s),
f AS (SELECT *, ss * 3.0::DOUBLE / wt AS fl FROM w),
l AS (SELECT *, (total - coalesce(sum(ss * 3) OVER (ORDER BY fl, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(wt) OVER (ORDER BY fl, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM f),
t AS (SELECT *, least(ss * 3.0::DOUBLE, wt * coalesce(first_value(lv) OVER (ORDER BY lv > fl, fl, rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)) AS target FROM l),
c AS (SELECT d.*, t.ss, t.wt, t.rk, t.target, t.total,
             sum(size) OVER (PARTITION BY t.rk ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT c.*, e, (e * ss + cum)::DOUBLE / wt AS fin FROM c, range(3) AS q(e) WHERE size > 0),
o AS (SELECT r, size, sum(size) OVER (ORDER BY fin, rk, cum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, total FROM x),
n AS (SELECT r, sum(size) AS taken FROM o WHERE run <= total GROUP BY r)
SELECT doc_id, size::BIGINT AS size, ss::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN n USING (r)
"""
