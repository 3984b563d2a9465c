"""Summaries of sequences and pieces, for each split and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import segment_length


def split_lengths(sequences: DataFrame, max_segments: int | None = 30, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """A row for each split, empty ones too: records, mean, median, 95th nearest-rank percentile, least and greatest length, and those over max_segments.

    Lengths are few, so the percentiles hold a count for each length and no rows.
    """
    n = segment_length(sequences)
    over = F.count_if(n > max_segments) if max_segments is not None else F.lit(0).cast("long")
    rows = sequences.select("split", n.alias("n")).groupBy("split").agg(
        F.count("*").alias("num_records"),
        F.avg("n").alias("avg_segments"),
        F.expr("percentile(n, 0.5)").alias("median_segments"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95_segments"),
        F.min("n").cast("long").alias("min_segments"),
        F.max("n").cast("long").alias("max_segments"),
        (F.count_if(F.col("n") > max_segments) if max_segments is not None else over).alias("num_long"),
    )
    every = sequences.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    rows = F.broadcast(every).join(rows, "split", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("num_records", "avg_segments", "median_segments", "p95_segments", "min_segments", "max_segments", "num_long")}
    return rows.withColumns(zero).withColumn("fraction_long", F.coalesce(F.try_divide("num_long", "num_records"), F.lit(0.0)))


def piece_statistics(pieces: DataFrame, dataset: str = "walks") -> DataFrame:
    """Parents and pieces for each split, and over all where split is null: shares of parents in several pieces, and the share of transitions that pieces hold.

    Over all, min_coverage is the least of the splits'.
    """
    parents = pieces.groupBy("split", "traj_id").agg(
        F.count("*").alias("q"), F.max("parent_num_segments").alias("n"), F.max(F.size("segments")).alias("most"), F.sum(F.size("segments") - 1).alias("held")
    )
    per_split = parents.groupBy("split").agg(
        F.count("*").alias("num_parents"),
        F.sum("q").alias("num_pieces"),
        F.count_if(F.col("q") == 1).alias("num_single"),
        F.count_if(F.col("q") > 1).alias("num_multi"),
        F.max("q").alias("max_pieces"),
        F.sum("n").alias("total"),
        F.max("most").alias("max_piece_segments"),
        (F.sum("held") / F.sum(F.col("n") - 1)).alias("min_coverage"),
    )
    sums = [F.sum(c).alias(c) for c in ("num_parents", "num_pieces", "num_single", "num_multi", "total")]
    out = per_split.groupingSets([[F.col("split")], []], F.col("split")).agg(*sums, *(F.max(c).alias(c) for c in ("max_pieces", "max_piece_segments")), F.min("min_coverage").alias("min_coverage"))
    out = out.where("num_parents > 0")
    share = lambda a: F.round(F.col(a) / F.col("num_parents"), 9)
    return out.select(
        F.lit(dataset).alias("dataset"), "split", "num_parents", "num_pieces", "num_single", "num_multi",
        share("num_multi").alias("fraction_multi"), share("num_pieces").alias("avg_pieces"), "max_pieces", share("total").alias("avg_parent_segments"), F.col("max_piece_segments").cast("int").alias("max_piece_segments"), "min_coverage",
    )


def check_pieces(statistics: DataFrame, max_segments: int) -> None:
    """Raise unless each split's pieces hold all transitions, none is too long, and parents add up."""
    bad = statistics.where(f"max_piece_segments > {int(max_segments)} or abs(min_coverage - 1) > 1e-12 or num_single + num_multi != num_parents").collect()  # a row for each split
    if bad:
        raise AssertionError(f"pieces of {', '.join(str(r['split']) for r in bad)} do not hold their parents")
    if statistics.limit(1).count() == 0:
        raise ValueError("no sequences")
