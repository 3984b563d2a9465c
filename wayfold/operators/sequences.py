"""Sub-trajectories and their transitions, splits and samples, and checks of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform


def pieces(sequences: DataFrame, max_segments: int = 30) -> DataFrame:
    """Cut each sequence into pieces of at most `max_segments`, neighbours sharing one segment, so that each transition stands in one piece.

    sequences has traj_id, segments, segment_times (may be null). Returns traj_id,
    sbs_id, sbs_index, num_sbs, a_j, r_j (1-based bounds), parent_num_segments,
    segments, segment_times. A sequence of fewer than two segments gives nothing.
    """
    n, stride = F.size("segments"), max_segments - 1
    rows = sequences.where(n >= 2).withColumn("num_sbs", F.ceil((n - 1) / stride).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("num_sbs"))).alias("sbs_index"))
    a = (F.col("sbs_index") - 1) * stride + 1
    return rows.select(
        *(c for c in sequences.columns if c not in ("segments", "segment_times")),
        F.concat(F.col("traj_id"), F.lit("::sbs"), F.col("sbs_index")).alias("sbs_id"),
        "sbs_index",
        "num_sbs",
        a.alias("a_j"),
        F.least(a + stride, n).alias("r_j"),
        n.alias("parent_num_segments"),
        F.slice("segments", a, F.lit(max_segments)).alias("segments"),
        F.slice("segment_times", a, F.lit(max_segments)).alias("segment_times"),
    )


def faults(sequences: DataFrame) -> Column:
    """Why a row is no sequence, or null: no list, fewer than two segments, a null or empty segment, times of another length."""
    times = F.col("segment_times") if "segment_times" in sequences.columns else F.lit(None).cast("array<long>")
    return (
        F.when(F.col("segments").isNull(), "no_segments")
        .when(F.size("segments") < 2, "fewer_than_two")
        .when(F.exists("segments", lambda s: s.isNull() | (s == "")), "empty_segment")
        .when(times.isNotNull() & (F.size(times) != F.size("segments")), "times_of_other_length")
    )


def checked(sequences: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """The rows that are sequences. A row that is none fails the query, or is left out if skip_invalid."""
    fault = faults(sequences)
    if skip_invalid:
        return sequences.where(fault.isNull())
    return sequences.where(F.assert_true(fault.isNull(), F.concat(F.lit("no sequence: "), F.coalesce(fault, F.lit("")))).isNull())


def transitions(sbs: DataFrame) -> DataFrame:
    """A row for each pair of successive segments of a piece: t (from 1), global_pos, cnt, n_transitions, u, v, tau_u, tau_v, delta_t, start, stop."""
    keep = [c for c in sbs.columns if c not in ("segments", "segment_times", "num_sbs", "r_j", "parent_num_segments")]
    n = F.size("segments")
    pair = lambda i: F.struct(
        (i + 1).alias("t"),
        F.get("segments", i).alias("u"),
        F.get("segments", i + 1).alias("v"),
        F.get("segment_times", i).alias("tau_u"),
        F.get("segment_times", i + 1).alias("tau_v"),
    )
    pairs = F.transform(F.sequence(F.lit(0), n - 2), pair)
    rows = sbs.where(n >= 2).select(*keep, n.alias("cnt"), (n - 1).alias("n_transitions"), F.get("segments", F.lit(0)).alias("start"), F.element_at("segments", -1).alias("stop"), F.explode_outer(pairs).alias("x"))
    gap = (F.col("x.tau_v") - F.col("x.tau_u")).cast("double")
    return rows.select(*keep, "cnt", "n_transitions", "start", "stop", "x.*", (F.col("a_j") + F.col("x.t") - 1).alias("global_pos"), gap.alias("delta_t")).drop("a_j")


def assert_ordered(rows: DataFrame) -> DataFrame:
    """The transitions, failing where time runs backwards."""
    fine = F.assert_true(F.coalesce(F.col("delta_t") >= 0, F.lit(True)), F.lit("a transition has a negative time gap"))
    return rows.where(fine.isNull())


def legality(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """traj_id, n_pairs, n_illegal, first_illegal (position of the first pair that is no edge, else null)."""
    known = edges.select("u", "v").distinct().withColumn("legal", F.lit(True))
    joined = rows.join(known, ["u", "v"], "left")
    bad = F.col("legal").isNull()
    return joined.groupBy("traj_id").agg(F.count("*").alias("n_pairs"), F.count_if(bad).alias("n_illegal"), F.min(F.when(bad, F.col("global_pos"))).alias("first_illegal"))


def stay_anchors(rows: DataFrame, seconds: float) -> DataFrame:
    """sbs_id, pos (from 0), segment: both ends of each transition that takes `seconds` or longer."""
    long_ = rows.where(F.col("delta_t") >= seconds)
    ends = long_.select("sbs_id", (F.col("t") - 1).alias("pos"), F.col("u").alias("segment")).union(long_.select("sbs_id", "t", "v"))
    return ends.distinct()


def without_repeats(items: Column, times: Column) -> Column:
    """(item, time) pairs without those whose item equals the one before; the first of a run stays."""
    both = F.arrays_zip(items.alias("item"), times.alias("time"))
    return F.filter(both, lambda x, i: (i == 0) | (x["item"] != F.get(items, F.greatest(i - 1, F.lit(0)))))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, each with the same chance; the rows with the least hashes, however the table is partitioned."""
    return rows.orderBy(uniform(seed, "sample", F.col(key)), key).limit(n)


def bin_sample(rows: DataFrame, bin_: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at most of each bin, by the least hashes."""
    order = Window.partitionBy(bin_).orderBy(uniform(seed, "bin", F.col(bin_), F.col(key)), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def split_of(rows: DataFrame, key: str, ratios=(0.8, 0.1, 0.1), seed: int = 42, rounding: str = "floor") -> DataFrame:
    """rows with `split`: exact sizes of train and valid, the rest is test.

    Rows are dealt to equal ranges of their hash, ranked within, and offset by
    the ranges before, so that no task ranks the whole table.
    """
    x = uniform(seed, "split", F.col(key))
    dealt = rows.withColumn("_x", x).withColumn("_range", F.floor(F.col("_x") * 256).cast("int"))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # 256 rows at most
    total = Window.partitionBy()
    before = sizes.select("_range", F.sum("_n").over(total).alias("_all"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_x", key))
    ranked = dealt.withColumn("_own", own).join(F.broadcast(before), "_range")
    size = (lambda r: F.floor(F.col("_all") * r)) if rounding == "floor" else (lambda r: F.bround(F.col("_all") * r))
    rank = F.col("_before") + F.col("_own")
    split = F.when(rank <= size(ratios[0]), "train").when(rank <= size(ratios[0]) + size(ratios[1]), "valid").otherwise("test")
    return ranked.withColumn("split", split).drop("_x", "_range", "_n", "_all", "_before", "_own")


def even_downsample(values: Column, target: int) -> Column:
    """`target` values at even steps, ends included; halves round to even. Shorter arrays stay as they are."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.bround(i * (n - 1) / (target - 1)).cast("int"))
    return F.when(n <= target, values).otherwise(F.transform(F.array_distinct(at), lambda i: F.get(values, i)))


def summary(sbs: DataFrame, max_segments: int = 30) -> DataFrame:
    """One row of statistics of the pieces: parents, pieces, single and multi-piece shares, quantiles of pieces a parent, coverage."""
    parents = sbs.groupBy("traj_id").agg(F.max("num_sbs").alias("q"), F.max("parent_num_segments").alias("n"), F.sum(F.col("r_j") - F.col("a_j")).alias("covered"))
    return parents.agg(
        F.count("*").alias("parents"),
        F.sum("q").alias("pieces"),
        F.count_if(F.col("q") == 1).alias("single"),
        F.count_if(F.col("q") > 1).alias("multi"),
        F.round(F.avg("q"), 9).alias("avg_q"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY q)").cast("long").alias("p95_q"),
        F.max("q").cast("long").alias("max_q"),
        F.round(F.avg("n"), 9).alias("avg_segments"),
        F.expr("percentile(n, 0.5)").alias("median_segments"),
        F.count_if(F.col("n") > max_segments).alias("longer_than_piece"),
        F.round(F.sum("covered") / F.sum(F.col("n") - 1), 9).alias("coverage"),
        (F.sum("q") - F.count("*")).alias("shared_boundaries"),
    )
