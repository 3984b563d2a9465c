"""Synthetic walks on the public graph, drawn from recovered statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.tables import staged

#: Candidates that each task may hold: the public graph's size, not the data's. Beyond, each step is a join.
HELD = 5_000_000


def global_prior(recovered: DataFrame) -> DataFrame:
    """v, prob: the mean of all contexts' distributions, weighted by their reports (1 at least)."""
    w = F.greatest(F.col("num_reports"), F.lit(1))
    sums = recovered.groupBy("v").agg(F.sum(F.col("prob") * w).alias("m"))
    return sums.withColumn("prob", F.col("m") / F.sum("m").over(Window.partitionBy())).select("v", "prob")  # a row for each public segment


def candidates(recovered: DataFrame, domain: DataFrame, prior: DataFrame) -> DataFrame:
    """u, more, v, pos, prob, cum, source: what may follow u, with (more) or without steps to come.

    The recovered distribution within the domain; where it has none, the global
    prior within it; else every successor alike. With steps to come, successors
    that are no dead end come first. cum is the running sum in the order of pos.
    """
    alive = domain.select(F.col("u").alias("v")).distinct().withColumn("alive", F.lit(True))
    rows = domain.select("u", "v", "pos").join(alive, "v", "left").join(recovered.select("u", "v", F.col("prob").alias("local")), ["u", "v"], "left")
    rows = rows.join(prior.select("v", F.col("prob").alias("prior")), "v", "left").fillna(0.0, ["local", "prior"]).withColumn("alive", F.coalesce("alive", F.lit(False)))
    rows = rows.withColumn("more", F.explode(F.array(F.lit(False), F.lit(True))))
    own = Window.partitionBy("u", "more")

    def first_choice(c):
        """c where it is positive and no dead end if steps are to come, unless all are."""
        good = F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)
        kept = F.when(~F.col("more") | F.col("alive"), good).otherwise(0.0)
        return F.when(F.sum(kept).over(own) > 0, kept).otherwise(good)

    rows = rows.withColumn("one", F.lit(1.0))
    rows = rows.withColumns({f"_{c}": first_choice(c) for c in ("local", "prior", "one")})
    some = {c: F.sum(f"_{c}").over(own) for c in ("local", "prior", "one")}
    rows = rows.withColumns(
        {
            "prob": F.when(some["local"] > 0, F.col("_local") / some["local"]).when(some["prior"] > 0, F.col("_prior") / some["prior"]).otherwise(F.col("_one") / some["one"]),
            "source": F.when(some["local"] > 0, "local").when(some["prior"] > 0, "prior").otherwise("even"),
        }
    )
    upto = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.where("prob > 0").withColumn("cum", F.sum("prob").over(upto)).select("u", "more", "v", "pos", "prob", "cum", "source")


def with_cum(dist: DataFrame) -> DataFrame:
    """value, cum: the running sum of prob in the order of value."""
    return dist.select("value", F.sum("prob").over(Window.orderBy("value")).alias("cum"))  # a row for each public value


def _pick(options, x):
    """The first option whose running sum reaches x, else the last (sums may round below 1)."""
    return F.coalesce(F.get(F.filter(options, lambda o: x <= o["cum"]), F.lit(0)), F.element_at(options, -1))


def _drawn(n: int, start: DataFrame, count: DataFrame, max_segments: int, seed: int, spark) -> DataFrame:
    """syn_id, first, target_count of n walks."""
    line = lambda d, name: with_cum(d).agg(F.array_sort(F.collect_list(F.struct("cum", "value"))).alias(name))
    held = line(start, "starts").crossJoin(line(count, "counts"))  # one row
    rows = spark.range(1, n + 1).select(F.concat(F.lit("syn"), F.col("id")).alias("syn_id")).crossJoin(F.broadcast(held))
    target = _pick(F.col("counts"), uniform(seed, F.col("syn_id"), "count"))["value"]
    return rows.select("syn_id", _pick(F.col("starts"), uniform(seed, F.col("syn_id"), "start"))["value"].alias("first"), F.least(F.greatest(target, F.lit(1)), F.lit(max_segments)).cast("int").alias("target_count"))


def grow(rows: DataFrame, options: DataFrame, max_segments: int, seed: int, held: int = HELD) -> DataFrame:
    """rows (syn_id, first, target_count) with path and backoff: each walk drawn step by step from candidates().

    A graph of `held` candidates or fewer is one array, looked up by number; a
    larger one is joined at each step.
    """
    listed = options.groupBy("u", "more").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "cum", "source"))).alias("o"))
    if options.limit(held + 1).count() > held:
        return _grow_by_joins(rows, listed, max_segments, seed)
    names = options.select("u").union(options.select("v")).distinct()
    numbered = names.select(F.col("u").alias("name"), (F.row_number().over(Window.orderBy("u")) - 1).alias("at"))  # the public segments
    v = numbered.select(F.col("name").alias("v"), F.col("at").alias("v_at"))
    by_number = options.join(v, "v").join(numbered.withColumnRenamed("name", "u"), "u").groupBy("at", "more").agg(F.array_sort(F.collect_list(F.struct("pos", "v_at", "cum", "source"))).alias("o"))
    slots = numbered.select("at", F.explode(F.array(F.lit(False), F.lit(True))).alias("more")).join(by_number, ["at", "more"], "left")
    table = slots.agg(F.array_sort(F.collect_list(F.struct("at", "more", "o"))).alias("t")).select(F.transform("t", lambda x: x["o"]).alias("table"))
    line = numbered.agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("t")).select(F.transform("t", lambda x: x["name"]).alias("names"))
    rows = rows.join(numbered.withColumnRenamed("name", "first"), "first", "left").crossJoin(F.broadcast(table.crossJoin(line)))  # one row
    zero = F.struct(F.array(F.col("at")).alias("path"), F.lit(0).alias("backoff"))

    def step(s, i):
        last = F.element_at(s["path"], -1)
        choices = F.get("table", 2 * last + (i < F.col("target_count")).cast("int"))
        x = _pick(choices, uniform(seed, F.col("syn_id"), i))
        go = (F.size(s["path"]) == i - 1) & last.isNotNull() & choices.isNotNull() & (i <= F.col("target_count"))
        return F.when(go, F.struct(F.concat(s["path"], F.array(x["v_at"])).alias("path"), (s["backoff"] + (x["source"] != "local").cast("int")).alias("backoff"))).otherwise(s)

    steps = F.sequence(F.lit(2), F.lit(max_segments)) if max_segments >= 2 else F.array().cast("array<int>")
    rows = rows.withColumn("s", F.aggregate(steps, zero, step))
    path = F.when(F.col("at").isNull(), F.array("first")).otherwise(F.transform("s.path", lambda k: F.get("names", k)))
    return rows.select("syn_id", "target_count", path.alias("path"), F.col("s.backoff").alias("backoff"))


def _grow_by_joins(rows: DataFrame, listed: DataFrame, max_segments: int, seed: int) -> DataFrame:
    rows = rows.select("syn_id", "target_count", F.array("first").alias("path"), F.lit(0).alias("backoff"))
    for i in range(2, max_segments + 1):
        going = (F.size("path") == i - 1) & (F.col("target_count") >= i)
        rows = rows.withColumns({"u": F.when(going, F.element_at("path", -1)), "more": F.col("target_count") > i})
        rows = rows.join(listed, ["u", "more"], "left")
        x = _pick(F.col("o"), uniform(seed, F.col("syn_id"), F.lit(i)))
        go = F.col("o").isNotNull()
        rows = rows.select("syn_id", "target_count", F.when(go, F.concat("path", F.array(x["v"]))).otherwise(F.col("path")).alias("path"), (F.col("backoff") + F.when(go & (x["source"] != "local"), 1).otherwise(0)).alias("backoff"))
        if i % 6 == 0:
            rows = staged(rows, "walks")
    return rows


def walks(n: int, start: DataFrame, count: DataFrame, options: DataFrame, max_segments: int, seed: int, spark) -> DataFrame:
    """syn_id, segments, target_count, early_stop, backoff_steps: n walks, each drawn by a fold over its steps.

    start and count are distributions (value, prob); options are candidates().
    A walk stops early at a segment without successors.
    """
    rows = grow(_drawn(n, start, count, max_segments, seed, spark), options, max_segments, seed)
    return rows.select("syn_id", F.col("path").alias("segments"), "target_count", (F.size("path") < F.col("target_count")).cast("int").alias("early_stop"), F.col("backoff").alias("backoff_steps"))
