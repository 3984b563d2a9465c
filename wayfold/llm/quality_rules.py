"""Quality rules whose cutoffs carry a guarantee: of the good documents of a stratum,
no more than a stated share is rejected, with a stated confidence over all tests.

Labelled documents are the holdout, in two halves by a hash of doc_id. The
design half names for each stratum and rule the cutoff that best divides bad
from good documents, and ranks the rules by that gain. The certifying half,
which has had no say in this, then tests the best rule, the best two, and so on
(a fixed sequence, so its length costs no correction): a set of rules is
certified while the exact binomial probability of so few good documents
rejected by any of them, were the true share at the limit, is at most delta over
the number of strata. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as S

#: Rules: a score in thousandths, above whose cutoff a document is rejected, and the grid, strictest first.
GRID = (20, 50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1500, 2000)
RULES = ("symbols", "shouts", "capitals", "dup_lines", "repeats")
#: Of a stratum's good documents at most this share is rejected by the certified rules together.
ALPHA = 0.05
#: Chance that any certified cutoff breaks its limit.
DELTA = 0.05
#: Strata whose cutoffs are sent to all tasks; beyond, the cutoffs are joined by a shuffle with split hot keys.
STRATA_SENT = 10_000
SALT = 32


def base_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed and `scores`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(S.WORD))
    out = docs.withColumn("_words", words).withColumn("_lines", lines)
    n = F.size("_words")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    out = out.withColumn("_grams", F.coalesce(hashes, F.array().cast("array<bigint>")))
    # windows in the order of their hashes, where some hash stands more than once; then where equal neighbours start
    ordered = F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("_ordered", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), ordered))
    same = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
    again = F.filter("_ordered", lambda s, k: same(s, F.when(k > 0, F.get("_ordered", k - 1))) | same(s, F.get("_ordered", k + 1)))
    out = out.withColumn("_again", F.sort_array(F.transform(again, lambda s: s["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate("_again", zero, lambda a, i: F.struct((i + 3).alias("end"), (a["total"] + i + 3 - F.greatest(i, a["end"])).alias("total")), lambda a: a["total"])
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]", ""))
    shouts = F.char_length(F.regexp_replace(text, "[^!]", ""))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_upper": upper.cast("long"),
            "_shouts": shouts.cast("long"),
        }
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 1000, F.col(b)).cast("long"), F.lit(0))
    scores = F.array(part("n_symbols", "n_words"), part("_shouts", "n_words"), part("_upper", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "scores": scores})
    return out.drop("_words", "_lines", "_grams", "_ordered", "_again", "_upper", "_shouts")


def _lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series, eight places up."""
    z = x + 8
    down = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p); 1 where k is not below the mean, for which no test passes.

    Summed from k downwards. Terms beyond 20 standard deviations are below 1e-80 of the first.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(20 * F.sqrt(n * p)) + 50).cast("int")
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a, j):
        i = k - j + 1
        t = a["t"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.when(steps >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), zero, add, lambda a: a["s"])).otherwise(1.0)
    return F.when(k < n * p, top * total).otherwise(1.0)


def _truth(labels: DataFrame) -> DataFrame:
    """doc_id, quality and whether the document designs cutoffs; it is good only if all its labels call it so."""
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return truth.withColumn("designs", F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "8")


def designed_cutoffs(rows: DataFrame, alpha: float) -> DataFrame:
    """stratum, cutoffs, ranks: a cutoff and the rank of its gain, or nulls, for each rule, from the design half."""
    bins = F.transform("scores", lambda x: F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: c < x)))
    rows = rows.where("designs").select("stratum", "quality", F.posexplode(bins).alias("rule", "bin"))
    counts = rows.groupBy("stratum", "rule", "bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    by_rule = F.collect_list(F.struct("bin", "good", "bad"))
    grouped = counts.groupBy("stratum", "rule").agg(by_rule.alias("seen"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))  # a bin or less for each cutoff
    tests = grouped.select("stratum", "rule", "n_good", "n_bad", "seen", F.posexplode(F.array(*map(F.lit, GRID))).alias("at", "cutoff"))
    over = lambda name: F.aggregate(F.filter("seen", lambda s: s["bin"] > F.col("at")), F.lit(0).cast("long"), lambda a, s: a + s[name])
    tests = tests.withColumns({"false": over("good"), "right": over("bad")})
    gain = F.coalesce(F.try_divide(F.col("right"), F.col("n_bad")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("false"), F.col("n_good")), F.lit(0.0))
    useful = tests.withColumn("gain", F.round(gain, 9)).where((F.col("gain") > 0) & (F.col("false") * len(RULES) <= F.lit(alpha) * F.col("n_good")))
    best = useful.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("x"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("x.gain"), "rule")))
    made = ranked.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct(F.col("x.cutoff").alias("cutoff"), "rank")))).alias("by_rule"))  # an entry or less for each rule
    return made.select("stratum", *(F.array(*(F.col("by_rule")[k][c] for k in range(len(RULES)))).alias(f"{c}s") for c in ("cutoff", "rank")))


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs: for each stratum with certified rules an array with a cutoff, or null, for each rule.

    A document with several labels is good only if all call it so; labels without a quality are not used.
    """
    rows = S.staged(features.select("doc_id", "stratum", "scores").join(_truth(labels), "doc_id").select("stratum", "scores", "quality", "designs"), "quality-holdout")
    designed = S.staged(designed_cutoffs(rows, alpha), "quality-designed")
    held = _with_strata(rows.where("not designs"), designed)
    over = F.filter(F.arrays_zip("scores", "cutoffs", "ranks"), lambda x: F.coalesce(x["scores"] > x["cutoffs"], F.lit(False)))
    first = F.array_min(F.transform(over, lambda x: x["ranks"]))  # the smallest set of rules that rejects the document
    good = F.col("quality") == 1
    counts = held.groupBy("stratum").agg(F.count_if(good).alias("n_good"), *(F.count_if(good & (first <= k)).alias(f"false_{k}") for k in range(1, len(RULES) + 1)))
    strata = features.sparkSession.range(1).join(counts.agg(F.count("*").alias("m")), how="left").select("m")
    tests = counts.join(F.broadcast(strata))  # one row
    passes = [binomial_tail(F.col("n_good"), F.col(f"false_{k}"), alpha) <= F.lit(delta) / F.col("m") for k in range(1, len(RULES) + 1)]
    reach = F.lit(0)
    for k in range(len(RULES), 0, -1):
        reach = F.when(passes[k - 1], reach + 1).otherwise(0) if k < len(RULES) else F.when(passes[k - 1], 1).otherwise(0)
    out = tests.select("stratum", reach.alias("reach")).where("reach > 0").join(designed, "stratum")
    kept = F.transform(F.arrays_zip("cutoffs", "ranks"), lambda x: F.when(x["ranks"] <= F.col("reach"), x["cutoffs"]))
    return out.select("stratum", kept.alias("cutoffs")).where(F.exists("cutoffs", lambda c: c.isNotNull()))


def _with_strata(rows: DataFrame, by_stratum: DataFrame) -> DataFrame:
    """rows joined to what belongs to their stratum, if anything; a stratum may hold a third of all rows."""
    if by_stratum.limit(STRATA_SENT + 1).count() <= STRATA_SENT:
        return rows.join(F.broadcast(by_stratum), "stratum", "left")
    salted = by_stratum.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("scores"), F.lit(SALT)).cast("int")).join(salted, ["stratum", "salt"], "left").drop("salt")


def apply_cutoffs(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """features with the column kept: false where base_failed or a score is over its stratum's cutoff."""
    rows = _with_strata(features, cutoffs)
    over = F.exists(F.arrays_zip("scores", "cutoffs"), lambda x: F.coalesce(x["scores"] > x["cutoffs"], F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).drop("cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", carry: list[str] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Judge documents by rules with risk-controlled cutoffs.

    docs has doc_id, text and the stratum's column; labels has doc_id and
    quality (1 is good). Returns doc_id, the columns named in `carry`, the
    counts, base_failed and kept; a column of docs that is not named in `carry`
    is not read. A null text is empty and fails the base; a null stratum is one
    of its own; a stratum with too few labels for any certified cutoff keeps
    what passes the base. Rows that share a doc_id are judged each for itself
    and all count where that id is labelled. Empty tables give empty results.
    """
    carry = [c for c in carry or [] if c != "doc_id"]
    rows = docs.select(F.col("doc_id"), *[F.col(c).alias(f"_carry_{k}") for k, c in enumerate(carry)], "text", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"))
    features = S.staged(base_features(rows).drop("text"), "quality-features")
    out = apply_cutoffs(features, certified_cutoffs(features, labels, alpha, delta))
    back = [F.col(f"_carry_{k}").alias(c) for k, c in enumerate(carry)]
    return out.select("doc_id", *back, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that quality_rules() keeps, as they are, with all their columns.

    Texts are counted once; the rows are then picked by doc_id, text and stratum.
    """
    key = {"_id": F.col("doc_id"), "_text": F.xxhash64("text"), "_stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))}
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in key.items()))
    counted = base_features(docs.select("doc_id", "text", *(c.alias(k) for k, c in key.items()), key["_stratum"].alias("stratum")))
    features = S.staged(counted.select(*key, "doc_id", "stratum", "scores", "base_failed"), "quality-features")
    good = apply_cutoffs(features, certified_cutoffs(features, labels, alpha, delta)).where("kept").select(*key).distinct()
    good = S.staged(good, "quality-kept").toDF("_id2", "_text2", "_stratum2")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")) & (F.col("_stratum") == F.col("_stratum2"))
    return rows.join(good, same, "left_semi").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_GRID_SQL = ", ".join(map(str, GRID))

OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0)) AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT rid, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts
  FROM w LEFT JOIN r ON w.rid = r.rid),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, unnest([0, 1, 2, 3, 4]) AS rule,
    unnest([coalesce(1000 * n_symbols // nullif(n_words, 0), 0), coalesce(1000 * shouts // nullif(n_words, 0), 0), coalesce(1000 * upper_ // nullif(word_chars, 0), 0),
      coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0), coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)]) AS score FROM f),
l AS (SELECT doc_id, min(quality) AS quality, left(md5(CAST(doc_id AS VARCHAR)), 1) < '8' AS designs FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
t AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality <> 1) AS n_bad,
    count(*) FILTER (quality = 1 AND score > cutoff) AS k, count(*) FILTER (quality <> 1 AND score > cutoff) AS hit
  FROM s JOIN l USING (doc_id), (SELECT unnest([{_GRID_SQL}]) AS cutoff) WHERE designs GROUP BY ALL),
c AS (SELECT *, round(coalesce(hit / nullif(n_bad, 0), 0) - coalesce(k / nullif(n_good, 0), 0), 9) AS gain FROM t WHERE {len(RULES)} * k <= {ALPHA} * n_good),
g2 AS (SELECT stratum, rule, arg_max(cutoff, (gain, cutoff)) AS cutoff, max(gain) AS gain FROM c WHERE gain > 0 GROUP BY ALL),
q AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS rank FROM g2),
v AS (SELECT rid, stratum, any_value(quality) AS quality, min(CASE WHEN score > cutoff THEN rank END) AS first_ FROM s JOIN l USING (doc_id) LEFT JOIN q USING (stratum, rule) WHERE NOT designs GROUP BY rid, stratum),
z AS (SELECT stratum, step, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND first_ <= step) AS k FROM v, (SELECT unnest(range(1, {len(RULES) + 1})) AS step) GROUP BY ALL),
p AS (
  SELECT *, CASE WHEN k < n_good * {ALPHA} THEN list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0) + i * ln({ALPHA}) + (n_good - i) * ln(1 - {ALPHA})))) ELSE 1 END
    <= {DELTA} / (SELECT count(DISTINCT stratum) FROM z) AS passes FROM z),
e AS (SELECT stratum, step, bool_and(passes) OVER (PARTITION BY stratum ORDER BY step) AS certified FROM p),
b AS (SELECT stratum, rule, cutoff FROM q JOIN e USING (stratum) WHERE certified AND step = rank)
SELECT any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines,
  any_value(n_repeat_words) AS n_repeat_words, bool_or(base_failed) AS base_failed, NOT bool_or(base_failed) AND NOT bool_or(coalesce(score > cutoff, false)) AS kept
FROM s LEFT JOIN b USING (stratum, rule) GROUP BY rid
"""
