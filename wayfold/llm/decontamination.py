"""Benchmark decontamination by template windows, in DataFrame expressions only.

Numbers, names and units of a text become typed placeholders. Windows of the
template that a benchmark item and a document share are found by a hash join.
Where the texts under shared windows differ, only slots can differ; each of the
item's slot values must then map to one of the document's along the whole
alignment, or the match is a coincidence of templates. A window with too few
words to tell one template from another is looked for as it stands; if it has
some words, its template counts where all templates of the item stand along one
alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: Tokens in a window, and how many of them must be words rather than slots for the template to stand for it.
WINDOW = 8
LITERALS = 5
#: Words in a window whose template counts together with all others of the item only.
FEW = 2
#: Of an item's windows, the share that must be found where all of them have other slots; one window is enough where some stand as they are.
SLOTTED_COVERAGE = 0.5
#: Benchmark windows that are sent to all tasks; more are joined by a shuffle.
SENT = 500_000
UNITS = "km cm mm m kg mg g l ml s ms h min hours hour minutes minute seconds second days day weeks week months month years year miles mile feet foot inches inch pounds pound dollars dollar euros euro cents percent degrees meters metres liters litres"
_END, _NUMBER, _NAME, _UNIT = "\x01", "\x02", "\x03", "\x04"


def _marked(text: Column) -> Column:
    """The text without punctuation, a mark behind each sentence's last word."""
    text = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03\x04", "    ")
    text = F.regexp_replace(text, r"[.!?:]+(?=\s|$)|(?=\n)", _END)
    return F.regexp_replace(text, r"[^\p{L}\p{N}\s\x01]+", "")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.translate(text, _END, "")), r"\s+", -1), lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """The words, lower case, without punctuation; a word of punctuation alone is none."""
    return _tokens(_marked(text))


def template_tokens(text: Column) -> Column:
    """The same with placeholders: a capitalised word inside a sentence is a name, a word that begins with a digit a number."""
    text = F.regexp_replace(_marked(text), r"(?<=[^\x01\s]\s)\p{Lu}\p{Ll}+(?=[\s\x01]|$)", _NAME)
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}\x03])\p{N}+", _NUMBER)
    text = F.regexp_replace(text, rf"(?<=\x02|\x02\s)(?:{UNITS.replace(' ', '|')})(?=[\s\x01]|$)", _UNIT)
    return _tokens(text)


def _windows(size: int, tokens: str) -> Column:
    """A hash of each window of `size` tokens, in order; those of raw and of template tokens differ."""
    last, seed = F.size(tokens) - size, -size if tokens == "raw" else size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(seed), *(F.get(tokens, i + k) for k in range(size)))))


def _benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, form, raw, size, place, slotted, few, hash: all windows; an item shorter than a window is one window.

    slotted: hash is that of the window's template, else of its raw tokens. A
    window with words enough has a slotted row, one with few words both rows.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", raw_tokens(F.col("text")).alias("raw"), template_tokens(F.col("text")).alias("tokens"))
    items = items.dropDuplicates(["item_id", "raw"])
    # an item that repeats an id with another text is an alternative form of it
    items = items.withColumn("size", F.least(F.lit(WINDOW), F.size("tokens"))).where("size > 0")
    by_size = F.coalesce(*(F.when(F.col("size") == n, F.arrays_zip(_windows(n, "tokens").alias("template"), _windows(n, "raw").alias("raw"))) for n in range(1, WINDOW + 1)))
    rows = items.select("item_id", "raw", "tokens", "size", F.posexplode(by_size).alias("place", "w"))
    words = F.size(F.filter(F.slice("tokens", F.col("place") + 1, F.col("size")), lambda t: ~t.rlike(r"[\x02\x03\x04]")))
    few = words < LITERALS
    kinds = F.when(~few, F.array(F.lit(True))).when(words >= FEW, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumns({"few": few, "slotted": F.explode(kinds)})
    return rows.select("item_id", F.xxhash64("raw").alias("form"), "raw", "size", "place", "slotted", "few", F.when(F.col("slotted"), F.col("w.template")).otherwise(F.col("w.raw")).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, slotted_coverage: float = SLOTTED_COVERAGE) -> DataFrame:
    """Documents that hold benchmark items, whole or in part, as they stand or with other numbers, names and units.

    docs has doc_id and text, benchmark item_id and text; other columns are not
    read. Returns a row for each pair: doc_id, item_id, n_windows (of the item's
    windows, those found), item_windows, coverage (their ratio), and
    reparameterised (the slots differ wherever the item was found). Null texts
    hold nothing; rows with a null id are left out; rows that repeat an id are
    taken together. Where no window stands as it is, slotted_coverage of the
    item's must be found. Windows with fewer than LITERALS words beside slots are
    found as they stand, or, with FEW words at least, by template where all of
    the item's templates are found along one alignment; an item without tokens
    is not looked for. A window or a value that stands several times is the same
    window or value.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    bench = S.staged(_benchmark_windows(benchmark), "benchmark-windows")
    total = bench.groupBy("item_id", "form").agg(F.count_distinct("place").alias("item_windows"), F.count_if("slotted").alias("templates"))
    kinds = sorted((r["size"], "tokens" if r["slotted"] else "raw") for r in bench.select("size", "slotted").distinct().collect())  # twice WINDOW at most
    keys = bench.select("hash", "item_id", "form", "place", "size", "slotted", "few", F.xxhash64(F.slice("raw", F.col("place") + 1, F.col("size"))).alias("exact"))
    if bench.count() <= SENT:
        keys = F.broadcast(keys)
    made = {"tokens": template_tokens, "raw": raw_tokens}
    tokens = docs.select("doc_id", *(made[k](F.col("text")).alias(k) for k in sorted({k for _, k in kinds})))
    hashes = F.flatten(F.array_compact(F.array(*(F.transform(_windows(n, k), lambda h, i: F.struct(h.alias("hash"), i.alias("at"))) for n, k in kinds)))) if kinds else F.array().cast("array<struct<hash:bigint,at:int>>")
    # the outer form: for the plain one Spark adds a filter that would compute the tokens again for each window
    rows = tokens.select("doc_id", hashes.alias("hashes")).select("doc_id", F.explode_outer("hashes").alias("w")).select("doc_id", "w.hash", "w.at")
    hits = S.staged(rows.join(keys, "hash").select("doc_id", "item_id", "form", "place", "size", "slotted", "few", "at", "exact"), "hits")
    # slots under the windows, for the documents and items that matched
    some = S.staged(hits.select("doc_id").distinct(), "hit-documents")
    texts = docs.join(some, "doc_id").select("doc_id", raw_tokens(F.col("text")).alias("raw_d"))
    forms = bench.select("item_id", "form", F.col("raw").alias("raw_b")).dropDuplicates(["item_id", "form"])
    both = hits.join(texts, "doc_id").join(forms, ["item_id", "form"])
    own = F.slice("raw_d", F.col("at") + 1, F.col("size"))
    theirs = F.slice("raw_b", F.col("place") + 1, F.col("size"))
    slots = F.filter(F.arrays_zip(own.alias("d"), theirs.alias("b")), lambda x: x["d"].isNotNull() & x["b"].isNotNull())
    both = both.select("doc_id", "item_id", "form", "place", "slotted", "few", (F.col("at") - F.col("place")).alias("shift"), (F.xxhash64(own) == F.col("exact")).alias("same"), slots.alias("slots"))
    aligned = ["doc_id", "item_id", "form", "shift"]
    # two of the item's values can have become one
    values = both.where("slotted").select(*aligned, "few", F.explode("slots").alias("s")).groupBy(*aligned, "s").agg(F.min("few").alias("few"))
    values = values.groupBy(*aligned, "s.b").agg(F.count("*").alias("n"), F.count_if(~F.col("few")).alias("n_sure"))
    fits = values.groupBy(*aligned).agg((F.max("n_sure") <= 1).alias("fits"), (F.max("n") <= 1).alias("all_fit"))
    whole = both.where("slotted").groupBy(*aligned).agg(F.count_distinct("place").alias("n_places")).join(total, ["item_id", "form"])
    fits = fits.join(whole.select(*aligned, (F.col("n_places") == F.col("templates")).alias("complete")), aligned)
    counts = F.col("slotted") & F.when(F.col("few"), F.col("all_fit") & F.col("complete")).otherwise(F.col("fits"))
    good = both.join(fits, aligned, "left").where(F.col("same") | F.coalesce(counts, F.lit(False)))
    found = good.groupBy("doc_id", "item_id", "form").agg(F.count_distinct("place").alias("n_windows"), (~F.bool_or("same")).alias("reparameterised"))
    found = found.join(total, ["item_id", "form"]).where(~F.col("reparameterised") | (F.col("n_windows") >= F.lit(slotted_coverage) * F.col("item_windows")))
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "item_windows", "reparameterised"), F.struct("n_windows", ~F.col("reparameterised"), "form")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_windows", "x.item_windows", F.round(F.col("x.n_windows") / F.col("x.item_windows"), 6).alias("coverage"), "x.reparameterised")


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which contaminated() finds no benchmark item."""
    found = S.staged(contaminated(docs, benchmark).select(F.struct("doc_id").alias("key")).distinct(), "contaminated")
    name = "_found" + "_" * max(map(len, docs.columns))  # no column of docs is as long
    return docs.join(found.select(F.col("key.doc_id").alias(name)), F.col("doc_id") == F.col(name), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
