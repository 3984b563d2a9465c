import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from wayfold.llm import _repeats, near_dedup, suffix_dedup
from wayfold.llm.near_dedup import near_duplicates
from wayfold.llm.substring_dedup import dedup_words, word_units
from wayfold.llm.suffix_dedup import dedup_bytes, dedup_texts

WORD = re.compile(r"[^ \t-\r]+")


def brute(rows, units, length):
    """Flags of removed units for each row; a window counts where it also starts in a smaller doc_id."""
    least = {}
    for d, u in rows:
        for i in range(len(u) - length + 1):
            key = tuple(u[i : i + length])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, u in rows:
        flags = [False] * len(u)
        for i in range(len(u) - length + 1):
            if least[tuple(u[i : i + length])] < d:
                flags[i : i + length] = [True] * length
        out.append((d, flags))
    return out


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 4, 256):
        parts = [rng.integers(0, alphabet, n) + 1 for n in (1, 30, 50, 7)]
        symbols = np.concatenate([np.r_[p, 0] for p in parts]).astype(np.int16)
        order = suffix_dedup.two_stage_order(symbols, 100)
        assert sorted(order.tolist()) == list(range(len(symbols)))
        real = [k for k in order.tolist() if symbols[k]]
        ends = lambda k: k + int(np.flatnonzero(symbols[k:] == 0)[0])
        keys = [symbols[k : ends(k)].tolist() for k in real]
        assert all(a <= b or a[: len(b)] == b for a, b in zip(keys, keys[1:], strict=False))


def test_bytes(docs, corpus, none):
    got = defaultdict(list)
    for r in dedup_bytes(docs, 50, ["count"]).collect():
        got[r.doc_id].append(r)
    rows = [(d, (t or "").encode()) for d, t in corpus]
    for (d, flags), (_, u) in zip(brute(rows, None, 50), rows, strict=True):
        kept = bytes(b for b, f in zip(u, flags, strict=True) if not f)
        spans = sum(f and (k == 0 or not flags[k - 1]) for k, f in enumerate(flags))
        assert any((bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == (kept, len(u), sum(flags), spans) for r in got[d])
    assert sum(map(len, got.values())) == len(corpus)
    assert dedup_bytes(none).count() == 0


def twice_within(make, units, sep):
    """Two documents that share 52 units, of which a gram stands twice within 43; other grams around make each its least one's place."""
    order = lambda u: int(units(np.frombuffer(sep.join(u).encode(), np.uint8), np.array([0, len(sep.join(u))]))[0][0]) >> 1
    least, next_ = sorted((make(8) for _ in range(20000)), key=order)[:2]
    core = make(10) + next_ + make(17) + next_ + make(9)
    return [(k, sep.join(make(30) + least + make(gap) + core + make(1) + least + make(30)).encode()) for k, gap in enumerate((4, 0))]


def test_a_gram_twice_in_a_window(spark):
    rng = random.Random(8)
    rows = twice_within(lambda n: [chr(rng.randrange(33, 127)) for _ in range(n)], suffix_dedup.byte_units, "")
    got = {r.doc_id: r.n_removed for r in dedup_bytes(spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string")).collect()}
    assert got == {d: sum(f) for d, f in brute(rows, None, 50)} == {0: 0, 1: 52}


def test_words_twice_in_a_window(spark):
    rng = random.Random(8)
    rows = [(d, t.decode()) for d, t in twice_within(lambda n: [f"w{rng.randrange(9999)}" for _ in range(n)], word_units, " ")]
    got = {r.doc_id: r.n_removed for r in dedup_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: sum(f) for d, f in brute([(d, t.split()) for d, t in rows], None, 50)} == {0: 0, 1: 52}


def hot_corpus():
    """Ids that share one passage of common grams in other surroundings, so that buckets are split by the second key."""
    rng = random.Random(12)
    common = [f"c{rng.randrange(6)}" for _ in range(90)]
    rows = []
    for k in range(150):
        a = rng.randrange(0, 30)
        rows.append((k, " ".join([f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 70))] + common[a : a + rng.randrange(20, 80)] + [f"w{rng.randrange(500)}" for _ in range(5)])))
    return rows


def test_hot_grams_and_the_number_of_partitions(spark):
    """The same rows however many buckets there are; what buckets send grows with what is removed, not with their number."""
    rows = hot_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {d: sum(f) for d, f in brute([(d, t.split()) for d, t in rows], None, 50)}
    want_bytes = {d: sum(f) for d, f in brute([(d, t.encode()) for d, t in rows], None, 50)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sent = []
    try:
        for n in (16, 256):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r.doc_id: r.n_removed for r in dedup_words(df).collect()} == want
            assert {r.doc_id: r.n_removed for r in dedup_bytes(df).collect()} == want_bytes
        for n in (16, 256, 1024):
            ids = np.repeat(np.arange(40), 5)
            sent.append(_repeats.run_rows(ids, np.zeros(200, np.int64), np.tile(np.arange(5) * 100, 40), np.full(200, 50), n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [t.num_rows for t in sent] == [200, 200, 200]


def test_common_grams_are_dealt_by_two(spark):
    """Windows of common grams alone are keyed by their least and greatest gram: equal windows get equal keys."""
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, 200, dtype=np.uint64)
    common = np.zeros(_repeats.CELLS, bool)
    common[(core >> np.uint64(46)).astype(np.int64)] = True
    seen = {}
    for shift in (0, 17, 60):
        grams = np.r_[rng.integers(0, 2**63, 30, dtype=np.uint64), core[shift:]]
        row, start, windows, place, key = _repeats.stretches(grams, np.array([0, len(grams) + 7]), common, 50, 8)
        for s, n, k in zip(start.tolist(), windows.tolist(), key.tolist(), strict=True):
            for w in range(s, s + n):
                if w >= 30:
                    assert seen.setdefault(w - 30 + shift, k) == k
    assert len(set(seen.values())) > 8


def test_carried_names_that_clash(spark, docs):
    """A carried column with the name of a made one gives way; one named like an inner column is returned."""
    df = spark.createDataFrame([(1, "a b", 5, 6, "x"), (None, None, 7, 8, None)], "doc_id int, text string, kept int, text_key int, bucket string")
    out = dedup_bytes(df, 50, ["kept", "text_key", "bucket", "text"])
    assert out.columns == ["doc_id", "text_key", "bucket", "kept", "n_bytes", "n_removed", "n_spans"]
    assert sorted(((r.doc_id, r.text_key, r.bucket, bytes(r.kept)) for r in out.collect()), key=repr) == [(1, 6, "x", b"a b"), (None, 8, None, b"")]


def test_one_very_long_text(spark):
    """A text of 300000 words beside short ones: nothing of it is cut short."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(300_000))
    tail = long[-900:]
    rows = [(1, long), (2, tail), (3, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(tail.split())
    assert got[1] == (300_000, 0) and got[2][0] == n and got[2][1] >= n - 1 and got[3] == (1, 0)


def test_bytes_against_sql(spark):
    import duckdb
    from wayfold.llm.oracles import OP9_SQL

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert {tuple(r) for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()} == set(c.execute(OP9_SQL).fetchall())


def test_texts_stay_text(docs):
    for r in dedup_texts(docs).collect():
        assert "�" not in r.text


def test_words(docs, corpus, none):
    got = defaultdict(list)
    for r in dedup_words(docs).collect():
        got[r.doc_id].append(r)
    rows = [(d, WORD.findall(t or "")) for d, t in corpus]
    for (d, flags), (_, u) in zip(brute(rows, None, 50), rows, strict=True):
        kept = " ".join(w for w, f in zip(u, flags, strict=True) if not f)
        assert any((r.kept, r.n_words, r.n_removed) == (kept, len(u), sum(flags)) for r in got[d])
    assert dedup_words(none).count() == 0


def test_other_texts_of_an_id_do_not_remove(spark):
    text = " ".join(f"u{k}" for k in range(60))
    rows = spark.createDataFrame([(1, text), (1, text + " more"), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in dedup_words(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]


def groups(corpus, size, percent):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = []
    for d, t in corpus:
        w = WORD.findall((t or "").translate(fold))
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (d, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], d)
    return {(d, len(s), least[find(k)]) for k, (d, s) in enumerate(sets)}


def near_corpus(n=60):
    """A hot group of near copies, some closer than others, and small groups."""
    import random

    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(n):
        own = list(base)
        for j in rng.sample(range(200), k % 14):
            own[j] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(own)))
    for k in range(n, n + 30):
        own = [f"g{k // 3}.{j}" for j in range(80)]
        own[k % 3 * 7] = "other"
        rows.append((k, " ".join(own)))
    return rows


def test_near(spark, docs, corpus, none):
    for rows, df in ((corpus, docs), (near_corpus(), spark.createDataFrame(near_corpus(), "doc_id long, text string"))):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
        assert got == groups(rows, 3, 85)
    assert near_duplicates(none).count() == 0
    r = near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c")], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.component_id, x.kept) for x in r} == {(None, None, True), (3, 3, True)}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    a, b = near_dedup.sketch(x), near_dedup.sketch(np.r_[x, y])
    assert (near_dedup.merge(a, near_dedup.sketch(y)) == b).all()
    j = near_dedup.estimate(a[None, :], b[None, :], np.array([900.0]), np.array([1000.0]))
    assert abs(j[0] - 0.9) < 0.08


def test_digest_matches(docs):
    from pyspark.sql import functions as F

    r = dedup_bytes(docs).select("kept", F.sha2("kept", 256).alias("x")).head()
    assert r.x == hashlib.sha256(bytes(r.kept)).hexdigest()
