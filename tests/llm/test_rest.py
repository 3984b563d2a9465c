import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from wayfold.llm import license_scan as L
from wayfold.llm import packing, quality_rules, token_counts
from wayfold.llm.decontamination import clean_of, contaminated
from wayfold.llm import html_extraction as H
from wayfold.llm.html_extraction import extract_text
from wayfold.llm.lm_scoring import bits_per_byte, lm_scores

WORD = re.compile(r"[^ \t-\r]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def test_quality_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = {tuple(r) for r in quality_rules.op1_quality_rules(spark, sf).collect()}
    assert got == set(c.execute(quality_rules.OP1_SQL).fetchall())


def test_quality_cutoffs(spark, docs, none):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(2500):
        bad = k % 10 == 0
        text = " ".join(f"w{rng.randrange(9999)}" + ("###" if bad else "") for _ in range(60))
        texts.append((k, text, "en"))
        labels.append((k, 0 if bad else 1))
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.quality_rules(table, marks).collect()}
    assert all(r.kept == (d % 10 != 0) for d, r in out.items())
    few = quality_rules.quality_rules(docs, marks.limit(0), carry=["count"]).collect()
    assert len(few) == docs.count() and all(r.kept != r.base_failed for r in few)
    assert quality_rules.quality_rules(none, marks).count() == 0
    assert quality_rules.keep_good(docs, marks).columns == docs.columns


def test_small_strata_get_cutoffs(spark):
    """Some 150 good labels in each of three strata are enough; a set of rules that rejects good documents is not certified."""
    rng = random.Random(5)
    rows = []
    for k in range(1050):
        bad = k % 7 == 0
        scores = [0, 0, 0, 0, rng.randrange(300, 900) if bad else rng.randrange(0, 60)]
        rows.append((k, "xyz"[k % 3], scores, int(not bad)))
    table = spark.createDataFrame(rows, "doc_id long, stratum string, scores array<long>, quality int")
    got = {r.stratum: r.cutoffs for r in quality_rules.certified_cutoffs(table, table.select("doc_id", "quality")).collect()}
    assert set(got) == set("xyz") and all(c[:4] == [None] * 4 and 50 <= c[4] <= 400 for c in got.values())
    mixed = table.withColumn("quality", (table.doc_id * 7919 % 11 > 3).cast("int"))
    assert quality_rules.certified_cutoffs(table, mixed.select("doc_id", "quality")).count() == 0


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    rows = [(n, k) for n in (1, 20, 300, 5000) for k in (0, 1, 2, 5, 30) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r.p == 1.0 if r.k >= r.n * 0.01 else abs(r.p - want) < 1e-9


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, corpus, none, rule):
    enc, _ = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    total = Counter()
    for r in token_counts.count_tokens(docs, rule=rule).collect():
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for d, t in corpus:
        want[d] += len(enc.encode_ordinary(t or ""))
    assert all(abs(total[d] - n) < 1e-6 for d, n in want.items())
    assert token_counts.count_tokens(none).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, rule="last")


def test_boundary_rules():
    ends, lines = np.array([3, 9, 12]), np.array([5, 12])  # the second token has 2 characters in the first line, 4 in the other
    assert token_counts.attribute(ends, lines, "first").tolist() == [2, 1]
    assert token_counts.attribute(ends, lines, "most").tolist() == [1, 2]
    assert np.allclose(token_counts.attribute(ends, lines, "share"), [1 + 1 / 3, 1 + 2 / 3])


def test_packing(spark, none):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["Straße,", "don't", "été.", "x1y2!!", "WORD", "a" * 30, "ΑΣ", "'s,", "¡hola!", "€,", "1,000"]) for _ in range(rng.choice([0, 3, 40, 900, 2500])))) for k in range(80)] + [(80, None), (81, "a <|endoftext|> b <|ENDOFTEXT|>,"), (80, "twice")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            want[d, k, 2048 * k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_plan_places_each_piece_once():
    rng = random.Random(2)
    counts = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(40)}
    used = Counter()
    for length, rank, pieces, per, sequence, offset in packing.plan(counts, 64):
        for k in range(pieces):
            for x in range(length):
                used[sequence + k // per, offset + k % per * length + x] += 1
    assert set(used.values()) == {1} and sum(used.values()) == sum(k * n for k, n in counts.items())
    assert max(x for _, x in used) < 64


def test_licenses(spark, docs, none):
    rows = [
        (1, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nmore"),
        (2, "Under the GNU  General-Public License; cc-by cc by 4, mit\nlicense"),
        (3, "SPDX-License-Identifier: MIT AND OR"),
        (4, None),
        (5, "SPDX-License-Identifier: )"),
        (6, "admit license"),
    ]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "permissive,spdx-apache-2.0-with-llvm-exception,spdx-gpl-2.0-only,spdx-mit" and got[1].score == 1.0
    assert (got[2].n_base, got[2].base_labels, got[2].first_word, got[2].last_word) == (4, "cc-by,gpl,mit", 2, 11)
    assert (got[3].labels, got[3].score) == ("spdx-malformed", 0.0)
    assert (got[4].n_words, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0)
    assert got[5].labels == "spdx-malformed" and got[6].n_base == 0
    assert L.scan_licenses(docs).count() == docs.count() and L.scan_licenses(none).count() == 0


def test_tag_lines(spark):
    """The whole line is the expression: stray operators, parentheses, prose and unknown names are malformed."""
    lines = {
        "MIT": "permissive,spdx-mit",
        "MIT */": "permissive,spdx-mit",
        "GPL-2.0-or-later WITH Classpath-exception-2.0 -->": "restricted,spdx-gpl-2.0-or-later-with-classpath-exception-2.0",
        "(LicenseRef-Own AND MIT)": "restricted,spdx-licenseref-own,spdx-mit",
        "LGPL-2.1+ OR ISC.": "permissive,spdx-isc,spdx-lgpl-2.1+",
        "MIT AND OR": "spdx-malformed",
        "MIT)": "spdx-malformed",
        "MIT and others may apply": "spdx-malformed",
        "the tag": "spdx-malformed",
        "others": "spdx-malformed",
        "MIT WITH Apache-2.0": "spdx-malformed",
        "Classpath-exception-2.0": "spdx-malformed",
        "MIT, ISC": "spdx-malformed",
        "": "spdx-malformed",
    }
    rows = [(k, f"// SPDX-License-Identifier: {x}\nmore text", k) for k, x in enumerate(lines)]
    got = {r.doc_id: r.labels for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()}
    assert [got[k] for k in range(len(lines))] == list(lines.values())


def test_license_places_by_brute_force(spark, corpus):
    rng = random.Random(6)
    parts = ["GNU", "general", "Public", "license", "apache", "CC", "by", "MIT", "-", ".", "x", "cc by", "é", "gnu general public license", "\n", "License"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for k in range(300)] + corpus + [(9000, "MIT license " * 40000)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def brute(text):
        words = word.findall((text or "").translate(FOLD))
        found = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
        places = [i for i, _ in found]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))

    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((d, *brute(t)) for d, t in rows)


def test_expressions():
    assert L.parse_expression("A OR B AND C".split()) == ["a", "b", "c", "and", "or"]
    assert L.parse_expression(["(", "A", "OR", "B", ")", "AND", "C"]) == ["a", "b", "or", "c", "and"]
    for bad in (["AND"], ["A", "B"], ["(", "A"], ["A", ")"], ["A", "OR"], []):
        assert L.parse_expression(bad) is None
    assert L.evaluate(L.parse_expression("MIT OR GPL-3.0-only".split()))[0] is True
    assert L.evaluate(L.parse_expression("MIT AND GPL-3.0-only".split()))[0] is False


def main_texts(spark, htmls, url="http://h/"):
    rows = spark.createDataFrame([(k, url, h) for k, h in enumerate(htmls)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in extract_text(rows).orderBy("page_id").collect()]


def test_html(spark):
    page = '<body><header>Site</header><div class="menu"><a href=x>Home</a></div><div id="content"><h1>T &amp; m</h1><p>One  two<br>three</p><form>Mail</form></div><aside>s</aside><div id="cookie-notice">We</div><section id="comments"><p>Nice</p></section><footer>f</footer>'
    rows = [(1, "http://a/1", page), (2, None, None), (3, "http://b", "<article><p>x &lt; y</p><script>if (a<b) {}</script><div class=ad>buy</div></article>"), (3, "http://b", "<p>plain")]
    got = [(r.page_id, r.text, r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "T & m\n\nOne two three", 20), (2, "", 0), (3, "plain", 5), (3, "x < y", 5)]
    group = [f"<body><div><a href=/>Home</a> about us</div><div><h1>T{i}</h1><p>text {i} goes on here</p></div><div>Copyright us</div>" for i in range(4)]
    assert main_texts(spark, group) == [f"T{i}\n\ntext {i} goes on here" for i in range(4)]


def test_html_template_of_marked_pages(spark):
    """What is the same on all pages goes from inside the article; a page without the mark has its text where the others have it."""
    page = "<body><div class=top>Site {i}</div><{t}><div class=box>Buy our things</div><div class=body><p>text {i} goes on</p></div></{t}><div class=end>us {i}</div>"
    group = [page.format(i=i, t="article") for i in range(4)]
    assert main_texts(spark, group) == [f"text {i} goes on" for i in range(4)]
    assert main_texts(spark, [group[0]] * 4) == ["Buy our things\n\ntext 0 goes on"] * 4
    group[3] = page.format(i=3, t="p")
    assert main_texts(spark, group)[3] == "text 3 goes on"


def test_html_without_marks_keeps_text(spark):
    """Short slots and paragraphs of links stay; a class word makes no aside of what holds the page's text."""
    page = '<body class=x><div class=menu><a href=/>Home {i}</a></div><div class="has-sidebar"><div class=a>{long}</div><div class=b>by {i}</div><div class=c>So <a href=/>says the whole of source {i}</a></div></div>'
    group = [page.format(i=i, long=f"text {i} " * 40) for i in range(4)]
    assert main_texts(spark, group) == [("text %d " % i * 40).strip() + f"\n\nby {i}\n\nSo says the whole of source {i}" for i in range(4)]
    assert main_texts(spark, ['<div id="content" class="no-sidebar"><p>One two</p><p><a href=/>three</a></p></div>']) == ["One two\n\nthree"]


def test_html_odd_markup(spark):
    """A form around the page, class words that only look like asides, elements left open, a quote that is not closed."""
    cases = {
        '<form id="aspnetForm"><div id="content"><p>One</p><p>Two</p></div><div>x</div></form>': "One\n\nTwo",
        '<article><p>a</p><div class="share-of-market"><p>c</p></div></article>': "a\n\nc",
        "<article><p>a</p><svg><path/><p>b</p></article>": "a\n\nb",
        "<article><title>t<p>b</p><textarea>c</article>": "t\n\nb\n\nc",
        '<article><p title="x>two</p><p>three</p></article>': "two\n\nthree",
        "<article><p>a</p><div class='ad-slot-3'>buy</div><form>mail</form><svg><text>s</text></svg></article>": "a",
        "<p>a &lt; b &amp; c</p>\n<p>  d\t e </p>": "a < b & c\n\nd e",
    }
    got = [r.text for k, h in enumerate(cases) for r in extract_text(spark.createDataFrame([(k, f"http://h{k}/", h)], "page_id long, url string, html string")).collect()]
    assert got == list(cases.values())


def test_html_template_decides_pages_without_marks(spark):
    """Without the template the same pages give other texts: what is the same on all of them comes along."""
    group = [f"<div><div>Our shop {'of ropes'}</div><div>story {i} is told here</div><div>Call us</div></div>" for i in range(5)]
    assert main_texts(spark, group) == [f"story {i} is told here" for i in range(5)]
    assert [H.main_text(h, set(), set(), set()) for h in group] == [f"Our shop of ropes\n\nstory {i} is told here\n\nCall us" for i in range(5)]


def test_html_hosts_without_a_name_are_alone(spark):
    """Null urls share no template; nor do urls without a host; repeated rows are one page; other columns do no harm."""
    group = [f"<div>Our shop</div><div>story {i} is told here</div>" for i in range(4)]
    rows = [(k, u, h, "x", k) for u in (None, "story", "http://a.b/c") for k, h in enumerate(group)]
    got = Counter((r.url, r.text.count("Our shop")) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, fixed long")).collect())
    assert got == {(None, 1): 4, ("story", 1): 4, ("http://a.b/c", 0): 4}
    assert extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, fixed long").limit(0)).count() == 0
    long = "<article>" + "".join(f"<p>word{k} and more</p>" for k in range(60_000)) + "</article>"
    assert main_texts(spark, [long])[0].count("\n\n") == 59_999


def test_html_classes_by_brute_force(spark):
    """Templates of random small sites equal those of a builder that holds each token's whole occurrence vector."""
    rng = random.Random(4)
    sites = {}
    for host in range(6):
        fixed = [f"line {host}.{k}" for k in range(4)]
        for page in range(rng.choice([1, 2, 3, 9])):
            parts = [f"<div class=c{k % 2}>" + rng.choice([fixed[k], fixed[k], f"own {page}.{k}", ""]) + "</div>" for k in range(4) if rng.random() < 0.9]
            sites.setdefault(host, []).append("<main>".join(parts) if rng.random() < 0.5 else "".join(parts))
    want = {}
    for host, htmls in sites.items():
        at = defaultdict(list)  # token: the pages it stands on, with its numbers there
        for k, h in enumerate(htmls):
            for token, n in H.page_tokens(h).items():
                at[token].append((k, *n))
        vector = {t: {k for k, *_ in v} for t, v in at.items()}
        own = {(p, t) for p, t in at if t and len(vector[p, t]) >= 3 and len({htmls[k] for k in vector[p, t]}) > 1 and vector[p, t] == vector[p, 0]}
        left = {p: [sum(x[j] for x in at[p, 0]) - sum(x[j] for q, t in own if q == p for x in at[q, t]) for j in (1, 2)] for p, t in at if not t and len(vector[p, 0]) >= 2}
        want[host] = ({t for _, t in own}, {p for p, n in left.items() if n[1] > 0}, {p for p, n in left.items() if n[0] > 0})
    rows = spark.createDataFrame([(host, h) for host, hs in sites.items() for h in hs], "host long, html string").repartition(5)
    got = {r.host: (set(r.fixed), set(r.main), set(r.free)) for r in H.templates(rows).collect()}
    assert got == {h: x for h, x in want.items() if any(x)} and any(x[0] for x in want.values())


def test_html_templates_by_shuffle(spark, monkeypatch):
    """Templates too large to send are joined by a shuffle, with the same texts."""
    group = [f"<div>Our shop</div><div>story {i} is told here</div>" for i in range(6)]
    want = main_texts(spark, group)
    monkeypatch.setattr(H, "SENT", 0)
    assert main_texts(spark, group) == want


def test_decontamination(spark, docs, none):
    item = "In 1990 the merchant sold 5 km of rope to old Peter and then 5 more went away."
    rows = [(1, "x foo " + item), (2, "ok " + item.replace("5", "7").replace("Peter", "James")), (3, "ok " + item.replace("5 km", "7 km").replace("Peter", "James").replace("then 5", "then 9")), (4, None), (None, item), (6, "nothing of the kind stands here at all, be sure of it"), (1, item)]
    bench = spark.createDataFrame([(9, item), (9, item), (8, "too short"), (None, item)], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in contaminated(table, bench).collect()}
    assert {(1, 9, False), (2, 9, True)} <= got and not {d for d, _, _ in got} & {4, 6}
    assert sorted(str(r.doc_id) for r in clean_of(table, bench).collect() if r.doc_id not in (3,)) == ["4", "6", "None"]
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_slots_and_short_items(spark):
    """Items of numbers and names, and short ones, as they stand; values that two slots share in the copy."""
    items = [(1, "Compute 12 + 7 - 3 * 4"), (2, "Zoe met"), (3, "11 12 13 14 15 16 17 18 19 20"), (4, "the old merchant sold 3 ropes and then 4 more ropes went away"), (5, " .!"), (6, "the young sailor sold 3 boats and then 3 more boats went away")]
    docs = [(1, "so: Compute 12 + 7 - 3 * 4, please"), (2, "compute 12 7 3 5"), (3, "When zoe met him"), (4, "10 11 12 13 14 15 16 17 18 99"), (5, "ok the old merchant sold 5 ropes and then 5 more ropes went away"), (6, "ok the young sailor sold 5 boats and then 6 more boats went away")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.reparameterised) for r in got}
    assert {k: found.get(k) for k in ((1, 1), (3, 2), (4, 3))} == {(1, 1): (1, 1, False), (3, 2): (1, 1, False), (4, 3): (1, 3, False)}
    assert found[5, 4] == (6, 6, True) and not {d for d, _ in found} & {2} and (4, 1) not in found
    assert found.get((6, 6), (0,))[0] < 6


def brute_windows(docs, items):
    """(doc, item) pairs that share a window of 8 words as it stands; texts here have words only."""
    own = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)} if len(w) >= 8 else {tuple(w)} if w else set()
    sets = [(i, grams(own(t)), min(8, len(own(t)))) for i, t in items if i is not None and t is not None]
    out = {}
    for d, t in docs:
        w = own(t)
        for i, g, n in sets:
            hit = g & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if d is not None and hit:
                out[d, i] = max(out.get((d, i), 0), len(hit))
    return out


def test_decontamination_by_brute_force(spark):
    """Verbatim passages of every length, a very long document, null and empty items, items that share an id."""
    rng = random.Random(11)
    make = lambda n: [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([1, 4, 7, 8, 9, 30])))) for k in range(25)] + [(50, None), (51, ""), (None, "a b c")]
    docs = []
    for k in range(120):
        w = make(rng.randrange(0, 60))
        if k % 2:
            t = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a : a + rng.randrange(1, 20)]
        docs.append((k, " ".join(w)))
    docs += [(500, " ".join(make(60000) + items[3][1].split() + make(60000))), (501, None), (502, "")]
    table = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_windows(docs, items)
    assert clean_of(table.withColumnRenamed("item_id", "_found"), spark.createDataFrame(items, "item_id long, text string")).count() == len(docs) - len({d for d, _ in got})


def test_reparameterised_arithmetic(spark):
    """Few words and many slots: the template counts where all of the item is there, with one value for each of its values."""
    item = "Compute 12 + 15 * 3 - 7 / 2 now please"
    rows = [(1, "ok: Compute 4 + 25 * 9 - 8 / 6 now please"), (2, "Compute 4 + 25 now please"), (3, "x " + item), (4, "compute 1 2 3 4 5 later please")]
    got = {r.doc_id: (r.item_id, r.reparameterised, r.coverage) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (1, True, 1.0), 3: (1, False, 1.0)}
    twice = [(1, "Add 5 and 5 and 6 to 7 or 8")]
    rows = [(1, "Add 1 and 1 and 2 to 3 or 4"), (2, "Add 1 and 9 and 2 to 3 or 4")]
    got = [r.doc_id for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(twice, "item_id long, text string")).collect()]
    assert got == [1]


def test_slotted_coverage(spark):
    """Other slots throughout need a stated share of the item; the parameter says which."""
    item = "the old man has 3 ropes in his boat and then one more of them went away to sea with 4 sailors of the king"
    half = spark.createDataFrame([(1, "we say the old man has 9 ropes in his boat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert contaminated(half, bench).count() == 0
    assert [r.reparameterised for r in contaminated(half, bench, 0.05).collect()] == [True]


def test_scores(docs, corpus, none):
    got = defaultdict(list)
    out = lm_scores(docs)
    for r in out.collect():
        got[r.doc_id].append(r)
    tokens = [(d, WORD.findall((t or "").translate(FOLD)) + ["\0"]) for d, t in corpus]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, x in tokens if not held(d) for w in x)
    n, v = sum(c.values()), len(c)
    for d, x in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(x), sum(c[w] > 0 for w in x), n) and abs(r.base_score - base) < 1e-6 and r.score < 0 for r in got[d])
    assert lm_scores(none).count() == 0
    assert bits_per_byte(out, docs).count() == 2


def test_every_training_document_teaches_the_mixer(spark, monkeypatch):
    """The weights have been taught each decision of each training document, however many there are."""
    from wayfold.llm import lm_scoring

    taught = []
    average = lm_scoring.Mixer.average
    monkeypatch.setattr(lm_scoring.Mixer, "average", lambda self, sums: (taught.append(sums), average(self, sums))[1])
    rows = [(k, f"a{k % 7} b c", "en") for k in range(8000)]
    lm_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).count()
    training = sum(zlib.crc32(str(k).encode()) % 5 != 1 for k in range(8000))
    classes = taught[0]["taught/weights/word"][: 64 * lm_scoring._GATES].reshape(64, -1).sum(1)
    assert classes.max() == 4 * training  # every token passes the root of the class code


def captured_model(monkeypatch, L, docs):
    """The mixer and the coded blocks of a scoring run."""
    seen = {}
    score, staged = L._score, L.S.staged
    monkeypatch.setattr(L, "_score", lambda model, code, floor: (seen.update(mixer=model.value, code=code), score(model, code, floor))[1])
    monkeypatch.setattr(L.S, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
    seen["out"] = L.lm_scores(docs).collect()
    seen["blocks"] = [L.Block(bytes(r.payload), seen["code"]) for r in seen["lm-coded"].collect()]
    return seen


def test_chances_of_all_tokens_add_up(spark, monkeypatch):
    """Over all words, the end and unknown words, the chances of a first token make 1, less what bits asked of all words give to places without one; a scalar mixer gives the same chances."""
    from wayfold.llm import lm_scoring as L

    rng = random.Random(7)
    ids = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 5 != 1]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = [(ids[k], " ".join([f"v{k % 90}"] + [f"v{int(rng.paretovariate(1)) % 90}" for _ in range(8)]), "en") for k in range(300)] + [(ids[300], "", "en"), (held[0], "unheard of", "en"), (held[1], "", "en")]
    got = captured_model(monkeypatch, L, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    chance = {}
    for block in got["blocks"]:
        tokens, _ = L.token_scores(got["mixer"], block)
        for k in block.at[:-1]:
            chance["unknown" if block.cls[k] == L.UNKNOWN else int(block.words[k])] = 10 ** tokens[k]
    assert len(chance) == 92 and 0.95 < sum(chance.values()) < 1 + 1e-6
    mixer, block = got["mixer"], got["blocks"][0]
    for kind, (bit, slots, sets, _) in list(L.decisions(block))[:12]:
        fast = mixer.chances(kind, bit, slots, sets)
        for i in range(0, len(bit), 17):
            seen = [int(mixer.ready[f"{kind}/{k}"][s[i]]) for k, s in enumerate(slots)]
            cell = int(sets[i]) * L._GATES + seen[0] % 2 * 8 + seen[-1] % 8
            logit = sum((x // 8) / 128 * float(mixer.weights[kind][k][cell]) for k, x in enumerate(seen))
            logit = min(7.99, max(-7.99, logit))
            place = (logit + 8) * 2
            table = mixer.refine[kind].reshape(-1, 33)[int(sets[i])].tolist()
            fine = table[int(place)] * (1 - place % 1) + table[int(place) + 1] * (place % 1)
            p = 0.5 / (1 + math.exp(-logit)) + 0.5 * fine
            assert abs(fast[i] - max(p if bit[i] else 1 - p, 1e-6)) < 1e-5


def test_scores_do_not_depend_on_the_dealing(spark, docs):
    """The same to the last bit for one, four and seven partitions, and other numbers of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen.append(Counter((r.doc_id, r.score, r.base_score) for r in lm_scores(docs.repartition(n)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_scores_without_training_documents_or_groups(spark):
    """Null groups, more groups than there is room for, null ids, and a table that teaches nothing."""
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = [(k, "some words here", None) for k in held] + [(None, "some words", "x")]
    out = lm_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and r.score < 0 for r in out)
    many = spark.createDataFrame([(k, f"w{k % 12} x y", f"l{k % 12}") for k in range(200)], "doc_id long, text string, lang string")
    assert lm_scores(many).count() == 200 and lm_scores(many.drop("lang"), None).count() == 200


def test_held_out_text_is_scored_better_than_by_counts(spark):
    """Held-out accuracy: fewer bits for each token than the smoothed counts, in two invented languages."""
    rng = random.Random(4)
    rows = []
    for k in range(900):
        tongue = "xyz"[k % 3]
        rows.append((k, " ".join(f"{tongue}{int(rng.paretovariate(0.9)) % 900}" for _ in range(120)), tongue))
    out = lm_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_tables_count_every_training_token_with_less_work(spark, monkeypatch):
    """Tables are those of every decision of every training token, though what predictors see the same of is counted at once."""
    from wayfold.llm import lm_scoring as L

    rng = random.Random(8)
    rows = [(k, " ".join(f"t{int(rng.paretovariate(0.8)) % 300}" for _ in range(rng.randrange(60))) + f" once{k}", "xyz"[k % 3]) for k in range(400)]
    got = captured_model(monkeypatch, L, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fast, plain, work = Counter(), Counter(), Counter()
    for block in got["blocks"]:
        for kind, first, bit, slots, times in L.tallied(block):
            for k, x in enumerate(slots, first):
                work["grouped", kind, k] += len(x)
                for at, n in zip((x * 2 + bit).tolist(), [1] * len(x) if times is None else times.tolist(), strict=True):
                    fast[kind, k, at] += n
        hashes = [None, *L.contexts(block.words, block.group, block.at)]
        for d, taught in enumerate(block.train):
            for t in range(block.at[d], block.at[d + 1] if taught else block.at[d]):
                for bit, slots, _, _ in L.word_bits(block.code, block.less, block.cls, block.ident, block.mask, hashes, t, t + 1):
                    for k, x in enumerate(slots):
                        plain["word", k, int(x[0] * 2 + bit[0])] += 1
                        work["plain", "word", k] += 1
    assert {k: n for k, n in fast.items() if k[0] == "word"} == plain and any(k[0] == "byte" for k in fast)
    assert all(work["grouped", "word", k] < work["plain", "word", k] / 3 for k in (0, 1))
    tables = defaultdict(Counter)
    payloads = [bytes(r.payload) for r in got["lm-coded"].collect()]
    batch = L.pa.record_batch([L.pa.array(payloads, L.pa.binary())], names=["payload"])
    for row in next(L._tally(got["code"])(iter([batch]))).to_pylist():
        counts = L.unpack(row["counts"])[0]
        tables[row["name"]].update({row["start"] + int(i): int(counts[i]) for i in counts.nonzero()[0]})
    assert {(*name.split("/"), at): n for name, t in tables.items() for at, n in t.items()} == {(kind, str(k), at): n for (kind, k, at), n in fast.items()}


def test_scores_of_tokens_stand_in_the_order_of_the_text(spark, monkeypatch):
    """Tokens are read class by class and word by word; each one's chance is that of the token read alone."""
    from wayfold.llm import lm_scoring as L

    rng = random.Random(9)
    rows = [(k, " ".join(f"s{int(rng.paretovariate(0.8)) % 90}" for _ in range(30)), "xy"[k % 2]) for k in range(120)] + [(500, "", "x")]
    got = captured_model(monkeypatch, L, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for block in got["blocks"]:
        order = block.by_word
        assert sorted(order.tolist()) == list(range(len(block.index))) and (np.diff(block.cls[order].astype(int)) >= 0).all()
        tokens, _ = L.token_scores(got["mixer"], block)
        hashes = [None, *L.contexts(block.words, block.group, block.at)]
        for t in range(0, len(tokens), 37):
            alone = math.log(block.share[t])
            for bit, slots, sets, _ in L.word_bits(block.code, block.cls, block.cls, block.ident, block.mask, hashes, t, t + 1):
                alone += float(np.log(got["mixer"].chances("word", bit, slots, sets))[0])
            assert abs(tokens[t] - alone / math.log(10)) < 1e-6


def test_distinct_words_by_sorted_hashes(monkeypatch):
    """As np.unique would, and where the upper bits of hashes tie too."""
    from wayfold.llm import lm_scoring as L

    tokens = np.random.default_rng(3).integers(0, 2**63, 700, dtype=np.uint64)[np.random.default_rng(4).integers(0, 700, 5000)]
    for mix in (L.S.mix, lambda x: x & np.uint64(0xF << 60)):
        monkeypatch.setattr(L.S, "mix", mix)
        names, index = L._distinct(tokens)
        assert len(np.unique(names)) == len(names) and (names[index] == tokens).all()
        assert (np.diff(L.identity(names).astype(np.int64)) >= 0).all()
    assert [len(x) for x in L._distinct(tokens[:0])] == [0, 0]
