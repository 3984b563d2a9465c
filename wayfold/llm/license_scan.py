"""Licence scans: one Aho-Corasick pass finds identifier tags and notice phrases;
a shunting-yard parser evaluates the licence expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _shared as S

#: Phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own notice phrases: label and weight.
NOTICES = {
    "mozilla public license": ("mpl", 0.8),
    "bsd license": ("bsd", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "creative commons": ("creative-commons", 0.6),
    "all rights reserved": ("all-rights-reserved", 0.6),
    "permission is hereby granted free of charge": ("mit-notice", 0.9),
    "redistribution and use in source and binary forms": ("bsd-notice", 0.9),
    "licensed under the apache license version 2 0": ("apache-notice", 0.9),
    "this program is free software you can redistribute it": ("gpl-notice", 0.9),
    "public domain": ("public-domain", 0.5),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.7, 1.0
#: Identifiers under which text may be used with attribution alone.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd"})

_FOLD = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Public identifiers: families that take a version, names that stand alone (fixed values), and references of one's own.
VERSIONED = "apache gpl lgpl agpl gfdl mpl epl cddl cpl afl apl osl eupl ecl ofl lppl php python psf zpl cecill bsl odbl odc-by pddl upl artistic cc0 cc-by cc-by-sa cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd blueoak etalab mulanpsl ssplv rpl lal nposl qpl sgi-b w3c cern-ohl-p cern-ohl-s cern-ohl-w".split()
ALONE = "mit mit-0 mit-cmu isc zlib libpng unlicense 0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause wtfpl x11 curl openssl postgresql ruby vim ms-pl ms-rl ncsa icu json beerware ftl hpnd tcl unicode-dfs-2016 unicode-3.0 naist-2003 bzip2-1.0.6 libtiff mirros xnet none noassertion".split()
_KNOWN = re.compile(rf"(?:{'|'.join(map(re.escape, ALONE))}|(?:{'|'.join(map(re.escape, VERSIONED))})-?\d+(?:\.\d+)*(?:-only|-or-later)?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+)\+?")
_EXCEPTION = re.compile(r"(?:[a-z0-9.+-]+-exception(?:-\d+(?:\.\d+)*)?|additionref-[a-z0-9.-]+)")
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+|[^ \t()A-Za-z0-9.+:-]+")
#: What may close the comment that a tag stands in.
_CLOSING = re.compile(rb"(?:[ \t\r]|\*+/|--+>|#\}|%>|\"|'|[.,;](?=[ \t\r]*$))+$")


def parse_expression(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in tokens:
        name = token.lower()
        if name in _PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[name]:
                out.append(stack.pop())
            stack.append(name)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(name)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[bool, set[str]] | None:
    """Whether a permissive choice satisfies the expression, and its identifiers; None where a name is unknown or WITH joins other than a licence and an exception."""
    stack: list[tuple[str, bool, set[str]]] = []
    for name in postfix:
        if name not in _PRECEDENCE:
            kind = "licence" if _KNOWN.fullmatch(name) else "exception" if _EXCEPTION.fullmatch(name) else "unknown"
            stack.append((kind, name.rstrip("+") in PERMISSIVE, {name}))
            continue
        b, a = stack.pop(), stack.pop()
        if name == "with":
            if (a[0], b[0]) != ("licence", "exception"):
                return None
            stack.append(("joined", a[1], {f"{next(iter(a[2]))}-with-{next(iter(b[2]))}"}))
        elif {a[0], b[0]} <= {"licence", "joined"}:
            stack.append(("joined", a[1] or b[1] if name == "or" else a[1] and b[1], a[2] | b[2]))
        else:
            return None
    kind, permissive, names = stack[0]
    return (permissive, names) if kind in ("licence", "joined") else None


def expression_at(line: bytes) -> list[str]:
    """Tokens of the expression that fills the rest of a tag's line; what closes a comment is no part of it."""
    return [x.decode("utf-8", "replace") for x in _TOKEN.findall(_CLOSING.sub(b"", line))]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    phrases = {p: ("base", label, BASE_WEIGHT) for p, label in BASE.items()} | {p: ("notice", *x) for p, x in NOTICES.items()} | {TAG: ("tag", "", TAG_WEIGHT)}
    for phrase, (kind, label, weight) in phrases.items():
        found.add_word(f" {phrase} ", (kind, label, weight, len(phrase) + 2, phrase.count(" ") + 1))
    found.make_automaton()
    return found


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = automaton()
    for batch in batches:
        names = batch.schema.names
        data, offsets = S.text_column(batch.column(names.index("text")))
        folded = _FOLD[data]
        starts, ends, bounds = S.word_bounds(folded, offsets)
        n = len(offsets) - 1
        # each word after a space, each row closed by a space and a line feed
        row = np.repeat(np.arange(n), np.diff(bounds))
        size = ends - starts
        at = np.cumsum(size + 1) - size + 2 * row  # where a word stands in the stream
        stream = np.full(len(folded) + len(size) + 2 * n + 2, 32, np.uint8)
        stream = stream[: int((size + 1).sum()) + 2 * n]
        stream[S.ranges(at, size)] = folded[S.ranges(starts, size)]
        closing = np.r_[0, np.cumsum(size + 1)][bounds[1:]] + 2 * np.arange(n)
        stream[closing + 1] = 10
        hits: dict[int, list] = {}
        for end, hit in search.iter(stream.tobytes().decode("latin-1")):
            word = int(np.searchsorted(at, end - hit[3] + 2))
            hits.setdefault(int(row[word]), []).append((word, hit))
        count = np.zeros(n, np.int64)
        first: list = [None] * n
        last: list = [None] * n
        base, labels, score = [""] * n, [""] * n, np.zeros(n)
        for k, found in hits.items():
            low = int(bounds[k])
            places = [w - low for w, h in found if h[0] == "base"]
            count[k] = len(places)
            if places:
                first[k], last[k] = min(places), max(places)
            own = {h[1] for _, h in found if h[0] == "base"}
            base[k] = ",".join(sorted(own))
            own |= {h[1] for _, h in found if h[0] == "notice"}
            miss = 1.0
            weights = {h[1]: h[2] for _, h in found if h[0] != "tag"}
            for w, h in found:
                if h[0] != "tag":
                    continue
                line = data[ends[w + h[4] - 1] : offsets[k + 1]].tobytes().split(b"\n", 1)[0]
                if not line.startswith(b":"):
                    continue
                tokens = expression_at(line[1:])
                postfix = parse_expression(tokens)
                value = evaluate(postfix) if postfix else None
                if value is None:
                    own.add("spdx-malformed")
                    continue
                own |= {f"spdx-{x}" for x in value[1]} | {"permissive" if value[0] else "restricted"}
                weights["spdx"] = TAG_WEIGHT
            for weight in sorted(weights.values()):
                miss *= 1 - weight
            score[k] = 1 - miss
            labels[k] = ",".join(sorted(own))
        keep = [c for c, x in zip(batch.columns, names, strict=True) if x != "text"]
        new = [pa.array(np.diff(bounds)), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score)]
        yield pa.record_batch([*keep, *new], names=[*(x for x in names if x != "text"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence mentions of each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs has doc_id and text; other columns are not read. A null or empty text
    has no words: counts 0, places null, labels empty, score 0. Rows that share a
    doc_id are scanned each for itself. The score is 1 less the product of the
    distinct labels' doubts; a well-formed identifier tag gives 1. The expression
    of a tag is the rest of its line; if that is malformed, or names what is
    neither a public identifier nor a LicenseRef, the label is spdx-malformed
    and the tag adds no score.
    """
    S.prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {OUT}")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
