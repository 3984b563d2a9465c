"""Token counts by section: encode a document once, then attribute its tokens to sections by their spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import _shared as S

RULES = ("first", "most", "share")
_ENCODINGS: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the bytes of each token."""
    if path not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            size[k] = len(token)
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _ENCODINGS[path]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Both tile the same characters; sections are not empty.

    first: a token counts where its first character stands. most: where most of
    its characters stand, the earlier one on a tie. share: to each section by its
    part of the token's characters.
    """
    out = np.zeros(len(section_ends))
    begin = np.r_[0, token_ends[:-1]]
    at = np.searchsorted(section_ends, begin, side="right")
    upto = np.searchsorted(section_ends, np.maximum(token_ends - 1, begin), side="right")
    at, upto = np.minimum(at, len(out) - 1), np.minimum(upto, len(out) - 1)
    inside = at == upto if rule != "first" else np.ones(len(at), bool)
    np.add.at(out, at[inside], 1)
    for k in np.flatnonzero(~inside):
        cuts = np.minimum(section_ends[at[k] : upto[k] + 1], token_ends[k])
        part = np.diff(np.r_[begin[k], cuts])
        if rule == "most":
            out[at[k] + int(part.argmax())] += 1
        else:
            out[at[k] : upto[k] + 1] += part / part.sum()
    return out


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte ends of the lines, each with its line feed; the last may lack one."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.r_[ends, len(data)]


def _count(path: str, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(path)
        for batch in batches:
            ids = batch.column(0)
            texts = pa.array([x or "" for x in batch.column(1).to_pylist()], pa.string())
            data, offsets = S.text_column(texts)
            rows, section, begin, end, tokens = [], [], [], [], []
            for k, text in enumerate(texts):
                if offsets[k] == offsets[k + 1]:
                    continue
                part = data[offsets[k] : offsets[k + 1]]
                token_ends = np.cumsum(size[np.asarray(enc.encode_to_numpy(text.as_py(), disallowed_special=()), np.int64)])
                chars = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]  # characters before each byte; a cut one counts as begun
                ends = line_sections(part)
                # a token that begins inside a character begins at that character
                starts = np.maximum(chars[np.r_[0, token_ends[:-1]]] - ((part[np.r_[0, token_ends[:-1]]] & 0xC0) == 0x80), 0)
                edges = np.r_[starts[1:], chars[-1]]
                lines = chars[ends]
                if rule == "first":
                    n = np.bincount(np.searchsorted(lines, starts, side="right"), minlength=len(lines)).astype(float)
                else:
                    n = attribute(edges, lines, rule)
                rows.append(np.full(len(ends), k))
                section.append(np.arange(len(ends)))
                begin.append(np.r_[0, lines[:-1]])
                end.append(lines)
                tokens.append(n)
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.record_batch([ids.take(at), *(pa.array(np.concatenate(x)) for x in (section, begin, end, tokens))], names=["doc_id", "section", "start_char", "end_char", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """Tokens of each line of each document: doc_id, section, start_char, end_char, n_tokens (double).

    docs has doc_id and text; other columns are not read. `path` is a rank file
    (byte_bpe_50k.tiktoken by default); `rule` says where a token that crosses a
    boundary counts: see attribute(). A line's span has its line feed. A null or
    empty text has no sections and so no rows. Rows that share a doc_id each give
    their own rows. The tokens of a document's sections add up to its tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    S.prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select("doc_id", "text").mapInArrow(_count(path, rule), f"doc_id {kind}, section long, start_char long, end_char long, n_tokens double")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
