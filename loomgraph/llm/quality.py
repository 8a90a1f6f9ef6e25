"""Operator 1, quality rules: suffix-array repetition over the words of each document.

A document's words become a suffix array by prefix doubling (3, 6, 12, ... words). Neighbours in it
give the longest-common-prefix intervals; the deepest interval around a suffix is the longest repeated
substring that starts there, so the union of those spans is the union of all maximal repeated
substrings. A document is rejected when the spans cover too large a part of it, or when the longest
repeat is too large a part of it. Documents are independent of each other: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import columns_of, slices, small_batches

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class QualityRules:
    """Production parameters. Lengths are in words, shares in parts of the document's words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A repeated substring counts from so many words.
    min_repeat: int = 6
    #: Most of the words that repeated substrings may cover: the published limit on duplicated text.
    max_covered: float = 0.20
    #: Most of the words that the longest repeated substring may take (one of its copies): half of that,
    #: as one substring found twice reaches both limits at once.
    max_longest: float = 0.10


class _Ids(dict):
    """Numbers words from 1 in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the index at which each one's run starts, and whether the run holds two or more."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    last = np.empty(len(keys), bool)
    last[-1:] = True
    last[:-1] = new[1:]
    return start, ~(new & last)


def _cover(at: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in a span [at, at + length)."""
    edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def repetition(ids: np.ndarray, doc: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Over the concatenated word numbers of documents, each followed by two zeros.

    Returns for every position whether a 3-word window found twice in its document covers it, and the
    length of the longest substring from it, of `min_repeat` words or more, that its document repeats.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    real = np.flatnonzero(ids)
    if not len(real):
        return np.zeros(n, bool), longest
    pad = np.concatenate([ids, np.zeros(2, ids.dtype)])
    if pad.max() < 1 << 21:
        key = (pad[:n] << 42 | pad[1 : n + 1] << 21 | pad[2 : n + 2])[real]
    else:  # too many different words for one number: rank pairs first
        _, pair = np.unique(pad[:-1] << 32 | pad[1:], return_inverse=True)
        key = (pair[:n].astype(np.int64) << 32 | pad[2 : n + 2])[real]
    order = np.argsort(key)
    start, tied = _runs(key[order])
    where = real[order]
    # Only windows that occur twice anywhere in the batch need their documents looked at.
    again = np.flatnonzero(tied)
    by_doc = start[again] << 32 | doc[where[again]]
    inner = np.argsort(by_doc)
    again_at, by_doc = where[again][inner], by_doc[inner]
    run, twice = _runs(by_doc)
    rank = np.full(n + 1, -1, np.int64)
    rank[where] = start
    # The tied ones take the places of `again` in order, so ranks stay those of one total order.
    rank[again_at] = again[run]
    rank[np.flatnonzero(np.append(ids, 0) == 0)] = -1 - np.flatnonzero(np.append(ids, 0) == 0)
    tied_at = again_at[twice]
    repeated = _cover(tied_at, 3, n)

    levels, sets, m = [rank], [tied_at], 3
    while len(tied_at):
        first, then = rank[tied_at], rank[tied_at + m]
        place = np.argsort(then, kind="stable")
        place = place[np.argsort(first[place], kind="stable")]
        tied_at, first, then = tied_at[place], first[place], then[place]
        group, _ = _runs(first)
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
        rank = rank.copy()
        rank[tied_at] = first + start - group
        last = np.ones(len(first), bool)
        last[:-1] = new[1:]
        tied_at = tied_at[~(new & last)]
        m *= 2
        levels.append(rank)
        sets.append(tied_at)
    base = max(k for k in range(len(sets)) if 3 << k <= max(3, min_repeat) or k == 0)
    suffixes = sets[base]
    if len(suffixes):
        suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
        a, b = suffixes[:-1], suffixes[1:]
        near = levels[base][a] == levels[base][b]
        a, b = a[near], b[near]
        lcp = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            lcp += np.where(levels[k][a + lcp] == levels[k][b + lcp], 3 << k, 0)
        for _ in range(2):
            lcp += (pad[a + lcp] == pad[b + lcp]) & (pad[a + lcp] > 0)
        np.maximum.at(longest, a, lcp)
        np.maximum.at(longest, b, lcp)
        longest[longest < min_repeat] = 0
    return repeated, longest


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def measure(texts: list[str | None], rules: QualityRules) -> dict[str, list]:
    """The figures of a batch of documents."""
    number, ids, lens = _Ids(), [], []
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        split = raw.split()
        ids.append(np.fromiter(map(number.__getitem__, split), np.int64, len(split)))
        lens.append(len(split))
        lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
        out["n_words"].append(len(split))
        out["word_chars"].append(len(text or "") - sum(map((text or "").count, SPACES)))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    end = np.zeros(2, np.int64)
    flat = np.concatenate([x for one in ids for x in (one, end)]) if ids else end
    doc = np.repeat(np.arange(len(ids)), np.array(lens) + 2) if ids else np.zeros(2, np.int64)
    repeated, longest = repetition(flat, doc, rules.min_repeat)
    at = np.flatnonzero(longest)
    covered = _cover(at, longest[at], len(flat))
    per = lambda flags: np.bincount(doc[flags], minlength=len(ids)).tolist()
    out["n_repeat_words"] = per(repeated)
    out["n_covered_words"] = per(covered)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, doc[at], longest[at])
    out["longest_repeat"] = most.tolist()
    first = np.cumsum([0, *(n + 2 for n in lens)])
    out["spans"] = [
        [{"from_word": a, "to_word": b} for a, b in _spans(covered[first[i] : first[i] + lens[i]])] if most[i] else []
        for i in range(len(ids))
    ]
    return out


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, spans array<struct<from_word:int,to_word:int>>"
)
_ARROW = [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")]
_SPAN = pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())]))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every document's figures, repeated spans and verdict, beside the columns named in `keep`.

    Nulls and empty texts have no words and fail the base rule. Repeated rows are judged one by one;
    other columns are neither read nor returned. A text is held whole by one task, never cut.
    """
    small_batches(docs.sparkSession)
    rows = columns_of(docs, *dict.fromkeys([*keep, "text"]))
    kept = rows.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                got = measure(batch.column("text").to_pylist(), rules)
                cols = [batch.column(n) for n in keep] + [pa.array(got[n], t) for n, t in _ARROW] + [pa.array(got["spans"], _SPAN)]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *(n for n, _ in _ARROW), "spans"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [SCHEMA])
    out = rows.mapInArrow(run, schema)
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    method = (F.col("n_covered_words") <= rules.max_covered * F.col("n_words")) & (
        F.col("longest_repeat") <= rules.max_longest * F.col("n_words")
    )
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & method)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """One row per document: the base figures and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("spans")
