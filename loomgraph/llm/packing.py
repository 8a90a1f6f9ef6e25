"""Operator 10, best-fit packing: bounded-space online best-fit into sequences of a fixed length.

Every task packs the documents it scans, in the order in which they come. It keeps a fixed number of open
bins in a bitset keyed by free space: the lowest set bit at or above a piece's length is the tightest bin
that takes it, and when no more bins may open the fullest one closes. A task holds only the pieces of its
open bins; those of a closed bin go out.

What is open when a task ends, and still has room, would leave every task with its own half-empty
sequences. These pieces alone are shuffled, into groups of some thousand sequences, and packed once more
in the same way, so the number of sequences hardly depends on the number of partitions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, columns_of, slices

#: Characters on which every Unicode version agrees; other texts take the tokenizer's own, slower road.
_ODD = re.compile("[^\t\n\r -~¡-ɏ]")


def _own_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class PackingRules:
    """Production parameters; the tokenizer is a path to a byte-level BPE file of the tokenizers library."""

    tokenizer: str = field(default_factory=_own_tokenizer)
    length: int = 2048
    end_id: int = 0
    open_bins: int = 256
    #: A bin that is open when its task ends is packed again if so much of it is free.
    loose: float = 1 / 128
    #: Sequences that one task of the second packing makes, about.
    group: int = 2048


class Encoder:
    """Token ids of a tokenizers file. Plain texts go through tiktoken with that file's own vocabulary
    and split pattern, which gives the same ids about four times faster; texts with unusual characters
    or with an added token in them go through tokenizers itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            # Byte-level files write a byte as a printable character: itself, or the next one from 256 on.
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in own}
            shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
            ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast and (text.isascii() or not _ODD.search(text)) and "\x7f" not in text and not any(t in text for t in self.added):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class OpenBins:
    """Open bins in a bitset keyed by free space; each holds what was placed in it until it closes."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.open = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return one

    def place(self, n: int, what: object) -> list[list]:
        """Puts a piece of length n into the tightest bin; returns the bins that this closes."""
        closed, fits = [], self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.open >= self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            one, free = [], self.length
        one.append(what)
        left = free - n
        if left:
            self.by_free[left].append(one)
            self.bits |= 1 << left
            self.open += 1
        else:
            closed.append(one)
        return closed

    def rest(self) -> list[tuple[int, list]]:
        """(free space, bin) of the bins still open."""
        return [(free, one) for free, bins in enumerate(self.by_free) for one in bins]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and before them the rest."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


_PIECE = ("doc_id", "piece", "start", "length", "ids")


class _Sequences:
    """Gathers closed bins as rows; the numbers of sequences go on from `first`."""

    def __init__(self, first: int, kind: pa.DataType):
        self.next, self.kind, self.rows, self.held = first, kind, [], 0

    def close(self, bins: list[list], loose: bool = False) -> None:
        for one in bins:
            offset = 0
            for piece in one:
                self.rows.append((*piece, self.next, offset, loose))
                offset += piece[3]
            self.held += offset
            self.next += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 8
        kinds = (self.kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*_PIECE, "sequence_id", "offset", "loose"])


#: Token ids of finished sequences that a task gathers before it passes them on.
_HELD = 1 << 20


def pack(docs: DataFrame, rules: PackingRules | None = None, encoder: Callable[[str], Callable[[str | None], np.ndarray]] = Encoder) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    A null or empty text is the end id alone. Documents up to the sequence length stay whole; each text
    is tokenized whole. Repeated rows are packed each, rows without a doc_id too; an empty table gives no
    rows. Sequence numbers hold the task's partition in their upper bits, those of the second packing
    below zero. The first packing is written to the shared folder, so texts are tokenized once.
    """
    rules = rules or PackingRules()
    scratch = Scratch(docs.sparkSession)
    rows = columns_of(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long, loose boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, out = encoder(rules.tokenizer), OpenBins(rules.length, rules.open_bins), None
        for whole in batches:
            out = out or _Sequences(TaskContext.get().partitionId() << 36, whole.schema.field("doc_id").type)
            for batch in slices(whole, "text", 4 << 20):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(rules.end_id)).astype("<u4")
                    for k, (start, n) in enumerate(cuts(len(ids), rules.length)):
                        out.close(bins.place(n, (doc, k, start, n, ids[start : start + n].tobytes())))
                    if out.held >= _HELD:
                        yield out.batch()
        if out:
            for free, one in bins.rest():
                out.close([one], loose=free >= rules.loose * rules.length)
            yield out.batch()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, out = OpenBins(rules.length, rules.open_bins), None
        for batch in batches:
            out = out or _Sequences(-((TaskContext.get().partitionId() + 1) << 36), batch.schema.field("doc_id").type)
            for piece in zip(*(batch.column(c).to_pylist() for c in _PIECE), strict=True):
                out.close(bins.place(piece[3], piece))
            if out.held >= _HELD:
                yield out.batch()
        if out:
            out.close([one for _, one in bins.rest()])
            yield out.batch()

    packed = scratch.write(rows.mapInArrow(first, schema))
    loose = packed.where("loose")
    total = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # Whole bins go to a group, by their number: all groups have about the same size, whatever the documents are.
    group = F.pmod(F.xxhash64("sequence_id"), F.lit(-(-total // (rules.length * rules.group)) or 1))
    loose = loose.withColumn("at", group).repartition("at").sortWithinPartitions("at", "sequence_id", "offset").drop("at")
    return packed.where("not loose").unionByName(loose.mapInArrow(again, schema)).drop("loose")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
