"""Operator 7, suffix-array dedup: every byte that a `length`-byte string covers which starts earlier too.

A window is a string of `length` bytes. Its anchor is its smallest k-gram by hash (leftmost of equals),
so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a run.
Most anchors occur once in the corpus and their windows repeat nowhere; counting anchors drops them.
What is left is settled by anchor:

- runs with equal content hashes: all but the first are repeated whole;
- first runs of different content that share an anchor: the suffixes that start at their windows are
  sorted by a mergesort whose comparisons find the common extension of two suffixes by binary search on
  prefix polynomial hashes, a logarithmic number of probes each. The earliest of equal windows stays;
- an anchor with more than `group` different contents (a passage in very many contexts) is taken apart into
  windows, each by its own hash; of those hashes that several windows have, all but the first are repeated.

Every claim of the hashes is verified by bytes. Neighbours in the sorted order are compared byte by byte,
and a group whose order the bytes refute is settled by them instead. Runs and windows repeated by hash are
joined into the longest stretches of one document that stand in one earlier document; the stretches' bytes
are grouped with those of the earlier place. Should they differ, all is done again with other hashes.

Counts, first runs and the verification are partial aggregates before any shuffle, so a passage in a third
of all documents is one row a task, and no group that one task sorts exceeds `group` contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, columns_of


@dataclass(frozen=True)
class SuffixRules:
    """Production parameters."""

    length: int = 100
    kgram: int = 36
    #: Seed of all hashes, and how often another one is tried where two contents have one hash.
    seed: int = 7
    attempts: int = 4
    #: Bits of the first attempt's content hashes; fewer only in tests, to have hashes collide.
    bits: int = 64
    #: Different contents of one anchor that one task sorts; beyond it they are taken apart into windows.
    group: int = 2_000
    #: Suffixes sorted at a time.
    batch: int = 200_000


_SPACE = 1 << 20  # positions in a buffer: they share a number with the hash that selects anchors
_BASE = 0x9E3779B97F4A7C15 | 5


class _Hasher:
    """Polynomial hashes modulo 2 ** 64 over a byte's random number."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.of = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256).astype(np.uint64)
        self.grow(_SPACE)

    def grow(self, size: int) -> None:
        """Powers for buffers of that size; sorting may need more than one text's buffer."""
        n = size + 1
        self.power, self.inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
        self.power[1:] = np.uint64(_BASE)
        self.inverse[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):
            self.grow(2 * len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.of[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def part(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]


_HASHER: dict[int, _Hasher] = {}


def _hasher(seed: int = SuffixRules.seed) -> _Hasher:
    if seed not in _HASHER:
        _HASHER[seed] = _Hasher(seed)
    return _HASHER[seed]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs_of(raws: list[bytes], rules: SuffixRules) -> tuple[np.ndarray, ...]:
    """Of texts that fit one buffer: anchor hash, content hash, text, start, windows, anchor's offset, per run."""
    length, k = rules.length, rules.kgram
    hasher, raw = _hasher(rules.seed), np.frombuffer(b"".join(raws), np.uint8)
    n = len(raw)
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    valid = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True) if s >= length] or [none])
    if not len(valid):
        return (none,) * 6
    prefix = hasher.prefix(raw)
    at = np.arange(n - k + 1)
    gram = _mix((prefix[k:] - prefix[: n - k + 1]) * hasher.inverse[: n - k + 1])
    least = (gram & ~np.uint64(_SPACE - 1)) | at.astype(np.uint64)
    width, span = 1, length - k + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least[valid] & np.uint64(_SPACE - 1)).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    start, anchor = valid[first], anchor[first]
    content = _mix(hasher.part(prefix, start, start + count - 1 + length) ^ count.astype(np.uint64)) >> np.uint64(64 - rules.bits)
    text = np.searchsorted(ends, start, side="right")
    return gram[anchor].astype(np.int64), content.astype(np.int64), text, start - (ends - sizes)[text], count, anchor - start


def _texts(batch: pa.RecordBatch, rules: SuffixRules) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Rows of a batch as buffers: (row, bytes, the bytes' place in the row's text). A text beyond a buffer
    comes in parts that share length - 1 bytes, so that every window is in exactly one of them."""
    rows, raws, places, held = [], [], [], 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for place in range(0, max(1, len(raw) - rules.length + 1), _SPACE - rules.length + 1):
            part = raw[place : place + _SPACE]
            if held + len(part) > _SPACE:
                yield rows, raws, places
                rows, raws, places, held = [], [], [], 0
            rows.append(row)
            raws.append(part)
            places.append(place)
            held += len(part)
    if rows:
        yield rows, raws, places


def _runs(docs: DataFrame, rules: SuffixRules, narrow: bool) -> DataFrame:
    """The runs of all texts; narrow: their anchors alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, raws, places in _texts(batch, rules):
                anchor, content, text, start, count, offset = runs_of(raws, rules)
                if narrow:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                    continue
                start = start + np.array(places, np.int64)[text] if len(text) else start
                own = ids[np.array(rows)[text]] if len(text) else start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(content), pa.array(own.astype(np.int64)), pa.array(start), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32))],
                    ["anchor", "content", "doc_id", "start", "windows", "offset"],
                )

    return docs.mapInArrow(run, "anchor long" if narrow else "anchor long, content long, doc_id long, start long, windows int, offset int")


def _compare(prefix: np.ndarray, raw: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Common extension of suffixes x and y, up to a window, and whether x is the smaller by its next byte."""
    hasher, common = _hasher(), np.zeros(len(x), np.int64)
    step = 1 << (length.bit_length() - 1)
    while step:
        a, b = x + common, y + common
        inside = common + step <= length
        e = np.where(inside, step, 0)
        same = (prefix[a + e] - prefix[a]) * hasher.inverse[a] == (prefix[b + e] - prefix[b]) * hasher.inverse[b]
        common += np.where(inside & same, step, 0)
        step >>= 1
    over = common >= length
    at = np.where(over, 0, common)
    return common, ~over & (raw[x + at] < raw[y + at])


def sort_suffixes(raw: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of the suffixes `at`, bucket by bucket (they come sorted by bucket, and stay in the order
    given where equal). Returns their new order and, for each but the first, the common extension with the
    one before it in its bucket (0 at a bucket's start)."""
    n = len(at)
    prefix = _hasher().prefix(raw)
    new = np.ones(n, bool)
    new[1:] = bucket[1:] != bucket[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))[np.cumsum(new) - 1]
    order, width = np.arange(n), 1
    while width < size.max(initial=0):
        local = np.arange(n) - first
        own = local // width
        begin = (own ^ 1) * width
        active = np.flatnonzero(begin < size)
        low = np.zeros(n, np.int64)
        high = np.where(begin < size, np.minimum(width, size - begin), 0)
        while len(active):
            mid = (low[active] + high[active]) // 2
            other = order[first[active] + begin[active] + mid]
            mine = order[active]
            # A left element goes before equals of the right run, a right one after equals of the left.
            common, less = _compare(prefix, raw, at[other], at[mine], length)
            before = less | ((own[active] % 2 == 1) & (common >= length))
            low[active] = np.where(before, mid + 1, low[active])
            high[active] = np.where(before, high[active], mid)
            active = active[low[active] < high[active]]
        place = first + np.where(begin < size, np.minimum(own, own ^ 1) * width + local - own * width + low, local)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = np.where(new[1:], 0, _compare(prefix, raw, at[order[1:]], at[order[:-1]], length)[0])
    return order, common


def repeated_windows(contents: list[bytes], group: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Rows (doc, start) of the windows of these runs that an earlier one of the same anchor equals."""
    raw = np.frombuffer(b"".join(contents), np.uint8)
    base = np.cumsum([0, *map(len, contents)])[:-1]
    run = np.repeat(np.arange(len(contents)), windows)
    within = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.lexsort((start[run] + within, doc[run], offset[run] - within, group[run]))
    run, within = run[place], within[place]
    at = base[run] + within
    new = np.ones(len(run), bool)
    key = group[run], offset[run] - within
    new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
    order, common = sort_suffixes(raw, at, np.cumsum(new), length)
    same = common >= length
    bucket = np.cumsum(new)
    hit = order[same]
    wrong = refuted(raw, at[order], bucket, same, length)
    if len(wrong):  # two strings have one hash: these buckets are settled by the windows' bytes
        hit = hit[~np.isin(bucket[hit], wrong)]
        seen: set[tuple[int, bytes]] = set()
        again = []
        for i in np.flatnonzero(np.isin(bucket, wrong)).tolist():  # in order of document and start
            window = int(bucket[i]), raw[at[i] : at[i] + length].tobytes()
            again += [i] if window in seen else []
            seen.add(window)
        hit = np.concatenate([hit, np.array(again, np.int64)])
    return np.stack([doc[run[hit]], start[run[hit]] + within[hit]], 1)


def refuted(raw: np.ndarray, at: np.ndarray, bucket: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """Buckets in which the bytes of neighbouring windows `at` contradict their order, or whether they are the
    `same`. Where none does, the order is that of the bytes, and equal windows stand together."""
    padded, words = np.append(raw, np.zeros(8, np.uint8)).astype(np.uint64), np.zeros(len(raw), np.uint64)
    for k in range(8):  # big-endian numbers are in the order of their bytes
        words |= padded[k : k + len(raw)] << np.uint64(56 - 8 * k)
    wrong = []
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for k in range(1, len(at), 100_000):
        here = np.arange(k, min(len(at), k + 100_000))
        here = here[bucket[here] == bucket[here - 1]]
        for step in steps:  # those whose bytes are equal so far
            x, y = words[at[here - 1] + step], words[at[here] + step]
            differ = x != y
            wrong.append(bucket[here[differ & ((x > y) | same[here])]])
            here = here[~differ]
        wrong.append(bucket[here[~same[here]]])
    return np.unique(np.concatenate(wrong)) if wrong else np.zeros(0, np.int64)


def _joined(repeats: DataFrame, rules: SuffixRules) -> DataFrame:
    """Stretches (doc_id, start, end, of_doc, of_start) of windows that follow each other in a document as they do
    in the earlier document that they repeat, from runs (doc_id, start, windows, of_doc, of_start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("runs").flatten()
            sizes = np.diff(batch.column("runs").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            start, windows, of_doc, of_start = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "windows", "of_doc", "of_start"))
            order = np.lexsort((start, of_start - start, of_doc, row))
            row, start, end, of_doc, of_start = row[order], start[order], (start + windows)[order], of_doc[order], of_start[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (of_doc[1:] != of_doc[:-1]) | ((of_start - start)[1:] != (of_start - start)[:-1]) | (start[1:] > end[:-1])
            first = np.flatnonzero(new)
            last = np.maximum.reduceat(end, first) if len(first) else end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row[first])), *(pa.array(c) for c in (start[first], last - 1 + rules.length, of_doc[first], of_start[first]))],
                ["doc_id", "start", "end", "of_doc", "of_start"],
            )

    lists = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "of_doc", "of_start")).alias("runs"))
    return lists.mapInArrow(run, "doc_id long, start long, end long, of_doc long, of_start long")


#: Bytes of a stretch that are compared as one: its earlier place is cut at multiples of so many.
_CUT = 4096


def _to_verify(stretches: DataFrame) -> DataFrame:
    """Both sides of every stretch, in cuts: doc_id, start, size, and as key and hash the earlier place."""
    size = F.col("end") - F.col("start")
    cuts = stretches.withColumn("size", size)
    cuts = cuts.withColumn("cut", F.explode(F.sequence(F.expr(f"of_start div {_CUT}"), F.expr(f"(of_start + size - 1) div {_CUT}"))))
    low = F.greatest(F.col("of_start"), F.col("cut") * _CUT)
    cuts = cuts.withColumn("low", low).withColumn("size", F.least(F.col("of_start") + F.col("size"), (F.col("cut") + 1) * _CUT) - low)
    here = cuts.select("doc_id", (F.col("start") + F.col("low") - F.col("of_start")).alias("start"), "size", F.col("of_doc").alias("key"), F.col("low").alias("hash"))
    there = here.select(F.col("key").alias("doc_id"), F.col("hash").alias("start"), "size", "key", "hash").distinct()
    return here.unionByName(there)


def _listed(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray]]]:
    """The listed parts of a batch's texts (with start and size) some megabytes at a time: doc_id, bytes and the named
    fields of each. Parts that reach beyond their text are of another text under the same doc_id and left out."""
    parts = batch.column("parts")
    ends, flat = parts.offsets.to_numpy(), parts.flatten()
    fields = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "size", *names)}
    docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    held: list[bytes] = []
    stay: list[int] = []
    own, bytes_ = [], 0
    for row, raw in enumerate(raws):
        a, b = int(ends[row]), int(ends[row + 1])
        start, size = fields["start"][a:b].tolist(), fields["size"][a:b].tolist()
        for i, (s, z) in enumerate(zip(start, size, strict=True)):
            if s + z <= len(raw):
                held.append(raw[s : s + z])
                stay.append(a + i)
                own.append(row)
                bytes_ += z + 64
        if bytes_ > 4 << 20:
            yield docs[own], held, [fields[n][stay] for n in ("start", *names)]
            held, stay, own, bytes_ = [], [], [], 0
    if held:
        yield docs[own], held, [fields[n][stay] for n in ("start", *names)]


def _extract(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """key, hash, content, doc_id, start, windows, offset, sort of parts (doc_id, start, size and these) of the texts."""
    names = ("key", "hash", "windows", "offset", "sort")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content, (start, key, hash_, windows, offset, sort) in _listed(batch, names):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(hash_, pa.int64()), pa.array(content, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(windows, pa.int32()), pa.array(offset, pa.int32()), pa.array(sort, pa.bool_())],
                    ["key", "hash", "content", "doc_id", "start", "windows", "offset", "sort"],
                )

    lists = rows.join(parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", *names)).alias("parts")), "doc_id")
    return lists.mapInArrow(run, "key long, hash long, content binary, doc_id long, start long, windows int, offset int, sort boolean")


def _apart(rows: DataFrame, runs: DataFrame, rules: SuffixRules) -> DataFrame:
    """Every window of these runs (doc_id, start, size) as a run of its own, its anchor being its hash."""
    length, shift, salt = rules.length, 64 - rules.bits, rules.seed.to_bytes(8, "little")
    hashed = lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8, salt=salt).digest(), "little", signed=True) >> shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content, (start,) in _listed(batch, ()):
                n = np.array([len(c) - length + 1 for c in content])
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor = [hashed(c[i : i + length]) for c in content for i in range(len(c) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(np.repeat(doc, n), pa.int64()), pa.array(np.repeat(start, n) + within, pa.int64())], ["anchor", "doc_id", "start"])

    lists = rows.join(runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("parts")), "doc_id")
    out = lists.mapInArrow(run, "anchor long, doc_id long, start long")
    return out.select("anchor", F.lit(0).cast("long").alias("hash"), "doc_id", "start", F.lit(1).alias("windows"), F.lit(0).alias("offset"))


def _sorted_out(rows: DataFrame, rules: SuffixRules) -> DataFrame:
    """Spans (doc_id, start, end) of the repeated windows among runs, which stand together by key."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        contents = t.column("content").to_pylist()
        cols = [t.column(n).to_numpy().astype(np.int64) for n in ("key", "doc_id", "start", "windows", "offset")]
        # A repeated row brings its runs again, at the same places.
        order = np.lexsort(cols[3::-1])
        same = np.all([c[order[1:]] == c[order[:-1]] for c in cols[:4]], axis=0)
        gone = {int(order[i + 1]) for i in np.flatnonzero(same) if contents[order[i + 1]] == contents[order[i]]}
        if gone:
            stay = np.array([i for i in range(len(contents)) if i not in gone])
            contents, cols = [contents[i] for i in stay], [c[stay] for c in cols]
        hit = repeated_windows(contents, *cols, rules.length)
        hit = hit[np.lexsort((hit[:, 1], hit[:, 0]))]
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
        return pa.RecordBatch.from_arrays([pa.array(hit[first, 0]), pa.array(hit[first, 1]), pa.array(hit[last, 1] + rules.length)], ["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            windows, sizes = batch.column("windows").to_numpy(), np.array([len(c) for c in batch.column("content").to_pylist()])
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                more, bytes_ = int(windows[a:b].sum()), int(sizes[a:b].sum())
                fresh = not held or held[-1].column("key")[-1].as_py() != int(keys[a])
                if held and fresh and (n + more > rules.batch or size + bytes_ > _SPACE // 2):
                    yield settle(held)
                    held, n, size = [], 0, 0
                held.append(batch.slice(a, b - a))
                n, size = n + more, size + bytes_
        if held:
            yield settle(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start long, end long")


_KIND = ["anchor", "hash", "windows", "offset"]


def _kinds(runs: DataFrame) -> DataFrame:
    """Runs with equal hashes: how many, and the first."""
    return runs.groupBy(*_KIND).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))


def _not_first(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The runs of kinds that several runs have, but for each kind's first, and where that one is."""
    later = F.struct("doc_id", "start") != F.col("first")
    found = runs.join(kinds.where("n > 1").select(*_KIND, "first"), _KIND).where(later)
    return found.select("doc_id", "start", "windows", F.col("first.doc_id").alias("of_doc"), F.col("first.start").alias("of_start"))


def _attempt(rows: DataFrame, rules: SuffixRules, scratch: Scratch) -> DataFrame | None:
    """The repeated spans, or nothing if one hash stands for two contents."""
    again = scratch.write(_runs(rows, rules, True).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    scratch.collect_shuffles()
    runs = scratch.write(_runs(rows, rules, False).join(again, "anchor", "left_semi").withColumnRenamed("content", "hash"))
    scratch.free(again)
    scratch.collect_shuffles()
    kinds = scratch.write(_kinds(runs))
    scratch.collect_shuffles()
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    size = (F.col("windows") - 1 + rules.length).cast("long").alias("size")
    mixed = kinds.join(several, "anchor").select("first.doc_id", "first.start", size, F.col("anchor").alias("key"), "windows", "offset", "kinds")
    mixed = scratch.write(mixed)
    repeats, made = _not_first(runs, kinds), [runs, kinds]
    crowded = mixed.where(F.col("kinds") > rules.group)
    if crowded.limit(1).count():
        windows = scratch.write(_apart(rows, crowded, rules))
        shared = scratch.write(_kinds(windows).where("n > 1"))
        repeats = repeats.unionByName(_not_first(windows, shared))
        made += [windows, shared]
    stretches = scratch.write(_joined(repeats, rules))
    scratch.free(*made)
    # One more pass over the texts for all contents: those to sort, and those to verify.
    sort = mixed.where(F.col("kinds") <= rules.group).select("doc_id", "start", "size", "key", F.lit(0).cast("long").alias("hash"), "windows", "offset", F.lit(True).alias("sort"))
    check, repeated = _to_verify(stretches), rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.limit(1).count():  # an id of several rows may have several texts, and a place none of its own
        check = check.join(repeated, "doc_id", "left_anti").join(repeated.withColumnRenamed("doc_id", "key"), "key", "left_anti")
    wanted = sort.unionByName(check.withColumn("windows", F.lit(0)).withColumn("offset", F.lit(0)).withColumn("sort", F.lit(False)))
    contents = scratch.write(_extract(rows, wanted))
    scratch.free(mixed)
    scratch.collect_shuffles()
    distinct = contents.where("not sort").select("key", "hash", F.length("content").alias("size"), "content").distinct()
    if distinct.groupBy("key", "hash", "size").agg(F.count("*").alias("strings")).where("strings > 1").limit(1).count():
        return None
    out = scratch.write(_sorted_out(contents.where("sort").drop("hash", "sort"), rules))
    scratch.free(contents)
    return stretches.select("doc_id", "start", "end").unionByName(out)


def repeated_spans(docs: DataFrame, rules: SuffixRules, scratch: Scratch) -> DataFrame:
    """doc_id, start, end (bytes) of spans that windows cover which start earlier too; spans may overlap."""
    rows = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    for k in range(rules.attempts):
        out = _attempt(rows, replace(rules, seed=rules.seed + k, bits=64 if k else rules.bits), scratch)
        if out is not None:
            return out
    raise ArithmeticError(f"contents with one hash under each of {rules.attempts} seeds")


def dedup_substrings(docs: DataFrame, rules: SuffixRules = SuffixRules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes), kept (the bytes left) and the columns named in
    `keep`, per row of docs.

    Null and empty texts have no bytes; texts under a window's length lose none. Rows that repeat a doc_id
    and its text count as one document; where texts differ under one doc_id, spans found in either apply
    to both, within their length. Rows without a doc_id take no part and lose nothing. An empty table gives no rows. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    spans = repeated_spans(docs, rules, scratch)
    scratch.collect_shuffles()
    per = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    rows = columns_of(docs, "doc_id", "text", *keep).withColumn("doc_id", F.col("doc_id").cast("long")).join(per, "doc_id", "left")
    also = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out: list[dict[str, int]] = []
                for f in found or ():
                    start, end = f["start"], min(f["end"], len(raw))
                    if out and start <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], end)
                    elif start < end:
                        out.append({"start": start, "end": end})
                edge = [0, *(x for s in out for x in (s["start"], s["end"])), len(raw)]
                sizes.append(len(raw))
                merged.append(out)
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)) if out else raw)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary()), *(batch.column(k) for k in keep)], ["doc_id", "n_bytes", "spans", "kept", *keep])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + also)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's removed bytes and the checksum of what is left."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
