"""Operator 3, MinHash near-dedup: a chosen-path set similarity join.

A document is its set of distinct word shingles; equal sets are one class from the start. Rows of one
doc_id with different texts are one document: their classes are tied by a link of their own. Each of several
independent trees sends a class down the path of its minwise tokens, one token a level. A node with few
classes is a leaf, and its classes are compared exhaustively by their minhash sketches; a node with more
branches on the next token. At the last level a node that is still large is one group, by a link each to
its smallest class; comparing it in blocks shows its best-linked classes, and two trees are enough for that.
A pair at the threshold J shares a leaf of depth d with probability 1 - (1 - J ** d) ** trees; `trees` is chosen so that leaves at the last level, where only crowded nodes get,
miss it with a probability under `miss` (leaves at the first level: far under). The sketches of a leaf are
compared five standard deviations below the threshold.

The trees only propose: their links join classes into coarse groups, and in each group the full sets are
then compared exactly until every document is linked or refused. A group too large for one task is
compared in blocks, each together with the group's hubs (its best-linked classes); documents that this
leaves outside the group's main component are compared with every block. So no link depends on a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, columns_of, components, slices

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearRules:
    """Production parameters. Link where 100 * intersection >= percent * union."""

    shingle: int = 3
    percent: int = 85
    #: Probability with which all trees miss a pair at exactly the threshold, in leaves at the last level.
    miss: float = 1e-4
    #: Levels of the first and the last node of a path.
    first: int = 3
    last: int = 5
    #: Classes a leaf holds at most.
    leaf: int = 256
    #: Classes, and shingles, of a group that one task compares; larger groups are cut into blocks.
    block: int = 2000
    block_shingles: int = 4_000_000
    hubs: int = 16

    @property
    def trees(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - min(0.99, self.percent / 100) ** self.last))

    @property
    def lenient(self) -> float:
        """The sketch similarity from which the trees propose: five standard deviations under the threshold."""
        j, k = self.percent / 100, self.trees * self.last
        return j - 5 * math.sqrt(max(j * (1 - j), 0.05) / k)


class _Hashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; of fewer words, the one of all of them."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, split), np.uint64, len(split))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minhash values (uint32) of every set; sets may not be empty."""
    xor, odd = _functions(n)
    out = np.empty((len(sets), n), np.uint32)
    at = 0
    while at < len(sets):  # so many sets at a time that they stay in the cache
        upto, held = at, 0
        while upto < len(sets) and (upto == at or held + len(sets[upto]) <= 1 << 15):
            held += len(sets[upto])
            upto += 1
        tokens = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        start = np.cumsum([0] + [len(s) for s in sets[at : upto - 1]])
        room = np.empty_like(tokens)
        for f in range(n):
            np.bitwise_xor(tokens, xor[f], out=room)
            np.multiply(room, odd[f], out=room)
            out[at:upto, f] = np.minimum.reduceat(room, start)
        at = upto
    return out


def _sketches(sig: np.ndarray) -> np.ndarray:
    """One byte of every minhash value, mixed from all four."""
    return ((sig * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, which with its size name its class."""
    return int((s * _MULTIPLY).sum(dtype=np.uint64).astype(np.int64)), int(_mix(s ^ np.uint64(77)).sum(dtype=np.uint64).astype(np.int64))


def _sign(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, n_shingles, the set's hash (h1, h2), its minhash values and its sketch (null for empty sets)."""
    n = rules.trees * rules.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = [shingle_set(t, rules.shingle) for t in batch.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], n) if full else np.zeros((0, n), np.uint32)
                sketch, place = _sketches(sig), {i: k for k, i in enumerate(full)}
                h1, h2 = zip(*map(set_hash, sets), strict=True) if sets else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                        pa.array([sig[place[i]].astype("<u4").tobytes() if i in place else None for i in range(len(sets))], pa.binary()),
                        pa.array([sketch[place[i]].tobytes() if i in place else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "sig", "sketch"],
                )

    rows = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, sketch binary")


def leaf_links(ids: np.ndarray, sketch: np.ndarray, lenient: float) -> list[tuple[int, int]]:
    """(hub, other) links that join the classes of one leaf whose sketches are alike: exhaustive comparison,
    then a star round the best-linked class of each component."""
    n, width = sketch.shape
    near = np.zeros((n, n), bool)
    for i in range(n):
        near[i, i + 1 :] = (sketch[i + 1 :] == sketch[i]).sum(1, dtype=np.int32) >= lenient * width
    near |= near.T
    degree, label, links = near.sum(1), np.full(n, -1), []
    for hub in np.lexsort((ids, -degree)):
        if label[hub] >= 0 or not degree[hub]:
            continue
        label[hub], front = hub, [hub]
        while front:
            found = np.flatnonzero(near[front].any(0) & (label < 0))
            label[found] = hub
            links += [(int(ids[hub]), int(ids[j])) for j in found]
            front = found.tolist()
    return links


def _propose(reps: DataFrame, rules: NearRules, scratch: Scratch) -> DataFrame:
    """Links (a, b) from the leaves of all trees; a is a hub."""
    width = rules.trees * rules.last

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            flat, sizes = batch.column("leaf").flatten(), pc.list_value_length(batch.column("leaf")).to_numpy()
            starts = np.cumsum(sizes) - sizes
            ids = flat.field("rep").to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, width)
            two = starts[sizes == 2]
            same = (raw[two] == raw[two + 1]).sum(1, dtype=np.int32) >= rules.lenient * width
            links += zip(ids[two[same]].tolist(), ids[two[same] + 1].tolist(), strict=True)
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                links += leaf_links(ids[start : start + size], raw[start : start + size], rules.lenient)
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def paths(rows: DataFrame, depth: int) -> DataFrame:
        """key, rep and tree of the nodes at a depth; rows has rep, tree and the path of rep in it."""
        return rows.select(F.xxhash64("tree", F.substring("path", 1, 4 * depth)).alias("key"), "rep", "tree")

    way = F.expr(f"substring(sig, tree * {4 * rules.last} + 1, {4 * rules.last})").alias("path")
    every = reps.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(rules.trees - 1))).alias("tree")).select("rep", "tree", way)
    sketches = reps.select("rep", "sketch")
    active, links = every, []
    for depth in range(rules.first, rules.last + 1):
        nodes = paths(active, depth)
        counts = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
        held = scratch.write(nodes.join(counts, "key"))
        leaves = held.where(F.col("n") <= rules.leaf).select("key", "rep")
        large = held.where(F.col("n") > rules.leaf)
        some = large.limit(1).count()
        if depth == rules.last and some:
            part = F.pmod(F.xxhash64("rep", F.lit(depth)), F.ceil(F.col("n") / rules.leaf * 2))
            leaves = leaves.unionByName(large.where("tree < 2").select(F.xxhash64("key", part).alias("key"), "rep"))
        # Classes that are alike meet in many trees: each different set of classes gets its sketches once.
        sets = leaves.groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("reps")).select("reps").distinct()
        members = sets.select(F.xxhash64("reps").alias("set"), F.explode("reps").alias("rep"))
        boxes = members.join(sketches, "rep").groupBy("set").agg(F.collect_list(F.struct("rep", "sketch")).alias("leaf"))
        links.append(scratch.write(boxes.select("leaf").mapInArrow(compare, "a long, b long")))
        if some:
            if depth == rules.last:
                # Their blocks belong to one coarse group; the exact comparison parts what this joins wrongly.
                links.append(scratch.write(large.select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a <> b")))
            else:
                active = scratch.write(large.select("rep", "tree").join(reps.select("rep", "sig"), "rep").select("rep", "tree", way))
        scratch.free(held)
        if not some:
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    out = scratch.write(out.distinct())
    scratch.free(*links)
    return out


def _linked(one: np.ndarray, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets (their tokens concatenated, owner by token) are linked with the set `one`."""
    at = np.searchsorted(one, tokens)
    at[at == len(one)] = 0
    shared = np.bincount(owner[one[at] == tokens], minlength=len(sizes))
    return 100 * shared >= percent * (sizes + len(one) - shared)


#: Buckets of the counts that bound an intersection.
_BUCKETS = 512


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of every set fall into each bucket (a row per set). The sum of the smaller counts
    of two sets is at least their intersection, so it refuses no pair that is linked."""
    out = np.zeros((len(sets), _BUCKETS), np.int32)
    for row, one in zip(out, sets, strict=True):
        row += np.bincount((one & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS).astype(np.int32)
    return out


def _expand(one: int, others: np.ndarray, sets: list[np.ndarray], size: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Those of `others` that the set `one` is linked with: exact bounds by size and by counts, then the full sets."""
    low, high = np.minimum(size[others], size[one]), np.maximum(size[others], size[one])
    others = others[100 * low >= percent * high]
    found = [others[:0]]
    for k in range(0, len(others), 256):
        part = others[k : k + 256]
        most = np.minimum(counts[part], counts[one]).sum(1)
        part = part[100 * most >= percent * (size[part] + size[one] - most)]
        if len(part):
            owner = np.repeat(np.arange(len(part)), size[part])
            found.append(part[_linked(sets[one], np.concatenate([sets[i] for i in part]), owner, size[part], percent)])
    return np.concatenate(found)


def exact_links(ids: list[int], sets: list[np.ndarray], rules: NearRules, first: list[bool] | None = None) -> list[tuple[int, int]]:
    """(root, other) links of the exact components of a group of different classes: each in turn reaches,
    among those not yet in any component, all that it is linked with."""
    place = sorted(range(len(ids)), key=lambda i: (not (first and first[i]), ids[i]))
    sets = [sets[i] for i in place]
    size, counts = np.array([len(s) for s in sets]), _counts(sets)
    free, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not free[root]:
            continue
        free[root], front = False, [root]
        while front:
            one = front.pop()
            found = _expand(one, np.flatnonzero(free), sets, size, counts, rules.percent)
            free[found] = False
            links += [(ids[place[root]], ids[place[j]]) for j in found]
            front += found.tolist()
    return links


def cross_links(left: pd.DataFrame, right: pd.DataFrame, rules: NearRules) -> list[tuple[int, int]]:
    """Links between the classes of two blocks (cid, label, set) whose labels differ; each label pair once."""
    ids = [*left["cid"], *right["cid"]]
    sets = [*left["set"], *right["set"]]
    label = np.array([*left["label"], *right["label"]])
    size, counts = np.array([len(s) for s in sets]), _counts(sets)
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    links = []
    for i in range(len(left), len(ids)):
        own = top(int(label[i]))
        tops = np.array([top(int(x)) for x in label[: len(left)]])
        for j in _expand(i, np.flatnonzero(tops != own), sets, size, counts, rules.percent):
            other = top(int(label[j]))
            if other != top(own):
                joined[other] = top(own)
                links.append((int(ids[i]), int(ids[j])))
    return links


def _with_sets(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """One row per class, with its set. A class's text comes by doc_id, which may have other texts too:
    those of another class are left out, and so are repeated rows."""
    sets, seen, keep = [], set(), []
    for i, (cid, text, h1, h2) in enumerate(zip(pdf["cid"], pdf["text"], pdf["h1"], pdf["h2"], strict=True)):
        if cid in seen:
            continue
        one = shingle_set(text, size)
        if set_hash(one) == (h1, h2):
            seen.add(cid)
            keep.append(i)
            sets.append(one)
    return pdf.iloc[keep].drop(columns=["text"]).assign(set=pd.Series(sets, dtype=object).to_numpy())


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs.

    Null and empty texts have empty sets and are linked with nothing. Rows with one doc_id are one document:
    each row is returned with its own text's n_shingles, and whatever one of its texts is linked with is
    linked with all of them. Rows without a doc_id are kept and linked with nothing. Texts are read whole.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.write(_sign(docs, rules))
    key = ["h1", "h2", "n_shingles"]
    some_id = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some_id.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    # Written at once: a class's number is unique by its partition and row, and stays what it is.
    wide = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()))
    classes = scratch.write(wide.select("cid", "doc_id", *key))
    narrow = scratch.write(signed.select("doc_id", *key))
    scratch.free(signed)
    signed, some_id = narrow, narrow.where("n_shingles > 0 and doc_id is not null")
    proposed = _propose(wide.select(F.col("cid").alias("rep"), "sig", "sketch"), rules, scratch)
    scratch.free(wide)
    coarse = scratch.write(components(proposed, scratch).withColumnRenamed("node", "cid"))
    scratch.collect_shuffles()

    sized = coarse.join(classes.select("cid", *key, "doc_id"), "cid")
    parts = F.greatest(F.ceil(F.count("*") / rules.block), F.ceil(F.sum("n_shingles") / rules.block_shingles))
    groups = scratch.write(sized.groupBy("root").agg(parts.cast("int").alias("parts")))
    block = F.pmod(F.xxhash64("h1", F.lit(5)), F.col("parts")).cast("int")
    members = sized.join(groups, "root").select("root", "cid", "doc_id", "h1", "h2", "parts", block.alias("part"))
    some = groups.where("parts > 1").limit(1).count()
    texts = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = members.select("root", "part", "cid", "doc_id", "h1", "h2", F.lit(False).alias("hub"))
    if some:
        degree = proposed.groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("degree"))
        best = Window.partitionBy("root").orderBy(F.desc("degree"), "h1", "cid")
        hubs = members.where("parts > 1").join(degree, "cid").withColumn("k", F.row_number().over(best)).where(F.col("k") <= rules.hubs)
        hubs = hubs.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "doc_id", "h1", "h2", F.lit(True).alias("hub"))
        rows = rows.unionByName(hubs)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        one = _with_sets(pdf.sort_values("hub", ascending=False, kind="stable"), rules.shingle)
        return pd.DataFrame(exact_links(one["cid"].tolist(), one["set"].tolist(), rules, one["hub"].tolist()), columns=["a", "b"])

    links = scratch.write(rows.join(texts, "doc_id").groupBy("root", "part").applyInPandas(local, "a long, b long"))
    if some:
        links = scratch.write(links.unionByName(_across(members.where("parts > 1"), links, texts, rules, scratch)))
    # Documents with several texts: their classes belong together. Few rows are left of a narrow aggregate.
    differ = [F.min(k) != F.max(k) for k in key]
    several = some_id.groupBy("doc_id").agg((differ[0] | differ[1] | differ[2]).alias("differ")).where("differ").select("doc_id")
    several = some_id.join(several, "doc_id").join(classes.select("cid", *key), key).select("doc_id", "cid").distinct()
    least = several.groupBy("doc_id").agg(F.min("cid").alias("a"))
    links = links.unionByName(several.join(least, "doc_id").select("a", F.col("cid").alias("b")).where("a <> b"))
    found = components(links, scratch)
    # A component's number is the smallest doc_id of its classes.
    named = classes.select("cid", *key, "doc_id").join(found.select(F.col("node").alias("cid"), "root"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid")).select(*key, "doc_id", "root")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    roots = named.join(smallest, "root").select(*key, "component_id")
    out = signed.select("doc_id", *key).join(roots, key, "left")
    component = F.coalesce("component_id", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _across(members: DataFrame, links: DataFrame, texts: DataFrame, rules: NearRules, scratch: Scratch) -> DataFrame:
    """Links between blocks of large groups: what is outside a group's main component meets every block."""
    found = components(links, scratch).select(F.col("node").alias("cid"), F.col("root").alias("label"))
    with_text = ["cid", "doc_id", "h1", "h2"]
    rows = members.join(found, "cid", "left").select("root", "part", "parts", *with_text, F.coalesce("label", "cid").alias("label"))
    rows = scratch.write(rows)
    most = rows.groupBy("root", "label").agg(F.count("*").alias("n"))
    main = most.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = rows.join(main, "root").where("label <> main").select("root", *with_text, "label", "parts")
    cuts = rest.groupBy("root").agg(F.ceil(F.count("*") / rules.block).cast("int").alias("cuts"))
    rest = rest.join(cuts, "root").withColumn("cut", F.pmod(F.xxhash64("h1", F.lit(9)), F.col("cuts")).cast("int"))
    right = rest.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cut", *with_text, "label").join(texts, "doc_id")
    left = rows.join(cuts, "root").select("root", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), *with_text, "label").join(texts, "doc_id")

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["a", "b"])
        return pd.DataFrame(cross_links(_with_sets(a, rules.shingle), _with_sets(b, rules.shingle), rules), columns=["a", "b"])

    # New names inside the plan: both sides come from the same tables.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["root", "part", "cut"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pairs, "a long, b long")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
