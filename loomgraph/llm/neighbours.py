"""Operator 2, approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample (`sample` vectors); every vector
is then indexed: its nearest centroid's list and one byte a subspace of what is left. A query looks into
its nearest lists, as many as the sample shows to be needed, with asymmetric distance tables, keeps the `depth` best by them, and these
are ranked again by the exact distance in double precision.

Equal vectors are one entry that carries its smallest ids, so a vector with a third of all rows is one
row of the index. Lists are searched in bundles of bounded size: small lists share one, a long list fills
several. A query travels once to every bundle that holds one of its lists, not once a list, and a bundle's
tables and sums are made for a block of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch


@dataclass(frozen=True)
class AnnRules:
    """Production parameters."""

    neighbours: int = 10
    #: Bound on the vectors that the index is fitted on.
    sample: int = 20_000
    #: Lists: so many times the root of the entries, within this bound. The finer they are, the smaller the
    #: part of the entries that the probed ones hold.
    lists: float = 4
    most_lists: int = 4096
    #: A query looks into as many lists as hold this part of the sample's own nearest neighbours, measured
    #: with `trials` of its vectors, and into at least `least_probes`.
    target: float = 0.96
    trials: int = 256
    least_probes: int = 8
    #: Components of a subspace, and codewords in each.
    width: int = 4
    codewords: int = 256
    #: Entries that each query ranks again.
    depth: int = 200
    #: Entries of a bundle, and queries compared with it at a time.
    block: int = 8_192
    query_block: int = 2_000
    rounds: int = 12
    seed: int = 2


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k of the points; an empty cluster takes a random point."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        some = np.flatnonzero(n)
        total[some] = np.add.reduceat(x[np.argsort(own, kind="stable")], (np.cumsum(n) - n)[some], axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


@dataclass
class Index:
    """What was fitted: coarse centroids, and a codebook for each subspace (its columns and codewords);
    and the lists and codes of the sample itself, which bound what a query need return from a list."""

    centroids: np.ndarray
    columns: list[np.ndarray]
    books: list[np.ndarray]
    lists: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, lists: int, rules: AnnRules) -> Index:
        rng = np.random.default_rng(rules.seed)
        centroids = kmeans(x, min(lists, len(x)), rules.rounds, rng)
        left = x - centroids[_nearest(x, centroids)]
        columns = np.array_split(np.arange(x.shape[1]), max(1, -(-x.shape[1] // rules.width)))
        index = Index(centroids, columns, [kmeans(left[:, c], min(rules.codewords, len(x)), rules.rounds, rng) for c in columns], [])
        own, codes = index.encode(x)
        index.lists = [codes[own == k] for k in range(len(centroids))]
        return index

    def approximate(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances of one list's entries (rows) from queries (columns), the sums of their tables' cells."""
        near = np.zeros((len(codes), len(q)), np.float32)
        left = q - self.centroids[which]
        for column, c, b in zip(codes.T, self.columns, self.books, strict=True):
            part = left[:, c]
            table = ((b * b).sum(1)[:, None] - 2 * (b @ part.T) + (part * part).sum(1)).astype(np.float32)
            near += table[column]
        return near

    def probed(self, q: np.ndarray, n: int) -> np.ndarray:
        """Which lists (columns) each query (row) looks into."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(out, self.probes(q, n), True, 1)
        return out

    def bounds(self, q: np.ndarray, n: int, rank: int) -> np.ndarray:
        """By the tables, the distance of each query's rank-th best sample entry in its probed lists."""
        probed, found = self.probed(q, n), np.full((len(q), sum(map(len, self.lists))), np.inf, np.float32)
        at = 0
        for which, codes in enumerate(self.lists):
            own = np.flatnonzero(probed[:, which])
            if len(own) and len(codes):
                found[own, at : at + len(codes)] = self.approximate(q[own], which, codes).T
            at += len(codes)
        return np.partition(found, rank - 1, axis=1)[:, rank - 1] if rank <= found.shape[1] else np.full(len(q), np.inf, np.float32)

    def probes_for(self, x: np.ndarray, rules: AnnRules) -> int:
        """How many lists hold the target part of the exact nearest neighbours among the sample."""
        trial = x[np.random.default_rng(rules.seed + 1).permutation(len(x))[: rules.trials]]
        own, ranks = _nearest(x, self.centroids), []
        for q in trial:
            near = np.argsort(_distances(q[None], x)[0], kind="stable")[1 : rules.neighbours + 1]
            place = np.empty(len(self.centroids), np.int64)
            place[np.argsort(_distances(q[None], self.centroids)[0], kind="stable")] = np.arange(len(self.centroids))
            ranks += place[own[near]].tolist()
        needed = int(np.quantile(ranks, rules.target, method="higher")) + 1 if ranks else 1
        return min(len(self.centroids), max(rules.least_probes, needed))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centroids)
        left = x - self.centroids[own]
        return own, np.stack([_nearest(left[:, c], b) for c, b in zip(self.columns, self.books, strict=True)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(_distances(q, self.centroids), axis=1, kind="stable")[:, :n]


def usable(vector: str) -> str:
    """SQL condition: not null, not empty, every component finite, one not zero."""
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"{vector} is not null and size({vector}) > 0 and coalesce({finite}, false) and exists({vector}, x -> x <> 0)"


def search(vectors: DataFrame, is_query: str, rules: AnnRules = AnnRules()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query among all rows but its own.

    Rows without a vec_id, and vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those
    whose length isn't the sample's most common one. Equal distances go to smaller ids. An empty table
    gives none. Rows of one vec_id with different vectors are rows each.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null").where(usable("v"))
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rules.neighbours + 1)
    entries = scratch.write(few.groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.orderBy(F.xxhash64("cid", F.lit(rules.seed)), "cid").limit(rules.sample).select("v").collect()
    if not sample:
        return empty
    lengths = np.bincount([len(r["v"]) for r in sample])
    dim = int(lengths.argmax())
    entries = entries.where(F.size("v") == dim)
    x = np.array([r["v"] for r in sample if len(r["v"]) == dim])
    total = entries.count()
    lists = max(1, min(rules.most_lists, int(rules.lists * total**0.5)))
    index = spark.sparkContext.broadcast(Index.fit(x, lists, rules))
    n_probes = index.value.probes_for(x, rules)
    asked = rows.where(is_query).where(F.size("v") == dim).select(F.col("vec_id").alias("query_id"), "v")
    asked = scratch.write(asked.join(entries.select("v", "cid"), "v").select("query_id", F.col("cid").alias("qid")))

    def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = index.value.encode(_matrix(batch, "v"))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["cid", "list", "codes"])

    coded = scratch.write(entries.select("cid", "v").mapInArrow(encode, "cid long, list int, codes binary"))
    wanted = entries.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), "v")
    # Bundles: lists in turn, until they hold a block. One row a list, so within most_lists.
    sizes = np.zeros(len(index.value.centroids), np.int64)
    for row in coded.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[row["list"]] = row["n"]
    parts = np.maximum(1, -(-sizes // rules.block))
    first, at, room = np.zeros(len(sizes), np.int64), -1, 0
    for which, n in enumerate(sizes.tolist()):
        if parts[which] > 1 or n > room or at < 0:
            at, room = at + 1, rules.block
        first[which], room = at, room - n
        if parts[which] > 1:
            at, room = at + int(parts[which]) - 1, 0
    spread = spark.createDataFrame([(k, int(f), int(p)) for k, (f, p) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int")
    # What the shortlist is cut at: a rank in the sample that stands for about `depth` and a half of all entries.
    rank = min(rules.depth, max(3 * rules.neighbours, -(-3 * rules.depth * len(x) // (2 * total))))
    asked_n = wanted.count()
    cuts = max(1, -(-asked_n // rules.query_block))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                q = _matrix(part, "v")
                near, most = index.value.probed(q, n_probes), index.value.bounds(q, n_probes, rank)
                goes = [np.unique(np.concatenate([np.arange(first[k], first[k] + parts[k]) for k in np.flatnonzero(row)])) for row in near]
                at = np.repeat(np.arange(len(q)), [len(g) for g in goes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(goes), pa.int32()), part.column("qid").take(pa.array(at)), part.column("v").take(pa.array(at)), pa.array(most[at], pa.float32())], ["bundle", "qid", "v", "most"])

    left = (
        coded.join(F.broadcast(spread), "list").withColumn("bundle", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        .select("bundle", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"), "list", "cid", "codes")
    )
    right = wanted.mapInArrow(probe, "bundle int, qid long, v array<double>, most float").withColumn("cut", F.pmod(F.xxhash64("qid"), F.lit(cuts)).cast("int"))
    depth = rules.depth

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if len(a) and len(b):
            a = a.sort_values(["list", "cid"])
            which, ids = a["list"].to_numpy(), a["cid"].to_numpy()
            codes = np.frombuffer(b"".join(a["codes"]), np.uint8).reshape(len(a), -1)
            q, qid, most = np.stack(b["v"].to_list()), b["qid"].to_numpy(), b["most"].to_numpy()
            probed = index.value.probed(q, n_probes)
            begin = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(which)], strict=True):
                own = np.flatnonzero(probed[:, which[i]])
                near = index.value.approximate(q[own], int(which[i]), codes[i:j])
                entry, query = np.nonzero(near <= most[own])
                found.append((own[query], ids[i:j][entry], near[entry, query]))
        row, cid, near = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((cid, near, row))
        row, cid, near = row[order], cid[order], near[order]
        start = np.searchsorted(row, row)
        best = np.arange(len(row)) - start < depth
        return pd.DataFrame({"qid": qid[row[best]] if len(row) else row, "cid": cid[best], "near": near[best]})

    keys = ["bundle", "cut"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "qid long, cid long, near float")
    by_near = Window.partitionBy("qid").orderBy("near", "cid")
    short = found.withColumn("k", F.row_number().over(by_near)).where(F.col("k") <= depth).select("qid", "cid")
    short = short.unionByName(wanted.select("qid", F.col("qid").alias("cid"))).distinct()
    exact = F.sqrt(F.aggregate(F.zip_with("qv", "v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))
    scored = (
        short.join(wanted.select("qid", F.col("v").alias("qv")), "qid").join(entries, "cid")
        .select("qid", exact.alias("score"), F.explode("ids").alias("vec_id"))
    )
    by_score = Window.partitionBy("qid").orderBy("score", "vec_id")
    best = scored.withColumn("k", F.row_number().over(by_score)).where(F.col("k") <= rules.neighbours + 1)
    best = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    own = F.slice(F.filter("best", lambda e: e["vec_id"] != F.col("query_id")), 1, rules.neighbours)
    out = asked.join(best, "qid").select("query_id", F.posexplode(own).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose vec_id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
