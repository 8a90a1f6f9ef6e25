"""Dense tensors as tables: a row per cell, its indices d0, d1, ... and its value v (ML1-ML5).

A tensor is its table and its shape. Cells carry their own place, so every operation is a projection, an equality
join or an aggregate, and no task holds a tensor. Sizes of 1 are broadcast in arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _dims(n: int) -> list[str]:
    return [f"d{i}" for i in range(n)]


@dataclass(frozen=True)
class Tensor:
    cells: DataFrame
    shape: tuple[int, ...]

    @property
    def dims(self) -> list[str]:
        return _dims(len(self.shape))

    # Made and laid out (ML1)

    def view(self, *shape: int) -> Tensor:
        """The same cells in row-major order under another shape."""
        if math.prod(shape) != math.prod(self.shape):
            raise ValueError(f"{self.shape} and {shape} have different numbers of cells")
        return from_flat(self.cells.select(self._flat().alias("at"), "v"), shape)

    def _flat(self) -> Column:
        out = F.lit(0).cast("long")
        for d, n in zip(self.dims, self.shape, strict=True):
            out = out * n + F.col(d)
        return out

    def swap_axes(self, a: int, b: int) -> Tensor:
        order = list(range(len(self.shape)))
        order[a], order[b] = order[b], order[a]
        return Tensor(self.cells.select(*[F.col(f"d{o}").alias(f"d{i}") for i, o in enumerate(order)], "v"), tuple(self.shape[o] for o in order))

    def transpose(self) -> Tensor:
        return self.swap_axes(0, 1)

    def squeeze(self) -> Tensor:
        """Without dimensions of size 1."""
        keep = [i for i, n in enumerate(self.shape) if n != 1]
        return Tensor(self.cells.select(*[F.col(f"d{k}").alias(f"d{i}") for i, k in enumerate(keep)], "v"), tuple(self.shape[k] for k in keep))

    def expand(self, *shape: int) -> Tensor:
        """Dimensions of size 1 repeated up to a shape."""
        cells = self.cells
        for d, own, n in zip(self.dims, self.shape, shape, strict=True):
            if own != n:
                if own != 1:
                    raise ValueError(f"dimension of size {own} can't become {n}")
                cells = cells.withColumn(d, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return Tensor(cells, tuple(shape))

    def unbind(self, dim: int = 0) -> list[Tensor]:
        """The tensors along a dimension."""
        return [self.at(*([None] * dim), k) for k in range(self.shape[dim])]

    # Reduced and multiplied (ML2)

    def reduce(self, how: Callable[[str], Column], dim: int | None = None, keep: bool = False) -> Tensor:
        """Cells under an aggregate: all, or along one dimension."""
        if dim is None:
            return Tensor(self.cells.agg(how("v").alias("v")), ())
        rest = [d for i, d in enumerate(self.dims) if i != dim]
        out = self.cells.groupBy(*rest).agg(how("v").alias("v"))
        if keep:
            return Tensor(out.withColumn(f"d{dim}", F.lit(0).cast("long")).select(*self.dims, "v"), tuple(1 if i == dim else n for i, n in enumerate(self.shape)))
        return Tensor(out.select(*[F.col(d).alias(f"d{i}") for i, d in enumerate(rest)], "v"), tuple(n for i, n in enumerate(self.shape) if i != dim))

    def sum(self, dim: int | None = None, keep: bool = False) -> Tensor:
        return self.reduce(F.sum, dim, keep)

    def max(self, dim: int | None = None, keep: bool = False) -> Tensor:
        return self.reduce(F.max, dim, keep)

    def argmax(self, dim: int) -> Tensor:
        """The index of the largest cell along a dimension, the first of equals."""
        return self.reduce(lambda v: -F.max(F.struct(F.col(v), (-F.col(f"d{dim}")).alias("i")))["i"], dim)

    def log_sum_exp(self, dim: int | None = None) -> Tensor:
        """Moved by the largest cell, so nothing overflows."""
        top = self.max(dim, keep=dim is not None)
        moved = self.combine(top, lambda a, b: F.exp(a - b)) if dim is not None else Tensor(self.cells.join(top.cells.select(F.col("v").alias("w"))).select(*self.dims, F.exp(F.col("v") - F.col("w")).alias("v")), self.shape)
        low = self.max(dim)
        return moved.sum(dim).combine(low, lambda a, b: F.ln(a) + b)

    def matmul(self, other: Tensor) -> Tensor:
        """The product over this one's last and the other's first dimension: vectors, matrices or one of each."""
        if self.shape[-1] != other.shape[0]:
            raise ValueError(f"{self.shape} and {other.shape} don't fit")
        n = len(self.shape) - 1
        left = self.cells.select(*_dims(n), F.col(f"d{n}").alias("k"), F.col("v").alias("a"))
        right = other.cells.select(F.col("d0").alias("k"), *[F.col(f"d{i}").alias(f"d{n + i - 1}") for i in range(1, len(other.shape))], F.col("v").alias("b"))
        shape = (*self.shape[:-1], *other.shape[1:])
        return Tensor(left.join(right, "k").groupBy(*_dims(len(shape))).agg(F.sum(F.col("a") * F.col("b")).alias("v")), shape)

    def outer(self, other: Tensor) -> Tensor:
        """Every cell times every other; the result has as many cells as that."""
        n = len(self.shape)
        right = other.cells.select(*[F.col(f"d{i}").alias(f"d{n + i}") for i in range(len(other.shape))], F.col("v").alias("b"))
        shape = (*self.shape, *other.shape)
        return Tensor(self.cells.crossJoin(right).select(*_dims(len(shape)), (F.col("v") * F.col("b")).alias("v")), shape)

    # Cell by cell (ML3)

    def combine(self, other: Tensor | float, how: Callable[[Column, Column], Column]) -> Tensor:
        if not isinstance(other, Tensor):
            return Tensor(self.cells.select(*self.dims, how(F.col("v"), F.lit(float(other))).alias("v")), self.shape)
        shape = tuple(max(a, b) for a, b in zip(self.shape, other.shape, strict=True))
        left, right = self.expand(*shape), other.expand(*shape)
        both = right.cells.select(*right.dims, F.col("v").alias("w"))
        return Tensor((left.cells.join(both, right.dims) if right.dims else left.cells.join(both)).select(*right.dims, how(F.col("v"), F.col("w")).alias("v")), shape)

    def __add__(self, other):
        return self.combine(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self.combine(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self.combine(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self.combine(other, lambda a, b: a / b)

    def __neg__(self):
        return self.combine(-1.0, lambda a, b: a * b)

    def same(self, other: Tensor) -> bool:
        """Whether shapes and all cells are equal."""
        return self.shape == other.shape and self.cells.exceptAll(other.cells.select(*self.cells.columns)).isEmpty()

    # Looked into (ML4)

    def at(self, *index: int | slice | None) -> Tensor:
        """An index takes one place of its dimension away, a slice cuts it, None and what is left out keep it whole."""
        cells, keep, shape = self.cells, [], []
        for i, n in enumerate(self.shape):
            own = index[i] if i < len(index) else None
            d = F.col(f"d{i}")
            if isinstance(own, int):
                cells = cells.where(d == own % n)
                continue
            places = range(n)[own] if own is not None else range(n)
            if own is not None:
                cells = cells.where((d >= places.start) & (d < places.stop) & ((d - places.start) % places.step == 0)).withColumn(f"d{i}", F.floor((d - places.start) / places.step))
            keep.append(f"d{i}")
            shape.append(len(places))
        return Tensor(cells.select(*[F.col(d).alias(f"d{i}") for i, d in enumerate(keep)], "v"), tuple(shape))

    def assign(self, index: tuple[int | None, ...], value: Tensor | float) -> Tensor:
        """With other values at places; a tensor's cells go to the dimensions that the index keeps."""
        keep = [i for i in range(len(self.shape)) if i >= len(index) or index[i] is None]
        here = reduce(lambda a, b: a & b, [F.col(f"d{i}") == k for i, k in enumerate(index) if k is not None], F.lit(True))
        if not isinstance(value, Tensor):
            return Tensor(self.cells.withColumn("v", F.when(here, F.lit(float(value))).otherwise(F.col("v"))), self.shape)
        new = value.cells.select(*[F.col(f"d{i}").alias(f"d{k}") for i, k in enumerate(keep)], F.col("v").alias("w"))
        both = self.cells.join(new, [f"d{k}" for k in keep], "left")
        return Tensor(both.select(*self.dims, F.when(here, F.col("w")).otherwise(F.col("v")).alias("v")), self.shape)


def from_flat(flat: DataFrame, shape: tuple[int, ...]) -> Tensor:
    """A tensor from (at, v), the row-major numbers of its cells."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(F.floor(F.col("at") / step) % n)
        step *= n
    return Tensor(flat.select(*[c.cast("long").alias(f"d{i}") for i, c in enumerate(reversed(out))], "v"), tuple(shape))


def full(spark: SparkSession, shape: tuple[int, ...], value: float | Column) -> Tensor:
    """Cells of one value, or of an expression over their row-major number `at`."""
    cell = value if isinstance(value, Column) else F.lit(float(value))
    return from_flat(spark.range(math.prod(shape)).select(F.col("id").alias("at")).select("at", cell.alias("v")), shape)


def zeros(spark: SparkSession, *shape: int) -> Tensor:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, *shape: int) -> Tensor:
    return full(spark, shape, 1.0)


def randn(spark: SparkSession, *shape: int, seed: int = 0) -> Tensor:
    """Normal cells from a hash of their place: the same on any partitioning."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("at", F.lit(seed), F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)
    return full(spark, shape, F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1)))


def stack(tensors: list[Tensor], dim: int = 0) -> Tensor:
    """Tensors of one shape along a new dimension."""
    shape = tensors[0].shape
    moved = [t.cells.select(*[(F.lit(k).cast("long") if i == dim else F.col(f"d{i - (i > dim)}")).alias(f"d{i}") for i in range(len(shape) + 1)], "v") for k, t in enumerate(tensors)]
    return Tensor(reduce(DataFrame.unionByName, moved), (*shape[:dim], len(tensors), *shape[dim:]))


def concat(tensors: list[Tensor], dim: int = 0) -> Tensor:
    """Tensors one after the other along a dimension."""
    at, parts = 0, []
    for t in tensors:
        parts.append(t.cells.withColumn(f"d{dim}", F.col(f"d{dim}") + at))
        at += t.shape[dim]
    first = tensors[0].shape
    return Tensor(reduce(DataFrame.unionByName, parts), (*first[:dim], at, *first[dim + 1 :]))


def write(tensor: Tensor, path: str) -> None:
    """A tensor's cells, and its shape beside them (ML5)."""
    tensor.cells.write.mode("overwrite").parquet(f"{path}/cells")
    spark = tensor.cells.sparkSession
    spark.createDataFrame([(list(tensor.shape),)], "shape array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def read(spark: SparkSession, path: str) -> Tensor:
    """What write() wrote (ML5)."""
    return Tensor(spark.read.parquet(f"{path}/cells"), tuple(spark.read.parquet(f"{path}/shape").first()["shape"]))
