"""Embedding near-duplicates over an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has its own codebook, and the pairs
of codes form a grid of cells. Every vector lies in the cell of its nearest two codes, its home,
and looks for partners in the homes around it.

How far a cell is: for a half, the distance from the vector's half to the plane between its
nearest centre and the cell's, which any point of the cell lies beyond. The squares of both
halves add up to a bound on the squared distance to everything in the cell. The multi-sequence
traversal visits cells by rising bound, until the bound up to which `recall` of partners at
exactly the threshold were found in a trial. (Partners at cosine c are at squared distance
2 - 2c, and no bound beyond that is ever needed.) What a visit finds is verified by the cosine in
double precision. A pair is found if either of the two visits the other's home, and counted once.

Equal vectors are one node with a count, so copies cost nothing. Cells with many vectors or many
visitors are dealt in blocks to several tasks. A group of linked vectors leaves a task as link
counts per node and a spanning forest, never as pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths with each other, nor rows with a null id (their component is null,
and they are kept). Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.components import components
from loanloom.sources.store import stored

#: Vectors on which codebooks are fitted, about, and trials of the traversal.
SAMPLE, TRIALS = 16_384, 2_000
#: Vectors per cell aimed at, and the most centres of a half.
CELL, CENTRES = 48, 1024
RECALL = 0.99
#: Vectors of a cell, and visitors, that one task compares at a time.
HOMES_BLOCK, VISITORS_BLOCK = 1024, 8192


def _kmeans(x: np.ndarray, k: int, seed: int = 5, rounds: int = 15) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


@dataclass
class Grid:
    """Two codebooks and the bound up to which cells are visited."""

    books: tuple[np.ndarray, np.ndarray]
    bound: float = 0.0

    def halves(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest code of each vector, and how far it is to each code's region."""
        out, cut = [], self.books[0].shape[1]
        for book, part in zip(self.books, (x[:, :cut], x[:, cut:]), strict=True):
            d = _squares(part, book)
            near = d.argmin(1)
            apart = np.sqrt(np.maximum(_squares(book, book), 0))[near]
            reach = (d - d[np.arange(len(d)), near][:, None]) / np.where(apart > 1e-9, 2 * apart, np.inf)
            out.append((near, np.maximum(reach, 0.0) ** 2))
        return out

    def homes(self, x: np.ndarray) -> np.ndarray:
        (a, _), (b, _) = self.halves(x)
        return a * len(self.books[1]) + b

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Home of each vector and the cells that it visits, by rising bound."""
        (a, far_a), (b, far_b) = self.halves(x)
        width = len(self.books[1])
        out = []
        for i in range(len(x)):
            near_a, near_b = (np.flatnonzero(f[i] <= self.bound) for f in (far_a, far_b))
            near_a = near_a[np.argsort(far_a[i, near_a], kind="stable")]
            near_b = near_b[np.argsort(far_b[i, near_b], kind="stable")]
            out.append(self._traverse(near_a, far_a[i, near_a], near_b, far_b[i, near_b], width))
        return a * width + b, out

    def _traverse(self, a, far_a, b, far_b, width) -> list[int]:
        """Pairs of two sorted lists in the order of their sums, as far as the bound."""
        cells, heap, pushed = [], [(far_a[0] + far_b[0], 0, 0)], {(0, 0)}
        while heap:
            far, i, j = heapq.heappop(heap)
            if far > self.bound:
                break
            cells.append(int(a[i]) * width + int(b[j]))
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in pushed:
                    pushed.add((p, q))
                    heapq.heappush(heap, (far_a[p] + far_b[q], p, q))
        return cells

    def calibrate(self, x: np.ndarray, least: float, recall: float, seed: int = 11) -> None:
        """Set the bound by partners at cosine `least` in random directions."""
        draw = np.random.default_rng(seed)
        side = draw.standard_normal(x.shape)
        side -= (side * x).sum(1)[:, None] * x
        side /= np.linalg.norm(side, axis=1)[:, None] + 1e-30
        partner = least * x + np.sqrt(max(0.0, 1 - least * least)) * side
        found = []
        for one, other in ((x, partner), (partner, x)):
            (_, far_a), (_, far_b) = self.halves(one)
            (a, _), (b, _) = self.halves(other)
            rows = np.arange(len(x))
            found.append(far_a[rows, a] + far_b[rows, b])
        needed = np.minimum(*found)
        self.bound = float(min(np.quantile(needed, recall, method="higher"), 2 - 2 * least + 1e-9))


def fit_grid(x: np.ndarray, total: int, least: float, recall: float) -> Grid:
    """Codebooks for `total` vectors from a sample of them, scaled to length 1."""
    k = int(np.clip(round(np.sqrt(total / CELL)), 1, min(CENTRES, len(x))))
    cut = x.shape[1] // 2 or 1
    parts = (x[:, :cut], x[:, cut:] if x.shape[1] > 1 else np.zeros((len(x), 1)))
    grid = Grid(tuple(_kmeans(np.ascontiguousarray(p), k) for p in parts))
    grid.calibrate(x[:TRIALS] if x.shape[1] > 1 else np.pad(x[:TRIALS], ((0, 0), (0, 1))), least, recall)
    return grid


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors in double precision, scaled to length 1 (a vector of one component gets a zero)."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x if x.shape[1] > 1 else np.pad(x, ((0, 0), (0, 1)))


def _packed(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """Columns id, raw (the components as bytes, null if the vector can't be used) and dim."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                usable = i is not None and v.is_valid and len(v.values) and not v.values.null_count
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if usable else np.zeros(1)
                usable = np.isfinite(x).all() and x.any()
                raw.append((x + 0).tobytes() if usable else None)
                dims.append(len(x) if usable else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], names=["id", "raw", "dim"]
            )

    element = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col(key).cast("long"), F.col(vector).cast(f"array<{element}>"))
    return rows.mapInArrow(pack, "id long, raw binary, dim int")


def _nodes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """Distinct usable vectors: node, least id, n, dim, raw; and the type of the components."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"

    packed = _packed(vectors, key, vector, kind).where("raw IS NOT NULL")
    nodes = packed.groupBy("raw", "dim").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes"), kind


def _compare(homes: dict, visitors: dict, least: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, links (in rows) and roots of what visitors find among homes."""
    w, q = _unit(homes["raw"], kind), _unit(visitors["raw"], kind)
    w_node, q_node = (np.array(x["node"], np.int64) for x in (homes, visitors))
    w_n, q_n = (np.array(x["n"], np.int64) for x in (homes, visitors))
    i, j = np.nonzero(q @ w.T >= least - 1e-12)
    step = 1 << 16
    exact = [
        np.einsum("ij,ij->i", q[i[s : s + step]], w[j[s : s + step]]) >= least
        for s in range(0, len(i), step)
    ]
    keep = np.concatenate([np.zeros(0, bool), *exact]) & (q_node[i] != w_node[j])
    i, j = i[keep], j[keep]
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    seen_back = np.zeros(len(i), bool)
    q_home = np.array(visitors["home"], np.int64)
    order = np.argsort(j, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(j[order])) + 1):
        seen_back[at] = np.isin(q_home[i[at]], homes["visits"][j[at[0]]])
    counts = ~seen_back | (q_node[i] < w_node[j])
    nodes, place = np.unique(np.concatenate([q_node, w_node]), return_inverse=True)
    a, b = place[: len(q_node)][i], place[len(q_node) :][j]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a[counts], w_n[j[counts]])
    np.add.at(links, b[counts], q_n[i[counts]])
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    touched = np.unique(np.concatenate([a, b]))
    return nodes[touched], links[touched], nodes[root[touched]]


def _search(nodes: DataFrame, dim: int, total: int, least: float, recall: float, kind: str) -> DataFrame:
    """Rows (node, links, root) over all cells of the vectors of one length."""
    spark = nodes.sparkSession
    own = nodes.where(F.col("dim") == dim)
    grains = 1 << 40
    part = int(min(1.0, SAMPLE / total) * grains)
    picked = own.where(F.pmod(F.xxhash64("raw"), F.lit(grains)) < part).select("raw").collect()
    picked = sorted(bytes(r.raw) for r in picked) or [bytes(own.select("raw").first().raw)]
    sample = _unit(picked, kind)
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    grid = spark.sparkContext.broadcast(fit_grid(sample, total, least, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                home, visits = grid.value.visits(_unit(some.column(2).to_pylist(), kind))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                    names=["node", "n", "raw", "home", "visits"],
                )

    placed = stored(
        own.select("node", "n", "raw").mapInArrow(
            place, "node long, n long, raw binary, home long, visits array<long>"
        ),
        "placed",
    )
    seen = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("v"))
    cells = (
        placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("h"))
        .join(seen, "cell")
        .where("v > 1")
        .select("cell", F.ceil(F.col("h") / HOMES_BLOCK).alias("hs"), F.ceil(F.col("v") / VISITORS_BLOCK).alias("vs"))
    )
    cells = stored(cells, "cells")
    deal = F.hash("node")

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    homes = placed.join(cells, placed.home == cells.cell).select(
        "cell", F.pmod(deal, F.col("hs")).alias("hb"), each("vs").alias("vb"),
        "node", "n", "raw", "home", "visits",
    )
    visitors = (
        placed.select("node", "n", "raw", "home", F.explode("visits").alias("cell"))
        .join(cells, "cell")
        .select(
            "cell", each("hs").alias("hb"), F.pmod(deal, F.col("vs")).alias("vb"),
            "node", "n", "raw", "home", F.lit(None).cast("array<long>").alias("visits"),
        )
    )

    def compare(group: pa.Table) -> pa.Table:
        is_home = pa.compute.is_valid(group.column("visits"))
        tables = (group.filter(is_home), group.filter(pa.compute.invert(is_home)))
        names = ("node", "n", "raw", "home", "visits")
        parts = [{c: t.column(c).to_pylist() for c in names} for t in tables]
        found = _compare(*parts, least, kind) if parts[0]["node"] and parts[1]["node"] else ([], [], [])
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["node", "links", "root"])

    return homes.union(visitors).groupBy("cell", "hb", "vb").applyInArrow(compare, "node long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    least: float = 0.95,
    recall: float = RECALL,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Per row: key, n_links, component_id (least id reachable over links), kept."""
    nodes, kind = _nodes(vectors, key, vector)
    dims = nodes.groupBy("dim").count().collect()
    schema = "node long, links long, root long"
    found = vectors.sparkSession.createDataFrame([], schema)
    for dim, total in dims:
        found = found.union(_search(nodes, dim, total, least, recall, kind))
    found = stored(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = stored(
        nodes.join(links, "node", "left")
        .join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        .select(
            "raw",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        ),
        "linked",
    )
    least_id = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    result = stored(joined.join(least_id, "root").select("raw", "n_links", "component_id"), "vectors")
    return _per_row(vectors, result, key, vector, kind)


def _per_row(vectors: DataFrame, result: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """Bring the nodes' results to the rows: by the packed vector, null where unusable."""
    joined = _packed(vectors, key, vector, kind).join(result, "raw", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
