"""Near-duplicate vectors by product quantisation over inverted lists.

Unit vectors go to the list of their nearest coarse centroid; what is left of a
vector is coded by one codeword per subspace.  A query looks into other lists
and compares itself with codes by table look-up, and survivors are compared in
double precision.

* Lists hold some LIST_ROWS vectors each, so their number follows the rows (up
  to LISTS).  A vector probes its own list and the ``probes`` next nearest ones.
  How many that are is measured when the index is fitted: vectors of the sample
  get partners at exactly the least cosine, in random directions, and so many
  lists are probed that the share ``recall`` of these pairs meet, from either
  side.  Nearer pairs meet more often.  With ``recall=None`` every list is
  probed that can hold a linked vector: if x is in list a and y in list b, then
  |x - y| <= r implies y.(c_b - c_a) <= r |c_b - c_a|.
* Codes lose no link.  With p the angle between y and its decoded code z, and t
  the angle of the least cosine, x.z >= |z| cos(p + t) for every x linked to y;
  this floor is stored with the code, and looked-up products below it are out.
* Rerank.  What is left gets its exact cosine.

A pair that meets in both lists is counted in one: that of the side whose list
comes first, if the other side probes it.  Centroids and codewords are fitted
on a bounded sample (SAMPLE_ROWS vectors of least hash); every vector is
indexed.  Large lists are cut into blocks, and pairs of blocks are the units of
work; equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.components import local_components, settle
from touchline.llm.groups import flat, runs
from touchline.sources.stage import stage

SAMPLE_ROWS = 16_384
LISTS = 4096
LIST_ROWS = 256
RECALL = 0.995
SUBSPACES = 8
CODEWORDS = 64
BLOCK = 1024
PAIRS_AT_ONCE = 100_000
EPSILON = 1e-9

INDEXED = T.StructType([
    T.StructField("cls", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("list", T.IntegerType()),
    T.StructField("dim", T.IntegerType()), T.StructField("unit", T.BinaryType()),
    T.StructField("code", T.BinaryType()), T.StructField("floor", T.DoubleType()),
    T.StructField("near", T.ArrayType(T.IntegerType(), False)),
])
HITS = T.StructType([
    T.StructField("cls", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType()),
])


def units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, filled up with zeros to ``width``, and their sizes.

    Rows that are null, zero or hold null or non-finite components are zero.
    """
    if column.null_count:
        column = pa.array([x if x is not None else [] for x in column.to_pylist()], column.type)
    values, first = flat(column)
    values = np.asarray(values, np.float64)
    sizes = np.diff(first)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - first[row]] = values
    good = np.isfinite(out).all(1)
    out[~good] = 0
    top = np.abs(out).max(1, initial=0.0, keepdims=True)
    np.divide(out, top, out=out, where=top > 0)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    np.divide(out, length, out=out, where=length > 0)
    return out, sizes


def _means(points: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    """Centroids of Lloyd's method; empty ones stay where they were."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if unit:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            np.divide(centres, length, out=centres, where=length > 0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


@dataclass
class Index:
    coarse: np.ndarray
    words: np.ndarray  # subspace x codeword x part
    cosine: float  # least cosine of a linked pair
    count: int | None  # lists probed beside the own one; None for all that can hold a link

    @property
    def width(self) -> int:
        return self.coarse.shape[1]

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Greatest for the nearest centroid."""
        return points @ self.coarse.T - 0.5 * (self.coarse ** 2).sum(1)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and least looked-up product with a linked vector of each unit vector."""
        own = _nearest(points, self.coarse)
        decoded = self.coarse[own]
        rest = points - decoded
        code = np.empty((len(points), len(self.words)), np.uint8)
        step = self.words.shape[2]
        for s, words in enumerate(self.words):
            code[:, s] = _nearest(rest[:, s * step: (s + 1) * step], words)
            decoded[:, s * step: (s + 1) * step] += words[code[:, s]]
        length = np.sqrt((decoded * decoded).sum(1))
        along = (decoded * points).sum(1)
        across = np.sqrt(np.maximum(length ** 2 - along ** 2, 0))
        floor = self.cosine * along - np.sqrt(1 - self.cosine ** 2) * across
        # Beyond a right angle and more, the cap around y reaches the side opposite to z.
        far = along < -self.cosine * length
        return own, code, np.where(far, -length, floor)

    def probes(self, points: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Other lists that each vector looks into."""
        near = self.scores(points)
        row = np.arange(len(points))
        if self.count is not None:
            near[row, own] = -np.inf
            count = min(self.count, near.shape[1] - 1)
            if not count:
                return [np.zeros(0, np.int32)] * len(points)
            return list(np.sort(np.argpartition(-near, count - 1, axis=1)[:, :count], 1).astype(np.int32))
        square = (self.coarse ** 2).sum(1)
        gaps = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * self.coarse @ self.coarse.T, 0))
        radius = np.sqrt(max(0.0, 2 - 2 * self.cosine))
        open_ = near[row, own][:, None] - near <= radius * gaps[own] + EPSILON
        open_[row, own] = False
        return [np.flatnonzero(x).astype(np.int32) for x in open_]


def wanted_probes(index: Index, sample: np.ndarray, recall: float) -> int:
    """Lists to probe for ``recall`` of pairs at the least cosine to meet, from either side."""
    points = sample[: 4096]
    draw = np.random.default_rng(3)
    aside = draw.standard_normal(points.shape)
    aside -= (aside * points).sum(1, keepdims=True) * points
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    partners = index.cosine * points + np.sqrt(1 - index.cosine ** 2) * aside
    row = np.arange(len(points))
    ranks = []
    a, b = index.scores(points), index.scores(partners)
    own_a, own_b = a.argmax(1), b.argmax(1)
    for near, other in ((a, own_b), (b, own_a)):
        ranks.append((near > near[row, other][:, None]).sum(1))
    return int(np.quantile(np.minimum(*ranks), recall, method="higher"))


def train(sample: np.ndarray, rows: int, cosine: float, recall: float | None = RECALL, list_rows: int = LIST_ROWS) -> Index:
    lists = int(np.clip(round(rows / list_rows), 1, LISTS))
    coarse = _means(sample, lists, 8, 7, unit=True)
    rest = sample - coarse[_nearest(sample, coarse)]
    step = sample.shape[1] // SUBSPACES
    words = [_means(np.ascontiguousarray(rest[:, s * step: (s + 1) * step]), CODEWORDS, 8, s, unit=False) for s in range(SUBSPACES)]
    least = min(map(len, words))
    index = Index(coarse, np.stack([w[:least] for w in words]), cosine, None)
    if recall is not None:
        index.count = wanted_probes(index, sample, recall)
    return index


def _index(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                points, sizes = units(part.column(2), index.width)
                own, code, floor = index.encode(points)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(own.astype(np.int32)),
                    pa.array(sizes.astype(np.int32)), pa.array([x.tobytes() for x in points], pa.binary()),
                    pa.array([x.tobytes() for x in code], pa.binary()), pa.array(floor),
                    pa.array(index.probes(points, own), pa.list_(pa.int32())),
                ], names=INDEXED.names)

    return run


def unit_links(index: Index, list_: int, points, code, floor, dim, member, query, same: bool, cosine: float):
    """Linked pairs (member row, query row) of one pair of blocks.

    In a block paired with itself each pair is looked at once.
    """
    steps = len(index.words)
    width = index.words.shape[2]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = max(1, 2_000_000 // max(1, len(member)))
    for at in range(0, len(query), rows):
        own = query[at: at + rows]
        looked = np.repeat((points[own] @ index.coarse[list_])[:, None], len(member), 1)
        for s in range(steps):
            table = points[own, s * width: (s + 1) * width] @ index.words[s].T
            looked += table[:, code[member, s]]
        q, m = np.nonzero(looked >= floor[member][None] - EPSILON)
        q, m = own[q], member[m]
        good = dim[q] == dim[m]
        if same:
            good &= m < q
        q, m = q[good], m[good]
        for to in range(0, len(q), PAIRS_AT_ONCE):
            a, b = q[to: to + PAIRS_AT_ONCE], m[to: to + PAIRS_AT_ONCE]
            near = np.einsum("ij,ij->i", points[a], points[b]) >= cosine
            left.append(b[near]), right.append(a[near])
    return np.concatenate(left), np.concatenate(right)


def _links(sent, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in runs(batches, "work"):
            part = part.combine_chunks()
            cls, copies = part.column("cls").to_numpy(), part.column("copies").to_numpy()
            role, dim = part.column("role").to_numpy(), part.column("dim").to_numpy()
            points = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(len(cls), -1)
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(cls), -1)
            same = bool((role == 2).any())
            member, query = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            at = int(part.column("at")[0].as_py())
            u, v = unit_links(index, at, points, code, part.column("floor").to_numpy(), dim, member, query, same, cosine)
            if not same and len(u):
                # Members u of this list, queries v of another: if that one comes first and u probes it, it is counted there.
                home = part.column("list").to_numpy()[v]
                probed, begin = flat(part.column("near"))
                there = np.array([h < at and h in probed[begin[i]: begin[i + 1]] for i, h in zip(u.tolist(), home.tolist())])
                u, v = u[~there], v[~there]
            if not len(u):
                continue
            links = np.zeros(len(cls), np.int64)
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            root = cls[local_components(len(cls), u, v)]
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(links[hit]), pa.array(root[hit])], names=HITS.names)

    return run


def near_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.9,
    recall: float | None = RECALL, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """(id, class_id, n_links, component_id) for every row.

    Two rows link if the cosine of their vectors, in double precision, is at
    least ``cosine`` (over 0.5); links between different vectors are found if
    they meet in a probed list (see above; ``recall=None`` finds all), and equal
    vectors always link.  ``class_id`` is the least id with an equal
    vector, ``n_links`` the number of other rows linked directly (equal ones
    included), ``component_id`` the least id that links reach, the own one
    included.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, not even one another, and vectors of different size do
    not link.  Rows with a null id come back with no link and null class and
    component.  Rows that share an id count as rows of their own.  An empty
    table gives an empty table; further columns are ignored.
    """
    if not 0.5 < cosine <= 1:
        raise ValueError("the bounds are of use for a cosine over 0.5")
    spark = rows.sparkSession
    source = rows.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
    )
    fine = F.expr(
        "vector is not null and forall(vector, x -> x is not null and abs(x) <= 1.7976931348623157E308D)"
        " and exists(vector, x -> x <> 0)",
    )
    known = source.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull()).withColumn(
        "cls", F.when(F.col("fine"), F.xxhash64("vector")),
    )
    classes = stage(
        known.filter("fine").groupBy("cls", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")),
        "vectors",
    )
    shape = classes.agg(F.count("*"), F.max(F.size("vector"))).head()
    count, width = shape[0], -(-(shape[1] or 1) // SUBSPACES) * SUBSPACES
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_ROWS).select("vector").toArrow()
    points = units(sample.column(0).combine_chunks(), width)[0] if sample.num_rows else np.eye(1, width)
    index = train(points, count, cosine, recall, list_rows)
    sent = spark.sparkContext.broadcast(index)
    indexed = stage(
        classes.select("cls", "copies", "vector").mapInArrow(_index(sent), INDEXED), "indexed",
    )
    lists = indexed.groupBy("list").agg(F.count("*").alias("members"))
    probes = indexed.select("cls", F.explode("near").alias("at"))
    asked = probes.groupBy("at").agg(F.count("*").alias("asking"))
    sizes = stage(
        lists.join(asked, lists["list"] == asked["at"], "left").select(
            "list", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
            F.ceil(F.coalesce("asking", F.lit(0)) / BLOCK).cast("int").alias("askers"),
        ),
        "lists",
    )
    block = lambda n: F.expr(f"cast(pmod(xxhash64(cls), {n}) as int)")
    own = indexed.select("cls", "list").join(sizes, "list").withColumn("block", block("blocks"))
    own = own.select("cls", F.col("list").alias("at"), F.explode(F.expr("""
        concat(
          transform(sequence(0, blocks - 1), i -> named_struct(
            'kind', 0, 'i', least(i, block), 'j', greatest(i, block),
            'role', case when i = block then 2 when block < i then 0 else 1 end)),
          case when askers > 0 then transform(sequence(0, askers - 1), j -> named_struct(
            'kind', 1, 'i', block, 'j', j, 'role', 0)) else array() end)
    """)).alias("m"))
    asking = probes.join(sizes, probes["at"] == sizes["list"]).withColumn("block", block("askers")).select(
        "cls", "at", F.explode(F.expr(
            "transform(sequence(0, blocks - 1), i -> named_struct('kind', 1, 'i', i, 'j', block, 'role', 1))",
        )).alias("m"),
    )
    work = own.unionAll(asking).select(
        "cls", "at", F.xxhash64("at", "m.kind", "m.i", "m.j").alias("work"), F.col("m.role").alias("role"),
    )
    hits = stage(
        work.join(indexed.select("cls", "copies", "dim", "unit", "code", "floor", "list", "near"), "cls")
        .repartition("work").sortWithinPartitions("work").mapInArrow(_links(sent, cosine), HITS),
        "hits",
    )
    facts = settle(classes.select("cls", "rep", "copies"), hits)
    return known.select("id", "cls").join(facts, "cls", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
