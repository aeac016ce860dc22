r"""Operator 1: embedding near-dedup on a robust-pruned flat graph.

Vectors are compared only within one label (and one number of dimensions). Equal vectors
collapse first. Cells of more than twice SHARD vectors are split by pivots drawn from them,
level by level: a vector's home is the pivot with the greatest dot product, and it also joins
every cell whose bisecting hyperplane lies within half the linking distance. Two linked vectors
are nearer to their midpoint than that, so both stand in the midpoint's cell: the overlap
loses no link. A cell that no split makes smaller (a large group of near copies) is dealt to
blocks, and each pair of blocks is a shard, so that a shard stays bounded.

In every shard each vector's candidates, the nearest and some at ever greater ranks, are pruned
robustly (a candidate is dropped if a kept one is nearer to it by the factor ALPHA); the
adjacency lists of all shards are united by vector. Then each shard's vectors are searched
for in its part of the united graph: a best-first search from the medoids of the shard's
parts, followed by expansion of everything within the range plus a slack. What it finds is
verified in double precision, and nothing else is a link.

A pair that stands in several shards counts in the first of them. A shard gives for each
vector the number of its links and a tree edge of its group, never the pairs themselves. The
audit compares, for every AUDIT-th vector by hash, the finds with all products in the shard;
below LEAST_RECALL of these the search is made again with a wider beam, and at last the
operator fails rather than give an incomplete result.

Links: cosine >= LINK in double precision. Vectors that are null, of zero length or hold
null or non-finite components, and those without a label, link with nothing and are kept.
Vectors without an id link with nothing. Rows that repeat an id with the same vector link
with each other as any two equal vectors do and share the component; an id that stands with
several vectors has the links of each in the row of each, and one component. An empty table
gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, small_batches, table, written

LINK = 0.98
#: Vectors of a shard; candidates, degree and factor of the pruning; width and slack of the search.
SHARD, CANDIDATES, DEGREE, ALPHA, BEAM, SLACK = 4000, 48, 32, 1.2, 32, 0.02
#: Factor from one rank of far candidates to the next, and neighbours of a vector at most, named both ways.
STRIDE, WIDE = 1.2, 128
#: Pivots that split one cell, at most; a split counts if it multiplies the rows by no more than
#: SPREAD and leaves no cell with more than SHRUNK of them; levels.
FAN, SPREAD, SHRUNK, LEVELS = 64, 2.5, 0.95, 12
MEDOIDS = 4
#: One vector of so many is audited; the share of its links that the search must find.
AUDIT, LEAST_RECALL = 16, 0.9
_NEAR = 1e-9


def valid(embedding: Column) -> Column:
    """Whether the vector has components, all of them finite, and a length."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(values: list) -> np.ndarray:
    x = np.asarray(values, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(units: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
    """For each vector its cells, home first."""
    dots = units @ pivots.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    half = np.sqrt(2 - 2 * LINK) / 2
    margin = dots[np.arange(len(units)), home][:, None] - dots
    near = margin <= half * apart[home] + _NEAR
    return [np.concatenate([[h], np.setdiff1d(np.flatnonzero(n), [h])]) for h, n in zip(home, near)]


def thinned(pivots: np.ndarray) -> np.ndarray:
    """Those of the pivots that stand apart by four linking distances, else by two: so a group of
    near copies, however many pivots were drawn from it, is cut by few planes."""
    far = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    for apart in (4, 2):
        kept: list[int] = []
        for k in range(len(pivots)):
            if not kept or far[k, kept].min() > apart * np.sqrt(2 - 2 * LINK):
                kept.append(k)
        if len(kept) > 1:
            break
    return pivots[kept]


def _ranks(n: int, near: int) -> np.ndarray:
    """Ranks of the candidates by nearness: the nearest ones, then ever wider steps to the farthest."""
    out, step = list(range(min(near, n))), float(near)
    while near and step * STRIDE < n:
        step *= STRIDE
        out.append(int(step))
    return np.array(out, dtype=np.int64)


def prune(units: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: for each vector up to degree neighbours, -1 where there are fewer.

    Candidates are the nearest vectors and some at ever greater ranks of nearness, so that a list
    reaches out of a group of near copies, however large: a search from afar then comes into
    the group, and finds its way by vectors that are nearer and nearer. The nearest fill half of a
    list at most; the rest is left to the others.
    """
    n = len(units)
    ranks = _ranks(n - 1, candidates)
    k = len(ranks)
    out = np.full((n, degree), -1, dtype=np.int64)
    if k < 1:
        return out
    x = units.astype(np.float32)
    for lo in range(0, n, 256):
        own = np.arange(lo, min(n, lo + 256))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -9
        # in place at their ranks; the nearest, which stand before theirs, are then sorted
        near = np.argpartition(-sims, ranks[min(candidates, k) - 1 :], axis=1)[:, ranks]
        close = near[:, :candidates]
        order = np.argsort(-np.take_along_axis(sims, close, axis=1), axis=1, kind="stable")
        near[:, :candidates] = np.take_along_axis(close, order, axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, axis=1)))
        among = np.einsum("bkd,bld->bkl", x[near], x[near])
        among = np.sqrt(np.maximum(0, 2 - 2 * among))
        alive = np.ones(near.shape, dtype=bool)
        rows = np.arange(len(own))
        for step in range(degree):
            if step == degree // 2 and k > candidates:
                alive[:, :candidates] = False
            pick = alive.argmax(axis=1)
            there = alive[rows, pick]
            out[own[there], step] = near[rows[there], pick[there]]
            # one without a pick keeps what is alive
            alive[there] &= (alpha * among[rows, pick] > far)[there]
            alive[rows, pick] = False
    return out


def find(units: np.ndarray, neighbours: list[np.ndarray], link: float = LINK, beam: int = BEAM, slack: float = SLACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Range search of every vector from the medoids alone: queries and hits, verified in double,
    part by part. Lists are ragged, so a node of many neighbours costs what it opens."""
    n = len(units)
    sizes = np.array([len(v) for v in neighbours], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.empty(0, np.int64), *neighbours]).astype(np.int64)
    x = units.astype(np.float32)

    def lists(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the nodes' lists, end to end: which node, which neighbour."""
        each = sizes[nodes]
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(np.arange(len(nodes)), each), flat[np.repeat(begin[nodes], each) + inside]

    # medoids: the vectors nearest to the means of consecutive parts
    parts = np.array_split(np.arange(n), min(MEDOIDS, n))
    starts = np.unique([p[(x[p] @ x[p].mean(axis=0)).argmax()] for p in parts])
    for lo in range(0, n, 256):
        own = np.arange(lo, min(n, lo + 256))
        m, rows = len(own), np.arange(min(256, n - lo))
        seen = np.zeros((m, n), dtype=bool)
        inside = np.zeros((m, n), dtype=bool)  # within the range and the slack
        opened = np.zeros((m, n), dtype=bool)
        ids = np.full((m, beam), -1, dtype=np.int64)
        sims = np.full((m, beam), -9, dtype=np.float32)
        done = np.ones((m, beam), dtype=bool)
        ids[:, : len(starts)] = starts
        sims[:, : len(starts)] = x[own] @ x[starts].T
        done[:, : len(starts)] = False
        seen[:, starts] = True
        inside[:, starts] = sims[:, : len(starts)] >= link - slack
        active = rows
        while len(active):
            score = np.where(done[active], -99, sims[active])
            pick = score.argmax(axis=1)
            going = score[np.arange(len(active)), pick] > -9
            active, pick = active[going], pick[going]
            if not len(active):
                break
            done[active, pick] = True
            node = ids[active, pick]
            opened[active, node] = True
            of, near = lists(node)
            fresh = ~seen[active[of], near]
            of, near = of[fresh], near[fresh]
            seen[active[of], near] = True
            s = np.einsum("nd,nd->n", x[own[active[of]]], x[near])
            hit = s >= link - slack
            inside[active[of[hit]], near[hit]] = True
            # the best of each query's old and new: padded to the longest list of this step
            count = np.bincount(of, minlength=len(active))
            width = int(count.max()) if len(of) else 0
            if not width:
                continue
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            new_sims, new_ids = np.full((len(active), width), -9, np.float32), np.full((len(active), width), -1, np.int64)
            new_sims[of, at], new_ids[of, at] = s, near
            every = np.concatenate([sims[active], new_sims], axis=1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(every, top, axis=1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new_ids], axis=1), top, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], new_ids < 0], axis=1), top, axis=1)
        # range expansion: open all that lie inside until nothing new does
        while True:
            q, node = np.nonzero(inside & ~opened)
            if not len(q):
                break
            for a in range(0, len(q), 20_000):
                qs, ns = q[a : a + 20_000], node[a : a + 20_000]
                opened[qs, ns] = True
                of, near = lists(ns)
                qq = qs[of]
                fresh = ~seen[qq, near]
                qq, near = qq[fresh], near[fresh]
                seen[qq, near] = True
                hit = np.einsum("nd,nd->n", x[own[qq]], x[near]) >= link - slack
                inside[qq[hit], near[hit]] = True
        q, h = np.nonzero(inside)
        exact = (np.einsum("nd,nd->n", units[own[q]], units[h]) >= link) & (own[q] != h)
        yield own[q[exact]], h[exact]


def both_ways(n: int, tail: np.ndarray, head: np.ndarray, wide: int) -> list[np.ndarray]:
    """Neighbours of n vectors from directed edges, each kept both ways. Of a vector that many name,
    its own list and evenly spaced others are kept, wide of them: those that name it still reach it."""
    own = np.unique(tail * n + head)
    back = np.setdiff1d(np.unique(head * n + tail), own)
    cut = lambda edges: np.searchsorted(edges, np.arange(n + 1) * n)
    a, b = cut(own), cut(back)
    out = []
    for k in range(n):
        mine, other = own[a[k] : a[k + 1]] % n, back[b[k] : b[k + 1]] % n
        room = max(0, wide - len(mine))
        out.append(np.concatenate([mine, other if len(other) <= room else other[np.linspace(0, len(other) - 1, room).astype(np.int64)] if room else other[:0]]))
    return out


def connected(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least number connected with each of n, by hooking and jumping; label continues a former result."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    return label


def every_link(units: np.ndarray, some: np.ndarray, link: float = LINK) -> tuple[np.ndarray, np.ndarray]:
    """The audit's pairs: all products of some vectors, the near ones again in full precision."""
    q, h = [], []
    for lo in range(0, len(some), 512):
        own = some[lo : lo + 512]
        a, b = np.nonzero(units[own] @ units.T >= link - 1e-6)
        exact = (np.einsum("nd,nd->n", units[own[a]], units[b]) >= link) & (own[a] != b)
        q.append(own[a[exact]])
        h.append(b[exact])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *q]), np.concatenate([none, *h])


PLACED = "space string, cell string, node bigint, least bigint, copies bigint, unit binary"
KEYS = ["space", "cell", "i", "j"]


def _split(rows: DataFrame, sizes: DataFrame, shard: int, level: int) -> DataFrame:
    """rows of oversize cells (sizes: space, cell, n) with cells: the numbers of their new cells, home first."""
    h = F.pmod(F.xxhash64("node", F.lit(11 + level)), F.lit(1 << 30))
    want = F.least(F.lit(FAN), F.ceil(F.col("n") / shard)).cast("int")
    sized = sizes.withColumn("want", want).withColumn("parts", F.ceil(F.col("n") / (4 * shard)).cast("int"))
    # about twice as many as wanted by a threshold on a hash, then the least hashes: no sort of all rows
    drawn = rows.join(sized, ["space", "cell"]).where(h < (F.col("want") * 3 + 20) * F.lit(float(1 << 30)) / F.col("n"))
    order = Window.partitionBy("space", "cell").orderBy(F.xxhash64("node", F.lit(11 + level)), "node")
    drawn = drawn.withColumn("k", F.row_number().over(order)).where("k <= want")
    # a cell's rows are dealt to parts, and its pivots go to each of them
    pivots = written(drawn.select("space", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "k", "unit"))
    dealt = rows.join(sized.select("space", "cell", "parts"), ["space", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).drop("parts")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        one = lambda t: np.frombuffer(b"".join(t.column("unit").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
        cells = pa.array([], pa.list_(pa.int32()))
        if left.num_rows and not right.num_rows:
            cells = pa.array([[0]] * left.num_rows, pa.list_(pa.int32()))
        elif left.num_rows:
            cells = pa.array(_cells(one(left), thinned(one(right.sort_by("k")))), pa.list_(pa.int32()))
        return left.drop_columns(["part"]).append_column("cells", cells)

    key = ["space", "cell", "part"]
    return dealt.select(*key, "node", "least", "copies", "unit").groupBy(*key).cogroup(pivots.groupBy(*key)).applyInArrow(assign, f"{PLACED}, cells array<int>")


def _sharded(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """space, cell, i, j, own (block), node, least, copies, unit, earlier: the vectors' places in
    all their shards. earlier: the vector's cells that come before this one.

    vectors: space (label and dimensions), node (a number of its own), least (the smallest id
    that has the vector), copies, x (array<double>).
    """
    schema = pa.schema([("space", pa.string()), ("cell", pa.string()), ("node", pa.int64()), ("least", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary())])

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), dtype=object)
            for s in dict.fromkeys(spaces):
                part = batch.filter(pa.array(spaces == s))
                units = _unit(part.column("x").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("space"), pa.array(["0"] * len(units), pa.string()), part.column("node"), part.column("least"), part.column("copies"), pa.array([u.tobytes() for u in units], pa.binary())], schema=schema)

    rows = written(vectors.select("space", "node", "least", "copies", "x").mapInArrow(unit, PLACED))
    settled, open_ = [], rows
    for level in range(LEVELS):
        sizes = written(open_.groupBy("space", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard))
        if sizes.isEmpty():
            break
        cells = written(_split(open_.join(sizes.select("space", "cell"), ["space", "cell"]), sizes, shard, level))
        split = cells.withColumn("to", F.explode("cells"))
        grown = split.groupBy("space", "cell", "to").agg(F.count("*").alias("n")).groupBy("space", "cell").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
        grown = grown.join(sizes, ["space", "cell"]).where((F.col("rows") <= SPREAD * F.col("n")) & (F.col("most") <= SHRUNK * F.col("n")))
        better = written(grown.select("space", "cell"))
        settled.append(open_.join(better, ["space", "cell"], "left_anti"))
        split = split.join(better, ["space", "cell"])
        open_ = written(split.select("space", F.concat_ws("/", "cell", "to").alias("cell"), "node", "least", "copies", "unit"))
    for part in settled:
        open_ = open_.unionByName(part)
    placed = written(open_) if settled else open_
    sizes = placed.groupBy("space", "cell").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("blocks"))
    every = placed.groupBy("node").agg(F.array_sort(F.collect_list("cell")).alias("mine"))
    spread = placed.join(sizes, ["space", "cell"]).join(every, "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    # a block meets every other block once; in a cell of several blocks, itself in one shard
    spread = spread.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    earlier = F.filter("mine", lambda c: c < F.col("cell"))
    return spread.select("space", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "least", "copies", "unit", earlier.alias("earlier"))


FOUND = "node bigint, links bigint, least bigint, root bigint, audited bigint, audited_found bigint"


def search(vectors: DataFrame, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """node, links (others, copies counted), least and root (the smallest id of the vector and that
    of its group, as far as the shard knows it), audited and audited_found (links of the audit, and those of them that the search found): one row per
    vector and shard."""
    sharded = written(_sharded(vectors, shard))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        units = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), -1)
        near = prune(units)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node, "near": [node[x[x >= 0]] for x in near]})

    lists = sharded.select(*KEYS, "node", "unit").groupBy(*KEYS).applyInPandas(build, "node bigint, near array<bigint>")
    # the union of a vector's lists: at most DEGREE for each of its shards
    united = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        node, n = rows["node"].to_numpy(), len(rows)
        units = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(n, -1)
        # edges both ways, as far as both ends stand in this shard
        sizes = [0 if x is None else len(x) for x in rows["near"]]
        tail = np.repeat(np.arange(n), sizes)
        head = np.concatenate([np.empty(0, np.int64), *[np.asarray(x, dtype=np.int64) for x in rows["near"] if x is not None]])
        at = np.minimum(np.searchsorted(node, head), n - 1)
        here = node[at] == head
        tail, at = tail[here], at[here]
        neighbours = both_ways(n, tail, at, WIDE)
        # a pair counts here unless a former shard holds it: a common cell that comes before, or, in
        # a shard of two blocks, one block for both
        own, copies = rows["own"].to_numpy(), rows["copies"].to_numpy()
        two = rows["i"].iloc[0] != rows["j"].iloc[0]
        names = sorted({c for x in rows["earlier"] for c in x})
        before = np.zeros((n, len(names)), dtype=bool)
        for k, x in enumerate(rows["earlier"]):
            before[k, np.searchsorted(names, list(x))] = True
        some = before.any(axis=1)

        def counted(q: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = own[q] != own[h] if two else np.ones(len(q), dtype=bool)
            both = np.flatnonzero(some[q] & some[h])
            for lo in range(0, len(both), 1 << 16):
                k = both[lo : lo + (1 << 16)]
                keep[k] &= ~(before[q[k]] & before[h[k]]).any(axis=1)
            return q[keep], h[keep]

        links, found = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        group = np.arange(n)
        for q, h in find(units, neighbours, beam=beam):
            group = connected(n, q, h, group)
            q, h = counted(q, h)
            links += np.bincount(q, weights=copies[h], minlength=n).astype(np.int64)
            found += np.bincount(q, minlength=n)
        audit = np.flatnonzero((node * 0x9E3779B1 >> 7) % AUDIT == 0)
        truth = np.bincount(counted(*every_link(units, audit))[0], minlength=n)
        seen = np.zeros(n, dtype=np.int64)
        seen[audit] = found[audit]
        least = rows["least"].to_numpy()
        root = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(root, group, least)
        return pd.DataFrame({"node": node, "links": links, "least": least, "root": root[group], "audited": truth, "audited_found": seen})

    return written(sharded.join(united, "node", "left").groupBy(*KEYS).applyInPandas(walk, FOUND))


def recall(found: DataFrame) -> tuple[int, int]:
    """Links of the audited vectors, and those of them that the search found."""
    row = found.agg(F.sum("audited").alias("links"), F.sum("audited_found").alias("found")).collect()[0]
    return row["links"] or 0, row["found"] or 0


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (id, embedding, label)."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.when(valid(F.col("embedding")) & F.col("label").isNotNull() & F.col(id_col).isNotNull(), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))).alias("space"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    keyed = rows.withColumn("print", F.when(F.col("space").isNotNull(), F.sha2(F.to_json(F.struct("space", "x")).cast("binary"), 256)))
    keyed = written(keyed)
    nodes = keyed.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("x").alias("x"))
    # a node is a number of its own: one id may stand with several vectors
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    # a search that finds too little is made again, wider
    for beam in (BEAM, 4 * BEAM, 16 * BEAM):
        found = search(nodes.select("space", "node", "least", "copies", "x"), shard, beam)
        links, seen = recall(found)
        if seen >= LEAST_RECALL * links:
            break
    else:
        raise RuntimeError(f"the search found {seen} of {links} audited links")
    others = found.groupBy("node").agg(F.sum("links").alias("others"))
    # groups are joined by ids, which stand in the shards already: no vector is looked up by its group
    group = components(found.where("least <> root").select(F.col("least").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("node", "least")
    of = nodes.select("print", "node", "least", "copies").join(others, "node", "left").join(group, "least", "left")
    of = of.select("print", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = keyed.select("vec_id", "print").join(of, "print", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (SELECT a AS node, a AS hit FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.hit),
c AS (SELECT node, min(hit) AS component FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
