r"""Operator 8: MinHash near-dedup by fast similarity sketching.

A document's set holds the 64-bit hashes of its distinct five-word shingles. The sketch is
filled in rounds: in round i < t every element is thrown into a hashed bin with the value
(i, hash), in round t + j all go to bin j, and a bin keeps its least value; the rounds stop
when all t bins are full. So every coordinate fills, equal coordinates estimate the Jaccard
similarity, and the estimate concentrates as if the coordinates were independent.

Documents with equal sets collapse to their smallest id first. Bands of four coordinates
give candidate buckets. Components need no pairs inside a linked group, so links are sought in
three steps, each confirmed on the full sets: (1) a bucket's members against its smallest id;
(2) each member of a bucket that still holds several components against its most similar
member of another one; (3) all remaining pairs of a bucket across components. Buckets are
compared in blocks of bounded size, by a finer sketch of the documents in open buckets. Pairs
whose sketches agree in fewer than ``LEAST_AGREE`` (steps 2 and 3: or ``FINE_AGREE``)
coordinates are passed over, which at the threshold happens with probability below 1e-6.

Words are maximal runs without ASCII white space, A-Z in lower case. A text with fewer than five words
is one shingle; null texts and texts without words have none, link with nothing and are
kept. Very long texts are sketched and compared whole. Rows without an id link with nothing.
Rows that repeat an id share its group. An empty table gives an empty result. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, only, small_batches, table, written

WIDTH = 5
SIMILAR, OF = 75, 100
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Six standard deviations below the agreement expected at the threshold.
LEAST_AGREE = 67
#: Coordinates of the finer sketch, eight bits of each, and the same bound for it.
FINE = 1024
FINE_AGREE = 684
#: Members of a block of a bucket: a task holds two blocks of FINE bytes a member.
BLOCK = 1024

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 48) - 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _begin() -> None:
    only("near_dup", _HASHES.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _M2 + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each set that is not empty; empty sets keep the mark."""
    out = np.full(len(sets) * t, _EMPTY, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    x = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    for i in range(2 * t):
        if not len(x):
            break
        h = _mix(x ^ _mix(np.array([i + 1], dtype=np.uint64)))
        bins = (h >> np.uint64(48)).astype(np.int64) % t if i < t else i - t
        np.minimum.at(out, owner * t + bins, (np.uint64(i) << np.uint64(48)) | (h & _LOW))
        open_ = (out.reshape(-1, t) == _EMPTY).any(axis=1)
        keep = open_[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
    return out.reshape(-1, t)


def _bands(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band, which also tells the bands apart."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * _M1 + parts[:, :, k])
    return key.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n, print (of the whole set), bands, brief (16 bits of each coordinate)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.string()), ("bands", pa.list_(pa.int64())), ("brief", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            sketch = sketches(sets)
            bands, brief = _bands(sketch), (sketch & np.uint64(0xFFFF)).astype(np.uint16)
            some = [len(s) > 0 and i is not None for s, i in zip(sets, batch.column(0).to_pylist())]
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if ok else None for s, ok in zip(sets, some)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.string()),
                    pa.array([b if ok else None for b, ok in zip(bands, some)], pa.list_(pa.int64())),
                    pa.array([b.tobytes() if ok else None for b, ok in zip(brief, some)], pa.binary()),
                ],
                schema=schema,
            )

    picked = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n bigint, print string, bands array<bigint>, brief binary")


def _agreeing(a: pa.Array, b: pa.Array) -> np.ndarray:
    one = lambda x: np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint16).reshape(len(x), COORDINATES)
    return (one(a) == one(b)).sum(axis=1)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda k: nodes.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("brief").alias(f"brief_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((OF * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _agreeing(batch.column("brief_a"), batch.column("brief_b")) >= LEAST_AGREE
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "brief_a", "brief_b").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame, fine: bool = False) -> DataFrame:
    """doc_id, n, set, fine (the finer sketch, or null) of the documents in ids (doc_id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("fine", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            briefs = [b.tobytes() for b in (sketches(sets, FINE) & np.uint64(0xFF)).astype(np.uint8)] if fine else [None] * len(sets)
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(briefs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    small_batches(docs.sparkSession)
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    return some.mapInArrow(make, "doc_id bigint, n bigint, set binary, fine binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link by their full sets (doc_id, set)."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                every = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((every[1:] == every[:-1]).sum())
                ok.append(OF * common >= SIMILAR * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a bigint, b bigint").distinct()


def _across(members: DataFrame, best_only: bool) -> DataFrame:
    """Likely pairs (a < b) across components inside buckets.

    members: key, size (of the bucket), doc_id, component, n, fine, bands. A bucket of more
    than BLOCK members is compared block by block, each pair of blocks in a group of its own.
    Without best_only a pair comes from the first bucket that its two share, and no other:
    as its components differ, that bucket is open too (or of two, and its pair tested).
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), blocks).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", "n", "fine", "bands")
    spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def group(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(rows)
        ids, comp, n, own = (rows.column(c).to_numpy() for c in ("doc_id", "component", "n", "own"))
        fine = np.frombuffer(b"".join(rows.column("fine").to_pylist()), dtype=np.uint8).reshape(-1, FINE)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        key = rows.column("key")[0].as_py()
        coarse = np.ascontiguousarray(fine[:, :COORDINATES])
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        found_a, found_b = [], []
        for k in range(len(ids)):
            ok = (comp != comp[k]) & (OF * np.minimum(n, n[k]) >= SIMILAR * np.maximum(n, n[k]))
            if i != j:
                ok &= own != own[k]
            if not best_only:
                ok &= ids > ids[k]
            at = np.flatnonzero(ok)
            at = at[np.count_nonzero(coarse[at] == coarse[k], axis=1) >= LEAST_AGREE]
            agree = np.count_nonzero(fine[at] == fine[k], axis=1)
            at, agree = at[agree >= FINE_AGREE], agree[agree >= FINE_AGREE]
            if best_only and len(at):
                at = at[np.lexsort((ids[at], -agree))[:1]]
            elif len(at):
                first = (bands[at] == bands[k]).argmax(axis=1)
                at = at[bands[k][first] == key]
            found_a.append(np.minimum(ids[at], ids[k]))
            found_b.append(np.maximum(ids[at], ids[k]))
        return np.concatenate(found_a), np.concatenate(found_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group that goes on; at most two blocks
        was = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(keys[lo])
                if held and now != was:
                    a, b = group(held)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                    held = []
                was = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            a, b = group(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    all_ = written(sketched(docs))
    known = all_.where("print is not null")
    # one node for each distinct set; equal sets have equal sketches
    nodes = written(known.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("brief").alias("brief")))
    buckets = nodes.select("doc_id", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).where("size > 1")
    members = written(buckets.join(sizes, "key").select("key", "size", "a", "doc_id"))
    tested = written(_likely(members.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), nodes))
    ends = tested.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    links = written(_confirmed(tested, written(_sets(docs, ends))))
    sets = None
    for best_only in (True, False):
        group = components(links)
        # buckets of two had their only pair tested
        placed = members.where("size > 2").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        open_ = written(placed.join(mixed, "key").select("key", "size", "doc_id", "component"))
        if sets is None:  # later buckets are among these
            sets = written(_sets(docs, open_.select("doc_id").distinct(), fine=True).join(nodes.select("doc_id", "bands"), "doc_id"))
        more = written(_across(open_.join(sets.select("doc_id", "n", "fine", "bands"), "doc_id"), best_only).join(tested, ["a", "b"], "left_anti"))
        # even if the most similar partners were all refused before, others may link
        if more.isEmpty():
            continue
        tested = tested.unionByName(more)
        links = written(links.unionByName(_confirmed(more, sets)))
    group = components(links)
    smallest = nodes.select("print", F.col("doc_id").alias("node")).join(group, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = all_.select("doc_id", "n", "print").join(smallest, "print", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS node, a AS hit FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.hit),
c AS (SELECT node, min(hit) AS component FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(c.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
