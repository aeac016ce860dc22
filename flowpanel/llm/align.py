"""Operator 12: aligning the tokens of two tokenizers by a sweep over their end events.

Each text is encoded by both tokenizers. The ends of their tokens are events on the text's
byte offsets: the events of both are united, moved to the document's partition, sorted there
by offset, and stream through a machine that holds the tokens since the last offset at which
both tokenizers end one. At such an offset a group closes: its A tokens and B tokens are linked
pair by pair. Neighbouring events of one tokenizer travel as one row (at most RUN of them: the
first one's start and their ids, whose lengths are known), so the machine holds two runs and
the open group, however long a text is.

Counts: a block of documents, closed when it holds about BLOCK id pairs, sends each of its
distinct pairs once, with the number of its documents that hold it; sums and the best of each A
id come from these rows, and answers go back to the blocks that asked. Documents keep their
pairs as places in the block's list. So neither links nor pairs of documents are shuffled, a
pair has a row for each block at most, and a task scores one block at a time.

Null and empty texts, and texts whose joined token bytes are not space + text (a text with the
word mark U+2581, for one), have no tokens: zeros and an empty string. Repeated rows are
documents of their own (each counts once for a pair); rows without an id are scored like others.
Very long texts stream run by run. Other columns, whatever their names, are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, small_batches, table, written
from .subwords import Side, parts, side

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Events of a row, id pairs of a block, about, and links of a group that are listed one by one at most.
RUN, BLOCK, WIDE = 2048, 1_000_000, 1024

EVENTS = "at bigint, doc_id bigint, start bigint, side int, ids binary"
GROUPS = "doc_id bigint, group bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>"
SWEPT = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, pair bigint, docs bigint"
SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _sides(a: str, b: str) -> tuple[Side, Side]:
    both = side(a), side(b)
    only("align", lambda: [s.memo.clear() for s in both])
    return both


def end_events(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The events of both tokenizers, united: at (the row's number), doc_id, start (byte offset
    of the first token's begin in space + text), side (0 or 1), ids (of up to RUN tokens, in
    order). A text without tokens has one row without ids."""
    small_batches(docs.sparkSession)
    schema = _arrow(EVENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _sides(a, b)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            split = [parts(t) if t else [] for t in texts]
            encoded = [s.memo.ids(split) for s in both]
            rows = []
            for k, (at, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if not texts[k] or not all(s.whole(split[k], e[k], texts[k]) for s, e in zip(both, encoded)):
                    rows.append((at, doc, 0, 0, b""))
                    continue
                for i, (s, e) in enumerate(zip(both, encoded)):
                    step = RUN * s.kind.itemsize
                    start = 0
                    for j in range(0, len(e[k]), step):
                        ids = e[k][j : j + step]
                        rows.append((at, doc, start, i, ids))
                        start += int(s.length[np.frombuffer(ids, s.kind)].sum())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    picked = docs.select(F.monotonically_increasing_id().alias("at"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, EVENTS)


def sorted_events(events: DataFrame) -> DataFrame:
    return events.repartition("at").sortWithinPartitions("at", "start", "side")


class Sweep:
    """The machine over one document's events in order of offset. Runs come in; whole groups go
    out as (A ids, their groups, B ids, their groups, number of groups, byte offsets of the groups' ends)."""

    def __init__(self, both: tuple[Side, Side]) -> None:
        self.length = [s.length for s in both]
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def add(self, i: int, start: int, ids: np.ndarray):
        self.ids[i] = np.concatenate([self.ids[i], ids.astype(np.int64)])
        self.ends[i] = np.concatenate([self.ends[i], start + np.cumsum(self.length[i][ids])])
        a, b = self.ends
        if not (len(a) and len(b)):
            return None
        # a group ends where both do; tokens of no bytes belong to the group before the next end
        low = min(int(a[0]), int(b[0]))
        mark = np.zeros(max(int(a[-1]), int(b[-1])) - low + 1, bool)
        mark[a - low] = True
        common = b[mark[b - low]]
        if not len(common):
            return None
        common = common[np.append(True, common[1:] > common[:-1])]
        out = []
        for k in (0, 1):
            n = int(np.searchsorted(self.ends[k], common[-1], "right"))
            out += [self.ids[k][:n], np.searchsorted(common, self.ends[k][:n])]
            self.ids[k], self.ends[k] = self.ids[k][n:], self.ends[k][n:]
        return *out, len(common), common


def _pairs(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs (A << 32 | B) of n groups, and how many links each has."""
    size = np.bincount(of_b, minlength=n)
    size_a = np.bincount(of_a, minlength=n)
    wide = size * size_a > WIDE
    narrow = ~wide[of_a]
    begin = np.cumsum(size) - size
    each = size[of_a[narrow]]
    inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    found = [np.unique(np.repeat(a[narrow] << 32, each) | b[np.repeat(begin[of_a[narrow]], each) + inside], return_counts=True)]
    begin_a = np.cumsum(size_a) - size_a
    for g in np.flatnonzero(wide).tolist():  # a group of many tokens: its distinct ids, times their counts
        x, n_x = np.unique(a[begin_a[g] : begin_a[g] + size_a[g]], return_counts=True)
        y, n_y = np.unique(b[begin[g] : begin[g] + size[g]], return_counts=True)
        found.append((np.ravel(x[:, None] << 32 | y), np.ravel(n_x[:, None] * n_y)))
    return found[0] if len(found) == 1 else _merged(found)


def _decimals(both: tuple[Side, Side]) -> np.ndarray:
    """Texts of ids: each A id before another and before B, each B id before another and before a group."""
    return np.array([b"%d%s" % (i, end) for s, ends in zip(both, ((b",", b"|"), (b",", b";"))) for end in ends for i in range(s.size)], object)


def _text(both: tuple[Side, Side], table: np.ndarray, a, of_a, b, of_b) -> bytes:
    """The groups as a1,a2|b1; and so on, in order."""
    out = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
    out[np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")] = a + last_a * both[0].size
    out[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b + last_b * both[1].size + 2 * both[0].size
    return b"".join(table[out].tolist())


def _documents(batches: Iterator[pa.RecordBatch], both: tuple[Side, Side]):
    """Each document's (at, doc_id) and the groups that its sweep closes, in order, as an iterator
    to be read to its end."""
    now, sweep = None, None
    for batch in batches:
        for at, doc, start, i, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if at != now:
                now, sweep = at, Sweep(both)
                yield at, doc, None
            if ids and (closed := sweep.add(i, start, np.frombuffer(ids, both[i].kind))):
                yield at, doc, closed


def _pack(values: np.ndarray) -> bytes:
    """Rising numbers as differences: low bytes, then the rest, compressed."""
    import zstandard

    d = np.diff(values, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress((d & 255).astype(np.uint8).tobytes() + (d >> 8).astype("<u4").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 5
    return np.cumsum(np.frombuffer(raw, np.uint8, n).astype(np.int64) + (np.frombuffer(raw, "<u4", n, n).astype(np.int64) << 8))


def swept(events: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Documents with their counts, digest and places in their block's list, and the lists: one
    row per block and distinct pair, with the number of the block's documents that hold it."""
    schema = _arrow(SWEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = _sides(a, b)
        table = _decimals(both)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        docs: list[list] = []  # doc_id, n_a, n_b, n_groups, n_links, hash, distinct pairs, times
        held = blocks = 0

        def close(doc: list) -> None:
            doc[5] = doc[5].hexdigest() if doc.pop() else ""
            doc[6:] = _merged(doc[6]) if doc[6] else (np.empty(0, np.int64),) * 2

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, blocks
            at = base + blocks
            keys, n = np.unique(np.concatenate([d[6] for d in docs]), return_counts=True)
            columns = [[at] * len(docs), *([d[k] for d in docs] for k in range(6)), [_pack(np.searchsorted(keys, d[6])) for d in docs], [_pack(np.cumsum(d[7])) for d in docs], [None] * len(docs), [None] * len(docs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
            for k in range(0, len(keys), 1 << 16):
                m = len(keys[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, at)), *(pa.nulls(m, t) for t in schema.types[1:9]), pa.array(keys[k : k + m]), pa.array(n[k : k + m], pa.int64())], schema=schema)
            docs, held, blocks = [], 0, blocks + 1

        for _, doc, closed in _documents(batches, both):
            if closed is None:
                if docs:
                    close(docs[-1])
                    held += len(docs[-1][6]) + 16
                    if held >= BLOCK:
                        yield from block()
                docs.append([doc, 0, 0, 0, 0, hashlib.sha256(), [], None, False])
                continue
            ids_a, of_a, ids_b, of_b, n, _ = closed
            d = docs[-1]
            text = _text(both, table, ids_a, of_a, ids_b, of_b)
            d[5].update((b";" if d[8] else b"") + text[:-1])
            pairs = _pairs(ids_a, of_a, ids_b, of_b, n)
            d[1] += len(ids_a)
            d[2] += len(ids_b)
            d[3] += n
            d[4] += int(pairs[1].sum())
            d[6].append(pairs)
            if len(d[6]) > 16:  # a long text's pairs, merged as it goes
                d[6] = [_merged(d[6])]
            d[8] = True
        if docs:
            close(docs[-1])
            yield from block()

    return sorted_events(events).mapInArrow(run, SWEPT)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def link_counts(lists: DataFrame) -> DataFrame:
    """pair, docs (documents corpus-wide that hold it linked), best (whether no pair of its A id has more)."""
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(swept(end_events(docs, a, b, id_col, text_col), a, b))
    lists = rows.where("pair is not null").select("block", "pair", "docs")
    # counted once, read by the answers; a pair has a row for each block at most
    counts = written(link_counts(lists))
    answers = lists.select(F.col("block").alias("asked"), "pair").join(counts, "pair").select("asked", "pair", "docs", "best")
    schema = _arrow(SCORED)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        n = right["docs"].to_numpy()[order]
        best = right["best"].to_numpy(zero_copy_only=False)[order]
        out = []
        for places, times in zip(left["places"].to_pylist(), left["times"].to_pylist()):
            at, m = _unpack(places), np.diff(_unpack(times), prepend=0)
            out.append((int(m[best[at]].sum()), int((m * n[at]).sum())))
        columns = [left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*columns, *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)), left["groups_sha256"]], schema=schema)

    docs_only = rows.where("pair is null").select("block", *(f.name for f in rows.schema if f.name not in ("block", "pair", "docs")))
    return docs_only.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(score, SCORED)


def groups(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves, in order: doc_id, group (from 0), start and end (byte offsets in
    space + text), a_ids, b_ids. Texts without tokens have none."""
    schema = _arrow(GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _sides(a, b)
        number = start = 0
        for _, doc, closed in _documents(batches, both):
            if closed is None:
                number = start = 0
                continue
            ids_a, of_a, ids_b, of_b, n, ends = closed
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(ids, pa.int32())) for ids, of in ((ids_a, of_a), (ids_b, of_b))]
            columns = [pa.array([doc] * n, pa.int64()), pa.array(np.arange(number, number + n)), pa.array(np.append(start, ends[:-1])), pa.array(ends), *lists]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            number, start = number + n, int(ends[-1])

    return sorted_events(end_events(docs, a, b, id_col, text_col)).mapInArrow(run, GROUPS)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
