"""Operator 5: language-model scoring by cross-entropy difference.

Two bigram models, one of a target (documents labelled of high quality) and one of the
background (all documents), share one vocabulary and one smoothing; the target's counts are
scaled to the background's number of tokens, so that both are smoothed alike at any size. A
document's score is the mean over its tokens of the background's loss less the target's: high
for texts that are more like the target than the corpus at large.

No document is scored by a model that saw it: its own counts are taken out of both models
before its tokens are looked up. So a target document gains nothing from its label, and a
text whose copy stands elsewhere is told from one that stands once.

Words and pairs are counted exactly, under keys of 64 bits, so the models grow with the
corpus: no cap, no shared cells. Documents are dealt to blocks of about ``BLOCK`` tokens,
written once. A block lists each of its words and pairs once with its own counts, cut by key
into buckets whose number follows the input, and sends a list to those buckets alone that hold
a key of its own, so lists are never more than keys; a bucket adds up the lists of all blocks
and answers each of them with the corpus counts in the order asked; a block then scores its
documents. The size of the vocabulary is counted by the same buckets before. A pair that stands in every document stands once in a block's list, as any other.

Tokens are the white-space separated words in ASCII lower case. Null and empty texts have no
tokens and score 0; a very long text is a block of its own. Repeated rows count as often as they
stand, and each row is taken out of the models once when it is scored; an empty table gives an
empty result; other columns, whatever their names, are not read. The target counts every row
whose id is labelled good; where no other such row is left, target and background agree and the
score is 0. Up to MOST_SENT labelled ids are sent to the tasks as a sorted array, 8 bytes each,
in which they look ids up; more are joined to the documents, which gives the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, small_batches, table, written

#: Tokens of one block, and bytes of text for each bucket of keys.
BLOCK = 1_750_000
BUCKET_BYTES = 16 << 20
LAMBDA, ALPHA = 0.6, 0.5
#: Labelled ids that are sent to the tasks at most (32 MB).
MOST_SENT = 4_000_000
#: Tokens that are scored at a time.
CHUNK = 1 << 18


class _Keys(dict):
    """word -> key of 64 bits; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n


_KEYS = _Keys()


def _begin() -> None:
    only("lm_score", _KEYS.clear)


def keys(text: str | None) -> np.ndarray:
    """The keys of the tokens."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_KEYS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + after
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pack(x: np.ndarray) -> bytes:
    """An array of 8-byte numbers, its bytes by place and compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def _unpack(b: bytes, dtype: type = np.int64) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[8:], 8 * n, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(dtype)


def _pack_keys(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _pairs(words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of each token and the one before it in ``at``, and the key of their pair.

    ``at`` holds for each text with tokens a start (key 0) and its tokens.
    """
    there = lengths[lengths > 0] + 1
    ends = np.cumsum(there)
    first, last = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    first[ends - there], last[ends - 1] = True, True
    before, after = at[~last], at[~first]
    return before, after, _pair_keys(words[before], words[after])


def _flagged(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """docs (doc_id, text), and the distinct labelled ids if they are few; else docs with the column
    good, which says whether the id is labelled, and None. Only few ids reach the driver."""
    ids = target.select(F.col(target.columns[0]).cast("bigint").alias("_id")).where("_id is not null").distinct()
    ids = written(ids)
    if ids.count() <= MOST_SENT:
        return docs, np.sort(ids.toArrow().column(0).to_numpy().astype(np.int64))
    joined = docs.join(ids, F.col("doc_id") == F.col("_id"), "left")
    return joined.select("doc_id", "text", F.col("_id").isNotNull().alias("good")), None


def _blocks(docs: DataFrame, target: np.ndarray | None) -> DataFrame:
    """Blocks of documents: ids, numbers of tokens, which are of the target (by the ids given, or by
    the column good), distinct words and the place of each token."""
    sent = None if target is None else docs.sparkSession.sparkContext.broadcast(target)
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("n_good", pa.int64()), *[(k, pa.binary()) for k in ("lengths", "good", "words", "at")]])

    def looked_up(ids: list) -> np.ndarray:
        own = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        good = np.searchsorted(sent.value, own, "right") > np.searchsorted(sent.value, own)
        return good & np.array([i is not None for i in ids], dtype=bool)

    def packed(block: int, ids: list, texts: list[np.ndarray], good: np.ndarray) -> pa.RecordBatch:
        start = np.zeros(1, dtype=np.uint64)
        words, at = np.unique(np.concatenate([start[:0], *[y for x in texts if len(x) for y in (start, x)]]), return_inverse=True)
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        row = {"block": block, "ids": ids, "n": int(lengths.sum()), "n_good": int(lengths[good].sum()), "lengths": _pack(lengths), "good": _pack(good.astype(np.int64))}
        return pa.RecordBatch.from_pylist([row | {"words": _pack_keys(words), "at": _pack(at.astype(np.int64))}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _begin()
        block, ids, texts, good, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            flags = batch.column(2).to_pylist() if sent is None else looked_up(own).tolist()
            for i, text, flag in zip(own, batch.column(1).to_pylist(), flags):
                ids.append(i)
                texts.append(keys(text))
                good.append(flag)
                size += len(texts[-1])
                if size >= BLOCK or len(ids) >= BLOCK:
                    yield packed(block, ids, texts, np.array(good, dtype=bool))
                    block, ids, texts, good, size = block + 1, [], [], [], 0
        if ids:
            yield packed(block, ids, texts, np.array(good, dtype=bool))

    return docs.mapInArrow(run, "block bigint, ids array<bigint>, n bigint, n_good bigint, lengths binary, good binary, words binary, at binary")


def _cut(x: np.ndarray, buckets: int) -> dict[int, slice]:
    """The buckets that hold any of the sorted keys, and where their keys stand."""
    of = ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    there, first = np.unique(of, return_index=True)
    return {k: slice(a, b) for k, a, b in zip(there.tolist(), first.tolist(), [*first.tolist()[1:], len(x)])}


def _vocabulary(blocks: DataFrame, buckets: int) -> int:
    """The number of distinct words of all blocks; counts alone reach the driver."""
    schema = pa.schema([("bucket", pa.int64()), ("words", pa.binary())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0).to_pylist():
                words = _unpack_keys(words)
                words = words[words > 0]  # not the start of a text
                rows = [{"bucket": k, "words": _pack_keys(words[a])} for k, a in _cut(words, buckets).items()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def distinct(rows: pa.Table) -> pa.Table:
        n = len(np.unique(np.concatenate([_unpack_keys(x) for x in rows.column("words").to_pylist()])))
        return pa.table({"n": pa.array([n], pa.int64())})

    lists = blocks.select("words").mapInArrow(listed, "bucket bigint, words binary")
    return lists.groupBy("bucket").applyInArrow(distinct, "n bigint").agg(F.sum("n")).collect()[0][0] or 0


def _lists(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's keys and counts of each bucket that holds any of them."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *[(k, pa.binary()) for k in ("words", "word_counts", "pairs", "pair_counts")]])

    def listed(block: int, lengths: bytes, good: bytes, words: bytes, at: bytes) -> pa.RecordBatch:
        lengths, words = _unpack(lengths), _unpack_keys(words)
        before, after, pair = _pairs(words, _unpack(at), lengths)
        of_good = np.repeat(_unpack(good) > 0, lengths)
        each = [np.bincount(x, minlength=len(words)) for x in (after, after[of_good], before, before[of_good])]
        del before, after
        pairs, place = np.unique(pair, return_inverse=True)
        both = [np.bincount(x, minlength=len(pairs)) for x in (place, place[of_good])]
        rows, none, w, p = [], slice(0, 0), _cut(words, buckets), _cut(pairs, buckets)
        for k in sorted({*w, *p}):
            a, b = w.get(k, none), p.get(k, none)
            rows.append({"block": block, "bucket": k, "words": _pack_keys(words[a]), "word_counts": _pack(np.concatenate([x[a] for x in each])), "pairs": _pack_keys(pairs[b]), "pair_counts": _pack(np.concatenate([x[b] for x in both]))})
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield listed(**row)

    part = blocks.select("block", "lengths", "good", "words", "at")
    return part.mapInArrow(run, "block bigint, bucket bigint, words binary, word_counts binary, pairs binary, pair_counts binary")


def _answers(lists: DataFrame) -> DataFrame:
    """For each list of a bucket, the corpus counts of its keys."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("word_counts", pa.binary()), ("pair_counts", pa.binary())])

    def summed(listed: list[np.ndarray], counts: list[np.ndarray], kinds: int) -> list[bytes]:
        every, place = np.unique(np.concatenate(listed), return_inverse=True)
        own = np.concatenate([x.reshape(kinds, -1) for x in counts], axis=1)
        # doubles hold whole numbers to 2**53
        total = np.stack([np.bincount(place, weights=x, minlength=len(every)) for x in own]).astype(np.int64)
        ends = np.cumsum([0, *map(len, listed)])
        return [_pack(total[:, place[a:b]].reshape(-1)) for a, b in zip(ends, ends[1:])]

    def run(rows: pa.Table) -> pa.Table:
        got = {k: rows.column(k).to_pylist() for k in ("words", "word_counts", "pairs", "pair_counts")}
        words = summed([_unpack_keys(x) for x in got["words"]], [_unpack(x) for x in got["word_counts"]], 4)
        pairs = summed([_unpack_keys(x) for x in got["pairs"]], [_unpack(x) for x in got["pair_counts"]], 2)
        return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"), pa.array(words, pa.binary()), pa.array(pairs, pa.binary())], schema=schema)

    return lists.groupBy("bucket").applyInArrow(run, "block bigint, bucket bigint, word_counts binary, pair_counts binary")


def _scored(left: pa.Table, right: pa.Table, v: int, n: int, n_t: int) -> pa.Table:
    """The scores of a block; v, n, n_t: the vocabulary, and the tokens of background and target."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(k, pa.float64()) for k in ("target_loss", "background_loss", "score")]])
    (row,), answers = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["bucket"])
    words, lengths, at = _unpack_keys(row["words"]), _unpack(row["lengths"]), _unpack(row["at"])
    before, after, pair = _pairs(words, at, lengths)
    place = np.unique(pair, return_inverse=True)[1]
    count, count_t, context, context_t = np.concatenate([np.zeros((4, 0), np.int64), *[_unpack(r["word_counts"]).reshape(4, -1) for r in answers]], axis=1)
    both, both_t = np.concatenate([np.zeros((2, 0), np.int64), *[_unpack(r["pair_counts"]).reshape(2, -1) for r in answers]], axis=1)
    good, ends = _unpack(row["good"]), np.cumsum(lengths)
    sums = np.zeros((2, len(lengths)))

    def own(text: np.ndarray, x: np.ndarray, kinds: int) -> np.ndarray:
        """How often each x stands in its own text."""
        _, place, n = np.unique(text * kinds + x, return_inverse=True, return_counts=True)
        return n[place]

    # whole texts, about CHUNK tokens at a time
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        until = max(first + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
        cut = slice(begin, ends[until - 1])
        w, c, p = after[cut], before[cut], place[cut]
        text = np.repeat(np.arange(until - first), lengths[first:until])
        own_w, own_c, own_p = own(text, w, len(words)), own(text, c, len(words)), own(text, p, both.size)
        size = lengths[first:until]

        def losses(count: np.ndarray, context: np.ndarray, pairs: np.ndarray, mine: np.ndarray, scale: np.ndarray) -> np.ndarray:
            m = mine[text]
            single = (1 - LAMBDA) * ((count[w] - m * own_w) * scale[text] + ALPHA) / (n - size + ALPHA * v)[text]
            return -np.log(single + LAMBDA * (pairs[p] - m * own_p) / np.maximum(context[c] - m * own_c, 1))

        every = losses(count, context, both, np.ones_like(size), np.ones(len(size)))
        mine = good[first:until]
        rest = n_t - mine * size
        other = losses(count_t, context_t, both_t, mine, (n - size) / np.maximum(rest, 1))
        other = np.where((rest > 0)[text], other, every)
        for k, x in enumerate((every, other)):
            sums[k, first:until] = np.bincount(text, weights=x, minlength=until - first)
        first = until
    b, t = sums / np.maximum(lengths, 1)
    return pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(lengths), pa.array(t), pa.array(b), pa.array(b - t)], schema=schema)


def exact_score(docs: DataFrame, target: DataFrame | np.ndarray) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score, from exact counts of all documents.
    target: the labelled ids, as the first column of a table, or an array of a few."""
    small_batches(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    flagged = _flagged(docs, target) if isinstance(target, DataFrame) else (docs, np.unique(target))
    blocks = written(_blocks(*flagged))
    buckets = 1 + size // BUCKET_BYTES
    v = _vocabulary(blocks, buckets)
    n, n_t = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("n_good")).collect()[0])
    answers = _answers(_lists(blocks, buckets))
    texts = blocks.select("block", "ids", "lengths", "good", "words", "at")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: _scored(left, right, v, n, n_t), "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint"))
    return exact_score(docs, good)
