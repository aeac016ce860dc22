"""Operator 2: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every adjacent pair whose bytes are a vocabulary entry sits in the bucket of its merge rank. A
bitmap of two levels marks the ranks whose buckets hold entries; find-first-set picks the least
rank, and the live positions of its bucket merge from the left. Positions are nodes of linked
lists over the bytes; a merge pushes the pairs it creates and leaves outdated entries behind,
which are skipped when popped. So n bytes cost about n pushes, however long a pre-token is.

Pre-tokens don't touch, so one queue serves many: the new short pre-tokens of some texts share
their buckets. A worker remembers, for short pre-tokens, the ids as joined decimals, and for
these decimals the bytes that they decode to; a text's ids and its decoded bytes are joined from
them. Longer pre-tokens each have a queue of their own and are not remembered.

Texts: null and empty texts have no tokens; rows without an id are encoded like others; texts are
encoded whole. Repeated rows give
repeated results, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import only, small_batches, table

#: Entries of each of the two generations of a worker's memo of pre-tokens. It saves work only.
MEMO = 150_000
#: Longer pre-tokens are not remembered, so that the memo stays small in bytes.
MEMO_CHARS = 48
#: Characters of the texts whose pre-tokens are held at once, if there are several.
GROUP_CHARS = 1 << 20


class BytePairEncoder:
    """Encodes and decodes by a rank file and a pattern that splits texts into pre-tokens.

    The rank queue: ``buckets[rank]`` is a heap of positions, bit ``rank & 63`` of
    ``low[rank >> 6]`` says that the bucket exists, bit ``rank >> 6`` of the upper word says
    that this lower word is not zero. Both find-first-set steps are ``x & -x``.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        if size > 1 << 17:
            raise ValueError("ids of at most 17 bits are packed in pairs")
        self.bytes_of: list[bytes] = [b""] * size
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = [self.ranks[bytes([i])] for i in range(256)]
        #: rank of each pair of bytes, -1 if none
        self.first = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        #: left id << 17 | right id -> id of the two together
        self.pair = {
            self.ranks[piece[:k]] << 17 | self.ranks[piece[k:]]: rank
            for piece, rank in self.ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in self.ranks and piece[k:] in self.ranks
        }
        self.split = regex.compile(pattern).findall
        self.low = [0] * ((size >> 6) + 1)
        self.buckets: list[list[int]] = [[]] * size
        #: pre-token -> its ids as joined decimals, and the bytes that they decode to
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, get, low = len(piece), self.pair.get, self.low
        byte_id = self.byte_id
        ids = [byte_id[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        due = [-1] * n  # of each live position: the rank of its pair with the next
        buckets: dict[int, list[int]] = {}
        upper = 0
        left = ids[0]
        for at in range(n - 1):
            right = ids[at + 1]
            r = get(left << 17 | right)
            left = right
            if r is not None:
                due[at] = r
                if r in buckets:
                    buckets[r].append(at)  # ascending, so still a heap
                else:
                    buckets[r] = [at]
                    low[r >> 6] |= 1 << (r & 63)
                    upper |= 1 << (r >> 6)
        while upper:
            j = (upper & -upper).bit_length() - 1
            word = low[j]
            rank = j << 6 | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            at = heapq.heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                del buckets[rank]
                low[j] = word = word & (word - 1)
                if not word:
                    upper &= upper - 1
            if due[at] != rank:
                continue
            ids[at] = rank
            gone = after[at]
            due[gone] = due[at] = -1
            after[at] = follows = after[gone]
            if follows < n:
                before[follows] = at
                if (r := get(rank << 17 | ids[follows])) is not None:
                    due[at] = r
                    if r in buckets:
                        heapq.heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        low[r >> 6] |= 1 << (r & 63)
                        upper |= 1 << (r >> 6)
            if (at := before[at]) >= 0:
                due[at] = -1
                if (r := get(ids[at] << 17 | rank)) is not None:
                    due[at] = r
                    if r in buckets:
                        heapq.heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        low[r >> 6] |= 1 << (r & 63)
                        upper |= 1 << (r >> 6)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many short pre-tokens, by one queue.

        Where a merge makes a pair of a lower rank, the rest of its pre-token waits for that one.
        """
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        codes = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        n, get, low = len(codes), self.pair.get, self.low
        ends = np.cumsum(sizes)
        ranks = np.full(n, -1, dtype=np.int64)
        ranks[:-1] = self.first[codes[:-1] << 8 | codes[1:]]
        ranks[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = n, -1
        ends, none = ends.tolist(), []
        ids, due, after, before = np.array(self.byte_id)[codes].tolist(), ranks.tolist(), after.tolist(), before.tolist()
        buckets = self.buckets
        upper = 0
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        present, starts = np.unique(ranks[order], return_index=True)
        order = order.tolist()
        for r, lo, hi in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            buckets[r] = order[lo:hi]
            low[r >> 6] |= 1 << (r & 63)
            upper |= 1 << (r >> 6)
        waiting: list[int] = []
        while upper:
            j = (upper & -upper).bit_length() - 1
            word = low[j]
            rank = j << 6 | ((word & -word).bit_length() - 1)
            low[j] = word = word & (word - 1)
            if not word:
                upper &= upper - 1
            bucket, buckets[rank] = buckets[rank], none
            if len(bucket) > 1:
                bucket.sort()
            base, end = rank << 17, 0
            for at in bucket:
                if due[at] != rank:
                    continue
                if at < end:
                    waiting.append(at)
                    continue
                gone = after[at]
                after[at] = follows = after[gone]
                ids[at] = rank
                ids[gone] = due[gone] = due[at] = -1
                if follows < n:
                    before[follows] = at
                    if (r := get(base | ids[follows])) is not None:
                        due[at] = r
                        if bucket := buckets[r]:
                            bucket.append(at)
                        else:
                            buckets[r] = [at]
                            low[r >> 6] |= 1 << (r & 63)
                            upper |= 1 << (r >> 6)
                        if r < rank:
                            end = ends[bisect_right(ends, at)]
                if (at := before[at]) >= 0:
                    due[at] = -1
                    if (r := get(ids[at] << 17 | rank)) is not None:
                        due[at] = r
                        if bucket := buckets[r]:
                            bucket.append(at)
                        else:
                            buckets[r] = [at]
                            low[r >> 6] |= 1 << (r & 63)
                            upper |= 1 << (r >> 6)
                        if r < rank:
                            end = ends[bisect_right(ends, at)]
            if waiting:
                buckets[rank], waiting = waiting, []
                low[rank >> 6] |= 1 << (rank & 63)
                upper |= 1 << (rank >> 6)
        ids = np.array(ids, dtype=np.int64)
        cuts = [0, *np.cumsum(ids >= 0)[np.array(ends) - 1].tolist()]
        ids = ids[ids >= 0].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _learn(self, pieces: set[str]) -> dict[str, tuple[str, bytes]]:
        """A memo that holds these short pre-tokens.

        It has two generations: when the new one is full it becomes the old one, whose entries
        move on as they are used again, so that frequent pre-tokens stay.
        """
        new = pieces.difference(self.young)
        if len(self.young) + len(new) > MEMO:
            self.old, self.young = self.young, {}
            new = pieces
        young, old = self.young, self.old
        some = []
        for p in new:
            if (known := old.get(p)) is None:
                some.append(p)
            else:
                young[p] = known
        if some:
            for piece, ids in zip(some, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in some])):
                young[piece] = ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids)
        return young

    def _long(self, piece: str) -> tuple[str, bytes]:
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids)

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids as joined decimals and the bytes that they decode to."""
        sizes = list(accumulate(len(t or "") for t in texts))
        lo = 0
        while lo < len(texts):
            hi, until = lo + 1, (sizes[lo - 1] if lo else 0) + GROUP_CHARS
            while hi < len(texts) and sizes[hi] <= until:
                hi += 1
            split = [self.split(t or "") for t in texts[lo:hi]]
            lo = hi
            every = set().union(*split)
            long = {p: self._long(p) for p in every if len(p) > MEMO_CHARS}
            every.difference_update(long)
            memo = self._learn(every)
            if long:
                memo = {**{p: memo[p] for p in every}, **long}
            for pieces in split:
                if pieces:
                    decimals, decoded = zip(*map(memo.__getitem__, pieces))
                    yield ",".join(decimals), b"".join(decoded)
                else:
                    yield "", b""

    def encode(self, text: str | None) -> list[int]:
        ((decimals, _),) = self.encode_texts([text])
        return list(map(int, decimals.split(","))) if decimals else []


@lru_cache(maxsize=2)
def encoder(ranks_name: str) -> BytePairEncoder:
    """One encoder for each worker. ranks_name: a file of public_tokenizers, or a path."""
    import public_tokenizers

    path = ranks_name if "/" in ranks_name else public_tokenizers.path(ranks_name)
    return BytePairEncoder(path, public_tokenizers.PATTERN)


def _begin(ranks_name: str) -> BytePairEncoder:
    enc = encoder(ranks_name)
    only("bpe", enc.forget)
    return enc


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    One pass over the texts without a shuffle; a lost task is simply run again.
    """
    small_batches(docs.sparkSession)
    fields = [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _begin(ranks)
        gc.disable()  # nothing here makes cycles, and the many short lists would start it often
        try:
            for batch in batches:
                decimals, digests, decoded = [], [], []
                for text, back in enc.encode_texts(batch.column(1).to_pylist()):
                    if with_ids:
                        decimals.append(text)
                    digests.append((text.count(",") + 1 if text else 0, hashlib.sha256(text.encode()).hexdigest()))
                    decoded.append(hashlib.sha256(back).hexdigest())
                columns = [batch.column(0), pa.array([n for n, _ in digests], pa.int64()), pa.array([x for _, x in digests], pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ids = pc.split_pattern(pa.array([x for x in decimals if x], pa.string()), ",").flatten().cast(pa.int32())
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(n for n, _ in digests)], pa.int32()), ids))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        finally:
            gc.enable()

    spark_schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, spark_schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
