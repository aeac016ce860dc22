"""Operator 11: packing documents into sequences by order-preserving dynamic programming.

Documents keep the order in which their partition holds them. Their tokens, each document's end
id last, form one stream, parted into blocks of about BLOCK tokens at documents' ends; a block
is cut into windows of at most ``length`` tokens. Cuts may stand at a document's end (free), at
a sentence's end or, in a long sentence, after every ``grid`` tokens (each at a penalty), and
the dynamic programme finds the cuts of the least padding plus penalties:

    cost(j) = least over i of cost(i) + padding(j - i) + penalty(j) + one window's penalty

A window is padded to ``length``, so padding(j - i) is length - (j - i), and the best i of a
position is the least cost(i) + i among the last ``length`` tokens: a monotone queue gives it
in constant time. A window whose size is a power of two is not padded; those few i are looked at
one by one. Blocks are packed apart from each other, so a block's last window is cut into powers
of two, for which positions are allowed on a finer grid before its end.

No text is shuffled: one pass encodes, cuts and emits. Sequence ids hold the partition's number
and the window's number in it, so they do not depend on other partitions.

Null and empty texts have the end id alone. Repeated rows, and rows without an id, are documents
of their own. A very long text spans many windows; its block holds it whole, as ids. Other columns,
whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, small_batches, table
from .subwords import ENTRIES, Memo, byte_of, load_json, place

MODEL, END, LENGTH = "word_bpe_49k.json", 1, 2048
#: Tokens of a block, about; of a step inside long sentences and before a block's end.
BLOCK, GRID, FINE = 1 << 18, 16, 16
#: In tokens of padding: a cut at a sentence's end, inside a sentence, and a window.
AT_SENTENCE, INSIDE, WINDOW = 1.0, 8.0, 32.0
STOPS = ".!?…。！？"
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


#: What one part of the fixed pre-token pattern is; parts of these characters alone are composed
#: already, the library's lower case is Python's, and so is its white space.
PRE_TOKEN, SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", re.compile("[\x00-\x1b\x20-\u024f]*").fullmatch
ENDED = b"\xff"


def _by_rank(path: str):
    """Ids of one simple word (bytes) by tiktoken, None of any other, several times as fast as the library, if the file's ids
    are bytes, bytes that end a word, and merges in their order; else None.

    The end of a word is a byte that no UTF-8 text holds: it joins the byte before it first, as
    those pairs have the least ranks, and is then a part of the merges like any other.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, byte = model["vocab"], byte_of()
    pair = lambda m: m if isinstance(m, list) else m.split(" ")
    merged = [vocab["".join(pair(m))] for m in model["merges"]]
    base = {**{c: i for c, i in vocab.items() if len(c) == 1}, **{c: i for c, i in vocab.items() if len(c) == 5 and c.endswith("</w>")}}
    if model.get("end_of_word_suffix") != "</w>" or merged != list(range(512, 512 + len(merged))) or sorted(base.values())[:512] != list(range(512)):
        return None
    import tiktoken

    raw = lambda p: bytes(map(byte.__getitem__, p.removesuffix("</w>"))) + ENDED * p.endswith("</w>")
    ranks = {raw(p): i for p, i in vocab.items() if i < 512 + len(merged)}
    piece = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    split = regex.compile(PRE_TOKEN).findall

    def encode(word: bytes) -> list[int] | None:
        if word.isalpha():  # of ASCII letters alone
            return piece(word.lower() + ENDED)
        text = word.decode("utf-8", "surrogatepass").lower()
        if not SIMPLE(text) or "<|" in text:
            return None
        return piece(text.encode() + ENDED) if text.isalpha() else [i for t in split(text) for i in piece(t.encode() + ENDED)]

    return encode


class Encoder:
    """Ids of texts by a tokenizers file with the library's defaults, and which ids end a sentence."""

    def __init__(self, name: str) -> None:
        model, fast = load_json(name, False), _by_rank(place(name))

        def encode(word: bytes) -> list[int]:
            ids = fast(word) if fast else None
            return model.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids if ids is None else ids

        self.memo = Memo(encode, np.dtype("<u4"), b".,", 2 * ENTRIES)
        vocab = model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for stop in STOPS:
            ids = model.encode("a" + stop, add_special_tokens=False).ids
            self.ends[ids[-1]] = True

    def words(self, text: str) -> list[bytes]:
        """The text's words. The tokenizer drops white space and joins nothing across it; A-Z are
        lower-case, as it has them, so that more words repeat."""
        raw = text.encode("utf-8", "surrogatepass")
        return (raw if b"<|" in raw else raw.lower()).split()  # strings of special tokens count as they are written

    def ids(self, texts: list[str], end: int) -> list[np.ndarray]:
        tail = np.array([end], "<u4").tobytes()
        return [np.frombuffer(x + tail, "<u4") for x in self.memo.ids([self.words(t) if t else [] for t in texts])]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def positions(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, grid: int = GRID, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Where a block may be cut, from 0 to its size, and each cut's penalty."""
    n = len(ids)
    price = np.full(n + 1, np.inf)
    price[1:][sentence_end[ids]] = AT_SENTENCE
    price[0] = 0
    price[doc_ends] = 0
    at = np.flatnonzero(price < np.inf)
    # steps inside what is longer than a step
    gap = np.diff(at)
    steps = (gap - 1) // grid
    inside = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    more = np.repeat(at[:-1], steps) + (inside + 1) * grid
    last = np.arange(n - FINE, max(0, n - length), -FINE)
    for extra in (more, last):
        price[extra] = np.minimum(price[extra], INSIDE)
    at = np.flatnonzero(price < np.inf)
    return at, price[at]


def cuts(at: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """The best cuts among the positions (rising, the first 0, steps of at most length): the
    ends of the windows, in order. Ties go to the earlier found."""
    n = int(at[-1])
    index = np.full(n + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    # windows of a power of two: for each position, the positions that far before it
    ends, begins, size = [], [], 1
    while size <= length:
        j = np.flatnonzero(at >= size)
        before = index[at[j] - size]
        ends.append(j[before >= 0])
        begins.append(before[before >= 0])
        size *= 2
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    begins, part = begins[order].tolist(), np.searchsorted(ends[order], np.arange(len(at) + 1)).tolist()
    where, fee = at.tolist(), price.tolist()
    cost, came = [0.0], [0]
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost(i) + i, position of i, i
    for j in range(1, len(where)):
        p = where[j]
        while queue[0][1] < p - length:
            queue.popleft()
        best, i = queue[0][0] + length - p, queue[0][2]
        for k in begins[part[j] : part[j + 1]]:
            if cost[k] < best:
                best, i = cost[k], k
        best += fee[j] + WINDOW
        cost.append(best)
        came.append(i)
        key = best + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = came[j]
    return out[::-1]


def pack(docs: DataFrame, model: str = MODEL, end: int = END, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (ids of its sequence before it)."""
    small_batches(docs.sparkSession)
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in PIECES.split(", ")]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(PIECES.split(", "), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(model)
        only("packing", enc.memo.clear)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, names, size
            ids = np.concatenate(held)
            sizes = [len(x) for x in held]
            ends = np.cumsum(sizes)
            edges = cuts(*positions(ids, ends, enc.ends, length=length), length)
            rows: list[tuple] = []
            d = first = 0  # document and its begin
            begin = 0
            for cut in edges:
                at = begin
                while at < cut:
                    stop = min(cut, first + sizes[d])
                    rows.append((names[d], at - first, stop - at, ids[at:stop].tobytes(), sizes[d], number, at - begin))
                    at = stop
                    if stop == first + sizes[d]:
                        first, d = stop, d + 1
                number, begin = number + 1, cut
            held, names, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(texts, end)):
                held.append(ids)
                names.append(doc)
                size += len(ids)
                if size >= BLOCK:
                    yield from block()
        if held:
            yield from block()

    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (its pieces' ids end to end), n_pieces, padding (a power of two has none):
    a group is one sequence, so at most length ids."""
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    n = F.sum("length")
    power = F.bit_count(n) == 1
    joined = F.aggregate(F.col("_p"), F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["ids"]))
    out = pieces.groupBy("sequence_id").agg(order.alias("_p"), F.count("*").alias("n_pieces"), F.when(power, 0).otherwise(F.lit(length) - n).alias("padding"))
    return out.select("sequence_id", joined.alias("ids"), "n_pieces", "padding")


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
