r"""Operator 13: phrases that stand together more often than their parts, by PCY / DHP passes.

Pass 1 counts words and, on the side, hashes every two-word phrase into BUCKETS counters. Pass k
counts the phrases of k words whose two parts of k - 1 words are frequent (the a-priori rule)
and whose bucket reached the threshold, and hashes the phrases of k + 1 words whose parts
passed both tests into the next counters. Frequent phrases and full buckets reach the tasks as
bitmaps of fixed size (MARKS and BUCKETS bits, whatever the corpus), so both tests may let a
rare phrase through and never hold a frequent one back; exact counts decide, over strings.

Counters stop at the threshold (a byte each): a bucket is full where its sum reaches it. They
are summed in two rounds of streaming tasks, salted first, so no task gathers what all tasks
counted for one segment at once.

Words: A-Z lower-cased; pieces end at ``.,;:!?`` and U+000A to U+000D, words at spaces and tabs.
All counts are per language (null: ``und``). Null and empty texts have no words. Repeated rows
count again. Very long texts are read whole. Other columns, whatever their names, are not read.
An empty table, and a language without a frequent phrase, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, small_batches, table, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Hash counters of a pass, bits of a bitmap of frequent phrases, and counters of a segment.
BUCKETS, MARKS, SEGMENT = 1 << 22, 1 << 24, 1 << 15
#: Bytes of text that are counted at once, and rounds' partitions of a segment's counters.
CHUNK, SALTS = 6 << 20, 16

STOPS = b".,;:!?\n\x0b\x0c\r"
#: Stops become a byte that no UTF-8 text holds; then words stand between ASCII white space.
BREAK = b"\xff"
_CLEAN = bytes.maketrans(STOPS, BREAK * len(STOPS))
COUNTED = "lang string, phrase string, n bigint, h bigint, segment int, counters binary"


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase from its beginning's and its last word's."""
    x = h * np.uint64(0x9E3779B97F4A7C15) ^ (w + (h >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    return (h & np.uint64(size - 1)).astype(np.int64)


def _holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spark's bitmaps: the first position is a byte's lowest bit."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Text:
    """A chunk of texts of one language as numbers of its words; -1 between pieces."""

    def __init__(self, lang: str, texts: list[str]) -> None:
        from xxhash import xxh3_64_intdigest

        buf = BREAK.join(t.encode("utf-8", "replace") for t in texts).lower().translate(_CLEAN)
        words = pa.array(buf.replace(BREAK, b" \xff ").split(), pa.binary()).dictionary_encode()
        self.words = words.dictionary.to_pylist()
        code = words.indices.to_numpy()
        if BREAK in self.words:
            code = np.where(code == self.words.index(BREAK), -1, code)
        self.code, self.lang = code, lang
        seed = xxh3_64_intdigest(lang.encode())
        self.hash = np.fromiter((xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def starts(self, k: int) -> np.ndarray:
        """Where a phrase of k words begins."""
        n = len(self.code) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        ok = np.ones(n, bool)
        for i in range(k):
            ok &= self.code[i : n + i] >= 0
        return np.flatnonzero(ok)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        h = self.hash[self.code[at]]
        for i in range(1, k):
            h = _mix(h, self.hash[self.code[at + i]])
        return h

    def count(self, at: np.ndarray, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct phrases at these places, exactly: texts, counts, hashes."""
        key, width = self.code[at].astype(np.int64), len(self.words) + 1
        for i in range(1, k):  # numbers of the phrases so far, so that the next key fits
            key = np.unique(key, return_inverse=True)[1] * width + self.code[at + i]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        where = at[first]
        texts = [b" ".join([self.words[self.code[p + i]] for i in range(k)]).decode() for p in where.tolist()] if k > 1 else [self.words[c].decode() for c in self.code[where].tolist()]
        return texts, n, self.hashes(where, k)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts by language, about CHUNK characters at once."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK or sum(size.values()) >= 2 * CHUNK:
                most = max(size, key=size.get)
                yield most, held.pop(most)
                del size[most]
    yield from held.items()


def _counted(docs: DataFrame, k: int, least: int, frequent: bytes | None, full: bytes | None, longest: int) -> DataFrame:
    """Pass k: phrases with their counts in a chunk, and segments of the next pass's counters."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, full))  # at most (MARKS + BUCKETS) / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("h", pa.int64()), ("segment", pa.int32()), ("counters", pa.binary())])
        marks, buckets = (None if x is None else np.frombuffer(x, np.uint8) for x in shared.value)
        counters = np.zeros(BUCKETS, np.uint8)
        waiting: list[np.ndarray] = []

        def add(enough: int) -> None:
            if sum(map(len, waiting)) > enough:
                counters[:] = np.minimum(counters + np.bincount(np.concatenate(waiting), minlength=BUCKETS), least)
                waiting.clear()

        for lang, texts in _chunks(batches):
            text = Text(lang, texts)
            at = text.starts(k)
            if k > 1 and len(at):
                ok = np.zeros(len(text.code) + 1, bool)  # places of frequent phrases of k - 1 words
                before = text.starts(k - 1)
                ok[before[_holds(marks, _bits(text.hashes(before, k - 1), MARKS))]] = True
                at = at[ok[at] & ok[at + 1]]
                at = at[_holds(buckets, _bits(text.hashes(at, k), BUCKETS))]
            if k < longest and len(at):
                passed = np.zeros(len(text.code) + 1, bool)
                passed[at] = True
                both = at[passed[at + 1]]  # overlapping phrases of k words are one of k + 1
                if len(both):
                    waiting.append(_bits(text.hashes(both, k + 1), BUCKETS))
                    add(2_000_000)
            if len(at):
                phrases, n, h = text.count(at, k)
                for i in range(0, len(n), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    m = len(n[part])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(phrases[part], pa.string()), pa.array(n[part], pa.int64()), pa.array(h[part].view(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        add(0)
        some = [s for s in range(BUCKETS // SEGMENT) if counters[s * SEGMENT : (s + 1) * SEGMENT].any()]
        for s in some:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in schema.types[:4]), pa.array([s], pa.int32()), pa.array([counters[s * SEGMENT : (s + 1) * SEGMENT].tobytes()], pa.binary())], schema=schema)

    return docs.mapInArrow(run, COUNTED)


def _summed(segments: DataFrame, least: int) -> DataFrame:
    """segment, counters: added up, stopping at least, in streaming tasks that hold the segments dealt to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(data, np.uint8)
                held[s] = np.minimum(held[s].astype(np.int16) + new, least).astype(np.uint8) if s in held else new
        for s, data in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["segment", "counters"])

    once = segments.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("segment", "salt").select("segment", "counters").mapInArrow(run, "segment int, counters binary")
    return once.repartition("segment").mapInArrow(run, "segment int, counters binary")


def _full(segments: DataFrame, least: int) -> bytes:
    """The bitmap of full buckets, BUCKETS / 8 bytes."""
    out = np.zeros(BUCKETS // 8, np.uint8)
    size = SEGMENT // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(x, np.uint8) >= least, bitorder="little").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["segment", "bits"])

    for row in _summed(segments, least).mapInArrow(run, "segment int, bits binary").collect():
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _marks(frequent: DataFrame) -> bytes:
    """The bitmap of frequent phrases, MARKS / 8 bytes."""
    at = F.pmod("h", F.lit(MARKS))
    # the functions number positions from 1 and their buckets from 1
    bits = frequent.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for row in bits.collect():
        data = np.frombuffer(row["bits"], np.uint8)
        out[(row["bucket"] - 1) * len(data) : row["bucket"] * len(data)] = data
    return out.tobytes()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f: all phrases of 1 to longest words with f >= least) and (lang, n: all
    word occurrences). docs: lang, text."""
    if not 0 < least <= 255:
        raise ValueError("counters are bytes: least must be 1 to 255")
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).where("text <> ''")
    marks = full = totals = found = None
    for k in range(1, longest + 1):
        rows = written(_counted(docs, k, least, marks, full, longest))
        phrases = rows.where("segment is null")
        if k == 1:
            totals = written(phrases.groupBy("lang").agg(F.sum("n").alias("n")))
        level = written(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("h").alias("h")).where(F.col("f") >= least))
        here = level.select("lang", "phrase", F.lit(k).alias("k"), "f")
        found = here if found is None else found.unionByName(here)
        if k < longest:
            marks, full = _marks(level), _full(rows.where("segment is not null").select("segment", "counters"), least)
    return found, totals


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly: products of 64-bit numbers are decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, or all of them (top None)."""
    found, totals = frequent_phrases(docs, least, longest)
    candidates = found.where("k > 1")
    words = F.split("phrase", " ")
    join = lambda first, count: F.array_join(F.slice(words, first, count), " ")
    # a phrase goes if a longer one around it is as frequent; then one that is a word longer is, too
    around = candidates.select("lang", F.explode(F.array(join(F.lit(1), F.col("k") - 1), join(F.lit(2), F.col("k") - 1))).alias("phrase"), F.col("f").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * f").drop("longer")
    parted = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    parted = parted.withColumns({"first": join(F.lit(1), F.col("cut")), "rest": join(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    parted = parted.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    least_cut = F.min(F.struct(score(F.col("f"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r"))
    scored = parted.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(least_cut.alias("c"))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
phrases AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inside AS (
  SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, k, w, a, j, unnest(range(1, k - j + 2)) AS i FROM c, range(2, 5) AS r(j) WHERE j < k) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN n USING (lang)
  JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 : cuts.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
WHERE rank <= 2000
"""
