"""Operator 6: exact token counts at every prefix by dynamic programming.

The tokenizer merges adjacent pieces in the order of a rank, and its encoding of a text is
the only sequence of pieces in which each neighbouring two are what the encoder makes of
their concatenation. So the last token of every prefix follows from shorter prefixes: it is
the piece that ends there and is compatible with the last token of the prefix before it.
One sweep stores the token count of each prefix, and any truncation or budget question is
then answered from that array, without encoding again.

No piece joins a word's end with a following word mark, and a character without a piece of
its own falls back to its bytes; both end a segment, and counts add up over segments.

Texts: null and empty texts have no tokens; rows without an id are counted like others; very long ones are counted whole, segment by segment. Repeated rows give repeated results, other
columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, small_batches, table

MARK = "▁"  # the word mark that replaces a space
MEMO, MEMO_CHARS, PAIRS = 700_000, 48, 1_000_000
LIMIT = 4096


class _Memo(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class PrefixCounter:
    def __init__(self, model_path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # rank: pieces with a better score merge first
        self.pieces = [model.id_to_piece(i) for i in sorted(usable, key=lambda i: (-model.get_score(i), i))]
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.width = len(self.pieces)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces):
            raise ValueError("a piece crosses a word mark or a line end")
        self.segments = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.chars = frozenset(p for p in self.pieces if len(p) == 1)
        #: the two parts whose merge makes a piece; pieces that merging can't make have none
        self.halves: dict[int, tuple[int, int]] = {}
        self.ending = ahocorasick.Automaton()
        for r, p in enumerate(self.pieces):
            parts = self._merge(p)
            if parts is not None:
                self.halves[r] = parts
                self.ending.add_word(p, (len(p), r))
        self.ending.make_automaton()
        self.fits: dict[int, bool] = {}
        self.totals = _Memo(lambda s: self.segment(s)[-1])

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """The last two parts when plain merging turns the characters into the piece."""
        parts, halves = list(piece), (-1, -1)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], self.width), i) for i in range(len(parts) - 1))
            if best == self.width:
                return None
            halves = self.rank.get(parts[at], -1), self.rank.get(parts[at + 1], -1)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return halves

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether the pieces, set next to each other, are encoded as just these two.

        Both are taken apart in the reverse order of their merges. At each stage the parts
        that meet at the seam must not merge before the step that ended that stage: a merge
        across the seam comes first if its rank is lower, or equal and further left.
        """
        until_left = until_right = self.width  # ranks of the steps that end the present parts
        while True:
            across = self.rank.get(self.pieces[left] + self.pieces[right])
            # the seam lies right of the left part's own next step and left of the right part's
            if across is not None and across < until_left and across <= until_right:
                return False
            a, b = self.halves[left], self.halves[right]
            if a[0] < 0 and b[0] < 0:
                return True
            if b[0] < 0 or a[0] >= 0 and left >= right:
                if left == right:  # of equal ranks the left one was made first: undo the right one
                    until_right, right = right, b[0]
                else:
                    until_left, left = left, a[1]
            else:
                until_right, right = right, b[0]

    def segment(self, text: str) -> list[int]:
        """Token counts of all prefixes of one segment, from the empty one on."""
        counts = [0] * (len(text) + 1)
        if not self.chars.issuperset(text):
            run, base = 0, 0
            for i, c in enumerate(text):
                if c not in self.chars:
                    if run < i:
                        counts[run + 1 : i + 1] = [base + x for x in self.segment(text[run:i])[1:]]
                        base = counts[i]
                    base += len(c.encode("utf-8", "surrogatepass"))
                    counts[i + 1] = base
                    run = i + 1
            if run < len(text):
                counts[run + 1 :] = [base + x for x in self.segment(text[run:])[1:]]
            return counts
        last = [-1] * (len(text) + 1)
        fits, width = self.fits, self.width
        for end, (size, piece) in self.ending.iter(text):
            end += 1
            if counts[end]:
                continue
            before = last[end - size]
            if before >= 0:
                key = before * width + piece
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    ok = fits[key] = self._side_by_side(before, piece)
                if not ok:
                    continue
            elif end != size:
                continue
            counts[end] = counts[end - size] + 1
            last[end] = piece
        return counts

    def _normal(self, text: str | None) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def count(self, text: str | None) -> int:
        return sum(map(self.totals.__getitem__, self.segments(self._normal(text))))

    def prefixes(self, text: str | None) -> list[int]:
        """counts[i]: tokens of the first i characters; counts[0] is 0."""
        if not text:
            return [0]
        out = [0]
        for s in self.segments(self._normal(text)):
            base = out[-1]
            out.extend(base + n for n in self.segment(s)[1:])
        return [0, *out[2:]]  # the mark before the text is no character of its own

    def fit(self, prefixes: list[int], budget: int) -> int:
        """The most characters whose tokens stay within the budget."""
        return max(i for i, n in enumerate(prefixes) if n <= budget)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(model if "/" in model else public_tokenizers.path(model))


def _begin(model: str) -> PrefixCounter:
    c = counter(model)
    only("token_counts", c.totals.clear)
    return c


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. One pass without a shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _begin(model).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def truncate(docs: DataFrame, budget: int, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars_kept, text cut to the most characters within the budget of tokens."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars_kept", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _begin(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = [c.fit(c.prefixes(t), budget) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.int64()), pa.array([t[:n] for t, n in zip(texts, cut)], pa.string())], schema=schema)

    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_chars_kept bigint, text string")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
