"""Subword ids of whole texts from public tokenizers, word by word, with a bounded memo.

A text is parted at single spaces that stand between two characters that are no white space.
None of the tokenizers here lets a token reach across such a space, and none looks past it, so
the ids of a text are the ids of its parts, one after the other. Parts repeat, so most come
from the memo; a part of any length is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from struct import pack

import numpy as np

#: Entries of a memo (about 230 bytes each), and the longest part that one holds.
ENTRIES, LONGEST = 400_000, 64

parts = re.compile(r"(?<=\S) (?=\S)").split


def place(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def load_json(name: str, plain: bool):
    """A tokenizers file; plain: strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(place(name))
    t.encode_special_tokens = plain
    return t


class Memo(dict):
    """Part (a string, or bytes) to its ids as bytes (little-endian, of the given type).

    loose: characters that the tokenizer never joins with a letter before them; a new part that
    ends in one is made of the ids of what stands before it, which repeats more often.
    """

    def __init__(self, encode: Callable[..., list[int]], kind: np.dtype, loose: str | bytes = "", entries: int = ENTRIES) -> None:
        super().__init__()
        self.encode, self.loose, self.entries = encode, loose, entries
        self.code = {2: "H", 4: "I"}[kind.itemsize]

    def __missing__(self, part) -> bytes:
        if self.loose and len(part) > 1 and part[-1:] in self.loose and part[-2:-1].isalpha():
            ids = self[part[:-1]] + self[part[-1:]]
        else:
            ids = self.encode(part)
            ids = pack(f"<{len(ids)}{self.code}", *ids)
        if len(part) <= LONGEST:
            if len(self) >= self.entries:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, texts: list[list]) -> list[bytes]:
        """The ids of each text, given as its parts."""
        return [b"".join(map(self.__getitem__, t)) for t in texts]


def byte_of() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable bytes stand for
    themselves, the others, in order, for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: The fixed pattern of byte-level pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_rank(path: str, byte: dict[str, int]):
    """The tiktoken encoder of a tokenizers file, several times as fast on single words, if the
    file is plain byte-level BPE whose merges stand in the order of their results' ids; else None."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, pre = given["model"], given["pre_tokenizer"] or {}
    plain = not given["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in given["added_tokens"]}
    if not plain or merged != sorted(set(merged)) or len(merged) + 256 + len(special) != len(model["vocab"] | dict.fromkeys(special)):
        return None
    import tiktoken

    ranks = {bytes(map(byte.__getitem__, p)): i for p, i in model["vocab"].items() if p not in special}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class Side:
    """One tokenizer of an alignment: ids of texts and the bytes of each id.

    A .json file is byte-level BPE (tokenizers) and encodes space + text; a .model file
    (sentencepiece) adds that space itself.
    """

    def __init__(self, name: str) -> None:
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=place(name))
            self.bytes = []
            for i in range(model.get_piece_size()):
                piece = model.id_to_piece(i)
                self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
            encode = model.encode
        else:
            model, byte = load_json(name, True), byte_of()
            names = {i: piece for piece, i in model.get_vocab().items()}
            special = {t.content for t in model.get_added_tokens_decoder().values()}
            self.bytes = [b"" if names.get(i) is None else names[i].encode() if names[i] in special else bytes(map(byte.__getitem__, names[i])) for i in range(max(names) + 1)]
            fast = _by_rank(place(name), byte)
            encode = (lambda w: fast.encode_ordinary(" " + w)) if fast else (lambda w: model.encode(" " + w, add_special_tokens=False).ids)
        self.size = len(self.bytes)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        #: parts whose ids do not give space + part
        self.odd: set[str] = set()
        def noted(part: str) -> list[int]:
            ids = encode(part)
            if b"".join([self.bytes[i] for i in ids]) != b" " + part.encode("utf-8", "surrogatepass"):
                self.odd.add(part)
            return ids

        self.memo = Memo(noted, self.kind, entries=ENTRIES * 3 // 2)

    def whole(self, split: list[str], ids: bytes, text: str) -> bool:
        """Whether the bytes of the ids of a text, given with its parts, are space + text: they are
        if each part's are, and a text with an odd part is compared whole."""
        if not self.odd or self.odd.isdisjoint(split):
            return True
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, self.kind).tolist())) == b" " + text.encode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def side(name: str) -> Side:
    return Side(name)
