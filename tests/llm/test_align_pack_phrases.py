"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flowpanel.llm import align, collocations, packing
from flowpanel.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", "a  b", " \n a", "x \n y", "foo\n bar  \nbaz ", "▁", "a ▁b", "tab\tand gap", "日本語 テキスト", "naïve café É", "😀😀 é", "<|endoftext|> <s> <unk>",
       "a\x1cb c\x85d", "=" * 500 + " ---- " + "=" * 77, "don't they're I'LL 's", "İstanbul ẞ Σας", "word. ,., A., 1., x'.", "<|ENDOFTEXT|>.", "12345 67 8", "\x00 nul"]


def frame(spark, texts, **more):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, at string").repartition(3)


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def slow_groups(text):
    """Groups of one text by the libraries on the whole text."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(slow_groups, "both"):
        a = Tokenizer.from_file(P.path(align.A))
        a.encode_special_tokens = True
        slow_groups.both = a, sentencepiece.SentencePieceProcessor(model_file=P.path(align.B))
    a, b = slow_groups.both
    if not text:
        return [], [], []
    shown = {c: i for i, c in enumerate(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    order = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in order]
    at = {c: order[i] for c, i in shown.items()} | {chr(256 + i): x for i, x in enumerate(hidden)}
    e = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    as_a = [bytes(at[c] for c in t) for t in e.tokens]
    as_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(as_a) == b"".join(as_b) == b" " + text.encode():
        return [], [], []
    ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (as_a, as_b)]
    common = ends[0] & ends[1]
    groups = []
    for side, (ids, pieces) in enumerate(((e.ids, as_a), (ids_b, as_b))):
        g = at_byte = 0
        for i, piece in zip(ids, pieces):
            if len(groups) <= g:
                groups.append(([], []))
            groups[g][side].append(i)
            at_byte += len(piece)
            g += at_byte in common
    return e.ids, ids_b, groups


def slow_align(texts):
    found = [slow_groups(t) for t in texts]
    links = [[(x, y) for g in f[2] for x in g[0] for y in g[1]] for f in found]
    docs = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    for i, (f, x) in enumerate(zip(found, links)):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        yield i, len(f[0]), len(f[1]), len(f[2]), len(x), sum(docs[p] == most[p[0]] for p in x), sum(docs[p] for p in x), hashlib.sha256(text.encode()).hexdigest() if text else ""


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("run", "block", "wide"), [(2048, 1_000_000, 1024), (3, 200, 1)])
def test_alignment_against_brute_force(spark, texts, monkeypatch, run, block, wide):
    """The second case cuts runs, blocks and wide groups as small as they get."""
    for name, value in (("RUN", run), ("BLOCK", block), ("WIDE", wide)):
        monkeypatch.setattr(align, name, value)
    some = ODD + texts[: 60 if run == 3 else 200] + texts[:5]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in align.align(frame(spark, some)).collect())
    assert got == list(slow_align(some))


def test_groups_are_whole(spark, texts):
    some = ODD + texts[:30]
    got = defaultdict(list)
    for r in align.groups(frame(spark, some)).collect():
        got[r["doc_id"]].append((r["group"], r["start"], r["end"], list(r["a_ids"]), list(r["b_ids"])))
    for i, t in enumerate(some):
        rows = sorted(got.get(i, []))
        assert [(a, b) for *_, a, b in rows] == [(list(a), list(b)) for a, b in slow_groups(t)[2]]
        assert [s for _, s, *_ in rows] == [0, *(e for _, _, e, *_ in rows)][: len(rows)]
        assert not rows or rows[-1][2] == len((" " + t).encode())


def test_alignment_of_nothing_and_without_ids(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = align.align(spark.createDataFrame([(None, "same words"), (None, "same words"), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_links"] > 0, r["count_sum"] == 2 * r["n_links"]) for r in rows) == [(False, False, True), (True, True, True), (True, True, True)]


def test_alignment_of_a_very_long_text(spark):
    long = "ab" * 40_000 + " " + "word " * 30_000
    got = align.align(frame(spark, [long])).collect()[0]
    assert tuple(got[c] for c in COLUMNS) == next(iter(slow_align([long])))


def check_pieces(rows, texts, length=packing.LENGTH):
    """All that the contract says of pieces; returned: padding and sequences."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path(packing.MODEL))
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            part = np.array(ids[i][at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding, len(by_sequence), sum(map(len, ids.values()))


def as_query(pieces):
    from pyspark.sql import functions as F

    return pieces.withColumn("ids_crc32", F.crc32("ids")).collect()


def test_pieces_hold_every_id_once(spark, texts):
    padding, n, total = check_pieces(as_query(packing.pack(frame(spark, ODD + texts))), ODD + texts)
    assert padding <= 0.02 * total and n <= 1.2 * total / packing.LENGTH + 12


def test_pack_keeps_order_and_small_blocks_hold(spark, texts, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    docs = frame(spark, texts).coalesce(1).sortWithinPartitions("doc_id")
    rows = as_query(packing.pack(docs))
    check_pieces(rows, texts)
    order = [r["doc_id"] for r in docs.collect()]
    stream = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert list(dict.fromkeys(stream)) == order


def test_cuts_are_the_best():
    """Against the plain recurrence over all pairs of positions."""
    draw = np.random.default_rng(5)
    for _ in range(200):
        length = int(draw.choice([8, 12, 16]))
        n = int(draw.integers(1, 60))
        at = np.unique(np.concatenate([[0, n], np.arange(0, n, length), draw.integers(0, n + 1, 12)]))
        price = draw.integers(0, 5, len(at)).astype(float)
        cost = [0.0]
        for j in range(1, len(at)):
            size = [int(at[j] - at[i]) for i in range(j)]
            cost.append(min(cost[i] + (0 if s & (s - 1) == 0 else length - s) + price[j] + packing.WINDOW for i, s in enumerate(size) if s <= length))
        got, before, total = packing.cuts(at, price, length), 0, 0.0
        for c in got:
            s = c - before
            total += (0 if s & (s - 1) == 0 else length - s) + price[int(np.searchsorted(at, c))] + packing.WINDOW
            before = c
        assert before == n and total == pytest.approx(cost[-1])


def test_pack_of_nothing_nulls_and_a_very_long_text(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in rows] == [(None, 0, 1, 1)] * 2
    long = ["x" * 30_000 + " many words" * 20_000]
    padding, n, total = check_pieces(as_query(packing.pack(frame(spark, long))), long)
    assert padding <= 64 and n <= total / packing.LENGTH + 12


def test_sequences_join_their_pieces(spark, texts):
    pieces = packing.pack(frame(spark, texts[:50])).cache()
    own = defaultdict(list)
    for r in pieces.collect():
        own[r["sequence_id"]].append(r)
    for r in packing.sequences(pieces).collect():
        parts = sorted(own[r["sequence_id"]], key=lambda x: x["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(p["ids"]) for p in parts) and r["n_pieces"] == len(parts)
        n = len(r["ids"]) // 4
        assert r["padding"] == (0 if n & (n - 1) == 0 else 2048 - n)


def slow_phrases(docs, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * found.get(p[i:j], 1 << 60)}
        rows = []
        for p, a in found.items():
            if p not in gone:
                s, k = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            yield lang, i, p.decode(), -a, l, r, n[lang], -s


FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrases(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


@pytest.mark.parametrize(("buckets", "marks", "chunk"), [(1 << 22, 1 << 24, 6 << 20), (1 << 15, 1 << 18, 2000)])
def test_phrases_against_brute_force(spark, monkeypatch, buckets, marks, chunk):
    """The second case fills the bitmaps, so that pruning lets much through, and cuts chunks small."""
    for name, value in (("BUCKETS", buckets), ("MARKS", marks), ("CHUNK", chunk)):
        monkeypatch.setattr(collocations, name, value)
    draw = np.random.default_rng(3)
    words = ["a", "B", "c", "Été", "日本", "x\x1cy", "é"]
    docs = [("en" if i % 3 else None, "".join(draw.choice(words) + str(draw.choice([" ", "  ", "\t", ". ", "\n", " , "], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(draw.integers(0, 60)))) for i in range(120)]
    docs += [("en", None), (None, ""), ("de", "rare words here"), ("en", "one two three four five six. " * 7), ("und", "a b")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "lang string, text string, segment string").repartition(4)
    for least, top in ((5, 2000), (5, 3), (1, 40)):
        assert phrases(collocations.collocations(df, least, top=top)) == sorted(slow_phrases(docs, least, top))


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "too few")], "lang string, text string")).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 10**15, 10**12, 10**12), (3 * 10**9 + 1, 7 * 10**14 + 3, 10**10 + 7, 5 * 10**11 + 1), (100, 10**15, 100, 100), (2**31, 2**50 - 1, 2**31 + 1, 2**33)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select(collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_phrases_beside_sql(spark, tmp_path):
    docs = [("en", "Alpha beta, gamma alpha beta gamma. " * 40), ("en", "alpha beta\tgamma delta\n" * 70), (None, "x y " * 130)]
    spark.createDataFrame(docs, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op13_collocations"])
    cols = [c[0] for c in want.description]
    want = sorted(tuple(row[cols.index(c)] for c in FIELDS) for row in want.fetchall())
    assert want and phrases(collocations.op13_collocations(spark, str(tmp_path))) == want
