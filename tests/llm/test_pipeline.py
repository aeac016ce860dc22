"""Every stage of the pipeline with nulls, empty and long texts, repeats, clashing names and no rows."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from flowpanel.llm import bpe, common, mixing

CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, place string, id string, hash string, base string, spans string, size string, row string, `_times` string, `a` string, times string, `time` string"
NAMES = [c.split()[0].strip("`") for c in CLASH.split(", ")]
FAR = " ".join(f"v{i}" for i in range(300))
NEAR = [" ".join([*(f"w{i}" for i in range(300)), f"end{j}"]) for j in range(2)]
TEXTS = [(1, NEAR[0]), (1, NEAR[0]), (2, NEAR[1]), (2, FAR), (None, "alone here"), (None, None), (3, None), (4, ""), (5, "  "), (6, 'a token = "abcdefghijklmno" b'), (7, "long words " * 30_000), (8, "vile nasty zzz"), (9, "short")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["x", None, "y"][k % 3], len(t or ""), *[f"c{k}"] * (len(NAMES) - 5)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CLASH).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    d = str(tmp_path_factory.mktemp("sf"))
    bad = [(100 + i, f"vile nasty word{i % 7} and more", "en", "x", 20, *["c"] * (len(NAMES) - 5)) for i in range(40)]
    good = [(200 + i, " ".join(f"plain{(i * k) % 91}" for k in range(30)), "en", "y", 20, *["c"] * (len(NAMES) - 5)) for i in range(120)]
    every = docs.unionByName(spark.createDataFrame(bad + good, CLASH))
    every.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(120)], "doc_id bigint, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def same(a, b):
    return collections.Counter(map(repr, a)) == collections.Counter(map(repr, b))


def test_toxic_documents_go(spark, folder):
    every = common.table(spark, folder, "documents")
    got = cp.drop_toxic(spark, every, folder)
    assert got.columns == NAMES
    ids = collections.Counter(r["doc_id"] for r in got.collect())
    assert not any(100 <= (i or 0) < 140 for i in ids) and all(ids[200 + i] == 1 for i in range(120))
    assert ids[1] == 2 and ids[2] == 2 and ids[None] == 2 and ids[3] == ids[4] == ids[7] == 1


def test_one_of_each_group_stays(spark, docs):
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == NAMES
    rows = [r for r in docs.collect() if r["text"] != NEAR[0] and r["text"] != NEAR[1]]
    kept = got.collect()
    near = [r for r in kept if r["text"] in NEAR]
    assert len(near) == 1 and near[0]["doc_id"] == 1 and same([r for r in kept if r["text"] not in NEAR], rows)


def test_secrets_are_masked(spark, docs):
    got = cp.mask_secrets(spark, docs, "")
    assert got.columns == NAMES
    key = lambda r: (r["doc"],)
    for was, now in zip(sorted(docs.collect(), key=key), sorted(got.collect(), key=key)):
        if was["doc_id"] == 6:
            assert now["text"] == 'a [SECRET]" b' and now["n_chars"] == len(now["text"])
        else:
            assert now == was


def test_documents_are_mixed(spark, docs):
    got = cp.mix_sources(spark, docs, "")
    assert got.columns == NAMES
    n = collections.Counter(map(repr, got.collect()))
    rows = docs.collect()
    assert set(n) <= set(map(repr, rows)) and max(n.values()) <= 3
    assert all(n[repr(r)] == 1 for r in rows if not (r["text"] or "").split())
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    made = collections.Counter()
    for r in got.collect():
        made[r["source"]] += len((r["text"] or "").split())
    assert all(abs(made[s] - taken[s]) <= 60_000 for s in taken)
    assert same(got.collect(), cp.mix_sources(spark, docs.repartition(3), "").collect())


def test_texts_are_encoded(spark, docs):
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in cp.encode(spark, docs, "").collect()}
    enc = bpe.encoder("byte_bpe_multi_50k.tiktoken")
    for i, t in TEXTS:
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert enc.decode(r["ids"]) == (t or "").encode() and len(r["ids"]) == r["n_tokens"]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_no_documents(spark, folder, docs, name, stage):
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_the_whole_run(spark, folder):
    """The run against its stages one by one, each on what its predecessor kept."""
    rows = common.table(spark, folder, "documents")
    for _, stage in cp.STAGES[:-1]:
        before, rows = rows, common.written(stage(spark, rows, folder))
        assert rows.columns == before.columns
    want = [bpe.encoder("byte_bpe_multi_50k.tiktoken").encode(r["text"]) for r in rows.collect()]
    got = cp.run(spark, folder).collect()
    assert len(got) > 100 and same([list(r["ids"]) for r in got], want)
    made = len(common._WRITTEN)
    assert made and common.clean(spark) == made and common.clean(spark) == 0


class _Empty:
    """A session of a cluster on which no shared folder is set."""

    master = "spark://host:7077"

    def get(self, *_):
        return None

    def isEmpty(self):  # noqa: N802
        return True

    def __getattr__(self, _):
        return self

    def __call__(self, *_):
        return self


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        common.shared_dir(_Empty())


def test_threads_keep_their_own_tables(spark):
    """A run that cleans up leaves the tables of another thread's run."""
    import threading

    from flowpanel.llm import common

    common.clean(spark)
    mine = common.written(spark.range(3))
    other = threading.Thread(target=lambda: (common.written(spark.range(5)), common.clean(spark)))
    other.start()
    other.join()
    assert mine.count() == 3 and common.mark() == 1
    assert common.clean(spark) == 1
