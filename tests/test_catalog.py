"""Character references and registry matching against plain Python."""

import html
import random
import re

import pytest
from html.entities import html5
from pyspark.sql import functions as F

from flowpanel import queries
from flowpanel.functions import parsing
from flowpanel.sources import catalog

SF = "/root/testdata/sf0.001"
rng = random.Random(3)


def test_references_like_the_standard_library(spark):
    names = list(html5)
    texts = ["B&#225;o c&aacute;o QU&#7928; A", "&#x1EF8;", "&amp;#39;", "&", "&&", "a&b", "&ampx", "&notit;", "&notin;", "&#;", "&#x;", "&#xZ;", "&#0;", "&#128;", "&#x81;", "&#xD800;", "&#x110000;", "&#99999999999999999999999;",
             "&#x0000000000041;", "&#x1F600;z", "&#11;", "&#13;", "&#xFFFE;", "&#x1FFFF;", "&#127;", "&#150", "&ThickSpace;x", "", "&#65x", "&#X41;;", "&lt;&gt&quot&nbsp;|&nbsp", "<p>a&nbsp;<b>&#8195;b</b>\x1c c<>", None]
    texts += ["".join(rng.choice(["&", "#", "x", "1", "a", "amp", ";", "lt", "notin", "É", " ", "<"]) if rng.random() < 0.5 else "&" + rng.choice(names) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    texts += ["&" + n for n in names] + ["&" + n.rstrip(";") + "z" for n in names]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.unescape(F.col("t")).alias("u"), parsing.clean_html(F.col("t")).alias("c"))
    for r in df.collect():
        if r["t"] is None:
            assert r["u"] is None and r["c"] is None
        else:
            assert r["u"] == html.unescape(r["t"])
            assert r["c"] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", r["t"])).split())


def against_sql(spark, folder, name, table):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, str(folder)).collect()]
    assert sorted(got, key=repr) == sorted(cur.fetchall(), key=repr)


TITLES = ["R&amp", "R&amp;D &amp", "a &quot;b&quot", "&copy; x&cop", "&amp;amp;&amp;lt;&am", "&middot", "&ampx &ampx; &lt &#39", ""]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages whose titles are cut inside a reference."""
    folder = tmp_path_factory.mktemp("cut")
    spark.createDataFrame([(k, f"https://x.test/{k}", f"<title>{t}</title><p>a&nbsp;b &#39;c&#39; {t}</p>") for k, t in enumerate(TITLES)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["html_clean", "html_entities"])
def test_cut_references_in_pages(spark, cut_pages, name):
    against_sql(spark, cut_pages, name, "pages")


def test_closed_references_alone(spark):
    texts = {"R&amp": "R&amp", "&amp;&lt&gt;": "&&lt>", "&ampx; &notit; &notin;": "&ampx; &notit; ∉", "&#65 &#65; &#x41 &#X41; &#;": "&#65 A &#x41 A &#;", "é&eacute;&eacute": "éé&eacute", "&&amp;amp;": "&&amp;"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.unescape(F.col("t"), closed=True).alias("u")).collect()
    assert {r["t"]: r["u"] for r in got} == texts


FUNDS = {"m": {"funds": {"vf1": {"aliases": ["VF1", "ĐẦU TƯ"]}, "vf": {"aliases": ["VF"]}, "a-b": {"aliases": ["A B", "A.B"]}, "b": {}, "Long": {"aliases": ["B"]}}}, "n": {"funds": {"vf": {"code": "N"}, "x": {}}}}


def slow(how, manager, name):
    if name is None or manager not in FUNDS:
        return None
    for key, meta in FUNDS[manager]["funds"].items():
        k = key.lower()
        if how == "prefix" and name.lower().startswith(k):
            return key
        if how == "token" and re.search(rf"(?:^|[^a-z0-9]){re.escape(k)}(?:[^a-z0-9]|$)", name.lower()):
            return key
        if how == "alias" and any(re.search(rf"\bQU[YỸ]\s+{re.escape(a)}(?!\w)", name.upper()) for a in meta.get("aliases", [])):
            return key
    return None


@pytest.mark.parametrize("how", ["prefix", "token", "alias"])
def test_first_registered_fund(spark, how):
    parts = ["vf", "vf1", "a-b", "b", "long", "-", "_", " ", "quỹ ", "quy  ", "QUỸ đầu tư", "quy a b", "quỹ a.b", "quỹ VF1", "x", "ỹ"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, "", "quỹ quỹ vf1", "-b-", "b"]
    rows = [(m, n) for n in names for m in ("m", "n", "unknown")] + [(None, "vf")]
    df = spark.createDataFrame(rows, "manager_id string, name string")
    got = catalog.matched(df, catalog.registry(spark, FUNDS), F.col("name"), how, "key").collect()
    assert sorted((str(r["manager_id"]), str(r["name"]), str(r["key"])) for r in got) == sorted((str(m), str(n), str(slow(how, m, n))) for m, n in rows)


def test_codes_of_keys(spark):
    df = spark.createDataFrame([("n", "vf"), ("n", "other"), ("m", None), ("m", "b")], "manager_id string, fund_key string")
    assert sorted(str(r["fund_code"]) for r in catalog.coded(df, catalog.registry(spark, FUNDS)).collect()) == ["B", "N", "None", "OTHER"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_matching_is_by_equality_and_bodies_are_read_once(spark):
    for name in ("prefix_registry_join", "report_page_refs"):
        text = plan(queries.QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert plan(queries.QUERIES["report_page_refs"](spark, SF)).split("== Physical Plan ==")[1].count("FileScan") <= 3  # the names' own branch and the rows'


def test_pages_without_status_or_files(spark):
    funds = catalog.registry(spark, FUNDS)
    schema = "manager_id string, page_url string, fund_key string, status int, body string"
    rows = [("m", "u1", "b", None, "x"), ("m", "u2", "b", 200, None), ("m", "u3", "b", 200, "nothing"), ("m", "u4", "b", 404, "x"), ("m", "u5", "b", 200, "<a href='B_BC_TUAN_20240101.pdf'><a href='B_BC_TUAN_20240101.pdf'>"), ("m", "u6", "vf", 200, "<a href='/B_BC_TUAN_20240101.pdf'>")]
    got = catalog.report_page_entries(spark.createDataFrame(rows, schema), funds).collect()
    assert sorted((r["fund_key"], r["title"], str(r["reason"])) for r in got if r["url"] is None) == [
        ("b", "B_BC_TUAN_20240101.pdf", "the page names vf, the file name b; the file name counts"), ("b", "u1", "the report page returned HTTP no status"), ("b", "u2", "the report page could not be fetched"), ("b", "u3", "the report page has no file link"), ("b", "u4", "the report page returned HTTP 404")]
    assert sum(r["url"] is not None for r in got) == 2
    pages = catalog.fund_page_entries(spark.createDataFrame(rows, schema), funds).collect()
    assert sorted((r["title"], r["reason"]) for r in pages) == [("u1", "the fund's page returned HTTP no status"), ("u4", "the fund's page returned HTTP 404")]


def test_walks_without_a_task_for_a_listing(spark):
    rows = [(m, p, rng.choice([200] * 12 + [503, None]), rng.choice(["x"] * 9 + [""]), rng.choice([0] * 9 + [3, 20])) for m in ("a", "b", "c", None) for p in rng.sample(range(1, 40), 25)]
    df = spark.createDataFrame(rows, "manager_id string, page_no int, status int, body string, last int")
    want = []
    for m in {r[0] for r in rows}:
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: r[1]):
            ok = r[2] == 200 and r[3] == "x"
            if ok and r[1] <= 30:
                want.append(r)
            # a page whose status nobody knows is passed over
            if (not ok and not (r[2] is None and r[3] == "x")) or r[1] >= (r[4] or r[1] + 1):
                break
    last = F.when(F.col("last") > 0, F.col("last")).otherwise(F.lit(1 << 30))
    got = catalog.walked(df, ["manager_id"], last, F.col("body") == "x", 30)
    assert "Window" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_bodies_of_a_listing_are_not_brought_together(spark):
    bodies = spark.createDataFrame([("m", "low", 1, 200, "https://m.test/list", "x")], "manager_id string, fund_key string, page_no int, status int, page_url string, body string")
    for entries in (catalog.listing_entries, catalog.form_entries):
        physical = plan(entries(bodies, catalog.registry(spark, FUNDS))).split("== Physical Plan ==")[1]
        windows = [line for line in physical.splitlines() if "Window [" in line]
        assert windows and all("url#" in line for line in windows)  # they find the first entry of each URL


def test_rows_of_one_name_stay_where_they_are(spark):
    funds = catalog.registry(spark, FUNDS)
    rows = spark.range(400).repartition(4).select(F.when(F.col("id") % 50 == 0, "n").otherwise("m").alias("manager_id"), F.when(F.col("id") % 3 > 0, "Quỹ VF1").alias("title"), F.spark_partition_id().alias("before"))
    got = catalog.based(catalog.coded(catalog.matched(rows, funds, F.col("title"), "alias", "fund_key"), funds), funds).withColumn("after", F.spark_partition_id()).collect()
    assert len(got) == 400 and len({r["before"] for r in got}) == 4 and all(r["before"] == r["after"] for r in got)


def test_dead_links_are_dealt_out(spark):
    rows = spark.range(400).select(F.lit("m").alias("manager_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("u"), F.col("id") % 8)).alias("url"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog._once(rows, ["manager_id"], [F.col("id")]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["id"] for r in got if r["url"]) == [0, 4] and sum(r["url"] is None for r in got) == 300
    assert len({r["task"] for r in got if r["url"] is None}) == 4


def test_report_pages_name_their_files_once(spark):
    funds = catalog.registry(spark, FUNDS)
    schema = "manager_id string, page_url string, fund_key string, status int, body string"
    page = "<a href='B_BC_TUAN_20240101.pdf'><a href='./x/B_BC_NGAY_20240101.pdf'><a href='B_BC_THANG_1.pdf'><a href='Q_BC_TUAN_1.pdf'><a href='/r/B_BC_TUAN_20240101.pdf'>"
    rows = [(m, f"https://x.test/r/{k}", "b", 200 if k % 4 else 404, page) for m in ("m", "n") for k in range(40)] + [("m", "https://x.test/r/1", "b", 200, page), ("m", None, "b", 200, "<a href='a_BC_TUAN_.pdf'>")]
    got = catalog.report_page_entries(spark.createDataFrame(rows, schema), funds)
    # no filter works the names and kinds out again
    assert not [line for line in plan(got).split("== Physical Plan ==")[1].splitlines() if "Filter" in line and "_BC_" in line]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in found if r["manager_id"] == "m" and "HTTP 404" in (r["reason"] or "")}) == 4  # pages without a file are dealt out
    count = lambda manager, what: sum(r["manager_id"] == manager and what in (r["reason"] or "found") for r in found)
    assert [count("m", w) for w in ("found", "HTTP 404", "no known kind", "no registered fund", "no file link")] == [1, 10, 30, 30, 1]
    # n has no fund b: both names of the week begin with none
    assert [count("n", w) for w in ("found", "HTTP 404", "no known kind", "no registered fund", "no file link")] == [0, 10, 30, 60, 0]
