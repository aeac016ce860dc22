"""Catalogues of documents from the bodies of listing pages: the fund registry, entries, sitemaps.

Bodies come as tables, fetched by whoever fetches; nothing here touches a network. Every entry
of a body ends as a reference to a document or as a dead entry with its reason: a hole in an
archive that nobody wrote down would later look like a flow.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parsing

REGISTRY = "manager_id string, crawler string, status string, base_url string, ord int, fund_key string, fund_code string, fund_name string, asset_class string, aliases array<string>, page string, site_slug string, feed_id bigint"
REFS = ["manager_id", "fund_key", "fund_code", "url", "published", "title", "label", "filename_date"]
DEAD = ["manager_id", "fund_key", "title", "published", "reason"]
MAX_PAGES = 200
#: Age in hours up to which a list of pages counts as current.
TTL_HOURS = 24


def registry(spark: SparkSession, managers: dict) -> DataFrame:
    """The funds of all managers in their order, one row each, from the registry's nested form:
    manager -> crawler, status, base_url, funds -> key -> code, name, asset_class, aliases, page."""
    rows = []
    for manager, cfg in managers.items():
        base = cfg.get("base_url") or cfg.get("listing_url")
        for k, (key, meta) in enumerate((cfg.get("funds") or {}).items()):
            meta = meta or {}
            rows.append((manager, cfg.get("crawler"), cfg.get("status"), base, k, key, meta.get("code", key.upper()), meta.get("name"), meta.get("asset_class"), list(meta.get("aliases") or []), meta.get("page"), meta.get("site_slug", key), meta.get("feed_id")))
    return spark.createDataFrame(rows, REGISTRY)


def load_registry(spark: SparkSession, path: str) -> dict:
    """The managers of a YAML or JSON file, read by Spark's own file access."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    if path.endswith(".json"):
        got = json.loads(row["value"])
    else:
        import yaml

        got = yaml.safe_load(row["value"])
    return got.get("managers", got)


def manager_config(managers: dict, manager: str) -> dict:
    if manager not in managers:
        raise KeyError(f"unknown manager {manager!r}; known: {sorted(managers)}")
    return managers[manager]


def verified(managers: dict) -> list[str]:
    return [m for m, cfg in managers.items() if cfg.get("status") == "verified"]


#: What a registered key may stand in, and a character after which it can't end.
_SHAPES = {
    # the beginning of a file name
    "prefix": (lambda name: F.array(F.lower(name)), None),
    # a slug, between other characters than letters and digits
    "token": (lambda slug: F.regexp_extract_all(F.concat(F.lit("-"), F.lower(slug)), F.lit("(?s)[^a-z0-9](?=(.*))"), F.lit(1)), "[a-z0-9]"),
    # a title, after the word for fund
    "alias": (lambda title: F.regexp_extract_all(F.upper(title), F.lit(r"(?sU)\bQU[YỸ]\s+(?=(.*))"), F.lit(1)), r"(?U)\w"),
}


def _keys(funds: DataFrame, how: str) -> Column:
    """What is looked for: a map of managers to their keys, by length, each with the first fund that it means."""
    named = funds.select("manager_id", "ord", "fund_key", F.explode("aliases").alias("_key")) if how == "alias" else funds.select("manager_id", "ord", "fund_key", F.lower("fund_key").alias("_key"))
    first = named.where("manager_id is not null and _key <> ''").groupBy("manager_id", "_key").agg(F.min(F.struct("ord", "fund_key")).alias("_fund"))
    sized = first.groupBy("manager_id", F.length("_key").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("_key", "_fund"))).alias("funds"))
    whole = sized.groupBy("manager_id").agg(F.collect_list(F.struct("n", "funds")).alias("_keys"))
    return whole.agg(F.map_from_entries(F.collect_list(F.struct("manager_id", "_keys")))).scalar()


def matched(rows: DataFrame, funds: DataFrame, name: Column, how: str, out: str) -> DataFrame:
    """rows with the column out: the first fund (in the registry's order) of the row's manager whose
    key begins the file name ("prefix"), stands in the slug ("token"), or one of whose short names
    follows the word for fund in the title ("alias"); NULL if there is none.

    The registry's keys are sent to the tasks, a manager's in one map for each length that they
    have. The names are cut to these lengths, and the cuts are looked up: no pattern is made from
    the registry, and rows stay where they are, however many have the same name or none.
    """
    begins, inner = _SHAPES[how]

    def funds_of(rest: Column) -> Column:
        """The funds that the rest's beginnings mean, where a key may end."""
        fits = lambda n: F.length(rest) >= n if inner is None else (F.length(rest) >= n) & ~F.rlike(F.substr(rest, n + 1, F.lit(1)), F.lit(inner))
        return F.transform(F.filter("_keys", lambda k: fits(k["n"])), lambda k: F.element_at(k["funds"], F.substr(rest, F.lit(1), k["n"])))

    found = F.array_min(F.flatten(F.transform(begins(name), funds_of)))
    return rows.withColumn("_keys", F.element_at(_keys(funds, how), F.col("manager_id"))).withColumn(out, found["fund_key"]).drop("_keys")


def coded(rows: DataFrame, funds: DataFrame, key: str = "fund_key", out: str = "fund_code") -> DataFrame:
    """rows with the registry's code of their fund; a key that is not registered is its own code, in capitals."""
    codes = funds.select("manager_id", F.col("fund_key").alias(key), F.col("fund_code").alias("_code")).dropDuplicates(["manager_id", key])
    return rows.join(F.broadcast(codes), ["manager_id", key], "left").withColumn(out, F.coalesce("_code", F.upper(key))).drop("_code")


def based(rows: DataFrame, funds: DataFrame) -> DataFrame:
    """rows with the base_url of their manager."""
    return rows.join(F.broadcast(funds.groupBy("manager_id").agg(F.first("base_url", True).alias("base_url"))), "manager_id", "left")


def split_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, dead), the refs by fund, date (undated first) and URL."""
    refs = entries.where("reason is null").select(*REFS).orderBy("fund_key", F.asc_nulls_first("filename_date"), "url")
    return refs, entries.where("reason is not null").select(*DEAD)


def _beside(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """rows with what few says of their group (one row each, no value is a group of its own): few is
    sent to the tasks, so a group need not stand in one."""
    same = None
    for c in by:
        equal = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        same = equal if same is None else same & equal
    return rows.join(F.broadcast(few.withColumnsRenamed({c: f"_by_{c}" for c in by})), same, "left").drop(*[f"_by_{c}" for c in by])


def _once(entries: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of the entries that carry a URL the first of each; dead links all stay, and are dealt out."""
    dealt = F.when(F.col("url").isNull(), F.xxhash64(*entries.columns))
    w = Window.partitionBy(*by, "url", dealt).orderBy(*order)
    return entries.withColumn("_r", F.when(F.col("url").isNotNull(), F.row_number().over(w)).otherwise(1)).where("_r = 1").drop("_r")


#: The fixed shape of a listing entry: title, day of publication, link; the label; the pages' numbers.
ITEM = r'(?s)<div class="list-download">.*?<p>(.*?)</p>.*?<span class="date-time">(.*?)</span>.*?href="([^"]*)"'
PUBLISHED = r"(?iu)Ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
LABEL = r"(?iu)(?:Tuần|Ky|Kỳ)\s*\d+\s*/\s*\d{4}"
PAGE_NUMBER = r"[?&]p=(\d+)"
#: The fixed shapes of a form's hidden token and number of pages, and of sitemaps of reports.
TOKEN = r'id="field_csrf_ft"[^>]*value="([^"]+)"'
TOTAL = r'data-total="(\d+)"'
REPORT_SITEMAP = r"(?i)/report-sitemap\d*\.xml$"


def walked(bodies: DataFrame, by: list[str], last: Column, found: Column, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages that a walk would reach: in order up to a page that failed or is empty, the last
    page that any page before names, or the limit. Of each walk one number is worked out, that of
    the page it ends at; the bodies stay in the tasks that have them."""
    ok = (F.col("status") == 200) & found
    ends = F.col("page_no") >= F.when(last > 0, last).otherwise(F.col("page_no"))
    stops = bodies.where(~ok | ends).groupBy(*by).agg(F.min("page_no").alias("_stop"))
    got = _beside(bodies, stops, by).where(F.col("page_no") <= F.coalesce("_stop", "page_no"))
    return got.where(ok & (F.col("page_no") <= max_pages)).drop("_stop")


def listing_entries(bodies: DataFrame, funds: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Entries of paged listings: bodies manager_id, page_no, status, body."""
    items = [F.regexp_extract_all("body", F.lit(ITEM), F.lit(k)) for k in (1, 2, 3)]
    pages = F.array_max(F.transform(F.regexp_extract_all("body", F.lit(PAGE_NUMBER), F.lit(1)), lambda p: p.try_cast("int")))
    reached = walked(bodies, ["manager_id"], F.coalesce(pages, F.lit(0)), F.regexp_like("body", F.lit(ITEM)), max_pages)
    zipped = F.arrays_zip(*[x.alias(k) for x, k in zip(items, ("title", "date", "href"))])
    rows = based(reached, funds).select("manager_id", "page_no", "base_url", F.posexplode(zipped).alias("pos", "i"))
    title, when = parsing.clean_html(F.col("i.title")), parsing.clean_html(F.col("i.date"))
    href = parsing.unescape(F.trim(F.col("i.href")))
    d, m, y = (F.regexp_extract(when, PUBLISHED, k) for k in (1, 2, 3))
    rows = rows.select("manager_id", "page_no", "pos", "base_url", title.alias("title"), parsing._dmy(d, m, y).alias("published"), href.alias("href"))
    dead = (F.col("href") == "") | F.lower("href").startswith("javascript")
    root = F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/"))
    url = F.when(~dead, parsing.absolute_url(root, F.regexp_replace("href", "^/+", "")))
    rows = rows.withColumns({"url": url, "name": F.lower(F.element_at(F.split(url, "/"), -1))})
    rows = _once(rows, ["manager_id"], [F.col("page_no"), F.col("pos")])
    rows = matched(matched(rows, funds, F.col("name"), "prefix", "_by_name"), funds, F.col("title"), "alias", "_by_title")
    rows = coded(rows.withColumn("fund_key", F.coalesce("_by_name", "_by_title")), funds)
    reason = F.when(dead, F.concat(F.lit("no file is published: links to '"), "href", F.lit("'"))).when(F.col("fund_key").isNull(), F.concat(F.lit("no registered fund: "), "url"))
    label = F.nullif(F.regexp_extract("title", LABEL, 0), F.lit(""))
    return rows.select("manager_id", "fund_key", "fund_code", "url", "published", "title", label.alias("label"), parsing.flat_date(F.col("name")).alias("filename_date"), reason.alias("reason"))


def form_token(body: Column) -> Column:
    """The hidden token that a disclosure form must send back; NULL if the form has none."""
    return F.nullif(F.regexp_extract(body, TOKEN, 1), F.lit(""))


def form_entries(bodies: DataFrame, funds: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Entries of a form's answers: bodies manager_id, fund_key, page_no, status, body, page_url.
    The first answer says how many pages there are. Daily reports are passed over."""
    by = ["manager_id", "fund_key"]
    totals = F.array_max(F.transform(F.regexp_extract_all("body", F.lit(TOTAL), F.lit(1)), lambda p: p.try_cast("int")))
    sized = _beside(bodies, bodies.groupBy(*by).agg(F.min_by(totals, "page_no").alias("_total")), by).withColumn("_total", F.coalesce("_total", F.lit(1)))
    reached = walked(sized, by, F.col("_total"), F.lit(True), max_pages)
    rows = reached.select("manager_id", "fund_key", "page_no", "page_url", F.posexplode(parsing.file_links(F.col("body"))).alias("pos", "href"))
    rows = rows.withColumn("url", parsing.absolute_url(F.col("page_url"), F.col("href")))
    # a file that several funds list is the first one's, in the registry's order
    order = funds.select("manager_id", "fund_key", "ord").dropDuplicates(["manager_id", "fund_key"])
    rows = _once(rows.join(F.broadcast(order), ["manager_id", "fund_key"], "left"), ["manager_id"], [F.asc_nulls_last("ord"), F.col("fund_key"), F.col("page_no"), F.col("pos")])
    name = F.element_at(F.split("url", "/"), -1)
    rows = rows.withColumns({"title": name, "kind": parsing.report_kind(name, "period_word")}).where("kind <> 'daily'")
    reason = F.when(F.col("kind") != "weekly", "the file name is neither weekly nor daily")
    return coded(rows, funds).select("manager_id", "fund_key", "fund_code", "url", parsing.flat_date(F.col("title")).alias("published"), "title", F.lit(None).cast("string").alias("label"), parsing.period_date(F.col("title")).alias("filename_date"), reason.alias("reason"))


def fund_page_entries(bodies: DataFrame, funds: DataFrame) -> DataFrame:
    """Entries of one page per fund: bodies manager_id, fund_key, page_url, status, body. Only
    reports of changes count; a page that failed is a dead entry."""
    # one pass: a failed page is one entry with its reason, any other gives its links
    failed = F.when(F.coalesce(F.col("status") != 200, F.lit(True)), F.concat(F.lit("the fund's page returned HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("no status"))))
    links = F.when(failed.isNull(), parsing.file_links(F.col("body"))).otherwise(F.array(F.lit(None).cast("string")))
    found = bodies.select("manager_id", "fund_key", "page_url", failed.alias("reason"), F.posexplode(links).alias("pos", "href"))
    found = found.withColumn("url", F.when(F.col("reason").isNull(), parsing.absolute_url(F.col("page_url"), F.col("href"))))
    found = _once(found, ["manager_id"], [F.col("fund_key"), F.col("pos")])
    name = parsing.base_name(F.col("url"))
    found = found.withColumn("title", F.coalesce(name, "page_url")).where(F.col("reason").isNotNull() | (parsing.report_kind(F.col("title"), "change_word") == "weekly"))
    code = F.when(F.col("reason").isNull(), F.col("fund_code"))
    when = F.when(F.col("reason").isNull(), parsing.any_date(F.col("title")))
    return coded(found, funds).select("manager_id", "fund_key", code.alias("fund_code"), "url", F.lit(None).cast("date").alias("published"), "title", F.lit(None).cast("string").alias("label"), when.alias("filename_date"), "reason")


def locations(bodies: DataFrame) -> DataFrame:
    """sitemap_url, url: the <loc> values of sitemap bodies, whatever their namespace."""
    loc = F.regexp_extract_all("body", F.lit(r"<(?:\w+:)?loc(?:\s[^>]*)?>\s*([^<]+?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return bodies.select("sitemap_url", F.posexplode(loc).alias("pos", "url")).withColumn("url", F.trim(parsing.unescape(F.col("url")))).where("url <> ''")


def child_sitemaps(index: DataFrame, max_pages: int = MAX_PAGES) -> tuple[DataFrame, bool]:
    """The report sitemaps that an index (sitemap_url, body) names, in order, up to the limit, and
    whether these are all; an index without one is an error."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    every = locations(index).where(path.rlike(REPORT_SITEMAP))
    n = every.count()
    if not n:
        raise ValueError("the sitemap index names no report sitemap")
    return every.orderBy("pos").limit(max_pages).select(F.col("url").alias("sitemap_url")), n <= max_pages


def sitemap_pages(children: DataFrame) -> DataFrame:
    """The distinct pages of child sitemaps (sitemap_url, status, body). A child that failed or is
    empty is an error: a partial list is no result."""
    bad = children.join(locations(children).select("sitemap_url").distinct(), "sitemap_url", "left_anti").unionByName(children.where("status <> 200")).select("sitemap_url").first()
    if bad:
        raise ValueError(f"a report sitemap failed or has no pages: {bad['sitemap_url']}")
    return locations(children).select("url").distinct()


def save_pages(pages: DataFrame, folder: str, sitemap_url: str, n_sitemaps: int, complete: bool, now: Column | None = None) -> bool:
    """Keeps a complete list with the time and the counts that its reader checks; a partial walk is not kept."""
    if complete:
        record = pages.withColumns({"sitemap_url": F.lit(sitemap_url), "created_at": F.current_timestamp() if now is None else now, "sitemap_count": F.lit(n_sitemaps)})
        record.write.mode("overwrite").parquet(folder)
    return complete


def current_pages(saved: DataFrame, sitemap_url: str, now: Column, max_pages: int = MAX_PAGES, hours: float = TTL_HOURS) -> DataFrame | None:
    """A saved list of pages if it is of this sitemap, whole, not empty and no older than the limit; else None."""
    age = (now.cast("double") - F.col("created_at").cast("double")) / 3600
    ok = (F.col("sitemap_url") == sitemap_url) & age.between(0, hours) & F.col("sitemap_count").between(1, max_pages) & F.col("url").isNotNull()
    row = saved.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.countDistinct("created_at").alias("times")).collect()[0]
    return saved.select("url") if row["n"] and row["n"] == row["ok"] and row["times"] == 1 else None


def candidate_pages(pages: DataFrame, manager: str, funds: DataFrame) -> DataFrame:
    """manager_id, page_url, fund_key: the pages whose slug names a fund and a weekly report; no other need be fetched."""
    slug = parsing.page_slug(F.col("url"))
    weekly = pages.select(F.lit(manager).alias("manager_id"), F.col("url").alias("page_url"), slug.alias("slug")).where(F.col("slug").rlike(parsing.WEEKLY_PAGE))
    return matched(weekly, funds, F.col("slug"), "token", "fund_key").where("fund_key is not null").drop("slug")


def report_page_entries(bodies: DataFrame, funds: DataFrame) -> DataFrame:
    """Entries of report pages: bodies manager_id, page_url, fund_key, status, body (NULL if the
    page could not be fetched). The file's own name says which fund and which kind it is.

    One pass over the bodies: each becomes its files, or one entry with the reason why it has
    none; each file gets the kinds of entry that it stands for ("ref" and "mixed" for a
    weekly report of another fund than its page's).
    """
    why = (
        F.when(F.col("body").isNull(), "the report page could not be fetched")
        .when(F.coalesce(F.col("status") != 200, F.lit(True)), F.concat(F.lit("the report page returned HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("no status"))))
    )
    none = F.lit("the report page has no file link")

    def entry_of(url: Column, name: Column, why: Column) -> Column:
        kind = F.when(url.isNotNull(), parsing.report_kind(name, "bc_code"))
        return F.struct(url.alias("url"), F.coalesce(name, F.col("page_url")).alias("title"), kind.alias("kind"), why.alias("why"))

    def file(href: Column) -> Column:
        named = lambda url: parsing._let(parsing.base_name(url), lambda name: entry_of(url, name, F.when(url.isNull(), none)))
        return parsing._let(parsing.absolute_url(F.col("page_url"), href), named)

    # links are named and told apart inside the page's array: a filter of rows would work the names out again
    counted = lambda f: f["kind"].isNull() | f["kind"].isin("weekly", "unknown")
    failed = lambda reason: F.array(entry_of(F.lit(None).cast("string"), F.lit(None).cast("string"), reason))
    files = parsing._let(parsing.file_links(F.col("body")), lambda hrefs: F.when(F.size(hrefs) == 0, failed(none)).otherwise(F.filter(F.transform(hrefs, file), counted)))
    found = bodies.select("manager_id", "page_url", F.col("fund_key").alias("page_key"), F.explode(F.when(why.isNotNull(), failed(why)).otherwise(files)).alias("f"))
    # each page's file once; nearly all are, so they are dealt out before they are compared
    found = found.select("manager_id", "page_url", "page_key", "f.*").repartition("page_url").distinct()
    found = matched(found, funds, F.when(F.col("kind") == "weekly", F.col("title")), "prefix", "own_key")
    # the first page of each file; pages without a file are dealt out
    dealt = F.when(F.col("url").isNull(), F.col("page_url"))
    first = F.row_number().over(Window.partitionBy("manager_id", "url", F.col("own_key").isNotNull(), dealt).orderBy("page_url"))
    kept = F.col("own_key").isNotNull() & F.col("url").isNotNull()
    found = found.withColumn("_first", F.when(kept, first == 1).otherwise(False))
    entry = lambda key, url, reason: F.struct(key.alias("fund_key"), url.alias("url"), reason.alias("reason"))
    no_text, own, page = F.lit(None).cast("string"), F.col("own_key"), F.col("page_key")
    entries = F.array(
        F.when(F.col("why").isNotNull(), entry(page, no_text, F.col("why"))),
        F.when(F.col("kind") == "unknown", entry(page, no_text, F.lit("a report's file name of no known kind"))),
        F.when((F.col("kind") == "weekly") & own.isNull(), entry(no_text, no_text, F.lit("the file name begins with no registered fund"))),
        F.when(own != page, entry(own, no_text, F.concat(F.lit("the page names "), page, F.lit(", the file name "), own, F.lit("; the file name counts")))),
        F.when(F.col("_first"), entry(own, F.col("url"), no_text)),
    )
    rows = found.select("manager_id", "title", "why", F.explode(F.array_compact(entries)).alias("e")).select("manager_id", "title", "why", "e.*")
    of_file = lambda c: F.when(F.col("why").isNull(), c)
    return coded(rows, funds).select("manager_id", "fund_key", of_file(F.col("fund_code")).alias("fund_code"), "url", F.lit(None).cast("date").alias("published"), "title", F.lit(None).cast("string").alias("label"), of_file(parsing.flat_date(F.col("title"))).alias("filename_date"), "reason")


#: How a manager's bodies are read, by the name in the registry.
CRAWLERS = {"listing": listing_entries, "form": form_entries, "fund_pages": fund_page_entries, "report_pages": report_page_entries}


def discover(managers: dict, bodies: dict[str, DataFrame], funds: DataFrame, max_pages: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(refs, dead) of several managers: bodies by manager, each as its crawler reads it, pages up to the limit."""
    every = None
    for manager, rows in bodies.items():
        crawler = manager_config(managers, manager).get("crawler")
        if crawler not in CRAWLERS:
            raise NotImplementedError(f"manager {manager!r} has no crawler ({crawler!r}); its status is {managers[manager].get('status', 'unknown')}")
        paged = {"max_pages": max_pages} if crawler in ("listing", "form") else {}
        got = CRAWLERS[crawler](rows, funds.where(F.col("manager_id") == manager), **paged)
        every = got if every is None else every.unionByName(got)
    if every is None:
        raise ValueError("no bodies are given")
    return split_entries(every)


def write_refs(refs: DataFrame, folder: str) -> None:
    refs.write.mode("overwrite").json(folder)


def read_refs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("manager_id string, fund_key string, fund_code string, url string, published date, title string, label string, filename_date date, path string").json(folder)


def fetched(refs: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs with the path of their document, those not fetched with an error): manifest url, path."""
    known = manifest.groupBy("url").agg(F.max("path").alias("path"))
    base = refs.drop("path")
    return base.join(known, "url"), base.join(known, "url", "left_anti").withColumn("error", F.lit("not fetched"))


def with_codes(refs: DataFrame, funds: DataFrame) -> DataFrame:
    """The fund code that the registry gives the ref's key, else the one the ref carries."""
    codes = funds.select("manager_id", "fund_key", F.col("fund_code").alias("_code")).dropDuplicates(["manager_id", "fund_key"])
    return refs.join(F.broadcast(codes), ["manager_id", "fund_key"], "left").withColumn("fund_code", F.coalesce("_code", "fund_code")).drop("_code")
