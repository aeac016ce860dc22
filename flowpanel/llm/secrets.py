r"""Operator 10: secret scans with base patterns and character Markov models, native only.

Base patterns find assignments, access keys and long hexadecimal runs, each leftmost and
non-overlapping by kind. Two first-order Markov models over the characters of a token, one of
random strings and one of ordinary identifiers, add the stretch of a token whose log-likelihood
ratio speaks most for a random string. Both are trained from labelled samples: strings of
random letters and digits in the usual alphabets made by rule from digests (label random),
and words of the corpus and of programs, joined as names, slugs, paths, addresses and
assignments are (label ordinary), the words from a bounded sample of ``train_docs`` documents
with the least hash of their id.

Candidates of the models are runs of 20 or more of the characters that keys use; shorter ones
are left to the base patterns, as a ratio over a few characters tells little. In a run the
stretch with the greatest sum of ratios, each less a small toll, is sought in one pass and
widened to the separators (``/ = _ -``) around it: a key at the end of a path is a span, the
path is none. It counts if it has 20 characters and its sum reaches a cut that grows with the
run's length, as a long run has more stretches to be wrong about. A run holds one such stretch.

Spans are in code points, the end exclusive. Null and empty texts have none; texts are
scanned whole, in time that grows with their length and their number of spans; repeated rows
give repeated results; an empty table gives an empty result. Without training texts the
ordinary model knows no pair and the random one decides alone. Other columns, whatever their
names, are kept by ``scan`` and ``redact`` and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Cuts, hex_sha256, running, sampled_ids, table

#: The fixed base patterns; matches whose group is shorter than the number are dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12),
    # a maximal run that is too short holds no longer one, so the length may stand in the pattern
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates of the Markov models; the toll on each step, the least characters of a stretch, and
#: what its sum must reach, with what each doubling of the run's length adds.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
TOLL, LEAST = 1.2, 20
RATIO, DOUBLING = 20.0, 1.5
#: Weight of the single characters in the estimate of a pair.
BACKOFF = 4.0
TRAIN_DOCS = 2000
TRAIN_WORDS = 50_000
TRAIN_RANDOM = 4000

SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """All matches of pattern in text as spans; those whose group is too short are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # zipped, so that no lambda evaluates a regular expression again; the last gap has no match
    parts = F.transform(
        F.filter(F.arrays_zip(between.alias("gap"), whole.alias("m"), value.alias("value")), lambda z: z["m"].isNotNull()),
        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["m"]).alias("len"), z["value"].alias("value")),
    )
    begins = running(parts, F.lit(0), lambda at, p: at + p["gap"] + p["len"])
    ended = F.zip_with(
        parts,
        begins,
        lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["len"]).alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value")),
    )
    found = F.filter(ended, lambda s: F.length(s["value"]) >= least) if least and group else ended
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def _steps(token: Column) -> Column:
    """The code of each pair of neighbouring characters (a * 128 + b) of an ASCII token, in one
    pass however long it is."""
    codes = F.transform(F.slice(F.split(token, ""), 1, F.length(token)), F.ascii)
    after = F.slice(codes, 2, F.greatest(F.length(token) - 1, F.lit(0)))
    return F.zip_with(F.slice(codes, 1, F.greatest(F.length(token) - 1, F.lit(0))), after, lambda a, b: a * 128 + b)


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of neighbouring characters of the column token: code (a * 128 + b), n."""
    steps = _steps(F.col("token"))
    return tokens.where(F.length("token") > 1).select(F.explode(steps).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def random_strings(spark: SparkSession, n: int = TRAIN_RANDOM) -> DataFrame:
    """Samples labelled random, made from digests: hexadecimal, base-64 in both alphabets, letters
    and digits of both cases, of one case."""
    digest = F.sha2(F.col("id").cast("string"), 512)
    b64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(b64, r"[+/=\s]", "")
    kinds = [F.substring(digest, 1, 40), F.substring(b64, 1, 44), F.translate(F.substring(b64, 1, 44), "+/", "-_"), F.substring(plain, 1, 40), F.upper(F.substring(plain, 1, 40)), F.lower(F.substring(plain, 1, 40))]
    token = F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int"))
    return spark.range(n).select(token.alias("token"))


#: Fixed sample: words that names in programs, paths and addresses are made of.
CODE_WORDS = (
    "abstract access account action active adapter address admin agent alias alpha amount api app archive array asset async attribute auth author base batch bean binary block blog body boolean branch buffer build bundle button byte cache "
    "call category channel character check class client cluster code collection column command common component config connection const container content context controller core count create current custom data database date debug default "
    "delete device dialog directory display document domain download editor element email enable encode engine entity entry error event exception execute export factory field file filter find folder form format frame function gateway get "
    "global graph group handler hash header helper html http identifier image import index info init input instance int interface internal item iterator java job json kernel key label language layout left lib library line link list local "
    "lock log login main manager map master memory message method model module name network node number object option order org output package packages page parameter parse path pattern plugin policy port post print process product profile project "
    "property protocol proxy public python query queue random read record reference region remote report request resource response result root route row rule sample schema script search security select sequence server service session set setting "
    "share shared simple singleton site size sort source spark sql src stack start state static status storage store stream string style sub summary support switch symbol sync system table tag target task template test text thread time title token tool "
    "tree type unit update upload url user usr util utils valid value vector version video view visit web widget window word worker write xml year zone"
).split()


def ordinary_words(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS) -> DataFrame:
    """Samples labelled ordinary: words of a bounded sample of documents outside base spans and of
    programs, alone and joined with others: as names in both styles, slugs, paths, addresses,
    assignments and constants, with numbers and years; and ruled lines."""
    ids = F.broadcast(sampled_ids(docs.where("text is not null"), train_docs))  # at most train_docs rows
    some = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id")
    clean = F.col("text")
    for _, pattern, _, _ in BASE:
        clean = F.regexp_replace(clean, pattern, " ")
    word = some.select(F.explode(F.split(clean, f"[{SPACE}]+")).alias("w")).where(F.col("w").rlike(r"^[A-Za-z_-]{2,}$"))
    word = word.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(train_words).select("w")
    own = F.array(*[F.lit(w) for w in CODE_WORDS])
    # a program's word stands as often as it takes for both kinds to weigh alike
    code = docs.sparkSession.range(len(CODE_WORDS) * 160).select(F.get(own, (F.col("id") % len(CODE_WORDS)).cast("int")).alias("w"), "id")
    word = word.withColumn("id", F.lit(0).cast("bigint")).unionByName(code)
    other = lambda seed: F.get(own, F.pmod(F.xxhash64("w", "id", F.lit(seed)), F.lit(len(CODE_WORDS))).cast("int"))
    word = word.select("w", *[other(k).alias(f"o{k}") for k in (1, 2, 3)], F.pmod(F.xxhash64("w", "id"), F.lit(3000)).cast("string").alias("n"))
    low, up, title = F.lower("w"), F.upper, F.initcap
    styles = F.array(
        F.col("w"), F.concat(title("o1"), title("w"), title("o2"), title("o3")), F.concat("o1", title("w"), title("o2"), "n"), F.concat_ws("_", "o1", low, "o2", "n"), F.concat_ws("_", up("o1"), up("w"), up("o2")),
        F.concat_ws("-", low, "o1", "o2", "o3"), F.concat_ws("-", "o1", "n", low), F.concat(F.lit("/"), F.concat_ws("/", "o1", low, "o2", "o3", "n")), F.concat_ws("/", "o1", "o2", title("o3"), "w"), F.concat(low, F.lit("="), "o1", F.lit("_"), "n"),
        F.concat("n", "n", F.lit("/"), "n", F.lit("-"), "n"),
    )
    rules = docs.sparkSession.range(5 * 400).select(F.repeat(F.get(F.array(*map(F.lit, "-=_/+")), (F.col("id") % 5).cast("int")), F.lit(60)).alias("token"))
    return word.select(F.explode(styles).alias("token")).unionByName(rules)


def log_ratios(spark: SparkSession, docs: DataFrame, train_docs: int = TRAIN_DOCS) -> list[float]:
    """log p(b | a, random) - log p(b | a, ordinary) at a * 128 + b.

    Two tables of at most 128 * 128 counts reach the driver.
    """
    models = []
    for tokens in (random_strings(spark), ordinary_words(docs, train_docs)):
        count = {r["code"]: r["n"] for r in _pairs(tokens).collect()}
        total = [sum(count.get(a * 128 + b, 0) for b in range(128)) for a in range(128)]
        # add-half smoothing over the 66 characters that candidates may hold; rare pairs lean on it
        single = [sum(count.get(a * 128 + b, 0) for a in range(128)) for b in range(128)]
        single = [(n + 0.5) / (sum(single) + 33.0) for n in single]
        models.append([math.log((count.get(i, 0) + BACKOFF * single[i & 127]) / (total[i >> 7] + BACKOFF)) for i in range(128 * 128)])
    return [round(a - b, 6) for a, b in zip(*models)]


def _stretch(token: Column, table_: Column) -> Column:
    """The stretch of an ASCII token with the greatest sum of ratios less tolls: start, end (in the
    token, widened to the separators around it) and sum, found in one pass."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("from"), F.lit(0.0).alias("run"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        i, gain = acc["i"] + 1, F.get(table_, code) - TOLL
        fresh = acc["run"] <= 0.0
        start, run = F.when(fresh, acc["i"]).otherwise(acc["from"]), F.when(fresh, gain).otherwise(acc["run"] + gain)
        better = run > acc["sum"]
        return F.struct(i.alias("i"), start.alias("from"), run.alias("run"), F.when(better, start).otherwise(acc["start"]).alias("start"), F.when(better, i + 1).otherwise(acc["end"]).alias("end"), F.when(better, run).otherwise(acc["sum"]).alias("sum"))

    run = "[A-Za-z0-9+]*"

    def widened(best: Column) -> Column:
        """A part of a piece at either end is widened to the piece if it is half of it at least, else left out."""
        before = F.length(F.regexp_extract(F.substring(token, F.lit(1), best["start"]), f"{run}$", 0))
        first = F.length(F.regexp_extract(F.substr(token, best["start"] + 1), f"^{run}", 0))
        last = F.length(F.regexp_extract(F.substring(token, F.lit(1), best["end"]), f"{run}$", 0))
        after = F.length(F.regexp_extract(F.substr(token, best["end"] + 1), f"^{run}", 0))
        start = F.when(first >= before, best["start"] - before).otherwise(best["start"] + first)
        end = F.when(last >= after, best["end"] + after).otherwise(best["end"] - last)
        return F.struct(start.alias("start"), end.alias("end"), best["sum"].alias("sum"))

    def trimmed(best: Column) -> Column:
        """Separators at the ends are none of the key."""
        lead = F.length(F.regexp_extract(F.substr(token, best["start"] + 1), "^[/=_-]*", 0))
        end = F.length(F.regexp_replace(F.substring(token, F.lit(1), best["end"]), "[/=_-]+$", ""))
        return F.struct((best["start"] + lead).alias("start"), end.alias("end"), best["sum"].alias("sum"))

    best = F.transform(F.transform(F.array(F.aggregate(_steps(token), zero, step)), widened), trimmed)
    return F.get(best, F.lit(0))


def _keys(token: Column, table_: Column, ratio: float) -> Column:
    """The stretch of a token that counts as a key, as a struct(start, end), else NULL."""
    cut = ratio + DOUBLING * F.log2(F.length(token) / LEAST)
    return F.get(F.transform(F.array(_stretch(token, table_)), lambda b: F.when((b["sum"] >= cut) & (b["end"] - b["start"] >= LEAST), F.struct(b["start"].alias("start"), b["end"].alias("end")))), F.lit(0))


def scan(docs: DataFrame, ratios: list[float], ratio: float = RATIO) -> DataFrame:
    """docs' columns (text among them) and after them base (spans of the base patterns) and
    spans (all), two arrays of structs. docs may have columns of these names: then there are two
    of each, the caller's first; ``found`` gives the two arrays under names of the caller's choice."""
    return found(docs, ratios, ("base", "spans"), ratio)


def found(docs: DataFrame, ratios: list[float], names: tuple[str, str], ratio: float = RATIO) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    base = F.concat(*[_spans(text, kind, pattern, group, least) for kind, pattern, group, least in BASE])
    inside = lambda s, k: F.struct((s["start"] + k["start"]).alias("start"), (s["start"] + k["end"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    keyed = F.transform(_spans(text, "markov", TOKEN), lambda s: F.struct(s.alias("s"), _keys(s["value"], model, ratio).alias("k")))
    more = F.transform(F.filter(keyed, lambda x: x["k"].isNotNull()), lambda x: inside(x["s"], x["k"]))
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # all that was there goes along in one struct, and names that the caller uses are not ours
    kept = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    row, b, m = _free(docs.columns, "row", "base", "more")
    seen = docs.select(kept.alias(row), base.alias(b), more.alias(m)).select(row, order(F.col(b)).alias(b), order(F.col(m)).alias(m))
    # a token that a base span already covers is no new finding: sorted by start, the base spans
    # that reach furthest among those that begin no later decide
    both = F.array_sort(F.concat(F.transform(b, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("k"), s["end"].alias("end"))), F.transform(m, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("k"), s["end"].alias("end")))))
    reach = F.zip_with(both, running(both, F.lit(0), lambda at, s: F.when(s["k"] == 0, F.greatest(at, s["end"])).otherwise(at)), lambda s, at: F.struct(s["k"].alias("k"), at.alias("at")))
    fresh = F.zip_with(m, F.filter(reach, lambda r: r["k"] == 1), lambda s, r: F.struct(s.alias("s"), r["at"].alias("at")))
    fresh = F.transform(F.filter(fresh, lambda x: x["s"]["end"] > x["at"]), lambda x: x["s"])
    spans = F.when((F.size(b) > 0) & (F.size(m) > 0), order(F.concat(b, fresh))).when(F.size(m) > 0, F.col(m)).otherwise(F.col(b))
    done = seen.select(row, b, spans.alias(m))
    return done.select(f"{row}.*", done[b].alias(names[0]), done[m].alias(names[1]))


def _free(columns: list[str], *names: str) -> tuple[str, ...]:
    """The names, each with the first number that makes it none of the columns."""
    return tuple(next(n for k in range(len(columns) + 1) if (n := f"_{x}{k}") not in columns) for x in names)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of text that spans cover replaced by mark, and n_chars, if it is a
    number, set anew. All other columns stay, whatever their names."""
    columns = docs.columns
    own = _free([*columns, *_free(columns, "base")], "base", "spans", "text")
    marked = found(docs, ratios, own[:2])
    spans = F.col(own[1])
    text = F.coalesce(F.col("text"), F.lit(""))
    # spans by start; one that begins inside those before lengthens their stretch
    until = running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    opens = F.filter(F.zip_with(spans, until, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    cuts = Cuts(text)
    parts = F.transform(opens, lambda x: F.concat(cuts.part(x["at"], x["start"]), F.lit(mark)))
    clean = F.concat(F.array_join(parts, ""), cuts.part(F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"])), F.length(text)))
    marked = marked.withColumn(own[2], F.when(F.size(spans) > 0, clean))
    out = {"text": F.coalesce(own[2], "text")}
    if "n_chars" in columns and docs.schema["n_chars"].dataType.typeName() in ("long", "integer"):
        out["n_chars"] = F.when(F.size(spans) > 0, F.length(own[2]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return marked.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, log_ratios(spark, docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        hex_sha256(joined(F.col("base"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
