"""The learned half of the secret scan on strings that it has not seen."""

import base64
import random
import string

import pytest

from flowpanel.llm import common, secrets

rng = random.Random(99)
#: Words that the training list lacks, most of them.
WORDS = """quick river stone market garden silver planet engine bridge forest signal harbor castle dragon meadow thunder crystal shadow velvet lantern whisper compass anchor orchard mirror puzzle canyon
marble saddle ribbon tunnel blanket cushion pepper ginger cinnamon vanilla kitchen bottle pillow curtain ladder hammer needle basket bucket shovel rocket saturn jupiter mercury neptune apache hadoop kafka django flask
angular redis postgres mysql oracle docker kubernetes terraform ansible jenkins gitlab github release candidate snapshot nightly stable legacy deprecated checkout payment invoice shipping customer warehouse analytics""".split()
KNOWN = ["/usr/local/lib/python/site-packages/module", "src/main/java/org/apache/spark/sql", "org/reference/functions/aggregate", "en/products/kitchen/accessories/2024", "AbstractSingletonProxyFactoryBean", "CamelCaseIdentifierForTesting123",
         "this-is-a-long-article-slug-about-gardening-2023", "MAX_NUMBER_OF_CONCURRENT_CONNECTIONS", "-" * 40, "=" * 32, "_" * 30, "1234567890123456789012345", "wp-content/uploads/2023/11/header-image", "2024-01-15T10-30-45_backup_final"]


def ordinary(n):
    out = list(KNOWN)
    while len(out) < n:
        w = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        x = ["".join(a.title() for a in w), w[0] + "".join(a.title() for a in w[1:]), "_".join(w), "-".join(w) + rng.choice(["", "-2024", "-v2"]), "/" + "/".join(w), "/".join(w) + f"/{rng.randint(1, 9999)}", "_".join(w).upper(), w[0] + "=" + "-".join(w[1:])][rng.randrange(8)]
        if len(x) >= secrets.LEAST:
            out.append(x)
    return out


def keys(n):
    letters = string.ascii_letters + string.digits
    for i in range(n):
        size, raw = rng.randint(24, 48), bytes(rng.getrandbits(8) for _ in range(40))
        yield [base64.b64encode(raw).decode()[:size].rstrip("=+/"), base64.urlsafe_b64encode(raw).decode()[:size].rstrip("=-_"), "".join(rng.choice(letters) for _ in range(size)), "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(size)), "".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(size))][i % 5]


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.log_ratios(spark, common.table(spark, "/root/testdata/sf0.001", "documents"))


def spans(spark, ratios, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "markov"] for r in secrets.scan(df, ratios).collect()}
    return [got[i] for i in range(len(texts))]


def test_ordinary_strings_are_left_alone(spark, ratios):
    texts = ordinary(300)
    wrong = [t for t, s in zip(texts, spans(spark, ratios, [f"see {t} or https://host.test/{t} there" for t in texts])) if s]
    assert len(wrong) < 0.02 * len(texts) and not set(wrong) & set(KNOWN)


def test_keys_are_found_alone_and_inside_a_path(spark, ratios):
    wanted = list(keys(300))
    for around in ("see {} here", "/srv/app/config/{}/settings", "https://host.test/download/file?key={}&x=1"):
        found = spans(spark, ratios, [around.format(k) for k in wanted])
        assert sum(bool(s) for s in found) > 0.95 * len(wanted)
        # the span is the key: nothing of the path around it, and most keys to the last character
        assert all("config" not in x and "settings" not in x and "download" not in x for s in found for x in s)
        assert sum(s == [k] for s, k in zip(found, wanted)) > 0.85 * len(wanted)
