import re

import pytest

from genosieve.llm import licenses as L, url_filter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x.org", "/fr/ab", "block"), ("org", "", "block")]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1]) and host]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = ["http://A.example.net/en/1?x#y", "https://example.net/de/", "http://net", "http://net/", "http://xnet/", "http://x.org/fr/abc", "http://x.org/fr/", "http://y.x.org/fr/ab", "nothing", "", None, "http://", "://x.org/fr/", "http://example.com:80/de/", "http://m.example.com/de/a/b/../c", "http://a.org#/fr/", "http://É.ORG/fr/x", "x://y://z.net/", "http://a..net/", "http://net./", "http://a\nb.net/q"]


def test_urls(spark):
    df = spark.createDataFrame([(i % 25, u, "h") for i, u in enumerate(URLS * 2)] + [(None, URLS[0], "h")], "page_id long, url string, host string")
    rows = U.judge(df, U.rules_table(spark, tuple(RULES))).collect()
    want = sorted(map(str, ((r.page_id, *brute(r.url, RULES)) for r in df.collect())))
    assert sorted(map(str, map(tuple, rows))) == want
    assert U.judge(df.where("false"), U.rules_table(spark)).count() == 0


def test_urls_stay_native(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), U.rules_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("createDataFrame", ""))


def words(text):
    import regex

    return regex.sub(r"(?<![\p{L}\p{N}])[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?![\p{L}\p{N}])", " ", (text or "").lower()).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_licenses(docs, templates=L.TEMPLATES, least=0.8):
    t = {n: shingles(x) for n, x in templates}
    return sorted((i, n) for i, text in docs for n, s in t.items() if s and len(s & shingles(text)) >= least * len(s))


def test_licenses(spark, documents):
    found = sorted((r.doc_id, r.template) for r in L.scan(documents, L.templates_table(spark)).collect())
    assert found == brute_licenses([(r.doc_id, r.text) for r in documents.collect()]) and found


@pytest.mark.parametrize("few", [8 << 20, 0])
def test_changed_licenses(spark, odd, few, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BYTES", few)
    grant = dict(L.TEMPLATES)["MIT-grant"].split()
    docs = [(1, "a b c " * 50 + " ".join(grant) + " d e f" * 40), (2, " ".join(grant[:30] + ["CHANGED"] + grant[31:])), (3, " ".join(grant[:20])), (4, "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"), (5, None), (6, ""), (None, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (8, "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", __import__("pyspark").sql.functions.lit(1))
    found = sorted(((r.doc_id, r.template) for r in L.scan(df, L.templates_table(spark)).collect()), key=str)
    assert found == sorted(((i, n) for i, t in docs for _, n in brute_licenses([(i, t)])), key=str)
    assert L.scan(df.where("false"), L.templates_table(spark)).count() == 0
    assert L.scan(df, L.templates_table(spark).where("false")).count() == 0
