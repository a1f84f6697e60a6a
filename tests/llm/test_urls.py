import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform_value
from vertexlens.llm.lookup import with_values
from vertexlens.llm.urls import RULES, Rule, UrlParams, grams, url_verdicts

P = UrlParams()
FIRST, LAST = "\x02", "\x03"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (low(m[1]), m[2]) if m else ("", "")


def rule_of(host, path, rules=RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


def grams_of(form):
    s = FIRST * P.order + form + LAST
    return [s[i : i + P.order + 1] for i in range(len(form) + 1)]


def brute(urls):
    """Verdicts by plain counting of contexts of each length, one model at a time."""
    rows = []
    for u in urls:
        host, path = parts(u)
        form = low(u.split("://", 1)[1] if u and "://" in u else u or "")
        rows.append((host, path, form, rule_of(host, path)))
    held = {f: uniform_value(P.seed, f) < P.held for _, _, f, _ in rows}
    models = {}
    for verdict in ("allow", "block"):
        after = defaultdict(Counter)
        for _, _, f, r in rows:
            if r and r.verdict == verdict and not held[f]:
                for g in grams_of(f):
                    for k in range(P.order + 1):
                        after[g[P.order - k : P.order]][g[-1]] += 1
        models[verdict] = after

    def prob(after, g):
        q = 1 / P.alphabet
        for k in range(P.order + 1):
            c = after.get(g[P.order - k : P.order])
            if c and c.total() >= P.least:
                q = (c[g[-1]] + len(c) * q) / (c.total() + len(c))
        return q

    def score(form):
        bits = [math.floor(1e6 * (math.log(prob(models["allow"], g)) - math.log(prob(models["block"], g)))) for g in grams_of(form)]
        return sum(bits) // len(bits)

    known = Counter()
    for _, _, f, r in rows:
        if r and held[f]:
            known[(score(f) // P.step * P.step, r.verdict)] += 1
    yes = sum(n for (_, v), n in known.items() if v == "allow")
    no = known.total() - yes
    least = 0
    if yes and no:
        gain = lambda t: sum(n for (s, v), n in known.items() if v == "allow" and s >= t) / yes + sum(n for (s, v), n in known.items() if v == "block" and s < t) / no
        least = max(sorted({s for s, _ in known}), key=gain)
    return [(h, p, r and r.name, r.verdict if r else "allow" if score(f) >= least else "block", None if r else score(f)) for h, p, f, r in rows]


def some_urls():
    r = random.Random(5)
    hosts = ["www.example.com", "example.com", "blog.Example.COM", "a.net", "b.net", "sub.b.net", "xcom", "netes.org", "good.org", "bad.org", "com", "net"]
    tails = ["", "/", "/en/1", "/es/2", "/fr/3?x=/es/", "/de/4#/fr/", "?q=://", "#f", "/EN/5"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(tails)}{r.choice(['', r.randrange(50)])}" for _ in range(300)]
    return [*urls, None, "", "no scheme com/", "://", "a://", "x://y://z.com/en/", "http://é日.org/ü", "http://ads.net/es/😀", "http://a.net\n/es/1", urls[0], urls[0], "http://q.org/" + "ab" * 40_000]


def test_verdicts_against_brute_force(spark):
    urls = some_urls()
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, form string, n string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.score) for r in url_verdicts(pages).collect()}
    want = brute(urls)
    assert len(got) == len(urls)
    for i, w in enumerate(want):
        assert got[i] == w, urls[i][:80] if urls[i] else urls[i]
    assert {w[3] for w in want if w[2] is None} == {"allow", "block"}


def test_a_subdomain_is_no_suffix_and_the_longest_rule_wins():
    assert rule_of("xcom", "/") is None and rule_of("com", "/").name == "com/"
    assert rule_of("www.example.com", "/en/1").verdict == "allow" and rule_of("blog.example.com", "/en/1").verdict == "block"


def test_empty_tables_null_ids_and_no_rules(spark):
    kind = "page_id bigint, url string"
    assert url_verdicts(spark.createDataFrame([], kind)).collect() == []
    rows = url_verdicts(spark.createDataFrame([(None, None), (None, "http://a.org/b"), (7, "http://a.org/b"), (7, "http://a.org/b")], kind), rules=()).collect()
    assert sorted((r.page_id is None, r.host, r.verdict, r.score) for r in rows) == [(False, "a.org", "allow", 0)] * 2 + [(True, "", "allow", 0), (True, "a.org", "allow", 0)]


def test_equally_long_rules_that_fit(spark):
    rules = (Rule("block", "a.com", "/b/"), Rule("allow", "x.a.com", "/"))
    row = url_verdicts(spark.createDataFrame([(1, "http://x.a.com/b/")], "page_id bigint, url string"), rules).first()
    assert (row.rule, row.verdict) == ("x.a.com/", "allow")


def test_grams_count_code_points(spark):
    row = grams(spark.createDataFrame([("a😀",)], "form string"), 2).select("gram").collect()
    assert [r.gram for r in row] == [FIRST * 2 + "a", FIRST + "a😀", "a😀" + LAST]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_values_by_broadcast_or_by_shuffle(spark, bound):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(400)] + [("x" * 300, i) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, i int")
    values = df.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.min(F.length("key")).alias("v"))
    got = with_values(df, values, "key", broadcast_bytes=bound)
    assert sorted((r.key, r.i, r.v) for r in got.collect()) == sorted((k, i, len(k)) for k, i in rows)
