import math
import re
from collections import Counter

import numpy as np

from geoloom.llm import urls as U


def _slow(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(rules, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def _features(url):
    host, path, _, _ = _slow(url)
    url = url or ""
    n = max(1, len(url))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    digits = sum(c in "0123456789" for c in url) / n
    return [len(url), len(host), host.count("."), host.count("-"), path.count("/"), digits, entropy, url.count("&") + ("?" in url), float("#" in url), path.count(".")]


URLS = ["http://WWW.Example.com/en/1?a=1&b=2#x", "https://example.com/en/2", "ftp://a.b.example.com/en/", "https://x.net/fr/9", "http://com/", "http://com", "no scheme", "", None, "x://y://z/net/es/", "http://É.org/p", "http://a.net/es/" + "9" * 5000, "http://xexample.com/en/", "https://u@h.net:80/es/?q"]


def _frame(spark, urls):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")


def _featured(df):
    rows = U.parted(df, ["page_id"], "url")
    return U.featured(rows, U.statistics(rows))


def test_rules_and_features_against_plain_python(spark):
    rows = _featured(_frame(spark, URLS * 2)).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        url = URLS[r.kept.page_id % len(URLS)]
        assert (r.host, r.path, r.rule, r.decided) == _slow(url)
        assert np.allclose([r[f] for f in U.FEATURES[:10]], _features(url), atol=1e-9)


def _statistics(urls, folds):
    """For each URL its four statistics, plainly: a labelled one does without the hosts of its fold."""
    facts = []
    for u in urls:
        host, path, _, decided = _slow(u)
        ending, head = re.search(r"\.([^./]*)$", path), re.match(r"/([^/]*)/", path)
        facts.append((".".join(host.split(".")[-2:]), ending[1] if ending else "", head[1] if head else "", decided, folds[host], ".".join(host.split(".")[-3:])))
    out = []
    for f in facts:
        row = [math.log1p(sum(g[5] == f[5] for g in facts))]
        for k in range(3):
            some = [g for g in facts if g[k] == f[k] and g[3] and not (f[3] and g[4] == f[4])]
            row.append((sum(g[3] == "block" for g in some) + 1) / (len(some) + 2))
        out.append(row)
    return out


def test_statistics_cover_all_rows_but_the_own_fold(spark):
    urls = URLS + [f"http://h{i % 17}.a.{'net' if i % 3 else 'com'}/{'es' if i % 4 == 0 else 'en'}/{i}.html" for i in range(80)]
    rows = _featured(_frame(spark, urls)).collect()
    want = _statistics(urls, {r.host: r.fold for r in rows})
    assert all(np.allclose([r[f] for f in U.FEATURES[10:]], want[r.kept.page_id]) for r in rows) and len({r.fold for r in rows}) == U.FOLDS


def test_held_out_hosts(spark):
    """The trees rank labelled URLs of hosts that they have not seen, and do not judge all undecided URLs alike."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = U.parted(pages, ["page_id"], "url")
    data = U.sample(rows, U.statistics(rows))
    assert U.held_out(data) > 0.85
    open_ones = U.judge(pages, ["page_id"], "url").where("rule is null").groupBy("verdict").count().collect()
    assert len(open_ones) == 2 and min(r["count"] for r in open_ones) > 50


def test_trees_learn_and_score_alike_in_both_engines(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = U.fit(x, y)
    assert ((trees.score(x) > 0) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], "a double, b double, c double")
    got = [r[0] for r in df.select(trees.expression([df.a, df.b, df.c])).collect()]
    assert np.allclose(got, trees.score(x[:200]))


def test_query_against_plain_python(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    rows = U.parted(pages, ["page_id"], "url")
    counts = U.statistics(rows)
    data = U.sample(rows, counts)
    trees = U.fit(data[:, 2:], data[:, 0])
    facts = {r.kept.page_id: r for r in U.featured(rows, counts).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = U.op4_urls(spark, sf_small).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, decided = _slow(urls[r.page_id])
        assert np.allclose([facts[r.page_id][f] for f in U.FEATURES[:10]], _features(urls[r.page_id]))
        odds = trees.score(np.array([[facts[r.page_id][f] for f in U.FEATURES]]))[0]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (decided or ("block" if odds > 0 else "allow"))


def test_edge_tables(spark):
    assert U.judge(_frame(spark, []), ["page_id"], "url").count() == 0
    assert {r.verdict for r in U.judge(_frame(spark, ["http://a.org/", None]), ["page_id"], "url").collect()} == {"allow"}
    assert {r.verdict for r in U.judge(_frame(spark, ["http://a.net/es/", "http://a.org/"]), ["page_id"], "url").collect()} == {"block"}
    assert len(U.judge(_frame(spark, URLS), ["page_id"], "url").collect()) == len(URLS)
