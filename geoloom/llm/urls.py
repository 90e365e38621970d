"""URL filter: fixed host rules first, else gradient-boosted trees on lexical features of the URL.

The labelled URLs are those that a rule decides. Trees are fitted on the driver to a bounded sample of them
(`MAX_ROWS`, by a row hash) with histograms of at most `BINS` quantile bins, both verdicts weighing the same, and are
then written as nested CASE expressions, so scoring runs in the JVM over all rows.

Suffix statistics are counted over all rows: how many URLs have the host's last three labels, and the share blocked
among the labelled URLs that agree in the host's last two labels, in the suffix of the file name, and in the first part
of the path. Hosts are dealt to `FOLDS` folds; what a labelled URL gets is counted without the hosts of its own fold, so that
a share does not tell the label that it is to help to predict. `held_out` measures the trees on hosts that they have not
seen.

Defined cases: a null URL, or one without `://`, has an empty host and path and is judged by the trees; with no
labelled URL every verdict of the trees is `allow`; with labels of one kind only it is that kind; repeated rows give
repeated results; an empty table gives an empty table; a URL of any length is judged whole; only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import bounded_sample, materialize, table

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH, FOLDS = 30, 3, 32, 0.3, 20, 1.0, 5
STATISTICS = ["site", "suffix", "ending", "head"]
FEATURES = [
    "url_length", "host_length", "host_labels", "host_hyphens", "depth", "digit_ratio", "entropy", "params", "fragment", "dots_in_path",
    "site_log", "suffix_blocked", "ending_blocked", "head_blocked",
]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a URL, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL's text, by name."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": _count(host, ".").cast("double"),
        "host_hyphens": _count(host, "-").cast("double"),
        "depth": _count(path, "/").cast("double"),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, string.digits, ""))) / n,
        "entropy": entropy,
        "params": (_count(url, "&") + F.when(F.contains(url, F.lit("?")), 1).otherwise(0)).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "dots_in_path": _count(path, ".").cast("double"),
    }


@dataclass
class Trees:
    """Regression trees: (feature, threshold, left, right) or a leaf's value, nested; and the prior's log-odds."""

    prior: float
    trees: list

    def expression(self, columns: list[Column]) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(columns[feature] <= threshold, of(left)).otherwise(of(right))

        total = F.lit(self.prior)
        for t in self.trees:
            total = total + of(t)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        def of(node, rows) -> np.ndarray:
            if isinstance(node, float):
                return np.full(len(rows), node)
            left = rows[:, node[0]] <= node[1]
            out = np.empty(len(rows))
            out[left], out[~left] = of(node[2], rows[left]), of(node[3], rows[~left])
            return out

        return self.prior + sum((of(t, x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log-odds of y, by Newton steps on histograms; both values of y weigh the same."""
    if not len(y) or y.min() == y.max():
        return Trees(-1.0 if not len(y) or y[0] == 0 else 1.0, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    raw, trees = np.zeros(len(y)), []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                n = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                gl = np.bincount(b, grad[rows], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(b, hess[rows], len(e) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g**2 / (h + SMOOTH)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k))
        if best[1] is None:
            value = float(-RATE * g / (h + SMOOTH))
            raw[rows] += value
            return value
        j, k = best[1]
        left = binned[rows, j] <= k
        return (j, float(edges[j][k]), grow(rows[left], grad, hess, depth + 1), grow(rows[~left], grad, hess, depth + 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), 0))
    return Trees(0.0, trees)


def parted(df: DataFrame, keep: list[str], url: str, rules=RULES) -> DataFrame:
    """kept, url, host, path, rule, decided, fold, site, suffix, ending and head of every row."""
    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(url).alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.select("kept", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(FOLDS)).cast("int")
    ending, head = F.regexp_extract("path", r"\.([^./]*)$", 1), F.regexp_extract("path", r"^/([^/]*)/", 1)
    return rows.select("*", rule.alias("rule"), verdict.alias("decided"), fold.alias("fold"), F.substring_index("host", ".", -3).alias("site"), F.substring_index("host", ".", -2).alias("suffix"), ending.alias("ending"), head.alias("head"))


def statistics(rows: DataFrame) -> DataFrame:
    """kind, value, urls, told (labelled URLs) and blocked of every suffix, and the arrays told_in, blocked_in by fold."""
    told, blocked = F.col("decided").isNotNull().cast("long"), F.coalesce((F.col("decided") == "block").cast("long"), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in STATISTICS])).alias("x")
    counts = rows.select("fold", told.alias("t"), blocked.alias("b"), each).select("fold", "t", "b", "x.*").groupBy("kind", "value")
    by_fold = lambda c: F.array(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)) for f in range(FOLDS)])
    out = counts.agg(F.count("*").alias("urls"), F.sum("t").alias("told"), F.sum("b").alias("blocked"), by_fold("t").alias("told_in"), by_fold("b").alias("blocked_in"))
    return materialize(out, "url-statistics")


def featured(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """kept, host, path, rule, decided, fold and the features of rows of `parted`; counts: `statistics` of all rows."""
    made = lexical(F.col("url"), F.col("host"), F.col("path"))
    out = rows.select("kept", "host", "path", "rule", "decided", "fold", *STATISTICS, *[c.alias(n) for n, c in made.items()])
    own = F.col("decided").isNotNull()
    for kind in STATISTICS:
        of = counts.where(F.col("kind") == kind).drop("kind").withColumnRenamed("value", kind)
        out = out.join(of, kind)
        without = lambda c: F.col(c) - F.when(own, F.get(f"{c}_in", F.col("fold"))).otherwise(0)
        share = (without("blocked") + 1) / (without("told") + 2)
        made = {"site_log": F.log1p(F.col("urls").cast("double"))} if kind == "site" else {f"{kind}_blocked": share}
        out = out.withColumns(made).drop("urls", "told", "blocked", "told_in", "blocked_in", kind)
    return out


def sample(rows: DataFrame, counts: DataFrame) -> np.ndarray:
    """Label (1: block), fold and features of at most MAX_ROWS rows that a rule decides, in order of their values."""
    chosen = bounded_sample(rows.where(F.col("decided").isNotNull()), MAX_ROWS, "kept", "url")
    data = featured(chosen, counts).select((F.col("decided") == "block").cast("int").alias("y"), "fold", *FEATURES).collect()
    data = sorted(map(tuple, data))  # the trees do not depend on the order of arrival
    return np.array(data, float).reshape(-1, 2 + len(FEATURES))


def held_out(data: np.ndarray) -> float:
    """The probability that trees fitted to the other folds' hosts score a blocked URL above an allowed one, over each fold's URLs; the mean over folds with both."""
    out = []
    for f in range(FOLDS):
        test = data[:, 1] == f
        y = data[test, 0]
        if y.min(initial=1) == y.max(initial=0) or not test.any():
            continue
        score = fit(data[~test, 2:], data[~test, 0]).score(data[test, 2:])
        yes, no = np.sort(score[y == 1]), score[y == 0]
        below, upto = np.searchsorted(yes, no, "left"), np.searchsorted(yes, no, "right")
        out.append(1 - ((below + upto) / 2).mean() / len(yes))
    return float(np.mean(out)) if out else float("nan")


def judge(df: DataFrame, keep: list[str], url: str, rules=RULES) -> DataFrame:
    """keep, host, path, rule, verdict and block_odds (the trees' log-odds of a block) of every row."""
    rows = parted(df, keep, url, rules)
    counts = statistics(rows)
    data = sample(rows, counts)
    odds = fit(data[:, 2:], data[:, 0]).expression([F.col(f) for f in FEATURES])
    verdict = F.coalesce("decided", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    rows = featured(rows, counts).select("kept", "host", "path", "rule", "decided", odds.alias("block_odds"))
    return rows.select(*[F.col(f"kept.{c}").alias(c) for c in keep], "host", "path", "rule", verdict.alias("verdict"), "block_odds")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), ["page_id"], "url")


QUERIES = {"op4_urls": op4_urls}
ORACLE: dict[str, str] = {}
