"""URL filter: allow and block rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import ascii_lower

# A small labelled table of invented URLs; 1 is to be blocked. Both kinds have the same prefixes, endings and paths.
LABELLED_URLS: tuple[tuple[str, int], ...] = (
    ("http://casino-royal.example.com/en/12", 1), ("http://library.example.com/en/905", 0),
    ("https://www.win-casino.example.org/fr/340.html", 1), ("https://www.university.example.org/fr/61.html", 0),
    ("http://m.casino-spins.example.net/en/77/", 1), ("http://m.gardener.example.net/en/228/", 0),
    ("https://blog.online-casino.example.com/es/905?page=2", 1), ("https://blog.museum.example.com/es/4503?page=2", 0),
    ("http://mega-casino-win.example.org/de/61#top", 1), ("http://dailynews.example.org/de/86#top", 0),
    ("https://www.best-bets.example.net/es/228", 1), ("https://www.weather.example.net/es/12", 0),
    ("http://m.free-bets-now.example.com/fr/4503.html", 1), ("http://m.recipes.example.com/fr/340.html", 0),
    ("https://blog.sports-bets.example.org/en/86/", 1), ("https://blog.docs.example.org/en/77/", 0),
    ("http://bets-free.example.net/fr/12?page=2", 1), ("http://school.example.net/fr/905?page=2", 0),
    ("https://www.poker-free.example.com/de/340#top", 1), ("https://www.travel.example.com/de/61#top", 0),
    ("http://m.cheap-pills-shop.example.org/es/77", 1), ("http://m.health.example.org/es/228", 0),
    ("https://blog.buy-cheap-pills.example.net/de/905.html", 1), ("https://blog.history.example.net/de/4503.html", 0),
    ("http://pills-discount.example.com/en/61/", 1), ("http://forum.example.com/en/86/", 0),
    ("https://www.cheap-meds.example.org/fr/228?page=2", 1), ("https://www.cinema.example.org/fr/12?page=2", 0),
    ("http://m.adult-x-videos.example.net/en/4503#top", 1), ("http://m.science.example.net/en/340#top", 0),
    ("https://blog.x-adult.example.com/es/86", 1), ("https://blog.archive.example.com/es/77", 0),
    ("http://adult-chat.example.org/de/12.html", 1), ("http://theatre.example.org/de/905.html", 0),
    ("https://www.adult-cams.example.net/es/340/", 1), ("https://www.another.example.net/es/61/", 0),
    ("http://m.ads-click.example.com/fr/77?page=2", 1), ("http://m.thinker.example.com/fr/228?page=2", 0),
    ("https://blog.track-ads.example.org/en/905#top", 1), ("https://blog.nation.example.org/en/4503#top", 0),
    ("http://ads-track-pixel.example.net/fr/61", 1), ("http://station.example.net/fr/86", 0),
    ("https://www.adserver-track.example.com/de/228.html", 1), ("https://www.other.example.com/de/12.html", 0),
    ("http://m.spam-links.example.org/es/4503/", 1), ("http://m.thread.example.org/es/340/", 0),
    ("https://blog.spam-farm-seo.example.net/de/86?page=2", 1), ("https://blog.tradition.example.net/de/77?page=2", 0),
    ("http://link-farm.example.com/en/12#top", 1), ("http://edition.example.com/en/905#top", 0),
    ("https://www.farm-of-spam.example.org/fr/340", 1), ("https://www.her.example.org/fr/61", 0),
    ("http://m.win-prize.example.net/en/77.html", 1), ("http://m.theory.example.net/en/228.html", 0),
    ("https://blog.free-prize-win.example.com/es/905/", 1), ("https://blog.athens.example.com/es/4503/", 0),
    ("http://cheap-loans.example.org/de/61?page=2", 1), ("http://thing.example.org/de/86?page=2", 0),
    ("https://www.fast-cash-win.example.net/es/228#top", 1), ("https://www.anthem.example.net/es/12#top", 0),
)
# The rules that apply unless others are given: verdict, host, path.
RULES: tuple[tuple[str, str, str], ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hexadecimal digits of an n-gram's md5 that name its bucket; SQL engines agree on md5, so the oracle can retrain.
DIGITS = 3
BUCKETS = 16**DIGITS
SIZES = (3, 4)
MAX_RULES = 1000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; empty without :// or url."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def features(host_: Column, path_: Column) -> Column:
    """Buckets (0 to BUCKETS - 1) of the character n-grams of ^host$ and of the path, one entry per n-gram."""

    def grams(text: Column, kind: int, size: int) -> Column:
        places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
        digest = lambda i: F.md5(F.concat(F.lit(str(kind)), F.substr(text, i, F.lit(size))).cast("binary"))
        return F.transform(places, lambda i: F.conv(F.substring(digest(i), 1, DIGITS), 16, 10).cast("int"))

    framed = F.concat(F.lit("^"), host_, F.lit("$"))
    return F.concat(*[grams(framed, 0, s) for s in SIZES], *[grams(path_, 1, s) for s in SIZES])


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED_URLS, rounds: int = 200, rate: float = 0.5, decay: float = 0.002) -> list[float]:
    """Weights (index 0: intercept, bucket b at b + 1) by batch gradient descent, all in one SQL expression.

    labelled must be a small table (up to MAX_RULES rows): it becomes one row. The features' count vectors have unit length.
    The descent runs in the dual: after each round the weights are the sum of alpha[j] * x[j], so it needs only the rows'
    inner products, and the weights of the buckets are made once at the end.
    """
    if not labelled or len(labelled) > MAX_RULES:
        raise ValueError(f"the labelled table must have 1 to {MAX_RULES} rows")
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double")
    grams = rows.select("i", "y", F.explode(F.concat(F.transform(features(host(F.col("url")), path(F.col("url"))), lambda b: b + 1), F.array(F.lit(0)))).alias("b"))
    counts = grams.groupBy("i", "y", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norm = counts.groupBy("i").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    x = counts.join(norm, "i").select("i", "y", "b", (F.col("c") / F.col("norm")).alias("x"))
    other = x.select(F.col("i").alias("j"), "b", F.col("x").alias("z"))
    kernel = x.join(other, "b").groupBy("i", "y", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    lines = kernel.groupBy("i", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda s: s["k"]).alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda s: s["j"]).alias("js"))
    n = len(labelled)
    dense = lines.select("i", "y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.get(F.col("k"), F.array_position("js", j).cast("int") - 1), F.lit(0.0))).alias("k"))
    one = dense.agg(F.array_sort(F.collect_list(F.struct("i", "y", "k"))).alias("m"))
    step = lambda a: F.transform("m", lambda r: F.get(a, r["i"]) * (1 - decay) + rate * (r["y"] - 1 / (1 + F.exp(-F.aggregate(F.zip_with(r["k"], a, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)))))
    alpha = one.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("m", lambda r: F.lit(0.0)), lambda a, _: step(a))).alias("i", "alpha"))
    weights = x.join(F.broadcast(alpha), "i").groupBy("b").agg(F.sum(F.col("x") * F.col("alpha")).alias("w")).collect()
    out = [0.0] * (BUCKETS + 1)
    for r in weights:
        out[r["b"]] = r["w"]
    return out


def score(host_: Column, path_: Column, weights: Sequence[float]) -> Column:
    """The probability that a URL is to be blocked, with features scaled to unit length as in training."""
    w = F.from_json(F.lit(json.dumps(list(map(float, weights)))), "array<double>")
    buckets = F.array_sort(features(host_, path_))
    # In sorted order, a run's squared count is the sum of 1, 3, 5, ... over its entries.
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("q"), F.lit(-1).alias("last"), F.lit(0).alias("run"))

    def step(a: Column, b: Column) -> Column:
        run = F.when(b == a["last"], a["run"] + 1).otherwise(F.lit(1))
        return F.struct((a["s"] + F.get(w, b + 1)).alias("s"), (a["q"] + 2.0 * run - 1.0).alias("q"), b.alias("last"), run.alias("run"))

    return F.aggregate(buckets, zero, step, lambda a: 1 / (1 + F.exp(-(a["s"] + float(weights[0])) / F.sqrt(a["q"]))))


def judge(pages: DataFrame, weights: Sequence[float], rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url).

    A rule fits its host and all subdomains where the path starts with the rule's; of several the longest (host and path
    together, then the smaller by text) decides. Else the verdict is block from threshold on. Null urls and urls without
    :// have an empty host and path, and are judged by the intercept. Rules and weights are bounded and become expressions:
    nothing is shuffled. Repeated rows are judged alike; other columns are not read.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        if kind not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks; {kind} is neither")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    scored = parts.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("score", score(F.col("host"), F.col("path"), weights))
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_score).alias("verdict"), "score")
