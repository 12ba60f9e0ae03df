"""URL filter: allow and block rules, and a classifier for what no rule decides.

The classifier is logistic regression on hashed character n-grams of host and path,
trained on a small labelled URL table (``EXAMPLES`` or any rows of url and label, of
which at most ``MAX_LABELLED`` are used, by smallest hash). Training takes place once, when the
query is built; the weights are a vector of ``DIMENSIONS`` floats, whatever the data.

A rule is a host and the start of a path. It fits its host and all subdomains; of all
rules that fit the longest decides. Rules are a short list held in the plan.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule
fits it; with nothing to judge it is allowed (probability zero); repeated rows are judged each and urls of any
length read whole; an empty table gives an empty result; columns host, path, rule, unwanted and verdict are replaced,
all others pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import unused

DIMENSIONS = 1 << 14
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (verdict, host, start of the path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# The labelled table: host names by label; each is met with every ending in PATHS, so
# that paths that both labels have say nothing.
UNWANTED = """
casino-royal best-casino online-casino-bonus casinobets slots-jackpot jackpot-win win-slots poker-bonus
bet-now bets-live sportsbets betting-odds bet365-free freebet lucky-bets win-money-now
spamlinks link-farm linkfarm seo-spam spam-mail content-farm clickbait-farm
adtracker track-ads ad-server adserver ads-network clicktrack pixel-track popup-ads banner-ads doubleads
adult-video xxx-adult x-adult-cams porn-tube free-porn sex-cams hot-adult-x nude-cams
pills-online cheap-meds buy-pills viagra-cheap discount-pills cheap-viagra pharma-pills cheap-replica
payday-loans-fast crypto-doubler get-rich-quick miracle-weight-loss
""".split()
WANTED = """
library city-library university physics history-museum weather gardening recipes cooking news daily-news journal
science research astronomy biology chemistry medicine hospital clinic school college teachers students exams maths
music orchestra theatre cinema books bookshop publisher magazine poetry letters travel railway airport hotels maps
football cycling swimming athletics chess hiking climbing sailing forest river ocean mountains village townhall
parliament law courts justice police fire-service charity museum gallery painting sculpture architecture bridges
engineering software python linux database compiler hardware electronics robotics farm-life farming dairy-farm
tracks-and-trails train-track adults-learning adult-education winter-sports winery better-homes alphabet tibet
the and there other think nation station ration thing earth north than with hand land stand thread leather
ing tion ther hent onth erth ould tible nder ingly ences thern reat anti oned shou ting haed erea ward ness
""".split()
PATHS = ("/en/12", "/de/907/", "/fr/4411.html", "/es/38", "/", "", "/en/5/index", "/archive/2021/05")
ENDINGS = ("example.com", "example.org", "example.net")
FRONTS = ("", "www.", "m.", "blog.")


def _examples() -> list[tuple[str, int]]:
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for i, name in enumerate(names):
            for k in range(6):
                front, end = FRONTS[(i + k) % len(FRONTS)], ENDINGS[(i + k) % len(ENDINGS)]
                rows.append((f"https://{front}{name}.{end}{PATHS[(i + 3 * k) % len(PATHS)]}", label))
    return rows


EXAMPLES = _examples()


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of verdict and rule, or null."""
    choice = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        choice = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(choice)
    return choice


def slots(host: str, path: str) -> np.ndarray:
    """Hash slots of the distinct n-grams of host and path."""
    found = set()
    for mark, part in ((b"h", host), (b"p", path)):
        data = b"^" + part.encode("utf-8", "replace") + b"$"
        for n in GRAMS:
            found.update(zlib.crc32(data[i : i + n], zlib.crc32(mark)) % DIMENSIONS for i in range(len(data) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def _split(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    rest = rest.split("?")[0].split("#")[0] if mark else ""
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c in UPPER else c for c in host), slash + path


def train(examples=None, rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) from (url, label) rows; full-batch gradient descent."""
    rows = sorted(examples if examples is not None else EXAMPLES, key=lambda r: (zlib.crc32(r[0].encode()), r))
    rows = rows[:MAX_LABELLED]
    if not rows:
        return np.zeros(DIMENSIONS + 1)
    each = [slots(*_split(url)) for url, _ in rows]
    y = np.array([float(label) for _, label in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for s in each])
    column = np.concatenate(each)
    value = np.repeat([1 / np.sqrt(max(1, len(s))) for s in each], [len(s) for s in each])
    weights, bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        score = np.bincount(row, value * weights[column], len(rows)) + bias
        error = 1 / (1 + np.exp(-score)) - y
        weights -= rate * (np.bincount(column, value * error[row], DIMENSIONS) / len(rows) * 10 + decay * weights)
        bias -= rate * error.mean()
    return np.append(weights, bias)


def unwanted_probability(host: Column, path: Column, weights: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = np.empty(len(hosts))
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            at = slots(h, p)
            out[i] = weights[at].sum() / np.sqrt(max(1, len(at))) + weights[-1] if h or p else -np.inf
        return pd.Series(1 / (1 + np.exp(-out)))

    return score(host, path)


def judge_urls(
    pages: DataFrame, url: str = "url", rules=RULES, examples=None, threshold: float = 0.5
) -> DataFrame:
    """``pages`` with host, path, rule, unwanted (probability) and verdict."""
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "unwanted", "verdict")]
    mark = unused(pages, "_rule")
    parts = pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = parts.withColumn(
        "unwanted", unwanted_probability(F.col("host"), F.col("path"), train(examples))
    ).withColumn(mark, longest_rule(F.col("host"), F.col("path"), rules))
    judged = F.when(F.col("unwanted") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *rest, "host", "path", F.col(f"`{mark}`.rule").alias("rule"), "unwanted",
        F.coalesce(f"`{mark}`.verdict", judged).alias("verdict"),
    )
