"""URL filters: host and path rules, else logistic regression on hashed character n-grams.

The classifier is fitted on the driver from a small labelled table of URLs (url_labels.LABELLED, or any
list of (url, blocked) pairs the caller passes, which is used whole) and its weights,
2**BITS floats, travel with the task. Host, path and rules are built-in expressions.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and
is judged by the classifier on the empty string. URLs of any length are read whole. Repeated rows are judged
alike, an empty table gives no rows, and further columns of the input are kept unless they bear
the name of a result column, which then replaces them. Of rules of equal length the first by name wins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import ascii_lower
from talkloom.llm.url_labels import LABELLED

BITS = 14
ORDERS = (3, 4, 5)
_BREAK = re.compile(r"[-._/~]+")

def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of host and path with their values. Names are read part by part, with marks at
    either end of a part; host and path count alike, however long they are. The host's last label (com,
    net) and a leading www are left out: they say nothing of what a site is."""
    name = (host.rpartition(".")[0] or host).removeprefix("www.")
    out, value = [], []
    for mark, text in (("h", name), ("p", path)):
        parts = [f"^{x}$" for x in _BREAK.split(text) if x]
        grams = [zlib.crc32((mark + part[i : i + n]).encode()) for part in parts for n in ORDERS for i in range(len(part) - n + 1)]
        out += grams
        value += [max(1, len(grams)) ** -0.5] * len(grams)
    return np.array(out, dtype=np.int64) & ((1 << BITS) - 1), np.array(value)


def probability(w: np.ndarray, b: float, host: str, path: str) -> float:
    """Of being blocked."""
    grams, value = features(host, path)
    return float(1 / (1 + np.exp(-((w[grams] * value).sum() + b))))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as the column expressions below compute them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def fit(labelled: Iterable[tuple[str, int]] = LABELLED, steps: int = 500, l2: float = 1e-4, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and intercept: gradient descent on the log loss, both classes weighing alike."""
    rows = list(labelled)
    found = [features(*split_url(u)) for u, _ in rows]
    y = np.array([b for _, b in rows], dtype=float)
    owner = np.repeat(np.arange(len(rows)), [len(g) for g, _ in found])
    flat, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
    share = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) / 2
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-(np.bincount(owner, w[flat] * value, len(rows)) + b))) - y)
        w -= rate * (np.bincount(flat, value * g[owner], 1 << BITS) + l2 * w)
        b -= rate * g.sum()
    return w, b


def host_col(url: F.Column) -> F.Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_col(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labelled: Iterable[tuple[str, int]] = LABELLED,
    url: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """Adds host, path, rule, verdict and score (the classifier's probability of "block").

    rules: ("allow" or "block", host + path prefix). A rule fits its host and all subdomains when
    the path starts with the rule's path; the longest wins, and of equals the first by name.
    """
    w, b = fit(labelled)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([probability(w, b, h, p) for h, p in zip(host, path)], dtype="float64")

    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        h, _, p = r.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, said = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    c = F.col(url)
    return (
        pages.withColumns({"host": host_col(c), "path": path_col(c)})
        .withColumns({"rule": rule, "score": score("host", "path")})
        .withColumn("verdict", F.coalesce(said, F.when(F.col("score") >= threshold, "block").otherwise("allow")))
    )
