"""URL filters: rules first, else logistic regression on hashed character 3-grams of host and path.

A 3-gram of code points (a, b, c) falls into slot (a*A + b*B + c*C + part) mod
SLOTS; host and path are hashed apart.  The model is fitted by gradient steps
on a small labelled table of URLs (below, or the caller's), its weights are
rounded to millionths, and a score is a sum of integers, the same in any
engine.  Scoring is one Spark projection.

Defined cases: a null url, or one without ``://``, has empty host and path and
matches no rule; with no 3-gram, the model's intercept decides.  Repeated rows
are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import lower_ascii

#: Fixed values of the contract: verdict, rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

SLOTS = 2048
FACTORS = (961, 31, 1)
PARTS = {"host": 0, "path": 7}
UNIT = 1_000_000

#: The labelled table: 1 is to be blocked.
LABELLED = (
    ("https://www.gutenberg.example/ebooks/1342", 0), ("https://docs.library.example/en/tutorial/intro.html", 0), ("http://news.city.example/2021/05/council", 0),
    ("https://blog.garden.example/en/posts/roses", 0), ("https://m.weather.example/de/heute", 0), ("https://wiki.history.example/fr/article/12", 0),
    ("https://www.museum.example/es/visita", 0), ("http://school.example/en/853/", 0), ("https://journal.science.example/en/671", 0),
    ("https://www.cooking.example/recipes/bread.html", 0), ("https://blog.thernon.example/en/12", 0), ("https://m.thourea.example/fr/825", 0),
    ("https://www.tionhan.example/en/474.html", 0), ("http://thernd.example/es/533/", 0), ("https://stereon.example/de/25#top", 0),
    ("https://blog.ering.example/en/453", 0), ("https://edthan.example/en/960", 0), ("http://www.anonthe.example/en/148.html", 0),
    ("https://forum.travel.example/en/topic/77", 0), ("https://health.clinic.example/en/advice", 0), ("https://opensource.example/project/readme", 0),
    ("https://m.sports.example/es/978", 0), ("http://farmers.example/en/market", 0), ("https://pharmacy-school.example/en/students", 0),
    ("https://spam-farm.example/en/728", 1), ("http://www.cheap-pills.example/en/450", 1), ("https://casino-bonus.example/en/1", 1),
    ("https://free-casino.example/play", 1), ("http://cheap-meds.example/buy-pills", 1), ("https://adult-cams.example/live", 1),
    ("https://www.xxx-videos.example/en/22", 1), ("http://poker-win.example/bonus", 1), ("https://spam-links.example/de/3", 1),
    ("https://m.cheap-watches.example/buy", 1), ("https://link-farm.example/en/9", 1), ("http://torrent-free.example/crack", 1),
    ("https://www.viagra-pills.example/order", 1), ("http://malware-download.example/setup.exe", 1), ("https://phish-login.example/verify", 1),
    ("https://free-porn.example/es/4", 1), ("http://click-spam.example/fr/2", 1), ("https://betting-bonus.example/en/5", 1),
    ("http://www.spam-farm-links.example/en/77.html", 1), ("https://cheap-casino.example/es/8", 1), ("http://pills-cheap.example/de/6", 1),
    ("https://loan-cash-fast.example/apply", 1), ("http://replica-cheap.example/shop", 1), ("https://adult-spam.example/en/728", 1),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, as host_and_path() gives them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail.split("?", 1)[0].split("#", 1)[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def slots_of(text: str, part: str) -> list[int]:
    a, b, c = FACTORS
    return [(ord(x) * a + ord(y) * b + ord(z) * c + PARTS[part]) % SLOTS for x, y, z in zip(text, text[1:], text[2:], strict=False)]


@cache
def trained(labelled: tuple[tuple[str, int], ...] = LABELLED, steps: int = 400, rate: float = 0.5, ridge: float = 0.002) -> tuple[tuple[int, ...], int]:
    """Weights of all slots and the intercept, in millionths."""
    x = np.zeros((len(labelled), SLOTS))
    y = np.array([label for _, label in labelled], dtype=float)
    for row, (url, _) in enumerate(labelled):
        host, path = split_url(url)
        for slot in slots_of(host, "host") + slots_of(path, "path"):
            x[row, slot] += 1.0
    weights, intercept = np.zeros(SLOTS), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
        weights -= rate * (x.T @ error / len(y) + ridge * weights)
        intercept -= rate * error.mean()
    return tuple(int(v) for v in np.rint(weights * UNIT)), int(np.rint(intercept * UNIT))


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = url.isNotNull() & F.contains(url, F.lit("://"))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def _score(text: Column, part: str, weights: Sequence[int]) -> Column:
    a, b, c = FACTORS
    points = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    tail = lambda k: F.slice(points, F.lit(k), F.greatest(F.size(points) - 2, F.lit(0)))
    pair = F.zip_with(tail(1), tail(2), lambda p, q: p * a + q * b)
    slot = F.zip_with(pair, tail(3), lambda pq, r: (pq + r * c + PARTS[part]) % SLOTS)
    table = F.lit(list(weights)).cast("array<bigint>")
    return F.aggregate(slot, F.lit(0).cast("long"), lambda total, s: total + F.get(table, s.cast("int")))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: tuple[Sequence[int], int] | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, score (millionths of a logit; above 0 means block) and verdict."""
    weights, intercept = model or trained()
    host, path = host_and_path(F.col(url).cast("string"))
    out = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        at, start = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        fits = ((F.col("host") == at) | F.endswith("host", F.lit("." + at))) & F.startswith("path", F.lit(start))
        rule, said = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    out = out.withColumn("rule", rule)
    out = out.withColumn("score", F.lit(intercept).cast("long") + _score(F.col("host"), "host", weights) + _score(F.col("path"), "path", weights))
    return out.withColumn("verdict", F.coalesce(said, F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))))


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL for op2_url_filters."""
    weights, intercept = trained()
    a, b, c = FACTORS
    table = "[" + ", ".join(map(str, weights)) + "]"
    score = lambda x, part: f"coalesce(list_sum(list_transform(range(1, greatest(length({x}) - 1, 1)), lambda i: ({table})[(unicode(substr({x}, i, 1)) * {a} + unicode(substr({x}, i + 1, 1)) * {b} + unicode(substr({x}, i + 2, 1)) * {c} + {PARTS[part]}) % {SLOTS} + 1])), 0)"
    fits = lambda r: f"((host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}'))"
    by_length = sorted(rules, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in by_length) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in by_length) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
s AS (SELECT *, ({intercept} + {score('host', 'host')} + {score('path', 'path')})::BIGINT AS score FROM p)
SELECT page_id, host, path, {rule} AS rule, score, coalesce({said}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s
"""
