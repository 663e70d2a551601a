"""URL filters: host and path rules first, else logistic regression on hashed character n-grams.

Only DataFrame and SQL functions stand on the main path. The model is trained once per session from
a small labelled table of addresses kept here (the bound is the table's own length), by full-batch
gradient descent; its weights become whole numbers, so the sum of a row's weights is exact in any
engine and any order. Features are the distinct character trigrams of ``host`` and of ``path``, each
hashed to one of BUCKETS by a polynomial of its characters' codes.

A null address, or one without ``://``, has an empty host and path, fits no rule and is judged by the
bias alone. Repeated rows are judged alike; extra columns are not read. The work grows in proportion to
an address's length.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

BUCKETS = 4096
SCALE = 10_000

# A small labelled table of our own: 1 = block, 0 = allow.
LABELLED = (
    ("cheap-pills.example", "/buy/now", 1), ("win-prizes.example", "/claim?free", 1), ("casino-bonus.example", "/spin/slots", 1), ("bet365x.example", "/odds/live", 1),
    ("free-download.example", "/crack/keygen", 1), ("adult-cams.example", "/xxx/live", 1), ("loan-fast.example", "/apply/payday", 1), ("click-track.example", "/ads/banner", 1),
    ("pharma-deal.example", "/viagra/order", 1), ("torrent-hub.example", "/warez/full", 1), ("ads.tracker.example", "/pixel/click", 1), ("lottery-win.example", "/jackpot/claim", 1),
    ("m.spamlist.example", "/cheap/casino", 1), ("hotdeals.example", "/sale/discount-pills", 1), ("poker-room.example", "/bonus/free-spins", 1), ("redirect.example", "/go/aff?id=7", 1),
    ("docs.python.example", "/library/os.html", 0), ("en.wiki.example", "/wiki/Physics", 0), ("news.daily.example", "/en/2112", 0), ("blog.science.example", "/en/posts/17", 0),
    ("university.example.org", "/de/course/algebra", 0), ("library.example.org", "/fr/livre/12", 0), ("www.museum.example.org", "/es/arte/9", 0), ("gov.example.org", "/law/section-4", 0),
    ("weather.example.com", "/en/forecast", 0), ("recipes.example.com", "/en/bread.html", 0), ("history.example.com", "/fr/revolution", 0), ("health.example.com", "/en/guide/sleep", 0),
    ("blog.tech.example.com", "/es/articulo/5", 0), ("www.schule.example.org", "/de/mathe", 0), ("archive.example.org", "/en/1203", 0), ("m.journal.example.com", "/fr/6793", 0),
)


def _hash_py(gram: str, field: int) -> int:
    a, b, c = (ord(x) for x in gram)
    return (a * 961 + b * 31 + c + 2017 * field) % BUCKETS


def _features_py(host: str, path: str) -> set[int]:
    return {_hash_py(x[i : i + 3], f) for f, x in enumerate((f"^{host}$", f"^{path}$")) for i in range(len(x) - 2)}


@lru_cache(maxsize=1)
def weights(epochs: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """(bias, weight of each bucket), times SCALE and rounded."""
    rows = [(sorted(_features_py(h, p)), y) for h, p, y in LABELLED]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        grad, g0 = {}, 0.0
        for x, y in rows:
            e = 1 / (1 + math.exp(-(bias + sum(w[i] for i in x)))) - y
            g0 += e
            for i in x:
                grad[i] = grad.get(i, 0.0) + e
        bias -= rate * g0 / len(rows)
        for i, g in grad.items():
            w[i] -= rate * (g / len(rows) + penalty * w[i])
    return round(bias * SCALE), tuple(round(x * SCALE) for x in w)


def _rule(host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # longer ones last, so that they stand outermost
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(text: str, field: int) -> str:
    """SQL: buckets of a marked text's trigrams, each matched on its own, so that the work grows with the length alone."""
    code = lambda i: f"ascii(substring(g, {i}, 1))"
    return f"transform(regexp_extract_all(concat('^', {text}, '$'), '(?s)(?=(...)).', 1), g -> cast(pmod({code(1)} * 961 + {code(2)} * 31 + {code(3)} + {2017 * field}, {BUCKETS}) as int))"


def judge(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, logit): logit is the model's, times SCALE; 0 or more blocks."""
    bias, w = weights()
    table = "array(" + ",".join(map(str, w)) + ")"
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", F.expr("case when locate('://', url) > 0 then substring(url, locate('://', url) + 3) else '' end").alias("rest"))
    rows = rows.select("page_id", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    grams = " , ".join(f"case when length({x}) = 0 then cast(array() as array<int>) else {_grams(x, f)} end" for f, x in enumerate(("host", "path")))
    rows = rows.withColumn("grams", F.expr(f"array_distinct(concat({grams}))"))
    rows = rows.withColumn("logit", F.expr(f"cast({bias} + aggregate(grams, 0, (s, g) -> s + element_at({table}, g + 1)) as long)"))
    rule, verdict = _rule()
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("logit") >= 0, "block").otherwise("allow")).alias("verdict"), "logit")
