"""Operator 6, URL filters: rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (given as
rows, or the seed table below, which is composed of common words and made-up
syllables and holds no host of any data). It scores host and path n-grams of
all URLs of an Arrow batch at once.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no
rule and has no n-grams, so the model's intercept decides; repeated rows are
judged one by one; no text is shortened; extra columns pass by unused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import slices, table

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
#: (action, host, path) rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words that hosts of unwanted and of wanted pages are made of.
UNWANTED = """casino poker bet bets betting slots jackpot roulette bingo lottery gambling pills pharma viagra cialis drugs adult xxx porn sex
    cam escort dating spam click clicks ads adserver advert tracker track popup banner malware phishing warez torrent crack keygen loan
    payday cheap replica rolex prize winner win bonus free deals coupon""".split()
WANTED = """news library museum university school science physics history garden recipes weather council maps docs wiki blog books reading
    journal arts music sport travel health city forum archive research press gallery theatre radio language nature rivers mountain
    bridge market community family education data""".split()


def seed_urls(seed: int = 5) -> list[tuple[str, int]]:
    """The labelled table (1 is unwanted), composed by rule: hosts of one or two words of a kind, hosts of made-up syllables as wanted, paths that both kinds have."""
    rng = np.random.default_rng(seed)
    ends, fronts, paths = ("test", "invalid", "example"), ("", "www.", "m.", "blog."), ("", "/", "/en/12", "/de/3.html", "/fr/728", "/page?x=1", "/es/47/", "/2020/a")
    pick = lambda xs: str(rng.choice(list(xs)))
    syllables = [c + v for c in "bcdfghklmnprstvwz" for v in "aeiou"] + ["th", "sh", "st", "er", "an", "in", "on", "re"]
    rows = []
    for label, kind, neutral in ((1, UNWANTED, ("hub", "x", "zone", "online", "now", "24")), (0, WANTED, ("hub", "online", "land", "net", "lab", "24"))):
        for w in kind:
            for host in (w, f"{w}-{pick(kind)}", f"{pick(kind)}{w}", f"{w}-{pick(neutral)}", f"{pick(neutral)}{w}"):
                rows.append((f"https://{pick(fronts)}{host}.{pick(ends)}{pick(paths)}", label))
    rows += [(f"https://{pick(fronts)}{''.join(pick(syllables) for _ in range(rng.integers(2, 5)))}.{pick(ends)}{pick(paths)}", 0) for _ in range(200)]
    # paths tell something too
    rows += [(f"https://{''.join(pick(syllables) for _ in range(3))}.{pick(ends)}/{a}/{b}", label) for label, kind in ((1, ("win", "bonus", "offer", "promo", "xxx", "casino")), (0, ("articles", "wiki", "lessons", "archive", "about", "papers"))) for a in kind for b in kind]
    return rows


def _lower_ascii(column):  # noqa: ANN001, ANN202
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str = "url") -> tuple:
    """Columns host and path of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    return _lower_ascii(host), path


def rule_column(host, path, rules: Iterable[tuple[str, str, str]]):  # noqa: ANN001, ANN201
    """The longest fitting rule's (name, action), or null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def url_features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed n-grams of hosts and paths, each field marked; rows without host and path have none."""
    fields = [(k, f"{mark}:^{x}$".encode()) for k, (h, p) in enumerate(zip(hosts, paths, strict=True)) if h or p for mark, x in (("h", h), ("p", p))]
    if not fields:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(x) for _, x in fields])
    raw = np.frombuffer(b"".join(x for _, x in fields), np.uint8).astype(np.uint64)
    field, row = np.repeat(np.arange(len(fields)), size), np.repeat(np.array([k for k, _ in fields]), size)
    out = []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) ^ raw[k : m + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        inside = field[:m] == field[n - 1 :]
        out.append(row[:m][inside] * BUCKETS + (h >> np.uint64(64 - 14)).astype(np.int64)[inside])
    both = np.unique(np.concatenate(out))
    return both // BUCKETS, both % BUCKETS


def url_scores(hosts: list[str], paths: list[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    """Log-odds of being unwanted."""
    row, bucket = url_features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    return np.bincount(row, model[0][bucket], len(hosts)) / np.sqrt(np.maximum(n, 1)) + model[1]


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for c in "?#" if (k := path.find(c)) >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def fit_urls(rows: Iterable[tuple[str, int]] | None = None, steps: int = 400, rate: float = 2.0, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of the regression, by full gradient steps over the small table."""
    rows = list(seed_urls() if rows is None else rows)
    row, idx = url_features(*(list(x) for x in zip(*(_parts(u) for u, _ in rows), strict=True))) if rows else url_features([], [])
    y = np.array([label for _, label in rows], float)
    norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps if len(rows) else 0):
        z = np.bincount(row, w[idx] * norm[row], len(rows)) + b
        e = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(idx, e[row] * norm[row], BUCKETS) / len(rows) * 4 + l2 * w)
        b -= rate * e.mean()
    return w, float(b)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, score (probability of being unwanted) and verdict."""
    w, b = model or fit_urls()
    host, path = split_url()
    r = rule_column(F.col("host"), F.col("path"), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "path"):
            z = url_scores(batch.column("host").to_pylist(), batch.column("path").to_pylist(), (w, b))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["page_id", "host", "path", "score"])

    scored = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, score double")
    judged = scored.withColumn("_r", r)
    verdict = F.coalesce(F.col("_r.action"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), "score", verdict.alias("verdict"))


#: Everything but the model's own verdict, which SQL cannot give; for tests.
OP6_RULES_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
r AS (SELECT page_id, CASE WHEN position('://' IN u) > 0 THEN substr(u, position('://' IN u) + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k(action, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, arg_max(k.h || k.s, length(k.h || k.s)) AS rule, arg_max(k.action, length(k.h || k.s)) AS ruled
FROM p LEFT JOIN k ON (host = k.h OR ends_with(host, '.' || k.h)) AND starts_with(path, k.s) GROUP BY ALL
"""


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, else by the regression."""
    return judge_urls(table(spark, sf_dir, "pages"))
