"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame and SQL functions. ``fit`` learns from labelled URLs: features are cut into
bins at quantiles of the sample; each level of a tree is one aggregation to sums of gradients and
curvatures by (node, feature, bin), and the driver reads only that histogram to choose the splits.
Gradients are rounded to whole numbers of 2**-20, so sums, and with them the trees, don't depend on the
order of rows. A model is a few trees of a few nodes and becomes one Column expression; scoring
never shuffles a URL, so a hot host costs what any row costs.

Features: lengths of URL, host and longest label; labels and hyphens of the host; depth of the
path; parameters of the query; share of digits; entropy of the host's and of the rest's characters; and
of the last host label (suffix) the blocked share and the frequency among the labelled URLs. Suffixes of fewer
than ``SUFFIX_LEAST`` labelled URLs have the overall share, so the table of suffixes has at most
sample / SUFFIX_LEAST entries.

``fit`` uses at most about ``per_class`` labelled URLs of each label, those whose hash falls under a
share; every URL is judged.

Defined results: a null URL, or one without ``://``, has empty host and path, meets no rule and is
judged like any other; an empty URL likewise. Hosts are lower-cased in A-Z only; a port or user is part of the host.
Of rules that fit the longest in characters of host and path wins, then the longest host. Repeated
rows each get the same answer. Without labelled URLs, or with one label only, the trees are
left out and the share of blocked ones decides (none: allow). Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitgrain.llm.common import pick, settle

#: The rules (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Parts of host labels that mark a URL as unwanted when URLs are labelled by ``label_by_words``.
BAD_WORDS = ("adult", "bets", "casino", "pills", "porn", "spam", "track", "xxx")

FEATURES = (
    "url_length", "host_length", "label_length", "labels", "hyphens", "depth",
    "parameters", "digit_share", "host_entropy", "rest_entropy", "suffix_blocked", "suffix_count",
)
TREES, DEPTH, BINS, RATE, RIDGE = 12, 3, 16, 0.3, 1.0
SUFFIX_LEAST = 50
PER_CLASS = 5000
UNIT = 1 << 20
THRESHOLD = 0.5


@dataclass
class Model:
    base: float = 0.0
    #: Each tree: node number -> (feature, threshold), or -> value at a leaf; children 2i + 1, 2i + 2.
    trees: list[dict] = field(default_factory=list)
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    overall: float = 0.0


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: str, path: str) -> Column:
    mine = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
    return mine & F.startswith(F.col("path"), F.lit(path))


def ruled(rules) -> tuple[Column, Column]:
    """(rule as text, its verdict) for columns ``host`` and ``path``; null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    text = verdict = F.lit(None).cast("string")
    for said, host, path in reversed(order):
        fits = _fits(host, path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def label_by_words(host: Column, words=BAD_WORDS) -> Column:
    """1 for hosts that hold one of the words, else 0; null for an empty host."""
    return F.when(host != "", reduce(lambda a, b: a | b, (F.contains(host, F.lit(w)) for w in words)).cast("int"))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", -share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 9)).otherwise(0.0)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical(urls: DataFrame, url_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, ``host``, ``path``, ``suffix`` and the lexical features of each URL."""
    parts = urls.select(
        *keep,
        F.coalesce(url_col, F.lit("")).alias("url text"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    url, host, path = F.col("url text"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    longest = F.array_max(F.transform(F.split(host, r"\."), F.length))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    rest = F.substr(url, F.length(host) + F.lit(1), F.length(url))
    made = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "label_length": longest,
        "labels": F.when(host == "", 0).otherwise(_count(host, ".") + 1),
        "hyphens": _count(host, "-"),
        "depth": _count(path, "/"),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "digit_share": F.round(digits / F.greatest(F.length(url), F.lit(1)), 9),
        "host_entropy": _entropy(host),
        "rest_entropy": _entropy(rest),
    }
    return parts.select(
        *keep, "host", "path", suffix_of(host).alias("suffix"), *(c.cast("double").alias(k) for k, c in made.items())
    )


def _with_suffixes(features: DataFrame, model: Model) -> DataFrame:
    """The two suffix features from the model's table, whose size is bounded."""
    entries = [x for s, (share, count) in sorted(model.suffixes.items()) for x in (F.lit(s), F.struct(F.lit(share).alias("share"), F.lit(count).alias("count")))]
    found = F.element_at(F.create_map(*entries), F.col("suffix")) if entries else None
    share = F.coalesce(found["share"], F.lit(model.overall)) if entries else F.lit(model.overall)
    count = F.coalesce(found["count"], F.lit(0.0)) if entries else F.lit(0.0)
    return features.withColumns({"suffix_blocked": share, "suffix_count": count})


def _tree(tree: dict, at: int = 0) -> Column:
    node = tree[at]
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, threshold = node
    return F.when(F.col(name) <= F.lit(threshold), _tree(tree, 2 * at + 1)).otherwise(_tree(tree, 2 * at + 2))


def margin(model: Model) -> Column:
    return reduce(lambda a, t: a + _tree(t), model.trees, F.lit(model.base))


def _node(tree: dict, level: int, at: int = 0) -> Column:
    """The number of the node of this level a row stands in; null under a leaf."""
    if level == 0:
        return F.lit(at)
    node = tree.get(at)
    if not isinstance(node, tuple):
        return F.lit(None).cast("int")
    name, threshold = node
    return F.when(F.col(name) <= F.lit(threshold), _node(tree, level - 1, 2 * at + 1)).otherwise(_node(tree, level - 1, 2 * at + 2))


def _best_split(bins: dict[tuple[int, int], tuple[int, int]], cuts: list[list[float]]):
    """((feature, cut) with the greatest gain, or None, and (G, H) of the node)."""
    whole_g, whole_h = (sum(v[i] for (f, _), v in bins.items() if f == 0) for i in (0, 1))
    score = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    best, chosen = 1e-6, None
    for f, places in enumerate(cuts):
        g = h = 0
        for b, cut in enumerate(places):
            more = bins.get((f, b), (0, 0))
            g, h = g + more[0], h + more[1]
            if not h or h == whole_h:
                continue
            gain = score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h)
            if gain > best:
                best, chosen = gain, (FEATURES[f], cut)
    return chosen, (whole_g, whole_h)


def sample(labelled: DataFrame, per_class: int, by: Column) -> DataFrame:
    """Rows of column ``label`` 0 or 1: about ``per_class`` of each, whose hash falls under a share."""
    counts = {r.label: r["count"] for r in labelled.where("label in (0, 1)").groupBy("label").count().collect()}
    share = lambda k: min(1.0, per_class / max(counts.get(k, 0), 1))
    place = F.crc32(by.cast("string").cast("binary")) / float(1 << 32)
    return labelled.where((F.col("label") == 0) & (F.coalesce(place, F.lit(0.0)) < share(0)) | (F.col("label") == 1) & (F.coalesce(place, F.lit(0.0)) < share(1)))


def fit(
    urls: DataFrame,
    label: Column,
    spark: SparkSession,
    learn: Column | bool = True,
    per_class: int = PER_CLASS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> Model:
    """A model learned from the URLs whose ``label`` is 0 (allow) or 1 (block) and ``learn`` holds.

    ``label`` is a Column over ``host``, ``path`` and the id; ``learn`` one over the id.
    """
    urls = pick(urls, id_col, url_col)
    if learn is not True:
        urls = urls.where(learn)
    parts = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumn("label", label)
    chosen = sample(parts, per_class, F.concat_ws(" ", F.col(id_col).cast("string"), F.col(url_col)))
    rows = settle(lexical(chosen.drop("host", "path"), url_col, ("label",)), spark, "labelled")
    model = Model()
    counted = {r.suffix: (r.n, r.bad) for r in rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).where(F.col("n") >= SUFFIX_LEAST).collect()}
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        model.base = log(0.01)
        return model
    model.overall = round(bad / n, 9)
    model.base = log((bad + 0.5) / (n - bad + 0.5))
    if bad in (0, n):
        return model
    model.suffixes = {s: (round(b / k, 9), round(log(k), 9)) for s, (k, b) in counted.items()}
    ready = settle(_with_suffixes(rows, model).select("label", *FEATURES), spark, "features")
    steps = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    quantiles = ready.agg(*(F.percentile(c, steps).alias(c) for c in FEATURES)).first()
    top = ready.agg(*(F.max(c).alias(c) for c in FEATURES)).first()
    cuts = [sorted({q for q in quantiles[c] if q < top[c]}) for c in FEATURES]
    for c, places in zip(FEATURES, cuts):
        if not places and top[c] is not None:  # nearly all values are one: tell it from the others
            least = ready.agg(F.min(c)).first()[0]
            if least < top[c]:
                places.append(least)
    bins = F.array(*(F.struct(F.lit(f).alias("f"), reduce(lambda a, cut: a + (F.col(c) > F.lit(cut)).cast("int"), cuts[f], F.lit(0)).alias("b")) for f, c in enumerate(FEATURES)))
    for _ in range(TREES):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(model)))
        g = F.round((p - F.col("label")) * UNIT).cast("bigint")
        h = F.greatest(F.round(p * (F.lit(1.0) - p) * UNIT).cast("bigint"), F.lit(1))
        tree: dict = {}
        for level in range(DEPTH + 1):
            placed = ready.select(_node(tree, level).alias("node"), g.alias("g"), h.alias("h"), F.explode(bins).alias("e"))
            found = placed.where("node is not null").groupBy("node", "e").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            nodes: dict[int, dict] = {}
            for r in found.collect():
                nodes.setdefault(r.node, {})[r.e.f, r.e.b] = (r.g, r.h)
            for at, histogram in nodes.items():
                split, (total_g, total_h) = _best_split(histogram, cuts)
                tree[at] = split if split and level < DEPTH else round(-RATE * total_g / (total_h + RIDGE * UNIT), 12)
            if not any(isinstance(tree[at], tuple) for at in nodes):
                break
        model.trees.append(tree)
    return model


def judge(urls: DataFrame, model: Model, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per URL: the id, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (0 to 1, by the trees)."""
    features = _with_suffixes(lexical(pick(urls, id_col, url_col), url_col, (id_col,)), model)
    text, verdict = ruled(rules)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(model)))
    scored = features.select(id_col, "host", "path", text.alias("rule"), verdict.alias("said"), score.alias("score"))
    method = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")

