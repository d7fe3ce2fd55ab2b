"""URL filters: rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only.

The trees learn from labelled urls, here those that the rules decide. Fitting takes at most ``TRAIN`` of them, those with
the smallest hash of their url; features are cut into at most ``BINS`` bins at quantiles, equal binned rows are summed up
first, and each level of each tree is one aggregation of gradients by node, feature and bin. Only these sums, at most
``2**DEPTH`` * features * ``BINS`` rows, reach the driver, which picks the splits; trees are then CASE expressions over
the bins, so any number of urls is scored in one scan.

Defined cases: urls that are null or hold no ``://`` have an empty host and path, fit no rule and get the trees' verdict;
urls are used whole; suffixes and first path segments unseen in training get the overall share; if the labels hold one
class only, the trees answer that class, and ``allow`` without any label; equal rows get equal verdicts; other columns are left
alone; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import ascii_lower
from folioscope.sources.storage import materialise

#: (verdict, host and path prefix)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
TRAIN = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, SMOOTH = 16, 12, 3, 0.5, 1.0, 20.0
LEXICAL = ("url_length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "host_labels", "hyphens")
RATES = {"suffix_rate": "suffix", "segment_rate": "segment", "file_rate": "file_suffix"}
FEATURES = (*LEXICAL, *RATES)


def host_of(url):
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url):
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=None):
    """(rule, verdict) of the longest rule that fits, as a struct of nulls if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules or RULES, key=lambda r: len(r[1])):
        cut = rule.find("/")
        name, prefix = rule[:cut], rule[cut:]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (key, url) with host, path, the lexical features and the keys of the suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)

    def times(text, mark):
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")

    def information(share):
        return -share * F.log2(share)

    letters = F.array_distinct(F.split(url, ""))
    # characters are counted by what is left of the text without them
    shares = F.transform(letters, lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.when(size > 0, F.aggregate(F.filter(shares, lambda s: s > 0), F.lit(0.0), lambda total, s: total + information(s))).otherwise(0.0)
    placed = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return placed.withColumns({
        "url_length": size.cast("double"), "depth": times(F.col("path"), "/"),
        "digit_ratio": F.when(size > 0, (size - F.length(F.translate(url, "0123456789", ""))) / size).otherwise(0.0),
        "entropy": entropy, "parameters": times(url, "="), "host_length": F.length("host").cast("double"),
        "host_labels": times(F.col("host"), "."), "hyphens": times(url, "-"),
        "suffix": F.substring_index("host", ".", -1), "segment": F.regexp_extract("path", "^/([^/]*)", 1),
        "file_suffix": F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1),
    })


@dataclass
class Trees:
    """Cut points per feature, trees as nested (feature, bin, left, right) with numbers as leaves, and the statistics."""

    cuts: dict[str, list[float]]
    start: float
    share: float
    rates: dict[str, DataFrame]
    trees: list = field(default_factory=list)

    def binned(self, features: DataFrame) -> DataFrame:
        return features.select("*", *[_bin(F.col(f), self.cuts[f]).alias(f"bin_{f}") for f in FEATURES])

    def margin(self) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _walk(tree)
        return total

    def with_rates(self, placed: DataFrame) -> DataFrame:
        for name, key in RATES.items():
            placed = placed.join(self.rates[name], key, "left").withColumn(name, F.coalesce(name, F.lit(self.share)))
        return placed


def _bin(value, cuts: list[float]):
    total = F.lit(0)
    for cut in cuts:
        total = total + (value > cut).cast("int")
    return total


def _walk(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, cut, left, right = tree
    return F.when(F.col(f"bin_{feature}") <= cut, _walk(left)).otherwise(_walk(right))


def best_split(sums: dict, feature_order=FEATURES) -> tuple | None:
    """(feature, bin, left sums, right sums) of the highest gain; ``sums``: (feature, bin) -> (gradient, curvature).
    None if nothing is gained."""
    best, found = 1e-9, None
    for feature in feature_order:
        bins = sorted((b, gh) for (f, b), gh in sums.items() if f == feature)
        g, h = sum(x[1][0] for x in bins), sum(x[1][1] for x in bins)
        left_g = left_h = 0.0
        for b, (dg, dh) in bins[:-1]:
            left_g, left_h = left_g + dg, left_h + dh
            right_g, right_h = g - left_g, h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g**2 / (h + RIDGE)
            if gain > best + 1e-12:
                best, found = gain, (feature, b, (left_g, left_h), (right_g, right_h))
    return found


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, train: int = TRAIN) -> Trees:
    """Trees from ``labelled`` (url, blocked 0/1)."""
    import math

    sample = labelled.where("url is not null and blocked in (0, 1)").orderBy(F.xxhash64("url"), "url", "blocked").limit(train)
    placed = materialise(lexical(sample), "labelled-urls")
    n, blocked = placed.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    share = blocked / n if n else 0.0
    start = math.log(share / (1 - share)) if 0 < share < 1 else math.copysign(20.0, share - 0.5)
    rates = {}
    for name, key in RATES.items():
        rate = (F.sum("blocked") + SMOOTH * share) / (F.count("*") + SMOOTH)
        rates[name] = materialise(placed.groupBy(key).agg(rate.alias(name)), "rates")
    model = Trees({f: [] for f in FEATURES}, start, share, rates)
    if not 0 < share < 1:
        return model
    rows = model.with_rates(placed)
    steps = [i / BINS for i in range(1, BINS)]
    quantiles = rows.agg(*[F.percentile(f, F.lit(steps)).alias(f) for f in FEATURES]).first()
    model.cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}
    bins = [f"bin_{f}" for f in FEATURES]
    # at most ``train`` rows: one task sums them, level by level
    cells = materialise(model.binned(rows).groupBy(*bins).agg(F.count("*").alias("n"), F.sum("blocked").alias("hits")), "binned-urls").coalesce(1)
    for _ in range(trees):
        chance = 1 / (1 + F.exp(-model.margin()))
        told = cells.select(*bins, (chance * F.col("n") - F.col("hits")).alias("g"), (chance * (1 - chance) * F.col("n")).alias("h"))
        model.trees.append(_grow(told, depth))
    return model


def _grow(told: DataFrame, depth: int):
    """One tree, a level at a time: every level sums gradients by node, feature and bin."""
    splits: dict[int, tuple] = {}  # node -> (feature, bin); children of node k are 2k and 2k + 1
    leaves: dict[int, float] = {}

    def node() -> Column:
        def below(k):
            if k not in splits:
                return F.lit(k)
            feature, cut = splits[k]
            return F.when(F.col(f"bin_{feature}") <= cut, below(2 * k)).otherwise(below(2 * k + 1))

        return below(1)

    for _ in range(depth):
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])
        sums = told.select(node().alias("node"), "g", "h", F.explode(pairs).alias("p")).groupBy("node", "p.feature", "p.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by_node: dict[int, dict] = {}
        for r in sums:
            by_node.setdefault(r["node"], {})[r["feature"], r["bin"]] = (r["g"], r["h"])
        for k, found in by_node.items():
            split = best_split(found) if k not in splits and (k == 1 or k // 2 in splits) else None
            if split:
                splits[k] = split[:2]
                for child, (g, h) in zip((2 * k, 2 * k + 1), split[2:]):
                    leaves[child] = -RATE * g / (h + RIDGE)
    return _nested(1, splits, leaves)


def _nested(k: int, splits: dict, leaves: dict):
    return (*splits[k], _nested(2 * k, splits, leaves), _nested(2 * k + 1, splits, leaves)) if k in splits else leaves.get(k, 0.0)


def judge(pages: DataFrame, model: Trees, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block score of every row."""
    features = model.with_rates(lexical(pages.select("page_id", "url")))
    scored = model.binned(features).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    ruled = scored.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fits.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")


def rule_labels(pages: DataFrame, rules=None) -> DataFrame:
    """(url, blocked) of the urls that a rule decides."""
    fits = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("url", (fits["verdict"] == "block").cast("int").alias("blocked")).where("blocked is not null")
