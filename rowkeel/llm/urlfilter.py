"""URL filter with DataFrame functions only: allow and block rules, then a logistic regression.

Features are hashed character 3- and 4-grams of host and path. The model is fitted on a small labelled
URL table (its size is checked) by stochastic gradient steps folded over the table with aggregate()
in one row; only the weight vector, of fixed length, comes back. Scoring is a fold over each url's slots. Names that
the labels know nothing of are allowed, as most sites are harmless.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix); a rule fits its host and all subdomains.
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as host + path text, and its verdict; null without one. Equally long ones: by code point."""
    if not rules:
        none = F.lit(None).cast("string")
        return none, none
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def slots(host: Column, path: Column, width: int) -> Column:
    """Distinct hashed n-grams of host and path, in 1 to width. An n-gram has one slot wherever it stands, but one of its own in each part."""

    def hashed(tag: str, text: Column, n: int) -> Column:
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
        # One parameter: a second one would be the position.
        return F.transform(grams, lambda g: (F.pmod(F.xxhash64(F.lit(tag), g), F.lit(width)) + 1).cast("int"))

    ends = [(tag, F.concat(F.lit("^"), part, F.lit("$"))) for tag, part in (("h", host), ("p", path))]
    return F.array_distinct(F.concat(*[hashed(tag, text, n) for tag, text in ends for n in (3, 4)]))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train(labelled: DataFrame, *, width: int = 1 << 16, epochs: int = 12, rate: float = 0.6, decay: float = 1e-4, bias: float = 0.55, min_rows: int = 3, max_rows: int = 2000, max_cells: int = 1 << 24) -> list[float]:
    """Weights (width of them, then the bias) from labelled(url string, label int: 1 is block).

    Only slots that min_rows labelled urls use get a weight: n-grams that the labels hardly know count for neither side, and the
    bias, which the share of both labels sets, decides. `bias` is the constant that it multiplies: below 1, single steps move it less. Rows with a null url or label are left out. More than max_rows rows, or more than max_cells
    of rows times slots in use, raise ValueError. Without rows all weights are 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and label is not null").select("url", "label", slots(host, path, width).alias("s"))
    n = rows.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"the labelled table has more than {max_rows} rows")
    each = rows.select(F.explode("s").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    used = sorted(r.slot for r in each.limit(max_cells // max(1, n) + 1).collect())
    if n * len(used) > max_cells:
        raise ValueError(f"the labelled table takes more than {max_cells} cells")
    # Dense rows over the slots in use, in an order that only the urls decide.
    unit = 1 / F.sqrt(F.greatest(F.size("s"), F.lit(1)).cast("double"))
    seen = F.split(F.lit(",".join(map(str, used))), ",").cast("array<int>") if used else F.array().cast("array<int>")
    x = F.concat(F.transform(seen, lambda i: F.when(F.array_contains(F.col("s"), i), unit).otherwise(F.lit(0.0))), F.array(F.lit(bias)))
    dense = rows.select(F.xxhash64("url").alias("h"), "url", "label", F.col("label").cast("double").alias("y"), x.alias("x"))
    table = dense.agg(F.sort_array(F.collect_list(F.struct("h", "url", "y", "x"))).alias("rows"))

    def step(w: Column, row: Column) -> Column:
        miss = F.array(row["y"] - _sigmoid(F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
        return F.element_at(F.transform(miss, lambda e: F.zip_with(w, row["x"], lambda a, b: a * (1 - rate * decay) + rate * e * b)), 1)

    again = F.flatten(F.array_repeat(F.col("rows"), epochs))
    found = table.select(F.aggregate(again, F.array_repeat(F.lit(0.0), len(used) + 1), step).alias("w")).first().w
    weights = [0.0] * width + [found[-1] * bias]
    for slot, w in zip(used, found):
        weights[slot - 1] = w
    return weights


def block_score(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """Probability that the url is to be blocked."""
    width = len(weights) - 1
    # One text literal, folded to an array once: a literal for each weight would bloat the plan.
    w = F.split(F.lit(",".join(repr(x) if x else "0" for x in weights)), ",").cast("array<double>")
    own = slots(host, path, width)
    return _sigmoid(F.lit(float(weights[-1])) + F.aggregate(own, F.lit(0.0), lambda s, i: s + F.get(w, i - 1)) / F.sqrt(F.greatest(F.size(own), F.lit(1)).cast("double")))


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule], *, threshold: float = 0.5, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages(page_id, url).

    The rule's verdict stands; else the model's: block from `threshold` on. Null and malformed urls have an
    empty host and path and get a verdict from those. Urls are read whole; an empty table gives no rows.
    """
    weights = train(labelled, **options)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    scored = rows.withColumn("rule", rule).withColumn("_said", said).withColumn("score", block_score(F.col("host"), F.col("path"), weights))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
