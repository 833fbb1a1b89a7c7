"""URL filter: rules first, then a likelihood ratio of two character language models.

Method. Two variable-order Markov models, one of accepted and one of rejected URLs, are counted over the
characters of host and path and an end mark. The probability of a character interpolates all context lengths up to
``ORDER - 1``, p_o = (n(context, c) + s p_(o-1)) / (n(context) + s), so a context that was never seen
leaves the shorter one's estimate. A URL is rejected if its log-likelihood difference a character is above a
threshold that weighs the two error rates on a calibration fold (a fifth of the URLs, by their hash): a wrongly
rejected URL counts ``CAUTION`` times as much as a wrongly accepted one. ``evaluate`` measures both rates with a fold of whole hosts, which the
counts have not seen.

Rejected URLs are those whose host has one of the ``seeds`` while no rule allows it; accepted ones those that a rule allows, or that none blocks.
A rule blocks a place, whatever its characters, so what it blocks teaches neither model, and no URL that a rule decides gets a verdict from them. The counts are a table keyed by the very characters, which grows with the input and stays on the
executors. The threshold is set with the counts of the other four fifths; then the counts of all URLs score every
URL. Both kinds of counts are columns of one table, and URLs meet it in a join that spreads hot grams. If a class has
no URL, nothing more is blocked.

A null URL, or one without ``://``, has an empty host and path: no rule fits it and it is allowed. Equal URLs are judged alike; each row is
returned. A URL of any length is read whole. An empty table gives no row. Ids keep their type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.batches import blocks, strings, table
from viaduct.llm.skew import split_join
from viaduct.session import materialize

ORDER, SMOOTH, BINS, CAUTION = 5, 4.0, 2001, 10.0
#: Differences are summed as integers, so a score does not depend on the order of the sum.
UNIT = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEEDS = ("spam", "casino", "pills", "porn", "viagra", "lottery")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; a rule is ``host/path`` and fits the host, its subdomains and longer paths."""
    fits = []
    for rule in sorted(rules, key=len, reverse=True):
        own, slash, start = rule.partition("/")
        fits.append(F.when(((host == own) | host.endswith("." + own)) & path.startswith(slash + start), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``ORDER`` bytes up to each position of ``text 0x03``, with 0x02 before the text, and each text's positions; none of empty texts."""
    sizes = np.diff(at) + (np.diff(at) > 0)
    starts = np.cumsum(sizes) - sizes
    some = sizes > 0
    whole = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(whole), bool)
    inner[(starts + sizes)[some] - 1] = False
    whole[inner] = data
    whole[~inner] = 3
    room = np.arange(len(whole)) - np.repeat(starts, sizes)
    code = np.zeros(len(whole), np.int64)
    for o in range(ORDER):
        shifted = np.zeros_like(whole)
        shifted[o:] = whole[: max(len(whole) - o, 0)]
        code |= np.where(room >= o, shifted, 2) << 8 * o
    return code, sizes


def positions(urls: DataFrame, fold: str = "s") -> DataFrame:
    """``id, kind, code`` of every character of ``s``; ``kind`` is twice the label and 1 more in the calibration fold, a fifth by the hash of ``fold``."""
    schema = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("code", pa.int64())])

    def cut(batches):
        for batch in blocks(batches, "s", 1 << 20):
            code, sizes = grams(*strings(batch.column("s")))
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield table(schema, batch.column("id").take(row), batch.column("kind").take(row), code)

    kind = (2 * F.col("label") + (F.pmod(F.xxhash64(fold), F.lit(5)) == 0).cast("int")).cast("int")
    return urls.select("id", kind.alias("kind"), "s").mapInArrow(cut, "id bigint, kind int, code bigint")


SETS = ("fit0", "fit1", "all0", "all1")


def differences(places: DataFrame) -> tuple[DataFrame, tuple]:
    """``code, n, fit, all``: the log-likelihood difference, rejected minus accepted, in ``UNIT``, of each code by the counts
    without the calibration fold and by all counts; and the characters of each of ``SETS``."""
    count = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    counts = places.groupBy("code").agg(F.count("*").alias("n"), count(0).alias("fit0"), count(2).alias("fit1"), count(0, 1).alias("all0"), count(2, 3).alias("all1"))
    counts = materialize(counts, "url-grams")
    number, *totals = counts.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in SETS]).first()
    found = counts.select("code", "n", *[F.lit(1 / 256).alias(f"p_{c}") for c in SETS], *SETS)
    for o in range(ORDER):
        # the last o + 1 characters, and the o ones before the last
        for name, key, size in (("gram", F.col("code"), o + 1), ("context", F.shiftright("code", 8), o)):
            key = key.bitwiseAND(F.lit((1 << 8 * size) - 1))
            if size == 0:
                found = found.select("*", *[F.lit(total).alias(f"{name}_{c}") for c, total in zip(SETS, totals, strict=True)])
            elif size == ORDER:
                found = found.select("*", *[F.col(c).alias(f"{name}_{c}") for c in SETS])
            else:
                sums = counts.groupBy(key.alias("key")).agg(F.count("*").alias("members"), *[F.sum(c).alias(f"{name}_{c}") for c in SETS])
                found = split_join(found.withColumn("key", key), sums, ["key"], "members", number).drop("key", "members")
        better = [((F.col(f"gram_{c}") + SMOOTH * F.col(f"p_{c}")) / (F.col(f"context_{c}") + SMOOTH)).alias(f"p_{c}") for c in SETS]
        found = materialize(found.select("code", "n", *better, *SETS), "url-models")
    diff = [F.round((F.log(f"p_{c}1") - F.log(f"p_{c}0")) / UNIT).cast("bigint").alias(c) for c in ("fit", "all")]
    return found.select("code", "n", *diff), tuple(totals)


def _bins(calibration: DataFrame) -> np.ndarray:
    """How many scores of each label fall into each hundredth."""
    bins = np.zeros((2, BINS))
    at = F.least(F.greatest(F.floor(F.col("score") / 0.01 + BINS // 2), F.lit(0)), F.lit(BINS - 1)).cast("int")
    for label, place, n in calibration.groupBy("label", at.alias("place")).count().collect():  # at most 2 * BINS rows
        bins[label, place] = n
    return bins


def error_rates(calibration: DataFrame, threshold: float) -> tuple[float, float]:
    """The shares of accepted URLs above the threshold and of rejected ones up to it, of ``label, score``."""
    wrong = calibration.groupBy("label").agg(F.avg((F.col("score") > threshold).cast("double")).alias("above"))
    above = dict(wrong.collect())  # two rows
    return above.get(0, 0.0), 1 - above.get(1, 1.0)


def threshold_of(calibration: DataFrame) -> float:
    """The threshold that weighs both errors best, from ``label, score``."""
    accepted, rejected = _bins(calibration)
    if not (accepted.sum() and rejected.sum()):
        return 0.0
    # above bin b is rejected: the accepted above it and the rejected up to it, each as a share
    errors = CAUTION * (1 - np.cumsum(accepted) / accepted.sum()) + np.cumsum(rejected) / rejected.sum()
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return (float(best[len(best) // 2]) - BINS // 2 + 1) * 0.01


def _scored(pages: DataFrame, rules: dict[str, str], id_col: str, url_col: str, seeds: tuple[str, ...], fold: str = "s") -> tuple[DataFrame, DataFrame, float]:
    """The URLs, their scores ``id, kind, fit, score`` and the threshold."""
    host, path = host_and_path(F.col("u"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("s", F.concat("host", "path"))
    decided = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule")) if rules else F.lit(None).cast("string")
    seeded = F.col("host").rlike("|".join(seeds)) if seeds else F.lit(False)
    urls = urls.withColumn("ruled", decided).withColumn("label", F.when(F.length("s") == 0, None).when(F.col("ruled") == "allow", 0).when(seeded, 1).when(F.col("ruled").isNull(), 0))
    urls = materialize(urls.select("page_id", "host", "path", "rule", "ruled", F.col("label").cast("int").alias("label"), "s", F.monotonically_increasing_id().alias("id")), "urls")
    places = positions(urls, fold)
    diffs, totals = differences(places)
    diffs = materialize(diffs, "url-differences")
    number = diffs.agg(F.sum("n")).first()[0] or 0
    mean = lambda c: F.sum(c) * UNIT / F.count("*")
    scored = split_join(places, diffs, ["code"], "n", number).groupBy("id").agg(F.first("kind").alias("kind"), mean("fit").alias("fit"), mean("all").alias("score"))
    scored = materialize(scored, "url-scores")
    threshold = math.inf
    if totals[0] and totals[1]:
        threshold = threshold_of(scored.where("kind in (1, 3)").select(F.shiftright("kind", 1).alias("label"), F.col("fit").alias("score")))
    return urls, scored, threshold


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every URL; ``rules`` maps ``host/path`` to allow or block."""
    urls, scored, threshold = _scored(pages, rules, id_col, url_col, seeds)
    found = urls.join(scored.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when((F.col("score") > threshold) & (F.length("s") > 0), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def evaluate(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", seeds: tuple[str, ...] = SEEDS) -> tuple[float, float]:
    """The error rates on hosts that were not counted: wrongly rejected, wrongly accepted."""
    _, scored, threshold = _scored(pages, rules, id_col, url_col, seeds, "host")
    return error_rates(scored.where("kind in (1, 3)").select(F.shiftright("kind", 1).alias("label"), F.col("fit").alias("score")), threshold)
