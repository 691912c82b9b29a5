"""URL filters: host rules, and for other URLs the likelihood ratio of two character models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down, scope
from wardline.plans.ranking import cumulative_within, rank_within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Marks the ends of a URL in the models.
START, END = "\x02", "\x03"

#: Characters of context.
ORDER = 5

#: URLs that are scored together, with the slice of the models that they need.
BLOCK = 1024

#: One URL in so many calibrates the threshold instead of training a model.
CALIBRATES = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits.

    A rule is (``host/path``, verdict).  It fits its host and all subdomains, if the path starts with the rule's.
    """
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(F.lit(None) if rule is None else rule)
        verdict = F.when(fits, F.lit(what)).otherwise(F.lit(None) if verdict is None else verdict)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.cast("string"), verdict.cast("string"))


class CharModel:
    """Variable-order Markov model of characters with Witten-Bell smoothing.

    The probability after a context mixes its own counts with the probability after the context one character shorter,
    down to a uniform one; the longer a context was seen with few followers, the more it counts.  This one is held in
    memory, for lists of URLs; :func:`fit` makes the same probabilities as a table.
    """

    def __init__(self, urls: Sequence[str], order: int, alphabet: int):
        counts: list[dict] = [{} for _ in range(order + 1)]
        for url in urls:
            text = START + url + END
            for i in range(1, len(text)):
                for k in range(min(order, i) + 1):
                    followers = counts[k].setdefault(text[i - k : i], {})
                    followers[text[i]] = followers.get(text[i], 0) + 1
        # seen (context + character): its probability; context: weight of what is shorter
        self.order, self.floor = order, 1 / alphabet
        self.seen: dict[str, float] = {}
        self.shorter: dict[str, float] = {}
        for k in range(order + 1):
            for context, followers in counts[k].items():
                total = sum(followers.values()) + len(followers)
                self.shorter[context] = rest = len(followers) / total
                for c, n in followers.items():
                    below = (self.seen[context[1:] + c] if k else self.floor)
                    self.seen[context + c] = n / total + rest * below

    def log_likelihood(self, url: str) -> float:
        text, total = START + url + END, 0.0
        for i in range(1, len(text)):
            weight = 1.0
            for k in range(min(self.order, i), -1, -1):
                p = self.seen.get(text[i - k : i + 1])
                if p is not None:
                    break
                weight *= self.shorter.get(text[i - k : i], 1.0)
            total += math.log(weight * (self.floor if p is None else p))
        return total


@dataclass
class UrlModel:
    """Models of accepted and rejected URLs and the calibrated threshold of their ratio; None where a side was empty."""

    accepted: CharModel | None
    rejected: CharModel | None
    threshold: float = 0.0

    def ratio(self, url: str) -> float:
        """Log-likelihood difference per character, above zero if accepted fits better."""
        if not url or self.accepted is None or self.rejected is None:
            return 0.0
        return (self.accepted.log_likelihood(url) - self.rejected.log_likelihood(url)) / (len(url) + 1)


def calibrate(scores: Sequence[tuple[float, bool]]) -> float:
    """The threshold with the least sum of error rates on (ratio, accepted) pairs, in the middle of its gap."""
    goods = sum(ok for _, ok in scores)
    bads = len(scores) - goods
    if not goods or not bads:
        return 0.0
    ordered = sorted(scores)
    best, threshold = float("inf"), 0.0
    below_good = below_bad = 0
    for i in range(len(ordered) + 1):
        at_edge = i == 0 or i == len(ordered) or ordered[i][0] > ordered[i - 1][0]
        error = below_good / goods + (bads - below_bad) / bads
        if at_edge and error < best:
            low, high = ordered[max(i - 1, 0)][0], ordered[min(i, len(ordered) - 1)][0]
            best, threshold = error, (low + high) / 2
        if i < len(ordered):
            below_good += ordered[i][1]
            below_bad += not ordered[i][1]
    return threshold


def calibrate_table(scores: DataFrame) -> float:
    """:func:`calibrate` for a table of ``ratio, accepted`` of any size; errors are compared in whole numbers."""
    goods, bads = scores.agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    if not goods or not bads:
        return 0.0
    steps = scores.groupBy("ratio").agg(F.sum(F.when(F.col("accepted"), F.lit(bads)).otherwise(F.lit(-goods))).alias("weight"))
    placed = cumulative_within(steps, [], ["ratio"], "weight")
    best = placed.agg(F.min(F.struct((F.col("upto") - F.col("weight")).alias("below"), "ratio"))).first()[0]["ratio"]
    below = scores.where(F.col("ratio") < best).agg(F.max("ratio")).first()[0]
    return (best + (best if below is None else below)) / 2


def _windows(url: str, order: int) -> list[str]:
    """Each character of a URL and its end, behind as much context as there is."""
    text = START + url + END
    return [text[max(i - order, 0) : i + 1] for i in range(1, len(text))]


def _counted(urls: DataFrame, order: int) -> DataFrame:
    """``block, window, good, bad, labelled``: the windows of each block and how often they stand in training URLs.

    ``urls`` has ``block, url, accepted, trains``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, str], list] = {}
            for block, url, accepted, trains in zip(*(c.to_pylist() for c in batch.columns)):
                for window in _windows(url, order):
                    row = found.setdefault((block, window), [0, 0, False])
                    row[0] += trains and accepted
                    row[1] += trains and not accepted
                    row[2] |= accepted is not None
            blocks, windows = ([k[i] for k in found] for i in (0, 1))
            good, bad, labelled = ([v[i] for v in found.values()] for i in (0, 1, 2))
            columns = [pa.array(blocks, pa.int64()), pa.array(windows, pa.string()), pa.array(good, pa.int64()), pa.array(bad, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labelled, pa.bool_())], ["block", "window", "good", "bad", "labelled"])

    return urls.select("block", "url", "accepted", "trains").mapInArrow(run, "block long, window string, good long, bad long, labelled boolean")


def fit(counted: DataFrame, order: int = ORDER) -> DataFrame | None:
    """``window, step``: log-likelihood difference of a window's last character, for every window of :func:`_counted`.

    The two models are those of :class:`CharModel` on all training URLs.  Their counts are one row for each string of up
    to ``order`` + 1 characters, and every length takes its probabilities from the length below by a join on the string
    without its first character.  None if a class has no training URL.
    """
    whole = counted.groupBy("window").agg(*(F.sum(c).alias(c) for c in ("good", "bad")), F.max("labelled").alias("labelled"))
    parts = whole.select("*", F.explode(F.sequence(F.lit(1), F.length("window"))).alias("size"))
    parts = parts.select("size", F.expr("right(window, size)").alias("gram"), "good", "bad", "labelled")
    grams = parts.groupBy("size", "gram").agg(*(F.sum(c).alias(c) for c in ("good", "bad")), F.max("labelled").alias("labelled"))
    followers = Window.partitionBy("size", F.expr("left(gram, size - 1)"))
    shares = []
    for c in ("good", "bad"):
        kinds = F.sum((F.col(c) > 0).cast("long")).over(followers)
        total = F.sum(c).over(followers) + kinds
        shares += [F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)).alias(c), F.coalesce(F.try_divide(kinds, total), F.lit(1.0)).alias(f"{c}_rest")]
    grams = put_down(grams.select("size", "gram", "labelled", *shares), "url-grams")
    known = grams.where("size = 1").agg(F.count_if(F.col("labelled") & (F.col("gram") != END)), F.max("good"), F.max("bad")).first()
    if not known[1] or not known[2]:
        return None
    floor = 1 / (known[0] + 2)
    below, steps = None, None
    for size in range(1, order + 2):
        level = grams.where(F.col("size") == size).select("gram", "good", "bad", "good_rest", "bad_rest")
        if below is None:
            level = level.withColumns({"p_good": F.lit(floor), "p_bad": F.lit(floor)})
        else:
            shorter = below.select(F.col("gram").alias("shorter"), F.col("good").alias("p_good"), F.col("bad").alias("p_bad"))
            level = level.join(shorter, F.expr(f"right(gram, {size - 1})") == F.col("shorter"))
        mixed = ((F.col(c) + F.col(f"{c}_rest") * F.col(f"p_{c}")).alias(c) for c in ("good", "bad"))
        below = put_down(level.select("gram", *mixed), "url-steps")
        ends = below if size > order else below.where(F.col("gram").startswith(START))
        ends = ends.select(F.col("gram").alias("window"), (F.log("good") - F.log("bad")).alias("step"))
        steps = ends if steps is None else steps.union(ends)
    return steps


def _ratios(urls: DataFrame, counted: DataFrame, steps: DataFrame, order: int) -> DataFrame:
    """``url, accepted, trains, ratio`` for ``urls``: each block meets the steps of its own windows."""
    slices = counted.select("block", "window").distinct().join(steps, "window").select("block", "window", "step")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        step = dict(zip(right["window"].to_pylist(), right["step"].to_pylist()))
        ratios = []
        for url in left["url"].to_pylist():
            ratios.append(sum(step[w] for w in _windows(url, order)) / (len(url) + 1))
        return left.select(["url", "accepted", "trains"]).append_column("ratio", pa.array(ratios, pa.float64()))

    parts = _parallel(urls)
    both = (df.repartition(parts, "block").groupBy("block") for df in (urls, slices))
    return next(both).cogroup(next(both)).applyInArrow(run, "url string, accepted boolean, trains boolean, ratio double")


def _parallel(df: DataFrame) -> int:
    """Tasks for Python work whose rows are few bytes, so that size alone would put it into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def learn(ruled: DataFrame, order: int = ORDER) -> tuple[DataFrame, float] | None:
    """(``url, ratio`` of every different URL, threshold) for ``ruled`` of ``url`` and a verdict or null in ``ruled``.

    All URLs with a verdict are used: every fifth of a class, in the order of a hash, calibrates the threshold, the others
    train the models.  None if a class has no URL.
    """
    with scope():
        urls = ruled.where(F.col("url") != "").select("url", (F.col("ruled") == "allow").alias("accepted"))
        urls = put_down(urls.dropDuplicates(["url"]), "urls-told")
        told = urls.where("accepted is not null").withColumn("hash", F.xxhash64("url"))
        told = rank_within(told, ["accepted"], ["hash", "url"]).select("url", "accepted", ((F.col("rank0") + 1) % CALIBRATES != 0).alias("trains"))
        urls = told.union(urls.where("accepted is null").select("url", "accepted", F.lit(False))).repartition(_parallel(ruled), "url")
        urls = put_down(urls.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)), "urls")
        counted = put_down(_counted(urls, order), "url-windows")
        steps = fit(counted, order)
        if steps is None:
            return None
        scores = put_down(_ratios(urls, counted, steps, order), "url-ratios", kept=True)
    return scores.select("url", "ratio"), calibrate_table(scores.where("accepted is not null and not trains"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio, by`` for every row of ``pages``.

    The longest fitting rule decides.  Other URLs are allowed if their ratio is at or above the model's threshold.
    Without a model, one is fitted on all URLs that rules decide.  ``ratio`` is given for all; ``by`` is rule or model.

    Null and empty URLs have ratio 0 and are allowed if no rule fits, and so are all URLs that no rule fits if rules
    leave a class without examples.  Rows are judged by URL alone, so ids may be null or repeat.  Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = cut.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if model is not None:
        usable, threshold = model.accepted is not None and model.rejected is not None, model.threshold
        rated = _rated(ruled, model)
    else:
        learned = learn(ruled)
        usable, threshold = learned is not None, learned[1] if learned else 0.0
        if learned:
            rated = ruled.join(learned[0].withColumnRenamed("url", "of"), F.col("url") == F.col("of"), "left")
        else:
            rated = ruled.withColumn("ratio", F.lit(0.0))
    ratio = F.coalesce("ratio", F.lit(0.0))
    fits = F.col("url").isNull() | (F.col("url") == "") | F.lit(not usable) | (ratio >= threshold)
    verdict = F.coalesce("ruled", F.when(fits, "allow").otherwise("block"))
    by = F.when(F.col("rule").isNull(), "model").otherwise("rule")
    return rated.select("page_id", "host", "path", "rule", verdict.alias("verdict"), ratio.alias("ratio"), by.alias("by"))


def _rated(ruled: DataFrame, model: UrlModel) -> DataFrame:
    """``ruled`` with the ``ratio`` by a model in memory."""
    shared = ruled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = pa.array([shared.value.ratio(u.as_py() or "") for u in batch.column("url")], pa.float64())
            yield batch.append_column("ratio", ratios)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ruled.schema)
    return ruled.mapInArrow(run, f"{schema}, ratio double")
