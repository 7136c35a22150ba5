"""URL filter: rules first, then a ratio of character language models.

Rules (host and path prefix) settle the URLs they fit.  Those URLs also train two variable-order Markov models of
characters, one of accepted and one of rejected URLs, on host and path.  A character's probability
given up to ``ORDER`` - 1 characters before it mixes all orders by Witten-Bell smoothing.  A URL's score is the mean
over its characters of the log of accepted by rejected probability; it is calibrated on rule-settled URLs that the
models did not see (balanced classes, equal spread), and the sign of the calibrated score is the verdict.

All of it is DataFrame operations.  Counts are summed before the shuffle; the mixing of orders is worked out once for each distinct
stretch of ``ORDER`` characters, not for each occurrence.  Distinct texts are scored once.

Defined cases: null urls, and urls without ``://``, have empty host and path and are judged on the empty text; rules are judged by
the total length of host and path, the longer host first on a tie; with URLs of only one kind the verdict is that of the kind, with
none it is allow; repeated rows are judged alike; an empty table gives an empty result; other columns pass unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

ORDER = 5
FLOOR = 1 / 256  # chance of a character never seen
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    at = F.coalesce(F.locate("://", F.col(url)), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else null; a short list of rules becomes one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        name, verdict = F.when(fits, own + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def stretches(text: str) -> Column:
    """Every character with up to ``ORDER`` - 1 before it; the text is padded, so all have ``ORDER`` characters."""
    padded = F.concat(F.lit("\u0002" * (ORDER - 1)), F.col(text), F.lit("\u0003"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - ORDER + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def suffixes(stretch: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda n: F.substring(F.col(stretch), F.lit(ORDER + 1) - n, n))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` (chance of being acceptable) and ``verdict``."""
    host, path = url_parts()
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict", "_settled", "_text")]
    rows = pages.select(*names, host.alias("host"), path.alias("path"))
    rule, settled = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("_settled", settled).withColumn("_text", F.concat("host", "path"))
    # A third of a sixteenth of the distinct texts calibrate, by the first hexadecimal digit of a hash.
    texts = cut_lineage(rows.groupBy("_text").agg(F.max("_settled").alias("settled"), F.count("*").alias("n"))
                        .withColumn("unseen", F.md5(F.col("_text")) < "3"))
    placed = cut_lineage(texts.select("_text", "settled", "unseen", F.explode(stretches("_text")).alias("stretch"))
                         .groupBy("_text", "stretch").agg(F.count("*").alias("times"), F.max("settled").alias("settled"), F.max("unseen").alias("unseen")))
    counted = placed.groupBy("stretch").agg(*[
        F.sum(F.when((F.col("settled") == kind) & ~F.col("unseen"), F.col("times")).otherwise(0)).alias(f"{kind}_n") for kind in ("allow", "block")])
    counted = cut_lineage(counted)
    grams = cut_lineage(counted.select(F.explode(suffixes("stretch")).alias("gram"), "allow_n", "block_n").groupBy("gram").agg(
        F.sum("allow_n").alias("allow_n"), F.sum("block_n").alias("block_n")).filter("allow_n + block_n > 0"))
    # Of each context: characters seen after it, and how many different ones.
    contexts = grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), F.length("gram").alias("depth")).agg(*[
        c for kind in ("allow", "block") for c in (F.sum(f"{kind}_n").alias(f"{kind}_all"), F.sum((F.col(f"{kind}_n") > 0).cast("long")).alias(f"{kind}_kinds"))])
    asked = counted.select("stretch", F.explode(suffixes("stretch")).alias("gram")).withColumn("depth", F.length("gram")).withColumn(
        "context", F.expr("substring(gram, 1, length(gram) - 1)"))
    needed = asked.select("gram", "context", "depth").distinct()
    facts = needed.join(grams, "gram", "left").join(contexts, ["context", "depth"], "left")
    fields = [f"{kind}_{what}" for kind in ("allow", "block") for what in ("n", "all", "kinds")]
    facts = facts.select("gram", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in fields])
    steps = asked.select("stretch", "gram", "depth").join(facts, "gram").groupBy("stretch").agg(
        F.array_sort(F.collect_list(F.struct("depth", *fields))).alias("steps"))

    def chance(kind: str) -> Column:
        def mixed(before: Column, step: Column) -> Column:
            total = step[f"{kind}_all"] + step[f"{kind}_kinds"]
            return F.when(total > 0, (step[f"{kind}_n"] + step[f"{kind}_kinds"] * before) / total).otherwise(before)

        return F.aggregate("steps", F.lit(FLOOR).cast("double"), mixed)

    # Written, so that the join below has a plain shuffle on each side and a frequent stretch can be split.
    ratios = cut_lineage(steps.select("stretch", (F.log(chance("allow")) - F.log(chance("block"))).alias("ratio")))
    scores = cut_lineage(placed.join(ratios, "stretch").groupBy("_text").agg(
        (F.sum(F.col("times") * F.col("ratio")) / F.sum("times")).alias("raw"), F.max("settled").alias("settled"), F.max("unseen").alias("unseen")))
    seen = scores.groupBy("settled", "unseen").agg(F.count("*").alias("n"), F.avg("raw").alias("mean"), F.coalesce(F.var_pop("raw"), F.lit(0.0)).alias("var")).collect()
    slope, middle = calibrate({(r.settled, r.unseen): (r.n, r["mean"], r["var"]) for r in seen})
    known = scores.select("_text", (1 / (1 + F.exp(-F.lit(slope) * (F.col("raw") - F.lit(middle))))).alias("score"))
    judged = rows.join(known, "_text", "left")
    verdict = F.coalesce("_settled", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return judged.select(*names, "host", "path", "rule", "score", verdict.alias("verdict"))


def calibrate(seen: dict) -> tuple[float, float]:
    """Slope and middle of the curve from counts, means and variances of both kinds, on unseen texts where there are any."""
    sides = [seen.get((kind, True)) or seen.get((kind, False)) for kind in ("allow", "block")]
    if None in sides:  # of one kind, or none: no middle to find
        return (0.0, 0.0) if sides[1] is None else (1.0, 1e9)
    (n, good, a), (m, bad, b) = sides
    spread = max((n * a + m * b) / (n + m), 1e-9)
    return max((good - bad) / spread, 1e-9), (good + bad) / 2


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
