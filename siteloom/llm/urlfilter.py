"""URL filtering: rules of hosts and paths, and boosted trees for the rest.

The trees judge lexical features of a URL - its length, depth, share of digits,
entropy, number of parameters, and how often labelled URLs of its suffix were
blocked.  They are trained from labelled URLs.  Without such labels
(``weak_labels``), those that the rules decide serve, and of the others those
whose host holds a word that names spam are blocked, the rest allowed.

A suffix's rate never comes from the row's own label: labelled hosts are dealt
into ``FOLDS`` folds, and a row that trains the trees sees the rate of the
other folds.  Half of the sample is blocked and half allowed where there are
enough of both; a URL that repeats enters it once.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule, and is judged by the trees like any other; the longest of the
rules that fit decides, of equals the first by text; with labels of one kind
only, that is the verdict; with none, ``allow``; rows that repeat give equal
rows; URLs of any length are read whole; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_limit

#: (verdict, host and path)
Rule = tuple[str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: About so many labelled URLs train the trees; a suffix's rate leans on so many others.
SAMPLE, LEAN, FOLDS = 20_000, 20.0, 5
TREES, DEPTH, SEED = 12, 4, 7
#: Words of hosts that label a URL as spam where nothing else labels it.
SPAM_WORDS = ("adult", "bets", "casino", "escort", "gambl", "jackpot", "loans", "lottery", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")

FEATURES = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy",
    "n_params", "query_length", "upper_ratio", "escapes", "suffix_rate", "suffix_known",
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does.

    Rules are a short list that people keep; each is one branch.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        name = name.lower()
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: Column) -> Column:
    """Bits a character, over the text's code points."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    found = F.split(text, "")
    each = F.array_distinct(found)
    share = lambda c: F.size(F.filter(found, lambda x: x == c)) / n
    return F.when(F.length(text) == 0, 0.0).otherwise(
        F.aggregate(F.array_sort(each), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    )


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path, rate) and the columns of ``FEATURES``."""
    url = F.coalesce("url", F.lit(""))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    plain = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": _count(F.col("path"), "/"),
        "host_labels": F.size(F.split("host", r"\.")),
        "digit_ratio": _count(url, "[0-9]") / length,
        "hyphens": _count(F.col("host"), "-"),
        "entropy": entropy(F.col("host")),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "query_length": F.length(query),
        "upper_ratio": _count(url, "[A-Z]") / length,
        "escapes": _count(url, "%"),
        "suffix_known": F.col("rate").isNotNull(),
        "suffix_rate": F.coalesce("rate", F.lit(0.5)),
    }
    return urls.withColumns({k: v.cast("double") for k, v in plain.items()})


def weak_labels(rows: DataFrame) -> DataFrame:
    """url, host, path, block of rows (with said): the rules' verdict, else by words of the host."""
    spam = F.col("host").rlike("|".join(SPAM_WORDS))
    return rows.select("url", "host", "path", F.coalesce(F.col("said") == "block", spam).cast("double").alias("block"))


def suffix_rates(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suffix, rate) from all labelled rows, and (suffix, fold, rate) without those of a fold."""
    lean = lambda bad, n: (bad + LEAN / 2) / (n + LEAN)
    by = known.groupBy("suffix", "fold").agg(F.sum("block").alias("bad"), F.count("*").alias("n"))
    whole = by.groupBy("suffix").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    others = by.join(whole, "suffix").select(
        "suffix", "fold", F.when(F.col("all_n") > F.col("n"), lean(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n"))).alias("rate")
    )
    return whole.select("suffix", lean(F.col("all_bad"), F.col("all_n")).alias("rate")), others


def sampled(known: DataFrame, counts: dict[float, int], sample: int) -> DataFrame:
    """About ``sample`` distinct URLs, half of either label, with ``weight``s that make both count as much."""
    half = max(sample // 2, 1)
    limit = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, sample_limit(half, n))])
    expected = {label: min(n, half) for label, n in counts.items()}
    weight = F.create_map(*[F.lit(x) for label, n in expected.items() for x in (label, sum(expected.values()) / (2.0 * max(n, 1)))])
    near = known.where(F.xxhash64("url", "block") <= limit[F.col("block")])
    return near.dropDuplicates(["url", "block"]).withColumn("weight", weight[F.col("block")])


def judge(
    pages: DataFrame,
    rules: list[Rule],
    labelled: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    sample: int = SAMPLE,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the
    trees' probability of ``block``).  ``labelled`` has ``url`` and ``block`` (0, 1)."""
    host, path = host_of(pages[url]), path_of(pages[url])
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("said", verdict).withColumn("suffix", suffix_of(F.col("host")))
    if labelled is None:
        known = weak_labels(rows)
    else:
        known = labelled.select(
            "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("block").cast("double")
        )
    known = known.where("block is not null").withColumn("suffix", suffix_of(F.col("host")))
    known = known.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    counts = {r["block"]: r["n"] for r in known.groupBy("block").agg(F.approx_count_distinct("url").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        sure = "block" if 1.0 in counts else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(sure)).alias("verdict"), F.lit(float(sure == "block")).alias("score"))
    # a rate for each suffix: Spark broadcasts it where it is small
    rates, others = suffix_rates(known)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learned = with_features(sampled(known, counts, sample).join(others, ["suffix", "fold"], "left"))
    trees = GBTClassifier(labelCol="block", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
    model = trees.fit(assemble.transform(learned).select("features", "block", "weight").repartition(8))
    scored = model.transform(assemble.transform(with_features(rows.join(rates, "suffix", "left"))))
    chance = F.element_at(vector_to_array("probability"), 2)
    return scored.withColumn("chance", chance).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("chance") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.col("chance").alias("score"),
    )


def rules_sql(rules: list[Rule]) -> str:
    """The rules' part as SQL over columns host and path, for tests."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def when(rule: str) -> str:
        name, slash, rest = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"

    return "CASE " + reduce(lambda a, r: f"{a} WHEN {when(r[1])} THEN '{r[1]}'", order, "") + " END"
