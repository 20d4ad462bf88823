"""Robots files: groups, the group of an agent, and what its rules allow.

Rules aren't tried on every address.  A rule is indexed by what it says before
its first wildcard; an address meets, by an equal join, the rules of its host
whose text before the wildcard is a prefix of its path and query, and only
these are matched in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

#: Lines of a file and characters of a rule that are read, as the format's readers have it.
MOST_LINES, MOST_CHARS = 10_000, 2_000


def lines(files: DataFrame) -> DataFrame:
    """host, nr, group, field, value of each line that states something (host, body).

    A group begins at a ``user-agent`` that no other directly precedes; lines
    before the first group belong to none; ``sitemap`` lines don't end a group's agents.
    """
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "^\\ufeff+", "")
    raw = files.select("host", F.posexplode(F.slice(F.split(body, "\\r\\n|[\\n\\r\\x0b\\f\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"), 1, MOST_LINES)).alias("nr", "raw"))
    text = F.trim(F.regexp_replace("raw", "(?s)#.*$", ""))
    said = raw.where(text.contains(":")).select(
        "host", "nr", F.lower(F.trim(F.substring_index(text, ":", 1))).alias("field"), F.trim(F.regexp_replace(text, "(?s)^[^:]*:", "")).alias("value")
    )
    by = Window.partitionBy("host").orderBy("nr")  # at most MOST_LINES rows
    own = said.where("field <> 'sitemap'")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by), F.lit("")) != "user-agent")
    grouped = own.withColumn("_b", begins.cast("int")).withColumn("group", F.sum("_b").over(by)).drop("_b")
    return grouped.where("group > 0").unionByName(said.where("field = 'sitemap'").withColumn("group", F.lit(0).cast("long")))


def rules(said: DataFrame) -> DataFrame:
    """host, group, pattern, allow of ``lines``; an empty rule restricts nothing."""
    own = said.where(F.col("field").isin("allow", "disallow") & (F.length("value").between(1, MOST_CHARS)))
    return own.select("host", "group", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))


def group_for(said: DataFrame, agent: str) -> DataFrame:
    """host, group, crawl_delay: the group that governs ``agent`` on each host.

    The longest token that the agent's name begins with wins, the first of equals;
    ``*`` only where no name does.  A host without either has no row.
    """
    named = said.where("field = 'user-agent' and value <> ''").select("host", "group", "nr", F.lower("value").alias("token"))
    any_agent = F.col("token") == "*"
    fits = named.where(any_agent | F.lit(agent.lower()).startswith(F.col("token")))
    order = F.struct(any_agent, -F.length("token"), "nr")
    chosen = fits.groupBy("host").agg(F.min_by("group", order).alias("group"))
    delay = F.expr("try_cast(value AS double)")
    waits = said.where("field = 'crawl-delay'").select("host", "group", "nr", delay.alias("wait")).where("wait >= 0")
    waits = waits.groupBy("host", "group").agg(F.max_by("wait", "nr").alias("crawl_delay"))
    return chosen.join(waits, ["host", "group"], "left")


def rules_for(files: DataFrame, agent: str) -> DataFrame:
    """host, pattern, allow: the rules that hold for ``agent``."""
    said = lines(files)
    return rules(said).join(group_for(said, agent).select("host", "group"), ["host", "group"]).select("host", "pattern", "allow")


def target(url: Column) -> Column:
    """Path and query of an address, which rules are about."""
    parts = U.split_url(url)
    path = F.when(parts["path"].startswith("/"), parts["path"]).otherwise(F.concat(F.lit("/"), parts["path"]))
    return F.concat(path, F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise(""))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: the longest rule that fits, allow before disallow, else allowed.

    ``rules`` are (pattern, allow) and, if there are several files, host.
    """
    host = F.col("host") if "host" in rules.columns else F.lit("")
    indexed = rules.select(host.alias("of"), "pattern", "allow", F.regexp_extract("pattern", r"^([^*]*?)(?:\*|\$$|$)", 1).alias("begin"))
    sizes = indexed.groupBy("of").agg(F.collect_set(F.length("begin")).alias("sizes"))  # at most MOST_CHARS lengths
    own = urls.select("url").distinct().select("url", (U.host_of("url") if "host" in rules.columns else F.lit("")).alias("of"), target(F.col("url")).alias("said"))
    asked = own.join(sizes, "of").select("url", "of", "said", F.explode(F.filter("sizes", lambda n: n <= F.length("said"))).alias("n"))
    asked = asked.select("url", "of", "said", F.expr("substring(said, 1, n)").alias("begin"))
    fits = asked.join(indexed, ["of", "begin"]).where(F.regexp("said", S.robots_regex(F.col("pattern"))))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("pattern").alias("l"), "allow")).alias("b"))
    return own.select("url").join(best, "url", "left").select("url", F.coalesce("b.allow", F.lit(True)).alias("allowed"))
