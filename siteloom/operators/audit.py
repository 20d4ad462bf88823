"""Structural findings, reconciliation with another crawl, and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

SILO_PAGES, SILO_SHARE, REPEATED = 25, 0.01, 25
THRESHOLDS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def orphan_list(pages: DataFrame) -> DataFrame:
    return pages.where("inbound = 0").select("url", S.orphan_kind(F.col("in_sitemap"), F.col("in_cms")).alias("kind"), "page_type", "level")


def sitemap_redirects(pages: DataFrame) -> DataFrame:
    moved = pages.where(F.col("in_sitemap") & ~U.same_address(F.col("url"), F.col("final_url")))
    return moved.select("url", "final_url", (F.size(U.path_segments("final_url")) == 0).alias("lands_home"))


def duplicate_sets(pages: DataFrame, order: str = "url") -> DataFrame:
    """Pages with the same normal last segment whose segments before it are, in order,
    among those of the set's first page (by ``order``), or the reverse.  A page at
    the root has none before it and is only with such pages.

    The first page comes by an aggregate and a join, so no set is collected.
    """
    segs = F.transform(U.path_segments("url"), lambda s: U.normalize_segment(s))
    rows = pages.select("url", "inbound", F.col(order).alias("at"), segs.alias("segs"))
    leaf = F.when(F.size("segs") > 0, F.element_at("segs", -1)).otherwise("")
    rows = rows.select("url", "inbound", "at", leaf.alias("leaf"), F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0))).alias("above"))
    heads = rows.groupBy("leaf").agg(F.min_by(F.struct("url", "above"), F.struct("at", "url")).alias("head"))

    def within(a, b):  # a's elements in order among b's
        return F.aggregate(b, F.lit(0), lambda at, x: F.when(F.get(a, at) == x, at + 1).otherwise(at)) == F.size(a)

    own, head = F.col("above"), F.col("head.above")
    same = F.when((F.size(own) == 0) | (F.size(head) == 0), F.size(own) == F.size(head)).otherwise(within(own, head) | within(head, own))
    own = rows.join(heads, "leaf").where(same)
    sizes = own.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    return own.join(sizes, "leaf").select("leaf", "url", "inbound", "n")


def survivors(sets: DataFrame) -> DataFrame:
    """The page of each set to keep: most links, shortest path, no query, then URL."""
    path = F.length(U.path_of("url"))
    best = F.struct(F.col("inbound").alias("i"), (-path).alias("p"), (~F.col("url").contains("?")).alias("q"))
    top = sets.groupBy("leaf").agg(F.max(best).alias("best"))
    return sets.join(top, "leaf").where(best == F.col("best")).groupBy("leaf").agg(F.min("url").alias("keep"))


def silos(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """First folders with many pages that no menu label names (bounded list of labels)."""
    total = pages.agg(F.count("*").alias("total"))
    by = pages.select(F.get(U.path_segments("url"), F.lit(0)).alias("seg")).where("seg is not null").groupBy("seg").agg(F.count("*").alias("pages"))
    large = by.crossJoin(F.broadcast(total)).where((F.col("pages") >= SILO_PAGES) & (F.col("pages") >= SILO_SHARE * F.col("total")))
    name, label = U.flatten(F.col("seg")), U.flatten(F.col("label"))
    return large.join(labels, label.contains(name) | name.contains(label), "left_anti").select("seg", "pages")


def reconcile(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """key, side and reason; ``theirs`` has url, ord, status, indexable; the last of a key counts."""
    left = ours.groupBy(U.compare_key("url").alias("key")).agg(F.max_by("url", "ord").alias("our_url"))
    right = theirs.groupBy(U.compare_key("url").alias("key")).agg(F.max_by(F.struct("url", "status", "indexable"), "ord").alias("t"))
    both = left.join(right, "key", "full")
    hosts = ours.select(U.host_of("url").alias("host")).distinct()
    both = both.join(hosts.withColumn("known", F.lit(True)), U.host_of(F.col("t.url")) == F.col("host"), "left")
    url, status = F.col("t.url"), F.col("t.status")
    theirs_why = (
        F.when(F.col("known").isNull(), "OFF_SITE")
        .when(status.between(300, 399), "REDIRECT")
        .when((status >= 400) | (status == 0), "CLIENT_ERROR")
        .when(~U.is_crawlable(url), "MEDIA")
        .when(U.is_spider_trap(url), "TRAP")
        .when(~F.col("t.indexable"), "NON_INDEXABLE")
        .otherwise("MISSED_PAGE")
    )
    alone = both.where("t is null")
    tails = alone.select(U.tail_of("our_url")["tail"].alias("tail")).where("tail is not null").groupBy("tail").count().where(F.col("count") >= REPEATED)
    ours_why = (
        F.when(U.is_malformed("our_url"), "MALFORMED")
        .when(F.col("count").isNotNull(), "REPEATED_SUFFIX")
        .when(F.col("our_url").contains("?"), "QUERY_VARIANT")
        .otherwise("SITEMAP_ORPHAN")
    )
    mine = alone.join(tails, U.tail_of("our_url")["tail"] == F.col("tail"), "left").select("key", F.lit("ours").alias("side"), ours_why.alias("reason"))
    other = both.where("our_url is null").select("key", F.lit("theirs").alias("side"), theirs_why.alias("reason"))
    shared = both.where("our_url is not null and t is not null").select("key", F.lit("both").alias("side"), F.lit(None).cast("string").alias("reason"))
    return mine.union(other).union(shared)


def accuracy(labels: DataFrame, predictions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Hits by archetype, and over all (a null archetype), as grouping sets."""
    j = labels.join(predictions, "page_id", "left")
    seen = F.col("page_type").isNotNull()
    level, kind = F.col("level") == F.col("want_level"), F.col("page_type") == F.col("want_type")
    return (
        j.groupingSets([["archetype"], []], "archetype")
        .agg(
            F.count_if(seen).alias("evaluated"),
            F.count_if(~seen).alias("missing"),
            F.count_if(level).alias("level_hits"),
            F.count_if(kind).alias("type_hits"),
            F.count_if(level & kind).alias("exact_hits"),
            F.count_if(F.col("page_type") == "UNKNOWN").alias("unknown"),
            F.count_if(F.col("score") < threshold).alias("escalated"),
        )
        .withColumn("exact_rate", S.share(F.col("exact_hits").cast("double"), F.col("evaluated"), 0.0))
        .withColumn("sufficient", F.col("evaluated") >= 50)
    )


def profile_accuracy(labels: DataFrame, pages: DataFrame, voted: DataFrame, profiles: list[str]) -> DataFrame:
    """profile, evaluated, level_hits, type_hits, exact_hits, exact_rate over the labelled
    pages, the best first.  ``voted`` are consensus rows by profile; a page without one
    counts as an unknown leaf."""
    rows = labels.join(pages.select("page_id", "url"), "page_id").withColumn("profile", F.explode(F.array(*map(F.lit, profiles))))
    found = rows.join(voted.select("profile", "url", "level", "page_type"), ["profile", "url"], "left")
    level = F.coalesce("level", F.lit("L3_LEAF_PAGE")) == F.col("want_level")
    kind = F.coalesce("page_type", F.lit("UNKNOWN")) == F.col("want_type")
    by = found.groupBy("profile").agg(
        F.count("*").alias("evaluated"), F.count_if(level).alias("level_hits"), F.count_if(kind).alias("type_hits"), F.count_if(level & kind).alias("exact_hits")
    )
    return by.withColumn("exact_rate", S.share(F.col("exact_hits").cast("double"), F.col("evaluated"), 0.0)).orderBy(F.desc("exact_rate"), "profile")


def confusion(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    wrong = labels.join(predictions, "page_id").where("page_type <> want_type")
    return wrong.groupBy("want_type", "page_type").agg(F.count("*").alias("n"), F.min("url").alias("sample"))


def escalation_curve(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    j = labels.join(predictions, "page_id").withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    kept = F.col("score") >= F.col("threshold")
    hit = (F.col("level") == F.col("want_level")) & (F.col("page_type") == F.col("want_type"))
    return j.groupBy("threshold").agg(
        S.share(F.count_if(~kept).cast("double"), F.count("*"), 0.0).alias("escalated_share"),
        S.share(F.count_if(kept & hit).cast("double"), F.nullif(F.count_if(kept), F.lit(0)), 0.0).alias("accuracy_of_rest"),
    )


def path_tree(pages: DataFrame) -> DataFrame:
    """path, parent, depth, page (if one lies there; the last by URL), descendants."""
    segs = U.path_segments("url")
    rows = pages.select("url", F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: F.slice(segs, 1, n)).alias("p"), segs.alias("segs"))
    spread = rows.select("url", "segs", F.explode("p").alias("path"))
    nodes = spread.groupBy("path").agg(F.max(F.when(F.col("path") == F.col("segs"), F.col("url"))).alias("page"))
    above = nodes.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
    below = above.groupBy("path").agg((F.count("*") - 1).alias("descendants"))
    name = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    return nodes.join(below, "path").select(
        name(F.col("path")).alias("path"),
        F.when(F.size("path") > 0, name(F.slice("path", 1, F.size("path") - 1))).alias("parent"),
        F.size("path").alias("depth"),
        "page",
        "descendants",
    )


def folder_mismatch(pages: DataFrame) -> DataFrame:
    """Pages of two folders or more whose first folder is in no label of their trail."""
    segs = U.path_segments("url")
    rows = pages.select("url", F.size(segs).alias("n"), U.flatten(F.get(segs, F.lit(0))).alias("folder"), "trail").where("n >= 2 and size(trail) > 0")
    named = F.exists("trail", lambda label: U.flatten(label).contains(F.col("folder")) | F.col("folder").contains(U.flatten(label)))
    return rows.where(~named).select("url", "folder")


def trail_disagreement(sets: DataFrame, pages: DataFrame) -> DataFrame:
    """leaf, trails: sets whose pages have more than one trail (counts, not lists)."""
    trails = pages.where(F.size("trail") > 0).select("url", F.array_join("trail", " > ").alias("trail"))
    return sets.join(trails, "url").groupBy("leaf").agg(F.countDistinct("trail").alias("trails")).where("trails > 1")


def verify_missed(missed: DataFrame, probes: DataFrame, ours: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, state, held: what a probe (url, status, location) says of missed pages.

    Where pages share an address, ``by`` names the columns, in both, that tell them
    apart; the result has these too."""
    own = list(dict.fromkeys(["url", *by]))
    held = ours.select(U.compare_key("url").alias("there")).distinct().withColumn("held", F.lit(True))
    said = probes.select(*by, "status", "location")
    rows = missed.select(*own).join(said, list(by), "left").withColumn("there", U.compare_key(F.coalesce("location", F.lit(""))))
    status = F.coalesce("status", F.lit(0))
    state = F.when(status == 0, "UNREACHABLE").when(status.between(300, 399), "REDIRECTED").when(status >= 400, "GONE").otherwise("LIVE")
    return rows.join(held, "there", "left").select(*own, state.alias("state"), F.coalesce("held", F.lit(False)).alias("held"))
