"""Where pages lie in the site's menu, and the listings that people download."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U


def flat_menu(menu: DataFrame) -> DataFrame:
    """key, labels, ord of menu entries (url, labels, ord), the root left out, the first of a key."""
    rows = menu.select(U.match_key("url").alias("key"), "labels", "ord").where("key <> '/'")
    return rows.groupBy("key").agg(F.min_by("labels", "ord").alias("labels"), F.min("ord").alias("ord"))


def place(pages: DataFrame, menu: DataFrame) -> DataFrame:
    """url, trail, how (exact, inherited, unmatched): the longest menu key that is a prefix of the page's.

    One row for each address, though several pages have it; of their types the one that sorts
    first counts.  Every prefix of a page's path is looked up by equality; no pattern join.
    """
    key = U.match_key("url")
    segs = U.segments_of(F.col("key"))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segs), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, n), "/"), F.lit("/")))
    spread = pages.select("url", "page_type", key.alias("key")).select("url", "page_type", "key", F.explode(heads).alias("head"))
    found = spread.join(flat_menu(menu).withColumnRenamed("key", "head"), "head", "left")
    best = F.when(F.col("labels").isNotNull(), F.length("head"))
    top = found.groupBy("url", "key").agg(F.min("page_type").alias("page_type"), F.max_by(F.struct("head", "labels"), best).alias("m"))
    return top.select(
        "url",
        F.coalesce("m.labels", F.array(F.lit(S.OTHERS), F.col("page_type"))).alias("trail"),
        F.when(F.col("m").isNull(), "unmatched").when(F.col("m.head") == F.col("key"), "exact").otherwise("inherited").alias("how"),
    )


def better_trail(pages: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """Menu if it places the page at least as deep as its breadcrumb, else that, else none.

    Where pages share an address, ``by`` names the columns that tell them apart; the
    result has these too."""
    menu, crumb = F.coalesce(S.trail_depth(F.col("menu_trail")), F.lit(0)), F.coalesce(F.size("breadcrumb"), F.lit(0))
    source = F.when((menu > 0) & (menu >= crumb), "menu").when(crumb > 0, "breadcrumb").otherwise("none")
    trail = F.when(source == "menu", F.col("menu_trail")).when(source == "breadcrumb", F.col("breadcrumb")).otherwise(F.array(F.lit(S.OTHERS), F.col("page_type")))
    return pages.select(*_own(by), trail.alias("trail"), source.alias("source"))


def _own(by: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(["url", *by]))


def own_breadcrumb(pages: DataFrame) -> DataFrame:
    """``pages`` (own_breadcrumb, trail_source, trail) with ``breadcrumb``: what a page
    says of itself; where that was not stored, its trail if a breadcrumb placed it."""
    none = F.array().cast("array<string>")
    stored = F.when(F.coalesce(F.size("own_breadcrumb"), F.lit(0)) > 0, F.col("own_breadcrumb"))
    return pages.withColumn("breadcrumb", F.coalesce(stored, F.when(F.col("trail_source") == "breadcrumb", F.col("trail")), none))


def place_pages(pages: DataFrame, menu: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, trail, trail_source of every page (url, page_type, own_breadcrumb,
    trail_source, trail) by the menu and its own breadcrumb.  Its result, with the
    stored breadcrumbs, may be placed again and stays the same.  ``by`` as in
    ``better_trail``."""
    own = own_breadcrumb(pages).select(*_own(by), "page_type", "breadcrumb")
    by_menu = place(pages, menu).select("url", F.col("trail").alias("menu_trail"))
    return better_trail(own.join(by_menu, "url"), by).withColumnRenamed("source", "trail_source")


def merged(pages: DataFrame, missed: DataFrame, menu: DataFrame) -> DataFrame:
    """url, page_type, level, confidence, method, trail, trail_source, added: the pages
    and those that a reconciliation found missing (url, inlinks), classified by what
    is known of them and placed with all others under the same menu."""
    from . import classify as C

    total = pages.count() + missed.count()
    votes = C.collect(missed, C.degree_vote(F.col("inlinks"), F.lit(total)))
    new = C.cascade(missed, C.consensus(votes))
    none = F.array().cast("array<string>")
    added = new.select("*", none.alias("own_breadcrumb"), F.lit("none").alias("trail_source"), none.alias("trail"), F.lit(True).alias("added"))
    both = pages.withColumn("added", F.lit(False)).unionByName(added)
    placed = place_pages(both, menu)
    return both.drop("trail", "trail_source", "own_breadcrumb").join(placed, "url")


def coverage(placed: DataFrame) -> DataFrame:
    n = lambda how: F.count_if(F.col("how") == how)
    return placed.agg(
        F.count("*").alias("pages"),
        n("exact").alias("exact"),
        n("inherited").alias("inherited"),
        n("unmatched").alias("unmatched"),
        S.share((n("exact") + n("inherited")).cast("double"), F.count("*"), 0.0).alias("coverage"),
    )


def placement_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, old, new of pages whose trail moved; ``by`` as in ``better_trail``."""
    b, a = before.select(*_own(by), F.col("trail").alias("old")), after.select(*by, F.col("trail").alias("new"))
    return b.join(a, list(by)).where(~F.col("old").eqNullSafe(F.col("new")))


def placement_report(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """row, name, before, after of two placements (url, trail, trail_source): pages by
    source, pages whose trail moved (of those in both), and root labels gained or lost.
    ``by`` as in ``better_trail``."""
    one = lambda df, c, n: df.groupBy(F.coalesce(c, F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias(n))
    both = lambda c: one(before, c, "before").join(one(after, c, "after"), "name", "full").select("name", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("before", "after")))
    moved = placement_changes(before, after, by).agg(F.count(F.lit(1)).alias("n"))
    roots = both(F.get(F.col("trail"), F.lit(0))).where("(before = 0) <> (after = 0)")
    return (
        both(F.col("trail_source")).select(F.lit("source").alias("row"), "name", "before", "after")
        .union(moved.select(F.lit("moved"), F.lit(""), F.lit(0).cast("long"), "n"))
        .union(roots.select(F.when(F.col("before") == 0, "root gained").otherwise("root lost"), "name", "before", "after"))
    )


def placement_split(pages: DataFrame) -> DataFrame:
    """source (menu, breadcrumb, unplaced), pages, share from url, trail, trail_source; a result
    that is older than its source column is recounted from the trails."""
    placed = S.trail_depth(F.col("trail")) > 0
    known = F.when(F.col("trail_source").isin("menu", "breadcrumb"), F.col("trail_source")).when(F.col("trail_source").isNull() & placed, "menu")
    rows = pages.groupBy(F.coalesce(known, F.lit("unplaced")).alias("source")).agg(F.count(F.lit(1)).alias("pages"))
    total = pages.agg(F.count(F.lit(1)).alias("all"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("source", "pages", (F.col("pages") / F.col("all")).alias("share"))


def node_search(nodes: DataFrame, wanted: str, most: int = 40) -> DataFrame:
    """url, label, total: the first nodes whose label or address holds ``wanted`` in any
    case, by label and address, and how many there are (the feature)."""
    low = wanted.strip().lower()
    hits = nodes.where(F.lower(F.coalesce("label", F.lit(""))).contains(low) | F.lower(F.coalesce("url", F.lit(""))).contains(low)) if low else nodes.limit(0)
    total = hits.agg(F.count(F.lit(1)).alias("total"))  # one row
    return hits.orderBy("label", "url").limit(most).crossJoin(F.broadcast(total)).select("url", "label", "total")


def sibling_order(tree: DataFrame) -> DataFrame:
    """Place of a node among its siblings: by rank of its level, then by name."""
    from .ranking import running

    ranked = running(tree.withColumn("_rank_of_level", S.level_rank(F.col("level"))), ["parent"], [F.col("_rank_of_level").asc(), F.col("path").asc()], rank="nr")
    return ranked.drop("_rank_of_level").withColumn("nr", F.col("nr").cast("int"))


def section_counts(pages: DataFrame) -> DataFrame:
    """Pages under each node of the section tree, locale first if the address has one."""
    first = U.locale_of("url")
    trail = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")), S.section_trail(F.col("trail")))
    spread = pages.select(F.explode(S.prefixes(trail)).alias("node"))
    return spread.groupBy("node").agg(F.count("*").alias("pages")).select(F.array_join("node", " > ").alias("node"), "pages")


def worksheet(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """Draft labels, hardest first, with the names of the signals that a page has and
    empty columns for the reviewer."""
    from . import classify as C

    name = F.element_at(F.array(*map(F.lit, C.SOURCE_NAMES)), F.col("source") + 1)
    heard = signals.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias("signals"))
    blank = [F.lit("").alias(n) for n in ("reviewed", "expected_level", "expected_page_type", "notes")]
    return (
        pages.join(heard, "url", "left")
        .select(
            "url",
            F.col("level").alias("suggested_level"),
            F.col("page_type").alias("suggested_page_type"),
            F.bround("score", 3).alias("confidence"),
            F.coalesce("signals", F.lit("")).alias("signals"),
            *blank,
        )
        .orderBy("confidence", "url")
    )
