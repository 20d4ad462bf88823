"""Relations from stored bodies: sitemaps, listings, exports, robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U
from siteloom.operators.ranking import running
from siteloom.operators.staging import staged

#: Words by which exports name their columns, in six languages (fixed values).
CLICK_WORDS = ("click", "klick", "clic", "clique", "cliques", "クリック")
IMPRESSION_WORDS = ("impression", "impressionen", "impresion", "impressão", "表示")
POSITION_WORDS = ("position", "posición", "posição", "posizione", "掲載順位")
#: Columns of an export whose header says nothing, and the least share of addresses in a table of pages.
USUAL, LEAST_SHARE = (0, 1, 2, 4), 0.6

MOST_LOCS = 50_000


def _text(inner: Column) -> Column:
    """The text of an element: a CDATA section as it is, else references decoded."""
    cdata = F.regexp_extract(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
    return F.trim(F.when(cdata != "", cdata).otherwise(U.unescape_markup(inner)))


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """name, kind, loc, nr from name, body: distinct entries in order, at most 50 000 (the format's own limit)."""
    root = F.regexp_extract("body", r"(?is)<(?:\w+:)?(sitemapindex|urlset)\b", 1)
    locs = F.array_distinct(
        F.filter(
            F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<(?:\w+:)?loc[^>]*>(.*?)</(?:\w+:)?loc\s*>"), F.lit(1)), _text), lambda x: x != ""
        )
    )
    return bodies.select(
        "name",
        F.when(F.lower(root) == "sitemapindex", "INDEX").when(F.lower(root) == "urlset", "URLSET").otherwise("UNKNOWN").alias("kind"),
        F.posexplode(F.slice(locs, 1, MOST_LOCS)).alias("nr", "loc"),
    )


def wordpress_records(listings: DataFrame) -> DataFrame:
    """endpoint, id, link, parent, parent_url, has_children from endpoint, body."""
    rows = listings.select(
        "endpoint", F.explode(F.from_json("body", "array<struct<id:bigint,link:string,parent:bigint>>")).alias("r")
    ).select("endpoint", "r.id", "r.link", F.nullif(F.col("r.parent"), F.lit(0)).alias("parent"))
    above = rows.select("endpoint", F.col("id").alias("parent"), F.col("link").alias("parent_url")).dropDuplicates(["endpoint", "parent"])
    named = rows.where("parent is not null").select("endpoint", F.col("parent").alias("id")).distinct().withColumn("has_children", F.lit(True))
    return (
        rows.join(above, ["endpoint", "parent"], "left")
        .join(named, ["endpoint", "id"], "left")
        .select("endpoint", "id", "link", "parent", "parent_url", F.coalesce("has_children", F.lit(False)).alias("has_children"))
    )


def shopify_records(listings: DataFrame, collection: str = "products") -> DataFrame:
    """url, record_type, has_children from root, body."""
    body = F.from_json("body", f"struct<{collection}:array<struct<handle:string>>>")
    rows = listings.select("root", F.explode(body[collection]["handle"]).alias("handle")).where("handle is not null and handle <> ''")
    return rows.select(
        F.concat_ws("/", F.regexp_replace("root", "/+$", ""), F.lit(collection), "handle").alias("url"),
        F.lit(collection).alias("record_type"),
        F.lit(collection == "collections").alias("has_children"),
    )


def export_records(lines: DataFrame) -> DataFrame:
    """file, nr, line: records of rows (file, nr, line) without a byte order mark; a record
    goes on over lines until its quotes are closed."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    marked = lines.select("file", "nr", F.regexp_replace(F.coalesce("line", F.lit("")), "^\ufeff", "").alias("line")).withColumn("q", quotes % 2)
    odd = marked.where("q = 1").select("file").distinct()
    plain = marked.join(odd, "file", "left_anti").select("file", "nr", "line")
    # only files with a quote left open somewhere are put together
    counted = running(marked.join(odd, "file", "left_semi"), ["file"], [F.col("nr").asc()], sums={"closed": "q"}, rank="at")
    begins = ((F.col("closed") - F.col("q")) % 2 == 0).cast("long")
    numbered = running(counted.withColumn("b", begins), ["file"], [F.col("nr").asc()], sums={"record": "b"}, rank="place")
    whole = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("nr", "line"))).alias("l"))
    return plain.union(whole.select("file", F.col("l")[0]["nr"].alias("nr"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("line")))


def export_cells(lines: DataFrame) -> DataFrame:
    """file, nr, cells of rows (file, nr, line): quoted cells whole, by the delimiter
    that the file's first lines hold more of; empty lines left out."""
    records = export_records(lines)
    count = lambda c: F.sum(F.when(F.col("nr") < 20, F.length("line") - F.length(F.replace("line", F.lit(c), F.lit(""))))  )
    marks = records.groupBy("file").agg((F.coalesce(count(";"), F.lit(0)) > F.coalesce(count(","), F.lit(0))).alias("semicolons"))

    def cells(sep: str) -> Column:
        # each cell with the delimiter before it, so that none is empty
        raw = F.regexp_extract_all(F.concat(F.lit(sep), "line"), F.lit(f'(?s){sep}("(?:[^"]|"")*"[^{sep}]*|[^{sep}]*)'), F.lit(1))
        inner = lambda x: F.replace(F.regexp_extract(x, '(?s)^"(.*)"[^"]*$', 1), F.lit('""'), F.lit('"'))
        return F.transform(raw, lambda x: F.when(x.rlike('(?s)^".*"'), inner(x)).when(x == "", F.lit(None)).otherwise(x))

    read = records.where("trim(line) <> ''").join(marks, "file")
    return read.select("file", "nr", F.when(F.col("semicolons"), cells(";")).otherwise(cells(",")).alias("cells"))


def table_shares(cells: DataFrame) -> DataFrame:
    """file, rows, share: how much of each table's first column are addresses."""
    hit = F.count_if(F.coalesce(S.is_address(F.col("cells")[0]), F.lit(False)))
    return cells.groupBy("file").agg(F.count("*").alias("rows"), (hit / F.count("*")).alias("share"))


def pick_table(cells: DataFrame) -> DataFrame:
    """One row: the file with the greatest share of addresses, of equals the longest;
    none if the share is less than six tenths."""
    return table_shares(cells).agg(F.max_by(F.struct("file", "rows", "share"), F.struct("share", "rows", "file")).alias("t")).select("t.*").where(F.col("share") >= LEAST_SHARE)


def named_columns(cells: DataFrame) -> DataFrame:
    """file, header, clicks, impressions, position: places (from 0) of each file's
    columns by the words of its first row, the usual ones where it says nothing."""
    first = cells.groupBy("file").agg(F.min_by("cells", "nr").alias("row"))
    low = F.transform("row", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))

    def find(words: tuple[str, ...]) -> Column:
        named = F.transform(low, lambda x, i: F.when((i > 0) & x.rlike("|".join(words)), i))
        return F.array_min(named)

    address = F.coalesce(S.is_address(F.col("row")[0]), F.lit(False))
    found = first.select("file", (~address).alias("header"), *[find(w).alias(n) for n, w in (("c", CLICK_WORDS), ("i", IMPRESSION_WORDS), ("p", POSITION_WORDS))])
    named = F.col("header") & F.col("c").isNotNull() & F.col("i").isNotNull()
    return found.select(
        "file",
        "header",
        F.when(named, F.col("c")).otherwise(USUAL[1]).alias("clicks"),
        F.when(named, F.col("i")).otherwise(USUAL[2]).alias("impressions"),
        F.when(named, F.coalesce("p", F.lit(USUAL[3]))).otherwise(USUAL[3]).alias("position"),
    )


def search_export(lines: DataFrame) -> DataFrame:
    """file, url, clicks, impressions, position from rows (file, nr, line) of exports;
    rows without an address are left out (``rejected_rows`` counts them)."""
    return _figures(staged(export_cells(lines)))


def _figures(cells: DataFrame) -> DataFrame:
    at = lambda c: F.get(F.col("cells"), F.col(c))
    rows = cells.where(S.is_address(F.col("cells")[0])).join(named_columns(cells), "file")
    return rows.select(
        "file",
        F.trim(F.col("cells")[0]).alias("url"),
        S.tolerant_int(at("clicks")).alias("clicks"),
        S.tolerant_int(at("impressions")).alias("impressions"),
        S.tolerant_decimal(at("position")).alias("position"),
    )


def archive_export(lines: DataFrame) -> DataFrame:
    """As ``search_export``, of the one table of an archive that lists pages (``pick_table``);
    others, such as queries, countries or the same pages again, aren't counted."""
    cells = staged(export_cells(lines))
    return _figures(cells.join(F.broadcast(pick_table(cells).select("file")), "file", "left_semi"))  # one row


def rejected_rows(lines: DataFrame) -> DataFrame:
    """file, rejected: rows (but for a header) whose first cell is no address."""
    cells = export_cells(lines)
    bad = ~F.coalesce(S.is_address(F.col("cells")[0]), F.lit(False))
    first = cells.groupBy("file").agg(F.min("nr").alias("first"))
    return cells.join(first, "file").groupBy("file").agg(F.count_if(bad & (F.col("nr") > F.col("first"))).alias("rejected"))


def expanded_sitemaps(bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """url, sitemap_source: pages of all sitemaps that the roots (name) lead to over
    indexes, a level at a time; ``name`` of a body is its address, the source the
    last part of it.  A sitemap that was met is not met again."""
    entries = staged(sitemap_entries(bodies))
    met = staged(roots.select("name").distinct())
    frontier = met
    while True:  # each level has sitemaps that weren't met, so it ends
        below = entries.where("kind = 'INDEX'").join(frontier, "name", "left_semi").select(F.col("loc").alias("name")).distinct()
        frontier = staged(below.join(met, "name", "left_anti"))
        if frontier.isEmpty():
            break
        met = staged(met.union(frontier))
    pages = entries.where("kind = 'URLSET'").join(met, "name", "left_semi")
    return pages.select(F.col("loc").alias("url"), F.substring_index("name", "/", -1).alias("sitemap_source"))


def label_corpus(files: DataFrame) -> DataFrame:
    """name, archetype, url, expected_level, expected_page_type from rows (file, body):
    a JSON object or an array of them in each file; of sites of one name the one in the last file."""
    site = "struct<name:string,archetype:string,entries:array<struct<url:string,expected_level:string,expected_page_type:string>>>"
    one, many = F.from_json("body", site), F.from_json("body", f"array<{site}>")
    listed = F.when(F.ltrim("body").startswith("["), many).otherwise(F.array(one))
    sites = files.select("file", F.posexplode(listed).alias("nr", "s")).where("s.name is not null")
    last = sites.groupBy("s.name").agg(F.max_by("s", F.struct("file", "nr")).alias("s"))
    return last.select("s.name", "s.archetype", F.explode("s.entries").alias("e")).select("name", "archetype", "e.*")


def reviewed_rows(sheet: DataFrame, levels: list[str], types: list[str]) -> DataFrame:
    """Rows of a worksheet that a person has reviewed, with ``usable``: whether level and type are known ones."""
    done = F.lower(F.trim("reviewed")).isin("y", "yes", "true", "1", "ok", "done")
    good = F.upper(F.trim("expected_level")).isin(*levels) & F.upper(F.trim("expected_page_type")).isin(*types)
    return sheet.where(done).withColumn("usable", F.coalesce(good, F.lit(False)))


def robots_rules(files: DataFrame) -> DataFrame:
    """host, agent, pattern, allow from host, body: agents that follow each other share the rules below them."""
    from pyspark.sql import Window

    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("nr", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    named = lines.select("host", "nr", F.lower(F.trim(F.substring_index(text, ":", 1))).alias("k"), F.trim(F.regexp_replace(text, "^[^:]*:", "")).alias("v"))
    named = named.where(F.col("k").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy("host").orderBy("nr")
    begins = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(by), F.lit("")) != "user-agent")
    grouped = named.withColumn("b", begins.cast("int")).withColumn("g", F.sum("b").over(by))
    agents = grouped.where("k = 'user-agent'").select("host", "g", F.lower("v").alias("agent"))
    rules = grouped.where("k <> 'user-agent' and v <> ''").select("host", "g", F.col("v").alias("pattern"), (F.col("k") == "allow").alias("allow"))
    return agents.join(rules, ["host", "g"]).select("host", "agent", "pattern", "allow")
