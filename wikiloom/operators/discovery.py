"""What sites say to machines: robots rules, sitemaps and feeds, and which addresses they allow. Built-in expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, normal_spaces
from wikiloom.operators.search import containing
from wikiloom.operators.web import attribute, decoded
from wikiloom.staging import small

# Feeds by what the type of a link holds, first match first.
FEEDS = [(("rss",), "rss_feed"), (("atom",), "atom_feed"), (("json", "feed"), "json_feed")]
#: Letters that the last part of an address has at least, where sitemaps are searched for it.
TOKEN_CHARS = 4


def host_of(url: Column) -> Column:
    """Scheme and host in lower case; empty for what is no http(s) address."""
    return F.lower(F.regexp_extract(url, r"(?i)\A(https?://[^/?#]+)", 1))


def path_of(url: Column) -> Column:
    """Path and query of an address; `/` where there is none."""
    got = F.regexp_replace(F.regexp_replace(url, r"(?i)\Ahttps?://[^/?#]+", ""), r"#.*\z", "")
    return F.when(F.startswith(got, F.lit("/")), got).otherwise(F.concat(F.lit("/"), got))


def absolute(base: Column, href: Column) -> Column:
    """href as seen from the page at base: full, without scheme, from the root, a query alone, or relative."""
    root, folder = F.regexp_extract(base, r"\A(https?://[^/?#]+)", 1), F.regexp_extract(F.regexp_replace(base, r"[?#].*\z", ""), r"\A(https?://[^/]+(?:/.*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    full = (
        F.when(href.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"\A(https?:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href)).when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#].*\z", ""), href)).otherwise(F.concat(folder, href))
    )
    # `.` and `..` within the path; one step for each `..`
    bare = F.regexp_replace(full, r"/(?:\./)+|/\.\z", "/")
    up = F.sequence(F.lit(0), F.floor((F.char_length(full) - F.char_length(F.replace(full, F.lit("/.."), F.lit("")))) / 3).cast("int"))
    return F.when(F.contains(full, F.lit("/.")), F.aggregate(up, bare, lambda s, _: F.regexp_replace(s, r"\A(https?://[^/]+(?:/[^?#]*?)??)(?:/(?!\.\./)[^/?#]+)?/\.\.(?:/|(?=[?#])|\z)", "$1/"))).otherwise(full)


def directives(files: DataFrame) -> DataFrame:
    """url, line, name (lower case), value: lines `name: value` of robots files (url, text); comments and lines without a value go."""
    each = files.select("url", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "raw")).select("url", (F.col("at") + 1).alias("line"), F.trim(F.regexp_replace("raw", r"^\s*#.*|\s#.*", "")).alias("raw"))
    told = each.filter(F.contains("raw", F.lit(":"))).select("url", "line", ascii_lower(F.trim(F.substring_index("raw", ":", 1))).alias("name"), F.trim(F.regexp_replace("raw", r"^[^:]*:", "")).alias("value"))
    return told


def robots_rules(files: DataFrame) -> DataFrame:
    """url, line, agent (lower case), allow, pattern: each rule with each agent of its group.

    Lines that name agents in a row begin a group; it goes on to the next such row. Rules before any agent, and those without
    a path, say nothing.
    """
    said = directives(files).filter(F.col("name").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("url").orderBy("line")
    names = F.col("name") == "user-agent"
    begins = (names & ~F.coalesce(F.lag(names).over(w), F.lit(False))).cast("int")
    grouped = said.withColumn("begins", begins).withColumn("group", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.filter("name = 'user-agent' and value <> ''").select("url", "group", ascii_lower(F.col("value")).alias("agent")).distinct()
    rules = grouped.filter("name <> 'user-agent' and value <> ''").select("url", "group", "line", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return rules.join(agents, ["url", "group"]).select("url", "line", "agent", "allow", "pattern")


def content_signals(files: DataFrame) -> DataFrame:
    """url, line, key, value: pairs of the content-signal lines, in lower case."""
    pairs = directives(files).filter("name = 'content-signal'").select("url", "line", F.explode(F.split("value", ",")).alias("pair")).filter(F.contains("pair", F.lit("=")))
    told = pairs.select("url", "line", ascii_lower(F.trim(F.substring_index("pair", "=", 1))).alias("key"), ascii_lower(F.trim(F.regexp_replace("pair", r"^[^=]*=", ""))).alias("value"))
    return told.filter("key <> '' and value <> ''")


def declared_sitemaps(files: DataFrame) -> DataFrame:
    """url, line, sitemap: sitemaps that robots files name by a full address."""
    return directives(files).filter((F.col("name") == "sitemap") & F.col("value").rlike(r"(?i)\A[a-z][a-z0-9+.-]*://[^/\s]")).select("url", "line", F.col("value").alias("sitemap"))


def _regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * is anything, $ at the end is the end, all else is itself."""
    end = F.endswith(pattern, F.lit("$"))
    bare = F.when(end, F.substring(pattern, 1, F.char_length(pattern) - 1)).otherwise(pattern)
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(F.split(bare, r"\*", -1), lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), ".*"), F.when(end, r"\z").otherwise(""))


def allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """url, agent, allowed, pattern: what the host's rules say of each request (url, agent).

    The group that names the agent holds, else that of `*`. Of its rules that match, the longest wins, an allowing one among
    equals; where none does, all is allowed and pattern is null. Rules meet addresses by hash on the beginning that a pattern
    states literally, at the lengths that occur, so that a host's rules aren't tried one by one on all its pages.
    """
    each = requests.select("url", "agent", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), ascii_lower(F.col("agent")).alias("who")).distinct()
    known = rules.select(host_of(F.col("url")).alias("host"), F.col("agent").alias("who"), "allow", "pattern", F.regexp_extract("pattern", r"\A([^*$]*)", 1).alias("start")).distinct()
    groups = known.select("host", "who").distinct().withColumn("own", F.lit(True))
    each = each.join(groups, ["host", "who"], "left").withColumn("group", F.when(F.col("own"), F.col("who")).otherwise("*")).drop("own")
    sizes = sorted(r[0] for r in known.select(F.char_length("start")).distinct().collect())  # lengths of patterns
    starts = F.array_distinct(F.array(*(F.left("path", F.lit(n)) for n in sizes))) if sizes else F.array().cast("array<string>")
    met = each.withColumn("start", F.explode(starts)).join(small(known.withColumnRenamed("who", "group")), ["host", "group", "start"]).withColumn("regex", _regex(F.col("pattern"))).filter(F.expr("path rlike regex"))
    best = met.groupBy("url", "agent").agg(F.max(F.struct(F.char_length("pattern").alias("n"), "allow", "pattern")).alias("best"))
    return requests.select("url", "agent").distinct().join(best, ["url", "agent"], "left").select("url", "agent", F.coalesce("best.allow", F.lit(True)).alias("allowed"), "best.pattern")


def sitemap_locations(files: DataFrame) -> DataFrame:
    """url, is_index, loc: addresses that sitemaps (url, text) hold, each once; an index holds further sitemaps."""
    loc = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), F.lit(1)), lambda x: F.trim(decoded(F.regexp_replace(x, r"^\s+|\s+$", ""))))))
    return files.select("url", F.col("text").rlike("(?i)<sitemapindex").alias("is_index"), loc.alias("loc")).filter("loc <> ''")


def sitemap_frontier(seeds: DataFrame, files: DataFrame, depth: int = 5) -> DataFrame:
    """url, root, depth: addresses of pages by the sitemap (seeds: url) that leads to them, through indexes of sitemaps, by
    the shortest way; each index is opened once a root, so loops end. Each level is one join on the frontier."""
    held = sitemap_locations(files)
    seen = seeds.select(F.col("url").alias("root"), "url").distinct().withColumn("depth", F.lit(0))
    front, found = seen, None
    for k in range(depth):
        near = front.select("root", "url").join(held, "url").select("root", "is_index", F.col("loc").alias("url"), F.lit(k + 1).alias("depth"))
        pages = near.filter("not is_index").select("url", "root", "depth")
        found = pages if found is None else found.unionByName(pages)
        front = near.filter("is_index").select("root", "url", "depth").distinct().join(seen.select("root", "url"), ["root", "url"], "left_anti")
        seen = seen.unionByName(front)
    return found.groupBy("url", "root").agg(F.min("depth").alias("depth"))


def in_sitemaps(pages: DataFrame, locations: DataFrame) -> DataFrame:
    """page_id, loc, exact: locations that are a page's address but for a slash at the end, or that hold the last part of its
    path, of four characters or more, in either case."""
    plain = lambda c: ascii_lower(F.regexp_replace(c, r"/+\z", ""))
    asked = pages.select("page_id", plain(F.col("url")).alias("key"), ascii_lower(F.regexp_extract(F.regexp_replace("url", r"[?#].*\z", ""), r"\Ahttps?://[^/]+/(?:.*/)?([^/]*)\z", 1)).alias("token"))
    locs = locations.select("loc").distinct()
    same = locs.select("loc", plain(F.col("loc")).alias("key")).join(asked, "key").select("page_id", "loc", F.lit(True).alias("exact"))
    near = containing(locs, ascii_lower(F.col("loc")), asked.filter(F.char_length("token") >= TOKEN_CHARS).select("page_id", "token"), F.col("token")).select("page_id", "loc", F.lit(False).alias("exact"))
    return same.unionByName(near).groupBy("page_id", "loc").agg(F.max("exact").alias("exact"))


def surfaces(pages: DataFrame) -> DataFrame:
    """page_id, kind, url, type: feeds that a page's head links to, and structured data within it; each once."""
    head = F.regexp_extract("html", r"(?is)<head\b[^>]*>(.*?)</head>", 1)
    tag = F.explode(F.regexp_extract_all(head, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1)))
    each = pages.select("page_id", "url", tag.alias("tag")).select("page_id", "url", F.lower(attribute(F.col("tag"), "rel")).alias("rel"), F.lower(attribute(F.col("tag"), "type")).alias("type"), decoded(F.trim(attribute(F.col("tag"), "href"))).alias("href"))
    kind = F.lit(None)
    for parts, name in reversed(FEEDS):
        test = F.lit(True)
        for p in parts:
            test = test & F.contains("type", F.lit(p))
        kind = F.when(test, name).otherwise(kind)
    feeds = each.filter("href <> ''").filter(F.contains("rel", F.lit("alternate"))).withColumn("kind", kind).filter("kind is not null").select("page_id", "kind", absolute(F.col("url"), F.col("href")).alias("url"), "type")
    data = pages.filter(F.col("html").rlike(r"(?i)application/ld\+json")).select("page_id", F.lit("structured_data").alias("kind"), "url", F.lit("application/ld+json").alias("type"))
    return feeds.unionByName(data).distinct()


def redirects(pages: DataFrame) -> DataFrame:
    """page_id, target: where a page's refresh tag sends its readers."""
    tag = F.get(F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1)), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"), 0)
    told = pages.select("page_id", "url", normal_spaces(decoded(F.regexp_extract(attribute(tag, "content"), r"(?i)url\s*=\s*'?([^']*)", 1))).alias("href")).filter("href <> ''")
    return told.select("page_id", absolute(F.col("url"), F.col("href")).alias("target"))
