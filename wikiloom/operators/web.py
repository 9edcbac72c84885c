"""Web pages: readable text, metadata, links, quality and access checks, as expressions on the page's source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, count_words, domain, normal_spaces

# What separates blocks, what never is content, entities that are decoded, signs of empty shells (two
# make one), and word counts from which an extraction is good or fair.
BLOCKS = "p|div|h[1-6]|li|ul|ol|tr|br|table|section|blockquote|pre|header|footer|article|main"
SKIPPED = "script|style|noscript|svg|nav|footer|aside|form|iframe|template"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}
SHELL_SIGNS = ["__next_f.push(", "_next/static/", "__next_data__", "data-reactroot", "ng-version", "window.__nuxt__", 'id="app"', "id='app'"]
# Signs of one vendor's challenge, and general ones, of which two make a challenge.
VENDOR_SIGNS = {
    "cloudflare": ["__cf_chl_", "cf-browser-verification", "just a moment..."],
    "aws_waf": ["awswafintegration", "awswafcookiedomainlist"],
    "anubis": ["anubis-auth", "anubis-cookie-verification", "/.within.website/x/cmd/anubis", "making sure you're not a bot", "proof-of-work challenge"],
    "datadome": ["captcha-delivery", "datadome"],
    "perimeterx": ["perimeterx", "px-captcha"],
}
CHALLENGE_SIGNS = ["verify that you're not a robot", "checking your browser", "challenge-container", "enable javascript and then reload the page", "javascript is disabled", "access denied", "captcha", "challenge.js"]
GOOD_WORDS, FAIR_WORDS = 350, 40


def decoded(c: Column) -> Column:
    """Named entities of the table, `&amp;` last; unknown ones stay."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def content(html: Column) -> Column:
    """The first article, else main, else body, else all of it."""
    out = html
    for tag in ("body", "main", "article"):
        got = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        out = F.when(got != "", got).otherwise(out)
    return out


def readable(html: Column) -> Column:
    """Lines of text without tags, comments and what is never content; blocks begin lines, empty lines are dropped."""
    bare = F.regexp_replace(F.regexp_replace(content(html), r"(?s)<!--.*?-->", ""), rf"(?is)<({SKIPPED})\b[^>]*>.*?</\1>", "")
    lines = F.split(F.regexp_replace(F.regexp_replace(bare, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n"), r"(?s)<[^>]*>", ""), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: normal_spaces(decoded(x))), lambda x: x != ""), "\n")


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def meta(html: Column, key: str) -> Column:
    """The content of the first <meta> whose name or property is key; empty if none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    hits = F.filter(tags, lambda t: F.lower(F.coalesce(F.nullif(attribute(t, "name"), F.lit("")), attribute(t, "property"))) == key)
    return F.coalesce(attribute(F.get(hits, 0), "content"), F.lit(""))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, text, words, quality (good, fair, poor)."""
    told = pages.select("page_id", readable(F.col("html")).alias("text"))
    words = count_words(F.col("text"))
    return told.select("page_id", "text", words.alias("words"), F.when(words >= GOOD_WORDS, "good").when(words >= FAIR_WORDS, "fair").otherwise("poor").alias("quality"))


def metadata(pages: DataFrame) -> DataFrame:
    """page_id, domain, title, heading, language, description, canonical (empty where there is none)."""
    h = F.col("html")
    title = normal_spaces(decoded(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    heading = normal_spaces(decoded(F.regexp_replace(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), r"<[^>]*>", "")))
    link = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1)), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    best = F.coalesce(F.nullif(meta(h, "og:title"), F.lit("")), title)
    about = F.coalesce(F.nullif(meta(h, "description"), F.lit("")), meta(h, "og:description"))
    return pages.select(
        "page_id", domain(F.col("url")).alias("domain"), best.alias("title"), heading.alias("heading"), F.regexp_extract(h, r"""(?is)<html\b[^>]*\blang=["']([^"']*)""", 1).alias("language"), about.alias("description"),
        F.coalesce(attribute(F.get(link, 0), "href"), F.lit("")).alias("canonical"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url (absolute), n: addresses in href and src attributes; fragments, mail and scripts are left out."""
    raw = F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)\b(?:href|src)\s*=\s*["']([^"'#][^"']*)["']"""), F.lit(1)))
    each = pages.select("page_id", F.regexp_extract("url", r"\A(https?)", 1).alias("scheme"), F.regexp_extract("url", r"\A(https?://[^/?#]+)", 1).alias("root"), F.regexp_replace("url", r"[?#].*|[^/]*\z", "").alias("base"), raw.alias("href")).withColumn("href", decoded(F.col("href")))
    full = F.when(F.col("href").rlike(r"(?i)\Ahttps?://"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat("scheme", F.lit(":"), "href")).when(F.startswith("href", F.lit("/")), F.concat("root", "href")).otherwise(F.concat("base", "href"))
    return each.filter(~F.col("href").rlike(r"(?i)\A(mailto|javascript|data|tel):")).select("page_id", full.alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n"))


def access(pages: DataFrame) -> DataFrame:
    """page_id, status, vendor: challenge for one sign of a vendor's or two general ones, app_shell for two signs of a shell,
    else content; in either case of A-Z."""
    rows = pages.select("page_id", ascii_lower(F.col("html")).alias("html"))
    signs = lambda names: sum((F.contains("html", F.lit(n)).cast("int") for n in names), F.lit(0))
    vendor = F.coalesce(*(F.when(signs(names) >= 1, name) for name, names in VENDOR_SIGNS.items()))
    told = rows.select("page_id", "html", vendor.alias("vendor"))
    return told.select("page_id", F.when(F.col("vendor").isNotNull() | (signs(CHALLENGE_SIGNS) >= 2), "challenge").when(signs(SHELL_SIGNS) >= 2, "app_shell").otherwise("content").alias("status"), "vendor")


def crawl_frontier(seeds: DataFrame, links: DataFrame, depth: int, same_host: bool = True) -> DataFrame:
    """url, depth: breadth first along links (source, target), each address once; each level is one join on the frontier."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        near = links.join(front.select(F.col("url").alias("source")), "source")
        if same_host:
            near = near.filter(domain(F.col("source")) == domain(F.col("target")))
        front = near.select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(front)
    return seen
