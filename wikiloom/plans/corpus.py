"""Wiki-shaped tables made of the test tables, by SQL that Spark and DuckDB read alike; each names the tables it reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TITLE = "concat('Part ', CAST({} AS STRING))"
#: Tables whose rows are made texts, each of one row of a test table.
TEXTS = ("articles", "manuals")
#: Rows of which a partition of texts has at least, where there are cores enough, and at most.
LEAST_ROWS, MOST_ROWS = 500, 8000



def _article() -> str:
    """Markup of many kinds, dealt by the part's number: calls within calls, links, citations, media, faults of style."""
    k, n = "p_partkey", "\n"
    if_ = lambda test, *parts: f"CASE WHEN {test} THEN concat({', '.join(parts)}) ELSE '' END"
    text = lambda s: "'" + s.replace("'", "''") + "'"
    num = lambda e: f"CAST({e} AS STRING)"
    lines = [
        if_(f"{k} % 4 <> 3", text("{{Short description|"), "p_name", text("}}" + n)),
        if_(f"{k} % 2 = 0", text("{{Infobox item|name="), "p_name", text("|size="), num("p_size"), text("|image=[[File:P"), num(f"{k} % 9"), text(".png|thumb|A view]]|style={{Colour|"), "p_brand", text("}}}}" + n)),
        text("Lead of [[Part "), num(f"{k} % 97"), text("|it]] and [[:Category:Index]] near [[Part "), num(f"({k} * 3) % 150"), text("#Top]], with [[Category:"), "p_type", text("]]." + n),
        if_(f"{k} % 6 = 0", text("{{#invoke:Tally|count|"), num("p_size"), text("|mode=x}} and {{#invoke:Tally|count|again|mode=y}}" + n)),
        if_(f"{k} % 8 = 0", text("{{#if:x|y}} <!-- [[hidden]] -->" + n)),
        text("== Details ==" + n + "Brand "), "p_brand", text('<ref name="b'), num(f"{k} % 5"), text('">{{Cite web|url=https://www.Site'), num("p_size"), text(".example/x|title=Title "), num(f"{k} % 13"), text("|website=Site "), num("p_size"), text("|date=2020|doi=https://doi.org/10.5/A"), num(f"{k} % 7"), text("}}</ref>." + n),
        if_(f"{k} % 3 = 1", text("Shown.<ref>[https://youtube.com/w/"), num(f"{k} % 50"), text(" clip]</ref>" + n)),
        if_(f"{k} % 3 = 2", text('Said again<ref name="b'), num(f"{k} % 5"), text('" />' + n)),
        if_(f"{k} % 5 = 1", text('Aside<ref group="n">Plain note on [[Part '), num(f"{k} % 40"), text("]]</ref> here." + n)),
        if_(f"{k} % 4 = 1", text("Read<ref>{{Cite book|title=Book "), num(f"{k} % 11"), text("|last=Doe|first=Ann"), num(f"{k} % 3"), text("|isbn=978-"), num(f"{k} % 10"), text("|year=1999|publisher=Press}}</ref>" + n)),
        if_(f"{k} % 5 = 0", text("# Notes" + n)), if_(f"{k} % 7 = 0", text("It is “quoted”." + n)), if_(f"{k} % 9 = 0", text("=== Bad heading ==" + n)),
        if_(f"{k} % 5 = 2", text("[[File:Q"), num(f"{k} % 6"), text(".jpg|thumb|left|Caption "), num(f"{k} % 3"), text("]]" + n)),
        if_(f"{k} % 10 = 3", text("<gallery>" + n + "G1.png|First" + n + "File:G2.png" + n + "</gallery>" + n)), if_(f"{k} % 10 = 4", text("<gallery></gallery>" + n)),
        if_(f"{k} % 10 = 2", text("## Odds" + n)), if_(f"{k} % 15 = 4", text("Odd<ref>“Said” so</ref>," + n)),
        if_(f"{k} % 11 = 0", text("TODO finish this" + n)), if_(f"{k} % 12 = 5", text("Doubtful.{{citation needed}}" + n)), if_(f"{k} % 13 = 0", text('<templatestyles src="Part/styles.css" /><templatestyles />' + n)),
        f"CASE WHEN {k} % 16 = 3 THEN '== See Also ==' ELSE '== See also ==' END", text(n + "* [[Part "), num(f"({k} * 13) % 2600"), text("]]" + n),
        if_(f"{k} % 3 = 0", text("== details ==" + n + "again [[broken" + n)), if_(f"{k} % 14 = 1", text("== Further Odd Matters ==" + n + "x" + n)), if_(f"{k} % 6 = 1", text("== References ==" + n + "{{Reflist}}" + n)), if_(f"{k} % 6 = 5", text("== References ==" + n)),
    ]
    return f"concat({', '.join(lines)})".replace("{", "{{").replace("}", "}}")


ARTICLE = _article()

SQL = {
    # a tenth redirects, some to titles that don't exist; a few are templates
    "pages": f"""SELECT p_partkey AS page_key, {TITLE.format("p_partkey")} AS title,
  concat(CASE WHEN p_size = 25 THEN 'templates/' ELSE 'main/' END, CAST(p_partkey AS STRING), '.wiki') AS path,
  CASE WHEN p_size = 25 THEN 'Template' ELSE 'Main' END AS namespace, p_partkey % 10 = 0 AS is_redirect,
  CASE WHEN p_partkey % 10 = 0 THEN {TITLE.format("(p_partkey * 7 + 30) % 2500")} END AS redirect_target,
  p_name AS name, p_type AS type, p_brand AS brand, CAST(p_size AS BIGINT) AS bytes FROM {{part}}""",
    "links": f"""SELECT DISTINCT {TITLE.format("l_partkey")} AS source, {TITLE.format("(l_orderkey * l_orderkey) % 211 * 7 + l_linenumber % 3 * 1000")} AS target
  FROM {{lineitem}}""",
    "members": f"""SELECT {TITLE.format("p_partkey")} AS source, concat('Category:', p_type) AS target FROM {{part}} WHERE p_partkey % 7 <> 0""",
    "categories": "SELECT DISTINCT concat('Category:', p_type) AS title FROM {part} UNION SELECT DISTINCT concat('Category:', p_brand) AS title FROM {part}",
    "invocations": f"""SELECT DISTINCT concat('Template:', l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) AS template, {TITLE.format("l_partkey")} AS page,
  concat_ws(',', CASE WHEN l_quantity > 25 THEN 'amount' END, CASE WHEN l_discount > 0.05 THEN 'discount' END, 'supplier', CASE WHEN l_tax > 0.04 THEN 'tax' END) AS keys FROM {{lineitem}}""",
    "examples": """SELECT concat('Template:', l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) AS template, concat('Part ', CAST(l_partkey AS STRING)) AS page, l_orderkey AS place,
  concat('supplier=', CAST(l_suppkey AS STRING)) AS text, CAST(l_quantity AS BIGINT) AS tokens FROM {lineitem}""",
    "transclusions": f"""SELECT {TITLE.format("p_partkey")} AS page, concat('Template:Part ', CAST((p_partkey * 11) % 400 AS STRING)) AS template FROM {{part}} WHERE p_partkey % 3 = 0""",
    # cycles of two or three in a chain, trees beside them, and loops
    "chains": """SELECT concat('N', CAST(100000 + r_regionkey * 10 + a AS STRING)) AS source, concat('N', CAST(100000 + r_regionkey * 10 + b AS STRING)) AS target
  FROM {region}, (SELECT 0 AS a, 1 AS b UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 10 UNION ALL SELECT 11, 12 UNION ALL SELECT 2, 3 UNION ALL SELECT 3, 13 UNION ALL SELECT 4, 4) AS steps""",
    "citations": """SELECT concat('Part ', CAST(o_custkey AS STRING)) AS page, o_orderkey AS place, concat('https://www.site', CAST(o_custkey % 40 AS STRING), '.example/', CAST(o_orderkey % 300 AS STRING)) AS url,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('10.1000/', CAST(o_orderkey % 70 AS STRING)) END AS doi, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 50 AS STRING) END AS isbn,
  concat('Template:Cite ', lower(substr(o_orderpriority, 3))) AS template, CASE o_orderstatus WHEN 'F' THEN 'news' WHEN 'O' THEN 'web' ELSE 'book' END AS kind,
  concat('ref ', CAST(o_custkey % 40 AS STRING), ' ', CAST(o_orderkey % 300 AS STRING)) AS wikitext FROM {orders}""",
    "articles": f"""SELECT concat('Part ', CAST(p_partkey AS STRING)) AS title, {ARTICLE} AS text, p_partkey AS k, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size FROM {{part}}""",
    # sources of templates, their documentation and modules
    "sources": """SELECT concat('Template:T', CAST(s_suppkey AS STRING)) AS title, 'template' AS kind, concat('{{{{{{name|}}}}}} of {{{{{{size}}}}}} {{{{#invoke:M', CAST(s_suppkey % 12 AS STRING), '|show}}}}<noinclude>', CASE WHEN s_suppkey % 3 = 0 THEN concat('<templatedata>{{"params": {{"name": {{"type": "string", "required": true}}, "k',
    CAST(s_suppkey % 4 AS STRING), '": {{"type": "number"}}}}}}</templatedata>') ELSE '' END, '</noinclude>') AS text FROM {supplier}
  UNION ALL SELECT concat('Template:T', CAST(s_suppkey AS STRING), '/doc'), 'template', 'How to use it' FROM {supplier} WHERE s_suppkey % 2 = 0
  UNION ALL SELECT concat('Module:M', CAST(n_nationkey AS STRING)), 'module', concat('local p = {{}}
local u = require("Module:M', CAST((n_nationkey + 1) % 15 AS STRING), '")
-- function p.no() end
function p.show(frame) end
p.part', CAST(n_nationkey % 3 AS STRING), ' = function() end
local function q() end
return p
') FROM {nation}""",
    "manuals": """SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('Manual:Hooks/Hook', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('Manual:$wgSetting', CAST(s_suppkey AS STRING)) ELSE concat('Extension:E', CAST(s_suppkey AS STRING)) END AS title,
  concat('About it.
== Use ==
Set $wgSetting', CAST(s_suppkey % 9 AS STRING), ' or {{{{#if:x|y}}}} and __NOTOC__ in &lt;tag&gt;.
=== Code ===
<syntaxhighlight lang="php">
$x = ', CAST(s_suppkey AS STRING), ';
</syntaxhighlight>
', CASE WHEN s_suppkey % 4 = 0 THEN '<pre>ab</pre><pre>longer</pre>
' ELSE '' END) AS text FROM {supplier}""",
    # templates with their use, calls of modules, what authors ask for and what other lanes name for them
    "catalog": """SELECT concat('Template:', p_name, ' ', CAST(p_partkey AS STRING)) AS title, lower(p_type) AS category, concat('Made by ', p_brand) AS summary, CAST(coalesce(n, 0) AS BIGINT) AS uses, CAST(coalesce(n_pages, 0) AS BIGINT) AS pages,
  lower(p_name) AS name, p_brand AS brand, p_size AS size, p_partkey AS k FROM {part} AS p LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_pages FROM {lineitem} GROUP BY l_partkey) AS u ON p.p_partkey = u.l_partkey""",
    "module_uses": """SELECT concat('Order ', CAST(l_orderkey AS STRING)) AS page, concat('Module:', p_brand) AS module, concat('show', l_linestatus, CAST(p_size % 3 AS STRING)) AS fn FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey""",
    "asked": """SELECT CAST(r_regionkey AS BIGINT) AS query, 'Ring' AS term FROM {region} UNION ALL SELECT r_regionkey, concat('brand#', CAST(r_regionkey AS STRING)) FROM {region} UNION ALL SELECT r_regionkey, 'showF' FROM {region} WHERE r_regionkey < 3
  UNION ALL SELECT r_regionkey, 'size 3' FROM {region} WHERE r_regionkey > 1 UNION ALL SELECT r_regionkey, 'order 1' FROM {region} WHERE r_regionkey = 4 UNION ALL SELECT r_regionkey, lower(r_name) FROM {region} UNION ALL SELECT DISTINCT -1, 'zzzz' FROM {region}""",
    "lanes": """SELECT CAST(p_partkey % 5 AS BIGINT) AS query, CASE WHEN p_partkey < 6 THEN 'stub_template' WHEN p_partkey % 60 = 7 THEN 'comparable_template' ELSE 'baseline_template' END AS lane, concat('Template:', p_name, ' ', CAST(p_partkey AS STRING)) AS title, CAST(p_size AS BIGINT) AS uses
  FROM {part} WHERE p_partkey < 6 OR p_partkey % 60 = 7 OR p_partkey % 150 = 9 UNION ALL SELECT p_partkey % 5, 'module_pattern', concat('Module:', p_brand), p_size FROM {part} WHERE p_partkey % 70 = 3
  UNION ALL SELECT -1, CASE WHEN p_partkey % 3 = 0 THEN 'module_pattern' ELSE 'comparable_template' END, concat('Lost_', p_brand), p_size FROM {part} WHERE p_partkey % 100 = 1""",
    # what the hosts of the web pages say to machines: robots rules, sitemaps (an index of two, and one in a loop), pages with feeds
    "robots": """SELECT concat(host, '/robots.txt') AS url, concat('# rules of ', host, chr(10), 'Sitemap: ', host, '/sitemap.xml', chr(10), 'User-agent: *', chr(10), 'Disallow: /de/', chr(10), 'Disallow: /*?page=', chr(10), 'Allow: /de/', CAST(n % 10 AS STRING), ' # but these', chr(10), chr(10),
  'User-Agent: LoomBot', chr(10), 'user-agent: Other', chr(10), 'Disallow: /en/', chr(10), 'Allow: /en/*.html$', chr(10), 'Disallow:', chr(10), 'Content-Signal: search=yes, AI-train=', CASE WHEN n % 2 = 0 THEN 'no' ELSE 'yes' END, ', odd', chr(10), 'Sitemap: /relative.xml', chr(10)) AS text
  FROM (SELECT lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS host, count(*) AS n FROM {pages} GROUP BY lower(regexp_extract(url, '^(https?://[^/]+)', 1))) AS hosts WHERE n > 1""",
    "sitemaps": """SELECT concat(host, '/sitemap.xml') AS url, concat('<?xml version="1.0"?><sitemapindex><sitemap><loc>', host, '/even.xml</loc></sitemap><sitemap><loc> ', host, '/odd.xml </loc></sitemap><sitemap><LOC>', host, '/sitemap.xml</LOC></sitemap></sitemapindex>') AS text
  FROM (SELECT DISTINCT lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS host FROM {pages}) AS hosts
  UNION ALL SELECT concat(host, CASE WHEN odd = 0 THEN '/even.xml' ELSE '/odd.xml' END), concat('<urlset>', string_agg(concat('<url><loc>', replace(loc, '&', '&amp;'), '</loc></url>'), ''), '</urlset>')
  FROM (SELECT lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS host, page_id % 2 AS odd, regexp_extract(url, '^([^#]+)', 1) AS loc FROM {pages}) AS locs GROUP BY host, odd""",
    "web_pages": """SELECT page_id, url, concat(CASE WHEN page_id % 9 = 0 THEN '<p>captcha</p>' WHEN page_id % 9 = 1 THEN '<p>Captcha</p> Access Denied' WHEN page_id % 9 = 2 THEN 'DataDome' WHEN page_id % 9 = 3 THEN '<div id="app"></div><script src="/_next/static/x.js">' ELSE '' END,
  replace(html, '</head>', concat(CASE WHEN page_id % 4 = 0 THEN '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="Alternate" type="application/atom+xml" href="atom?a=1&amp;b=2">' WHEN page_id % 4 = 1 THEN '<link rel="alternate" type="application/feed+json" href="//feeds.example/x.json"><link rel="alternate" type="text/html" href="/m">'
  WHEN page_id % 4 = 2 THEN '<script type="application/ld+json">{{}}</script>' ELSE '<meta http-equiv="Refresh" content="1; URL=../next">' END, '</head>'))) AS html FROM {pages}""",
    # what guides say, one for each brand; rules come from the parts of the brand
    "guides": """SELECT concat('Guide ', p_brand) AS doc, concat('# Writing', chr(10), 'Never output Markdown. Begin with {{{{SHORTDESC:text}}}}.', chr(10), '## Citations', chr(10), '{{{{Cite web|url=|title=}}}}', chr(10), '  {{{{Cite_book |title=}}}}', chr(10), '{{{{Cite web|again=}}}}', chr(10), '{{{{Cite ', lower(min(p_type)), '|x=}}}}', chr(10),
  '## 6. Infobox selection', chr(10), '| Subject type | Template |', chr(10), '|---|---|', chr(10), string_agg(DISTINCT concat('| ', p_type, ' ', CAST(p_size % 2 AS STRING), ' | `{{{{Infobox_', CASE WHEN p_size % 2 = 0 THEN 'item' ELSE lower(p_type) END, '}}}}` |', chr(10)), ''), '### Other', chr(10), '| Not | {{{{Read}}}} |', chr(10),
  '## VI. Unreliable sources', chr(10), string_agg(DISTINCT concat('- Site ', CAST(p_size AS STRING), ' (site', CAST(p_size AS STRING), '.example) — not checked', chr(10)), ''), '- Some Forum — no', chr(10), '- Tube (www.youtube.com)', chr(10),
  '## Style', chr(10), '**Never use:**', chr(10), '- "Read again" and "said  Again", not "', min(p_brand), '"', chr(10), '### Next', chr(10), '- "not this"', chr(10), '**Watch list — use sparingly or not at all:**', chr(10), '- doubtful, brand , Plain note', chr(10), '### No placeholder content', chr(10), 'Such as `TODO finish` or ``.', chr(10),
  '## Tags', chr(10), 'Contract: kind=tag; name=t', CAST(count(*) % 3 AS STRING), '; provider=Ext; syntax=<t>; body=required; attributes=a, b,', chr(10), '```', chr(10), '<t>', chr(10), 'Contract: kind=no; name=no', chr(10), '</t>', chr(10), '```', chr(10), 'Contract: kind=function; name=f', chr(10), '## End', chr(10), '```', chr(10), 'none', chr(10), '```', chr(10), 'Contract: kind=x') AS text
  FROM {part} GROUP BY p_brand""",
    # redirects and calls between pages: trees that run into cycles, some of them in chains
    "page_edges": """SELECT concat('Part ', CAST(p_partkey AS STRING)) AS source, concat('Part ', CAST((p_partkey * 7 + 30) % 2500 AS STRING)) AS target, 'redirect' AS kind FROM {part} WHERE p_partkey % 10 = 0
  UNION ALL SELECT concat('Part ', CAST(p_partkey AS STRING)), concat('Part ', CAST((p_partkey * 11 + 4) % 400 AS STRING)), 'transclusion' FROM {part} WHERE p_partkey % 3 = 0""",
    "local_files": """SELECT concat('Order ', CAST(o_orderkey AS STRING)) AS title, concat(CASE WHEN o_orderkey % 4 = 0 THEN 'other/' ELSE 'main/' END, CAST(o_orderkey AS STRING), '.wiki') AS path,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Other' ELSE 'Main' END AS namespace, o_orderkey % 50 = 0 AS is_redirect,
  concat(o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 'edited' ELSE '' END, o_orderpriority) AS hash FROM {orders} WHERE o_orderkey % 13 <> 0""",
    "ledger": """SELECT concat('order ', CAST(o_orderkey AS STRING)) AS title, concat(CASE WHEN o_orderkey % 4 = 0 THEN 'other/' ELSE 'main/' END, CAST(o_orderkey AS STRING), '.wiki') AS path,
  concat(o_orderstatus, o_orderpriority) AS hash, CAST(o_orderkey % 1000 AS BIGINT) AS changed_at FROM {orders} WHERE o_orderkey % 17 <> 0""",
    "remote": """SELECT concat('Order ', CAST(o_orderkey AS STRING)) AS title, CAST(o_orderkey % 1000 + CASE WHEN o_orderkey % 6 = 0 THEN 31 WHEN o_orderkey % 6 = 1 THEN 30 ELSE 0 END AS BIGINT) AS changed_at,
  concat(o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE '' END, o_orderpriority) AS hash FROM {orders} WHERE o_orderkey % 3 <> 0""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as texts made of them need. A file of a few MB is one split, though the articles made of it
    are hundreds of MB; the short rows are dealt out before they are made texts."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-n // LEAST_ROWS), max(4 * cores, -(-n // MOST_ROWS)))
    return rows.repartition(parts) if parts > 1 else rows


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables above, or a test table as it is."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(SQL[name])}
    return spark.sql(SQL[name], **({t: dealt(rows) for t, rows in read.items()} if name in TEXTS else read))


def with_tables(*names: str) -> str:
    """The beginning of an SQL query over the tables above."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in tables_of(SQL[n])})})" for n in names)
