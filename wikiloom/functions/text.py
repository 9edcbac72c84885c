"""Column functions on titles, text, identifiers, addresses and times. All are built-in expressions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Namespaces by their lower-case prefix.
NAMESPACES = {"category": "Category", "file": "File", "image": "File", "user": "User", "template": "Template", "module": "Module", "mediawiki": "MediaWiki"}
# Hosts by kind.
SOCIAL = ["twitter.com", "x.com", "farcaster.xyz", "instagram.com", "tiktok.com", "mastodon.social"]
VIDEO = ["youtube.com", "youtu.be", "vimeo.com", "twitch.tv"]
WIKI_ENDS = [".wikipedia.org", ".wiktionary.org", ".wikimedia.org", ".miraheze.org", ".fandom.com"]
# Sections that hold no prose of their own.
LOW_SIGNAL = ["references", "notes", "external links", "further reading", "bibliography", "gallery", "see also"]


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would fold other letters too."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def normal_spaces(c: Column) -> Column:
    """Runs of Unicode white space are one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_lines(c: Column) -> Column:
    """Each line normalised, empty ones dropped, the rest parted by an empty line."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\r?\n"), normal_spaces), lambda x: x != ""), "\n\n")


def _once(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def namespace_of(title: Column) -> Column:
    """The namespace that a title's prefix names, in either case; else Main."""
    known = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    prefix = F.lower(F.trim(F.regexp_extract(title, r"\A([^:]*):", 1)))
    return F.coalesce(F.try_element_at(known, prefix), F.lit("Main"))


def _rest(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\A[^:]*:", ""))


def canonical_title(title: Column) -> Column:
    """Underscores are spaces, spaces normalised, a known namespace prefix in its canonical form."""
    plain = normal_spaces(F.translate(title, "_", " "))
    return _once(F.struct(plain.alias("t"), namespace_of(plain).alias("ns")), lambda x: F.when(x.ns == "Main", x.t).otherwise(F.concat(x.ns, F.lit(":"), _rest(x.t))))


def title_key(title: Column) -> Column:
    """canonical_title() with the first character of the page name in upper case, by which sync compares."""
    plain = normal_spaces(F.translate(title, "_", " "))
    parts = _once(F.struct(plain.alias("t"), namespace_of(plain).alias("ns")), lambda x: F.struct(x.ns.alias("ns"), F.when(x.ns == "Main", x.t).otherwise(_rest(x.t)).alias("name")))
    return _once(parts, lambda x: F.concat(F.when(x.ns == "Main", "").otherwise(F.concat(x.ns, F.lit(":"))), F.upper(F.substring(x["name"], 1, 1)), F.substring(x["name"], 2, (1 << 31) - 1)))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def sync_hash(c: Column) -> Column:
    """short_hash() of the text with LF line ends and no white space at its end."""
    return short_hash(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?U)\s+\z", ""))


def redirect_target(c: Column) -> Column:
    """The target of a text that begins with #REDIRECT; null for all others."""
    found = F.regexp_extract(c, r"(?is)\A\s*#redirect[^\[]*\[\[([^\]|#]*)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def variant_language(title: Column) -> Column:
    """The language code that a translated title ends with (`Page/pt-BR`), in lower case, or null: two letters or digits and
    further parts, none of digits alone; or qqq. Of no other length are the ends of subpages such as /doc."""
    code = ascii_lower(F.trim(F.regexp_extract(title, r"(?s)\A\s*\S.*/([^/]*)\z", 1)))
    return F.when(code.rlike(r"\A(?:[a-z0-9]{2}(?:-(?!\d+(?:-|\z))[a-z0-9]{1,8})*|qqq)\z"), code)


def variant_base(title: Column) -> Column:
    return F.when(variant_language(title).isNotNull(), F.regexp_replace(title, r"/[^/]*\z", "")).otherwise(title)


def words(c: Column) -> Column:
    plain = normal_spaces(c)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def count_words(c: Column) -> Column:
    plain = normal_spaces(c)
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " "))).cast("long")


def summary(c: Column, n: int = 36) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(c) / 4).cast("long")


def byte_token_estimate(c: Column) -> Column:
    """A quarter of the bytes of the normalised text, rounded up."""
    return F.ceil(F.octet_length(normal_spaces(c)) / 4).cast("long")


def preview(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def snippet(c: Column, term: Column, before: int = 80, after: int = 120, fallback: int = 200) -> Column:
    """The text about the first place of term, in either case, with dots where it is cut; else its first part."""
    at = F.instr(ascii_lower(c), ascii_lower(term))
    start = F.greatest(at - before, F.lit(1))
    end = at + F.char_length(term) + after
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(c, start, end - start), F.when(end <= F.char_length(c), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.left(c, F.lit(fallback)))


def parameter_key(c: Column) -> Column:
    return ascii_lower(normal_spaces(F.translate(c, "_", " ")))


def template_title(c: Column) -> Column:
    """`Template:Name`, or null for what can't be a template's name."""
    bare = normal_spaces(F.translate(F.regexp_replace(c, r"\A\s*:", ""), "_", " "))

    def named(x):
        name = F.when(x.ns == "Template", _rest(x.t)).otherwise(x.t)
        return F.when(x.ns.isin("Main", "Template") & (name != "") & ~name.rlike(r"[#!\[\]{}|<>]"), F.concat(F.lit("Template:"), name))

    return _once(F.struct(bare.alias("t"), namespace_of(bare).alias("ns")), named)


def identifier(key: Column, value: Column) -> Column:
    """Identifiers in the form in which they are compared: DOIs and arXiv numbers without resolver, others alphanumeric."""
    v = ascii_lower(F.trim(value))
    doi = F.regexp_replace(v, r"\A(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    arxiv = F.regexp_replace(v, r"\A(?:https?://arxiv\.org/abs/|arxiv:\s*)", "")
    kept = F.when(key == "doi", doi).when(key == "arxiv", arxiv)
    return F.coalesce(F.regexp_replace(kept, r"[^a-z0-9./_-]", ""), F.regexp_replace(v, r"[^a-z0-9]", ""))


def first_url(c: Column) -> Column:
    """The first http(s) address in a text, up to white space or a delimiter of markup."""
    return F.nullif(F.regexp_extract(c, r"""(https?://[^\s|}\]<>"']+)""", 1), F.lit(""))


def domain(url: Column) -> Column:
    """The host of an address in lower case, without leading `www.`."""
    host = F.regexp_extract(F.lower(url), r"\A(?:https?:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\A(?:www\.)+", ""), F.lit(""))


def domain_kind(host: Column) -> Column:
    """social, video, wiki, web, or none where there is no host; hosts of the lists count as they stand."""
    wiki = host.startswith("wiki.")
    for end in WIKI_ENDS:
        wiki = wiki | host.endswith(end)
    return F.when(host.isin(VIDEO), "video").when(host.isin(SOCIAL), "social").when(wiki, "wiki").when(host != "", "web").otherwise("none")


def normal_url(c: Column) -> Column:
    """An http(s) address with normalised spaces, https: before one that begins with //; null for all else."""
    return _once(normal_spaces(c), lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(u.rlike(r"\Ahttps?://"), u))


def wiki_address(url: Column) -> Column:
    """host, title and api of a wiki page's address, /wiki/Title or index.php?title=Title; a null title for others."""
    path = F.regexp_extract(url, r"\Ahttps?://[^/?#]+(/[^?#]*)?", 1)
    named = F.coalesce(F.nullif(F.regexp_extract(path, r"/wiki/(.+)\z", 1), F.lit("")), F.when(path.rlike(r"/(?:index\.php)?\z"), F.nullif(F.regexp_extract(url, r"[?&]title=([^&#]+)", 1), F.lit(""))))
    root = F.regexp_extract(url, r"\A(https?://[^/?#]+)", 1)
    before = F.regexp_extract(path, r"\A(.*?)/(?:wiki/.*|index\.php)?\z", 1)
    return F.struct(domain(url).alias("host"), normal_spaces(F.translate(F.try_url_decode(named), "_", " ")).alias("title"), F.when(root != "", F.concat(root, before, F.lit("/api.php"))).alias("api"))


def times_match(a: Column, b: Column, seconds: int = 30) -> Column:
    """Whether two ISO times are within `seconds`; what can't be read matches."""
    shape = F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")
    gap = F.abs(F.unix_timestamp(F.try_to_timestamp(a, shape)) - F.unix_timestamp(F.try_to_timestamp(b, shape)))
    return F.coalesce(gap <= seconds, F.lit(True))


def iso_time(unix_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(unix_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lexical_terms(c: Column) -> Column:
    """The set of words reduced to ASCII letters and digits, lower case, three or more of them; sorted."""
    # signs are cut from the whole text at once, not word by word
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s", " "), "[^A-Za-z0-9 ]++", ""))
    return F.array_sort(F.filter(F.array_distinct(F.split(bare, " ")), lambda w: F.char_length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def coverage_terms(c: Column) -> Column:
    """The set of lower-case words, any letters and digits."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), "")))


def query_terms(c: Column, most: int = 8) -> Column:
    """What a query is searched by: itself, its part after a colon, its words of four or more bytes; each once."""
    q = normal_spaces(c)
    after = F.when(F.locate(":", q) > 0, normal_spaces(F.regexp_replace(q, r"^[^:]*:", "")))
    parts = F.filter(F.split(q, " "), lambda w: F.octet_length(w) >= 4)
    every = F.filter(F.concat(F.array(q, after), parts), lambda x: x.isNotNull() & (x != ""))
    # the first place of each, in either case
    first = lambda x: F.transform(F.slice(F.array_distinct(x.low), 1, most), lambda k: F.get(x.terms, F.array_position(x.low, k).cast("int") - 1))
    return _once(F.struct(every.alias("terms"), F.transform(every, ascii_lower).alias("low")), first)


# markup within a text


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def call_depth(c: Column) -> Column:
    """How deep {{ }} are nested at most."""
    marks = F.regexp_extract_all(c, F.lit(r"(\{\{|\}\})"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    step = lambda s, x: F.struct(F.greatest(s.now + F.when(x == "{{", 1).otherwise(-1), F.lit(0)).alias("now"), F.greatest(s.top, s.now + (x == "{{").cast("int")).alias("top"))
    return F.coalesce(F.aggregate(marks, start, step, lambda s: s.top), F.lit(0))


INNERMOST = r"\{\{([^{}]*)\}\}"
#: Stands where a call was, within the text around it.
HOLE = "\u0002"


def inner_calls(c: Column) -> Column:
    """What stands between {{ and }}, innermost calls first; of an outer call the inner ones are holes. However deep; what is
    never closed ends the search."""
    bare = F.regexp_replace(c, r"\{\{\{[^{}]*\}\}\}", "")
    none = F.struct(bare.alias("text"), F.array().cast("array<string>").alias("found"), F.lit(False).alias("done"))
    go = lambda s: F.struct(
        F.regexp_replace(s.text, INNERMOST, HOLE).alias("text"), F.concat(s.found, F.regexp_extract_all(s.text, F.lit(INNERMOST), F.lit(1))).alias("found"), (~s.text.rlike(INNERMOST)).alias("done")
    )
    return F.when(bare.contains("{{"), F.aggregate(F.sequence(F.lit(0), call_depth(bare)), none, lambda s, _: F.when(s.done, s).otherwise(go(s)), lambda s: s.found)).otherwise(F.array().cast("array<string>"))


def without_calls(c: Column) -> Column:
    none = F.struct(c.alias("text"), F.lit(False).alias("done"))
    go = lambda s: F.struct(F.regexp_replace(s.text, INNERMOST, "").alias("text"), (~s.text.rlike(INNERMOST)).alias("done"))
    return F.when(c.contains("{{"), F.aggregate(F.sequence(F.lit(0), call_depth(c)), none, lambda s, _: F.when(s.done, s).otherwise(go(s)), lambda s: s.text)).otherwise(c)


def flat_excerpt(c: Column) -> Column:
    """Prose of a piece of markup: no tags, calls or holes; links and addresses are their labels."""
    t = F.regexp_replace(F.translate(without_calls(without_comments(c)), HOLE, ""), r"(?s)<[^>]*>", "")
    t = F.regexp_replace(t, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[\[([^\[\]]*)\]\]", "$1")
    return normal_spaces(F.regexp_replace(t, r"\[(?:https?:)?//[^\s\]]+\s+([^\]]*)\]", "$1"))


def call_parts(raw: Column) -> Column:
    """A call's name and arguments, parted by pipes outside links."""
    masked = F.regexp_replace(raw, r"\|(?=[^\[\]]*\]\])", "\u0003")
    return F.transform(F.split(masked, r"\|"), lambda x: F.translate(x, "\u0003", "|"))


def call_arguments(given: Column) -> Column:
    """(key, value) of arguments in order: keys normalised, `$n` for the n-th unnamed one."""
    unnamed = lambda i: F.size(F.filter(F.slice(given, 1, i + 1), lambda y: ~F.contains(y, F.lit("="))))
    named = lambda x: F.contains(x, F.lit("="))
    return F.transform(
        given,
        lambda x, i: F.struct(
            F.when(named(x), parameter_key(F.substring_index(x, "=", 1))).otherwise(F.concat(F.lit("$"), unnamed(i).cast("string"))).alias("key"),
            F.trim(F.when(named(x), F.regexp_replace(x, r"\A[^=]*=", "")).otherwise(x)).alias("value"),
        ),
    )


_LETTER, _SIGN = r"[\p{IsAlphabetic}\p{N}]", r"[^\p{IsAlphabetic}\p{N}]"


def wordlike(c: Column) -> Column:
    """How many words with a letter or digit."""
    return F.regexp_count(normal_spaces(c), F.lit(f"{_LETTER}[^ ]*+"))


def _at_least(t: Column, n: int, more: str = "") -> Column:
    """Whether a text has n letters or digits, each followed by `more`; read no further than these."""
    return t.rlike(rf"\A(?:{_SIGN}*+{_LETTER}{more}){{{n}}}")


def has_words(t: Column, n: int) -> Column:
    """wordlike() >= n for a text with normal spaces."""
    return _at_least(t, n, "[^ ]*+")


def is_noise(c: Column) -> Column:
    """Passages that say nothing: redirects, few letters, few words, the tail of a citation, or mostly markup."""

    def told(t: Column) -> Column:
        signs = F.char_length(F.regexp_replace(t, r"[^\[\]{}|=<>#*]++", ""))
        tail = t.endswith("</ref>") & ~has_words(t, 5)
        template_tail = t.endswith("}}</ref>") & t.contains("|") & ~has_words(F.substring_index(t, "|", 1), 5)
        few = ~_at_least(t, 10) | (~has_words(t, 3) & ~_at_least(t, 24))
        return (t == "") | F.startswith(ascii_lower(t), F.lit("#redirect")) | few | tail | template_tail | (~has_words(t, 6) & (3 * signs >= 2 * F.char_length(t)))

    return F.coalesce(_once(normal_spaces(c), told), F.lit(True))


def low_signal(heading: Column) -> Column:
    low = ascii_lower(F.coalesce(heading, F.lit("")))
    out = F.lit(False)
    for name in LOW_SIGNAL:
        out = out | low.contains(name)
    return out


def leading_prose(c: Column) -> Column:
    """A passage without the calls, files and categories that it begins with; null where fewer than five words then stay."""
    begins = r"(?i)\A(?:\s*(?:\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}|\[\[(?:file|image|category):(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]))+"
    prose = lambda b: F.when(has_words(b, 5), b)
    return _once(normal_spaces(c), lambda t: F.when(t.rlike(begins), _once(normal_spaces(F.regexp_replace(t, begins, "")), prose)).otherwise(F.nullif(t, F.lit(""))))


def retrieval_key(c: Column) -> Column:
    """A title by which documentation is looked up: underscores are spaces, spaces normalised, ASCII lower case."""
    return ascii_lower(normal_spaces(F.translate(c, "_", " ")))


# Pages of documentation that are an index or reference of their own kind, and kinds by how titles begin.
DOCS_PAGES = {
    "Manual:Hooks": "hooks_index", "Manual:Configuration settings": "config_index", "Help:Extension:ParserFunctions": "parser_reference",
    "Help:Magic words": "magic_word_reference", "Help:Tags": "tag_reference", "Extension:Scribunto/Lua reference manual": "lua_reference",
}
DOCS_BEGINNINGS = [(r"Manual:Hooks/.*\S", "hook_page"), (r"Manual:\$wg", "config_page"), (r"API:.*/Sample code ", "api_example_page"), (r"API:", "api_page"), (r"Manual:", "manual_page"), (r"Extension:", "extension_page"), (r"Help:", "help_page")]


def docs_page_kind(title: Column) -> Column:
    """What a page of documentation is about, by its title: a named reference page, else by how the title begins."""
    named = F.create_map(*[F.lit(x) for pair in DOCS_PAGES.items() for x in pair])
    kind = F.lit("page")
    for beginning, name in reversed(DOCS_BEGINNINGS):
        kind = F.when(title.rlike(rf"\A{beginning}"), name).otherwise(kind)
    return F.coalesce(F.try_element_at(named, title), kind)
