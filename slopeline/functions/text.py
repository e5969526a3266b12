"""Text normalisation, road-number tokens, keyword evidence, HTML and report extraction.

All functions are column expressions over whole texts; lists of words and patterns are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from slopeline.functions.geo import let

# Road and disruption words of the relevance filter.
ROAD_KEYWORDS = [
    "road", "highway", "nh-", "nh ", "nh27", "nh37", "nh29", "nh13", "nh6",
    "nh2", "nh10", "blocked", "blockade", "washed away", "washout", "cut off",
    "landslide", "flood", "bridge", "roadway", "arterial",
]
# The states of the region, in list order.
STATES = ["Arunachal Pradesh", "Assam", "Manipur", "Meghalaya",
          "Mizoram", "Nagaland", "Sikkim", "Tripura"]
# Words that keep a brief from a noisy source.
OVERRIDE_WORDS = ["landslide", "flood", "washed", "blocked", "nh-", " nh"]
# Titles and sources of programme briefs.
NOISE_TITLE = (r"(?i)(country brief|factsheet|fact sheet"
               r"|situation report.*(funding snapshot|response and funding)"
               r"|appeal|early recovery|rehabilitation|strategic roadmap|gender-based"
               r"|protection monitoring|food security|country strategy|annual report)")
NOISE_SOURCE = r"(?i)(WFP|UNHCR|UN Women|OCHA|IFRC|Amnesty International)"
# Keyword classes of file and source names.
CATEGORY_WORDS = {
    "hazard": ["hazard", "risk", "vulnerability", "susceptibility"],
    "incident": ["incident", "event", "disruption", "landslide", "flood", "collapse", "damage",
                 "road_block"],
    "weather": ["rain", "rainfall", "weather", "temperature", "humidity", "wind", "precip"],
    "terrain": ["slope", "elevation", "terrain", "dem", "aspect", "geology"],
    "traffic": ["traffic", "congestion", "speed", "travel_time", "delay"],
}
# Pattern of road references and of disruption words in report pages.
ROAD_REFERENCE = r"(?i)NH\s?[-–]?\s?\d+[A-Z]?|National\s+Highway\s*\d+[A-Z]?"
DISRUPTION = (r"(?i)highway|road|washed (?:away|out)|cut off|blocked|breach|landslide|slide"
              r"|flash flood|inundat|submerg")
# First line of a dated block in a status report.
DATED_HEADER = r"(?im)^[ \t]*Date:\s*\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+[-\s]\d{4}.*$"
# The start of a card in a report listing, and the patterns of its fields.
CARD_START = r'<article class="rw-river-article'
CARD_ID = r'<article class="rw-river-article[^"]*" data-id="(\d+)"'
CARD_LINK = r'(?s)rw-river-article__title"[^>]*><a href="([^"]+)">(.*?)</a>'
CARD_SUMMARY = r'(?s)rw-river-article__content" lang="en">.*?<p>(.*?)</p>'
CARD_SOURCES = r"(?s)rw-entity-meta__tag-value--source.*?</ul>"
CARD_SOURCE = r'/organization/[^"]+">([^<]+)</a>'
CARD_PUBLISHED = (r"rw-entity-meta__tag-value--published rw-entity-meta__tag-value--date "
                  r'rw-entity-meta__tag-value--last">\s*<time datetime="([^"]+)"')
CARD_POSTED = r'rw-entity-meta__tag-value--posted rw-entity-meta__tag-value--date">\s*<time datetime="([^"]+)"'


def or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def normalise_simple(x: Column) -> Column:
    """Lower case, hyphens and underscores as spaces."""
    return F.translate(F.lower(or_empty(x)), "-_", "  ")


def normalise(x: Column, slash: bool = False) -> Column:
    """Trimmed lower case, long dashes as hyphens, underscores (and slashes) as spaces, single spaces."""
    t = F.translate(F.lower(F.trim(or_empty(x))), "–—_" + ("/" if slash else ""), "-- " + (" " if slash else ""))
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(t) if slash else t


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def mutual_contains(a: Column, b: Column) -> Column:
    """Either text contains the other; empty text never matches."""
    a, b = or_empty(a), or_empty(b)
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))


def highway_tokens(x: Column) -> Column:
    """Distinct 'nhN' tokens; a letter after the number is dropped."""
    plain = normalise_simple(x)
    short = F.regexp_extract_all(plain, F.lit(r"nh\s*(\d+)"), F.lit(1))
    long = F.regexp_extract_all(plain, F.lit(r"national\s+highway\s+(\d+)"), F.lit(1))
    strip = lambda n: F.concat(F.lit("nh"), F.regexp_replace(n, r"^0+(?=\d)", ""))
    return F.array_sort(F.array_distinct(F.transform(F.concat(short, long), strip)))


def shares_highway(a: Column, b: Column) -> Column:
    return F.arrays_overlap(highway_tokens(a), highway_tokens(b))


def has_any(x: Column, words: Sequence[str]) -> Column:
    """Any word occurs, ignoring case: one alternation, scanned once."""
    import re
    return or_empty(x).rlike("(?i)" + "|".join(re.escape(w) for w in words))


def has_all_groups(x: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Every group has at least one of its spellings in the text."""
    out = F.lit(True)
    for g in groups:
        out = out & has_any(x, g)
    return out


def relevant(x: Column, places: Sequence[str], words: Sequence[str] = ROAD_KEYWORDS) -> Column:
    return has_any(x, places) & has_any(x, words)


def relevant_report(blob: Column, url: Column, places: Sequence[str],
                    words: Sequence[str] = ROAD_KEYWORDS, noise_title: str = NOISE_TITLE,
                    noise_source: str = NOISE_SOURCE,
                    override: Sequence[str] = OVERRIDE_WORDS) -> Column:
    """Relevance with noise: a noisy title rejects, a noisy source rejects unless overridden."""
    b = or_empty(blob)
    return (F.when(b.rlike(noise_title), False)
            .when(or_empty(url).rlike(noise_source) & ~has_any(b, override), False)
            .otherwise(relevant(b, places, words)))


def first_listed(x: Column, names: Sequence[str], whole: bool = True) -> Column:
    """First name in list order found in the text, else ''. ``whole=False`` looks for its first word."""
    low = F.lower(or_empty(x))
    return F.coalesce(*[F.when(low.contains((n if whole else n.split()[0]).lower()), n) for n in names],
                      F.lit(""))


def categories(x: Column, table: dict[str, list[str]] = CATEGORY_WORDS) -> Column:
    return F.array_compact(F.array(*[F.when(has_any(x, ws), c) for c, ws in table.items()]))


def unescape_html(x: Column) -> Column:
    """Character references in one left-to-right pass, so '&amp;lt;' becomes '&lt;'."""
    named = F.create_map(*[F.lit(v) for n, cp in sorted(name2codepoint.items()) for v in (n, chr(cp))])

    def char(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substr(p, F.length(ref) + 2)
        number = (F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10))
                  .when(ref.startswith("#"), F.substr(ref, F.lit(2)))).cast("bigint")
        value = F.when(number.isNotNull(), F.when(number.between(1, 0x10FFFF), char(number))).otherwise(
            F.try_element_at(named, ref))
        return F.when(value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(or_empty(x), "&", -1)
    return F.when(~or_empty(x).contains("&"), or_empty(x)).otherwise(
        F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), "")))


def strip_html(x: Column) -> Column:
    """Text of a page: script and style blocks and tags out, references decoded, blanks collapsed."""
    t = F.regexp_replace(or_empty(x), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.regexp_replace(unescape_html(t), r"[ \t]+", " ")


def cards(html: Column, patterns: dict[str, str]) -> Column:
    """Array of structs: the i-th capture of every pattern belongs to card i; short lists pad with NULL."""
    found = [F.regexp_extract_all(or_empty(html), F.lit(p), F.lit(1)).alias(n) for n, p in patterns.items()]
    return F.arrays_zip(*found)


def plain_line(x: Column) -> Column:
    """Inner HTML as one line: blanks collapsed, references decoded, ends trimmed."""
    return F.regexp_replace(unescape_html(F.regexp_replace(x, r"(?U)\s+", " ")), r"(?U)^\s+|\s+$", "")


def listing_cards(html: Column) -> Column:
    """Array of the cards of a report listing: id, title, url, summary, source (a list), date_published and
    date_posted.

    The page is cut where cards start and every field is looked for inside its own card, so a field that one
    card lacks (an empty text or list, a NULL id) cannot move those of the others. Each field is the first
    match in its card; title and url come from one match.
    """
    def card(c: Column) -> Column:
        sources = F.regexp_extract_all(F.regexp_extract(c, CARD_SOURCES, 0), F.lit(CARD_SOURCE), F.lit(1))
        return F.struct(
            F.nullif(F.regexp_extract(c, CARD_ID, 1), F.lit("")).try_cast("bigint").alias("id"),
            plain_line(F.regexp_extract(c, CARD_LINK, 2)).alias("title"), F.regexp_extract(c, CARD_LINK, 1).alias("url"),
            plain_line(F.regexp_extract(c, CARD_SUMMARY, 1)).alias("summary"), F.transform(sources, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).alias("source"),
            F.regexp_extract(c, CARD_PUBLISHED, 1).alias("date_published"), F.regexp_extract(c, CARD_POSTED, 1).alias("date_posted"))

    pieces = F.split(or_empty(html), f"(?={CARD_START})", -1)
    return F.transform(F.filter(pieces, lambda c: c.startswith(CARD_START)), card)


def contains_all_fragments(block: Column, fragments: Column) -> Column:
    low = F.lower(or_empty(block))
    return F.forall(fragments, lambda f: low.contains(F.lower(f)))


def missing_fragments(block: Column, fragments: Column) -> Column:
    low = F.lower(or_empty(block))
    return F.filter(fragments, lambda f: ~low.contains(F.lower(f)))


def term_presence(x: Column, patterns: dict[str, str]) -> Column:
    t = or_empty(x)
    # (?U): word boundaries and classes follow Unicode, whatever the Java version
    return F.create_map(*[c for n, p in patterns.items() for c in (F.lit(n), t.rlike("(?U)" + p))])


def first_pattern(x: Column, patterns: Sequence[str]) -> Column:
    """Struct (pattern, matched_text) of the first pattern in list order that matches."""
    t = or_empty(x)
    return F.coalesce(*[
        F.when(t.rlike("(?U)" + p), F.struct(
            F.lit(p).alias("pattern"), F.regexp_extract(t, "(?U)" + p, 0).alias("matched_text")))
        for p in patterns])


def match_spans(x: Column, pattern: str) -> Column:
    """Array of (start, stop) zero-based offsets of all matches, from the text between matches."""
    t = or_empty(x)
    between = F.transform(F.split(t, pattern, -1), lambda s: F.length(s))
    inside = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda s: F.length(s))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    steps = F.filter(F.zip_with(between, inside, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                     lambda s: s["b"].isNotNull())

    def step(acc, s):
        start = acc["at"] + s["a"]
        stop = start + s["b"]
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]


def snippets(x: Column, patterns: Sequence[str], before: int = 180, after: int = 300,
             limit: int = 12) -> Column:
    """First ``limit`` distinct contexts around matches, term by term, as (term, snippet)."""
    t = or_empty(x)
    found = []
    for p in patterns:
        def cut(s, term=p):
            lo = F.greatest(s["start"] - before, F.lit(0))
            return F.struct(F.lit(term).alias("term"),
                            F.trim(F.substr(t, lo + 1, s["stop"] + after - lo)).alias("snippet"))
        found.append(F.transform(match_spans(t, f"(?i){p}"), cut))
    every = F.filter(F.concat(*found), lambda s: F.length(s["snippet"]) > 0)

    def chosen(every: Column) -> Column:
        # bound once: the matches are not searched for again for each snippet
        return let(F.transform(every, lambda s: s["snippet"]), lambda texts: F.transform(
            F.slice(F.array_distinct(texts), 1, limit), lambda s: F.element_at(every, F.array_position(texts, s).cast("int"))))

    return let(every, chosen)


def dated_blocks(x: Column, header: str = DATED_HEADER) -> Column:
    """Array of (header, lines): lines belong to the last header above them.

    Text before the first header is dropped; lines are trimmed and blank ones removed.
    """
    t = or_empty(x)
    heads = F.regexp_extract_all(t, F.lit(header), F.lit(0))
    bodies = F.slice(F.split(t, header, -1), 2, F.size(F.split(t, header, -1)))
    return F.zip_with(heads, bodies, lambda h, b: F.struct(
        F.trim(h).alias("header"),
        F.filter(F.transform(F.split(b, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
        .alias("lines")))


def segment_id(version: Column, source_id: Column, geometry_hash: Column, prefix: str = "rseg-") -> Column:
    """Deterministic segment id: 24 hex digits of the hash of version, source id and geometry hash."""
    key = F.concat_ws("|", version, source_id.cast("string"), geometry_hash)
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 24))


def schema_hash(names: Column) -> Column:
    """Hash of the compact JSON list of feature names."""
    return F.sha2(F.to_json(names), 256)


def observation_id(prefix: str, day: Column, label: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat_ws("_", F.lit(prefix), F.date_format(day, "yyyy_MM_dd"), slug)
