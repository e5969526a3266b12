"""Text queries over documents, pages and conversations (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.functions import text as tx
from slopeline.sources import derived

# Words of the given documents standing in for place and disruption words.
PLACES = ["Enfor", "Thehe", "Sherer", "Estion", "Quever", "Undauf"]
WORDS = ["heron", "tionou", "enlich", "orand", "edthe"]


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w.lower()}')" for w in words) + ")"


@query("h1_h3_h6_text_normalise", sql="""
  SELECT doc_id, md5(replace(replace(lower(text), '-', ' '), '_', ' ')) AS simple_md5,
    md5(regexp_replace(replace(replace(replace(trim(lower(text), ' '), '–', '-'), '—', '-'), '_', ' '),
      '\\s+', ' ', 'g')) AS full_md5,
    nullif(trim(source), '') AS source,
    contains(lower(text), 'the') AND (contains(lower(text), 'ver') OR contains(lower(text), 'eaux'))
      AS two_keyword_match
  FROM documents""")
def normalise(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.md5(tx.normalise_simple(x)).alias("simple_md5"), F.md5(tx.normalise(x)).alias("full_md5"),
        tx.blank_to_null(F.col("source")).alias("source"),
        tx.has_all_groups(x, [["the"], ["ver", "eaux"]]).alias("two_keyword_match"))


ROAD_EVENTS = """
  SELECT h.event_id, s.osm_id, CASE WHEN h.event_id % 4 = 0 THEN 'National Highway '
      || (h.event_id % 25) WHEN h.event_id % 4 = 1 THEN 'nh_' || (h.event_id % 25) || 'A'
      WHEN h.event_id % 4 = 2 THEN s.name ELSE '' END AS nearby, s.name, s.ref
  FROM hazard h JOIN segment s ON s.osm_id = h.affected_segment_id"""


def _road_events(t):
    h, s = derived.hazard(t), derived.segment(t)
    e = F.col("event_id")
    nearby = (F.when(e % 4 == 0, F.concat(F.lit("National Highway "), (e % 25).cast("string")))
              .when(e % 4 == 1, F.concat(F.lit("nh_"), (e % 25).cast("string"), F.lit("A")))
              .when(e % 4 == 2, F.col("name")).otherwise(""))
    return h.join(s, F.col("osm_id") == F.col("affected_segment_id")).select(
        "event_id", "osm_id", nearby.alias("nearby"), "name", "ref")


@query("h4_h5_road_name_match", views="hazard segment", sql=f"""
  WITH e AS ({ROAD_EVENTS}),
  n AS (SELECT *, replace(replace(lower(coalesce(nearby, '')), '-', ' '), '_', ' ') AS src,
          replace(replace(lower(coalesce(name, '')), '-', ' '), '_', ' ') AS nm,
          replace(replace(lower(coalesce(ref, '')), '-', ' '), '_', ' ') AS rf FROM e),
  k AS (SELECT *, list_concat(regexp_extract_all(src, 'nh\\s*(\\d+)', 1),
                              regexp_extract_all(src, 'national\\s+highway\\s+(\\d+)', 1)) AS a,
          list_concat(regexp_extract_all(nm || ' ' || rf, 'nh\\s*(\\d+)', 1),
                      regexp_extract_all(nm || ' ' || rf, 'national\\s+highway\\s+(\\d+)', 1)) AS b FROM n)
  SELECT event_id, osm_id, src <> '' AND nm <> '' AND (contains(src, nm) OR contains(nm, src))
           AS source_road_name_match,
         src <> '' AND rf <> '' AND (contains(src, rf) OR contains(rf, src)) AS source_ref_match,
         len(list_intersect(list_transform(a, lambda x: CAST(x AS INT)),
                            list_transform(b, lambda x: CAST(x AS INT)))) > 0 AS source_nh_match,
         'nh' || array_to_string(list_sort(list_distinct(list_transform(a, lambda x: CAST(x AS INT)))), ',nh')
           AS tokens
  FROM k""")
def road_names(t):
    e = _road_events(t)
    src = tx.normalise_simple(F.col("nearby"))
    both = F.concat_ws(" ", tx.or_empty(F.col("name")), tx.or_empty(F.col("ref")))
    tokens = F.array_join(tx.highway_tokens(F.col("nearby")), ",")
    return e.select(
        "event_id", "osm_id",
        tx.mutual_contains(src, tx.normalise_simple(F.col("name"))).alias("source_road_name_match"),
        tx.mutual_contains(src, tx.normalise_simple(F.col("ref"))).alias("source_ref_match"),
        tx.shares_highway(F.col("nearby"), both).alias("source_nh_match"),
        F.when(tokens == "", "nh").otherwise(tokens).alias("tokens"))


@query("h7_h8_h10_keyword_relevance", sql=f"""
  SELECT doc_id, {_any("text", WORDS)} AS any_keyword,
         {_any("text", PLACES)} AND {_any("text", WORDS)} AS relevant,
         CASE {" ".join(f"WHEN contains(lower(text), '{p.lower()}') THEN '{p}'" for p in PLACES)}
           ELSE '' END AS first_place
  FROM documents""")
def keyword_relevance(t):
    x = F.col("text")
    return t.documents.select("doc_id", tx.has_any(x, WORDS).alias("any_keyword"),
                              tx.relevant(x, PLACES, WORDS).alias("relevant"),
                              tx.first_listed(x, PLACES).alias("first_place"))


NOISE_T, NOISE_S, KEEP = "(?i)(leser|thandhe.*ution|annual report)", "(?i)(/de/|/es/|WFP)", ["estion", "enlich"]


@query("h9_noise_filtered_relevance", sql=f"""
  SELECT page_id, CASE WHEN regexp_matches(html, '{NOISE_T}') THEN false
           WHEN regexp_matches(url, '{NOISE_S}') AND NOT {_any("html", KEEP)} THEN false
           ELSE {_any("html", PLACES)} AND {_any("html", WORDS)} END AS relevant
  FROM pages""")
def noise_relevance(t):
    rel = tx.relevant_report(F.col("html"), F.col("url"), PLACES, WORDS, NOISE_T, NOISE_S, KEEP)
    return t.pages.select("page_id", rel.alias("relevant"))


STRIP_SQL = """regexp_replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
      '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[ \\t]+', ' ', 'g')"""


@query("h11_html_strip", sql=f"SELECT page_id, length(s) AS n_chars, md5(s) AS text_md5 "
                             f"FROM (SELECT page_id, {STRIP_SQL} AS s FROM pages)")
def html_strip(t):
    s = tx.strip_html(F.col("html"))
    return t.pages.select("page_id", s.alias("s")).select(
        "page_id", F.length("s").cast("bigint").alias("n_chars"), F.md5("s").alias("text_md5"))


@query("h12_listing_cards", sql="""
  WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]+)">', 1) AS u,
               regexp_extract_all(html, '(?s)<li><a href="[^"]+">(.*?)</a>', 1) AS t,
               regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS s FROM pages)
  SELECT page_id, i - 1 AS card_no, u[i] AS url, t[i] AS title, s[i] AS summary
  FROM (SELECT *, unnest(generate_series(1, greatest(len(u), len(t), len(s)))) AS i FROM l)""")
def listing_cards(t):
    patterns = {"url": r'<li><a href="([^"]+)">', "title": r'(?s)<li><a href="[^"]+">(.*?)</a>',
                "summary": r"(?s)<p>(.*?)</p>"}
    return (t.pages.select("page_id", F.posexplode(tx.cards(F.col("html"), patterns)).alias("n", "c"))
            .select("page_id", F.col("n").cast("bigint").alias("card_no"), "c.*"))


_TITLE = "regexp_replace(substr(text, 1, 80), '[^A-Za-z0-9 \\n]', '', 'g')"


@query("h12_report_cards", sql=f"""
  WITH c AS (SELECT doc_id, doc_id // 5 AS page, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) - 1 AS card_no,
      trim(regexp_replace({_TITLE}, '[ \\n]+', ' ', 'g')) AS t, source, lang FROM documents WHERE doc_id IS NOT NULL)
  SELECT page, card_no, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS id,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN t = '' THEN 'Road & rail:' ELSE 'Road & rail: ' || t END AS title,
    CASE WHEN doc_id % 11 <> 0 THEN 'https://reports.example/' || doc_id ELSE '' END AS url,
    CASE WHEN doc_id % 3 = 0 THEN '' WHEN t = '' THEN '<b>' || lang || '</b>:' ELSE '<b>' || lang || '</b>: ' || t END AS summary,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN source ELSE source || '|' || lang END AS sources,
    CASE WHEN doc_id % 5 <> 2 THEN '2024-05-' || (10 + doc_id % 20) || 'T00:00:00+00:00' ELSE '' END AS date_published,
    CASE WHEN doc_id % 6 <> 1 THEN '2024-06-' || (10 + doc_id % 20) || 'T00:00:00+00:00' ELSE '' END AS date_posted
  FROM c""")
def report_cards(t):
    """Listing pages of five documents each, some cards without some fields, read back by the operator's own patterns."""
    k = F.col("doc_id")
    words = F.regexp_replace(F.substring("text", 1, 80), r"[^A-Za-z0-9 \n]", "")
    day = (F.lit(10) + k % 20).cast("string")
    link = lambda name: F.concat(F.lit('<li><a href="/organization/1">\n '), name, F.lit(" </a></li>"))
    html = F.concat(
        F.lit('<article class="rw-river-article rw-river-article--report"'), F.when(k % 7 != 0, F.concat(F.lit(' data-id="'), k.cast("string"), F.lit('"'))).otherwise(""),
        F.lit(">"), F.when(k % 11 != 0, F.concat(F.lit('<h3 class="rw-river-article__title"><a href="https://reports.example/'), k.cast("string"),
                                                 F.lit('">Road &amp; rail:\n  '), words, F.lit("</a></h3>"))).otherwise(""),
        F.when(k % 3 != 0, F.concat(F.lit('<div class="rw-river-article__content" lang="en"><div><p>&lt;b&gt;'), F.col("lang"), F.lit("&lt;/b&gt;: "), words,
                                    F.lit("</p><p>more</p></div></div>"))).otherwise(""),
        F.when(k % 4 != 0, F.concat(F.lit('<dd class="rw-entity-meta__tag-value--source"><ul>'), link(F.col("source")),
                                    F.when(k % 4 > 1, link(F.col("lang"))).otherwise(""), F.lit("</ul></dd>"))).otherwise(""),
        F.when(k % 5 != 2, F.concat(F.lit('<dd class="rw-entity-meta__tag-value--published rw-entity-meta__tag-value--date rw-entity-meta__tag-value--last">\n<time datetime="2024-05-'),
                                    day, F.lit('T00:00:00+00:00">'))).otherwise(""),
        F.when(k % 6 != 1, F.concat(F.lit('<dd class="rw-entity-meta__tag-value--posted rw-entity-meta__tag-value--date"><time datetime="2024-06-'),
                                    day, F.lit('T00:00:00+00:00">'))).otherwise(""), F.lit("</article>\n"))
    # five cards at most
    pages = t.documents.where("doc_id IS NOT NULL").groupBy(F.expr("doc_id div 5").alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", html.alias("html")))), lambda x: x["html"]), "").alias("html"))
    page = F.concat(F.lit("<html><body><p>list</p>"), F.col("html"), F.lit("</body></html>"))
    out = pages.select("page", F.posexplode(tx.listing_cards(page)).alias("card_no", "c"))
    return out.select("page", F.col("card_no").cast("bigint").alias("card_no"), "c.id", "c.title", "c.url", "c.summary",
                      F.array_join("c.source", "|").alias("sources"), "c.date_published", "c.date_posted")


@query("h13_evidence_fragments", sql="""
  SELECT doc_id, list_has_all([contains(lower(text), 'the'), true], [false]) = false
           AND contains(lower(text), 'the') AND contains(lower(text), lower('Tion'))
           AND contains(lower(text), lang) AS all_present,
    CASE WHEN contains(lower(text), 'the') THEN 0 ELSE 1 END
    + CASE WHEN contains(lower(text), 'tion') THEN 0 ELSE 1 END
    + CASE WHEN contains(lower(text), lang) THEN 0 ELSE 1 END AS n_missing
  FROM documents""")
def fragments(t):
    frags = F.array(F.lit("the"), F.lit("Tion"), F.col("lang"))
    return t.documents.select("doc_id", tx.contains_all_fragments(F.col("text"), frags).alias("all_present"),
                              F.size(tx.missing_fragments(F.col("text"), frags)).alias("n_missing"))


TERMS = {"the": r"(?i)\bthe\b", "ver": r"(?i)\bver(?:e|ed|ing)\b", "number": r"\b300\b|\bthree hundred\b",
         "que": r"(?i)\bque\b"}
# the SQL twin spells out Unicode word boundaries
EDGE = r"(?:^|$|[^\p{L}\p{N}_])"
FIRST = [r"(?i)ution\s*[-–—]\s*ver", r"(?i)le\s+la", r"(?i)der\s+die", r"(?i)\bthe\b"]


@query("h14_term_presence", sql=f"""
  SELECT doc_id, {", ".join(f"regexp_matches(text, '{p}') AS has_{n}".replace(chr(92) + "b", EDGE) for n, p in TERMS.items())},
    CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 0)" for p in FIRST)}
      END AS matched_text
  FROM documents""")
def term_presence(t):
    x = F.col("text")
    df = t.documents.select("doc_id", tx.term_presence(x, TERMS).alias("m"),
                            tx.first_pattern(x, FIRST).alias("f"))
    return df.select("doc_id", *[F.col("m")[n].alias(f"has_{n}") for n in TERMS],
                     F.col("f.matched_text").alias("matched_text"))


@query("h15_context_snippets", sql="""
  WITH RECURSIVE m AS (
    SELECT doc_id, text, term, ord, instr(lower(text), term) AS p
    FROM documents, (VALUES ('estion', 1), ('enlich', 2), ('tionou', 3)) v(term, ord)
    WHERE contains(lower(text), term)
    UNION ALL
    SELECT doc_id, text, term, ord, p + length(term) - 1 + instr(substr(lower(text), p + length(term)), term)
    FROM m WHERE contains(substr(lower(text), p + length(term)), term)),
  s AS (SELECT doc_id, term, ord, p, trim(substr(text, greatest(p - 180, 1),
          p - 1 + length(term) + 300 - greatest(p - 181, 0)), ' ') AS snippet FROM m),
  d AS (SELECT doc_id, snippet, min({'o': ord, 'p': p}) AS k FROM s WHERE snippet <> '' GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM d)
  SELECT doc_id, n - 1 AS snippet_no, md5(snippet) AS snippet_md5, length(snippet) AS n_chars
  FROM r WHERE n <= 12""")
def context_snippets(t):
    found = tx.snippets(F.col("text"), ["estion", "enlich", "tionou"])
    return (t.documents.select("doc_id", F.posexplode(found).alias("n", "s"))
            .select("doc_id", F.col("n").cast("bigint").alias("snippet_no"),
                    F.md5("s.snippet").alias("snippet_md5"),
                    F.length("s.snippet").cast("bigint").alias("n_chars")))


@query("e23_header_carry_forward", sql="""
  WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-E]') THEN pos END AS hp FROM l),
  c AS (SELECT *, max(hp) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM h)
  SELECT c.doc_id, md5(trim(x.line, ' ')) AS header_md5, md5(trim(c.line, ' ')) AS line_md5
  FROM c JOIN l x ON x.doc_id = c.doc_id AND x.pos = c.head
  WHERE c.hp IS NULL AND trim(c.line, ' ') <> ''""")
def header_blocks(t):
    blocks = tx.dated_blocks(F.col("text"), r"(?m)^[A-E][^\n]*$")
    return (t.documents.select("doc_id", F.explode(blocks).alias("b"))
            .select("doc_id", F.md5("b.header").alias("header_md5"), F.explode("b.lines").alias("line"))
            .select("doc_id", "header_md5", F.md5("line").alias("line_md5")))


@query("h16_segment_identity", views="segment", sql="""
  SELECT osm_id, 'rseg-' || substr(sha256('v1|' || osm_id || '|' || sha256(ref || ':' || highway)), 1, 24)
    AS road_segment_id FROM segment""")
def segment_identity(t):
    geo = F.sha2(F.concat_ws(":", "ref", "highway"), 256)
    return derived.segment(t).select(
        "osm_id", tx.segment_id(F.lit("v1"), F.col("osm_id"), geo).alias("road_segment_id"))


@query("h17_schema_hash", sql="""
  SELECT lang, sha256('["' || array_to_string(list_sort(list(DISTINCT source)), '","') || '"]') AS schema_hash
  FROM documents GROUP BY lang""")
def schema_hash(t):
    return t.documents.select("lang", "source").distinct().groupBy("lang").agg(
        tx.schema_hash(F.sort_array(F.collect_list("source"))).alias("schema_hash"))


@query("h18_observation_id", views="hazard", sql="""
  SELECT event_id, 'obs_' || strftime(event_time, '%Y_%m_%d') || '_road_' || affected_segment_id
    || '_' || event_type AS observation_id FROM hazard""")
def observation_ids(t):
    label = F.concat(F.lit("Road #"), F.col("affected_segment_id").cast("string"), F.lit(" -- "),
                     F.initcap("event_type"), F.lit("!"))
    return derived.hazard(t).select(
        "event_id", tx.observation_id("obs", F.col("event_time"), label).alias("observation_id"))


URL_CLASSES = {"en": ["/en/"], "romance": ["/fr/", "/es/"], "query": ["?page", "ref="], "top": ["#top"]}


@query("h19_keyword_categories", sql=f"""
  SELECT page_id, concat_ws(',', {", ".join(
      f"CASE WHEN {_any('url', w)} THEN '{c}' END" for c, w in URL_CLASSES.items())}) AS categories
  FROM pages""")
def keyword_categories(t):
    return t.pages.select("page_id", F.array_join(tx.categories(F.col("url"), URL_CLASSES), ",")
                          .alias("categories"))
