"""Queries over records, URLs, pages and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import base64url_bytes
from ..operators import dedup, incremental, sinks
from ..sources import dump, zstd_lines
from ..sources.files import scraped, table
from ..storage import fresh_path
from .base import query

# A raw line of each document: the kinds that the rules tell apart follow from the id.
_LINE_FIELDS = {
    "url": """concat('"', element_at(array(concat('http://imgur.com/k', doc_id), concat('https://x.com/', doc_id, '.png'), concat('https://x.com/', doc_id, '.html'),
              concat('https://youtu.be/k', doc_id), concat('https://i.x.com/', doc_id, '?a=1&amp;b=2')), cast(doc_id % 5 + 1 as int)), '"')""",
    "over_18": "if(doc_id % 11 = 0, 'true', 'false')",
    "title": "substr(to_json(named_struct('t', coalesce(text, ''))), 6, length(to_json(named_struct('t', coalesce(text, '')))) - 6)",
    "author": """CASE WHEN doc_id % 13 = 0 THEN '"[deleted]"' WHEN doc_id % 17 = 0 THEN 'null' ELSE concat('"u', doc_id, '"') END""",
    "selftext": """if(doc_id % 7 = 0, '"body"', '""')""",
    "subreddit": """if(doc_id % 31 = 0 OR lang IS NULL, 'null', concat('"', lang, '"'))""",
    "created_utc": """CASE WHEN doc_id % 19 = 0 THEN '"soon"' WHEN doc_id % 4 = 0 THEN concat('', 1600000000 + doc_id) WHEN doc_id % 4 = 1 THEN concat('"', 1600000000 + doc_id, '"')
                      WHEN doc_id % 4 = 2 THEN concat(1600000000 + doc_id, '.9') ELSE concat('"', 1600000000 + doc_id, '.75"') END""",
    "id": """concat('"d', doc_id, '"')""",
}


def document_lines(documents):
    """``value``: a raw line of each document; some are broken, promoted, without an author, or hold a zero byte."""
    line = F.concat(F.lit("{"), *[x for k, e in _LINE_FIELDS.items() for x in (F.lit(f'"{k}":'), F.expr(e), F.lit(","))])
    hint = F.when(F.col("doc_id") % 6 < 2, "").when(F.col("doc_id") % 6 < 4, '"post_hint":"image",').when(F.col("doc_id") % 6 == 4, '"post_hint":null,').otherwise('"post_hint":"link",')
    line = F.concat(line, hint, F.when(F.col("doc_id") % 29 == 0, '"promoted":true,').otherwise(""), F.lit('"score":1}'), F.when(F.col("doc_id") % 37 == 0, F.char(F.lit(0))).otherwise(""))
    return documents.select(F.when(F.col("doc_id") % 23 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def _written(lines, spark):
    """The lines as Zstandard files with windows of 2^30 bytes, in several frames, of which the first file is cut off."""
    folder = fresh_path(spark, "dump")
    zstd_lines.write_zstd_lines(lines, folder, window_log=30, frame_rows=100, broken_end=600_000).agg(F.sum("lines")).collect()
    return folder


def _lines(spark, sf_dir):
    return zstd_lines.read_zstd_lines(spark, _written(document_lines(table(spark, sf_dir, "documents")), spark), split_bytes=1 << 20)


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents")
def long_window_lines(spark, sf_dir):
    """Lines written with windows of 2^30 bytes and read back; a file is read by several tasks, and the cut one up to its last line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    folder = _written(d.select(F.to_json(F.struct("doc_id", "text")).alias("value")), spark)
    back = zstd_lines.read_zstd_lines(spark, folder, split_bytes=1 << 20).select(F.from_json("value", "doc_id long, text string").alias("r")).select("r.*")
    return back.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


_PARSED = "doc_id % 13 <> 0 AND doc_id % 29 <> 0 AND doc_id % 37 <> 0 AND doc_id % 23 <> 0 AND doc_id % 19 <> 0"


@query(f"""
    SELECT 'd' || doc_id AS id, 1600000000 + doc_id AS ts, CASE WHEN doc_id % 6 < 2 THEN 'na' WHEN doc_id % 6 < 4 THEN 'image' WHEN doc_id % 6 = 5 THEN 'link' END AS post_hint,
           md5(coalesce(text, '')) AS title_md5 FROM documents WHERE {_PARSED}""")
def line_reject_parse(spark, sf_dir):
    return dump.parse(_lines(spark, sf_dir)).select("id", F.col("timestamp").alias("ts"), "post_hint", F.md5("title").alias("title_md5"))


@query(f"""
    SELECT 'd' || doc_id AS id, md5(coalesce(text, '')) AS title_md5, lang AS subreddit, 'u' || doc_id AS author, 1600000000 + doc_id AS timestamp,
           CASE doc_id % 5 WHEN 0 THEN 'https://i.imgur.com/k' || doc_id || '.jpg' WHEN 1 THEN 'https://x.com/' || doc_id || '.png'
             WHEN 3 THEN 'https://i.ytimg.com/vi/k' || doc_id || '/maxresdefault.jpg' ELSE 'https://i.x.com/' || doc_id || '?a=1&b=2' END AS url
    FROM documents WHERE {_PARSED} AND doc_id > 50 AND doc_id % 5 <> 2 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 <> 0 AND doc_id % 31 <> 0 AND lang IS NOT NULL AND doc_id % 6 < 4""")
def accepted_entries(spark, sf_dir):
    """The whole chain from lines to what is fetched, resumed after 1600000050."""
    out = dump.projected(dump.accept(dump.parse(_lines(spark, sf_dir)), 1600000050))
    return out.withColumn("title_md5", F.md5("title")).drop("title")


@query(r"""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    WHERE NOT regexp_matches(props, '"k": ?1[0-9]\b') AND json_extract_string(props, '$.k') IS NOT NULL""")
def props_filter(spark, sf_dir):
    """Raw text is filtered before it is parsed."""
    e = table(spark, sf_dir, "events").filter(~F.col("props").rlike(r'"k": ?1[0-9]\b'))
    k = F.from_json("props", "k long")["k"]
    return e.select("event_id", k.alias("k")).filter("k IS NOT NULL")


@query("""
    SELECT page_id, replace(CASE WHEN starts_with(url, 'http://') THEN 'https://' || substring(url, 8) ELSE url END, '&amp;', '&') AS url FROM pages""")
def url_normalise(spark, sf_dir):
    """No page is of a host with rules of its own; those are in ``url_rewrite_cases``."""
    return table(spark, sf_dir, "pages").select("page_id", T.url_rewritten(F.col("url")).alias("url"))


# A URL and what it becomes, around a page's number.
URLS = [
    ("http://imgur.com/A{}", "https://i.imgur.com/A{}.jpg"), ("http://imgur.com/A{},Cd2", "https://i.imgur.com/A{}Cd2.jpg"),
    ("https://www.imgur.com/Z{}", "https://i.imgur.com/Z{}.jpg"), ("https://m.imgur.com/Z{}", "https://i.imgur.com/Z{}.jpg"),
    ("https://youtu.be/k_{}-x", "https://i.ytimg.com/vi/k_{}-x/maxresdefault.jpg"), ("https://www.youtube.com/watch?v=a{}&amp;t=1", "https://i.ytimg.com/vi/a{}/maxresdefault.jpg"),
    ("https://youtube.com/embed/a{}?x=1", "https://i.ytimg.com/vi/a{}/maxresdefault.jpg?x=1"), ("https://a.b/{}.png?x=1&amp;y=2", "https://a.b/{}.png?x=1&y=2"),
    ("https://imgur.com/a/{}", "https://imgur.com/a/{}"),
]


@query("SELECT page_id, CASE page_id % " + str(len(URLS)) + " " + " ".join(f"WHEN {k} THEN replace('{b}', '{{}}', CAST(page_id AS VARCHAR))" for k, (_, b) in enumerate(URLS)) + " END AS rewritten FROM pages")
def url_rewrite_cases(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(a) for a, _ in URLS]), (F.col("page_id") % len(URLS) + 1).cast("int"))
    url = F.replace(form, F.lit("{}"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.url_rewritten(url).alias("rewritten"))


@query("""
    WITH u AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/a.JPG' WHEN 1 THEN '/b.gifv' WHEN 2 THEN '/i/c' WHEN 3 THEN '/rss/d.png' ELSE '' END AS u FROM pages)
    SELECT page_id FROM u
    WHERE len(list_filter(['.htm', '.php', '?articleid=', '.asp', '.xml', '/rss/', '//vimeo.com', '//v.redd.it', 'youtube.com/user/'], lambda x: contains(u, x))) = 0
      AND NOT ends_with(u, '.gifv') AND NOT contains(u, '//reddit.com/') AND NOT contains(u, '//www.reddit.com/')
      AND len(list_filter(['jpg', 'jpeg', 'png', 'webp', '.gif', '=gif', 'bmp', 'tiff', 'avif', 'imgur', 'image', '//i.', 'img', 'cdn.', 'media.', '/i/', '/media', 'youtu.be', 'youtube.com'], lambda x: contains(lower(u), x))) > 0""")
def url_filter(spark, sf_dir):
    end = F.get(F.array(*[F.lit(e) for e in ("/a.JPG", "/b.gifv", "/i/c", "/rss/d.png", "")]), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").filter(T.url_accepted(F.concat("url", end))).select("page_id")


@query(r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""")
def html_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"))


@query(r"""
    SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, sf_dir):
    """Every match of a pattern as a row."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(scraped(F.col("html"), '<a href="([^"]*)"', "href")).alias("m")).select("page_id", "m.href")


@query("""
    SELECT page_id, CASE WHEN page_id % 5 IN (0, 1) AND page_id % 3 <> 0 THEN 'https://i.imgur.com/' || md5(html) || '.jpg'
                         WHEN page_id % 5 = 2 THEN 'https://preview/' || page_id END AS target FROM pages""")
def html_rule_cases(spark, sf_dir):
    """The first rule that knows the URL reads the whole page; a page without the tag, or of another site, has no target."""
    p = table(spark, sf_dir, "pages").withColumn("ident", F.col("page_id").cast("string"))
    forms = ["https://imgur.com/a/x", "https://imgur.com/gallery/x", "https://www.reddit.com/gallery/x", "https://x.com/p", "https://imgur.com/x"]
    url = F.concat(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("page_id") % 5 + 1).cast("int")), "ident")
    tag = F.concat(F.lit('<meta name="twitter:image" data-react-helmet="true" content="https://i.imgur.com/'), F.md5("html"), F.lit('.jpg">'))
    figure = F.concat(F.lit('<li style="left:0px" class="_28TEYBuEdOuE3kN6UyoKMa"><figure class="_3BxRNDoASi9FbGX01ewiLg _3o5Vzct5tn9PE7e-emdDmf"><a href="https://preview/'), "ident", F.lit('" rel="noopener noreferrer" target="_blank"'))
    html = F.concat("html", F.when(F.col("page_id") % 3 != 0, tag).otherwise(F.lit("")), figure)
    return p.select("page_id", T.html_target(url, html).alias("target"))


@query("""
    WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html; charset=utf-8' ELSE 'video/mp4' END AS kind, octet_length(encode(html)) * 1000 AS size FROM pages)
    SELECT page_id FROM p WHERE (kind = 'image/png' OR (kind LIKE 'text/html%' AND page_id % 2 = 0)) AND size <= 16777216""")
def content_filter(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8").otherwise("video/mp4")
    p = table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), (F.octet_length("html") * 1000).alias("size"))
    return p.filter(T.content_accepted(F.col("kind"), F.col("size"), F.col("page_id") % 2 == 0)).select("page_id")


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 100 = 0)")
def hash_discard(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.filter("doc_id % 100 = 0").select(F.md5("text").alias("digest")).distinct()
    return dedup.discard_known(d, known, "text").select("doc_id")


@query("""
    SELECT page_id FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0 AND url LIKE 'https://%' AND NOT (url LIKE '%.mp4' OR url LIKE '%.mkv' OR url LIKE '%.webm')
      AND page_id % 3 <> 2 AND page_id % 7 <> 0 AND octet_length(encode(html)) * 2000 <= 8000000 AND page_id >= 5""")
def crawl_filter(spark, sf_dir):
    """What is fetched, what of it is kept, and where the crawl stops."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    kind = F.when(n % 3 == 0, "image/png").when(n % 3 == 1, "image/avif").otherwise("image/gif")
    size = F.when(n % 7 != 0, F.octet_length("html") * 2000)
    p = p.filter(T.crawl_accepted(n % 4 == 0, n % 5 != 0, F.lit(True), F.col("url")))
    return p.filter(T.crawl_kept(kind, size) & T.crawl_going_on(n, F.lit(5))).select("page_id")


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE ('0x' || substring(sha256(CAST(doc_id AS VARCHAR)), 1, 2))::INTEGER / 255.0 < 0.1")
def val_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    return d.filter(T.validation_row(F.col("name")))


@query("""
    SELECT doc_id, 'https://reddit.com/r/' || source || '/comments/' || doc_id AS link, substring(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS bucket,
           regexp_replace(source || '/' || lang || '.x', '[^A-Za-z0-9-]', '_', 'g') AS safe FROM documents""")
def record_names(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.permalink(F.col("source"), ident).alias("link"), T.bucket_of(ident).alias("bucket"),
        T.safe_name(F.concat("source", F.lit("/"), "lang", F.lit(".x"))).alias("safe"),
    )


@query("""
    WITH d AS (SELECT doc_id, source || CASE doc_id % 7 WHEN 0 THEN '-2' WHEN 1 THEN '-5' ELSE '' END AS name FROM documents),
    r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n FROM d),
    names AS (SELECT DISTINCT name FROM d),
    free AS (SELECT b.name, s, row_number() OVER (PARTITION BY b.name ORDER BY s) + 1 AS n FROM names b, range(2, 20000) t(s) LEFT JOIN names o ON o.name = b.name || '-' || s WHERE o.name IS NULL)
    SELECT doc_id, CASE WHEN r.n = 1 THEN r.name ELSE r.name || '-' || s END AS unique_name FROM r LEFT JOIN free ON r.name = free.name AND r.n = free.n""")
def unique_names(spark, sf_dir):
    """Some rows already have names that suffixes would make."""
    end = F.when(F.col("doc_id") % 7 == 0, "-2").when(F.col("doc_id") % 7 == 1, "-5").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", end).alias("name"))
    return incremental.unique_names(d, "name", "doc_id").select("doc_id", "unique_name")


def _entries(spark, sf_dir):
    """Documents as processed entries."""
    n = F.col("doc_id")
    size = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"))
    meta = F.struct(F.lit("image/png").alias("mime_type"), F.col("n_chars").alias("original_file_size"), size.alias("dimension"), F.concat(F.lit("https://i/"), n).alias("final_url"))
    return table(spark, sf_dir, "documents").select("doc_id"), {
        "url": F.concat(F.lit("https://x/"), n), "id": n.cast("string"), "title": F.col("source"), "subreddit": F.col("lang"), "author": F.concat(F.lit("u"), n % 9),
        "timestamp": F.col("n_chars") * 1000, "embedding": F.array(F.lit(1.0), F.lit(-0.5)).cast("array<float>"), "metadata": meta,
    }


@query("""
    SELECT doc_id, '{"url":"https://x/' || doc_id || '","id":"' || doc_id || '","title":"' || source || '","subreddit":"' || lang || '","author":"u' || (doc_id % 9)
      || '","timestamp":' || (n_chars * 1000) || ',"embedding":[1.0,-0.5],"metadata":{"mime_type":"image/png","original_file_size":' || n_chars
      || ',"dimension":{"width":640,"height":480},"final_url":"https://i/' || doc_id || '"}}' AS line FROM documents""")
def printed_json(spark, sf_dir):
    entry = _entries(spark, sf_dir)[1]
    return table(spark, sf_dir, "documents").select("doc_id", sinks.printed("json", entry).alias("line"))


@query("""
    SELECT doc_id, strftime(make_timestamp(n_chars * 1000 * 1000000), '%Y-%m-%d %H:%M:%S UTC ') || source || ' https://reddit.com/r/' || lang || '/comments/' || doc_id || ' https://i/' || doc_id AS record,
           'https://x/' || doc_id AS url, source AS title, '?e=ADwAuA==' AS embedding FROM documents""")
def printed_lines(spark, sf_dir):
    """The other kinds of line; 1 and -0.5 in half precision are 00 3C and 00 B8."""
    entry = _entries(spark, sf_dir)[1]
    kinds = ("record", "url", "title", "embedding")
    return table(spark, sf_dir, "documents").select("doc_id", *[sinks.printed(k, entry).alias(k) for k in kinds])


@query("SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS sequence FROM documents")
def sequenced_dump(spark, sf_dir):
    """Numbered parts of a dump, one of them written twice, read back."""
    at = fresh_path(spark, "dump")
    d = table(spark, sf_dir, "documents").select("doc_id")
    for k in (0, 1, 2, 1):
        sinks.append_dump(d.filter(F.col("doc_id") % 3 == k), at, k)
    return spark.read.parquet(at).select("doc_id", F.col("sequence").cast("int").alias("sequence"))


@query("""
    WITH s AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(turn ORDER BY turn) FILTER (WHERE turn % 3 <> 2) AS r FROM conversations GROUP BY conv_id),
    k AS (SELECT conv_id, t, r, unnest(range(1, least(len(t), len(r)) + 1)) AS i FROM s)
    SELECT conv_id, i - 1 AS pos, t[i] AS text, r[i] AS region FROM k""")
def text_regions(spark, sf_dir):
    """Texts zipped with their regions, of which some are missing."""
    by_turn = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda x: x)
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(by_turn(F.lit(True)).alias("a"), by_turn(F.col("turn") % 3 != 2).alias("b"))
    z = T.segments(F.transform("a", lambda x: x["text"]), F.transform("b", lambda x: x["turn"]))
    out = g.select("conv_id", F.posexplode(z).alias("pos", "s"))
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), "s.text", F.col("s.coords").alias("region"))


@query("""
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'avif,webp' WHEN l.toxic = 1 THEN 'avif' ELSE '' END AS missing
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1 OR d.doc_id % 4 = 0""")
def changed_formats(spark, sf_dir):
    """Files that are new, whose time differs, or that lack a wanted format."""
    disk = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 10).alias("mtime"))
    have = F.when(F.col("toxic") == 1, F.array(F.lit("webp"))).otherwise(F.array(F.lit("webp"), F.lit("avif")))
    stored = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 10 - F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("mtime"), have.alias("formats"))
    out = incremental.changed(disk, stored, "doc_id", formats="formats", wanted=["avif", "webp"])
    return out.select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("""
    WITH f AS (SELECT user_id, event_type FROM events UNION SELECT user_id, 'VIDEO' FROM events WHERE user_id % 4 = 0),
    b AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS bit FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'VIDEO', 0)
    SELECT user_id, CAST(sum(CAST(1 AS BIGINT) << CAST(bit AS INTEGER)) AS BIGINT) AS mask FROM f JOIN b ON f.event_type = b.event_type GROUP BY user_id""")
def format_bitmask(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    f = f.withColumn("kinds", F.when(F.col("user_id") % 4 == 0, F.concat("kinds", F.array(F.lit("VIDEO")))).otherwise(F.col("kinds")))
    return sinks.format_mask(f, "user_id", "kinds")[0]


@query("""
    WITH d AS (SELECT doc_id, n_chars % 3000 + 10 AS w, n_chars % 5000 + 1 AS h FROM documents),
    s AS (SELECT doc_id, CAST(CASE WHEN w > 1024 THEN round(h * 1024::DOUBLE / w) ELSE h END AS BIGINT) AS sh FROM d),
    t AS (SELECT doc_id, sh, unnest(range(0, greatest(sh, 1), 1024)) AS y FROM s)
    SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(least(1024, sh - y) AS INTEGER) AS h FROM t""")
def ocr_tiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 3000 + 10).alias("w"), (F.col("n_chars") % 5000 + 1).alias("h"))
    return d.select("doc_id", F.inline(T.tiles(F.col("w"), F.col("h"))))


@query("""
    WITH b AS (SELECT doc_id, (doc_id % 10) / 10.0::DOUBLE AS cx, (doc_id % 7) / 7.0::DOUBLE AS cy FROM documents)
    SELECT doc_id, CAST(round((cx - 0.25::DOUBLE / 2) * 800) AS INTEGER) AS x, CAST(round((cy - 0.5::DOUBLE / 2) * 600) AS INTEGER) AS y, 200 AS w, 300 AS h FROM b""")
def ocr_boxes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10 / 10.0).alias("cx"), (F.col("doc_id") % 7 / 7.0).alias("cy"))
    return d.select("doc_id", T.ocr_box(F.col("cx"), F.col("cy"), F.lit(0.25), F.lit(0.5), F.lit(800), F.lit(600)).alias("b")).select("doc_id", "b.*")


@query("""
    SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS ocr FROM conversations GROUP BY conv_id""")
def joined_segments(spark, sf_dir):
    """Segments of a text joined in their order."""
    s = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(s, lambda x: x["text"]), "\n").alias("ocr"))


# Files on disk against stored rows: documents play files, labelled ones have been processed.
STORED = "SELECT doc_id AS filename, CASE WHEN doc_id % 3 = 0 THEN 500 ELSE 1500 END AS embedding_time, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1200 END AS ocr_time, 1200 AS thumbnail_time, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1 END AS metadata FROM labels"


@query(f"""
    WITH d AS (SELECT doc_id AS filename, 1000 + doc_id % 400 AS mtime FROM documents), s AS ({STORED}),
    j AS (SELECT d.filename, mtime, embedding_time IS NULL OR mtime > embedding_time AS needs_embed, ocr_time IS NULL OR mtime > ocr_time AS needs_ocr,
          thumbnail_time IS NULL OR mtime > thumbnail_time AS needs_thumbnail, embedding_time IS NULL OR mtime > embedding_time OR metadata IS NULL AS needs_metadata
          FROM d LEFT JOIN s ON d.filename = s.filename)
    SELECT * FROM j WHERE needs_embed OR needs_ocr OR needs_thumbnail OR needs_metadata""")
def incremental_plan(spark, sf_dir):
    disk = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filename"), (1000 + F.col("doc_id") % 400).alias("mtime"))
    n = F.col("doc_id")
    stored = table(spark, sf_dir, "labels").select(
        n.alias("filename"), F.when(n % 3 == 0, 500).otherwise(1500).alias("embedding_time"), F.when(n % 5 != 0, 1200).alias("ocr_time"),
        F.lit(1200).alias("thumbnail_time"), F.when(n % 7 != 0, 1).alias("metadata"),
    )
    return incremental.work_plan(disk, stored)


@query("""
    SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality * 1000 < d.n_chars""")
def stale_scans(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("modtime"))
    scans = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 1000).alias("scan_time"))
    return incremental.stale_scans(files, scans, "doc_id").select("doc_id")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality * 500 = d.n_chars // 2)")
def changed_files(spark, sf_dir):
    """New files and files whose time differs."""
    disk = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("n_chars") / 2).alias("mtime"))
    stored = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 500).cast("long").alias("mtime"))
    return incremental.changed(disk, stored, "doc_id").select("doc_id", "n_chars")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def vanished(spark, sf_dir):
    disk = table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id")
    return incremental.vanished(table(spark, sf_dir, "labels"), disk, "doc_id").select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 12 >= label + 1")
def stale_frames(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 12).alias("frame"), (F.col("label") + 1).alias("frames"))
    return incremental.stale_frames(f).select("vec_id")


@query("""
    WITH new AS (SELECT conv_id, max(turn) AS turn, 'new' AS state FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id),
    old AS (SELECT conv_id, CAST(0 AS BIGINT) AS turn, 'old' AS state FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE conv_id NOT IN (SELECT conv_id FROM new)""")
def upsert_latest(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    old = c.filter("conv_id % 3 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("old").alias("state")).distinct()
    new = c.filter("conv_id % 2 = 0").select("conv_id", "turn", F.lit("new").alias("state"))
    return incremental.upsert(old, new, "conv_id", "turn")


@query("""
    SELECT coalesce(d.doc_id, l.doc_id + 1000000) AS doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS lang, d.source
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT doc_id + 1000000, 'extra', NULL FROM labels WHERE toxic = 1""")
def merge_columns(spark, sf_dir):
    """Only columns with a value are overwritten; new keys are inserted."""
    lab = table(spark, sf_dir, "labels")
    changes = lab.select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    changes = changes.unionByName(lab.filter("toxic = 1").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("extra").alias("lang")))
    return incremental.merge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), changes, "doc_id")


@query("SELECT lang, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS missing FROM documents WHERE source NOT IN ('src0', 'src1') GROUP BY lang")
def missing_formats(spark, sf_dir):
    """Set difference of what is wanted and what is there."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set("source").alias("s"))
    return d.select("lang", F.array_join(F.array_sort(F.array_except("s", F.array(F.lit("src0"), F.lit("src1")))), ",").alias("missing"))


@query("SELECT vec_id, url FROM (SELECT vec_id, 'n' || (label * 7) AS url, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1")
def keep_first(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("n"), F.col("label") * 7).alias("url"))
    return dedup.keep_first(v, F.col("label"), F.col("vec_id")).select("vec_id", "url")


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substring(md5('0|' || doc_id), 1, 8) AS BIGINT) % 1000000 < 100000")
def hashed_sample(spark, sf_dir):
    """A tenth of the documents, the same in every run."""
    return dump.sampled(table(spark, sf_dir, "documents"), 0.1, "doc_id").select("doc_id")


@query("""
    SELECT page_id, replace(replace(rtrim(to_base64(unhex(substring(md5(url), 1, 16))), '='), '+', '-'), '/', '_') AS hash FROM pages""")
def name_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.name_hash("url").alias("hash"))


@query("SELECT page_id, url AS text FROM pages")
def base64_round_trip(spark, sf_dir):
    """URL-safe base64 decoded in the JVM."""
    p = table(spark, sf_dir, "pages").select("page_id", F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_").alias("b"))
    return p.select("page_id", base64url_bytes("b").cast("string").alias("text"))


@query("SELECT max(ts) AS latest, count(*) AS n_rows FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)")
def resume_point(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = e.agg(F.floor(F.max("event_id") / 2).alias("half"))
    written = e.crossJoin(F.broadcast(half)).filter("event_id <= half")
    return incremental.resume_point(written, "ts").withColumnRenamed("rows", "n_rows")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents QUALIFY n <= 3")
def head_per_key(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("n")).filter("n <= 3")
