"""Functions on records, URLs, names and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the data's own dialect, which results depend on.
LINE_REJECT = [r'"author":"\[deleted\]"', r'"promoted":true', r'"domain":"self.promos"', r"\x00"]
URL_DENY = [
    r"//reddit\.com/[^g]", r"\.html?", r"\.php", r"\?articleid=", r"\.aspx?", r"\.xml", r"/rss/", r"//vimeo\.com",
    r"//www\.reddit\.com/[^g]", r"//v\.redd\.it", r"\.gifv$", r"youtube\.com/user/",
]
URL_ALLOW = [
    "jpg", "jpeg", "png", "webp", r"\.gif", "=gif", "bmp", "tiff", "avif", "imgur", "image", r"//i\.", "img", r"cdn\.",
    r"media\.", "/i/", "/media", r"youtu\.be", r"youtube\.com", r"reddit.com/gallery/",
]
URL_REWRITE = [
    (r"imgur\.com/([A-Za-z0-9]+),", r"imgur.com/$1"),
    (r"//imgur\.com/([A-Za-z0-9]+)\z", r"//i.imgur.com/$1.jpg"),
    (r"//www\.imgur\.com/([A-Za-z0-9]+)\z", r"//i.imgur.com/$1.jpg"),
    (r"//m\.imgur\.com/([A-Za-z0-9]+)\z", r"//i.imgur.com/$1.jpg"),
    (r"^http://", r"https://"),
    (r"//youtu\.be/(.*)", r"//youtube.com/watch?v=$1"),
    (r"//[a-z]+\.youtube\.com/(.*)", r"//youtube.com/$1"),
    (r"//www.youtube.com/attribution_link?.*v%3D([A-Za-z0-9_-]+).*", r"//i.ytimg.com/vi/$1/maxresdefault.jpg"),
    (r"//youtube.com/embed/([A-Za-z0-9_-]+)", r"//i.ytimg.com/vi/$1/maxresdefault.jpg"),
    (r"//youtube\.com/(?:.*)v=([A-Za-z0-9_-]+)(?:.*)", r"//i.ytimg.com/vi/$1/maxresdefault.jpg"),
    (r"&amp;", "&"),
]
HTML_RULES = [
    (r"//imgur\.com/a/[A-Za-z0-9]+", r'<meta name="twitter:image" data-react-helmet="true" content="([^"]+)">'),
    (r"//imgur\.com/gallery/[A-Za-z0-9]+", r'<meta name="twitter:image" data-react-helmet="true" content="([^"]+)">'),
    (r"reddit.com/gallery/[A-Za-z0-9_-]+", r'<li style="left:0px" class="_28TEYBuEdOuE3kN6UyoKMa"><figure class="_3BxRNDoASi9FbGX01ewiLg _3o5Vzct5tn9PE7e-emdDmf"><a href="([^"]+)" rel="noopener noreferrer" target="_blank"'),
]
CONTENT_TYPES = ["image/png", "image/webp", "image/avif", "image/jpeg", "image/gif", "image/apng", "image/bmp", "image/tiff"]
MAX_BYTES = 1 << 24
RATINGS = {"1": 0.9, "1+": 0.7, "1p": 0.7, "eq": 0.5, "2+": 0.3, "2p": 0.3, "2": 0.1}
POST_HINTS = ["na", "image"]
CRAWL_SUFFIXES = [".mp4", ".mkv", ".webm"]
CRAWL_MAX_BYTES = 8_000_000
CRAWL_TYPES = ["image/png", "image/jpeg", "image/webp", "image/avif"]


def any_of(patterns: list[str], ignore_case: bool = False) -> str:
    """One alternation, so that a text is scanned once."""
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)


def line_rejected(c: Column) -> Column:
    """Whether a raw line is dropped before it is parsed."""
    return c.rlike(any_of(LINE_REJECT))


def url_accepted(c: Column) -> Column:
    """No denied pattern and at least one allowed one."""
    return ~c.rlike(any_of(URL_DENY)) & c.rlike(any_of(URL_ALLOW, ignore_case=True))


def url_rewritten(c: Column) -> Column:
    """The rewrite rules in order, each over the whole URL."""
    for pattern, to in URL_REWRITE:
        c = F.regexp_replace(c, pattern, to)
    return c


def html_target(url: Column, html: Column) -> Column:
    """The address that the first rule matching the URL finds in the page; null without."""
    out = F.lit(None).cast("string")
    for on, find in reversed(HTML_RULES):
        out = F.when(url.rlike(on), F.nullif(F.regexp_extract(html, find, 1), F.lit(""))).otherwise(out)
    return out


def content_accepted(kind: Column, size: Column, by_html_rule: Column) -> Column:
    """Image types, HTML only where a rule reads it, and a cap on the size."""
    return (kind.isin(CONTENT_TYPES) | (kind.startswith("text/html") & by_html_rule)) & (size <= MAX_BYTES)


def epoch_seconds(c: Column) -> Column:
    """Seconds from an integer, a numeric string or a float, which is truncated; null if it is none."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").cast("bigint"))


def crawl_accepted(over_18: Column, indexable: Column, preview: Column, url: Column) -> Column:
    """Whether an item of a listing is fetched at all."""
    bad_end = F.lit(False)
    for suffix in CRAWL_SUFFIXES:
        bad_end = bad_end | url.endswith(suffix)
    return ~over_18 & indexable & preview & url.startswith("https://") & ~bad_end


def crawl_kept(kind: Column, size: Column) -> Column:
    """Whether what was fetched is kept: its type, and its stated size; a missing size is too large."""
    return kind.isin(CRAWL_TYPES) & F.coalesce(size <= CRAWL_MAX_BYTES, F.lit(False))


def crawl_going_on(created: Column, threshold: Column) -> Column:
    """Whether a listing, newest first, has not reached what was crawled before."""
    return threshold.isNull() | (threshold <= created)


def validation_row(*names: Column) -> Column:
    """Whether any of the names falls in the validation tenth by its hash."""
    out = F.lit(False)
    for n in names:
        out = out | (F.conv(F.substring(F.sha2(n, 256), 1, 2), 16, 10).cast("int") / 255 < 0.1)
    return out


def permalink(subreddit: Column, ident: Column) -> Column:
    return F.concat(F.lit("https://reddit.com/r/"), subreddit, F.lit("/comments/"), ident)


def bucket_of(c: Column) -> Column:
    """Two hex digits of the MD5, to spread files over folders."""
    return F.substring(F.md5(c), 1, 2)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9-]", "_")


def ratings(c: Column) -> Column:
    """``a,b,c`` as an array of strengths."""
    table = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])
    return F.transform(F.split(c, ","), lambda r: F.element_at(table, r))


def preference(first: Column, second: Column) -> Column:
    """Chance that the first is preferred, from two scores."""
    return 1 / (1 + F.exp(second - first))


def ocr_box(centre_x: Column, centre_y: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> Column:
    """Pixel box from fractions of the image."""
    px = lambda c, size: F.round(c * size).cast("int")
    return F.struct(
        px(centre_x - width / 2, image_w).alias("x"), px(centre_y - height / 2, image_h).alias("y"),
        px(width, image_w).alias("w"), px(height, image_h).alias("h"),
    )


def tiles(width: Column, height: Column, size: int = 1024) -> Column:
    """Vertical tiles of an image scaled to at most ``size`` pixels of width: (y offset, height)."""
    scaled = F.when(width > size, F.round(height * size / width)).otherwise(height).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(scaled - 1, F.lit(0)), F.lit(size)),
        lambda y: F.struct(y.alias("y"), F.least(F.lit(size), scaled - y).alias("h")),
    )


def segments(texts: Column, regions: Column) -> Column:
    """Texts with their regions, as far as both go."""
    n = F.least(F.size(texts), F.size(regions))
    return F.arrays_zip(F.slice(texts, 1, n).alias("text"), F.slice(regions, 1, n).alias("coords"))


def name_hash(name: Column | str) -> Column:
    """A short URL-safe opaque id of a file name: 64 bits of its MD5."""
    short = F.base64(F.unhex(F.substring(F.md5(name), 1, 16)))
    return F.translate(F.rtrim(short, F.lit("=")), "+/", "-_")
