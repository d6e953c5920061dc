"""URL functions: normalisation, ids, platforms and kinds. All are column expressions; nulls count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import text

TRACKING = r"^(?i)(igsh|igshid|utm_[^=]*)(=|$)"
SHORT_S = 180
#: Where an address without one belongs.
SCHEME, HOST = "https", "www.instagram.com"
# Forms of two sites' addresses, and where their ids stand.
_INSTAGRAM, _YOUTUBE = r"(?i)(instagram\.com|instagr\.am)", r"(?i)(youtube\.com|youtu\.be)"
_LONG_ID = r"(?:youtu\.be/|youtube\.com/(?:shorts/|embed/|live/|watch\?(?:[^#]*&)?v=))([A-Za-z0-9_-]{11})"
_SHORT_CODE = r"(?i)(?:instagram\.com|instagr\.am)/(?:share/)?(?:reel|reels|p|tv)/([A-Za-z0-9_-]+)"
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def normalise_url(c: Column | str, tracking: str = TRACKING) -> Column:
    """With scheme, host and path (defaults where one is missing), without the fragment and tracking parameters.

    Other parameters keep their order, each with an equals sign; an empty text stays empty.
    """
    t = F.trim(text(c))
    part = lambda i: F.regexp_extract(t, _URL, i)
    either = lambda x, other: F.when(x == "", F.lit(other)).otherwise(x)
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(tracking))
    query = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    path = F.when(F.startswith(part(3), F.lit("/")), part(3)).otherwise(F.concat(F.lit("/"), part(3)))
    whole = F.concat(either(F.lower(part(1)), SCHEME), F.lit("://"), either(part(2), HOST), path)
    return F.when(t == "", "").when(query == "", whole).otherwise(F.concat(whole, F.lit("?"), query))


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(c), r"^[a-zA-Z]+://([^/?#:]+)", 1))


def video_id(c: Column | str) -> Column:
    """Eleven characters of a YouTube address in any of its forms, or an Instagram shortcode; "" for others."""
    t = text(c)
    long_id = F.regexp_extract(t, _LONG_ID, 1)
    code = F.regexp_extract(t, _SHORT_CODE, 1)
    return F.when(long_id != "", long_id).otherwise(code)


def platform(c: Column | str) -> Column:
    t = text(c)
    return F.when(t.rlike(r"^(/|file:)"), "file").when(t.rlike(_INSTAGRAM), "instagram").when(t.rlike(_YOUTUBE), "youtube").otherwise("other")


def is_live_url(c: Column | str) -> Column:
    """Live streams' addresses; Instagram's are never taken as live."""
    return ~text(c).rlike(_INSTAGRAM) & text(c).rlike(r"(?i)/live($|[^A-Za-z0-9_])|livestream")


def kind(c: Column | str, hint: Column, duration_s: Column) -> Column:
    """A live hint wins; then the duration; then the URL."""
    return (
        F.when(hint == "live", "live")
        .when(duration_s.isNotNull(), F.when(duration_s <= SHORT_S, "short").otherwise("vod"))
        .when(is_live_url(c), "live")
        .when(text(c).rlike(r"(?i)/(shorts|reel|reels)/"), "short")
        .otherwise("vod")
    )
