"""URL functions: identities that do not depend on size, tracking or order of parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that do not change which image or page is meant (fixed values).
IMAGE_PARAMS = "w|h|width|height|fit|crop|auto|quality|q|flip|fm|utm_.*"
PAGE_PARAMS = "utm_.*|ref|fbclid|gclid"
#: Widths that a picture's name may end in (fixed values).
SIZES = "150|180|340|640|960|1280|1920"
_URL = r"^(https?)://(?:[^/?#]*@)?([^/:?#]+)(?::\d+)?([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def kept_query(url: Column, dropped: str) -> Column:
    """Sorted parameters that are not dropped, with their question mark; empty without any."""
    parts = F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{dropped})(?:=|$)"))
    text = F.array_join(F.array_sort(parts), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def image_identity(url: Column) -> Column:
    """host, path without a size suffix, and what is left of the query."""
    name = F.regexp_replace(path(url), rf"(?i)_(?:{SIZES})(?=\.[a-z]+$)", "")
    return F.concat(host(url), name, kept_query(url, IMAGE_PARAMS))


def source_identity(url: Column) -> Column:
    """a page without `www.`, a final slash and tracking parameters."""
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/$", ""), kept_query(url, PAGE_PARAMS))


def identity_keys(id_: Column, url: Column) -> Column:
    """all keys under which a candidate may be known."""
    page = source_identity(url)
    return F.filter(F.array(F.concat(F.lit("id:"), id_.cast("string")), F.concat(F.lit("image:"), image_identity(url)), F.when(page != "", F.concat(F.lit("page:"), page))), lambda x: x.isNotNull())


def is_public_https(url: Column) -> Column:
    """Https, a named public host, no credentials and no port."""
    h = host(url)
    return (
        url.rlike(r"^https://[^/?#@:]+(?:[/?#]|$)") & h.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") & ~h.rlike(r"^[\d.]+$")
        & ~h.rlike(r"(^|\.)(localhost|local|internal|test|invalid)$")
    )


def fnv1a(c: Column) -> Column:
    """the 32-bit FNV-1a hash over characters (of the ASCII range)."""
    chars = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295)))


def usability(width: Column, height: Column) -> Column:
    """large and square pictures are more usable."""
    return F.least(F.lit(2.0), F.log2(width * height / 120000.0)) - F.abs(F.log2(width / height))
