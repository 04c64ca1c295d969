"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import as_col, is_present, last_segment, trim_text

# fixed value: file extensions accepted as images
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column | str) -> Column:
    return F.translate(as_col(c), _UPPER, _UPPER.lower())


def strip_trailing_slashes(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit("/"))


def normalize_url(c: Column | str) -> Column:
    """Key under which an imported URL is remembered."""
    return strip_trailing_slashes(ascii_lower(trim_text(c)))


def site_root(url: Column | str) -> Column:
    """Scheme and host of a URL, without user and port."""
    url = as_col(url)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.concat(scheme, F.lit("://"), host)


def host_of(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_label(url: Column | str) -> Column:
    """Last part of the path."""
    return last_segment(path_of(url))


def build_page_url(source: Column | str, param: Column | str, page: Column | str) -> Column:
    """Page 1 is the source itself; a parameter with a slash is a path template,
    any other is a query parameter."""
    source, param, page = as_col(source), as_col(param), as_col(page)
    number = page.cast("string")
    separator = F.when(F.contains(source, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return (
        F.when(page == 1, source)
        .when(
            F.contains(param, F.lit("/")),
            F.concat(strip_trailing_slashes(source), F.replace(param, F.lit("{page}"), number)),
        )
        .otherwise(F.concat(source, separator, param, F.lit("="), number))
    )


def resolve_link(href: Column | str, source: Column | str) -> Column:
    """Anything that does not start with ``http`` hangs below the site root;
    an absent link gives null."""
    href = as_col(href)
    slash = F.when(F.startswith(href, F.lit("/")), F.lit("")).otherwise(F.lit("/"))
    return F.when(
        is_present(href),
        F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(site_root(source), slash, href)),
    )


def is_image_url(url: Column | str) -> Column:
    """The path ends in a known image extension, in any case."""
    extension = F.lower(F.regexp_extract(path_of(url), r"\.([^./]+)$", 1))
    return F.coalesce(extension.isin(*IMAGE_EXTENSIONS), F.lit(False))
