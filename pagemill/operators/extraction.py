"""Article fields from bound pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import content as C
from pagemill.functions.dates import date_or_now, jsonld_date, normalize_date_text, to_zone
from pagemill.functions.markup import parse_attrs, parsed, raw_tokens, text_between
from pagemill.functions.selectors import first, matches, node_text
from pagemill.functions.sqltext import let, quote
from pagemill.functions.text import bind, is_present, trim_text, strip_tags, trim_words
from pagemill.functions.urls import ascii_lower, resolve_link

EVENTS, NODES = "doc.events", "doc.nodes"


def bind_page(df: DataFrame, html: str = "html") -> DataFrame:
    """Parse the page once; the body itself is not carried further."""
    return bind(df, doc=F.expr(parsed(html))).drop(html)


def first_text(selector: str) -> Column:
    """Text of the first match, null when nothing matches."""
    return F.expr(
        let("_one", first(matches(selector, EVENTS, NODES)), f"case when _one is not null then {node_text(EVENTS, '_one')} end")
    )


def jsonld_scripts() -> Column:
    """Texts of the page's structured-data scripts, in document order."""
    chosen = f"filter({NODES}, _n -> _n.tag = 'script' and try_element_at(_n.attrs, 'type') = {quote('application/ld+json')})"
    return F.expr(f"transform({chosen}, _x -> {text_between(EVENTS, '_x.start', '_x.end')})")


def long_paragraph(minimum: int = 50) -> Column:
    """First paragraph of the page with more than ``minimum`` characters, white space
    counted once."""
    text = text_between(EVENTS, "_x.start", "_x.end")
    paragraphs = f"transform(filter({NODES}, _n -> _n.tag = 'p'), _x -> {text})"
    spaced = rf"length(trim(regexp_replace(_y, {quote('[ \t\r\n]+')}, ' ')))"
    return F.expr(f"try_element_at(filter({paragraphs}, _y -> {spaced} > {minimum}), 1)")


def picked_image() -> Column:
    """Address on the element the image selector picks; '' when the element
    carries none, null when no element was picked."""
    node = let(
        "_one", first(matches("image_selector", EVENTS, NODES)),
        """case when _one is null then null
             when _one.tag = 'a' then coalesce(try_element_at(_one.attrs, 'href'), '')
             when _one.tag = 'img' then coalesce(try_element_at(_one.attrs, 'src'), '')
             else coalesce(nullif(nullif(try_element_at(_one.attrs, 'src'), ''), '0'),
                           try_element_at(_one.attrs, 'href'), '') end""",
    )
    return F.expr(node)


def first_img_src(content: str) -> Column:
    """G1: ``src`` of the first ``img`` in a piece of markup."""
    tag = f"try_element_at(filter({raw_tokens(content)}, _k -> _k rlike {quote(r'(?i)^<img[\s/>]')}), 1)"
    return F.expr(let("_img", tag, f"try_element_at({parse_attrs('_img')}, 'src')"))


def gate_columns(df: DataFrame) -> DataFrame:
    """``gate`` is 'open', 'no match' or 'closed'; ``gate_text`` the text found."""
    active = F.col("gate_selector_set") & (F.size("content_gate_values") > 0)
    bound = bind(df, gate_text=F.when(active, trim_text(first_text("gate_selector"))))
    allowed = F.transform("content_gate_values", ascii_lower)
    return bound.withColumn(
        "gate",
        F.when(~active, F.lit("open"))
        .when(F.col("gate_text").isNull(), F.lit("no match"))
        .when(F.array_contains(allowed, ascii_lower("gate_text")), F.lit("open"))
        .otherwise(F.lit("closed")),
    )


def extract_fields(df: DataFrame, run_ts: Column, zone: str) -> DataFrame:
    """All article fields of pages bound as ``doc`` with their profile's compiled
    selectors beside them. Pages behind a closed gate are not searched further."""
    gated = gate_columns(df)
    is_open = F.col("gate") == "open"
    html = C.content_html(EVENTS, NODES, "content_selector", "content_filter_mode", "include_rules", "remove_rules")
    date_text = normalize_date_text(first_text("date_selector"))
    raw = bind(
        gated,
        title=F.when(is_open, trim_text(F.coalesce(first_text("title_selector"), F.lit("")))),
        content=F.when(is_open, F.expr(C.clean_content(html))),
        date_text=F.when(is_open, date_text),
        scripts=F.when(is_open, jsonld_scripts()),
        excerpt_text=F.when(
            is_open, F.when(F.col("excerpt_selector_set"), first_text("excerpt_selector")).otherwise(long_paragraph())
        ),
        picked=F.when(is_open & F.col("image_selector").isNotNull(), picked_image()),
    ).drop("doc")
    has_date = is_present("date_text") & (F.col("date_text") != "-")
    dated = bind(
        raw,
        printed=F.when(has_date, date_or_now("date_text", zone, run_ts)),
        structured=F.when(~has_date, jsonld_date("scripts", run_ts)),
    )
    has_content = is_present("content")
    excerpt = F.when(
        F.col("excerpt_selector_set") | has_content,
        F.coalesce(trim_words(trim_text("excerpt_text")), F.lit("")),
    ).otherwise(F.lit(""))
    image = F.when(has_content, F.coalesce(F.col("picked"), first_img_src("content")))
    source = (
        F.when(F.col("printed").isNotNull(), F.lit("selector"))
        .when(F.col("structured").isNotNull(), F.lit("jsonld"))
        .otherwise(F.lit("run"))
    )
    return dated.withColumns(
        {
            "post_date": F.coalesce("printed", "structured", to_zone(run_ts, zone)),
            "date_source": source,
            "source_timezone": F.when(source == "jsonld", F.lit("ET")),
            "post_title": strip_tags("title"),
            "excerpt": excerpt,
            "image_url": resolve_link(image, "source_url"),
            "complete": is_present("title") & has_content,
        }
    ).drop("printed", "structured", "scripts", "excerpt_text", "picked", "date_text")
