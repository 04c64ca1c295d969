"""Registered queries: each operator over the driver's tables, with SQL for the check.

Inputs the tables lack are derived from them as columns: a profile per host or
customer, imported posts from the shape of a URL, dates and image addresses as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import content as C
from pagemill.functions import dates as D
from pagemill.functions import markup as M
from pagemill.functions import selectors as X
from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.functions.sqltext import quote
from pagemill.operators import discovery, extraction, images, outcome, profiles, report, schedule, terms
from pagemill.operators.staging import shared_folder, stage, sum_before
from pagemill.plans.import_run import import_run, write_run
from pagemill.sources import tables
from pagemill.streaming import imports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# tables whose rows cost more to work on than to move
WORKED = ("pages", "documents", "events", "orders", "customer")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return tables.read_table(spark, path) if name in WORKED else spark.read.parquet(path)


def sel(text: str) -> str:
    """Compiled selector as SQL, for a selector that is the same on every row."""
    return X.compiled(quote(text))


RUN_TS = "2024-01-20 03:00:00"


def run_ts():
    return F.lit(RUN_TS).cast("timestamp_ntz")


# ---- shared derivations and their SQL ----------------------------------------

HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
NORM = "rtrim(translate(trim(url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/')"
LABEL = "regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1)"
LANG = "regexp_extract(html, '<html lang=\"([a-z]+)\">', 1)"


def decoded(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


def trimmed(x: str) -> str:
    return rf"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"


H1 = trimmed(decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))
ARTICLE = "regexp_extract(html, '(?s)<article>.*</article>', 0)"
# the tables leave <p><b>..<br> open; the serialised form closes both
CLOSED = rf"regexp_replace({ARTICLE}, '(?s)<p><b>(.*?)<br>', '<p><b>\1<br></b></p>', 'g')"
BARE = r"regexp_replace(regexp_replace({}, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>', '', 'g')"
PLAIN = r"regexp_replace({}, '(?s)<[^>]*>', '', 'g')"


def escaped(x: str) -> str:
    """Text references written the way the serialiser writes them."""
    return f"replace(replace({decoded(x)}, '&', '&amp;'), '&amp;amp;amp;', '&amp;amp;')"


P = f"p AS (SELECT page_id, url, html, {HOST} AS host, {LANG} AS lang, {H1} AS title FROM pages)"


def page_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages parsed once, bound as ``doc``, with their host."""
    pages = table(spark, sf, "pages").withColumn("host", U.host_of("url"))
    return extraction.bind_page(pages)


def text_of(selector: str):
    return extraction.first_text(sel(selector))


def page_titles_df(spark: SparkSession, sf: str) -> DataFrame:
    lang = extraction.first_text(sel("/html/@lang"))
    return page_docs(spark, sf).select(
        "page_id", "url", "host", lang.alias("lang"), T.trim_text(text_of("//h1")).alias("title")
    )


def imported_posts(titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts and metadata of what counts as imported before: URLs ending in ``/``
    (since deleted) or ``.html``."""
    old = titles.where(F.rlike("url", F.lit(r"(/|\.html)$")))
    posts = old.select(
        F.col("page_id").alias("post_id"), F.col("lang").alias("post_type"), F.col("title").alias("post_title"),
        F.when(F.endswith("url", F.lit("/")), F.lit("trash")).otherwise(F.lit("publish")).alias("post_status"),
    )
    urls = old.select(
        F.col("page_id").alias("post_id"), F.lit("source_url").alias("meta_key"),
        U.normalize_url("url").alias("meta_value"),
    )
    origin = old.select(
        F.col("page_id").alias("post_id"), F.lit("imported_from").alias("meta_key"), F.lit("scraper").alias("meta_value")
    )
    return posts, urls.unionByName(origin)


OLD = r"""old AS (SELECT *, CASE WHEN url LIKE '%/' THEN 'trash' ELSE 'publish' END AS post_status
    FROM p WHERE regexp_matches(url, '(/|\.html)$'))"""

# ---- sources -----------------------------------------------------------------


@query("fetched_pages", "SELECT url, length(html) AS n_chars FROM pages WHERE html LIKE '%</html>%'")
def _(spark, sf):
    # a page cut off before its end counts as a failed fetch
    status = F.when(F.contains("html", F.lit("</html>")), 200).otherwise(500)
    pages = table(spark, sf, "pages").withColumn("status", status)
    return tables.fetched_pages(pages).select("url", F.length("html").cast("bigint").alias("n_chars"))


@query("lookup_page", """
    WITH w AS (SELECT DISTINCT rtrim(url, '/') AS url FROM pages)
    SELECT w.url, coalesce(length(p.html), -1) AS n_chars FROM w LEFT JOIN pages p USING (url)""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    wanted = pages.select(U.strip_trailing_slashes("url").alias("url")).distinct()
    found = tables.lookup_page(wanted, pages)
    return found.select("url", F.coalesce(F.length("html"), F.lit(-1)).cast("bigint").alias("n_chars"))


@query("imported_urls", f"WITH {P}, {OLD} SELECT lang AS post_type, {NORM} AS norm_url, page_id AS post_id, title AS post_title FROM old")
def _(spark, sf):
    return tables.imported_urls(*imported_posts(page_titles_df(spark, sf)))


@query("imported_titles", f"WITH {P}, {OLD} SELECT lang AS post_type, title AS post_title FROM old WHERE post_status = 'publish'")
def _(spark, sf):
    return tables.imported_titles(imported_posts(page_titles_df(spark, sf))[0])


def _meta_input(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("post_id"), "url",
        F.when(F.startswith("url", F.lit("https")), F.lit("ET")).alias("source_timezone"),
        F.endswith("url", F.lit("/")).alias("used_fallback"),
    )


META_SQL = f"""m AS (
    SELECT page_id AS post_id, 'source_url' AS meta_key, {NORM} AS meta_value FROM pages
    UNION ALL SELECT page_id, 'imported_from', 'scraper' FROM pages
    UNION ALL SELECT page_id, 'import_date', '2024-01-19 22:00:00' FROM pages
    UNION ALL SELECT page_id, 'source_timezone', 'ET' FROM pages WHERE url LIKE 'https%'
    UNION ALL SELECT page_id, 'used_fallback_featured_image', 'true' FROM pages WHERE url LIKE '%/')"""


@query("meta_long", f"WITH {META_SQL} SELECT * FROM m")
def _(spark, sf):
    return tables.post_meta_rows(_meta_input(spark, sf), run_ts(), D.JSONLD_ZONE)


@query("meta_wide", f"""WITH {META_SQL} SELECT post_id, {', '.join(
    f"min(meta_value) FILTER (WHERE meta_key = '{k}') AS {k}"
    for k in ('source_url', 'imported_from', 'import_date', 'source_timezone', 'used_fallback_featured_image', 'source_image_url')
)} FROM m GROUP BY post_id""")
def _(spark, sf):
    return tables.meta_wide(tables.post_meta_rows(_meta_input(spark, sf), run_ts(), D.JSONLD_ZONE))


# ---- profiles ------------------------------------------------------------------


def customer_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One stored profile per customer; values out of range and absent ones included."""
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        profiles.slug("c_name").alias("profile_key"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("profile_name"),
        F.concat(F.lit("https://"), F.lower(seg), F.lit(".example.com/"), F.lit("list//")).alias("source_url"),
        F.when(seg == "FURNITURE", F.lit("")).otherwise(F.lit("post")).alias("post_type"),
        F.lit("//a").alias("listing_xpath"),
        F.when(seg == "MACHINERY", F.lit("//h1[")).otherwise(F.lit("//h1")).alias("title_xpath"),
        F.lit("//article").alias("content_xpath"),
        F.when(F.col("c_nationkey") > 20, F.lit("0")).otherwise(F.lit("//time")).alias("date_xpath"),
        F.concat(F.lit(" //script \n0\n"), F.lower(seg), F.lit("\n\n//div")).alias("remove_xpaths"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")).alias("start_page"),
        (F.col("c_nationkey") - 5).cast("string").alias("max_pages"),
        F.when(F.col("c_nationkey") > 10, F.concat(F.col("c_nationkey").cast("string"), F.lit(" items"))).alias("posts_per_batch"),
        F.when(seg == "BUILDING", F.lit("future")).otherwise(F.lit("draft")).alias("post_status"),
        F.concat(F.lower(seg), F.lit(", news,, n"), F.col("c_nationkey").cast("string")).alias("categories"),
        F.when(seg == "HOUSEHOLD", F.lit("/page/{page}/")).when(seg == "BUILDING", F.lit("p")).alias("page_param"),
        F.when(seg == "BUILDING", F.lit("on")).otherwise(F.when(seg == "MACHINERY", F.lit("0")).otherwise(F.lit("1"))).alias("cron_enabled"),
        (F.col("c_nationkey") * 2 - 3).cast("string").alias("cron_frequency"),
        F.when(seg == "MACHINERY", F.lit("month")).when(seg == "FURNITURE", F.lit("week")).otherwise(F.lit("hour")).alias("cron_period"),
        "c_custkey",
    )


CP = """cp AS (SELECT replace(lower(c_name), '#', '') AS profile_key,
    CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS profile_name,
    'https://' || lower(c_mktsegment) || '.example.com/list//' AS source_url,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE 'post' END AS post_type,
    '//a' AS listing_xpath,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '//h1[' ELSE '//h1' END AS title_xpath,
    '//article' AS content_xpath,
    CASE WHEN c_nationkey > 20 THEN '0' ELSE '//time' END AS date_xpath,
    ' //script ' || chr(10) || '0' || chr(10) || lower(c_mktsegment) || chr(10) || chr(10) || '//div' AS remove_xpaths,
    CASE WHEN c_nationkey > 3 THEN c_nationkey::VARCHAR END AS start_page,
    (c_nationkey - 5)::VARCHAR AS max_pages,
    CASE WHEN c_nationkey > 10 THEN c_nationkey::VARCHAR || ' items' END AS posts_per_batch,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'future' ELSE 'draft' END AS post_status,
    lower(c_mktsegment) || ', news,, n' || c_nationkey::VARCHAR AS categories,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '/page/{page}/' WHEN 'BUILDING' THEN 'p' END AS page_param,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'on' WHEN 'MACHINERY' THEN '0' ELSE '1' END AS cron_enabled,
    (c_nationkey * 2 - 3)::VARCHAR AS cron_frequency,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'month' WHEN 'FURNITURE' THEN 'week' ELSE 'hour' END AS cron_period,
    c_custkey, c_nationkey, c_mktsegment FROM customer)"""


@query("profile_sanitize", f"""WITH {CP} SELECT profile_key, profile_name, post_type,
    greatest(1, coalesce(start_page, '1')::INT)::VARCHAR AS start_page,
    greatest(1, max_pages::INT)::VARCHAR AS max_pages,
    CASE WHEN posts_per_batch IS NULL THEN '9' ELSE c_nationkey::VARCHAR END AS posts_per_batch,
    CASE WHEN post_status = 'future' THEN 'publish' ELSE post_status END AS post_status,
    'exclude' AS content_filter_mode, coalesce(page_param, 'page') AS page_param, '0' AS fallback_image_id,
    CASE WHEN cron_enabled = '0' THEN '0' ELSE '1' END AS cron_enabled,
    least(24, greatest(1, cron_frequency::INT))::VARCHAR AS cron_frequency,
    CASE WHEN cron_period = 'month' THEN 'day' ELSE cron_period END AS cron_period FROM cp""")
def _(spark, sf):
    return profiles.profile_sanitize(customer_profiles(spark, sf)).select(
        "profile_key", "profile_name", "post_type", "start_page", "max_pages", "posts_per_batch", "post_status",
        "content_filter_mode", "page_param", "fallback_image_id", "cron_enabled", "cron_frequency", "cron_period",
    )


@query("profile_key", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'profile-1705719600'
    ELSE replace(lower(c_name), '#', '') END AS profile_key FROM customer""")
def _(spark, sf):
    name = F.when(F.col("c_acctbal") < 0, F.lit("!?#")).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey", profiles.profile_key(name, F.lit(1705719600)).alias("profile_key")
    )


@query("profile_effective", f"""WITH {CP} SELECT profile_key, rtrim(source_url, '/') AS source_url,
    greatest(1, coalesce(start_page, '1')::INT) AS start_page, greatest(1, max_pages::INT) AS max_pages,
    CASE WHEN posts_per_batch IS NULL THEN 0 ELSE c_nationkey END AS posts_per_batch,
    '//script;' || lower(c_mktsegment) || ';//div' AS remove_lines,
    CASE WHEN title_xpath = '//h1[' THEN 0 ELSE 1 END AS title_steps FROM cp""")
def _(spark, sf):
    return profiles.profile_effective(customer_profiles(spark, sf)).select(
        "profile_key", "source_url", "start_page", "max_pages", "posts_per_batch",
        F.array_join("remove_lines", ";").alias("remove_lines"),
        F.when(F.col("title_selector").isNull(), 0).otherwise(F.size("title_selector")).alias("title_steps"),
    )


@query("apply_overrides", f"""WITH {CP} SELECT profile_key,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE greatest(1, coalesce(start_page, '1')::INT) END AS start_page,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 7 ELSE greatest(1, max_pages::INT) END AS max_pages,
    CASE WHEN posts_per_batch IS NULL THEN 0 ELSE c_nationkey END AS posts_per_batch,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'publish' ELSE post_status END AS post_status FROM cp""")
def _(spark, sf):
    p = customer_profiles(spark, sf)
    wanted = p.where(F.contains("source_url", F.lit("building"))).select(
        "profile_key", F.lit("-4").alias("start_page"), F.lit("7").alias("max_pages"),
        F.lit(None).cast("string").alias("posts_per_batch"), F.lit("publish").alias("status"),
    )
    return profiles.profile_effective(p, wanted).select(
        "profile_key", "start_page", "max_pages", "posts_per_batch", "post_status"
    )


@query("profile_report", f"""WITH {CP}, v AS (
    SELECT profile_key, profile_name NOT IN ('', '0') AS complete, unnest([
      struct_pack(f := 'profile_name', v := profile_name), struct_pack(f := 'source_url', v := source_url),
      struct_pack(f := 'post_type', v := post_type), struct_pack(f := 'listing_xpath', v := listing_xpath),
      struct_pack(f := 'title_xpath', v := title_xpath), struct_pack(f := 'content_xpath', v := content_xpath),
      struct_pack(f := 'date_xpath', v := date_xpath), struct_pack(f := 'excerpt_xpath', v := ''),
      struct_pack(f := 'image_xpath', v := ''), struct_pack(f := 'categories', v := categories),
      struct_pack(f := 'tags', v := ''), struct_pack(f := 'post_status', v := post_status),
      struct_pack(f := 'start_page', v := coalesce(start_page, '')), struct_pack(f := 'max_pages', v := max_pages),
      struct_pack(f := 'posts_per_batch', v := coalesce(posts_per_batch, ''))]) AS s FROM cp)
    SELECT profile_key, complete::INT AS complete, s.f AS field, s.v AS value, (s.v IN ('', '0'))::INT AS is_empty FROM v""")
def _(spark, sf):
    r = profiles.profile_report(customer_profiles(spark, sf))
    return r.withColumns({c: F.col(c).cast("int") for c in ("complete", "is_empty")})


@query("validate_profiles", f"""WITH {CP} SELECT profile_key, concat_ws(';',
    CASE WHEN post_type = '' THEN 'missing post_type' END, CASE WHEN date_xpath = '0' THEN 'missing date_xpath' END,
    CASE WHEN post_status = 'future' THEN 'bad post_status' END,
    CASE WHEN title_xpath = '//h1[' THEN 'bad title_xpath' END) AS errors FROM cp""")
def _(spark, sf):
    return profiles.validate_profiles(customer_profiles(spark, sf)).select(
        "profile_key", F.array_join("errors", ";").alias("errors")
    )


@query("list_profiles", f"""WITH {CP} SELECT profile_key, profile_name, source_url, post_type,
    'run --profile=' || profile_key AS command FROM cp""")
def _(spark, sf):
    return profiles.list_profiles(customer_profiles(spark, sf))


_DEFAULT = {f: f"'{d}'" for f, d in profiles.S.PROFILE_DEFAULTS.items()}
_GIVEN = ("profile_name", "source_url", "post_type", "listing_xpath", "title_xpath", "content_xpath", "date_xpath",
          "remove_xpaths", "max_pages", "post_status", "categories", "cron_enabled", "cron_frequency", "cron_period")
_SQL_FIELDS = {f: (f if f in _GIVEN else f"coalesce({f}, {d})" if f in ("start_page", "posts_per_batch", "page_param") else d)
               for f, d in _DEFAULT.items()}


@query("export_profiles", f"""WITH {CP} SELECT profile_key,
    json_object({', '.join(f"'{f}', {x}" for f, x in _SQL_FIELDS.items())})::VARCHAR AS profile_json FROM cp""")
def _(spark, sf):
    return tables.export_profiles(profiles.profile_defaults(customer_profiles(spark, sf)))


@query("apply_profile_changes", f"""WITH {CP},
    kept AS (SELECT profile_key, profile_name, c_mktsegment FROM cp WHERE c_mktsegment <> 'MACHINERY'
        AND profile_name <> ''),
    up AS (SELECT 'renamed-' || c_custkey AS profile_key, 'Renamed-' || c_custkey AS profile_name, c_mktsegment FROM cp
        WHERE c_mktsegment = 'HOUSEHOLD'),
    made AS (SELECT *, replace(replace(lower(profile_name), '#', ''), ' ', '') || 'copy-1705719600' AS made_key FROM cp
        WHERE c_mktsegment = 'FURNITURE'),
    turns AS (SELECT *, row_number() OVER (PARTITION BY made_key ORDER BY c_custkey) AS turn FROM made),
    copies AS (SELECT made_key || CASE WHEN turn > 1 THEN '-' || turn ELSE '' END AS profile_key,
        profile_name || ' (Copy)' AS profile_name, c_mktsegment FROM turns)
    SELECT profile_key, min(profile_name) AS profile_name
    FROM (SELECT * FROM kept UNION ALL SELECT * FROM up UNION ALL SELECT * FROM copies) GROUP BY profile_key""")
def _(spark, sf):
    p = customer_profiles(spark, sf)
    seg = F.regexp_extract("source_url", "//([a-z]+)", 1)
    op = F.when(seg == "machinery", F.lit("delete")).when(seg == "household", F.lit("upsert")).when(seg == "furniture", F.lit("copy"))
    filled = profiles.profile_defaults(p).withColumn("c", F.regexp_extract("profile_key", r"0*(\d+)$", 1)).withColumn(
        "profile_name", F.concat(F.lit("Renamed-"), "c")
    )
    body = filled.select("profile_key", F.struct(*profiles.S.PROFILE_DEFAULTS).alias("profile"))
    changes = p.select("profile_key", F.col("c_custkey").alias("seq"), op.alias("op")).where(F.col("op").isNotNull()).join(
        body, "profile_key"
    )
    purge = spark.createDataFrame([("", 0, "purge")], "profile_key string, seq bigint, op string")
    result = profiles.apply_profile_changes(
        p, changes.unionByName(purge, allowMissingColumns=True), F.lit(1705719600)
    )
    return result.select("profile_key", "profile_name")


@query("include_rules", r"""WITH l AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'html:  <hr class="' || p_name || '"> '
        WHEN p_type = 'SMALL' THEN '//p | <b> | </b>' ELSE '//div[@class="' || p_brand || '"]|<i>' END AS line FROM part)
    SELECT p_partkey, CASE WHEN line LIKE 'html:%' THEN 'raw' ELSE 'select' END AS kind,
    CASE WHEN line LIKE 'html:%' THEN '' ELSE trim(split_part(line, '|', 1)) END AS selector,
    CASE WHEN line LIKE 'html:%' THEN trim(substr(line, 6)) ELSE trim(split_part(line, '|', 2)) END AS open_markup,
    CASE WHEN line LIKE 'html:%' THEN '' ELSE trim(split_part(line, '|', 3)) END AS close_markup FROM l""")
def _(spark, sf):
    line = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit('html:  <hr class="'), "p_name", F.lit('"> ')))
        .when(F.col("p_type") == "SMALL", F.lit("//p | <b> | </b>"))
        .otherwise(F.concat(F.lit('//div[@class="'), "p_brand", F.lit('"]|<i>')))
    )
    part = table(spark, sf, "part").select("p_partkey", F.array(line).alias("lines"))
    rule = F.expr(C.parse_include_rules("lines"))[0]
    return part.select("p_partkey", rule.alias("r")).select(
        "p_partkey", "r.kind", "r.selector", F.col("r.open").alias("open_markup"), F.col("r.close").alias("close_markup")
    )


# ---- discovery -----------------------------------------------------------------


@query("page_sequence", f"""WITH {CP}, c AS (SELECT profile_key, rtrim(source_url, '/') AS s, coalesce(page_param, 'page') AS param,
        greatest(1, coalesce(start_page, '1')::INT) AS a, greatest(1, max_pages::INT) AS n FROM cp)
    SELECT profile_key, page_no::INT AS page_no, CASE WHEN page_no = 1 THEN s
        WHEN param LIKE '%/%' THEN s || replace(param, '{{page}}', page_no::VARCHAR)
        ELSE s || '?' || param || '=' || page_no::VARCHAR END AS page_url
    FROM (SELECT *, unnest(range(a, a + n)) AS page_no FROM c)""")
def _(spark, sf):
    return discovery.page_sequence(profiles.profile_effective(customer_profiles(spark, sf))).select(
        "profile_key", "page_no", "page_url"
    )


@query("normalize_url", f"SELECT page_id, {NORM} AS norm_url FROM (SELECT page_id, '  ' || upper(url) || '// ' AS url FROM pages)")
def _(spark, sf):
    shouted = F.concat(F.lit("  "), F.upper("url"), F.lit("// "))
    return table(spark, sf, "pages").select("page_id", U.normalize_url(shouted).alias("norm_url"))


def nav_links_df(spark: SparkSession, sf: str) -> DataFrame:
    """Every page read as a listing page of its host: ``profile_key`` is the host,
    ``page_no`` the page id, ``links`` what the navigation names."""
    docs = page_docs(spark, sf).withColumn("source_url", F.col("url"))
    found = discovery.page_links(docs.withColumn("listing_selector", F.expr(sel("//nav//a"))))
    return found.select(F.col("host").alias("profile_key"), F.col("page_id").alias("page_no"), "links")


NAV = rf"""raw AS (SELECT {HOST} AS profile_key, page_id AS page_no, regexp_extract(url, '^[a-z]+://[^/]+') AS root,
        regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
    seen AS (SELECT profile_key, page_no, root, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS i FROM raw),
    kept AS (SELECT profile_key, page_no, root || {decoded("href")} AS url, min(i) AS i FROM seen GROUP BY ALL),
    links AS (SELECT profile_key, page_no, url, (row_number() OVER (PARTITION BY profile_key, page_no ORDER BY i) - 1)::INT AS link_pos FROM kept)"""


@query("listing_links", f"WITH {NAV} SELECT profile_key, page_no, link_pos, url FROM links")
def _(spark, sf):
    return discovery.exploded_links(nav_links_df(spark, sf)).select("profile_key", "page_no", "link_pos", "url")


@query("ordered_distinct_links", f"""WITH {NAV} SELECT profile_key, url, page_no, link_pos FROM links
    QUALIFY row_number() OVER (PARTITION BY profile_key, url ORDER BY page_no, link_pos) = 1""")
def _(spark, sf):
    return discovery.ordered_distinct(discovery.exploded_links(nav_links_df(spark, sf)))


def _listing(spark, sf):
    """Listing pages numbered by page id; one cut off before its end is a failed fetch."""
    pages = table(spark, sf, "pages").withColumn("host", U.host_of("url"))
    requests = pages.select(F.col("host").alias("profile_key"), F.col("page_id").alias("page_no"))
    whole = pages.where(F.contains("html", F.lit("</html>")))
    docs = extraction.bind_page(whole).withColumn("source_url", F.col("url"))
    found = discovery.page_links(docs.withColumn("listing_selector", F.expr(sel("//nav//a"))))
    return requests, stage(found.select(F.col("host").alias("profile_key"), F.col("page_id").alias("page_no"), "links"), "listing")


@query("prefix_until_gap", f"""WITH r AS (SELECT {HOST} AS profile_key, page_id AS page_no, (html LIKE '%</html>%')::INT AS ok FROM pages),
    g AS (SELECT *, sum(1 - ok) OVER (PARTITION BY profile_key ORDER BY page_no) AS gaps FROM r)
    SELECT profile_key, page_no FROM g WHERE gaps = 0""")
def _(spark, sf):
    return discovery.prefix_until_gap(*_listing(spark, sf)).select("profile_key", "page_no")


def _marked(spark, sf, limit: int) -> DataFrame:
    """Links of every page, those whose last part holds an ``e`` imported before."""
    links = stage(discovery.exploded_links(nav_links_df(spark, sf)), "links")
    config = links.select("profile_key").distinct().select(
        "profile_key", F.lit("post").alias("post_type"), F.lit(limit).alias("posts_per_batch")
    )
    old = links.where(F.contains(U.url_label("url"), F.lit("e")))
    imported = old.select(
        F.lit("post").alias("post_type"), "norm_url", F.col("page_no").alias("post_id"),
        F.concat(F.lit("Title of "), "norm_url").alias("post_title"),
    )
    return discovery.mark_imported(links, config, imported)


NAV_OLD = f"""{NAV}, known AS (SELECT DISTINCT {NORM} AS norm_url FROM links WHERE contains({LABEL}, 'e')),
    marked AS (SELECT l.*, {NORM} AS n, ({NORM} IN (SELECT norm_url FROM known))::INT AS old FROM links l)"""


@query("drop_imported", f"WITH {NAV_OLD} SELECT profile_key, page_no, link_pos, url FROM marked WHERE old = 0")
def _(spark, sf):
    return _marked(spark, sf, 5).where("is_new").select("profile_key", "page_no", "link_pos", "url")


FILLED = f"""{NAV_OLD}, per AS (SELECT profile_key, page_no, sum(1 - old) AS fresh FROM marked GROUP BY ALL),
    run AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY profile_key ORDER BY page_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
    full_pages AS (SELECT m.* FROM marked m JOIN run USING (profile_key, page_no) WHERE before < 5)"""


@query("imported_skips", f"""WITH {FILLED} SELECT profile_key, url, page_no, link_pos, 'Title of ' || n AS title,
    'skipped' AS status, 'Already imported' AS reason FROM full_pages WHERE old = 1""")
def _(spark, sf):
    return discovery.imported_skips(discovery.fill_to_limit(_marked(spark, sf, 5)))


@query("fill_to_limit", f"""WITH {FILLED} SELECT profile_key, url, page_no, link_pos FROM full_pages WHERE old = 0
    QUALIFY row_number() OVER (PARTITION BY profile_key, url ORDER BY page_no, link_pos) = 1""")
def _(spark, sf):
    return discovery.candidates(discovery.fill_to_limit(_marked(spark, sf, 5)))


@query("limit_mode_all", f"""WITH {NAV} SELECT profile_key, url, page_no, link_pos FROM links
    QUALIFY row_number() OVER (PARTITION BY profile_key, url ORDER BY page_no, link_pos) = 1""")
def _(spark, sf):
    return discovery.candidates(discovery.fill_to_limit(_marked(spark, sf, 0)))


@query("no_content_error", f"""WITH {NAV_OLD} SELECT DISTINCT profile_key, 'No content found!' AS error FROM raw
    WHERE profile_key NOT IN (SELECT profile_key FROM marked WHERE old = 0 AND contains(url, 'w'))""")
def _(spark, sf):
    marked = _marked(spark, sf, 5)
    found = discovery.candidates(marked).where(F.contains("url", F.lit("w")))
    hosts = table(spark, sf, "pages").select(U.host_of("url").alias("profile_key")).distinct()
    return discovery.no_content_errors(hosts, found)


# ---- selection -----------------------------------------------------------------


@query("page_tokens", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html,
        '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<[^>]*>|[^<]+')) AS t FROM pages),
    k AS (SELECT CASE WHEN t LIKE '<!%' THEN 'other' WHEN t LIKE '</%' THEN 'close'
        WHEN regexp_matches(t, '^<(br|meta)[ >]') THEN 'void' WHEN t LIKE '<%' THEN 'open' ELSE 'text' END AS kind,
        coalesce(nullif(regexp_extract(t, '^</?([a-z0-9]+)', 1), ''), '-') AS tag FROM t),
    x AS (SELECT kind, tag, count(*) AS n FROM k GROUP BY ALL
        UNION ALL SELECT 'rawtext', '-', count(*) FROM k WHERE tag IN ('script', 'style')
        UNION ALL SELECT 'close', tag, count(*) FROM k WHERE tag IN ('script', 'style') GROUP BY ALL)
    SELECT kind, tag, sum(n)::BIGINT AS tokens FROM x GROUP BY ALL""")
def _(spark, sf):
    tokens = table(spark, sf, "pages").select(F.explode(F.expr(M.tokens("html"))).alias("t"))
    return tokens.groupBy("t.kind", F.coalesce("t.tag", F.lit("-")).alias("tag")).agg(F.count("*").alias("tokens"))


PARENTS = {
    "html": "", "head": "html", "meta": "head", "title": "head", "style": "head", "script": "head", "body": "html",
    "nav": "body", "ul": "nav", "li": "ul", "a": "li", "div": "body", "article": "body", "h1": "article",
    "p": "article", "b": "p", "br": "b", "footer": "body",
}


@query("page_spans", f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages)
    SELECT page_id, tag, CASE tag {' '.join(f"WHEN '{t}' THEN '{p}'" for t, p in PARENTS.items())} END AS parent_tag,
        count(*) AS elements FROM t GROUP BY ALL""")
def _(spark, sf):
    docs = page_docs(spark, sf)
    inner = F.transform(
        F.col("doc.nodes"),
        lambda n: F.struct(n["tag"].alias("tag"), F.coalesce(
            F.when(n["parent"] >= 0, F.element_at(F.col("doc.events"), n["parent"] + 1)["tag"]), F.lit("")
        ).alias("parent_tag")),
    )
    return docs.select("page_id", F.inline(inner)).groupBy("page_id", "tag", "parent_tag").agg(F.count("*").alias("elements"))


@query("select_union", f"""WITH {P} SELECT page_id, len(regexp_extract_all(html, '<li>')) + 1 AS picked,
    {decoded("regexp_extract(html, '<a href=.([^>]*).>', 1)")} AS first_href,
    {decoded("regexp_extract(html, '(?s)<nav>.*?<li><a[^>]*>.*?</li><li><a[^>]*>(.*?)</a>', 1)")} AS second_item FROM p""")
def _(spark, sf):
    docs = page_docs(spark, sf)
    picked = F.size(F.expr(X.matches(sel("//nav//li | //article"), "doc.events", "doc.nodes")))
    return docs.select(
        "page_id", picked.cast("bigint").alias("picked"),
        F.coalesce(text_of("//nav//a/@href"), F.lit("")).alias("first_href"),
        F.coalesce(text_of("//nav/ul/li[2]/a"), F.lit("")).alias("second_item"),
    )


@query("select_predicates", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
    SELECT p.page_id, coalesce(min({decoded('h')}) FILTER (WHERE false), '') AS none,
        count(*) FILTER (WHERE contains(h, 'th')) AS holding, count(*) FILTER (WHERE h LIKE '/e%') AS starting,
        count(*) FILTER (WHERE h = '/de') AS equal FROM pages p LEFT JOIN a USING (page_id) GROUP BY p.page_id""")
def _(spark, sf):
    docs = page_docs(spark, sf)

    def many(selector):
        return F.size(F.expr(X.matches(sel(selector), "doc.events", "doc.nodes"))).cast("bigint")

    return docs.select(
        "page_id", F.coalesce(text_of("//a[0]"), F.lit("")).alias("none"),
        many('//a[contains(@href, "th")]').alias("holding"), many('//a[starts-with(@href,"/e")]').alias("starting"),
        many("//li/a[@href='/de']").alias("equal"),
    )


@query("article_text", f"SELECT page_id, {decoded(PLAIN.format(ARTICLE))} AS article_text FROM pages")
def _(spark, sf):
    return page_docs(spark, sf).select("page_id", text_of("//article").alias("article_text"))


@query("article_html", f"SELECT page_id, {escaped(CLOSED)} AS article_html FROM pages")
def _(spark, sf):
    docs = page_docs(spark, sf)
    one = f"element_at({X.matches(sel('//article'), 'doc.events', 'doc.nodes')}, 1)"
    html = M.let("_a", one, M.markup_between("doc.events", "_a.start", "_a.end"))
    return docs.select("page_id", F.expr(html).alias("article_html"))


@query("decode_entities", f"""SELECT page_id, {decoded("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} AS footer FROM pages""")
def _(spark, sf):
    inner = F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)
    cut = table(spark, sf, "pages").select("page_id", inner.alias("inner"))
    return cut.select("page_id", F.expr(M.decode_entities("inner")).alias("footer"))


# ---- extraction ----------------------------------------------------------------


@query("page_titles", f"WITH {P} SELECT page_id, title FROM p")
def _(spark, sf):
    return page_docs(spark, sf).select("page_id", T.trim_text(text_of("//h1")).alias("title"))


@query("content_gate", rf"""WITH g AS (SELECT page_id, url, {LABEL} AS url_label,
        {trimmed(decoded("regexp_extract(html, '(?s)<nav>.*?<a[^>]*>(.*?)</a>', 1)"))} AS t FROM pages)
    SELECT page_id, url_label, t AS gate_text, CASE WHEN translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        IN ('the', 'de', 'der', 'la') THEN 'open' ELSE 'closed' END AS gate FROM g""")
def _(spark, sf):
    docs = page_docs(spark, sf).withColumns(
        {
            "gate_selector": F.expr(sel("//nav//a")), "gate_selector_set": F.lit(True),
            "content_gate_values": F.array(*[F.lit(v) for v in ("The", "DE", "der", "la")]),
        }
    )
    return extraction.gate_columns(docs).select("page_id", U.url_label("url").alias("url_label"), "gate_text", "gate")


def _content(spark, sf, mode: str, include: str, remove: str) -> DataFrame:
    docs = page_docs(spark, sf).withColumn("mode", F.lit(mode))
    lines = docs.withColumns({"inc": T.split_lines(F.lit(include)), "rem": T.split_lines(F.lit(remove))})
    rules = lines.withColumns(
        {"inc": F.expr(C.compiled_rules("inc")), "rem": F.expr(f"transform(rem, _l -> {X.compiled('_l')})")}
    )
    html = C.content_html("doc.events", "doc.nodes", sel("//article"), "mode", "inc", "rem")
    return rules.select("page_id", F.expr(html).alias("content"))


@query("content_exclude", rf"""SELECT page_id, {escaped(rf"regexp_replace({CLOSED}, '(?s)<h1>.*?</h1>', '')")} AS content FROM pages""")
def _(spark, sf):
    return _content(spark, sf, "exclude", "", "//h1\n//div[")


@query("drop_nodes_in_order", rf"""SELECT page_id, {escaped(rf"regexp_replace(regexp_replace({CLOSED}, '(?s)<p>.*?</p>', ''), '(?s)<p>.*?</p>', '')")} AS content FROM pages""")
def _(spark, sf):
    return _content(spark, sf, "exclude", "", "//p[1]\n//p[1]")


@query("content_include", rf"""SELECT page_id, '<hr>' || {escaped(rf"array_to_string(list_transform(regexp_extract_all({CLOSED}, '(?s)<p>.*?</p>'), lambda x: '<q>' || x || '</q>'), '')")}
    || {escaped(rf"regexp_extract({CLOSED}, '(?s)<h1>.*?</h1>')")} AS content FROM pages""")
def _(spark, sf):
    return _content(spark, sf, "include", "html: <hr>\n//p | <q> | </q>\n//h1", "//h1")


# Lines of a text, each with single spaces; what stands between two lines are two breaks, of which one stays, and
# a paragraph begins and ends with one break less.
CLEAN_LINES = r"""list_transform(string_split(text, chr(10)), lambda x: regexp_replace(replace(x, chr(13), ' '), '\s\s+', ' ', 'g'))"""

# The same for markup ``c`` that begins and ends with a tag and writes breaks and paragraphs plainly: tags and texts, blank ones left out.
CLEAN_MARKUP = """replace(replace(replace(array_to_string(list_filter(list_transform(regexp_extract_all(c, '<[^>]*>|[^<]+'),
    lambda x: regexp_replace(translate(x, chr(13) || chr(10), '  '), ' +', ' ', 'g')), lambda x: trim(x) <> ''), ''),
    '<br><br>', '<br>'), '<p><br>', '<p>'), '<br></p>', '</p>')"""


@query("clean_content", rf"""WITH d AS (SELECT doc_id, lang, text, {CLEAN_LINES} AS ls FROM documents),
    e AS (SELECT doc_id, lang, text, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_full_match(x, '\s*') THEN '' ELSE x END), '<br>') AS b,
        regexp_full_match(ls[-1], '\s*') AS gap FROM d),
    f AS (SELECT doc_id, lang, text, gap, CASE WHEN starts_with(b, '<br>') THEN b[5:] ELSE b END AS b FROM e),
    g AS (SELECT doc_id, lang, text, CASE WHEN NOT gap THEN rtrim(b, ' ' || chr(9)) || ' ' WHEN ends_with(b, '<br>') THEN b[:-5] ELSE b END AS b FROM f)
    SELECT doc_id, '<p>' || b || '</p><!----><i>' || lang || '</i>' AS c0,
        '<p>' || b || '</p><pre>' || text || '</pre><i>' || lang || '</i>' AS content FROM g""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    broken = F.replace("text", F.lit("\n"), F.lit("<br>\n<BR />"))
    html = docs.select(
        "doc_id",
        F.concat(F.lit("<p>"), broken, F.lit("  </p> <pre>"), "text", F.lit("</pre> <i>"), "lang", F.lit("</i>")).alias("h"),
        F.concat(F.lit("<p>"), broken, F.lit("  </p> <!----> <i>"), "lang", F.lit("</i>")).alias("h0"),
    )
    return html.select("doc_id", F.expr(C.clean_content("h0")).alias("c0"), F.expr(C.clean_content("h")).alias("content"))


@query("excerpt", rf"""WITH a AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(
            regexp_replace(html, '(?s)<p><b>(.*?)<br>', '<p><b>\1<br></b></p>', 'g'), '(?s)<p>(.*?)</p>', 1),
            lambda x: {decoded(PLAIN.format('x'))}), lambda x: length(trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'))) > 50) AS ps FROM pages),
    w AS (SELECT page_id, list_filter(regexp_split_to_array({trimmed("coalesce(ps[1], '')")}, '[\n\r\t ]+'), lambda x: x <> '') AS w FROM a)
    SELECT page_id, array_to_string(w[1:55], ' ') || CASE WHEN len(w) > 55 THEN '...' ELSE '' END AS excerpt FROM w""")
def _(spark, sf):
    found = page_docs(spark, sf).select("page_id", extraction.long_paragraph().alias("t"))
    return found.select("page_id", F.coalesce(T.trim_words(T.trim_text("t")), F.lit("")).alias("excerpt"))


@query("trim_words", rf"""WITH t AS (SELECT doc_id, {trimmed(BARE.format("text"))} AS text FROM documents),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\n\r\t ]+'), lambda x: x <> '') AS w FROM t)
    SELECT doc_id, array_to_string(w[1:55], ' ') || CASE WHEN len(w) > 55 THEN '...' ELSE '' END AS words FROM w""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.trim_words("text").alias("words"))


@query("strip_title", rf"""SELECT page_id, {trimmed("regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', '', 'g')")} AS title FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("title"))


@query("prefix_css", r"""SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '' ELSE '<style>.' || p_brand || ' { color: ' || p_name || '; }</style>' || chr(10) END
    || '<p>' || p_name || '</p>' AS content FROM part""")
def _(spark, sf):
    css = F.concat(F.lit("  ."), "p_brand", F.lit(" {\n   color: "), "p_name", F.lit("; \r\n}\n"))
    part = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_type") == "SMALL", F.lit("0")).otherwise(css).alias("css"),
        F.concat(F.lit("<p>"), "p_name", F.lit("</p>")).alias("body"),
    )
    return part.select(
        "p_partkey",
        F.when(F.col("css") == "0", F.col("body")).otherwise(F.expr(C.prefix_css("css", "body"))).alias("content"),
    )


@query("allow_tags", rf"""SELECT page_id, regexp_replace({ARTICLE}, '</?(time|script|style)[^>]*>', '', 'g') AS article,
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<nav>.*</nav>'), '</?nav>', '', 'g'), ' onclick="x"', '', 'g') AS nav FROM pages""")
def _(spark, sf):
    cut = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", r"(?s)<article>.*</article>", 0).alias("a"),
        F.replace(F.regexp_extract("html", r"(?s)<nav>.*</nav>", 0), F.lit("<a "), F.lit('<a onclick="x" ')).alias("n"),
    )
    return cut.select("page_id", F.expr(C.allow_tags("a")).alias("article"), F.expr(C.allow_tags("n")).alias("nav"))


# ---- dates ---------------------------------------------------------------------


@query("month_dates", """SELECT o_orderkey, strftime(CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 904 MINUTE
        WHEN 'O' THEN o_orderdate + INTERVAL 545 MINUTE ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS shown FROM orders""")
def _(spark, sf):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Posted "), F.date_format(day, "MMM d, yyyy"), F.lit(" • 3:04 pm EST")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(" at 09:05")))
        .otherwise(F.date_format(day, "MMM dd,yyyy"))
    )
    written = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    shown = D.parse_month_date(D.normalize_date_text("t"))
    return written.select("o_orderkey", F.date_format(shown, "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("general_dates", """WITH d AS (SELECT o_orderkey, CASE o_orderpriority
        WHEN '1-URGENT' THEN o_orderdate WHEN '2-HIGH' THEN o_orderdate + INTERVAL 8 HOUR
        WHEN '3-MEDIUM' THEN o_orderdate + INTERVAL 630 MINUTE WHEN '5-LOW' THEN o_orderdate + INTERVAL 17 HOUR
        ELSE TIMESTAMP '2024-01-20 03:00:00' END AS utc FROM orders)
    SELECT o_orderkey, strftime(timezone('America/New_York', timezone('UTC', utc)), '%Y-%m-%d %H:%M:%S') AS shown FROM d""")
def _(spark, sf):
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(kind == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .when(kind == "2-HIGH", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00:00+02:00")))
        .when(kind == "3-MEDIUM", F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 10:30:00 GMT")))
        .when(kind == "5-LOW", F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 12:00 EST")))
        .otherwise(F.lit("some day soon"))
    )
    written = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    shown = D.date_or_now("t", D.JSONLD_ZONE, run_ts())
    return written.select("o_orderkey", F.date_format(shown, "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("jsonld_dates", """SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE
    strftime(timezone('America/New_York', timezone('UTC', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    published = F.concat(F.lit('{"@type": "NewsArticle", "datePublished": "'), iso, F.lit('"}'))
    created = F.concat(F.lit('{"datePublished": null, "dateCreated": "'), iso, F.lit('"}'))
    nested = F.concat(F.lit('[{"datePublished": "'), iso, F.lit('"}]'))
    scripts = (
        F.when(F.col("event_type") == "view", F.array(F.lit("{broken"), F.lit('{"datePublished": "soon"}'), created))
        .when(F.col("event_type") == "click", F.array(nested))
        .otherwise(F.array(published, F.lit('{"datePublished": "1999-01-01"}')))
    )
    docs = table(spark, sf, "events").select("event_id", scripts.alias("scripts"))
    return docs.select("event_id", F.date_format(D.jsonld_date("scripts", run_ts()), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("today_only", """SELECT event_id, (timezone('America/New_York', timezone('UTC', ts))::DATE = DATE '2024-01-19')::INT AS today FROM events""")
def _(spark, sf):
    items = table(spark, sf, "events").select("event_id", D.to_zone(F.col("ts"), D.JSONLD_ZONE).alias("post_date"))
    return imports.stream_today(items, run_ts(), D.JSONLD_ZONE).select("event_id", F.col("today").cast("int").alias("today"))


@query("short_zone", """SELECT event_id, CASE WHEN month(ts) BETWEEN 4 AND 10 THEN 'ET' ELSE 'ET' END AS zone FROM events""")
def _(spark, sf):
    printed = F.when(F.month("ts").between(4, 10), F.lit("EDT")).otherwise(F.lit("EST"))
    return table(spark, sf, "events").select("event_id", D.short_zone(printed).alias("zone"))


@query("article_fields", """WITH c AS (SELECT c_custkey, c_name, c_mktsegment AS seg, DATE '2024-01-01' + c_nationkey AS d FROM customer),
    x AS (SELECT *, CASE seg WHEN 'BUILDING' THEN d + INTERVAL 904 MINUTE WHEN 'FURNITURE' THEN d + INTERVAL 7 HOUR
        WHEN 'MACHINERY' THEN TIMESTAMP '2024-01-19 22:00:00' ELSE d::TIMESTAMP END AS t FROM c)
    SELECT c_custkey, 'About ' || c_name AS title, strftime(t, '%Y-%m-%d %H:%M:%S') AS post_date,
        CASE seg WHEN 'FURNITURE' THEN 'jsonld' WHEN 'MACHINERY' THEN 'run' ELSE 'selector' END AS date_source,
        CASE WHEN seg = 'FURNITURE' THEN 'ET' END AS source_timezone,
        '<article><p>Some words about ' || c_name || ', long enough for a summary.</p><img src="/img/' || c_custkey || '.png"></article>' AS content,
        'Some words about ' || c_name || ', long enough for a summary.' AS excerpt,
        CASE WHEN seg = 'MACHINERY' THEN 'https://shop.example.com/big/' || c_custkey || '.jpg'
            ELSE 'https://shop.example.com/img/' || c_custkey || '.png' END AS image_url FROM x""")
def _(spark, sf):
    """Whole field extraction over one small page per customer."""
    seg, day = F.col("c_mktsegment"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey"))
    time = (
        F.when(seg == "BUILDING", F.concat(F.lit("<time>"), F.date_format(day, "MMM d, yyyy"), F.lit(" 3:04 PM ET</time>")))
        .when(seg == "FURNITURE", F.concat(
            F.lit('<time> - </time><script type="application/ld+json">{"datePublished":"'),
            F.date_format(day, "yyyy-MM-dd"), F.lit('T12:00:00Z"}</script>')))
        .when(seg == "MACHINERY", F.concat(F.lit('<a class="lead" href="https://shop.example.com/big/'), F.col("c_custkey").cast("string"), F.lit('.jpg">x</a>')))
        .otherwise(F.concat(F.lit("<time>"), F.date_format(day, "MMMM d, yyyy"), F.lit("</time>")))
    )
    html = F.concat(
        F.lit("<html><body><h1> About "), "c_name", F.lit("</h1>"), time, F.lit("<article>\n <p>Some words about "), "c_name",
        F.lit(", long enough for a summary.</p>\n<img src='/img/"), F.col("c_custkey").cast("string"), F.lit(".png'/></article></body></html>"),
    )
    profile = spark.createDataFrame(
        [("c", "https://shop.example.com/", "//h1", "//article", "//time", '//a[@class="lead"]')],
        "profile_key string, source_url string, title_xpath string, content_xpath string, date_xpath string, image_xpath string",
    )
    config = profiles.profile_effective(profile)
    docs = table(spark, sf, "customer").select("c_custkey", html.alias("html"), F.lit("c").alias("profile_key"))
    # the settings are the one row above
    bound = extraction.bind_page(docs.join(F.broadcast(config), "profile_key"))
    return extraction.extract_fields(bound, run_ts(), D.JSONLD_ZONE).select(
        "c_custkey", "title", F.date_format("post_date", "yyyy-MM-dd HH:mm:ss").alias("post_date"), "date_source",
        "source_timezone", "content", "excerpt", "image_url",
    )


# ---- images --------------------------------------------------------------------

IMAGE_SQL = """img AS (SELECT p_partkey, 'https://cdn.example.com/' || CASE p_type WHEN 'ECONOMY' THEN 'a/' || p_partkey || '.JPG?x=1'
    WHEN 'SMALL' THEN 'b/' || p_partkey || '.pdf' WHEN 'STANDARD' THEN 'b/' || p_partkey
    ELSE 'c/' || replace(p_name, ' ', '-') || '.png' END AS image_url, p_size, p_brand, p_name, p_type FROM part)"""


def part_images(spark, sf):
    key = F.col("p_partkey").cast("string")
    tail = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("a/"), key, F.lit(".JPG?x=1")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("/b/"), key, F.lit(".pdf")))
        .when(F.col("p_type") == "STANDARD", F.concat(F.lit("https://cdn.example.com/b/"), key))
        .otherwise(F.concat(F.lit("c/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".png")))
    )
    url = U.resolve_link(tail, F.lit("https://cdn.example.com:8443/list?x"))
    return table(spark, sf, "part").select("p_partkey", url.alias("image_url"), "p_size", "p_brand", "p_name", "p_type")


@query("image_urls", f"""WITH {IMAGE_SQL} SELECT p_partkey, image_url, (p_type NOT IN ('SMALL', 'STANDARD'))::INT AS is_image FROM img""")
def _(spark, sf):
    return part_images(spark, sf).select("p_partkey", "image_url", U.is_image_url("image_url").cast("int").alias("is_image"))


ATTACHED_SQL = f"""{IMAGE_SQL}, att AS (SELECT p_partkey + 100000 AS attachment_id, 'https://site.example.org/up/' || CASE WHEN p_size > 30
        THEN replace(p_name, ' ', '-') || '.png' ELSE 'x' || p_partkey || '.jpg' END AS guid,
        CASE WHEN p_size < 10 THEN image_url END AS source_image_url FROM img),
    s AS (SELECT source_image_url AS image_url, min(attachment_id) AS by_source FROM att WHERE source_image_url IS NOT NULL GROUP BY ALL),
    n AS (SELECT regexp_extract(guid, '[^/]+$') AS name, min(attachment_id) AS by_name FROM att GROUP BY ALL),
    matched AS (SELECT i.*, by_source, by_name FROM img i LEFT JOIN s USING (image_url)
        LEFT JOIN n ON regexp_extract(split_part(i.image_url, '?', 1), '[^/]+$') = n.name)"""


def matched_images(spark, sf):
    items = part_images(spark, sf)
    guid = F.when(F.col("p_size") > 30, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".png"))).otherwise(
        F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    )
    attachments = items.select(
        (F.col("p_partkey") + 100000).alias("attachment_id"), F.concat(F.lit("https://site.example.org/up/"), guid).alias("guid"),
        F.when(F.col("p_size") < 10, F.col("image_url")).alias("source_image_url"),
    )
    return images.match_attachments(items, attachments)


@query("attachment_match", f"WITH {ATTACHED_SQL} SELECT p_partkey, by_source, by_name FROM matched")
def _(spark, sf):
    return matched_images(spark, sf).select("p_partkey", "by_source", "by_name")


@query("featured_image", f"""WITH {ATTACHED_SQL}, f AS (SELECT *, p_type NOT IN ('SMALL', 'STANDARD') AS ok, p_size - 25 AS fallback,
        coalesce(by_source, by_name) AS stored FROM matched)
    SELECT p_partkey, CASE WHEN ok AND stored IS NOT NULL THEN 'attachment' WHEN ok THEN 'external'
        WHEN fallback > 0 THEN 'fallback' ELSE 'none' END AS image_source,
        CASE WHEN ok THEN stored WHEN fallback > 0 THEN fallback END AS thumbnail_id,
        (NOT ok AND fallback > 0)::INT AS used_fallback FROM f""")
def _(spark, sf):
    items = matched_images(spark, sf).withColumn("fallback_image_id", F.col("p_size") - 25)
    return images.featured_image(items).select(
        "p_partkey", "image_source", "thumbnail_id", F.col("used_fallback").cast("int").alias("used_fallback")
    )


@query("mime_extension", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'jpg' WHEN 'SMALL' THEN 'svg' WHEN 'STANDARD' THEN 'webp' END AS extension FROM part""")
def _(spark, sf):
    kind = F.col("p_type")
    mime = F.when(kind == "ECONOMY", F.lit("image/jpeg")).when(kind == "SMALL", F.lit("image/svg+xml")).when(
        kind == "STANDARD", F.lit("image/webp")).otherwise(F.lit("text/html"))
    return table(spark, sf, "part").select("p_partkey", images.mime_extension(mime).alias("extension"))


# ---- outcomes ------------------------------------------------------------------

LIMIT = 5
ITEMS_SQL = rf"""{P}, {OLD},
    g AS (SELECT page_id, {trimmed(decoded("regexp_extract(html, '(?s)<nav>.*?<a[^>]*>(.*?)</a>', 1)"))} AS t FROM pages),
    it AS (SELECT page_id, url, host AS profile_key, page_id // 10 AS page_no, (page_id % 10)::INT AS link_pos, lang AS post_type,
        html LIKE '%</html>%' AS fetched, t AS gate_text, contains(t, 'e') AS is_open, title, {LABEL} AS label,
        DATE '2024-01-18' + (length(html) % 3)::INT AS day FROM p JOIN g USING (page_id)),
    known AS (SELECT DISTINCT lang AS post_type, title FROM old WHERE post_status = 'publish'),
    flagged AS (SELECT it.*, k.title IS NOT NULL AS title_known FROM it LEFT JOIN known k USING (post_type, title)),
    base AS (SELECT *, CASE WHEN NOT fetched THEN 'error' WHEN NOT is_open OR title_known OR day <> DATE '2024-01-19' THEN 'skipped' ELSE 'created' END AS status,
        CASE WHEN NOT fetched THEN 'Failed to fetch' WHEN NOT is_open THEN 'Content gate: "' || gate_text || '"'
            WHEN title_known THEN 'Title already exists' WHEN day <> DATE '2024-01-19' THEN 'Not published today' END AS reason,
        CASE WHEN fetched AND NOT is_open THEN label ELSE title END AS shown FROM flagged),
    firsts AS (SELECT profile_key, post_type, title, min(page_id) AS f FROM base WHERE status = 'created' GROUP BY ALL),
    live AS (SELECT b.* EXCLUDE (status, reason), f < page_id AND (status = 'created' OR reason = 'Not published today') AS blocked,
        CASE WHEN f < page_id AND (status = 'created' OR reason = 'Not published today') THEN 'skipped' ELSE status END AS status,
        CASE WHEN f < page_id AND (status = 'created' OR reason = 'Not published today') THEN 'Title already exists' ELSE reason END AS reason
        FROM base b LEFT JOIN firsts USING (profile_key, post_type, title)),
    cut AS (SELECT * FROM live QUALIFY coalesce(sum((status <> 'skipped')::INT) OVER (PARTITION BY profile_key ORDER BY page_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {LIMIT})"""


def page_items(spark, sf):
    """One item per page: host as profile, gate on the first navigation entry, a day
    from the page length; a page cut off before its end failed to fetch."""
    raw = table(spark, sf, "pages").withColumns({
        "fetched": F.contains("html", F.lit("</html>")),
        "post_date": F.date_add(F.lit("2024-01-18").cast("date"), (F.length("html") % 3)).cast("timestamp_ntz"),
    })
    docs = extraction.bind_page(raw)
    gate_text = T.trim_text(text_of("//nav//a"))
    titled = T.bind(docs, gate_text=gate_text, title=T.trim_text(text_of("//h1")), lang=text_of("/html/@lang")).drop("doc")
    items = titled.select(
        "page_id", "url", U.host_of("url").alias("profile_key"), F.floor(F.col("page_id") / 10).alias("page_no"),
        (F.col("page_id") % 10).cast("int").alias("link_pos"), F.col("lang").alias("post_type"), "fetched", "gate_text",
        F.when(F.contains("gate_text", F.lit("e")), F.lit("open")).otherwise(F.lit("closed")).alias("gate"),
        "title", T.strip_tags("title").alias("post_title"), "post_date", F.lit(True).alias("complete"),
        F.lit(LIMIT).alias("posts_per_batch"), "lang",
    ).withColumn("place", F.struct("page_no", "link_pos"))
    return stage(items, "items")


def judged_items(spark, sf, live=True):
    items = page_items(spark, sf)
    posts, _meta = imported_posts(items)
    known = outcome.title_exists(items, tables.imported_titles(posts))
    base = outcome.base_outcome(known, run_ts(), D.JSONLD_ZONE, today_only=True)
    return outcome.first_title_wins(base, ["profile_key"]) if live else base


@query("title_exists", f"WITH {ITEMS_SQL} SELECT page_id, title_known::INT AS title_known FROM flagged")
def _(spark, sf):
    items = page_items(spark, sf)
    known = outcome.title_exists(items, tables.imported_titles(imported_posts(items)[0]))
    return known.select("page_id", F.col("title_known").cast("int").alias("title_known"))


@query("title_dedup_dry", f"WITH {ITEMS_SQL} SELECT page_id, shown AS title, status, reason FROM base")
def _(spark, sf):
    return judged_items(spark, sf, live=False).select("page_id", "title", "status", "reason")


@query("title_dedup_live", f"WITH {ITEMS_SQL} SELECT page_id, shown AS title, status, reason FROM live")
def _(spark, sf):
    return judged_items(spark, sf).select("page_id", "title", "status", "reason")


@query("batch_cut", f"WITH {ITEMS_SQL} SELECT page_id, status, reason FROM cut")
def _(spark, sf):
    return outcome.batch_cut(stage(judged_items(spark, sf), "judged")).select("page_id", "status", "reason")


@query("run_stats", f"""WITH {ITEMS_SQL} SELECT profile_key, count(*) AS processed, count(*) FILTER (WHERE status = 'created') AS created,
    count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors FROM live GROUP BY profile_key""")
def _(spark, sf):
    return report.run_stats(judged_items(spark, sf))


@query("item_log", f"WITH {ITEMS_SQL} SELECT profile_key, url, shown AS title, status, reason FROM live WHERE status <> 'error'")
def _(spark, sf):
    return report.item_log(judged_items(spark, sf))


@query("reason_summary", f"WITH {ITEMS_SQL} SELECT status, coalesce(reason, '') AS reason, count(*) AS items FROM live GROUP BY ALL")
def _(spark, sf):
    return report.reason_summary(judged_items(spark, sf))


# ---- terms ---------------------------------------------------------------------

TERMS_SQL = f"""{CP}, want AS (SELECT DISTINCT profile_key, 'category' AS taxonomy, trim(unnest(string_split(categories, ','))) AS name FROM cp),
    w AS (SELECT * FROM want WHERE name <> ''),
    known AS (SELECT n_nationkey + 10 AS term_id, 'n' || n_nationkey AS name, 'category' AS taxonomy FROM nation WHERE n_regionkey < 3)"""


def _terms(spark, sf):
    nation = table(spark, sf, "nation").where("n_regionkey < 3")
    known = nation.select(
        (F.col("n_nationkey") + 10).cast("bigint").alias("term_id"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("category").alias("taxonomy"),
    )
    p = customer_profiles(spark, sf).withColumn("tags", F.lit(""))
    return p, terms.get_or_create_terms(terms.wanted_terms(p), known)


@query("terms_created", f"""WITH {TERMS_SQL}, fresh AS (SELECT DISTINCT taxonomy, name FROM w ANTI JOIN known USING (taxonomy, name))
    SELECT taxonomy, name, (SELECT max(term_id) FROM known) + 1 AS first_id, (SELECT max(term_id) + (SELECT count(*) FROM fresh) FROM known) AS last_id FROM fresh""")
def _(spark, sf):
    _p, (_linked, created) = _terms(spark, sf)
    return created.select(
        "taxonomy", "name", created.agg(F.min("term_id")).scalar().alias("first_id"),
        created.agg(F.max("term_id")).scalar().alias("last_id"),
    )


@query("terms_assigned", f"""WITH {TERMS_SQL} SELECT c.o_orderkey AS post_id, w.name AS term FROM orders c
    JOIN cp ON cp.c_custkey = c.o_custkey JOIN w USING (profile_key)""")
def _(spark, sf):
    p, (linked, _created) = _terms(spark, sf)
    posts = table(spark, sf, "orders").join(p.select("c_custkey", "profile_key"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("post_id"), "profile_key"
    )
    names = linked.select("term_id", "name").distinct()
    return terms.assign_terms(posts, linked).join(names, "term_id").select("post_id", F.col("name").alias("term"))


# ---- schedules -----------------------------------------------------------------


@query("interval_usage", f"""WITH {CP}, i AS (SELECT f, p, s, 'every_' || f || '_per_' || p AS interval_key, floor(s / f)::INT AS interval_seconds,
        f || ' time(s) per ' || p AS display FROM range(1, 25) r(f), (VALUES ('hour', 3600), ('day', 86400), ('week', 604800)) v(p, s)),
    k AS (SELECT 'every_' || least(24, greatest(1, cron_frequency::INT)) || '_per_' || CASE WHEN cron_period = 'month' THEN 'day' ELSE cron_period END AS interval_key FROM cp)
    SELECT interval_key, interval_seconds, display, count(k.interval_key) AS profiles FROM i LEFT JOIN k USING (interval_key) GROUP BY ALL""")
def _(spark, sf):
    """K1, K2: every interval with the number of profiles on it."""
    used = schedule.profile_interval(customer_profiles(spark, sf)).groupBy("interval_key").agg(F.count("*").alias("n"))
    return schedule.interval_table(spark).join(used, "interval_key", "left").select(
        "interval_key", "interval_seconds", "display", F.coalesce("n", F.lit(0)).alias("profiles")
    )


SCHEDULE_SQL = f"""{CP}, ev AS (
    SELECT 'import_profile_' || profile_key AS hook, CASE WHEN c_nationkey > 15 THEN 'daily' ELSE
        'every_' || least(24, greatest(1, cron_frequency::INT)) || '_per_' || CASE WHEN cron_period = 'month' THEN 'day' ELSE cron_period END END AS schedule,
        TIMESTAMP '2024-01-20 05:00:00' AS next_run FROM cp WHERE c_nationkey > 5
    UNION ALL SELECT 'import_profile_gone-' || s_suppkey, 'daily', TIMESTAMP '2024-01-20 06:00:00' FROM supplier
    UNION ALL SELECT 'other_' || s_suppkey, 'daily', TIMESTAMP '2024-01-20 06:00:00' FROM supplier),
    own AS (SELECT * FROM ev WHERE hook LIKE 'import_profile_%'),
    want AS (SELECT 'import_profile_' || profile_key AS hook, profile_key, cron_enabled = '1' AS enabled,
        least(24, greatest(1, cron_frequency::INT)) AS f, CASE WHEN cron_period = 'month' THEN 'day' ELSE cron_period END AS p, cron_frequency, cron_period FROM cp)"""


def _schedule(spark, sf):
    p = customer_profiles(spark, sf)
    keyed = schedule.profile_interval(p).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    mine = keyed.where("c_nationkey > 5").select(
        "hook", F.when(F.col("c_nationkey") > 15, F.lit("daily")).otherwise(F.col("interval_key")).alias("schedule"),
        F.lit("2024-01-20 05:00:00").cast("timestamp_ntz").alias("next_run"),
    )
    other = table(spark, sf, "supplier").select(
        F.explode(F.array(F.lit("import_profile_gone-"), F.lit("other_"))).alias("h"), "s_suppkey"
    ).select(
        F.concat("h", F.col("s_suppkey").cast("string")).alias("hook"), F.lit("daily").alias("schedule"),
        F.lit("2024-01-20 06:00:00").cast("timestamp_ntz").alias("next_run"),
    )
    return p, mine.unionByName(other)


@query("reconcile_schedule", f"""WITH {SCHEDULE_SQL}, b AS (SELECT coalesce(want.hook, own.hook) AS hook, enabled, own.schedule AS actual_key,
        'every_' || f || '_per_' || p AS ik, own.next_run AS nr,
        TIMESTAMP '2024-01-20 03:00:00' + to_seconds(floor(CASE p WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 ELSE 604800 END / f)::INT) AS fr
        FROM want FULL JOIN own ON want.hook = own.hook),
    a AS (SELECT *, CASE WHEN enabled IS NULL THEN 'cancel_orphan' WHEN NOT enabled AND actual_key IS NOT NULL THEN 'cancel' WHEN NOT enabled THEN 'none'
        WHEN actual_key IS NULL THEN 'create' WHEN actual_key = ik THEN 'keep' ELSE 'reschedule' END AS action FROM b)
    SELECT hook, action, actual_key, CASE WHEN enabled THEN ik END AS interval_key, strftime(CASE WHEN action IN ('create', 'reschedule') THEN fr WHEN action = 'keep' THEN nr END, '%Y-%m-%d %H:%M:%S') AS next_run FROM a WHERE action <> 'none'""")
def _(spark, sf):
    plan = schedule.reconcile_schedule(*_schedule(spark, sf), run_ts())
    return plan.withColumn("next_run", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss"))


@query("plugin_events", f"WITH {SCHEDULE_SQL} SELECT DISTINCT hook FROM own")
def _(spark, sf):
    return schedule.plugin_events(_schedule(spark, sf)[1])


@query("schedule_check", f"""WITH {SCHEDULE_SQL}, c AS (SELECT profile_key, 'every_' || cron_frequency || '_per_' || cron_period AS expected_key, schedule AS actual_key, next_run
        FROM want LEFT JOIN own USING (hook) WHERE enabled)
    SELECT profile_key, expected_key, actual_key, CASE WHEN actual_key IS NULL THEN 'not scheduled' WHEN actual_key = expected_key THEN 'matches' ELSE 'mismatch' END AS state,
        date_diff('second', TIMESTAMP '2024-01-20 03:00:00', next_run) AS seconds_until FROM c""")
def _(spark, sf):
    return schedule.schedule_check(*_schedule(spark, sf), run_ts())


# ---- whole runs ----------------------------------------------------------------


def crawl(spark, sf):
    """A crawl made of the pages: per host listing pages of ten links each, and the
    pages themselves, of which those cut off before their end came back with an error."""
    pages = table(spark, sf, "pages").withColumn("host", U.host_of("url"))
    order = sum_before(
        pages.select("host", "page_id", "url"), ["host"], F.floor(F.col("page_id") / 1024), ["page_id"], F.lit(1), "n"
    )
    link = F.concat(F.lit('<li><a href="'), "url", F.lit('">x</a></li>'))
    lists = (
        order.groupBy("host", F.floor(F.col("n") / 10).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("page_id", link.alias("link")))).alias("links"))
        .select(
            U.build_page_url(F.concat(F.lit("http://"), "host"), F.lit("page"), F.col("block") + 1).alias("url"),
            F.lit(200).alias("status"),
            F.concat(F.lit("<ul>"), F.array_join(F.transform("links", lambda x: x["link"]), ""), F.lit("</ul>")).alias("html"),
        )
    )
    status = F.when(F.contains("html", F.lit("</html>")), 200).otherwise(500)
    found = lists.unionByName(pages.select("url", status.alias("status"), "html"))
    limit = F.when(F.startswith("host", F.lit("www")), F.lit("0")).otherwise(F.lit("20"))
    hosts = pages.select("host").distinct().select(
        F.col("host").alias("profile_key"), F.col("host").alias("profile_name"), F.concat(F.lit("http://"), "host").alias("source_url"),
        F.lit("//li/a").alias("listing_xpath"), F.lit("//h1").alias("title_xpath"), F.lit("//article").alias("content_xpath"),
        F.lit("//time").alias("date_xpath"), F.lit("//h1").alias("remove_xpaths"), F.lit("1000").alias("max_pages"),
        limit.alias("posts_per_batch"), F.lit("News, Web").alias("categories"), F.lit("crawl").alias("tags"),
    )
    return hosts, stage(found, "crawl")


def crawl_history(spark, sf):
    titles = stage(page_titles_df(spark, sf).withColumn("lang", F.lit("post")), "history")
    return imported_posts(titles)


def crawl_sql(old: str, live: bool) -> str:
    blocked = "f < place" if live else "false"
    return f"""{P}, old AS ({old}),
    o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS n, CASE WHEN host LIKE 'www%' THEN 0 ELSE 20 END AS lim FROM p),
    l AS (SELECT *, n // 10 + 1 AS page_no, (n % 10)::INT AS link_pos, lim = 0 OR {NORM} NOT IN (SELECT {NORM} FROM old) AS is_new FROM o),
    per AS (SELECT host, page_no, sum(is_new::INT) AS fresh FROM l GROUP BY ALL),
    runp AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY host ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
    kept AS (SELECT l.* FROM l JOIN runp USING (host, page_no) WHERE lim = 0 OR before < lim),
    base AS (SELECT *, row(host, n) AS place, CASE WHEN html NOT LIKE '%</html>%' THEN 'error' WHEN title IN (SELECT title FROM old WHERE post_status = 'publish') THEN 'skipped' ELSE 'created' END AS status FROM kept WHERE is_new),
    f1 AS (SELECT host, title, min(place) AS f FROM base WHERE status = 'created' GROUP BY ALL),
    s1 AS (SELECT b.* EXCLUDE (status), CASE WHEN status = 'created' AND {blocked} THEN 'skipped' ELSE status END AS status FROM base b LEFT JOIN f1 USING (host, title)),
    c1 AS (SELECT * FROM s1 QUALIFY lim = 0 OR coalesce(sum((status <> 'skipped')::INT) OVER (PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < lim),
    f2 AS (SELECT title, min(place) AS f FROM c1 WHERE status = 'created' GROUP BY ALL),
    s2 AS (SELECT c.* EXCLUDE (status), CASE WHEN status = 'created' AND {blocked} THEN 'skipped' ELSE status END AS status FROM c1 c LEFT JOIN f2 USING (title)),
    res AS (SELECT host AS profile_key, url, CASE WHEN status = 'error' THEN NULL ELSE title END AS title, status,
        CASE status WHEN 'error' THEN 'Failed to fetch' WHEN 'skipped' THEN 'Title already exists' END AS reason FROM s2
        UNION ALL SELECT host, url, title, 'skipped', 'Already imported' FROM kept WHERE NOT is_new)"""


OLD_PAGES = OLD[OLD.index("(") + 1:-1]
NO_PAGES = "SELECT *, 'publish' AS post_status FROM p WHERE false"


def _run(spark, sf, live):
    hosts, found = crawl(spark, sf)
    posts, meta = crawl_history(spark, sf)
    empty = {t: spark.createDataFrame([], ddl) for t, ddl in (("terms", profiles.S.TERMS), ("attachments", profiles.S.ATTACHMENTS))}
    return import_run(hosts, found, posts, meta, empty["terms"], empty["attachments"], run_ts(), live=live)


@query("import_live", f"WITH {crawl_sql(OLD_PAGES, True)} SELECT profile_key, url, title, status, reason FROM res")
def _(spark, sf):
    return _run(spark, sf, True).outcomes.select("profile_key", "url", "title", "status", "reason")


@query("import_dry", f"WITH {crawl_sql(OLD_PAGES, False)} SELECT profile_key, url, title, status, reason FROM res")
def _(spark, sf):
    return _run(spark, sf, False).outcomes.select("profile_key", "url", "title", "status", "reason")


@query("import_posts", rf"""WITH {crawl_sql(OLD_PAGES, True)}, r AS (SELECT s2.*, {escaped(rf"regexp_replace({CLOSED}, '(?s)<h1>.*?</h1>', '')")} AS c FROM s2 WHERE status = 'created')
    SELECT title AS post_title, 'post' AS post_type, 'publish' AS post_status, '2024-01-20 03:00:00' AS post_date, {CLEAN_MARKUP} AS post_content FROM r""")
def _(spark, sf):
    return _run(spark, sf, True).posts.select(
        "post_title", "post_type", "post_status", F.date_format("post_date", "yyyy-MM-dd HH:mm:ss").alias("post_date"), "post_content"
    )


@query("import_refetched", f"""WITH {crawl_sql(OLD_PAGES, True)}, n AS (SELECT count(*) AS n FROM res WHERE status = 'created')
    SELECT profile_key, url, title, status, reason, n AS n_ids, n AS n_posts FROM res, n""")
def _(spark, sf):
    """Every page is there four times: stale, failed and twice as it is."""
    hosts, found = crawl(spark, sf)
    posts, meta = crawl_history(spark, sf)
    fetches = F.inline(F.array(*[
        F.struct(F.lit(t).cast("timestamp").alias("fetched_at"), status.alias("status"), html.alias("html"))
        for t, status, html in (
            ("2024-01-20 00:00:00", F.lit(200), F.lit("<h1>stale</h1>")), ("2024-01-20 01:00:00", F.lit(500), F.lit("")),
            ("2024-01-20 02:00:00", F.col("status"), F.col("html")), ("2024-01-20 02:00:00", F.col("status"), F.col("html")),
        )
    ]))
    pages = stage(found.select("url", fetches), "fetches")
    empty = {t: spark.createDataFrame([], ddl) for t, ddl in (("terms", profiles.S.TERMS), ("attachments", profiles.S.ATTACHMENTS))}
    run = import_run(hosts, pages, posts, meta, empty["terms"], empty["attachments"], run_ts(), live=True)
    n = run.posts.agg(F.countDistinct("post_id").alias("n_ids"), F.count("*").alias("n_posts"))
    return run.outcomes.select("profile_key", "url", "title", "status", "reason").crossJoin(F.broadcast(n))


# ---- streams -------------------------------------------------------------------


def event_stream(spark, sf):
    batch = table(spark, sf, "events")
    return (
        spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("at", F.col("ts").cast("timestamp"))
        .withColumn("url", F.concat(F.lit("HTTPS://Feed.example.com/U/"), F.col("user_id").cast("string"), F.lit("/")))
    )


def run_stream(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what has arrived into a table and read the table."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{imports.uuid4().hex}"
    done = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("stream_dedup_url", "SELECT DISTINCT 'https://feed.example.com/u/' || user_id AS norm_url FROM events")
def _(spark, sf):
    distinct = imports.stream_dedup_url(event_stream(spark, sf).select("url", "at"), "60 days", at="at")
    return run_stream(distinct.select("norm_url"), "dedup")


@query("stream_stats", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS processed,
    count(*) FILTER (WHERE event_type = 'purchase') AS created, count(*) FILTER (WHERE event_type = 'view') AS skipped,
    count(*) FILTER (WHERE event_type = 'click') AS errors FROM events GROUP BY ALL""")
def _(spark, sf):
    status = F.when(F.col("event_type") == "purchase", F.lit("created")).when(F.col("event_type") == "view", F.lit("skipped")).when(
        F.col("event_type") == "click", F.lit("error")).otherwise(F.lit("other"))
    stats = imports.stream_stats(event_stream(spark, sf).select("at", status.alias("status")), "at", "1 hour", "1 day")
    folder = f"{shared_folder(spark)}/stats-{imports.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    done = stats.writeStream.foreachBatch(keep).outputMode("complete").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    rows = spark.read.schema(stats.schema).parquet(f"{folder}/rows")
    return rows.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


@query("stream_import", f"WITH {crawl_sql(NO_PAGES, True)} SELECT profile_key, url, title, status, reason FROM res")
def _(spark, sf):
    """The crawl arrives as files, one unattended run takes what is there."""
    hosts, found = crawl(spark, sf)
    folder = f"{shared_folder(spark)}/crawl-{imports.uuid4().hex}"
    # every page was fetched twice, the first time without success
    again = F.inline(F.array(*[
        F.struct(F.lit(t).cast("timestamp").alias("fetched_at"), (F.col("status") if ok else F.lit(500)).alias("status"))
        for t, ok in (("2024-01-20 01:00:00", False), ("2024-01-20 02:00:00", True))
    ]))
    found.select("url", "html", again).select("url", "status", "html", "fetched_at").write.parquet(f"{folder}/pages")
    none = spark.createDataFrame([], profiles.S.ATTACHMENTS)
    done = imports.import_stream(
        imports.page_stream(spark, f"{folder}/pages"), stage(hosts, "hosts"), none, f"{folder}/out", f"{folder}/state", run_ts(),
    ).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/out/outcomes").select("profile_key", "url", "title", "status", "reason")


@query("stream_import_split", f"WITH {crawl_sql(NO_PAGES, True)} SELECT profile_key, title AS post_title FROM res WHERE status = 'created'")
def _(spark, sf):
    """Listing pages arrive first, the articles they name in a later trigger."""
    hosts, found = crawl(spark, sf)
    hosts = stage(hosts, "hosts")
    folder = f"{shared_folder(spark)}/crawl-{imports.uuid4().hex}"
    none = spark.createDataFrame([], profiles.S.ATTACHMENTS)
    listing = F.startswith("html", F.lit("<ul>"))
    for some in (listing, ~listing):
        rows = found.where(some).withColumn("fetched_at", F.lit("2024-01-20 02:00:00").cast("timestamp"))
        rows.select("url", "status", "html", "fetched_at").write.mode("append").parquet(f"{folder}/pages")
        imports.import_stream(
            imports.page_stream(spark, f"{folder}/pages"), hosts, none, f"{folder}/out", f"{folder}/state", run_ts(), today_only=False,
        ).start().awaitTermination()
    key = spark.read.parquet(f"{folder}/out/post_meta").where("meta_key = 'source_url'").select(
        "post_id", U.host_of("meta_value").alias("profile_key")
    )
    return spark.read.parquet(f"{folder}/out/posts").join(key, "post_id").select("profile_key", "post_title")


@query("import_written", f"""WITH {crawl_sql(OLD_PAGES, True)}
    SELECT profile_key, title AS post_title, {NORM} AS source_url, 3 AS n_meta, 'News,Web,crawl' AS terms,
        (SELECT count(*) FROM res r WHERE r.profile_key = res.profile_key) AS n_logged FROM res WHERE status = 'created'""")
def _(spark, sf):
    """The tables after a run that was written twice, and after an interrupted write of another."""
    result = _run(spark, sf, True)
    folder = f"{shared_folder(spark)}/site-{imports.uuid4().hex}"
    result.tables()["posts"].write.parquet(f"{folder}/posts/run=interrupted")
    for _ in range(2):
        write_run(result, folder, "first")
    stored = {
        name: tables.written(spark, folder, name, ddl) for name, ddl in (
            ("posts", profiles.S.POSTS), ("post_meta", profiles.S.POST_META), ("terms", profiles.S.TERMS),
            ("post_terms", profiles.S.POST_TERMS), ("outcomes", "profile_key string"),
        )
    }
    meta = stored["post_meta"].groupBy("post_id").agg(
        F.count("*").alias("n_meta"), F.max(F.when(F.col("meta_key") == "source_url", F.col("meta_value"))).alias("source_url")
    )
    names = stored["post_terms"].join(stored["terms"], "term_id").groupBy("post_id").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ",").alias("terms")
    )
    logged = stored["outcomes"].groupBy("profile_key").agg(F.count("*").alias("n_logged"))
    return stored["posts"].join(meta, "post_id").join(names, "post_id").withColumn("profile_key", U.host_of("source_url")).join(
        logged, "profile_key"
    ).select("profile_key", "post_title", "source_url", "n_meta", "terms", "n_logged")


@query("profiles_loaded", f"""WITH h AS (SELECT DISTINCT {HOST} AS profile_key FROM pages)
    SELECT profile_key, 'all' AS asked, '1000' AS max_pages FROM h UNION ALL SELECT min(profile_key), 'one', '1000' FROM h""")
def _(spark, sf):
    """A3: stored profiles, all of them and one by its key; a key that nobody has is an error."""
    hosts, _pages = crawl(spark, sf)
    path = f"{shared_folder(spark)}/profiles-{imports.uuid4().hex}"
    hosts.write.json(path)
    everyone = tables.load_profiles(spark, path)
    key = everyone.agg(F.min("profile_key")).first()[0]
    try:
        tables.load_profiles(spark, path, key=f"{key} and more")
    except ValueError:
        one = tables.load_profiles(spark, path, key=key)
    return everyone.withColumn("asked", F.lit("all")).unionByName(one.withColumn("asked", F.lit("one"))).select(
        "profile_key", "asked", "max_pages"
    )


@query("stream_import_thrice", f"""WITH {crawl_sql(NO_PAGES, True).replace("ELSE 20 END AS lim", "ELSE 0 END AS lim")}
    SELECT title, count(*) FILTER (status = 'created') AS n_created, count(DISTINCT url) AS n_urls, count(*) AS n_logged
    FROM res WHERE status <> 'error' GROUP BY ALL""")
def _(spark, sf):
    """Listing pages, half of the articles with a page nobody asked for, and the rest, in three triggers;
    every article is logged once and every title created once, as in one run (which of the articles of a title is
    first depends on what arrived first)."""
    hosts, found = crawl(spark, sf)
    hosts = stage(hosts.withColumn("posts_per_batch", F.lit("0")), "hosts")
    folder = f"{shared_folder(spark)}/crawl-{imports.uuid4().hex}"
    none = spark.createDataFrame([], profiles.S.ATTACHMENTS)
    listing, half = F.startswith("html", F.lit("<ul>")), F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    stray = spark.range(1).select(F.lit("http://nobody/asked").alias("url"), F.lit(200).alias("status"), F.lit("<h1>x</h1>").alias("html"))
    for rows in (found.where(listing), found.where(~listing & half).unionByName(stray), found.where(~listing & ~half)):
        rows.select("url", "status", "html", F.lit("2024-01-20 02:00:00").cast("timestamp").alias("fetched_at")).write.mode("append").parquet(f"{folder}/pages")
        imports.import_stream(
            imports.page_stream(spark, f"{folder}/pages"), hosts, none, f"{folder}/out", f"{folder}/state", run_ts(), today_only=False,
        ).start().awaitTermination()
    log = spark.read.parquet(f"{folder}/out/outcomes").where("status <> 'error'")
    return log.groupBy("title").agg(
        F.count_if(F.col("status") == "created").alias("n_created"), F.countDistinct("url").alias("n_urls"), F.count("*").alias("n_logged")
    )
