"""Table schemas. ``pages`` holds one row per URL."""

from __future__ import annotations

# fixed values: profile fields and their defaults, in stored order
PROFILE_DEFAULTS = {
    "profile_name": "Default Profile", "source_url": "", "post_type": "post",
    "listing_xpath": "", "title_xpath": "", "content_xpath": "", "date_xpath": "",
    "excerpt_xpath": "", "image_xpath": "", "content_gate_xpath": "", "content_gate_values": "",
    "content_filter_mode": "exclude", "include_xpaths": "", "remove_xpaths": "",
    "start_page": "1", "max_pages": "1", "posts_per_batch": "9", "post_status": "publish",
    "categories": "", "tags": "", "page_param": "page", "fallback_image_id": "0",
    "custom_css": "", "cron_enabled": "0", "cron_frequency": "1", "cron_period": "day",
}
# fixed values: defaults used when a stored profile lacks the field at load time
LOAD_DEFAULTS = {**PROFILE_DEFAULTS, "posts_per_batch": "0"}
# fixed values: fields a run needs, and the shorter list of a test run
REQUIRED_FIELDS = ("source_url", "post_type", "listing_xpath", "title_xpath", "content_xpath", "date_xpath")
TEST_RUN_FIELDS = tuple(f for f in REQUIRED_FIELDS if f != "post_type")
# fixed values: fields shown by the profile report, in its order
REPORT_FIELDS = (
    "profile_name", "source_url", "post_type", "listing_xpath", "title_xpath", "content_xpath",
    "date_xpath", "excerpt_xpath", "image_xpath", "categories", "tags", "post_status",
    "start_page", "max_pages", "posts_per_batch",
)
POST_STATUSES = ("publish", "draft")
FILTER_MODES = ("include", "exclude")
PERIODS = ("hour", "day", "week")
# fixed value: states in which a stored title blocks a new one
TITLE_STATES = ("publish", "draft", "pending", "private")

PROFILES = "profile_key string, " + ", ".join(f"{f} string" for f in PROFILE_DEFAULTS)
PAGES = "url string, status int, html string, fetched_at timestamp"
POSTS = (
    "post_id bigint, post_type string, post_title string, post_content string, post_excerpt string,"
    " post_status string, post_date timestamp_ntz, post_author bigint"
)
POST_META = "post_id bigint, meta_key string, meta_value string"
TERMS = "term_id bigint, name string, taxonomy string"
POST_TERMS = "post_id bigint, term_id bigint"
ATTACHMENTS = "attachment_id bigint, guid string, source_image_url string"
EVENTS = "hook string, schedule string, next_run timestamp_ntz"
META_KEYS = (
    "source_url", "imported_from", "import_date", "source_timezone", "used_fallback_featured_image",
    "source_image_url",
)
