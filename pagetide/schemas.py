"""Schemas of the model tables."""

from __future__ import annotations

SITES = "id long, name string, url string, site_type string, created_at timestamp"
RUNS = "run_id long, site_id long, completed_at timestamp, status string"
RUN_COUNTERS = "processed int, requested int, successful int, forbidden int, errors int, limited boolean"
PAGE_RECORDS = "page_id long, run_id long, sequence_number int, url string, depth int, outcome string, message string, http_status int"
PRICE = "struct<amount: string, currency: string, kind: string, source: string>"
SNAPSHOTS = f"page_id long, run_id long, url string, title string, description string, h1 string, normalized_text string, content_hash string, internal_links array<string>, prices array<{PRICE}>"
METRICS = "site_id long, period_start date, period_end date, normalized_url string, clicks long, impressions long, average_position_text string"
DAILY_METRICS = "source_id long, metric_date date, normalized_url string, clicks long, impressions long, position_text string"
SCHEDULES = "site_id long, enabled boolean, frequency string, local_weekday int, local_time string, next_run_at timestamp"
ENTRIES = "id long, site_id long, schedule_id long, scheduled_for timestamp, completed_at timestamp, status string, missed_periods int"
VIEW_STATES = "source string, event_id long, viewed_at timestamp"
EVENT_COLUMNS = ["current_run_id", "previous_run_id", "event_type", "url", "current_page_id", "previous_page_id", "current_completed_at", "importance", "weight", "text_distance", "ratio_numerator", "ratio_denominator"]

#: Outcomes of a page request, the ones that are errors, and run statuses.
OUTCOMES = ("html", "non_html", "oversized", "parse_error", "forbidden", "redirect", "http_error", "network_error", "timeout")
ERROR_OUTCOMES = ("oversized", "parse_error", "redirect", "http_error", "network_error", "timeout")
SNAPSHOT_EVENTS = ("page_added", "page_removed", "title_changed", "description_changed", "h1_changed", "text_changed", "internal_links_changed")
EVENT_TYPES = (*SNAPSHOT_EVENTS, "price_changed")
