"""Schemas of the engine's own tables."""

EVENT = (
    "title string, start date, end date, time string, town string, venue string, category string, url string, note string, price string, "
    "free boolean, image string, outdoor boolean, online boolean, source string, submitted_by string, approved boolean"
)
SNAPSHOT = EVENT + ", fingerprint string, sources array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz"
RUN = "id bigint, scraper string, started_at timestamp_ntz, ok boolean, found int, added int, error string"
RULE = "url string, needle string, town string, date date"
OVERRIDE = "url string, needle string, town string, category string"
CANCELLATION = "needle string, town string, date date, note string"
