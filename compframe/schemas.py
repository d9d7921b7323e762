"""Table schemas of the domain."""

from __future__ import annotations

RAW_PAGES = "page_id bigint, url string, source string, city string, html string, fetched_at timestamp"
AUCTIONS = (
    "id bigint, url string, price_eur double, city string, neighborhood string, address string, "
    "property_type string, size_sqm double, rooms int, floor int, is_partial_ownership boolean, "
    "is_expired boolean, court string, auction_start string, auction_end string, "
    "scraped_at timestamp, first_seen_at timestamp, last_updated_at timestamp")
MARKET = (
    "id bigint, city string, neighborhood string, size_sqm double, price_eur double, price_per_sqm double, "
    "rooms int, source string, scraped_at timestamp")
DEALS = (
    "id string, city string, neighborhood string, address string, price bigint, effective_price bigint, "
    "sqm double, price_per_sqm bigint, market_avg bigint, market_price bigint, savings_eur bigint, "
    "comparables_count int, comparables_level string, market_min_sqm bigint, market_max_sqm bigint, "
    "discount double, property_type string, floor int, property_type_bg string, auction_start string, "
    "auction_end string, url string, matched_neighborhood string, partial_ownership string, score int")
# older names of deal fields, read beside the current ones
DEAL_ALIASES = (
    "bcpea_id string, auction_price double, price_eur double, discount_pct double, market_sample_size int, "
    "market_median_eur double, size_sqm double")
SUBSCRIBERS = (
    "id bigint, email string, cities_json string, min_discount int, verified boolean, created_at timestamp, "
    "verified_at timestamp, last_sent_at timestamp, last_deal_ids_json string")
USERS = "id bigint, email string, tier string, status string, created_at timestamp"
BILLING_EVENTS = "event_id string, event_type string, payload_json string, ts timestamp"
LEDGER = "city string, source string, success boolean, n bigint, error string, completed_at timestamp"
AGENCY_LISTINGS = (
    "id bigint, source string, agency string, listing_url string, district string, property_type string, "
    "area_sqm double, floor_text string, price_eur double, is_active boolean")
POSTS = "id string, group_name string, text string, ts timestamp"
REQUESTS = "key string, ts timestamp, id bigint"
ALERT_RULES = "user_id bigint, city string, min_price double, max_price double, keywords array<string>, active boolean"
