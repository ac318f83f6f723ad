"""The tables of a snapshot and the form of the change log."""

CHANGE = "domain string, collection string, group_key string, kind string, entity_key string, pos int, title string, text string, link string, category string, old_value string, new_value string, payload string"
CHANGE_FIELDS = dict(f.split() for f in CHANGE.split(", "))
CELLS = "array<struct<name: string, value: string>>"
SCHEMAS = {
    "products": "product_id string, vendor_id_name string, status_sort string, product_name string, protection_profiles array<struct<pp_short_name: string>>, pos int",
    "profiles": "pp_id string, pp_short_name string, pp_name string, sunset_date string, status string, pos int",
    "decisions": "td_id string, identifier string, title string, removed_on string, pp_short_name string, pos int",
    "labs_directory": "cctl_id string, name string, status_id struct<status_name: string>, pos int",
    "events": "id string, title string, link string, pos int",
    "news": "id string, title string, link string, url string, date string, pos int",
    "portal_news": "text string, link string, pos int",
    "portal_pps": f"cells {CELLS}, pos int",
    "portal_products": f"cells {CELLS}, pos int",
    "page_items": "domain string, page_key string, text string, href string, pos int",
    "feed_items": "domain string, feed_name string, title string, link string, summary string, published string, id string, pos int",
    "doc_headers": "domain string, doc_name string, url string, status_code int, last_modified string, etag string, content_length string, partial_hash string",
}
