"""Schemas of tables that are not read from Parquet; readers never infer."""

from __future__ import annotations

FETCHES = "url string, html string, http_code int, content_type string, outcome string, location string"
MANIFEST = (
    "timestamp string, mode string, profile string, threads int, max_depth int, max_pages long, seed_hash decimal(20,0), "
    "section string, elapsed_ms double, seeds_added long, discovered long, fetched long, nodes long, edges long"
)
