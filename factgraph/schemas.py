"""Schemas of the published tables."""

from __future__ import annotations

VERTICES = "label string, id long, text string, subject string, predicate string, object string, confidence double, title string, url string, date string, is_reference boolean"
EDGES = "src long, dst long, type string, weight double"
