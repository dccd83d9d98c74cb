"""Sitemap documents to entries."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from kiteloom.sources.feeds import without_control_bytes

MAX_CHILDREN = 8
SITEMAP_RESULT = "struct<entries:array<struct<loc:string,lastmod:string>>,children:array<string>,error:string>"


def read_sitemap(raw) -> dict:
    """{entries, children, error}: the addresses of a urlset, or the first child sitemaps of an index."""
    try:
        data = raw.encode() if isinstance(raw, str) else raw or b""
        root = ET.fromstring(without_control_bytes(data))
    except ET.ParseError as e:
        return {"entries": [], "children": [], "error": f"ParseError: {e}"}
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def part(node, name):
        return next(((c.text or "").strip() for c in node if local(c) == name), "") or None

    if local(root) == "sitemapindex":
        return {"entries": [], "children": [loc for c in root if (loc := part(c, "loc"))][:MAX_CHILDREN], "error": None}
    return {"entries": [{"loc": loc, "lastmod": part(c, "lastmod")} for c in root if local(c) == "url" and (loc := part(c, "loc"))], "children": [], "error": None}
