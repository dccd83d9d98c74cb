"""Feed documents (RSS 2.0, RSS 1.0, Atom, JSON Feed) to items."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

ITEM = "struct<title:string,link:string,summary:string,author:string,published_raw:string>"
FEED_RESULT = f"struct<items:array<{ITEM}>,error:string>"
# Fixed value: bytes that XML does not allow.
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def without_control_bytes(data: bytes) -> bytes:
    return _CONTROL.sub(b"", data).lstrip()


def _local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _namespace(element: ET.Element) -> str:
    return element.tag[1:].split("}")[0] if isinstance(element.tag, str) and element.tag.startswith("{") else ""


def _pick(element: ET.Element, *names: str) -> str:
    """Text of the first named child that has any; 'prefix:name' asks for a namespace containing the prefix."""
    for name in names:
        prefix, _, local = name.rpartition(":")
        for child in element:
            space = _namespace(child)
            if _local(child) == local and (prefix in space if prefix else not space or "rss" in space or "atom" in space.lower()):
                text = "".join(child.itertext()).strip()
                if text:
                    return text
    return ""


def _rss(item: ET.Element) -> dict:
    return {
        "title": _pick(item, "title"), "link": _pick(item, "link"), "summary": _pick(item, "content:encoded", "description"),
        "author": _pick(item, "author", "purl.org/dc:creator"), "published_raw": _pick(item, "pubDate", "purl.org/dc:date"),
    }


def _atom(entry: ET.Element) -> dict:
    links = [c for c in entry if _local(c) == "link" and c.get("href")]
    chosen = next((c for c in links if c.get("rel", "alternate") == "alternate"), links[0] if links else None)
    author = next((c for c in entry if _local(c) == "author"), None)
    return {
        "title": _pick(entry, "title"), "link": chosen.get("href").strip() if chosen is not None else "", "summary": _pick(entry, "summary", "content"),
        "author": _pick(author, "name") if author is not None else "", "published_raw": _pick(entry, "published", "updated"),
    }


def _json_item(entry: dict) -> dict:
    author = entry.get("author")
    if not isinstance(author, dict):
        authors = entry.get("authors")
        author = authors[0] if isinstance(authors, list) and authors and isinstance(authors[0], dict) else {}
    first = lambda *keys: next((str(entry[k]).strip() for k in keys if entry.get(k)), "")
    return {
        "title": first("title"), "link": first("url", "external_url"), "summary": first("summary", "content_text", "content_html"),
        "author": str(author.get("name") or "").strip(), "published_raw": first("date_published", "date_modified"),
    }


def feed_items(raw: bytes | str | None) -> list[dict]:
    """Items of a feed document; raises ValueError where it is none. Bytes let the XML declaration name the encoding."""
    data = raw.encode() if isinstance(raw, str) else raw or b""
    if data.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{"):
        entries = json.loads(data.decode("utf-8-sig", "replace")).get("items") or []
        return [_json_item(e) for e in entries if isinstance(e, dict)]
    try:
        root = ET.fromstring(without_control_bytes(data))
    except ET.ParseError as e:
        raise ValueError(f"no feed: {e}") from None
    kind = _local(root)
    if kind == "rss":
        return [_rss(i) for i in root.iterfind(".//channel/item")]
    if kind == "feed":
        return [_atom(e) for e in root if _local(e) == "entry"]
    if kind == "RDF":  # items of RSS 1.0 carry a namespace
        return [
            {k: v for k, v in _rss(_stripped(i)).items()} for i in root if _local(i) == "item"
        ]
    raise ValueError(f"no feed: root element {kind}")


def _stripped(item: ET.Element) -> ET.Element:
    """RSS 1.0 children without their own namespace; those of other vocabularies keep it."""
    copy = ET.Element("item")
    for child in item:
        twin = ET.SubElement(copy, _local(child) if "purl.org/rss/1.0" in _namespace(child) and "content" not in _namespace(child) else child.tag)
        twin.text = "".join(child.itertext())
    return copy


def read_feed(raw) -> dict:
    """{items, error}: errors are data, an executor never raises."""
    try:
        return {"items": feed_items(raw), "error": None}
    except Exception as e:  # noqa: BLE001
        return {"items": [], "error": f"{type(e).__name__}: {e}"}
