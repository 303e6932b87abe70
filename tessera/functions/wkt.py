"""Text and JSON geometries to rings."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")

Ring = list[tuple[float, float]]


class BadGeometry(ValueError):
    """The text isn't a geometry."""


def _tokens(text: str) -> list[str]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadGeometry(f"unexpected text at {at}")
        out.append(m[1])
        at = m.end()
    return out


def parse(text: str) -> tuple[str, list[list[Ring]]]:
    """The type in capitals and, for POLYGON and MULTIPOLYGON, the parts, each a list of rings (shell first). Other types have no parts."""
    tokens = _tokens(text or "")
    if not tokens or not tokens[0].isalpha():
        raise BadGeometry("no geometry type")
    kind, at = tokens[0].upper(), 1
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        if kind not in ("POINT", "LINESTRING", "LINEARRING", "MULTIPOINT", "MULTILINESTRING", "GEOMETRYCOLLECTION"):
            raise BadGeometry(f"unknown type {kind}")
        return kind, []
    if tokens[1:] and tokens[1].upper() == "EMPTY":
        if len(tokens) > 2:
            raise BadGeometry("text after EMPTY")
        return kind, []

    def take(what: str) -> None:
        nonlocal at
        if at >= len(tokens) or tokens[at] != what:
            raise BadGeometry(f"expected {what!r}")
        at += 1

    def listed(item) -> list:
        nonlocal at
        take("(")
        out = [item()]
        while at < len(tokens) and tokens[at] == ",":
            at += 1
            out.append(item())
        take(")")
        return out

    def number() -> float:
        nonlocal at
        try:
            value = float(tokens[at])
        except (IndexError, ValueError):
            raise BadGeometry("expected a number") from None
        at += 1
        return value

    def position() -> tuple[float, float]:
        x, y = number(), number()
        while at < len(tokens) and tokens[at] not in "(),":
            number()  # further ordinates have no place in the plane
        return x, y

    def ring() -> Ring:
        points = listed(position)
        if points[0] != points[-1]:
            raise BadGeometry("ring isn't closed")
        if len(points) < 4:
            raise BadGeometry("ring has fewer than four points")
        return points

    parts = listed(lambda: listed(ring)) if kind == "MULTIPOLYGON" else [listed(ring)]
    if at < len(tokens):
        raise BadGeometry("text after the geometry")
    return kind, parts


def parse_geojson(text: str) -> tuple[str, list[list[Ring]]]:
    """As ``parse``, from a GeoJSON geometry object."""
    try:
        shape = json.loads(text)
        kind = shape["type"].upper()
        if kind not in ("POLYGON", "MULTIPOLYGON"):
            return kind, []
        parts = [shape["coordinates"]] if kind == "POLYGON" else shape["coordinates"]
        return kind, [[[(float(p[0]), float(p[1])) for p in ring] for ring in rings] for rings in parts]
    except (ValueError, KeyError, TypeError, IndexError, AttributeError) as e:
        raise BadGeometry(str(e)) from None


def as_rings(parts: list[list[Ring]]) -> list[dict]:
    """Rows of the rings column."""
    return [{"part": i, "is_hole": j > 0, "pts": [{"x": float(x), "y": float(y)} for x, y in ring]} for i, rings in enumerate(parts) for j, ring in enumerate(rings)]
