"""SVG: attributes, texts and active content, by patterns over the text."""

from __future__ import annotations

import re

from . import parser
from .binary import entities, text
from .exif import emit_xmp
from .report import Report

ATTRIBUTES = ("inkscape:version", "sodipodi:docname", "inkscape:export-filename", "inkscape:export-xdpi")
ACTIVE = {"<script> tags": r"<script\b", "on* event handlers": r"\son[a-z]+\s*=", "<foreignObject>": r"<foreignObject\b", "External/js/data links": r"""(?:xlink:)?href\s*=\s*["'](?:https?:|javascript:|data:)[^"']*["']"""}
MADE_BY = re.compile("generator|created|illustrator|inkscape|sketch|figma|export", re.I)


@parser("svg")
def svg(b: bytes, R: Report) -> None:
    t, s = text(b[: 16 << 20]), R.section("svg", "SVG")
    if root := re.search(r"<svg\b([^>]*)>", t, re.I):
        found = {k.lower(): v for k, _, v in reversed(re.findall(r"""\s([\w:.-]+)\s*=\s*(["'])(.*?)\2""", root[1], re.S))}
        if found.get("width"):
            s.add("width × height", f"{found['width']} × {found.get('height')}")
        for k in ("viewBox", "version"):
            s.add(k, found.get(k.lower()))
        s.add("Namespaces", "\n".join(f"{k}={v}" for k, v in re.findall(r"""xmlns:([\w-]+)\s*=\s*["']([^"']*)["']""", root[1])), False)
        for k in ATTRIBUTES:
            s.add(k, found.get(k), True)
    for tag in ("title", "desc"):
        if m := re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", t, re.I | re.S):
            s.add(tag, entities(m[1]).strip())
    for c in [c for c in (x.strip() for x in re.findall(r"<!--(.*?)-->", t, re.S)) if MADE_BY.search(c)][:5]:
        s.add("Generator comment", c, True)
        R.highlight(f"🛠 {c[:60]}")
    if re.search(r"<metadata\b", t, re.I):
        emit_xmp(R, t)
    n = {k: len(re.findall(p, t, re.I)) for k, p in ACTIVE.items()}
    for k, v in n.items():
        s.add(k, v or None)
    if acts := n["<script> tags"] + n["on* event handlers"]:
        R.flag("svg-script", "danger", f"SVG contains scripts/event handlers ({acts})")
    if re.search("javascript:", t, re.I):
        R.flag("svg-js-url", "danger", "SVG contains a javascript: URL")
