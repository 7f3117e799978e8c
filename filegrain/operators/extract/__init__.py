"""Extractors: bytes of one file -> Report. They are looked up by parser name, so further ones can be registered."""

from __future__ import annotations

from collections.abc import Callable

from .report import Report

PARSERS: dict[str, Callable[[bytes, Report], None]] = {}


def parser(name: str):
    """Register a function (bytes, Report) under a parser name; a later one replaces it."""

    def put(f):
        PARSERS[name] = f
        return f

    return put


def load() -> dict[str, Callable[[bytes, Report], None]]:
    """All built-in parsers; imported on use, so that an executor pays for them once."""
    from . import audio, images, isobmff, matroska, office, ole, pdf, svg  # noqa: F401

    return PARSERS
