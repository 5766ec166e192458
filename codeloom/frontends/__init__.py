"""Front ends: from a file's text to entity and symbol rows."""

from __future__ import annotations

from codeloom.frontends.braces import extract as generic
from codeloom.frontends.python import extract as python
from codeloom.frontends.scoped import LANGUAGES as SCOPED
from codeloom.frontends.scoped import extract as scoped


def extract(lang: str, text: str) -> tuple[list[dict], list[dict], str | None]:
    """(entities, symbols, error): rows without ids, in reading order. What can be read of a text with errors is kept."""
    if lang == "python":
        entities, symbols, error = python(text)
        return (*generic(lang, text)[:2], error) if error else (entities, symbols, None)
    return scoped(lang, text) if lang in SCOPED else generic(lang, text)
