"""Accent folding."""

from __future__ import annotations

import unicodedata


def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition; case is kept."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)
