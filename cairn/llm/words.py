"""Words of a text as bytes: A-Z lower-cased, split at ASCII characters that are no letter or digit."""

from __future__ import annotations

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def ascii_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()
