"""Words of a text, as bytes: every separator is ASCII, so UTF-8 can be cut without decoding."""

from __future__ import annotations

_LICENSE_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of `text` with A-Z lower-cased and all else as it is; a missing text is empty."""
    return text.encode().lower() if text else b""


def split_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() cuts at exactly these characters."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    return ascii_lower(text).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode().translate(_LICENSE_WORD).split() if text else []
