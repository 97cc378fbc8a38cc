"""Words of a text as UTF-8 bytes."""

from __future__ import annotations


def _table() -> bytes:
    """A-Z become a-z; ASCII other than letters and digits becomes a blank."""
    out = bytearray(range(256))
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalnum() else 32
    return bytes(out)


_FOLD = _table()


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_FOLD).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []
