"""Byte-level word splitting shared by the workers of several operators."""

from __future__ import annotations

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

# Letters a-z, digits and every byte of a non-ASCII character are word bytes; the rest become spaces.
ALNUM_LOWER = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Runs of anything but tab, line feed, vertical tab, form feed, carriage return and space; A-Z lowered."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z lowered."""
    return text.translate(ALNUM_LOWER).split()


def pieces(batch_texts, most_bytes: int = 4 << 20):
    """(first row, texts) slices of a batch, each of about most_bytes or one text; null counts as empty."""
    begun, held, size = 0, [], 0
    for k, text in enumerate(batch_texts):
        text = text or b""
        if held and size + len(text) > most_bytes:
            yield begun, held
            begun, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield begun, held
