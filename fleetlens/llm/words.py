"""Words of UTF-8 texts, A-Z lower-cased, block by block."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

BLOCK = 1 << 20  # bytes of a text whose words are held at once

_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}
# Words of prose end at a blank and at 9 to 13; terms are letters and whatever is not ASCII.
PROSE = bytes(0x20 if i == 0x20 or 0x09 <= i <= 0x0D else _LOWER.get(i, i) for i in range(256))
TERM = bytes(_LOWER.get(i, i) if i in _LOWER or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


def blocks(data: bytes | memoryview, table: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from ``size`` bytes or one longer word."""
    view = memoryview(data)
    rest = b""
    for at in range(0, len(view), size):
        part = rest + bytes(view[at : at + size]).translate(table)
        if at + size < len(view):
            # The last word may go on in the next block.
            end = part.rfind(b" ") + 1
            part, rest = part[:end], part[end:]
        found = part.split(b" ")
        yield [w for w in found if w] if b"" in found else found


def counted(data: bytes | memoryview, table: bytes) -> Counter:
    """How often each word occurs."""
    total: Counter = Counter()
    for found in blocks(data, table):
        total.update(found)
    return total
