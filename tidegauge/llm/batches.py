"""Cutting Arrow batches of texts into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Texts of a block, and their characters.
BLOCK, BLOCK_CHARS = 256, 2 << 20


def blocks(texts: list[str | None], count: int = BLOCK, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``count`` texts and about ``chars`` characters; a longer text stands alone."""
    start = held = 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if k > start and (k - start == count or held + size > chars):
            yield start, k
            start, held = k, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
