"""Capacity limits of an evidence bundle, in bytes unless said otherwise."""

MIB = 1024 * 1024
ARTIFACT = 16 * MIB
TRACE = 64 * MIB
BUNDLE = 256 * MIB
ENTRIES = 10_000
DEPTH = 64
BYTES_PER_NODE = 16
SPANS = 50_000


def nodes(size: int) -> int:
    """JSON nodes that a document of that many bytes may have."""
    return max(size // BYTES_PER_NODE, 1)
