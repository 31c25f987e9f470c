"""Deterministic corpora for tests of chunking and packing: of mixed entropy, and in two versions."""

from __future__ import annotations

import random

KIB = 1024


def mixed_entropy(size: int, seed: int = 1) -> bytes:
    """Four quarters: repeated text, zeros, noise, counted records."""
    quarter = size // 4
    text = (b"a line of text that repeats\n" * (quarter // 28 + 1))[:quarter]
    records = b"".join(b"record %08d;" % i for i in range(quarter // 16 + 1))
    return (text + bytes(quarter) + random.Random(seed).randbytes(quarter) + records)[:size].ljust(size, b"\0")


def two_versions(size: int, seed: int = 2) -> tuple[bytes, bytes]:
    """Blocks of several kinds, and the same with bytes put in at a third and replaced at three quarters."""
    rng = random.Random(seed)
    words = [b"asset/%04d|mesh|texture|" % i * 300 for i in range(16)]
    makers = (lambda i: words[i % 16][: 4 * KIB], lambda i: words[i * 7 % 16][: 4 * KIB], lambda i: bytes([i % 251]) * (4 * KIB), lambda i: bytes((i + k) % 256 for k in range(4 * KIB)), lambda i: rng.randbytes(4 * KIB))
    old = b"".join(makers[i % 5](i) for i in range(-(-size // (4 * KIB))))[:size]
    at = size // 3 + 777
    new = bytearray(old[:at] + b"put in|" * (size // 1400) + old[at:])
    there = len(new) * 3 // 4
    new[there : there + size // 250] = rng.randbytes(size // 250)
    return old, bytes(new)


def sparse_tree(world_bytes: int = 1 << 22, seed: int = 5042, regions: int = 16) -> dict[str, bytes]:
    """A small tree of files by path: text, settings, repeated and random bytes, an empty file, and a world that is
    zero but for marked regions, at its ends, across a chunk's border and at drawn places."""
    if world_bytes < 1 << 20:
        raise ValueError("a world has 1 MiB at least")
    rng = random.Random(seed)
    room = world_bytes - 4 * KIB
    places = sorted({0, 256 * KIB - KIB, room, *(rng.randrange(room) for _ in range(regions))})
    world = bytearray(world_bytes)
    for place in places:
        world[place : place + 4 * KIB] = random.Random(seed ^ place).randbytes(4 * KIB)
    ramp = bytes(range(256))
    return {"readme.txt": b"a generated tree\n", "config.json": b'{"seed": %d}\n' % seed, "assets/empty.bin": b"", "assets/texture.dat": (b"texture" + ramp) * 64, "assets/noise.dat": rng.randbytes(64 * KIB), "audio.dat": (b"audio" + ramp) * 128, "world.dat": bytes(world)}
