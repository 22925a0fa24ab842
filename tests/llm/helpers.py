"""Fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import random
import zlib

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _h string, _leaf int, key string, node string"


def components(n: int, pairs) -> list[int]:
    p = list(range(n))

    def root(x: int) -> int:
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def fingerprint(text: str | None, width: int = 4) -> int:
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows of DOCS: random texts, exact and near copies, shared passages, nulls, blanks, a long text, repeated rows, clashing columns."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts: list[str | None] = [words(rng, rng.randrange(1, 150)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[3] + " tail", texts[4].upper(), None, "", "  \n ", words(rng, 8000)]
    texts += [words(rng, 5) + " " + passage + " " + words(rng, 7), passage.replace(" ", "\n"), passage + " " + passage]
    long = texts[5] + " " + words(rng, 120)
    for k in range(12):
        w = long.split()
        w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    rows = [(k, t, ("en", "de", None)[k % 3], f"src{k % 5}" if k % 7 else None, len(t or ""), "h", 3, "k", "n") for k, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((None, words(rng, 70), None, None, None, None, None, None, None))
    return rows


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def unit(rng: np.random.Generator, n: int, dim: int) -> np.ndarray:
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)
