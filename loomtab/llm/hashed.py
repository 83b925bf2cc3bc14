"""Hashed word and character n-grams of many documents at once, and linear scores over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .blocks import BASE_INV, Block, mix, per_document, powers, prefix_hash, window_hash, words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Spec:
    """``2**bits`` buckets; n-grams of words, and of the bytes of the text (white space as one kind)."""

    bits: int
    word_sizes: tuple[int, ...] = (1, 2)
    char_sizes: tuple[int, ...] = (4,)
    lower: bool = True


_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[0x09:0x0E] = 0x20


def features(block: Block, spec: Spec) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: bucket numbers (documents one after another), and how many each document has."""
    data = _SPACES[block.data]
    if spec.lower:
        data = LOWER[data]
    own = Block(block.first, data, block.offsets)
    prefix, shift, kinds = prefix_hash(data), np.uint64(64 - spec.bits), []
    starts, ends, counts = words(own)
    hashes = window_hash(prefix, starts, ends)
    for n in spec.word_sizes:
        h, c = gram(hashes, counts, n)
        kinds.append(((mix(h + np.uint64(n)) >> shift).astype(np.int32), c))
    sizes = np.diff(block.offsets)
    for n in spec.char_sizes:
        at = np.flatnonzero(np.arange(len(data)) + n <= np.repeat(block.offsets[1:], sizes))
        h = (prefix[at + n] - prefix[at]) * powers(BASE_INV, len(data) + 1)[at]
        kinds.append(((mix(h + np.uint64(64 * n)) >> shift).astype(np.int32), np.maximum(sizes - n + 1, 0)))
    return kinds


def gram(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words inside documents, from the words' hashes; and how many each document has."""
    if n == 1:
        return hashes, counts
    at = np.flatnonzero(np.arange(len(hashes)) + n <= np.repeat(np.cumsum(counts), counts))
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + hashes[at + k])
    return out, np.maximum(counts - n + 1, 0)


def scores(kinds: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, bias: float, mean: bool) -> np.ndarray:
    """Linear scores: for each kind the sum of the weights of what a document has, or their mean."""
    z = None
    for index, counts in kinds:
        part = per_document(counts, weights[index])
        part = part / np.maximum(counts, 1) if mean else part
        z = part if z is None else z + part
    return z + bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Adam:
    """Full-batch steps for one array of parameters."""

    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
