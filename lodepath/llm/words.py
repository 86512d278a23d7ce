"""Hashed words of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def split_words(texts: pa.Array, marks: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of each text, one after another, and where each text's begin (one more entry than texts).

    Without marks a word is a run of letters and digits; with marks, runs of other characters are words too.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    if marks:
        texts = pc.replace_substring_regex(texts, r"([^\p{L}\p{N}\s]+)", r" \1 ")
    else:
        texts = pc.replace_substring_regex(texts, r"[^\p{L}\p{N}]+", " ")
    lists = pc.ascii_split_whitespace(texts)
    flat, at = lists.flatten(), np.asarray(lists.offsets)
    at = at - at[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[at]


def hashed_words(texts: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As split_words, with 64-bit hashes in place of words; each different word of the batch is hashed once."""
    flat, at = split_words(texts, marks)
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return hashes[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64), at


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a margin + b))), fitted by Newton's method to targets that are smoothed by class size."""
    pos, neg = int(label.sum()), int((1 - label).sum())
    aim = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - aim) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def coded_words(texts: list[bytes], table: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as they are, exactly: the different words, the number of each word of each text among them, where each
    text's words begin (one more entry than texts), the texts' mapped bytes (a line feed between texts), and each word's place there.

    `table` maps bytes; of what it makes, spaces and line feeds part words.
    """
    line = np.frombuffer(b"\n".join(texts).translate(table), np.uint8)
    gap = np.concatenate([[True], (line == 32) | (line == 10), [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, size = edge[::2], edge[1::2] - edge[::2]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(line[~gap[1:-1]])])
    coded = words.dictionary_encode()
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, begins), line, starts


#: For coded_words: the white space of the contracts becomes spaces (line feeds stay), all else stays.
AS_IS = bytes(32 if c in b"\x09\x0b\x0c\x0d" else c for c in range(256))
