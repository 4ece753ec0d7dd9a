"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Masks that keep the first 0 to 8 bytes of eight.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), vectorised."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` word hashes."""
    run = np.full(len(words) - width + 1, U(width))
    for k in range(width):
        run = mix(run * U(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
    return run


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text with A-Z lowered, end to end, and where each text
    begins (one bound more than texts). Null texts have no words. Words are read eight bytes at a time."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, bounds = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    if not len(words):
        return np.zeros(0, U), bounds
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    low, high = int(starts[0]), int(starts[-1])
    data = words.buffers()[2]
    raw = np.concatenate([np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    sizes, at = np.diff(starts), starts[:-1] - low
    found = mix(sizes.astype(U) + U(1))
    for k in range(-(-min(int(sizes.max()), LONG_WORD) // 8)):
        some = np.flatnonzero(sizes > 8 * k) if k else slice(None)
        left = np.minimum(sizes[some] - 8 * k, 8)
        found[some] = mix(found[some] + (eights[at[some] + 8 * k] & KEEP[left]))
    for k in np.flatnonzero(sizes > LONG_WORD):
        found[k] = U(xxhash.xxh3_64_intdigest(raw[at[k] : at[k] + sizes[k]].tobytes()))
    real = sizes > 0  # a space at an end of a text leaves an empty word there
    return found[real], np.concatenate([[0], np.cumsum(real)])[bounds]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and where each set begins (one bound more than
    texts). A text with fewer than ``width`` words has one shingle, all its words; one without words has none."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.empty(int(ends[-1]) if len(ends) else 0, U)
    if len(words) >= width:
        whole = np.ones(len(words), bool)
        for back in range(1, width):  # no shingle begins so near to a text's end
            at = bounds[1:] - back
            whole[at[at >= bounds[:-1]]] = False
        short = np.repeat(counts < width, counts)
        target = np.repeat(counts >= width, sizes)
        out[target] = rolled(words, width)[(whole & ~short)[: len(words) - width + 1]]
    for k in np.flatnonzero((counts < width) & (counts > 0)):
        out[begins[k]] = rolled(words[bounds[k] : bounds[k + 1]], int(counts[k]))[0]
    for a, b in zip(begins.tolist(), ends.tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begins[sizes > 0]] = True
    ahead = np.concatenate([[0], np.cumsum(new)])
    return out[new], np.concatenate([ahead[begins], ahead[-1:]])
