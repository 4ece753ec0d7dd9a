"""Exact, memoised use of a byte-level BPE tokenizer of the tokenizers library.

Two facts make memoising exact, and ``tests/llm`` holds both against the library on whole texts:

* A token never runs over a space that a non-space follows, as such a space always opens a new pre-token.
  A text without two spaces in a row may be cut before each of its spaces.
* Merges never leave a pre-token. The library's own model merges each distinct pre-token once per worker.

Texts with runs of spaces, special strings or signs outside a plain Latin range go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import MEMOS

VOCABULARY = "byte_bpe_50k.json"
#: Entries and characters that a worker's memo holds before it starts anew (they bound memory, never the input).
MEMO_ENTRIES, MEMO_CHARS = 200_000, 8_000_000
JOINED = 1024
#: Pieces with signs outside common Latin text are encoded by the library whole.
UNPLAIN = re.compile("[^ \n!-~¡-¬®-ɏ‐-‧]")
#: Letters and one full stop or comma.
ENDED = r"^(\p{L}+)([.,])$"
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Code point of a Latin-1 decoded byte -> the printable letter that stands for it in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


def whole_only(text: str) -> bool:
    """Whether a text must go to the library as it is: it has two spaces in a row, or what may be a special string."""
    return "  " in text or "<|" in text


def spaced(piece: str) -> str:
    """The text of a piece: its space and it, or at the start of a text (marked with a space) it alone."""
    return piece[1:] if piece[:1] == " " else " " + piece


def pre_tokens_of(piece: str) -> list[str] | tuple[str, ...] | None:
    """Pre-tokens of a piece: what follows a space, or with a space as its mark the first one of a text. None: outside plain Latin text."""
    if not piece.isascii() and UNPLAIN.search(piece):
        return None
    if piece.isalpha():
        return (" " + piece,)  # letters alone, the common case
    if piece[-1:] in (".", ",") and piece[:-1].isalpha():
        return (" " + piece[:-1], piece[-1])
    if piece.isascii() and UNPLAIN.search(piece):
        return None
    return pre_token_pattern().findall(spaced(piece))


def lettered(text: str) -> str:
    """Tabs stay."""
    if text.isascii():
        return text.replace(" ", chr(288)).replace("\n", chr(266))
    return text.encode().decode("latin-1").translate(byte_letters() | {9: "\t"})


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and bytes of text (or one row)."""
    ends = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        upto = max(at + 1, min(upto, at + SLICE_ROWS))
        yield batch.slice(at, upto - at)
        at = upto


@lru_cache(maxsize=1)
def pre_token_pattern():
    """The pre-tokens of byte-level BPE: contractions, letters, digits, other signs (each with one leading space), white space."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Memo(dict):
    """Distinct strings by number, with their ids in one flat array; ``index`` numbers new strings and puts them into ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used, self.count, self.chars = np.zeros(1 << 14, np.uint32), 0, 0, 0

    def full(self) -> bool:
        return self.count > MEMO_ENTRIES or self.chars > MEMO_CHARS

    def index(self, keys: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            asked = [keys[k] for k in new.tolist()]
            distinct = list(dict.fromkeys(asked))
            self.update(zip(distinct, range(len(self), len(self) + len(distinct))))
            self.pending += distinct
            found[new] = np.fromiter(map(self.__getitem__, asked), np.int64, len(asked))
        return found

    def fill(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of what is pending, in order."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        here = slice(self.count, self.count + len(lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[here] = self.used + np.cumsum(lengths) - lengths
        self.lengths[here] = lengths
        self.chars += sum(map(len, self.pending))
        self.count, self.used, self.pending = here.stop, self.used + len(ids), []

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries one after another, ids of each)."""
        return gathered(self.flat, self.starts, self.lengths, index)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of ``flat`` by number, one after another, their lengths)."""
    lengths = lengths[index]
    ends = np.cumsum(lengths)
    at = np.repeat(starts[index] - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at], lengths


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``; counts: the lengths of the runs."""
    ends = np.concatenate([[0], np.cumsum(values)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def _mask(column: pa.BooleanArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _strings(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes batches of texts to one flat array of ids and the number of ids of each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load_tokenizer(path)
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pre_tokens = Memo()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library as it is."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _merge(self) -> None:
        """Ids of pending pre-tokens by the library's merges alone; letters stand for bytes, so tabs can part them."""
        ids, lengths, pending = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], self.pre_tokens.pending
        for k in range(0, len(pending), JOINED):
            some = pending[k : k + JOINED]
            e = self.merger.encode(lettered("\t".join(some)), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        self.pre_tokens.fill(np.concatenate(ids), np.concatenate(lengths))

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, ids of each). Letters alone, or with a full stop or comma, are parted as columns;
        the pattern parts the others."""
        odd = _mask(pc.match_substring_regex(pieces, UNPLAIN.pattern))
        letters, ended = _mask(pc.utf8_is_alpha(pieces)) & ~odd, _mask(pc.match_substring_regex(pieces, ENDED)) & ~odd
        rest = np.flatnonzero(~(letters | ended | odd))
        parted = [pre_token_pattern().findall(spaced(t)) for t in _strings(pieces.take(pa.array(rest)))]
        counts = letters + 2 * ended
        counts[rest] = np.fromiter(map(len, parted), np.int64, len(parted))
        with_end = pieces.filter(pa.array(ended))
        stems = pa.concat_arrays([pieces.filter(pa.array(letters)), pc.utf8_slice_codeunits(with_end, 0, -1)])
        found = [pc.binary_join_element_wise(pa.scalar(" ", stems.type), stems, pa.scalar("", stems.type)), pc.utf8_slice_codeunits(with_end, -1, None), pa.array(chain.from_iterable(parted), pieces.type)]
        coded = pa.concat_arrays(found).dictionary_encode()
        number = self.pre_tokens.index(_strings(coded.dictionary))[coded.indices.to_numpy()]
        if self.pre_tokens.pending:
            self._merge()
        starts = np.cumsum(counts) - counts
        more = counts[rest]
        within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        order = np.empty(len(number), np.int64)
        order[np.concatenate([starts[letters], starts[ended], starts[ended] + 1, np.repeat(starts[rest], more) + within])] = number
        ids, lengths = self.pre_tokens.gather(order)
        per = sums(lengths, counts)
        if odd.any():
            given, many = self.whole(list(map(spaced, _strings(pieces.filter(pa.array(odd))))))
            ids = np.insert(ids, np.repeat((np.cumsum(per) - per)[odd], many), given)
            per[odd] = many
        return ids, per

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text); a null text has none."""
        if self.pre_tokens.full():
            self.pre_tokens = Memo()
        texts = _strings(texts) if isinstance(texts, pa.Array) else texts
        per = np.zeros(len(texts), np.int64)
        plain = [k for k, t in enumerate(texts) if t and not whole_only(t)]
        ids = np.zeros(0, np.uint32)
        if plain:
            pieces, index, counts = split_pieces([texts[k] for k in plain])
            flat, lengths = self._pieces(pieces)
            ids, lengths = gathered(flat, np.cumsum(lengths) - lengths, lengths, index)
            per[plain] = sums(lengths, counts)
        known = set(plain)
        if apart := [k for k, t in enumerate(texts) if t and k not in known]:
            given, many = self.whole([texts[k] for k in apart])
            ids = np.insert(ids, np.repeat((np.cumsum(per) - per)[apart], many), given)
            per[apart] = many
        return ids, per


def split_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct pieces of texts, the number of each piece in order, pieces of each text)."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    firsts = pa.array([" " + t.partition(" ")[0] for t in texts], pa.large_string()).dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    index[offsets[:-1]] = len(coded.dictionary) + firsts.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, firsts.dictionary]), index, np.diff(offsets)


def split_index(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(places in the memo of all pieces of texts, pieces of each text); each distinct piece of the batch is looked up once."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pieces, index, counts = split_pieces(texts)
    return memo.index(_strings(pieces))[index], counts


_ENCODERS: dict[str, Encoder] = {}
MEMOS["ids"] = _ENCODERS.clear


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
