"""Texts cut into pieces that a tokenizer encodes one by one, each distinct piece once.

A piece begins at a blank that stands between a byte other than a blank and a byte that no white
space begins with. Byte-level BPE splits texts there in any case (a blank belongs to the word after
it), and a piece vocabulary whose entries hold no blank but at their front never merges across it.
So the ids of a text are those of its pieces, and most pieces of a text have been seen before. Byte-level
splitting also parts at a line end before a word and at a sign of `_SIGNS` after a letter or figure; `fine`
cuts are made there too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from comparo.llm import words as W

#: Bytes after which a blank may begin a piece: ASCII signs, and lead bytes of no white space beyond ASCII.
_AHEAD = W._table([*range(0x21, 0x80), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])
_SIGNS = ".,;:!?"
_SIGN = W._table(_SIGNS.encode())
_ALNUM = W._table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
KNOWN = 1 << 20     # distinct pieces that a task remembers at most; then it begins anew
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 2048
JOINED = 1 << 18    # bytes of new pieces that are encoded as one text


def cuts(data: np.ndarray, bounds: np.ndarray, fine: bool = False) -> np.ndarray:
    """Where pieces begin: at every document with bytes, and at the places named above."""
    if len(data) < 3:
        return np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
    blank = data == 0x20
    at = np.zeros(len(data), bool)
    at[1:-1] = blank[1:-1] & ~blank[:-2] & _AHEAD[data[2:]]
    if fine:
        at[1:-1] |= (data[1:-1] == 0x0A) & _AHEAD[data[2:]]
        at[1:] |= _SIGN[data[1:]] & _ALNUM[data[:-1]]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    last = bounds[1:-1][bounds[1:-1] > 0] - 1
    at[last[~_SIGN[data[last]]]] = False      # a document's last byte has no byte ahead
    at[edges] = True
    return np.flatnonzero(at)


def ragged(values: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `rows` of a list of lists, one after the other, and where each begins."""
    n = edges[rows + 1] - edges[rows]
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    return values[np.repeat(edges[rows] - out[:-1], n) + np.arange(out[-1])], out


class Pieces:
    """Distinct pieces of a task and their number in order of appearance.

    `learn` gets the new ones and keeps what it makes of them; `forget` is called when the next chunk
    may take their number beyond `limit`.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], limit: int = KNOWN):
        self.known: dict[bytes, int] = {}
        self.learn, self.forget, self.limit = learn, forget, limit

    def of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each piece of `data`, which begin at `starts`."""
        edges = np.append(starts, len(data)).astype(np.int64)
        distinct = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        own = distinct.dictionary.to_pylist()
        if len(self.known) + len(own) > self.limit and self.known:
            self.known.clear()
            self.forget()
        numbers = list(map(self.known.get, own))
        new = [p for p, k in zip(own, numbers) if k is None]
        if new:
            fresh = iter(range(len(self.known), len(self.known) + len(new)))
            numbers = [next(fresh) if k is None else k for k in numbers]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.learn(new)
        return np.array(numbers, np.int64)[distinct.indices.to_numpy()]


def encoded(pieces: list[bytes], encode: Callable[[list[str]], list[list[int]]],
            bytes_of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, where each piece's begin and the end).

    With `bytes_of`, the bytes that each id of a byte-level vocabulary stands for, pieces that begin as a word does are
    encoded side by side as one text: they part where they meet.
    """
    joined = np.array([bytes_of is not None and len(p) > 1 and p[0] in b" \n" and bool(_AHEAD[p[1]]) for p in pieces], bool)
    ids, n = [], np.zeros(len(pieces), np.int64)
    at = np.flatnonzero(joined)
    ends = np.cumsum([len(pieces[k]) for k in at], dtype=np.int64)
    done = 0
    while done < len(at):
        start = int(ends[done - 1]) if done else 0
        last = max(done + 1, int(np.searchsorted(ends, start + JOINED)))
        own = np.array(encode([b"".join([pieces[k] for k in at[done:last]]).decode()])[0], np.uint32)
        spelled = np.cumsum(bytes_of[own]) + start
        n[at[done:last]] = np.diff(np.searchsorted(spelled, ends[done:last]) + 1, prepend=0)
        ids.append(own)
        done = last
    alone = np.flatnonzero(~joined)
    lists = encode([pieces[k].decode() for k in alone]) if len(alone) else []
    n[alone] = [len(x) for x in lists]
    ids += [np.array(x, np.uint32) for x in lists]
    order = np.concatenate([at, alone])
    begin = np.zeros(len(pieces), np.int64)     # of each piece among the ids as they were made
    begin[order] = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[order])])[:-1]
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    return flat[np.repeat(begin - first[:-1], n) + np.arange(first[-1])], first


class Ids:
    """Ids of texts by their pieces (or, where the tokenizer does not part texts there, of whole texts)."""

    def __init__(self, vocabulary: str, special_as_text: bool = False, limit: int = KNOWN):
        self.encode = encoder(vocabulary, special_as_text)
        self.at_blanks = splits_at_blanks(vocabulary)
        self.bytes_of = byte_lengths(vocabulary) if self.at_blanks else None
        self.pieces = Pieces(self._learn, self._forget, limit)
        self._forget()

    def _forget(self) -> None:
        self.values, self.edges = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        values, first = encoded(new, self.encode, self.bytes_of)
        self.values = np.concatenate([self.values, values])
        self.edges = np.concatenate([self.edges, first[1:] + self.edges[-1]])

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each document's begin and the end)."""
        starts = cuts(data, bounds, fine=True) if self.at_blanks else bounds[:-1][bounds[:-1] < bounds[1:]]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        numbers = self.pieces.of(data, starts)
        values, edges = ragged(self.values, self.edges, numbers)
        return values, edges[np.searchsorted(starts, bounds)]


@lru_cache(maxsize=2)
def ids_of(vocabulary: str) -> Ids:
    """One for all tasks of a worker, so a task starts with the pieces of those before it."""
    return Ids(vocabulary)


def place(vocabulary: str) -> str:
    """The path of a vocabulary file; a bare name is one of the public tokenizers installed beside Python."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@lru_cache(maxsize=4)
def byte_bpe(vocabulary: str, special_as_text: bool = False):
    """A tokenizer of the tokenizers library, once a worker."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(place(vocabulary))
    made.encode_special_tokens = special_as_text
    return made


@lru_cache(maxsize=4)
def splits_at_blanks(vocabulary: str) -> bool:
    """Whether a tokenizer's splitting puts every blank before a word into that word's part, whatever stands around."""
    rules = json.loads(byte_bpe(vocabulary).to_str())
    split = rules["pre_tokenizer"] or {}
    return (split.get("type") == "ByteLevel" and split.get("use_regex") is True
            and not split.get("add_prefix_space") and rules["normalizer"] is None
            and not any(set(t["content"]) & set(" \n" + _SIGNS) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"]))


@lru_cache(maxsize=4)
def byte_lengths(vocabulary: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for: its entry has a sign for each."""
    made = byte_bpe(vocabulary)
    special = {t["id"]: len(t["content"].encode()) for t in json.loads(made.to_str())["added_tokens"]}
    out = np.zeros(made.get_vocab_size(), np.int64)
    for token, k in made.get_vocab().items():
        out[k] = special.get(k, len(token))
    return out


def encoder(vocabulary: str, special_as_text: bool = False) -> Callable[[list[str]], list[list[int]]]:
    made = byte_bpe(vocabulary, special_as_text)
    return lambda texts: [x.ids for x in made.encode_batch_fast(texts, add_special_tokens=False)]


def chunks_of(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of a text column, some rows and about a chunk of bytes at a time."""
    for at in range(0, len(column), CHUNK_ROWS):
        data, bounds = W.text_column(column.slice(at, CHUNK_ROWS))
        for i, j in W.chunks(bounds, CHUNK_BYTES):
            yield at + i, at + j, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
