"""Token ids of whole texts with a public tokenizer file, through a cache of text pieces.

Neither vocabulary lets a token cross the break in front of a space or line end that a
non-space follows, so a text's ids are the ids of its pieces one after the other. In a batch each
distinct piece is encoded once; pieces seen before come from a bounded cache of the worker.
Texts in which such a break is not certain (two spaces in a row, a space before another kind of
space) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most pieces a worker keeps, in two halves: a full half becomes the older one, whose place the next
#: full one takes. What is asked again moves to the younger half, so frequent pieces stay.
CACHE_PIECES = 400_000
#: Most runs of letters or signs a worker keeps, in two halves as well.
CACHE_RUNS = 600_000

_WORD = re.compile(r"(\n?)([^\W\d_]+)((?:(?!['\w\s])[\x21-\x7e])*)\Z").match
_LATIN_END = "\u024f"


def _shown_bytes() -> list[str]:
    """The printable character by which byte-level vocabularies show each byte: itself where
    it is printable in Latin-1, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_SHOWN = _shown_bytes()

_ENCODERS: dict[tuple[str, bool, int | None], "PieceEncoder"] = {}


def vocabulary_path(name: str) -> str:
    """Place of a tokenizer file of the installed ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, drops_space: bool, kept: int | None = None) -> "PieceEncoder":
    """This worker's encoder of a tokenizer file; ``kept`` bounds its pieces and its runs more tightly."""
    key = (path, drops_space, kept)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, drops_space, kept)
    return _ENCODERS[key]


class PieceEncoder:
    """Encodes Arrow columns of texts.

    drops_space: the vocabulary ignores white space between words (``word_bpe_49k``); otherwise a
    space belongs to the word after it (``byte_bpe_50k``).
    """

    def __init__(self, path: str, drops_space: bool, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = drops_space
        self.half_pieces = (kept or CACHE_PIECES) // 2
        self.half_runs = (kept or CACHE_RUNS) // 2
        self.forget()

    def forget(self) -> None:
        """Empty the caches."""
        self.cache: dict[str, bytes] = {}
        self.old_cache: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) one after the other, and ``n + 1`` offsets; null is empty."""
        texts = pc.fill_null(column, "")
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        broken = pc.replace_substring(texts, "\n", " " if self.drops_space else " \n")
        pieces = pc.split_pattern(broken.cast(pa.large_string()), " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pieces.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        names = words.dictionary.to_pylist()
        first = np.cumsum(counts) - counts
        whole = np.zeros(len(texts), bool)
        heads: dict[int, bytes] = {}
        if not self.drops_space:
            odd = np.zeros(len(names), bool)
            odd[[i for i, w in enumerate(names)
                 if (w < "!" or w > "\x7f") and not self._breaks(w)]] = True
            bad = odd[at]
            bad[first] = False
            whole = np.add.reduceat(bad, first) > 0
            # A text that starts with white space has no certain first break either.
            starts = [names[i] for i in at[first].tolist()]
            whole |= np.array([s[:1].isspace() for s in starts]) | (
                np.array([s == "" for s in starts]) & (counts > 1))
            alone = [i for i in range(len(starts)) if not whole[i]]
            for i, e in zip(alone, self._batch([starts[i] for i in alone])):
                heads[i] = e
            used = np.zeros(len(names), bool)
            keep = np.ones(len(at), bool)
            keep[first] = False
            used[at[keep & ~np.repeat(whole, counts)]] = True
            coded = self._pieces([w if u else None for w, u in zip(names, used)])
        else:
            coded = self._pieces(names)
        extra = [heads.get(i) for i in range(len(texts))] if not self.drops_space else []
        if not self.drops_space:
            full = [i for i in range(len(texts)) if whole[i]]
            for i, e in zip(full, self._batch([texts[i].as_py() for i in full])):
                extra[i] = e
            # First pieces take the places behind the dictionary; pieces of a text that was
            # encoded whole count nothing.
            at = at.astype(np.int64)
            at[first] = len(coded) + np.arange(len(texts))
            coded += extra
            coded.append(b"")
            drop = np.repeat(whole, counts)
            drop[first] = False
            at[drop] = len(coded) - 1
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        pool = np.frombuffer(b"".join(coded), np.uint16)
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[at]
        stop = np.cumsum(lengths)
        index = np.arange(int(stop[-1])) + np.repeat(begin[at] - (stop - lengths), lengths)
        ends = stop[first + counts - 1]
        return pool[index].astype(np.int32), np.concatenate(([0], ends))

    @staticmethod
    def _breaks(piece: str) -> bool:
        """Whether the break in front of a piece is certain."""
        if piece[:1] == "\n":
            return not piece[1:2].isspace() and len(piece) > 1
        return not piece[:1].isspace() and piece != ""

    def _batch(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint16).tobytes() for e in done]

    def _pieces(self, names: list[str | None]) -> list[bytes]:
        cache = self.cache
        found = [cache.get(w) if w is not None else b"" for w in names]
        new = [i for i, ids in enumerate(found) if ids is None]
        single = []
        for i in new:
            ids = self.old_cache.get(names[i])
            if ids is None:
                ids = self._word(names[i])
            if ids is None:
                single.append(i)
            else:
                found[i] = ids
        if single:
            # A piece that follows a space is encoded with it; one that follows a line end has it.
            texts = [names[i] if self.drops_space or names[i][:1] == "\n" else " " + names[i]
                     for i in single]
            for i, ids in zip(single, self._batch(texts)):
                found[i] = ids
        for i in new:
            if len(names[i]) <= 48:
                if len(cache) >= self.half_pieces:
                    self.old_cache = cache
                    self.cache = cache = {}
                cache[names[i]] = found[i]
        return found

    def _word(self, piece: str) -> bytes | None:
        """Ids of a Latin word with or without signs behind it; other pieces take the long way.

        Such a piece is one run of letters and one of signs for either vocabulary, so the model
        can be asked for each without splitting and normalising first.
        """
        match = _WORD(piece)
        if match is None:
            return None
        line, word, signs = match.groups()
        if not word.isascii() and (
            not word.isalpha() or max(word) > _LATIN_END or "\u0130" in word
        ):
            return None
        if self.drops_space:
            return self._run(word.lower()) + (self._run(signs) if signs else b"")
        head = self._run("\n") + self._run(word) if line else self._run(" " + word)
        return head + (self._run(signs) if signs else b"")

    def _run(self, text: str) -> bytes:
        ids = self.runs.get(text)
        if ids is not None:
            return ids
        ids = self.old_runs.get(text)
        if ids is None:
            shown = text if text.isascii() and text.isalpha() else "".join(
                map(_SHOWN.__getitem__, text.encode()))
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], np.uint16).tobytes()
        if len(text) <= 48:
            if len(self.runs) >= self.half_runs:
                self.old_runs, self.runs = self.runs, {}
            self.runs[text] = ids
        return ids
