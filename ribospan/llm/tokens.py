"""Byte-level BPE ids of whole texts with the tokenizers library, inside Arrow tasks."""

from __future__ import annotations

import ctypes
import gc
import os
import re

import numpy as np

#: White space other than a space or a line feed; texts that hold any are encoded in one piece.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ENCODERS: dict[tuple, Encoder] = {}


def default_tokenizer() -> str:
    """Path of the public vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian integers of the vocabulary's width.

    The tokenizer splits a text at single line feeds and before single spaces, so the ids of
    ``"a b\\nc"`` are those of ``"a"``, ``" b"``, ``"\\n"`` and ``"c"`` in turn. Words of that
    kind repeat and are looked up; only new ones reach the tokenizer. Where white space meets
    other white space (the split then depends on the whole run), or a special token may be
    spelled out, the text is encoded in one piece.

    ``max_words`` bounds the memory of the look-up: it is emptied when full.
    """

    def __init__(self, path: str, max_words: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words of letters only the split at spaces is the whole split.
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.max_words = max_words
        # Words after a space, with it; a word that starts a line has the line feed before it.
        self.known: dict[str, bytes] = {}
        self.feed, self.stop, self.comma = self._whole(["\n", ".", ","])
        vocabulary = self.tokenizer.get_vocab()
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        self.feeds = np.zeros_like(self.opens)
        self.feeds[np.frombuffer(self.feed, self.dtype)] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _joined(self, words: list[str], mark: str, tokenizer, starts: np.ndarray) -> None:
        """Learn words that all follow ``mark``; the tokens in ``starts``, and no others, begin one."""
        parts = ["".join([mark + w for w in words[i : i + 64]]) for i in range(0, len(words), 64)]
        found = tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], self.dtype)
        cuts, raw = (np.append(np.flatnonzero(starts[ids]), len(ids)) * self.dtype.itemsize).tolist(), ids.tobytes()
        keys = words if mark == " " else [mark + w for w in words]
        self.known.update(zip(keys, [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def _learn(self, new: set[str]) -> None:
        known, letters, others, first, ended = self.known, set(), [], [], []
        for w in new:
            if w.isalpha():
                letters.add(w)
            elif w[0] == "\n":
                first.append(w[1:])
            elif w[-1] in ".," and w[:-1].isalpha():
                ended.append(w)
                if w[:-1] not in known:
                    letters.add(w[:-1])
            else:
                others.append(w)
        self._joined(list(letters), " ", self.letters, self.opens)
        self._joined(others, " ", self.tokenizer, self.opens)
        self._joined([w for w in first if w], "\n", self.tokenizer, self.feeds)
        known["\n"] = self.feed
        for w in ended:
            known[w] = known[w[:-1]] + (self.stop if w[-1] == "." else self.comma)

    @staticmethod
    def _in_one_piece(text: str) -> bool:
        return (
            "  " in text
            or "<|" in text
            or "\n " in text
            or " \n" in text
            or "\n\n" in text
            or text[:1] == " "
            or text[-1:] == " "
            or (not text.replace("\n", " ").isprintable() and _OTHER_SPACE.search(text) is not None)
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [self._in_one_piece(t) for t in texts]
        words, ends = [], []
        for text, w in zip(texts, whole, strict=True):
            if not w:  # as if a line feed came before; its token is cut off again below
                words += ("\n" + text.replace("\n", " \n")).split(" ")
            ends.append(len(words))
        ids = list(map(self.known.get, words))
        if None in ids:
            open_at, k = [], -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                open_at.append(k)
            new = {words[k] for k in open_at}
            if len(self.known) + len(new) > self.max_words:
                self.known.clear()
            self._learn(new)
            for k in open_at:
                ids[k] = self.known[words[k]]
        rest, cut = iter(self._whole([t for t, w in zip(texts, whole, strict=True) if w])), len(self.feed)
        starts = [0, *ends[:-1]]
        return [next(rest) if w else b"".join(ids[i:j])[cut:] for w, i, j in zip(whole, starts, ends, strict=True)]


def encoder(path: str, **options) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = (path, *sorted(options.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, **options)
    return _ENCODERS[key]


def batches(texts: list[str], max_chars: int = 1 << 20):
    """Slices of ``texts`` of about ``max_chars`` in total, one text at least."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > max_chars:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def release_memory() -> None:
    """Give memory that this worker no longer uses back to the system, where that can be asked for."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_encoders() -> None:
    """Let go of the encoders of this worker, whose look-ups are large; the next one is made anew.

    For stages that run in the workers of an earlier stage that encoded.
    """
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
    release_memory()
