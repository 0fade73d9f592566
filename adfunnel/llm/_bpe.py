"""Word-wise use of a tokenizers file, for the encoding and the token-file operators.

White space separates what the tokenizer's pre-tokenizer sees, so the ids of a
text are the ids of its words, one after the other. Every distinct word of a
slice is looked up once; words not seen before are encoded together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from adfunnel.llm import _words

_MADE: dict[tuple[str, int], WordCoder] = {}


class WordCoder:
    """Encoder of one tokenizer file with a bounded memory of words.

    ``most_words`` bounds the memory only: when it is full it is emptied, and
    results don't depend on it. Lower-casing ASCII letters first is exact where
    the file's normaliser lower-cases, but for texts that ``cased`` matches;
    otherwise it is left out.
    """

    def __init__(self, path: str, most_words: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.most = most_words
        self.known: dict[str, bytes] = {"": b""}
        self.lower = "Lowercase" in str(self.tok.normalizer)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.wide = size > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        # a capital and a combining mark can compose otherwise than their lower case, and added tokens are matched in the raw text
        self.cased = "|".join(["[^\\x{0}-\\x{2FF}]", *(f"(?i:{re.escape(t)})" for t in sorted(self.special))])
        self.mark = next((i for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not t.lstrip and not t.rstrip), None)
        self.mark_text = self.tok.id_to_token(self.mark) if self.mark is not None else None
        # characters that an added token has may belong to it
        self.tail = "".join(c for c in ".,!?;:#$%&*" if not any(c in t for t in self.special))
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = np.fromiter((t.endswith(suffix.encode()) for t in self.tokens), bool, size) if suffix else None

    @classmethod
    def of(cls, path: str, most_words: int = 500_000) -> WordCoder:
        """One coder per worker process, kept between tasks."""
        if (path, most_words) not in _MADE:
            _MADE[path, most_words] = cls(path, most_words)
        return _MADE[path, most_words]

    def _learn(self, words: list[str]) -> None:
        """Ids of words that are not known yet; none of them has a tail."""
        rest = []
        if self.ends is None:
            rest = words
        else:
            alone = []
            for w in words:
                (alone if w.isalpha() else rest).append(w)
            # a word of letters alone has one end of a word, so ids are told apart without anything between the words
            for some, ids in self._batches(alone, " ", 1024):
                cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(cut) == len(some) and cut[-1] == len(ids):
                    self._keep(some, ids, [0, *cut[:-1]], cut)
                else:  # an added token, or letters that the tokenizer cuts
                    rest += some
        special = re.compile("|".join(map(re.escape, self.special))).search if self.special else None
        plain = [w for w in rest if not special(w)] if special else rest
        odd = set(rest).difference(plain)
        for w in odd if self.mark is not None else rest:
            self.known[w] = np.asarray(self.tok.encode(w, add_special_tokens=False).ids, self.dtype).tobytes()
        for some, ids in self._batches(plain, self.mark_text, 64) if self.mark is not None else ():
            at = np.flatnonzero(ids == self.mark)
            self._keep(some, ids, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)])

    def _batches(self, words: list[str], between: str, size: int) -> Iterator[tuple[list[str], np.ndarray]]:
        """Groups of ``size`` words with the ids of their text."""
        for i in range(0, len(words), 4096):
            groups = [words[j : min(j + size, i + 4096)] for j in range(i, min(i + 4096, len(words)), size)]
            # without the places of the ids in the text, which nobody asks for here
            coded = self.tok.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, coded, strict=True):
                yield group, np.asarray(e.ids, np.int64)

    def _keep(self, words: list[str], ids: np.ndarray, begin: list[int], end: list[int]) -> None:
        size = self.dtype.itemsize
        raw = ids.astype(self.dtype).tobytes()
        self.known.update((w, raw[a * size : b * size]) for w, a, b in zip(words, begin, end, strict=True))

    def _cut(self, words: pa.Array) -> list[pa.Array]:
        """Words without their tails, and the tails (empty for most): a letter before one always ends a pre-token there."""
        heads = pc.utf8_rtrim(words, characters=self.tail) if self.tail else words
        heads = pc.if_else(pc.ascii_is_alpha(pc.utf8_slice_codeunits(heads, -1)), heads, words)
        short = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
        at = np.cumsum(short)
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int64)[words.offset + 1 : words.offset + len(words) + 1]
        raw = np.frombuffer(data, np.uint8)[np.repeat(ends - at, short) + np.arange(at[-1])]
        tails = pa.Array.from_buffers(words.type, len(words), [None, pa.py_buffer(np.concatenate(([0], at))), pa.py_buffer(raw)])
        return [heads, tails]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and per text the place of its first id (one more entry than texts)."""
        if self.lower:
            # such texts are left to the tokenizer
            cased = pc.match_substring_regex(texts, self.cased)
            texts = pc.if_else(cased, texts, pc.ascii_lower(texts))
        words, starts = _words.split(texts)
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        coded = words.dictionary_encode()
        units = pa.concat_arrays(self._cut(coded.dictionary.cast(pa.large_string()))).dictionary_encode()
        each = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in each if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {"": b""}
            new = [w for w in each if w]
        if new:
            self._learn(new)
        ids = pa.array([self.known[w] for w in each], pa.large_binary()).take(units.indices)
        n = len(coded.dictionary)
        taken = pc.binary_join_element_wise(ids[:n], ids[n:], pa.scalar(b"", pa.large_binary())).take(coded.indices)
        _, at, raw = taken.buffers()
        at = np.frombuffer(at, np.int64)[taken.offset : taken.offset + len(taken) + 1]
        flat = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view(self.dtype) if raw else np.zeros(0, self.dtype)
        return flat, (at - at[0])[starts] // self.dtype.itemsize
