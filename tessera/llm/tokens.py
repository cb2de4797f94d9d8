"""Token ids of whole texts by a public vocabulary file.

The vocabulary drops white space and never joins across it, so the ids of a text are those of its words in turn; and
punctuation behind letters is a piece of its own. Words repeat: each is encoded once, and its ids are gathered, in
numpy, from a table of bounded size that forgets words seen once first.
"""

from __future__ import annotations

import os
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.kernel import give_back

VOCABULARY = "word_bpe_49k.json"
_SPLITS = "\u0130"  # the letter whose lower case is a letter and a mark
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


class Encoder:
    #: So many words are kept at most.
    KEEP = 800_000

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        # Words of lower-case letters need neither normalising nor cutting.
        self.plain = Tokenizer.from_str(self.tokenizer.to_str())
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.at: dict[str, int] = {}
        self.first, self.ids, self.uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # What reading the vocabulary took beside it.
        del vocab
        give_back()

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.first) - 1
        self.at.update(zip(words, range(n, n + len(words))))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def _encode(self, words: list[str]) -> None:
        """Adds words as they are. Words of letters alone are one piece each, so they can share a call."""
        alone = [w for w in words if w.isalpha() and w == w.lower() and is_normalized("NFC", w)]
        joined = [" ".join(alone[i : i + 256]) for i in range(0, len(alone), 256)]
        got = [x.ids for x in self.plain.encode_batch_fast(joined, add_special_tokens=False)]
        got = np.fromiter(chain.from_iterable(got), np.uint32)
        ends = np.flatnonzero(self.ends[got]) + 1
        if len(ends) == len(alone):
            self._add(alone, got, np.diff(ends, prepend=0))
            words = [w for w in words if w not in self.at]
        if words:
            got = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self._add(words, np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens)

    def _gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first[k + 1] - self.first[k]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.first[k] - ends[:-1], n)], n

    def _learn(self, words: list[str]) -> None:
        parts = []
        for w in words:
            core = w.rstrip(_MARKS)
            if core.isascii() and core.isalpha():
                core = core.lower()
                parts += (core, w[len(core) :])
            elif core.isalpha() and _SPLITS not in core:
                parts += (core, w[len(core) :])
            else:
                parts += (w, "")
        if new := list(dict.fromkeys(p for p in parts if p not in self.at)):
            self._encode(new)
        ids, n = self._gather(np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts)))
        whole = [i for i, w in enumerate(words) if w not in self.at]
        if len(whole) < len(words):
            keep = np.zeros(len(words), bool)
            keep[whole] = True
            ids, n = ids[np.repeat(np.repeat(keep, 2), n)], n[np.repeat(keep, 2)]
        self._add([words[i] for i in whole], ids, n[::2] + n[1::2])

    def _forget(self) -> None:
        often = self.uses > np.median(self.uses)
        k = np.flatnonzero(often)
        ids, n = self._gather(k)
        names = [w for w, i in self.at.items() if often[i]]
        order = np.argsort(np.fromiter((self.at[w] for w in names), np.int64, len(names)))
        names = [names[i] for i in order.tolist()]
        self.at, self.first, self.ids, self.uses = {}, np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._add(names, ids, n)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text starts, the end last."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(texts.fill_null("") if texts.null_count else texts)
        words = split.flatten().dictionary_encode()
        if len(self.at) > self.KEEP:
            self._forget()
        own = words.dictionary.to_pylist()
        k = np.fromiter(map(self.at.get, own, repeat(-1)), np.int64, len(own))
        if len(missed := np.flatnonzero(k < 0)):
            missing = [own[i] for i in missed.tolist()]
            self._learn(missing)
            k[missed] = np.fromiter(map(self.at.__getitem__, missing), np.int64, len(missing))
        at = words.indices.to_numpy()
        self.uses += np.bincount(k, np.bincount(at, minlength=len(own)), len(self.uses)).astype(np.int64)
        ids, n = self._gather(k[at])
        ends = np.concatenate([[0], np.cumsum(n)])
        off = split.offsets.to_numpy()
        return ids, ends[off - off[0]]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
