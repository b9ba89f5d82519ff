"""Token ids of a lower-casing word BPE vocabulary, as the tokenizers library gives them.

The ids of a run without white space do not depend on its neighbours, so each worker keeps a bounded memo of
such runs and of the pre-tokens in them, and asks the library only for pre-tokens that are not in it. This
holds for runs of characters whose classes are certain: ASCII, the Latin-1 letters and marks, common
typographic marks. A text with any other character or with a special token's string goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import Memo

#: Fixed by the contract: the id that ends each document.
END_ID = 1
MEMO_ENTRIES = 1_000_000
SLICE_CHARS = 2_000_000

_LETTERS = "a-zß-öø-ÿ"
_PRETOKEN = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTERS}0-9]+")
_UNCERTAIN = re.compile(r"[^!-~¡-©«¬®-±´¶-¸»¿-ÿ‐-‧€]")
#: Characters at which Python's split() parts and the library does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordEncoder:
    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = Memo(memo_entries)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Asks for many pre-tokens in one text; an id that closes a word closes a pre-token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words):
            raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
            self.memo.update(zip(words, (raw[a:b] for a, b in zip(at, at[1:]))))
        else:  # some pre-token has no closing id of its own
            self.memo.update(zip(words, self._whole(words)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        at, size = [], 0
        for i, text in enumerate(texts):
            at.append(i)
            size += len(text)
            if size >= SLICE_CHARS or i == len(texts) - 1:
                self._slice(texts, at, out)
                at, size = [], 0
        return out

    def _slice(self, texts: list[str], at: list[int], out: list[bytes]) -> None:
        memo, lib, found = self.memo, [], {}
        memo.new.clear()
        if len(memo) > memo.most:
            memo.clear()
        for i in at:
            text = texts[i]
            if "<|" in text or _SEPARATORS.search(text):
                lib.append(i)
            else:
                found[i] = list(map(memo.__getitem__, text.lower().split()))
        runs = {w: None if _UNCERTAIN.search(w) else _PRETOKEN.findall(w) for w in memo.new}
        missing = {x for words in runs.values() if words for x in words if x not in memo}
        if missing:
            self._learn(list(missing))
        for run, words in runs.items():
            if words is not None and run not in memo:
                memo[run] = b"".join(map(memo.__getitem__, words))
        odd = {run for run, words in runs.items() if words is None}
        for i, ids in found.items():
            if odd and not odd.isdisjoint(x for x in ids if x.__class__ is str):
                lib.append(i)
            elif runs:
                out[i] = b"".join([x if x.__class__ is bytes else memo[x] for x in ids])
            else:
                out[i] = b"".join(ids)
        if lib:
            for i, ids in zip(lib, self._whole([texts[i] for i in lib])):
                out[i] = ids


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary; its memo lives across tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
