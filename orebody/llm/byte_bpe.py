"""Byte-level BPE by one walk over a trie of distinct words (operator 3).

The last token of a word's encoding is a function of the word alone, and the encoding of w is that of w without
its last token, followed by that token. So a trie of words carries one state per node: the last token of the
prefix that the node spells. Depth first, a node's state is the one vocabulary entry t that ends its prefix and
may follow the state |t| levels up. Words with a common prefix share its nodes, and each node is settled once.
Sorted words are the trie in depth-first order: the common prefix with the word before tells how far the path
goes back up, so the path alone is held.

`t may follow s` means that encoding their joined bytes gives (s, t) again: no merge crosses the border between
them before both are complete.

Null texts count as empty and have no tokens. Very long texts are encoded whole. Equal texts give equal rows;
empty tables give none. Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table
from .tokens import vocabulary

MEMO_ENTRIES = 1_000_000
PAIR_ENTRIES = 1_000_000
SLICE_CHARS = 2_000_000

# Unicode's White_Space, which \s of Python's re exceeds.
_WS = r"\t-\r \x85\xa0  -     　"
#: Fixed value: how this family of vocabularies cuts a text into words.
_EXACT = (
    rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The same on texts of characters whose classes are certain.
_QUICK = re.compile(
    rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)
#: White space that parts otherwise than by single spaces and line ends, and the mark that cuts runs.
_OTHER_SPACE = re.compile(r"[ \n](?=[ \n])|[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNCERTAIN = re.compile(r"[^\t\n\r -~¡-©«¬®-±´¶-¸»¿-ÿ‐-‧€]")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 byte values: a byte that prints
    in Latin-1 stands for itself, the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        self.pattern = regex.compile(_EXACT)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spelled: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for word, i in model["vocab"].items():
            self.spelled[i] = bytes(letters[c] for c in word)
        self.ids = {s: i for i, s in enumerate(self.spelled) if s}
        for word, i in self.special.items():
            self.spelled[i] = word.encode()
        # Rank of the merge that makes a token; single bytes come before all merges.
        self.rank = [-1] * len(self.spelled)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.spelled)
        self.merge: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge[i, j] = r
            if self.halves[k] is None and k != i:
                self.rank[k], self.halves[k] = r, (i, j)
        self._suffixes()
        self.pairs = Memo(PAIR_ENTRIES)
        self.memo = Memo(memo_entries)

    def may_follow(self, left: int, right: int) -> bool:
        """True if merging the bytes of left and right stops at these two tokens. Undo the latest merge on either
        side of the border; a merge of the two tokens then facing each other would have come first, and joined
        them, if its rank is below that of the merge just undone (equal ranks run from left to right)."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        merge, rank, halves = self.merge, self.rank, self.halves
        a, b = left, right
        bound, on_right = 1 << 60, False
        while True:
            r = merge.get((a, b))
            # On a tie of ranks the pair further left merges first: the border lies right of a's inner pair,
            # and left of b's.
            if r is not None and (r < bound or (on_right and r == bound)):
                verdict = False
                break
            if rank[a] < 0 and rank[b] < 0:
                verdict = True
                break
            if rank[a] > rank[b]:
                bound, on_right = rank[a], False
                a = halves[a][1]
            else:
                bound, on_right = rank[b], True
                b = halves[b][0]
        if len(self.pairs) > self.pairs.most:
            self.pairs.clear()
        self.pairs[key] = verdict
        return verdict

    def _suffixes(self) -> None:
        """For every string that starts a vocabulary entry (a state): the states that a byte leads to, and the
        entries that end it, longest first. Following a word byte by byte, the state is the longest such string
        that ends the prefix read so far."""
        step, spelled, depth = {}, [b""], [0]
        own: list[int] = [-1]
        for entry, token in self.ids.items():
            s = 0
            for byte in entry:
                t = step.get(s << 8 | byte)
                if t is None:
                    t = step[s << 8 | byte] = len(own)
                    own.append(-1)
                    depth.append(depth[s] + 1)
                s = t
            own[s] = token
        back, ends = [0] * len(own), [()] * len(own)
        for key, t in sorted(step.items(), key=lambda kv: depth[kv[1]]):
            s, byte = key >> 8, key & 255
            if s:
                s = back[s]
                while s and (s << 8 | byte) not in step:
                    s = back[s]
                back[t] = step.get(s << 8 | byte, 0)
            ends[t] = ((own[t], depth[t]), *ends[back[t]]) if own[t] >= 0 else ends[back[t]]
        self.step, self.back, self.ends = step, back, ends
        self.moves = Memo(PAIR_ENTRIES)

    def _move(self, state: int, byte: int) -> int:
        s = state
        while s and (s << 8 | byte) not in self.step:
            s = self.back[s]
        to = self.step.get(s << 8 | byte, 0)
        if len(self.moves) > self.moves.most:
            self.moves.clear()
        self.moves[state << 8 | byte] = to
        return to

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words, in their sorted order, which this sorts in place."""
        words.sort()
        may, spelled, ends = self.may_follow, self.spelled, self.ends
        known, moves = self.pairs.get, self.moves.get
        path: list[int] = [0]  # path[d]: last token of the prefix of d bytes; path[0] is not used
        states: list[int] = [0]
        before, out = b"", []
        for word in words:
            n = min(len(before), len(word))
            d = 0
            if word[:n] == before[:n]:
                d = n
            else:
                while word[d] == before[d]:
                    d += 1
            del path[d + 1 :], states[d + 1 :]
            state = states[d]
            for end in range(d + 1, len(word) + 1):
                to = moves(state << 8 | word[end - 1])
                state = self._move(state, word[end - 1]) if to is None else to
                for token, size in ends[state]:  # noqa: B007
                    if size == end:
                        break
                    left = path[end - size]
                    ok = known(left << 20 | token)
                    if may(left, token) if ok is None else ok:
                        break
                path.append(token)
                states.append(state)
            tokens, at = [], len(word)
            while at:
                tokens.append(path[at])
                at -= len(spelled[path[at]])
            tokens.reverse()
            out.append(tokens)
            before = word
        return out

    def _cut(self, text: str) -> list[str]:
        return self.pattern.findall(text) if _UNCERTAIN.search(text) else _QUICK.findall(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token's string is one, and nothing reaches across it."""
        if self.special_cut is None or not self.special_cut.search(text):
            return self._cut(text)
        out: list[str] = []
        for piece in self.special_cut.split(text):
            out += [piece] if piece in self.special else self._cut(piece)
        return out

    def _runs(self, text: str) -> list[str] | None:
        """Where only single spaces and line ends part the text: its runs of other characters, a space with the
        run after it. A pre-token lies within one of these."""
        if _OTHER_SPACE.search(text) or "<|" in text:
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        memo.new.clear()
        if len(memo) > memo.most:
            memo.clear()
        found = [list(map(memo.__getitem__, self._runs(t) or self.words(t))) for t in texts]
        if not memo.new:
            return list(map(b"".join, found))
        runs = {w: self.words(w) for w in memo.new}
        missing = {x for words in runs.values() for x in words if x not in memo}
        spelled = {w.encode("utf-8"): w for w in missing if w not in self.special}
        order = list(spelled)
        for ids, raw in zip(self.encode_words(order), order):
            memo[spelled[raw]] = array("I", ids).tobytes()
        for w in missing.intersection(self.special):
            memo[w] = array("I", [self.special[w]]).tobytes()
        for run, words in runs.items():
            if run not in memo:
                memo[run] = b"".join(map(memo.__getitem__, words))
        return [b"".join([x if x.__class__ is bytes else memo[x] for x in ids]) for ids in found]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if len(numbers) < 2:
            raw = b"".join(self.spelled[i] for i in numbers)
        else:
            raw = b"".join(itemgetter(*numbers)(self.spelled))
        return raw.decode("utf-8", "replace")


_encoders: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    at, size = [], 0
    for t in texts:
        at.append(t)
        size += len(t)
        if size > SLICE_CHARS:
            yield at
            at, size = [], 0
    if at:
        yield at


def bpe_encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids binary): each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(tokenizer)
        for b in batches:
            at = 0
            for texts in _slices([t or "" for t in b.column(1).to_pylist()]):
                ids = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())], ["doc_id", "ids"]
                )
                at += len(texts)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids binary) -> (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(tokenizer)
        for b in batches:
            texts = [None if x is None else encoder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digest(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes, decodes from the ids and returns digests of both, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(tokenizer)
        for b in batches:
            sizes, id_hash, text_hash = [], [], []
            for texts in _slices([t or "" for t in b.column(1).to_pylist()]):
                for ids in encoder.encode(texts):
                    sizes.append(len(ids) // 4)
                    id_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
