"""Byte-level BPE by speculation: greedy longest match, a vectorised check of all adjacent pairs, exact merging of the rest.

The sequence of tokens that merging gives for a word is the only one whose adjacent pairs are all stable, that is, in
which merging the bytes of a pair gives this pair again. So a greedy proposal is the answer as soon as
every adjacent pair of it is stable, and only words with an unstable pair have to be merged step by step.
"""

from __future__ import annotations

import heapq
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern of the public tokenizer that splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 stays, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A vocabulary file (JSON with ``model.vocab`` and ``model.merges``), ready to encode."""

    #: words kept between batches; beyond it the memory starts anew
    REMEMBER = 200_000

    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        symbols = byte_symbols()
        raw = {t: bytes(symbols[c] for c in t) for t in model["vocab"] if all(c in symbols for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        reachable = {vocab[c] for c in symbols if c in vocab} | {vocab[a + b] for a, b in pairs}
        self.ids = {raw[t]: i for t, i in vocab.items() if i in reachable}
        #: longest token by first byte
        self.longest = [0] * 256
        for w in self.ids:
            self.longest[w[0]] = max(self.longest[w[0]], len(w))
        size = max(vocab.values()) + 1
        self.size = size
        self.first, self.second = np.arange(size), np.arange(size)
        # rank of the merge that makes a token; single bytes come before all merges
        self.rank = np.full(size, -1)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merge[a, b] = (r, c)
            if self.rank[c] < 0:
                self.first[c], self.second[c], self.rank[c] = a, b, r
        codes = np.fromiter((a * size + b for a, b in self.merge), np.int64, len(self.merge))
        ranks = np.fromiter((r for r, _ in self.merge.values()), np.int64, len(self.merge))
        order = np.argsort(codes)
        self._codes, self._ranks = codes[order], ranks[order]
        self._split = regex.compile(SPLIT)
        self._known: dict[str, np.ndarray] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            for end in range(min(n, at + longest[word[at]]), at, -1):
                token = ids.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], np.iinfo(np.int64).max)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives the pair again.

        Merging fails to stop at the border only if some token ending there, while ``a`` is built, and some token starting
        there, while ``b`` is built, are merged before either of them grows. Going back in time from (a, b), the one
        made last is taken apart, and each such state is tested: a merge across the border breaks the pair if it is
        due before the next step of either side.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        never = np.iinfo(np.int64).max
        # rank at which the present left (right) part is used up by the next merge on its side
        due_a, due_b = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            x, y = a[live], b[live]
            across = self._merge_rank(x, y)
            # a merge has its own rank, so a tie means a run of one token, where the leftmost pair goes first
            bad = (across != never) & (across < due_a[live]) & (across <= due_b[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_a = rx >= ry
            end = (rx < 0) & (ry < 0)
            go = ~bad & ~end
            live, undo_a, x, y = live[go], undo_a[go], x[go], y[go]
            due_a[live] = np.where(undo_a, self.rank[x], due_a[live])
            due_b[live] = np.where(undo_a, due_b[live], self.rank[y])
            a[live] = np.where(undo_a, self.second[x], x)
            b[live] = np.where(undo_a, y, self.first[y])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        ids = [self.ids[bytes([c])] for c in word]
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i] = self.merge[x, y][1]
            alive[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t, a in zip(ids, alive) if a]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet, all together."""
        raw = [w.encode() for w in words]
        proposed = [[i] if (i := self.ids.get(w)) is not None else self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposed)), lengths)
        inside = owner[1:] == owner[:-1]
        pair = np.unique(flat[:-1][inside] * self.size + flat[1:][inside])
        broken = pair[~self.stable(pair // self.size, pair % self.size)]
        failing = np.unique(owner[1:][inside][np.isin(flat[:-1][inside] * self.size + flat[1:][inside], broken)])
        for w, p in zip(words, proposed):
            self._known[w] = np.array(p, np.int32)
        for i in failing:
            self._known[words[i]] = np.array(self.merged(raw[i]), np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self._known) > self.REMEMBER:
            self._known.clear()
        split = [self._split.findall(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self._known}
        if new:
            self.learn(list(new))
        none, known = np.zeros(0, np.int32), self._known
        return [np.concatenate([known[w] for w in words]) if words else none for words in split]


_OF_WORKER: dict[str, Bpe] = {}


def _of_worker(digest: str, shared) -> Bpe:
    """The encoder of this Python worker, which is kept from task to task with the words it has learnt."""
    if digest not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[digest] = Bpe(shared.value)
    return _OF_WORKER[digest]


def encode_documents(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids array<int>): each text by the vocabulary file at path ``vocabulary``, without special tokens.

    The text is taken unchanged and whole. Null and empty texts give the empty list; a null ``doc_id`` stays null; repeated
    rows are encoded each. Strings of special tokens in a text are ordinary text. The file (it must be under
    32 MB) is read by the driver and broadcast, so executors need no copy. ``batch_chars`` bounds what is worked on at once,
    though a single text is never cut.
    """
    with open(vocabulary, "rb") as f:
        file = f.read(32_000_001)
    if len(file) > 32_000_000:
        raise ValueError("the vocabulary file is larger than 32 MB")
    shared = df.sparkSession.sparkContext.broadcast(file)
    kind, digest = dict(df.dtypes)[doc_id], hashlib.sha256(file).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of_worker(digest, shared)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < batch_chars):
                    size += len(texts[end] or "")
                    end += 1
                out = bpe.encode_batch(texts[at:end])
                offsets = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
                values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])
                at = end

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
