"""BPE encoding and decoding by batched numpy merge rounds.

The words of a batch lie in one flat array of symbols. A round looks up every adjacent pair in the sorted table of
merges by binary search, takes each word's pair of lowest rank, joins its occurrences from left to right, and
repeats until no word has a pair that merges. A word of very many letters would need a round for each rank in it; it
takes its pairs of lowest rank from a heap instead. What stands between two white spaces (a run) is looked up
whole in a bounded cache, so only new runs are split into words, and only new words are merged.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import per_text

#: Most runs, and most words, that a worker's caches hold before they are emptied; no limit on what is encoded.
CACHE_RUNS, CACHE_WORDS = 500_000, 300_000
#: Letters (bytes) from which a word is merged by a heap.
LONG = 1000


SPACE, SIGNS = regex.compile(r"\s+"), regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with word ends: normalise, split into words, merge within words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word_re = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        letters = byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined[order]
        self.tokens: list[str | None] = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t
        self.cache: dict[str, tuple] = {}
        self.runs: dict[str, tuple] = {}

    @functools.cached_property
    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Of each pair that merges: its rank and what it becomes."""
        return {(k >> 32, k & 0xFFFFFFFF): x for k, x in zip(self.keys.tolist(), zip(self.ranks.tolist(), self.joined.tolist(), strict=True), strict=True)}

    def merge_long(self, word: str) -> np.ndarray:
        """Token ids of one word, in time near to proportional to its length."""
        coded = np.frombuffer(word.encode(), np.uint8)
        first = self.first[coded]
        first[-1] = self.last[coded[-1]]
        ids, table = first[first >= 0].tolist(), self.table
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(table[x][0], k, *x) for k, x in enumerate(zip(ids, ids[1:])) if x in table]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = table[a, b][1], -1
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
            for left, right in ((before[k], k), (k, far)):
                if left >= 0 and right < n and (x := (ids[left], ids[right])) in table:
                    heapq.heappush(heap, (table[x][0], left, *x))
        return np.array([i for i in ids if i >= 0], np.int64)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.frombuffer(b"".join(coded), np.uint8)
        ids, word = self.first[flat], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[flat[ends]]
        known = ids >= 0
        ids, word = ids[known], word[known]
        done_ids, done_word = [], []
        far = np.iinfo(np.int64).max
        while ids.size:
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], far)
            low = np.full(len(words), far)
            np.minimum.at(low, word[:-1], rank)
            live = low[word] < far
            done_ids.append(ids[~live])
            done_word.append(word[~live])
            take = (rank < far) & (rank == low[word[:-1]])
            # Of touching occurrences (a a a) the first, third, ... of each run merge.
            where = np.flatnonzero(take)
            if not where.size:
                break
            new_run = np.r_[True, np.diff(where) > 1]
            start = where[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            where = where[(where - start) % 2 == 0]
            ids = ids.copy()
            ids[where] = self.joined[at[where]]
            live[where + 1] = False
            ids, word = ids[live], word[live]
        all_ids, all_word = np.concatenate(done_ids) if done_ids else ids, np.concatenate(done_word) if done_word else word
        order = np.argsort(all_word, kind="stable")
        return np.split(all_ids[order], np.cumsum(np.bincount(all_word, minlength=len(words)))[:-1])

    @staticmethod
    def normal(text: str) -> str:
        """NFC, and each character in lower case by itself (no final sigma). White space is in no word, so its form does not matter."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, run: str) -> list:
        """Pieces of a run: a special token's id, or a word."""
        out, at = [], 0
        for m in self.special_re.finditer(run) if self.special_re else ():
            out += self.word_re.findall(self.normal(run[at : m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.word_re.findall(self.normal(run[at:]))

    def learn(self, words: set[str]) -> None:
        """Put words into the cache."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        short = sorted(w for w in words if len(w) < LONG)
        put = lambda w, ids: self.cache.__setitem__(w, (ids.astype("<u4").tobytes(), " ".join([self.tokens[i] for i in ids.tolist()])))
        for lo in range(0, len(short), 50_000):
            part = short[lo : lo + 50_000]
            for w, ids in zip(part, self.merge(part), strict=True):
                put(w, ids)
        for w in words:
            if len(w) >= LONG:
                put(w, self.merge_long(w))

    def learn_runs(self, runs: set[str]) -> None:
        """Put runs into the cache."""
        runs, joined = list(runs), "\n".join(runs)
        if self.special_re and self.special_re.search(joined):
            split = [self.parts(r) for r in runs]
        else:  # isalpha is \p{L}+: such a run is one word
            split = [[r] if r.isalpha() else self.word_re.findall(r) for r in self.normal(joined).split("\n")]
        words = {w for pieces in split for w in pieces if isinstance(w, str)}
        missing = words.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = words
        self.learn(missing)
        get = self.cache.__getitem__
        special = lambda i: (int(i).to_bytes(4, "little"), self.tokens[i])
        for run, pieces in zip(runs, split, strict=True):
            if len(pieces) == 1 and isinstance(pieces[0], str):
                self.runs[run] = get(pieces[0])
            else:
                got = [get(w) if isinstance(w, str) else special(w) for w in pieces]
                self.runs[run] = (b"".join([x[0] for x in got]), " ".join([x[1] for x in got if x[1]]))

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text: its ids as little-endian unsigned 32-bit integers, and its decoding (tokens joined by one space)."""
        # str.split also parts at these four signs, which are no white space to the tokenizer. No special token holds white space.
        split = [SPACE.split(t) if SIGNS.search(t) else t.split() for t in texts]
        new = set().union(*split).difference(self.runs)
        if new:
            if len(self.runs) + len(new) > CACHE_RUNS:
                self.runs.clear()
                new = set().union(*split)
            self.learn_runs(new)
        get, out = self.runs.__getitem__, []
        for runs in split:
            ids, shown = zip(*map(get, runs), strict=True) if runs else ((), ())
            out.append((b"".join(ids), " ".join(filter(None, shown))))
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``; null text counts as empty.

    ``path`` names a tokenizer file that every executor has. The file has no decoder, so decoding joins tokens by
    one space. Repeated rows each get a row, other columns are ignored, an empty table gives an empty result.
    """

    def setup():
        bpe = load(path)

        def digests(texts):
            got = bpe.encode_batch(texts)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return [len(b) // 4 for b, _ in got], [sha(b) for b, _ in got], [sha(s.encode()) for _, s in got]

        return digests

    return per_text(docs, "text", ["doc_id"], setup, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row; null and empty texts have none. Repeated rows each get a row; an empty table gives an empty result."""
    return per_text(docs, "text", ["doc_id"], lambda: lambda texts: ([np.frombuffer(b, "<u4").tolist() for b, _ in load(path).encode_batch(texts)],), "ids array<int>")
