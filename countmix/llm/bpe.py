"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  In each round the pairs of
neighbours become 64-bit keys, their ranks are found by binary search over
the sorted keys of the merge table, and every word merges its lowest-ranked
pair.  A word of more than ``LONG_WORD`` bytes would need about as many rounds as
merges, each over all of it; its pairs wait in a heap by (rank, position) instead,
with the same result.  Each distinct word of a worker is encoded once (a bounded
cache, emptied when full; it only saves time).

Edge cases: null text counts as empty; an empty text has no ids; repeated
rows are each encoded; a null id is passed through; an id that no token has is
left out when decoding; null ids decode to the empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

#: White space of the tokenizer's patterns (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
NO_RANK = np.int64(2**62)
#: Distinct words kept by one worker.
CACHE_WORDS = 250_000
#: Characters of the distinct words kept by one worker.
CACHE_CHARS = 16_000_000
#: Words of more bytes than this are merged by a heap, not in rounds.
LONG_WORD = 256


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class BpeModel:
    """A tokenizer.json whose model is byte-level BPE with a word-end suffix,
    normalised by NFC, one space for white space and lower case."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {v: k for k, v in (self.vocab | self.special).items()}
        self.token_of = {str(i): name for i, name in self.names.items()}
        letters = byte_alphabet()
        self.byte_id = np.array([self.vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.end_id = np.array([self.vocab.get(c + self.suffix, -1) for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made_of = keys[order], order.astype(np.int64), made[order]
        # all occurrences of the best pair may merge in one round if nothing
        # built from a merge's result can rank before that merge
        first_use = np.full(max(self.names) + 1, NO_RANK)
        ranks = np.arange(len(merges))
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.all_at_once = bool((first_use[made] > ranks).all())

    def normalise(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them as they are."""
        if "<" not in text or not self.special_split:
            return self.pattern.findall(self.normalise(text))
        out: list[str] = []
        for p in self.special_split.split(text):
            if p in self.special:
                out.append(p)
            elif p:
                out.extend(self.pattern.findall(self.normalise(p)))
        return out

    def encode_words(self, words: list[str], long_word: int = LONG_WORD) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and where each word's ids end."""
        raw = [w.encode("utf-8") for w in words]
        long = {i: self.merge_long(r) for i, r in enumerate(raw) if len(r) > long_word}
        ids, ends = self.merge_rounds([b"" if i in long else r for i, r in enumerate(raw)])
        if not long:
            return ids, ends
        parts = np.split(ids, ends[:-1])
        for i, own in long.items():
            parts[i] = own
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def merge_long(self, raw: bytes) -> np.ndarray:
        """The ids of one word of any length: the leftmost pair of the lowest rank
        is merged until none is left, at a cost of log(n) a merge."""
        flat = np.frombuffer(raw, dtype=np.uint8)
        ids = self.byte_id[flat]
        ids[-1] = self.end_id[flat[-1]]
        ids = ids[ids >= 0]
        n = len(ids)
        key = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        heap = (self.rank_of[at[hit]] << 32 | hit).tolist()
        heapq.heapify(heap)
        sym, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        while heap:
            rank, i = divmod(heapq.heappop(heap), 2**32)
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            now, made = pairs.get(sym[i] << 32 | sym[j], (-1, 0))
            if now != rank:  # one of the two has been merged since
                continue
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if new := pairs.get(made << 32 | sym[k]):
                    heapq.heappush(heap, new[0] << 32 | i)
            h = before[i]
            if h >= 0 and (new := pairs.get(sym[h] << 32 | made)):
                heapq.heappush(heap, new[0] << 32 | h)
        left = np.array(sym, dtype=np.int64)
        return left[left >= 0]

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and result of each pair key."""
        return dict(zip(self.keys.tolist(), zip(self.rank_of.tolist(), self.made_of.tolist())))

    def decode(self, ids: str) -> str:
        """The text of decimal ids that are joined by one space: their tokens joined
        by a space (the tokenizer file names no decoder)."""
        return " ".join([t for t in map(self.token_of.get, ids.split()) if t is not None])

    def merge_rounds(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, by merge rounds over all of them at once, and
        where each word's ids end."""
        size = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        sym = self.byte_id[flat]
        ends = np.cumsum(size)[size > 0] - 1
        sym[ends] = self.end_id[flat[ends]]
        known = sym >= 0
        sym, word = sym[known], word[known]
        done_word, done_sym = [], []
        while len(sym) > 1:
            same = word[:-1] == word[1:]
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = same & (self.keys[at] == key)
            rank = np.where(hit, self.rank_of[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            run = np.diff(np.append(starts, len(sym)))
            lowest = np.repeat(lowest, run)
            over = lowest == NO_RANK
            done_word.append(word[over])
            done_sym.append(sym[over])
            best = (rank == lowest) & ~over
            pos = np.flatnonzero(best)
            if self.all_at_once:
                # of overlapping pairs (aaa) every second one, from the left
                new_run = np.append(True, np.diff(pos) != 1) if len(pos) else np.zeros(0, dtype=bool)
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run_start) % 2 == 0]
            else:
                pos = pos[np.append(True, word[pos][1:] != word[pos][:-1])] if len(pos) else pos
            sym[pos] = self.made_of[at[pos]]
            keep = ~over
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        done_word.append(word)
        done_sym.append(sym)
        w, s = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(w, kind="stable")
        return s[order], np.searchsorted(w[order], np.arange(1, len(raw) + 1))


class TextEncoder:
    """Encodes whole texts; remembers the ids of words as decimal text and forgets
    all when it holds ``cache_words`` of them or ``CACHE_CHARS`` of their characters."""

    def __init__(self, model: BpeModel, cache_words: int = CACHE_WORDS):
        self.model, self.limit = model, cache_words
        self.words: dict[str, str] = {}
        self.chars = 0
        self.id_text = {i: str(i) for i in model.names}

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > self.limit or self.chars + sum(map(len, new)) > CACHE_CHARS:
            self.words, self.chars, new = {}, 0, words
        self.chars += sum(map(len, new))
        for name in new.intersection(self.model.special):
            self.words[name] = str(self.model.special[name])
        unseen = list(new.difference(self.model.special))
        if not unseen:
            return
        ids, ends = self.model.encode_words(unseen)
        digits = list(map(self.id_text.__getitem__, ids.tolist()))
        lo = 0
        for w, hi in zip(unseen, ends.tolist(), strict=True):
            self.words[w] = " ".join(digits[lo:hi])
            lo = hi

    def encode(self, batch: list[str]) -> list[tuple[str, str]]:
        """Per text: its ids joined by one space, and the text they decode to."""
        cut = [self.model.split(t) for t in batch]
        self.learn(set().union(*cut))
        ids = [" ".join([g for g in map(self.words.__getitem__, ws) if g]) for ws in cut]
        return [(i, self.model.decode(i)) for i in ids]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_for(spec: str) -> TextEncoder:
    """One encoder per worker process and tokenizer."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(BpeModel(spec))
    return _ENCODERS[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, tokens``: the ids of each whole text and the
    text they decode to (tokens joined by a space: the file names no decoder).

    One pass over the rows without a shuffle; the tokenizer file is read on
    the driver and its text (a fixed file, some MB) goes out as a broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    rows = texts(docs, id_col, text_col)

    def run(batches):
        enc = encoder_for(spec.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = enc.encode(part.column("text").to_pylist())
                ids = [g[0] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()), pa.array(ids, pa.string()), pa.array([g[1] for g in got], pa.string())],
                    ["doc_id", "n_tokens", "ids", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids string, tokens string")


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of rows that hold decimal ids joined by one space, as
    :func:`encode_documents` gives them.  One pass over the rows without a shuffle."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    rows = texts(encoded, id_col, ids_col)

    def run(batches):
        model = encoder_for(spec.value).model
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.decode(t) for t in part.column("text").to_pylist()], pa.string())], ["doc_id", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, decoded string")


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document: digests of
    the decimal ids joined by one space and of the decoded text in UTF-8.

    As :func:`encode_documents`, but the long strings stay in the worker.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    rows = texts(docs, id_col, text_col)

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        enc = encoder_for(spec.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = enc.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([i.count(" ") + 1 if i else 0 for i, _ in got], pa.int64()), pa.array([digest(i) for i, _ in got]), pa.array([digest(t) for _, t in got])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
