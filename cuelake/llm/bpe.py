"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

Texts are split into words by the tokenizer's pattern, many texts at once: characters are put into
four classes, and runs of one class, the space before them and contractions give the bounds of
the words. For each distinct word one row of an array holds the parts still apart and, next to
them, the ranks of adjacent pairs. The smallest rank is looked up by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed, until no adjacent pair has a rank. Rows of
many words advance together; words over `LONG_WORD` bytes use a heap, whose cost does not grow
with the square of the length.

Ids of words are kept in arrays of a bounded number of bytes, found by a 64-bit hash. Decoding reads the ids
only. A text that doesn't come back byte by byte (two words with one hash) is encoded again word by word.

Null and empty texts have no tokens. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import as_text, code_point_classes, code_points, mapped, mix64, powers

#: Fixed values of the tokenizer's pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CLASSES = (r"\p{L}+", r"\p{N}+", r"\s+")
OTHER, LETTER, NUMBER, SPACE = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LONG_WORD = 64
#: Characters encoded at once, places for words, and ids kept; together they bound a worker's memory.
STEP_CHARS = 1 << 20
SLOTS = 1 << 19
POOL = 1 << 22
NO_RANK = 1 << 30


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Read a byte-level BPE file into plain arrays; their size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, to_byte = spec["model"]["vocab"], printable_bytes()
    pieces = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in special.items():
        pieces[i] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {
        "pieces": [pieces.get(i, b"") for i in range(max(pieces) + 1)],
        "left": np.array([vocab[a] for a, _ in pairs], dtype=np.int64),
        "right": np.array([vocab[b] for _, b in pairs], dtype=np.int64),
        "merged": np.array([vocab[a + b] for a, b in pairs], dtype=np.int64),
        "byte_ids": np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], dtype=np.int64),
        "special": special,
    }


class ByteLevelCodec:
    """Encodes and decodes; keeps the ids of `slots` words at most, and `pool` ids besides those of the last step."""

    def __init__(self, vocabulary: dict, slots: int = SLOTS, pool: int = POOL):
        self.byte_ids, self.special = vocabulary["byte_ids"], vocabulary["special"]
        pieces = vocabulary["pieces"]
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.size_of = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        texts = [f"{i}," for i in range(len(pieces))]
        width = len(texts[-1])
        self.digits = np.frombuffer("".join(t.ljust(width) for t in texts).encode(), dtype=np.uint8).reshape(-1, width)
        key = (vocabulary["left"] << 32) | vocabulary["right"]
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.merged = vocabulary["merged"]
        self.ranks: dict[int, int] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.slots, self.pool_most = slots, pool
        self.reset()

    def reset(self) -> None:
        self.slot_hash = np.zeros(self.slots, dtype=np.uint64)
        self.slot_at = np.zeros(self.slots, dtype=np.int64)
        self.slot_size = np.full(self.slots, -1, dtype=np.int32)
        self.pool, self.used = np.zeros(self.pool_most // 8, dtype=np.int32), 0

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], NO_RANK)

    def merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each) of short words: one row of parts and of adjacent ranks for each word."""
        n, width = len(starts), int(lengths.max()) + 1
        columns = np.arange(width)
        inside = columns < lengths[:, None]
        ids = np.full((n, width), -1, dtype=np.int64)
        ids[inside] = self.byte_ids[data[(starts[:, None] + columns)[inside]]]
        ranks = np.full((n, width), NO_RANK, dtype=np.int64)
        ranks[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        left, out = np.arange(n), np.full((n, width), -1, dtype=np.int64)
        while len(left):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(left)), at]
            done = least == NO_RANK
            if done.any():
                out[left[done]] = ids[done]
                go = ~done
                left, ids, ranks, at, least = left[go], ids[go], ranks[go], at[go], least[go]
                if not len(left):
                    break
            rows = np.arange(len(left))
            ids[rows, at] = self.merged[least]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)  # the boundary after `at` goes
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            source = np.minimum(columns + (columns >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ranks[:, -1] = NO_RANK
            ranks[rows, at] = self.rank_of(ids[rows, at], ids[rows, np.minimum(at + 1, width - 1)])
            has = at > 0
            before = np.maximum(at - 1, 0)
            fresh = self.rank_of(ids[rows, before], ids[rows, at])
            ranks[rows[has], before[has]] = fresh[has]
        real = out >= 0
        return out[real], real.sum(axis=1)

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word, with a heap of (rank, position)."""
        if not self.ranks:
            self.ranks = dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get((ids[i] << 32) | ids[nxt[i]]) if nxt[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            ids[i], gone = int(self.merged[r]), nxt[i]
            ids[gone] = -1
            nxt[i] = nxt[gone]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for j in (prev[i], i):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, (r, j))
        return [i for i in ids if i >= 0]

    def keep(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Put the ids of new words into the pool; where each begins."""
        at = self.used + np.cumsum(sizes) - sizes
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used), dtype=np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        self.slot_hash[slot], self.slot_at[slot], self.slot_size[slot] = hashes, at, sizes
        clash = self.slot_hash[slot] != hashes  # of two new words for one place either stays, as a whole
        if clash.any():
            self.slot_size[slot[clash]] = -1
        return at

    def ids_of_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each): known ones from the pool, the rest by merging."""
        if self.used > self.pool_most:
            self.reset()
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]).cumsum(dtype=np.uint64)])
        hashes = mix64((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        counts = self.slot_size[slot].astype(np.int64)
        at = self.slot_at[slot]
        long = sizes > LONG_WORD
        lacking = np.flatnonzero((self.slot_hash[slot] != hashes) | (counts < 0) | long)
        short = lacking[~long[lacking]]
        if len(short):
            own, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
            at_new, n_new = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            order = np.argsort(sizes[short[first]], kind="stable")
            lengths = sizes[short[first]][order]
            k = 0
            while k < len(order):
                end = min(k + 4_000, int(np.searchsorted(lengths, max(8, lengths[k] + lengths[k] // 4), side="right")))
                rows = order[k:end]
                ids, n_new[rows] = self.merge_rows(data, starts[short[first[rows]]], lengths[k:end])
                at_new[rows] = self.keep(ids, n_new[rows], own[rows])
                k = end
            at[short], counts[short] = at_new[inverse], n_new[inverse]
        known: dict[bytes, tuple[int, int]] = {}
        for k in np.flatnonzero(long).tolist():
            word = data[starts[k] : starts[k] + sizes[k]].tobytes()
            if word not in known:
                ids = np.array(self.merge_long(word), dtype=np.int64)
                known[word] = (self.used, len(ids))
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used), dtype=np.int32)])
                self.pool[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
            at[k], counts[k] = known[word]
        return self.pool[ragged(at, counts)], counts

    def parts(self, text: str) -> list[str]:
        """Special tokens and the texts between them, in text order; the odd ones are special."""
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return self.split.split(text)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= STEP_CHARS):
                chars += len(texts[end])
                end += 1
            yield from self.encode_step(texts[start:end])
            start = end

    def encode_step(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.parts(t) for t in texts]
        plain = [p for parts in split for p in parts[::2]]
        lengths = np.array([len(p) for p in plain], dtype=np.int64)
        points = code_points("".join(plain))
        first = np.cumsum(lengths) - lengths
        bounds = word_starts(points, first[lengths > 0])
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(width)])
        data = np.frombuffer("".join(plain).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts = byte_at[bounds]
        ids, counts = self.ids_of_words(data, starts, np.diff(np.append(starts, len(data)))) if len(starts) else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        so_far = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])
        low, high = so_far[np.searchsorted(bounds, first)], so_far[np.searchsorted(bounds, first + lengths)]
        byte_low, byte_high = byte_at[first], byte_at[first + lengths]
        out, k = [], 0
        for parts in split:
            found = []
            for j, part in enumerate(parts):
                if j % 2:
                    found.append(np.array([self.special[part]], dtype=np.int32))
                    continue
                own = ids[low[k] : high[k]]
                if self.bytes_of(own) != data[byte_low[k] : byte_high[k]].tobytes():
                    own = self.encode_apart(part)
                found.append(own)
                k += 1
            out.append(found[0] if len(found) == 1 else np.concatenate(found))
        return out

    def encode_apart(self, text: str) -> np.ndarray:
        """Word by word without hashes."""
        bounds = [*word_starts(code_points(text), np.zeros(1, dtype=np.int64)).tolist(), len(text)]
        return np.array([i for a, b in zip(bounds, bounds[1:], strict=False) for i in self.merge_long(text[a:b].encode("utf-8", "surrogatepass"))], dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        rows = self.digits[ids]
        return rows[rows != 32].tobytes()[:-1]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.blob[ragged(self.start_of[ids], self.size_of[ids])].tobytes()

    def decode(self, ids) -> str:
        return self.bytes_of(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin in some texts set side by side; first: where each of these texts, none of them empty, begins."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kinds = code_point_classes(CLASSES)[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = edge[n] = True
    opens = edge[:-1].copy()
    opens[1:] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(opens)
    ends = np.append(runs[1:], n)
    kind = kinds[runs]
    out = opens
    followed = ~edge[ends]  # by another run of the same text
    spaces = np.flatnonzero((kind == SPACE) & followed)
    out[ends[spaces] - 1] = True  # the last of several leaves the rest
    blank = spaces[points[ends[spaces] - 1] == 32]
    out[ends[blank]] = False  # and a plain space belongs to what follows
    quote = np.flatnonzero((kind == OTHER) & (points[runs] == 39) & (ends - runs == 1) & followed & out[runs])
    quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == LETTER]
    if len(quote):
        at, room = ends[quote], ends[quote + 1] - ends[quote]
        size = np.zeros(len(quote), dtype=np.int64)
        for tail in CONTRACTIONS:
            fits = room >= len(tail)
            for k, c in enumerate(tail):
                fits &= points[np.minimum(at + k, n - 1)] == ord(c)
            size[fits & (size == 0)] = len(tail)
        has = size > 0
        at, room, size = at[has], room[has], size[has]
        out[at] = False
        out[(at + size)[size < room]] = True
    return np.flatnonzero(out)


_CODECS: dict[int, ByteLevelCodec] = {}


def codec_of(vocabulary) -> ByteLevelCodec:
    """One codec for each Python worker and broadcast vocabulary, so that a later task finds the words of an earlier one."""
    key = getattr(vocabulary, "_path", None) or id(vocabulary)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteLevelCodec(vocabulary.value)
    return _CODECS[key]


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) of every row, in one narrow pass.

    Null and empty texts: 0 tokens, digests of the empty string, an empty array. Repeated rows give
    repeated results; other columns are not read.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(tokenizer_path))  # bounded by the vocabulary, not by the data
    kind = dict(df.dtypes)[id_col]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: 4 if ids else 3]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(vocabulary)
        for batch in batches:
            keys, rows, start, held = batch[id_col].to_numpy(), [], 0, 0
            for k, own in enumerate(codec.encode_batch([as_text(t) for t in batch["text"]])):
                row = (len(own), hashlib.sha256(codec.joined(own)).hexdigest(), hashlib.sha256(codec.decode(own).encode("utf-8", "surrogatepass")).hexdigest())
                rows.append((*row, own) if ids else row)
                held += len(own)
                if held >= STEP_CHARS or k + 1 == len(keys):  # what a task holds at once is bounded by a step, not by a batch
                    out = pd.DataFrame(rows, columns=names)
                    out.insert(0, id_col, keys[start : k + 1])
                    yield out
                    rows, start, held = [], k + 1, 0

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    return mapped(df.selectExpr(f"`{id_col}`", f"`{text_col}` AS text"), run, schema)


def decode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) from an array of ids; null counts as empty."""
    vocabulary = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(vocabulary)
        for batch in batches:
            texts = [codec.decode(ids) if ids is not None else "" for ids in batch["ids"]]
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), "text": texts})

    return mapped(df.selectExpr(f"`{id_col}`", f"`{ids_col}` AS ids"), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")
