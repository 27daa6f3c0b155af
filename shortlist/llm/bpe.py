"""Byte-pair encoding and decoding with a given vocabulary, by a pair occurrence index.

The words of a batch are cut into symbols once. An index maps each adjacent pair that the
vocabulary can merge to all positions where it occurs. Ranks are applied in ascending
order, each to all its positions at once; a merge enters the pairs it creates into the
index, so no word is scanned again. Only words that were not met before in the task
are encoded (a bounded memory keeps them).

The vocabulary file is a ``tokenizers`` JSON with a BPE model. Supported parts: the
normalizers NFC, white space to one space, and lower case; a split pattern whose matches
are kept; byte-level symbols; an end-of-word suffix; added tokens matched in the raw text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import gather, lists, over_batches, texts_of

#: words remembered by a task before its memory starts anew
WORDS_KEPT = 400_000
#: white space as the Unicode property has it (str.split also takes the four separators below it)
SPACE = "\t-\r \x85\xa0  -     　"
_BLANKS = re.compile(f"[{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbols[b] for b in range(256)]


class Vocabulary:
    """A BPE vocabulary: symbols, merge ranks, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = (
            re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        )
        size = 1 + max([*ids.values(), *self.added.values()])
        self.tokens = np.full(size, "", dtype=object)
        for token, i in [*ids.items(), *self.added.items()]:
            self.tokens[i] = token
        self.size = size
        kinds = _flat(spec.get("normalizer"), "normalizers")
        self.nfc = any(k["type"] == "NFC" for k in kinds)
        self.lower = any(k["type"] == "Lowercase" for k in kinds)
        splits = _flat(spec.get("pre_tokenizer"), "pretokenizers")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.byte_ids = np.array([ids[s] for s in symbols], dtype=np.int64)
        self.last_ids = np.array([ids[s + self.suffix] for s in symbols], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        # a merge may create a pair of a lower rank only if its result is also part of an
        # earlier merge; such ranks are applied to one place of a word at a time
        first_use = np.full(size, len(merges), dtype=np.int64)
        for part in (left, right):
            np.minimum.at(first_use, part, np.arange(len(merges)))
        self.one_by_one = first_use[self.made] < np.arange(len(merges))
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it cannot be merged."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    # -- words to ids ----------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        encoded = [w.encode("utf-8") for w in words]
        lengths = np.array([len(w) for w in encoded], dtype=np.int64)
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        n = len(data)
        ends = np.cumsum(lengths) - 1
        sym = self.byte_ids[data]
        sym[ends] = self.last_ids[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        follow = np.arange(1, n + 1)
        follow[ends] = -1
        before = np.arange(-1, n - 1)
        before[ends - lengths + 1] = -1

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Index the pairs that start at ``places``."""
            rank = self.ranks(sym[places], sym[follow[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(
                rank[np.r_[0, cuts]].tolist(), np.split(places, cuts), strict=True
            ):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(group)

        enter(np.flatnonzero(follow >= 0))
        while queue:
            r = heapq.heappop(queue)
            groups = index.pop(r)
            places = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            a, b = self.left[r], self.right[r]
            after = follow[places]
            good = (sym[places] == a) & (after >= 0)
            good &= sym[after] == b  # after is -1 only where good is already false
            places = places[good]
            if not len(places):
                continue
            if self.one_by_one[r]:
                _, first = np.unique(word[places], return_index=True)
                if len(first) < len(places):
                    index[r] = [np.delete(places, first)]
                    heapq.heappush(queue, r)
                places = places[first]
            elif a == b:
                places = _apart(places, follow)
            after = follow[places]
            beyond = follow[after]
            sym[places] = self.made[r]
            sym[after] = -1
            follow[places] = beyond
            before[beyond[beyond >= 0]] = places[beyond >= 0]
            ahead = before[places]
            new = np.concatenate([ahead[ahead >= 0], places[beyond >= 0]])
            if len(new):
                enter(np.unique(new))
        alive = sym >= 0
        return sym[alive], np.bincount(word[alive], minlength=len(words))

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in the memory; unknown words are encoded first."""
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(fresh) > WORDS_KEPT:
            known.clear()
            self.starts = self.lengths = self.flat = np.zeros(0, dtype=np.int64)
            fresh = list(dict.fromkeys(words))
        if fresh:
            flat, lengths = self._encode_chunks(fresh)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_words`, for pieces between white space, cut by the pattern."""
        parts = list(map(self.pattern.findall, chunks))
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        words = [w for p in parts for w in p]
        if not words:
            return np.zeros(0, dtype=np.int64), counts
        unique = {w: i for i, w in enumerate(dict.fromkeys(words))}
        flat, lengths = self.encode_words(list(unique))
        starts = np.cumsum(lengths) - lengths
        at = np.fromiter(map(unique.__getitem__, words), dtype=np.int64, count=len(words))
        chunk = np.repeat(np.arange(len(chunks)), counts)
        sizes = np.bincount(chunk, weights=lengths[at], minlength=len(chunks)).astype(np.int64)
        return flat[gather(starts[at], lengths[at])], sizes

    # -- texts -----------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """The normalized pieces of a text between white space."""
        if not text.isascii():
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.lower:  # letter by letter: a final sigma is like any other
                text = text.replace("Σ", "σ")
        if self.lower:
            text = text.lower()
        if _SEPARATORS.search(text):
            return [x for x in _BLANKS.split(text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        per_text: list[list[str]] = []
        marked: list[tuple[int, int, int]] = []  # text, chunks before, id of an added token
        for t, text in enumerate(texts):
            if self.added_pattern and "<" in text and self.added_pattern.search(text):
                own: list[str] = []
                for part in self.added_pattern.split(text):
                    if part in self.added:
                        marked.append((t, len(own), self.added[part]))
                    else:
                        own += self.chunks(part)
                per_text.append(own)
            else:
                per_text.append(self.chunks(text))
        counts = np.array([len(p) for p in per_text], dtype=np.int64)
        at = self.places([w for p in per_text for w in p])
        sizes, starts, flat = self.lengths[at], self.starts[at], self.flat
        text_of = np.repeat(np.arange(len(texts)), counts)
        if marked:
            first = np.cumsum(counts) - counts
            spots = np.array([first[t] + k for t, k, _ in marked])
            ids = np.array([i for *_, i in marked], dtype=np.int64)
            starts = np.insert(starts, spots, len(flat) + np.arange(len(ids)))
            sizes = np.insert(sizes, spots, 1)
            text_of = np.insert(text_of, spots, [t for t, *_ in marked])
            flat = np.concatenate([flat, ids])
        lengths = np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)
        return flat[gather(starts, sizes)], lengths

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The tokens of each row, joined as the library does without a decoder."""
        tokens, ends = self.tokens[ids], np.cumsum(lengths).tolist()
        begin = [0, *ends[:-1]]
        return [" ".join(tokens[b:e]) for b, e in zip(begin, ends, strict=True)]


def _flat(node: dict | None, inner: str) -> list[dict]:
    if node is None:
        return []
    return [x for n in node[inner] for x in _flat(n, inner)] if inner in node else [node]


def _apart(places: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Of overlapping places of a pair of equal symbols, every other one from the left."""
    kept: list[int] = []
    taken = -1
    for p in np.sort(places).tolist():
        if p != taken:
            kept.append(p)
            taken = int(follow[p])
    return np.array(kept, dtype=np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker."""
    return Vocabulary(path)


def encode(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """Add column ``ids`` (array of int) with the token ids of column ``text``.

    Null and empty texts get an empty array. Every other column stays; one that is named
    like ``ids`` is replaced. Repeated rows are encoded alike. Nothing is shuffled.
    """
    rest = df.drop(ids)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, lengths = vocabulary(path).encode(texts_of(batch.column(text)))
        return batch.append_column(ids, lists(flat, lengths, pa.int32()))

    return over_batches(rest, _with(rest, ids, "array<int>"), work, text)


def decode(df: DataFrame, ids: str, path: str, text: str = "decoded") -> DataFrame:
    """Add column ``text`` with the decoded form of the token ids; null ids give an empty text."""
    rest = df.drop(text)

    def run(batches):
        for batch in batches:
            column = batch.column(ids)
            lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(column.flatten()).astype(np.int64)
            texts = vocabulary(path).decode(flat, lengths)
            yield batch.append_column(text, pa.array(texts, type=pa.string()))

    return rest.mapInArrow(run, _with(rest, text, "string"))


def digests(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: ``key``, and digests of the ids of ``text`` and of their decoded form.

    Encodes and decodes a batch in one pass, so the ids never leave the worker. Columns:
    the key, ``n_tokens``, ``ids_sha256`` (ids as little-endian 32 bits) and
    ``decoded_sha256`` (UTF-8). Null texts count as empty; null keys and repeated rows
    keep their rows.
    """
    rest = df.select(key, text)
    kind = rest.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = vocabulary(path)
        flat, lengths = words.encode(texts_of(batch.column(text)))
        data = memoryview(flat.astype("<u4").tobytes())
        ends = (4 * np.cumsum(lengths)).tolist()
        of_ids = [_sha(data[b:e]) for b, e in zip([0, *ends[:-1]], ends, strict=True)]
        of_text = [_sha(t.encode("utf-8")) for t in words.decode(flat, lengths)]
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(lengths), pa.array(of_ids), pa.array(of_text)],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return over_batches(rest, schema, work, text)


_sha: Callable[[bytes], str] = lambda data: hashlib.sha256(data).hexdigest()


def _with(df: DataFrame, name: str, kind: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, f"`{name}` {kind}"])
