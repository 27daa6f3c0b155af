"""Packing token streams into fixed windows, in order, by dynamic programming.

Documents follow each other as they lie in the table. A task tokenizes its rows, appends
an end token to each document, and chooses where to cut the stream into windows. Cuts fall
at ends of documents or sentences, and at a higher price between words of long sentences.
The best cuts minimise padding plus penalties for cuts inside a document. With positions
``b`` and costs ``f``, the best start of a window that ends at ``j`` minimises
``f[i] + b[i]`` over a sliding range of ``i``; a monotone queue keeps that minimum, so the
work is linear in the cuts. Windows whose length is a power of two are not padded; these
are looked up directly, one start per power.

The stream is solved over a rolling horizon: all but the last windows of a stretch are
settled, and the rest is solved again with the text that follows. Memory is bounded by the
stretch and one document; nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import gather, in_arrow, sized, texts_of
from .bpe import byte_symbols

WINDOW = 1024
END_ID = 0
#: cost of a cut at the end of a sentence inside a document, in padded tokens
SENTENCE_PENALTY = 4.0
#: cost of a cut between words of a long sentence, and of a cut in a very long word
WORD_PENALTY, FORCED_PENALTY = 12.0, 256.0
#: sentences over this many tokens may be cut between words, about this many tokens apart
LONG_SENTENCE, WORD_STEP = 32, 24
#: cost of a window, so that equal padding prefers fewer windows
WINDOW_COST = 1.0
#: tokens solved at a time, and the tail of them that is solved again
STRETCH, TAIL = 1 << 19, 1 << 13
#: pieces between blanks remembered by a task before its memory starts anew
PIECES_KEPT = 500_000
#: sequence ids count from the partition number times this
IDS_PER_PARTITION = 1 << 36


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary in a ``tokenizers`` JSON file.

    Pieces that begin at a blank or line break are encoded once and remembered; that is
    exact because the split pattern never joins across them. Texts in which blanks touch
    other white space are encoded whole, and texts that name an added token by the
    ``tokenizers`` library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        data = {t: bytes(of_symbol[c] for c in t) for t in vocab if t not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids must follow the order of the merges")
        self.added = list(added)
        self.library = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding(
            "pieces",
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks={d: vocab[t] for t, d in data.items()},
            special_tokens={},
        )
        size = 1 + max([*vocab.values(), *added.values()])
        self.stops = np.zeros(size, dtype=bool)
        self.blanks = np.zeros(size, dtype=bool)
        for token, d in data.items():
            shown = d.decode("utf-8", "replace")
            self.stops[vocab[token]] = shown.endswith((".", "!", "?", "。", "！", "？")) or (
                "\n" in shown
            )
            self.blanks[vocab[token]] = shown[:1].isspace()
        self.known: dict[str, int] = {}
        self._clear()

    def forget(self) -> None:
        """Drop the remembered pieces; the vocabulary stays."""
        self.known = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _remember(self, pieces: list[str]) -> None:
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.known))
        if len(self.known) + len(fresh) > PIECES_KEPT:
            self._clear()
            fresh = list(dict.fromkeys(pieces))
        if not fresh:
            return
        encoded = list(map(self.fast.encode_ordinary, fresh))
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(fresh))
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.known.update(
            zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True)
        )
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        pieces: list[str] = []
        counts: list[int] = []
        whole: dict[int, np.ndarray] = {}
        for t, text in enumerate(texts):
            if any(a in text for a in self.added):
                ids = self.library.encode(text, add_special_tokens=False).ids
                whole[t] = np.array(ids, dtype=np.uint32)
                counts.append(0)
                continue
            own = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
            if not _cuts_are_safe(text):
                whole[t] = self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
                counts.append(0)
                continue
            pieces += own
            counts.append(len(own))
        self._remember(pieces)
        at = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        sizes = self.lengths[at]
        of_text = np.repeat(np.arange(len(texts)), counts)
        lengths = np.bincount(of_text, weights=sizes, minlength=len(texts)).astype(np.int64)
        flat = self.flat[gather(self.starts[at], sizes)]
        if not whole:
            return flat, lengths
        ends = np.cumsum(lengths)
        parts = [
            whole[t] if t in whole else flat[e - n : e]
            for t, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True))
        ]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def _cuts_are_safe(text: str) -> bool:
    """No white space next to a blank or line break, so that pieces encode alone."""
    if "\x00" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    if text.isascii():
        return not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return not any(c.isspace() and c not in " \n" for c in set(text))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The vocabulary of a file, read once per worker."""
    return ByteBpe(path)


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest way to cut ``0 .. cuts[-1]`` into windows that end at ``cuts``.

    ``cuts`` ascend from above 0 and are at most ``window`` apart; ``penalty`` is the cost
    of ending a window at each. Returns the chosen ends. Ties go to the longer window.
    """
    b = np.concatenate([[0], cuts])
    place_of = np.full(int(b[-1]) + 1, -1, dtype=np.int32)
    place_of[b] = np.arange(len(b))
    # all pairs of cuts that are a power of two apart
    hits, origins = [], []
    power = 1
    while power <= window:
        first = int(np.searchsorted(b, power))
        start = place_of[b[first:] - power]
        found = np.flatnonzero(start >= 0)
        hits.append(found + first)
        origins.append(start[found])
        power *= 2
    ends, starts = np.concatenate(hits), np.concatenate(origins)
    order = np.argsort(ends, kind="stable")
    exact_end, exact_start = [*ends[order].tolist(), -1], starts[order].tolist()
    position, cost_of = b.tolist(), [0.0, *(penalty + WINDOW_COST).tolist()]
    best = [0.0] * len(position)
    came = [0] * len(position)
    # the queue: starts whose key best + position may still be the least of a window
    keys, starts_held = [0.0] * len(position), [0] * len(position)
    head, tail = 0, 1
    k = 0
    for j in range(1, len(position)):
        here = position[j]
        oldest = here - window
        while position[starts_held[head]] < oldest:
            head += 1
        start = starts_held[head]
        least = keys[head] - oldest
        while exact_end[k] == j:
            i = exact_start[k]
            if best[i] < least:
                least, start = best[i], i
            k += 1
        least += cost_of[j]
        best[j], came[j] = least, start
        key = least + here
        while tail > head and keys[tail - 1] > key:
            tail -= 1
        keys[tail], starts_held[tail] = key, j
        tail += 1
    chosen = []
    j = len(position) - 1
    while j:
        chosen.append(position[j])
        j = came[j]
    return chosen[::-1]


def possible_cuts(
    ids: np.ndarray, doc_ends: np.ndarray, words: ByteBpe, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Ends of documents and sentences in a stream, at most ``window`` apart, and penalties."""
    n = len(ids)
    cost = np.full(n + 1, -1.0, dtype=np.float32)  # of a cut at each position; -1 is none
    follows_blank = np.append(words.blanks[ids[1:]], True)
    cost[1:][words.stops[ids] & follows_blank] = SENTENCE_PENALTY
    cost[doc_ends] = 0.0
    cost[n] = max(cost[n], 0.0)
    cuts = np.flatnonzero(cost >= 0)
    gaps = np.diff(cuts, prepend=0)
    # between words of long sentences: the last word end of each step of tokens
    spots = np.flatnonzero(follows_blank) + 1
    spots = spots[np.append(np.diff(spots // WORD_STEP) > 0, True)]
    in_long = np.repeat(gaps > LONG_SENTENCE, gaps)
    spots = spots[in_long[spots - 1] & (cost[spots] < 0)]
    cost[spots] = WORD_PENALTY
    cuts = np.flatnonzero(cost >= 0)
    gaps = np.diff(cuts, prepend=0)
    for w in np.flatnonzero(gaps > window).tolist():
        cost[cuts[w] - gaps[w] + window : cuts[w] : window] = FORCED_PENALTY
    cuts = np.flatnonzero(cost >= 0)
    return cuts, cost[cuts].astype(np.float64)


class _Stream:
    """The stream of one task: tokens not yet settled, and the documents they are of."""

    def __init__(self, words: ByteBpe, window: int, emit: Callable, first_id: int) -> None:
        self.words, self.window, self.emit, self.sequence = words, window, emit, first_id
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.keys: list = []  # documents in the held tokens
        self.ends: list[int] = []  # where each ends there; the last is the end of all
        self.totals: list[int] = []
        self.skipped = 0  # tokens of the first document that are already settled

    def add(self, key: object, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.keys.append(key)
        self.ends.append(self.held)
        self.totals.append(len(ids))

    def settle(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Cut the held tokens; keep the tail unless this is the end."""
        if not self.held:
            return
        ids = self.ids[0] if len(self.ids) == 1 else np.concatenate(self.ids)
        doc_ends = np.array(self.ends, dtype=np.int64)
        cuts, penalty = possible_cuts(ids, doc_ends, self.words, self.window)
        chosen = np.array(best_cuts(cuts, penalty, self.window))
        if not last:
            chosen = chosen[chosen <= self.held - TAIL]
            if not len(chosen):
                return
        upto = int(chosen[-1])
        starts = np.unique(np.concatenate([[0], chosen, doc_ends[doc_ends < upto]]))[:-1]
        ends = np.append(starts[1:], upto)
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(chosen, starts, side="right")
        window_start = np.concatenate([[0], chosen[:-1]])[window]
        doc_start = np.concatenate([[0], doc_ends[:-1]])[doc]
        begin = starts - doc_start + np.where(doc == 0, self.skipped, 0)
        filled = np.diff(np.concatenate([[0], chosen]))
        yield self.emit(
            self.keys, doc, begin, ends - starts, np.array(self.totals)[doc],
            self.sequence + window, starts - window_start, filled[window], ids, starts, ends,
        )
        self.sequence += len(chosen)
        done = int(np.searchsorted(doc_ends, upto, side="right"))
        if done < len(self.keys):
            into = upto - (int(doc_ends[done - 1]) if done else 0)
            self.skipped = into + (self.skipped if done == 0 else 0)
        else:
            self.skipped = 0
        self.ids, self.held = [ids[upto:].copy()], self.held - upto
        self.keys, self.totals = self.keys[done:], self.totals[done:]
        self.ends = [e - upto for e in self.ends[done:]]


def pack(
    df: DataFrame, key: str, text: str, path: str, window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """Pieces of documents and the windows they lie in.

    One row per piece: the document's ``key``, ``start`` (its tokens before the piece),
    ``length``, ``doc_tokens`` (with the end token), ``sequence_id``, ``offset`` in the
    window, ``filled`` (tokens in the window), ``padding`` (0 at a power of two) and ``ids``
    (little-endian unsigned 32 bits, as binary). Null and empty texts are a lone end token;
    null keys and repeated rows are packed like others; an empty table gives no rows.
    Windows of different input partitions are never joined, so at most one window per
    partition is short for that reason.
    """
    rest = df.select(key, text)
    kind = rest.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, "
        "offset long, filled long, padding long, ids binary"
    )
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "filled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_bpe(path)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) * IDS_PER_PARTITION
        key_type: list[pa.DataType] = []

        def emit(keys, doc, start, length, total, sequence, offset, filled, ids, begins, ends):
            data = memoryview(ids.astype("<u4").tobytes())
            cut = [data[4 * b : 4 * e].tobytes() for b, e in
                   zip(begins.tolist(), ends.tolist(), strict=True)]
            padded = np.where(filled & (filled - 1) == 0, 0, window - filled)
            numbers = [start, length, total, sequence, offset, filled]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in doc.tolist()], type=key_type[0]),
                    *[pa.array(x.astype(np.int64)) for x in numbers],
                    pa.array(padded.astype(np.int64)),
                    pa.array(cut, type=pa.binary()),
                ],
                [*names, "padding", "ids"],
            )

        stream = _Stream(words, window, emit, first)
        for batch in sized(batches, text, 1_000_000):
            key_type[:] = [batch.schema.field(key).type]
            flat, lengths = words.encode(texts_of(batch.column(text)))
            ends = np.cumsum(lengths).tolist()
            for k, b, e in zip(
                batch.column(key).to_pylist(), [0, *ends[:-1]], ends, strict=True
            ):
                stream.add(k, np.append(flat[b:e], np.uint32(end_id)))
                if stream.held >= STRETCH:
                    yield from stream.settle(last=False)
        yield from stream.settle(last=True)
        words.forget()

    return in_arrow(rest, schema, run)
