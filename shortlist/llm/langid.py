"""Language identification of whole texts and of spans of mixed-language text.

A word is a piece between white space; its letters are scored by hashed letter trigrams
under each learned language. The script of the letters narrows the languages first: a
language that was not learned with a script is no candidate for words in it. A Viterbi
pass over the word scores, with a penalty for each change of language, labels the spans;
the text's language is the one that covers most letters.

The model is counted by Spark over a bounded sample of labelled rows (about ``per_language``
rows of each language, dealt out by a hash of their key); it holds one row of
``BUCKETS`` numbers per language and is small enough to travel with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow, over_batches, sized, texts_of

BUCKETS = 1 << 16
#: rows of each language that the model is fitted on (as a hash of the keys deals them out)
PER_LANGUAGE = 3000
HASH_RANGE = 1 << 32
#: cost of a change of language between two words, in natural logs of likelihood
SWITCH = 9.0
#: a script is one of a language's if this share of its learned letters is in it
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
UNKNOWN = "und"
#: bytes of text labelled at a time
TEXT_BYTES = 3_000_000
WORDS_KEPT = 150_000
#: the log likelihood of a word in a language that is no candidate for it
NO_CANDIDATE = -1e4

#: Where the scripts of Unicode begin that many languages are written in
SCRIPT_STARTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"),
    (0x0B00, "oriya"),
    (0x0B80, "tamil"),
    (0x0C00, "telugu"),
    (0x0C80, "kannada"),
    (0x0D00, "malayalam"),
    (0x0D80, "sinhala"),
    (0x0E00, "thai"),
    (0x0E80, "lao"),
    (0x0F00, "tibetan"),
    (0x1000, "myanmar"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x1780, "khmer"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2C60, "latin"),
    (0x2E80, "han"),
    (0x3040, "kana"),
    (0x3130, "hangul"),
    (0x31F0, "kana"),
    (0x3400, "han"),
    (0xA720, "latin"),
    (0xAC00, "hangul"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB50, "arabic"),
    (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(piece: str) -> str:
    return _NO_LETTERS.sub("", piece).lower()


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words between two end marks each, and the word of each point."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points.astype(np.int64), np.cumsum(points == 2) - 1


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all letter trigrams (with end marks), and the word of each."""
    points, word = _points(words)
    a, b, c = points[:-2], points[1:-1], points[2:]
    whole = word[:-2] == word[2:]
    mixed = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
    mixed = (mixed ^ (mixed >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    return ((mixed ^ (mixed >> 13)) % BUCKETS)[whole], word[:-2][whole]


def scripts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The script of each letter, and the word of each."""
    points, word = _points(words)
    letter = points > 3
    return _SCRIPT[np.searchsorted(_STARTS, points[letter], side="right") - 1], word[letter]


@dataclass
class Model:
    """Log likelihoods of trigrams and the scripts of each language; languages ascend."""

    languages: list[str]
    log_likelihood: np.ndarray  # languages x BUCKETS
    in_script: np.ndarray  # scripts x languages
    most_common: int


def held_out(key: str) -> Column:
    """True for the fold that no model may learn from; null keys are not in it."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 5
    return F.coalesce(fold == 0, F.lit(False))


def fit(docs: DataFrame, text: str, language: str, key: str, rows: Column,
        per_language: int = PER_LANGUAGE) -> Model:
    """Count a model over a bounded sample of the rows for which ``rows`` holds.

    Null texts, languages and keys are not learned from. Of each language the rows are taken
    whose key's hash lies in a share of its range that holds ``per_language`` rows on average
    (all rows, if there are fewer; rows that share a key are taken together). Only counts
    reach the driver: ``BUCKETS`` per language.
    """
    usable = docs.filter(rows & F.col(language).isNotNull() & F.col(key).isNotNull()).select(
        F.col(language).cast("string").alias("_lang"),
        F.xxhash64(F.col(key).cast("string")).alias("_order"),
        F.col(text).cast("string").alias("_text"),
    )
    share = per_language * F.lit(float(HASH_RANGE)) / F.count("*")
    limits = usable.groupBy("_lang").agg(share.alias("_share")).collect()
    last = {r["_lang"]: r["_share"] for r in limits}
    languages = sorted(last)
    number = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((len(SCRIPTS), 0), dtype=bool), 0)
    bounds = F.create_map(*[F.lit(x) for lang in languages for x in (lang, last[lang])])
    place = F.pmod(F.col("_order"), F.lit(HASH_RANGE))
    sample = usable.filter((place < bounds[F.col("_lang")]) & F.col("_text").isNotNull())
    size = BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in sized(batches, "_text", TEXT_BYTES):
            langs, texts = batch.column("_lang").to_pylist(), texts_of(batch.column("_text"))
            for lang in set(langs):
                words = [letters_of(p) for x, t in zip(langs, texts, strict=True) if x == lang
                         for p in t.split()]
                own = found.setdefault(number[lang], np.zeros(size, dtype=np.int64))
                words = [w for w in words if w]
                if words:
                    own[:BUCKETS] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(scripts(words)[0], minlength=len(SCRIPTS))
        for lang, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang)), pa.array(at), pa.array(own[at])],
                ["lang", "slot", "n"],
            )

    counted = in_arrow(sample.select("_lang", "_text"), "lang long, slot long, n long", count)
    rows_of = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), size))
    counts[rows_of["lang"].to_numpy(), rows_of["slot"].to_numpy()] = rows_of["n"].to_numpy()
    grams, letters = counts[:, :BUCKETS], counts[:, BUCKETS:]
    likely = np.log(grams + SMOOTHING) - np.log(
        grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
    )
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(languages, likely, (share >= SCRIPT_SHARE).T, int(letters.sum(axis=1).argmax()))


class Scorer:
    """Word scores under a model, remembered for words met before in the task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)
        self.open = np.zeros(0, dtype=bool)

    def places(self, pieces: list[str]) -> np.ndarray:
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.known))
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self._clear()
            fresh = list(dict.fromkeys(pieces))
        if fresh:
            scores, letters, candidates = self._score([letters_of(p) for p in fresh])
            start = len(self.known)
            self.known.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, letters])
            self.open = np.concatenate([self.open, candidates])
        return np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihoods, letters, and whether any language is a candidate, for each word."""
        n, model = len(words), self.model
        buckets, word = trigrams(words)
        scores = np.stack(
            [np.bincount(word, weights=own[buckets], minlength=n) for own in model.log_likelihood],
            axis=1,
        )
        script, word = scripts(words)
        letters = np.bincount(word, minlength=n)
        for i in range(len(model.languages)):
            foreign = np.bincount(word, weights=~model.in_script[script, i], minlength=n)
            scores[foreign * 2 > letters, i] = NO_CANDIDATE
        candidates = (scores > NO_CANDIDATE).any(axis=1) & (letters > 0)
        scores[~candidates] = 0.0
        return scores.astype(np.float32), letters, candidates


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word of each text, changes costing ``switch``.

    ``scores`` has a row per word, text after text. All texts advance together, one word
    at a time; ties keep the language, then take the first one.
    """
    total, states = scores.shape
    labels = np.zeros(total, dtype=np.int16)
    if not total or states == 1:
        return labels
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    switched = np.zeros((total, states), dtype=bool)
    leader = np.zeros(total, dtype=np.int16)
    k = int(active[0])
    best = scores[starts[:k]].astype(np.float64)
    final = np.zeros(len(sizes), dtype=np.int16)
    for t in range(1, steps):
        more = int(active[t])
        if more < k:
            final[more:k] = best[more:k].argmax(axis=1)
            best, k = best[:more], more
        at = starts[:k] + t
        top = best.argmax(axis=1)
        bar = best[np.arange(k), top][:, None] - switch
        change = best < bar
        switched[at], leader[at] = change, top
        best = np.where(change, bar, best) + scores[at]
    final[:k] = best.argmax(axis=1)
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        k = int(active[t])
        at = starts[:k] + t
        labels[at] = state[:k]
        if t:
            came = switched[at, state[:k]]
            state[:k] = np.where(came, leader[at], state[:k])
    return labels


def predict(df: DataFrame, text: str, model: Model, spans: bool = True) -> DataFrame:
    """Add ``lang_pred``, ``score`` and (if asked) ``lang_spans`` to every row.

    ``lang_pred`` covers most letters, ties going to the first in order; ``score`` is its
    share of all letters. A null or empty text, or one without a letter, gets ``und`` and
    score 0; so does every text if nothing was learned. Letters of scripts that no language
    was learned with count for none; a text of only such letters gets the most common
    language with score 0. ``lang_spans`` lists runs of words of one language as
    (first word, word after the last, language), words being pieces between white space.
    Other columns stay; those with these names are replaced. Nothing is shuffled.
    """
    rest = df.drop("lang_pred", "score", "lang_spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields]
    fields += ["lang_pred string", "score double"]
    if spans:
        fields.append("lang_spans array<struct<first:int,last:int,lang:string>>")
    scorers: list[Scorer] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scorers:
            scorers.append(Scorer(model))
        texts = texts_of(batch.column(text))
        names, shares, runs = label(texts, scorers[0], spans)
        out = batch.append_column("lang_pred", pa.array(names, type=pa.string()))
        out = out.append_column("score", pa.array(shares, type=pa.float64()))
        if spans:
            kind = pa.list_(
                pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])
            )
            out = out.append_column("lang_spans", pa.array(runs, type=kind))
        return out

    return over_batches(rest, ", ".join(fields), work, text, TEXT_BYTES)


def label(texts: list[str], scorer: Scorer, spans: bool) -> tuple[list[str], list[float], list]:
    """Language, score and spans of each text."""
    model = scorer.model
    pieces = [t.split() for t in texts]
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    at = scorer.places([w for p in pieces for w in p])
    labels = viterbi(scorer.scores[at], lengths)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    letters = scorer.letters[at]
    counted = np.where(scorer.open[at], letters, 0)
    n = len(model.languages)
    covered = np.bincount(text_of * n + labels, weights=counted, minlength=len(texts) * n)
    covered = covered.reshape(len(texts), n)
    total = np.bincount(text_of, weights=letters, minlength=len(texts))
    winner = np.where(covered.sum(axis=1) > 0, covered.argmax(axis=1), model.most_common)
    names = [model.languages[w] if t else UNKNOWN
             for w, t in zip(winner.tolist(), total.tolist(), strict=True)]
    shares = (covered[np.arange(len(texts)), winner] / np.maximum(total, 1)).tolist()
    runs: list = []
    if spans:
        ends = np.cumsum(lengths).tolist()
        for b, e in zip([0, *ends[:-1]], ends, strict=True):
            own = labels[b:e]
            cuts = np.flatnonzero(np.diff(own)) + 1
            first = [0, *cuts.tolist()] if e > b else []
            last = [*cuts.tolist(), e - b] if e > b else []
            runs.append(
                [{"first": f, "last": z, "lang": model.languages[own[f]]}
                 for f, z in zip(first, last, strict=True)]
            )
    return names, shares, runs
