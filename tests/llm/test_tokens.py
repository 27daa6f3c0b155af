"""BPE encoding and packing against the tokenizers library and brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from tests.llm.frames import ODD_TEXTS, documents, words

from shortlist.llm import bpe, packing
from shortlist.llm.queries import PACKING_VOCABULARY, WORD_VOCABULARY, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer_path(name))


def test_encode_equals_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(0, "again"), (None, "no id")]
    docs = documents(spark, rows)
    path = tokenizer_path(WORD_VOCABULARY)
    tool = library(WORD_VOCABULARY)
    got = bpe.decode(bpe.encode(docs, "text", path), "ids", path).collect()
    assert len(got) == len(rows)
    for row in got:
        ids = tool.encode(row.text or "", add_special_tokens=False).ids
        assert list(row.ids) == ids
        assert row.decoded == tool.decode(ids, skip_special_tokens=False)


def test_digests(spark):
    path, tool = tokenizer_path(WORD_VOCABULARY), library(WORD_VOCABULARY)
    docs = documents(spark, list(enumerate(ODD_TEXTS)))
    for row in bpe.digests(docs, "doc_id", "text", path).collect():
        ids = tool.encode(ODD_TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        data = struct.pack(f"<{len(ids)}I", *ids)
        assert row.ids_sha256 == hashlib.sha256(data).hexdigest()
        text = tool.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_memory_that_starts_anew_changes_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 40)) for _ in range(30)]
    whole = bpe.Vocabulary(tokenizer_path(WORD_VOCABULARY)).encode(texts)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 10)
    small = bpe.Vocabulary(tokenizer_path(WORD_VOCABULARY))
    for k in range(0, 30, 5):
        ids, lengths = small.encode(texts[k : k + 5])
        begin = whole[1][:k].sum()
        assert ids.tolist() == whole[0][begin : begin + lengths.sum()].tolist()


def test_a_rank_that_creates_lower_ones_is_applied_place_by_place(tmp_path):
    # "ab" is made by merge 2 but used by merge 1, so later places must wait
    import json

    symbols = bpe.byte_symbols()
    vocab = {s: i for i, s in enumerate(symbols)}
    vocab |= {s + "</w>": 256 + i for i, s in enumerate(symbols)}
    merges = [["b", "c"], ["ab", "ab"], ["a", "b"], ["c", "ab"]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    for name in ("ab", "bc"):
        vocab.setdefault(name, len(vocab))
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [],
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "[^\\s]+"}, "behavior": "Removed",
             "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
             "use_regex": False}]},
        "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None,
                  "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
                  "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": merges},
    }
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    own, tool = bpe.Vocabulary(str(path)), tokenizers.Tokenizer.from_file(str(path))
    assert own.one_by_one.any()
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        assert own.encode([text])[0].tolist() == tool.encode(text).ids


def test_packing_covers_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    tool = library(PACKING_VOCABULARY)
    pieces = packing.pack(documents(spark, rows), "doc_id", "text",
                          tokenizer_path(PACKING_VOCABULARY)).collect()
    windows = {}
    for i, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        got = b"".join(bytes(p.ids) for p in own)
        assert got == struct.pack(f"<{len(ids)}I", *ids)
        at = 0
        for p in own:
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            at += p.length
            windows.setdefault(p.sequence_id, []).append(p)
    for parts in windows.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].filled <= 1024
        power = at & (at - 1) == 0
        assert parts[0].padding == (0 if power else 1024 - at)


def test_packing_odd_rows(spark):
    path = tokenizer_path(PACKING_VOCABULARY)
    assert packing.pack(documents(spark, []), "doc_id", "text", path).count() == 0
    docs = documents(spark, [(None, "a b"), (7, "same"), (7, "same")]).coalesce(1)
    pieces = packing.pack(docs, "doc_id", "text", path).collect()
    assert sorted(p.doc_id is None for p in pieces) == [False, False, True]
    assert zlib.crc32(bytes(pieces[1].ids)) == zlib.crc32(bytes(pieces[2].ids))


def _cheapest(cuts, penalty, window):
    best = {0: 0.0}
    for end, cost in zip(cuts, penalty, strict=True):
        options = []
        for start, so_far in best.items():
            size = end - start
            if 0 < size <= window:
                padding = 0 if size & (size - 1) == 0 else window - size
                options.append(so_far + padding + cost + packing.WINDOW_COST)
        best[end] = min(options)
    return best[cuts[-1]]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        cuts = np.cumsum(rng.integers(1, 20, size=rng.integers(1, 40)))
        penalty = rng.choice([0.0, 4.0, 12.0], size=len(cuts))
        chosen = packing.best_cuts(cuts, penalty, 32)
        assert chosen[-1] == cuts[-1] and set(chosen) <= set(cuts.tolist())
        cost_of = dict(zip(cuts.tolist(), penalty.tolist(), strict=True))
        total, start = 0.0, 0
        for end in chosen:
            size = end - start
            total += (0 if size & (size - 1) == 0 else 32 - size) + cost_of[end]
            total += packing.WINDOW_COST
            start = end
        assert total == pytest.approx(_cheapest(cuts.tolist(), penalty.tolist(), 32))


def test_settling_in_stretches_loses_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words_of = packing.byte_bpe(tokenizer_path(PACKING_VOCABULARY))
    monkeypatch.setattr(packing, "TAIL", 2048)
    seen = []

    def emit(keys, doc, start, length, total, sequence, offset, filled, ids, begins, ends):
        seen.extend(zip([keys[d] for d in doc], start.tolist(), length.tolist(), strict=True))

    stream = packing._Stream(words_of, 1024, emit, 0)
    sizes = {}
    for k in range(40):
        ids = words_of.encode([". ".join(words(rng, 300))])[0]
        sizes[k] = len(ids)
        stream.add(k, ids)
        if stream.held > 8000:
            list(stream.settle(last=False))
    list(stream.settle(last=True))
    for k, size in sizes.items():
        at = 0
        for _, start, length in sorted(s for s in seen if s[0] == k):
            assert start == at
            at += length
        assert at == size
