"""Text columns: tokens, documents as labelled paragraphs, rerank inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D

# A word is a run of letters, digits and underscores of any script. Java's \w is
# ASCII-only and would split accented words.
WORD_PATTERN = r"([\p{L}\p{N}_]+)"
# Everything that counts as white space in Unicode, not just the ASCII part.
SPACE_CLASS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
NON_SPACE_PATTERN = f"([^{SPACE_CLASS}]+)"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_text(text: Column) -> Column:
    return F.lower(text)


def split_words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.regexp_extract_all(text, F.lit(NON_SPACE_PATTERN), F.lit(1))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_SPACE_PATTERN)


def default_stopwords() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def tokenize(
    text: Column,
    stopwords: Iterable[str] | None = None,
    extra_stopwords: Iterable[str] = (),
) -> Column:
    """Lower-cased word tokens of ``text`` as an array.

    Stop words are matched against the white-space separated words *before* the word
    pattern is applied: ``the,`` is not a stop word and later yields ``the``.
    """
    lowered = normalize_text(or_empty(text))
    dropped = sorted({*(stopwords or ()), *extra_stopwords})
    if dropped:
        kept = F.filter(split_words(lowered), lambda word: ~word.isin(dropped))
        lowered = F.array_join(kept, " ")
    return F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(1))


def paragraph(text: Column, label: int) -> Column:
    return F.struct(or_empty(text).alias("text"), F.lit(label).cast("int").alias("ptype"))


def paper_paragraphs(
    title: Column,
    abstract: Column,
    title_label: int = D.TITLE_LABEL,
    abstract_label: int = D.ABSTRACT_LABEL,
) -> Column:
    return F.array(paragraph(title, title_label), paragraph(abstract, abstract_label))


def query_paragraphs(
    title: Column,
    abstract: Column,
    context: Column,
    title_label: int = D.TITLE_LABEL,
    abstract_label: int = D.ABSTRACT_LABEL,
    context_label: int = D.CONTEXT_LABEL,
) -> Column:
    """The citing paper's paragraphs followed by the local context."""
    return F.concat(
        paper_paragraphs(title, abstract, title_label, abstract_label),
        F.array(paragraph(context, context_label)),
    )


def pad_paragraphs(
    document: Column,
    max_doc_len: int = D.MAX_DOC_LEN,
    padding_label: int = D.PADDING_LABEL,
) -> Column:
    """Exactly ``max_doc_len`` paragraphs, each marked as empty or not."""
    padding = F.array_repeat(paragraph(F.lit(""), padding_label), max_doc_len)
    return F.transform(
        F.slice(F.concat(document, padding), 1, max_doc_len),
        lambda p: F.struct(
            p["text"].alias("text"),
            p["ptype"].alias("ptype"),
            is_blank(p["text"]).alias("is_empty"),
        ),
    )


def document_text(document: Column) -> Column:
    """Paragraph texts joined by one space; empty ones keep their place."""
    return F.array_join(F.transform(document, lambda p: or_empty(p["text"])), " ")


def candidate_text(title: Column, abstract: Column) -> Column:
    return F.concat(or_empty(title), F.lit(" "), or_empty(abstract))


def mask_citation(text: Column, cit_token: str = D.CIT_TOKEN) -> Column:
    return F.replace(text, F.lit(D.TARGET_MARK), F.lit(cit_token))


def rerank_query_text(
    title: Column,
    abstract: Column,
    context: Column,
    max_input_length: int = D.MAX_INPUT_LENGTH,
    mask: bool = True,
    sep_token: str = D.SEP_TOKEN,
) -> Column:
    """The first words of the citing paper, a separator, and the local context."""
    n_words = int(max_input_length * D.QUERY_SHARE)
    citing = F.slice(split_words(candidate_text(title, abstract)), 1, n_words)
    local = or_empty(context)
    if mask:
        local = mask_citation(local)
    return F.concat(F.array_join(citing, " "), F.lit(sep_token), local)


def pad_sequence(seq: Column, max_len: int, pad_index: Column | int) -> Column:
    pad = pad_index if isinstance(pad_index, Column) else F.lit(pad_index)
    missing = F.greatest(F.lit(max_len) - F.size(seq), F.lit(0))
    return F.concat(F.slice(seq, 1, max_len), F.array_repeat(pad, missing))

