"""Secret scanning with a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query of trigrams is derived: every match must contain all
trigrams of at least one clause. The index lists, for each trigram that some query names, the
rows that contain it (letter case ignored). Intersecting the postings of a clause gives the
candidates of its rule; only those are searched with the pattern. A rule without a mandatory
trigram searches every row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import free_name, materialize, row_key

#: candidates are copied to the executors up to this many rows (16 bytes each)
COPIED_CANDIDATES = 1_000_000
#: the most strings followed through a pattern, and members of a class that is spelt out
MOST_STRINGS, MOST_MEMBERS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters.

    Patterns are in the syntax that Java and Python share. Matches are taken from the left
    without overlap; those that are too short are dropped after that.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules of the contract, in the order of their kinds
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Published formats of credentials
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


# -- from a pattern to its trigrams ----------------------------------------------------------

Clause = frozenset  # of trigrams that must all be there
Query = frozenset  # of clauses, of which one must hold; an empty clause always holds

ALWAYS: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _least(query: Query) -> Query:
    """Without clauses that ask for more than another one."""
    kept = frozenset(c for c in query if not any(o < c for o in query))
    return kept if len(kept) <= 4 * MOST_STRINGS else ALWAYS


def _of_strings(strings: frozenset[str]) -> Query:
    return _least(
        frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    )


def _members(items: list) -> frozenset[str] | None:
    """The characters of a class, lower-cased; None if they are many."""
    found: set[str] = set()
    for what, value in items:
        if what is sre.LITERAL:
            found.add(chr(value).lower())
        elif what is sre.RANGE and value[1] - value[0] < MOST_MEMBERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= MOST_MEMBERS else None


def _walk(nodes: list) -> tuple[frozenset[str] | None, Query]:
    """The strings that a pattern can match if they are few, and its query otherwise."""
    query: Query = ALWAYS
    strings: frozenset[str] = frozenset([""])
    exact = True

    def cut() -> None:
        nonlocal query, strings, exact
        query, strings, exact = _both(query, _of_strings(strings)), frozenset([""]), False

    for what, value in nodes:
        own: frozenset[str] | None = None
        asked: Query = ALWAYS
        if what is sre.LITERAL:
            own = frozenset([chr(value).lower()])
        elif what is sre.IN:
            own = _members(value)
        elif what is sre.SUBPATTERN:
            own, asked = _walk(list(value[-1]))
        elif what is sre.BRANCH:
            parts = [_walk(list(p)) for p in value[1]]
            if all(s is not None for s, _ in parts):
                own = frozenset().union(*[s for s, _ in parts])
            else:
                asked = _least(
                    frozenset().union(*[q if s is None else _of_strings(s) for s, q in parts])
                )
        elif what in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            once, inside = _walk(list(inner))
            if once is not None and high == 1:
                own = once | {""} if low == 0 else once
            elif once is not None and low == high and low * len(once) <= 8:
                own = reduce(lambda a, _: frozenset(x + y for x in a for y in once), range(low),
                             frozenset([""]))
            elif low:
                asked = inside if once is None else _of_strings(once)
        elif what is sre.AT:
            own = frozenset([""])
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in own)
        elif own is not None:
            cut()
            strings = own
        else:
            cut()
            query = _both(query, asked)
    if exact:
        return strings, ALWAYS
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """The clauses of lower-case trigrams of which every match contains one whole clause.

    The only clause is empty if the pattern has no mandatory trigram.
    """
    strings, query = _walk(list(parser.parse(pattern)))
    query = query if strings is None else _of_strings(strings)
    return ALWAYS if frozenset() in query else query


# -- index and candidates --------------------------------------------------------------------


def build_index(df: DataFrame, key: str, text: str, trigrams: Sequence[str]) -> DataFrame:
    """Postings (``trigram``, ``key``) of the given trigrams, letter case ignored."""
    # lower-cased in a step of its own, or every trigram would do it again
    rows = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
    found = F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams])
    return rows.select(F.explode(F.array_compact(found)).alias("trigram"), "key")


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per key, the rules (as bits) of which one clause's postings all hold it.

    The clauses are a small constant table. All postings of a row come from one task, so
    the sums are partial there and one short row per key and clause is shuffled.
    """
    entries = []
    sizes = []
    for number, rule in enumerate(rules):
        for clause in sorted(map(sorted, trigram_query(rule.pattern))):
            for bit, t in enumerate(clause):
                entries.append((t, len(sizes), bit, number, (1 << len(clause)) - 1))
            sizes.append(len(clause))
    schema = "trigram string, clause int, bit int, rule int, whole long"
    clauses = postings.sparkSession.createDataFrame(entries, schema)
    met = postings.join(F.broadcast(clauses), "trigram")
    seen = met.groupBy("key", "clause", "rule", "whole").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("seen")
    )
    held = seen.filter("seen = whole")
    return held.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of a rule's matches: start, order of the kind, end (code points), kind.

    The text is taken apart at the matches; running sums of the lengths of what lies between
    and of the matches give their places.
    """
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, 0)
    asked = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, rule.group)
    sizes = F.zip_with(
        F.transform(between, F.length),
        F.zip_with(F.transform(matches, F.length), F.transform(asked, F.length),
                   lambda m, a: F.struct(m.alias("m"), a.alias("a"))),
        lambda b, pair: F.struct(b.alias("before"), pair.m.alias("size"), pair.a.alias("asked")),
    )
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def step(so_far: Column, x: Column) -> Column:
        start = so_far.place + F.coalesce(x.before, F.lit(0))
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        longer = F.concat(so_far.spans, F.array(span))
        return F.struct(
            end.alias("place"),
            F.when(x.asked >= rule.least, longer).otherwise(so_far.spans).alias("spans"),
        )

    begin = F.struct(F.lit(0).alias("place"), none.alias("spans"))
    return F.aggregate(sizes, begin, step, lambda so_far: so_far.spans)


def scan(df: DataFrame, text: str, rules: Sequence[Rule], spans: str = "spans") -> DataFrame:
    """Add array ``spans`` of all secrets in each row's text, by start, then order of the rules.

    Null and empty texts have no spans. Texts are searched whole, and repeated rows get the
    same spans. Other columns stay; one named like ``spans`` is replaced. Rows are matched
    to their candidate entries by a hash of the text; equal hashes only cause a search that
    finds nothing. Candidates up to ``COPIED_CANDIDATES`` are copied to the executors and the
    texts stay where they are; beyond that the texts are shuffled once by that hash.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for c in q for t in c})
    rows = df.drop(spans)
    whole, hashed, of, bits = (free_name(rows, n) for n in ("_text", "_hash", "_of", "_rules"))
    rows = rows.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn(hashed, row_key(whole))
    indexed = [r for r, q in zip(rules, queries, strict=True) if q != ALWAYS]
    if indexed:
        postings = build_index(rows, hashed, whole, trigrams)
        wanted = materialize(candidates(postings, indexed), "secret-candidates")
        small = wanted.count() <= COPIED_CANDIDATES
        wanted = wanted.toDF(of, bits)
        rows = rows.join(
            F.broadcast(wanted) if small else wanted, F.col(hashed) == F.col(of), "left"
        )
    kind = "array<struct<start:int,ord:int,end:int,kind:string>>"
    found = []
    for order, rule in enumerate(rules):
        if rule in indexed:
            bit = 1 << indexed.index(rule)
            searched = F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit) != 0
        else:
            searched = F.col(whole).rlike(rule.pattern)
        own = spans_of(F.col(whole), rule, order)
        found.append(F.when(searched, own).otherwise(F.array().cast(kind)))
    every = F.array_sort(F.concat(*found))
    return rows.withColumn(spans, every).drop(whole, hashed, of, bits)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""

    def step(so_far: Column, s: Column) -> Column:
        fresh = s.start >= so_far.place
        piece = F.concat(
            so_far.text, F.substring(text, so_far.place + 1, s.start - so_far.place), F.lit(mark)
        )
        return F.struct(
            F.greatest(so_far.place, s.end).alias("place"),
            F.when(fresh, piece).otherwise(so_far.text).alias("text"),
        )

    begin = F.struct(F.lit(0).alias("place"), F.lit("").alias("text"))
    rebuilt = F.aggregate(
        spans, begin, step,
        lambda a: F.concat(a.text, F.substring(text, a.place + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)


def duckdb_spans(rules: Sequence[Rule]) -> str:
    """A DuckDB query (``rid``, ``ord``, ``kind``, ``s``, ``e``) over table ``d`` (``rid``, ``t``)."""
    parts = []
    for order, rule in enumerate(rules):
        p = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT rid, {order} AS ord, '{rule.kind}' AS kind,
       list_sum(list_transform(between[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
       s + length(m[i]) AS e
FROM (SELECT rid, m, between, g, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m,
                   regexp_extract_all(t, '{p}', {rule.group}) AS g,
                   string_split_regex(t, '{p}') AS between
            FROM d WHERE regexp_matches(t, '{p}')))
WHERE length(g[i]) >= {rule.least}"""
        )
    return "\nUNION ALL\n".join(parts)


__all__ = [
    "ADDED_RULES",
    "BASE_RULES",
    "Rule",
    "build_index",
    "candidates",
    "duckdb_spans",
    "listed",
    "masked",
    "scan",
    "trigram_query",
]
