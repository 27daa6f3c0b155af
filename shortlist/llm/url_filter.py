"""URL filtering by rules and, where none fits, by character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give the
probability of each byte after its last ``ORDER`` bytes; each order is smoothed towards the
next shorter one. A URL is judged by the difference of its log likelihoods per byte against
a threshold calibrated on labelled URLs that the models were not counted on.

The labels come from the rules: a URL that a rule allows is accepted, one that it blocks is
rejected. The counts of all orders follow from those of the ``GRAM``, a byte with the bytes
before it, which are kept exactly in a Spark table, however many there are. A gram's part of a
score is the same wherever it stands, so each gram is worked out once. The most frequent ones
travel with the tasks (``COPIED`` at most); the others are joined to the URLs that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann_forest import content_key
from .batches import free_name, materialize, sized, texts_of

#: bytes of context, and weight of the shorter order
ORDER, BACK_OFF = 5, 4.0
#: bytes of a gram, which fit a long
GRAM = ORDER + 1
#: grams that travel with the tasks at most; all others are rarer than one in so many
COPIED = 1 << 20
#: one of this many labelled URLs is kept from the counts and calibrates the threshold
FOLDS = 5
#: width of the bins of the scores that calibrate, and their range (a score is a mean of logs)
BIN, REACH = 0.005, 4000
URL_BYTES = 200_000
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with the verdict of the URLs it fits."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        """The host or a subdomain of it, and a path that begins like the rule's."""
        name, slash, rest = self.text.partition("/")
        here = (host == name) | host.endswith("." + name)
        return here & path.startswith(slash + rest)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (the last of equally long ones); null without."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


# -- models ------------------------------------------------------------------------------


def _grams(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte, the last byte lowest, and whose it is.

    Each URL is read from its first byte to an end mark; grams reach back to before its start.
    """
    encoded = [u.encode("utf-8", "surrogatepass") for u in urls]
    data = b"".join(bytes(ORDER) + e + b"\x01" for e in encoded)
    symbols = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(e) + 1 for e in encoded], dtype=np.int64)
    url = np.repeat(np.arange(len(urls)), lengths)
    at = np.arange(len(url)) + ORDER * (url + 1)
    grams = np.zeros(len(at), dtype=np.int64)
    for k in range(GRAM):
        grams |= symbols[at - k] << (8 * k)
    return grams, url


def _counts(df: DataFrame) -> DataFrame:
    """Per gram of ``_url`` its number in accepted, in rejected and in all rows (by ``_ok``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "_url", URL_BYTES):
            grams, url = _grams(texts_of(batch.column("_url")))
            labels = np.array([-1 if g is None else int(g) for g in batch.column("_ok").to_pylist()])
            found, at = np.unique(grams, return_inverse=True)
            sums = [np.bincount(at[labels[url] == x], minlength=len(found)) for x in (1, 0)]
            sums.append(np.bincount(at, minlength=len(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), *[pa.array(x) for x in sums]],
                ["gram", "accepted", "rejected", "n"],
            )

    return _summed(df.mapInArrow(count, "gram long, accepted long, rejected long, n long"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", "n")])


def _last(gram: str, n: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def _ratios(counts: DataFrame) -> DataFrame:
    """``gram``, ``n`` and ``ratio``, the difference of the two models' logs.

    Grams that end alike are summed to the counts of each order. No key has more than 256
    rows in the window, nor in the join with the next shorter order.
    """
    known: DataFrame | None = None
    for k in range(GRAM):
        sums = [F.sum(c).alias(c) for c in ("accepted", "rejected", "n")]
        context = Window.partitionBy(F.shiftright("_g", 8))
        here = counts.groupBy(_last("gram", k + 1).alias("_g")).agg(*sums)
        here = here.select(
            "*", F.sum("accepted").over(context).alias("_a"), F.sum("rejected").over(context).alias("_r")
        )
        if known is None:
            here = here.withColumns({"_pa": F.lit(1 / 257), "_pr": F.lit(1 / 257)})
        else:
            shorter = known.select(F.col("_g").alias("_s"), "_pa", "_pr")
            here = here.withColumn("_s", _last("_g", k)).join(shorter, "_s")
        known = here.select("_g", "n", *[
            ((F.col(n) + BACK_OFF * F.col(p)) / (F.col(all_n) + BACK_OFF)).alias(p)
            for n, all_n, p in (("accepted", "_a", "_pa"), ("rejected", "_r", "_pr"))
        ])
    logs = [F.log(p) for p in ("_pa", "_pr")]  # never 0
    return known.select(F.col("_g").alias("gram"), "n", (logs[0] - logs[1]).alias("ratio"))


class Scorer:
    """Scores of the URLs whose grams were counted, column ``_url`` of ``urls``."""

    def __init__(self, counts: DataFrame, urls: DataFrame) -> None:
        ratios = materialize(_ratios(counts), "url-ratios")
        total = ratios.agg(F.count("*").alias("grams"), F.sum("n").alias("n")).first()
        least = total["n"] / COPIED if total["grams"] > COPIED else 0
        often = ratios.filter(F.col("n") >= least).select("gram", "ratio").toArrow()
        order = np.argsort(often["gram"].to_numpy())
        self.grams = often["gram"].to_numpy()[order]
        self.ratios = often["ratio"].to_numpy()[order]
        self.rest: DataFrame | None = None
        if least:
            rare = self._rare(urls).join(ratios.filter(F.col("n") < least), "gram")
            sums = rare.groupBy("_h1", "_h2").agg(F.sum(F.col("_n") * F.col("ratio")).alias("_rest"))
            self.rest = materialize(sums, "url-rest")

    def __getstate__(self) -> dict:
        return {"grams": self.grams, "ratios": self.ratios, "rest": None}

    def _find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each gram stands among the copied ones, and whether it does."""
        if not len(self.grams):
            return np.zeros(len(grams), dtype=np.int64), np.zeros(len(grams), dtype=bool)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return at, self.grams[at] == grams

    def _rare(self, urls: DataFrame) -> DataFrame:
        """The grams that are not copied, with their number, of each different URL."""
        different = urls.select("_url", *content_key("_url")).dropDuplicates(["_h1", "_h2"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sized(batches, "_url", URL_BYTES):
                grams, url = _grams(texts_of(batch.column("_url")))
                rare = ~self._find(grams)[1]
                pairs, n = np.unique(np.stack([url[rare], grams[rare]]), axis=1, return_counts=True)
                keys = [batch.column(c).take(pa.array(pairs[0])) for c in ("_h1", "_h2")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(pairs[1]), pa.array(n)], ["_h1", "_h2", "gram", "_n"]
                )

        return different.mapInArrow(cut, "_h1 long, _h2 long, gram long, _n long")

    def with_rest(self, df: DataFrame, url: str, name: str) -> DataFrame:
        """Add what the grams that are not copied give to the sum of each row's URL."""
        if self.rest is None:
            return df.withColumn(name, F.lit(0.0))
        one, two = free_name(df, "_one"), free_name(df, "_two")
        found = self.rest.toDF(one, two, name)
        keyed = df.select("*", *[k.alias(n) for k, n in zip(content_key(url), (one, two), strict=True)])
        joined = keyed.join(found, [one, two], "left").drop(one, two)
        return joined.withColumn(name, F.coalesce(name, F.lit(0.0)))

    def scores(self, urls: Sequence[str], rest: np.ndarray) -> np.ndarray:
        """Difference of the log likelihoods per byte; above 0 looks accepted."""
        if not len(urls):
            return np.zeros(0)
        grams, url = _grams(urls)
        at, known = self._find(grams)
        values = np.zeros(len(grams))
        values[known] = self.ratios[at[known]]
        sums = np.bincount(url, weights=values, minlength=len(urls)) + rest
        return sums / np.bincount(url, minlength=len(urls))


@dataclass
class Judge:
    """Counts of the grams, scores of the URLs they are of, and the least score allowed."""

    counts: DataFrame
    scorer: Scorer
    threshold: float = 0.0

    def scores(self, urls: Sequence[str]) -> np.ndarray:
        """Scores of a few URLs, also of ones that the table does not hold."""
        spark = self.counts.sparkSession
        rows = spark.createDataFrame([(u, None) for u in urls], "_url string, _ok boolean")
        scorer = Scorer(_summed(self.counts.union(_counts(rows))), rows)
        found = {r["_url"]: r["_rest"] for r in scorer.with_rest(rows, "_url", "_rest").collect()}
        return scorer.scores(urls, np.array([found[u] for u in urls]))


def fit(df: DataFrame, text: Column, verdict: Column) -> Judge:
    """Count both models on labelled rows and calibrate the threshold on the rest of them.

    ``verdict`` is allow or block, null for rows without label. The driver receives at most
    ``COPIED`` grams and the counts of the score bins. Without accepted or rejected rows the
    threshold is 0, and so is every score's evidence of that class.
    """
    rows = df.select(text.alias("_url"), (verdict == ALLOW).alias("_ok"))
    held = F.pmod(F.xxhash64("_url"), F.lit(FOLDS)) == 0
    counts = materialize(_counts(rows.select("_url", F.when(~held, F.col("_ok")).alias("_ok"))), "url-grams")
    scorer = Scorer(counts, rows)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "_url", URL_BYTES):
            scores = scorer.scores(texts_of(batch.column("_url")), batch.column("_rest").to_numpy())
            at = np.clip(np.floor(scores / BIN), -REACH, REACH).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), batch.column("_ok")], ["bin", "ok"]
            )

    counted = (
        scorer.with_rest(rows.filter(held & F.col("_ok").isNotNull()), "_url", "_rest")
        .mapInArrow(bins, "bin long, ok boolean")
        .groupBy("bin", "ok")
        .count()
        .collect()
    )
    threshold = _threshold([(r["bin"], r["ok"], r["count"]) for r in counted])
    return Judge(counts, scorer, threshold)


def _threshold(counted: list[tuple[int, bool, int]]) -> float:
    """The score that best parts accepted from rejected, both classes weighing the same.

    Among equally good ones the middle of the range nearest to 0; 0 if a class is missing.
    """
    totals = {label: sum(n for _, ok, n in counted if ok == label) for label in (True, False)}
    if not totals[True] or not totals[False]:
        return 0.0
    change = np.zeros(2 * REACH + 3)  # of the error, when the threshold passes a bin
    for at, ok, n in counted:
        change[at + REACH + 1] += n / totals[True] if ok else -n / totals[False]
    errors = 1.0 + np.cumsum(change)  # at [i]: threshold just above bin i - 1
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    middles = [(r[0] + r[-1]) / 2 - REACH for r in runs]
    return float(min(middles, key=abs)) * BIN


def judge_urls(df: DataFrame, url: str, rules: Sequence[Rule], score: bool = True) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and (if asked) ``url_score`` to each row.

    A rule's verdict holds where one fits; all other rows get the models' verdict. Null URLs
    and those without ``://`` have an empty host and path. The models read the whole URL, a
    null as an empty text. Repeated rows get the same verdict. Columns with these names are replaced, others
    stay. The table is read three times, its URL column only for the models. Rows move only if
    there are more than ``COPIED`` grams, to meet what their rare grams give to the score.
    """
    rest = df.drop("host", "path", "rule", "verdict", "url_score")
    kept = [f for f in rest.schema.fields]
    host, path, fit_rule, fixed, whole, rare = (
        free_name(rest, n) for n in ("_host", "_path", "_rule", "_verdict", "_whole", "_rare")
    )
    text, verdict = longest_rule(F.col(host), F.col(path), rules)
    parted = rest.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    full = F.coalesce(F.col(url).cast("string"), F.lit(""))
    model = fit(parted.select(url, host, path), full, verdict)
    ruled = parted.withColumns({fit_rule: text, fixed: verdict, whole: full})
    ruled = model.scorer.with_rest(ruled, whole, rare)
    scorer, threshold = model.scorer, model.threshold
    names = [*[f.name for f in kept], "host", "path", "rule", "verdict", "url_score"]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + ["host string, path string, rule string, verdict string, url_score double"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, whole, URL_BYTES):
            scores = scorer.scores(texts_of(batch.column(whole)), batch.column(rare).to_numpy())
            verdicts = [
                v or (ALLOW if s >= threshold else BLOCK)
                for v, s in zip(batch.column(fixed).to_pylist(), scores, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in kept],
                    *[batch.column(c) for c in (host, path, fit_rule)],
                    pa.array(verdicts, type=pa.string()),
                    pa.array(scores, type=pa.float64()),
                ],
                names,
            )

    judged = ruled.mapInArrow(run, schema)
    return judged if score else judged.drop("url_score")
