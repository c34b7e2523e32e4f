"""Mixing sources to target shares of the total size, along schedules of weights.

A source's weight may change over training: its schedule is a list of (time, weight) points, times from
0 to 1, linear in between, scaled so that it integrates to the target share. The source's
cumulative demand is then quadratic between the points; its documents, in random order and repeated as
often as the demand asks, lie one after another along that demand, and each is given the time at which
the demand reaches its middle. From the time follows the position: the share of the whole mix that all
sources' demands add up to by then. Sorting by it (a range sort) gives the training order, in
which every stretch follows the scheduled weights.

Nothing is gathered per source: places within a source are sums over small hash slices, whose totals
(one row per source and slice) are summed up in a table far smaller than the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.sources.tables import spread
from papyrion.stable import settle

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents per hash slice of a source, on average.
SLICE = 20_000


_ENCODINGS: dict = {}


def _encoding(path: str):
    """The tokenizer of a rank file, kept for later batches of the same task."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(`doc_id`, `source`, `tokens`) of each document; a null text has 0 tokens. `tokenizer` is a rank file every executor can read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text.as_py() or "")) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"), "doc_id").mapInArrow(count, "doc_id bigint, source string, tokens bigint")


#: A source's weight over time: (time from 0 to 1, weight) points.
Schedule = list[tuple[float, float]]


def _knots(points: Schedule | None) -> tuple[np.ndarray, np.ndarray]:
    """Times from 0 to 1 and the weights there, whose integral is 1; weights below 0 count as 0, no weight at all as constant."""
    points = sorted(points or [(0.0, 1.0)])
    times = np.unique([0.0, 1.0, *(t for t, _ in points if 0 < t < 1)])
    weights = np.interp(times, [t for t, _ in points], [max(0.0, w) for _, w in points])
    whole = np.trapezoid(weights, times)
    return times, weights / whole if whole > 0 else np.ones_like(times)


def _segments(times: np.ndarray, weights: np.ndarray) -> list[tuple[float, float, float, float]]:
    """(sum before, start, weight there, slope) of each stretch between two times."""
    sums = np.r_[0.0, np.cumsum(np.diff(times) * (weights[1:] + weights[:-1]) / 2)]
    return [tuple(map(float, x)) for x in zip(sums, times, weights, np.diff(weights) / np.diff(times))]


def plan(counts: DataFrame, targets: DataFrame, schedules: dict[str, Schedule] | None = None, total: int | None = None) -> list[dict]:
    """Per source: its size, target share, cap of repeats, schedule and the tokens asked of it. One row per source reaches the driver.

    Without `total` the mix is as large as the scarcest source allows at exact shares. With it, a
    source that cannot meet its demand within its repeats gives all it can, and its shortfall shows in
    the reached shares. Targets are scaled to sum to 1; sources without documents or with a null or
    non-positive share or cap take no part, as do documents of sources without a target. Of several
    targets of a source the greatest share counts. A source without a schedule has a constant weight.
    """
    aims = targets.where("source IS NOT NULL AND targetshare > 0 AND maxrepeats > 0").groupBy("source").agg(F.max(F.struct("targetshare", "maxrepeats")).alias("aim"))
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    rows = [r.asDict() | r["aim"].asDict() for r in aims.join(sizes, "source").where("size > 0").collect()]
    rows.sort(key=lambda r: r["source"])
    whole = sum(r["targetshare"] for r in rows)
    for r in rows:
        r["share"] = r["targetshare"] / whole
        r["times"], r["weights"] = _knots((schedules or {}).get(r["source"]))
    if total is None:
        total = int(min((r["size"] * r["maxrepeats"] / r["share"] for r in rows), default=0))
    for r in rows:
        r["demand"] = min(total * r["share"], float(r["size"] * r["maxrepeats"]))
    return rows


def _time_of(met: Column, segments: Column) -> Column:
    """The time at which the part `met` of a source's demand is reached: the stretch it falls in, and there a quadratic solved."""
    at = F.element_at(F.filter(segments, lambda s: s["sum"] <= met), -1)
    rest = met - at["sum"]
    root = F.sqrt(F.greatest(at["weight"] * at["weight"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return F.least(at["start"] + F.coalesce(F.try_divide(2 * rest, at["weight"] + root), F.lit(0.0)), F.lit(1.0))


def _position_of(time: Column, rows: list[dict]) -> Column:
    """The part of all sources' demand that comes before a time."""
    times = np.unique(np.concatenate([r["times"] for r in rows])) if rows else np.array([0.0, 1.0])
    weights = sum(r["demand"] * np.interp(times, r["times"], r["weights"]) for r in rows) if rows else np.ones(2)
    whole = float(sum(r["demand"] for r in rows)) or 1.0
    segments = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("sum", "start", "weight", "slope"), s))) for s in _segments(times, weights / whole)))
    at = F.element_at(F.filter(segments, lambda s: s["start"] <= time), -1)
    past = time - at["start"]
    return F.least(at["sum"] + at["weight"] * past + at["slope"] * past * past / 2, F.lit(1.0))


def mix(documents: DataFrame, targets: DataFrame, schedules: dict[str, Schedule] | None = None, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares reached).

    The mix has one row per use of a document, sorted by `position` (0 to 1): (`doc_id`, `source`, `repeat`
    from 1, `tokens`, `position`). A source's documents are used in the order of a hash of seed and
    id, all of them before any a second time; the last pass ends with the document that meets the
    demand (left out if the better part of it lies beyond). The shares: (`source`, `targetshare`,
    `tokens`, `share`, `uses`, `documents`, `mostrepeats`). Documents without id or source are not used;
    documents of equal id are told apart by nothing and each is used; empty texts are used like others. Empty tables give empty results.
    """
    spark = documents.sparkSession
    counts = settle(token_counts(documents.where("doc_id IS NOT NULL AND source IS NOT NULL"), tokenizer))
    rows = plan(counts, targets, schedules, total)
    fields = "source string, size bigint, n bigint, share double, maxrepeats int, segments array<struct<sum double, start double, weight double, slope double>>, demand double, slices int"
    sources = spark.createDataFrame([(r["source"], r["size"], r["n"], r["share"], r["maxrepeats"], _segments(r["times"], r["weights"]), r["demand"], -(-r["n"] // SLICE)) for r in rows], fields)
    hashed = F.xxhash64("doc_id", F.lit(seed))
    placed = counts.join(F.broadcast(sources), "source").withColumn("hash", hashed).withColumn("slice", F.pmod(F.col("hash"), F.col("slices")))  # one row per source
    slices = placed.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = slices.withColumn("before", F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice")) - F.col("in_slice")).select("source", "slice", "before")
    inner = Window.partitionBy("source", "slice").orderBy("hash", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(before, ["source", "slice"]).withColumn("offset", F.col("before") + F.col("inside"))
    middle = F.col("offset") + F.col("tokens") / 2
    asked = at.withColumn("uses", F.least(F.col("maxrepeats").cast("bigint"), F.ceil((F.col("demand") - middle) / F.col("size"))).cast("int")).where("uses > 0")
    chosen = asked.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("uses"))))  # as many rows as uses, never more
    met = F.least(((F.col("repeat") - 1) * F.col("size") + middle) / F.col("demand"), F.lit(1.0))
    timed = chosen.select("doc_id", "source", "repeat", "tokens", _time_of(met, F.col("segments")).alias("__time"))
    mixed = timed.select("doc_id", "source", "repeat", "tokens", _position_of(F.col("__time"), rows).alias("position"))
    reached = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.countDistinct("doc_id").alias("documents"), F.max("repeat").alias("mostrepeats"))
    full = sources.select("source", F.col("share").alias("targetshare")).join(reached, "source", "left").fillna(0, ["tokens", "uses", "documents", "mostrepeats"])
    shares = full.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).select("source", "targetshare", "tokens", "share", "uses", "documents", "mostrepeats")  # one row per source
    return mixed.orderBy("position", "source", "doc_id", "repeat"), shares
