"""References to records that do not exist, found with compressed bitmaps.

Every task folds its rows into the different (key, day) per reference field and key range and packs them
to a few bytes each; only these sets are shuffled, never the rows. Ranges are cut at quantiles of the
keys on both sides, so that they hold equally many, however scattered. Where the sets of one range meet, keys are
coded by a sorted dictionary; the codes of each (reference field, day) form a bitmap, from which the
bitmap of the parents known before that day is taken away (AND NOT). What survives is decoded: keys that
no parent has, and keys whose parent came that day or later. A blocked Bloom filter of the survivors, of
bounded size, is tested where references are scanned a second time; the few rows that pass meet the
survivors in a join and are judged exactly, by time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.operators import bitmaps
from papyrion.stable import settle

#: Rows (of a parent and its references) to a key range, on average, and the quantiles that ranges are cut at; beyond so many, the stretches between them are divided evenly.
RANGE, QUANTILES = 131_072, 1_024
#: Of every so many keys one is looked at to place the cuts, which steer balance only, no result.
LOOKED_AT = 8
#: Rows a task folds at once, which bounds its memory.
FOLDED = 2_000_000
#: Bits of the filter per survivor, and the most it may have (64 MB); beyond, more rows pass it and none is lost.
BITS, MOST_BITS = 16, 1 << 29
_DAY = 86_400_000_000
_NEVER = np.iinfo(np.int64).max  # for references: no time, so all parents are known
_PARENT, _LOG = -1, -2


@dataclass(frozen=True)
class Reference:
    """Rows of `frame` refer with `refkey` to records of the parent named `parent`."""

    frame: DataFrame
    tablename: str
    fieldname: str
    rowkey: str
    refkey: str
    parent: str
    created: str = "created"


def _key(name: str) -> Column:
    return F.col(name).cast("bigint")


def _bounds(references: list[Reference], parents: dict[str, tuple[DataFrame, str, str]]) -> dict[str, np.ndarray]:
    """Per parent the keys at which its ranges are cut: at most QUANTILES numbers each reach the driver."""
    grid = ", ".join(f"{i / QUANTILES!r}D" for i in range(1, QUANTILES))
    keys = None
    for name, frame, key in [(n, f, k) for n, (f, k, _) in parents.items()] + [(r.parent, r.frame, r.refkey) for r in references]:
        part = frame.select(F.lit(name).alias("parent"), _key(key).alias("key")).where(F.col("key").isNotNull() & (F.xxhash64("key").bitwiseAND(F.lit(LOOKED_AT - 1)) == 0))
        keys = part if keys is None else keys.unionByName(part)
    out = {name: np.zeros(0, np.int64) for name in parents}
    for row in keys.groupBy("parent").agg(F.count("key").alias("n"), F.expr(f"percentile_approx(key, array({grid}), {4 * QUANTILES})").alias("cuts")).collect():
        cuts, ranges = np.unique(np.array(row["cuts"], np.int64)), -(-row["n"] * LOOKED_AT // RANGE)
        if ranges <= QUANTILES:
            out[row["parent"]] = cuts[np.unique(np.linspace(0, len(cuts) - 1, ranges + 1, dtype=int)[1:-1])]
        else:
            parts = -(-ranges // QUANTILES)
            between = [int(a) + (int(b) - int(a)) * i // parts for a, b in zip(cuts, cuts[1:]) for i in range(parts)]
            out[row["parent"]] = np.unique(np.array([*between, cuts[-1]], np.int64))
    return out


_PACKED = "parent int, range int, side int, packed binary"


def _packed(frame: DataFrame, key: str, created: str | None, parent: int, side: int, cuts: np.ndarray) -> DataFrame:
    """The rows' different (key, day), or (key, first time) of parents, per range: one packed set per task and range."""

    def flush(keys: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        all_keys, all_times = np.concatenate(keys), np.concatenate(times)
        known, values = bitmaps.least(all_keys, all_times) if side < 0 else bitmaps.distinct(all_keys, np.where(all_times == _NEVER, _NEVER, all_times // _DAY))
        edges = [0, *np.searchsorted(known, cuts, side="right").tolist(), len(known)]
        sets = [(i, bitmaps.pack(known[a:b], values[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        n = len(sets)
        yield pa.RecordBatch.from_arrays([pa.array([parent] * n, pa.int32()), pa.array([i for i, _ in sets], pa.int32()), pa.array([side] * n, pa.int32()), pa.array([p for _, p in sets], pa.binary())], names=["parent", "range", "side", "packed"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, n = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            times.append(batch.column(1).cast(pa.int64()).fill_null(_NEVER).to_numpy())
            n += batch.num_rows
            if n >= FOLDED:
                yield from flush(keys, times)
                keys, times, n = [], [], 0
        if n:
            yield from flush(keys, times)

    time = F.col(created) if created else F.lit(None)
    return frame.where(F.col(key).isNotNull()).select(_key(key).alias("key"), time.cast("timestamp_ntz").alias("time")).mapInArrow(fold, _PACKED)


_SURVIVORS = "ref int, refkey bigint, first timestamp_ntz, reason string"


def _survivors(group: pa.Table) -> pa.Table:
    """Of one key range: the keys with references that no parent known before their day answers."""
    sides: dict[int, list] = {}
    for side, packed in zip(group.column("side").to_pylist(), group.column("packed").to_pylist()):
        sides.setdefault(side, []).append(bitmaps.unpack(packed))
    sets = {side: tuple(map(np.concatenate, zip(*parts))) for side, parts in sides.items()}
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parents, first = bitmaps.least(*sets.pop(_PARENT, nothing))
    deleted = sets.pop(_LOG, nothing)[0]
    dictionary = np.unique(np.concatenate([parents, *(keys for keys, _ in sets.values())]))
    size = len(dictionary)
    codes_of_parents = np.searchsorted(dictionary, parents)
    timeless = first == _NEVER  # parents without a time are always known
    since = np.where(timeless, np.iinfo(np.int64).min, first // _DAY)
    by_day = np.argsort(since, kind="stable")
    appeared, coming = since[by_day], codes_of_parents[by_day]
    out = []
    for ref, (keys, days) in sorted(sets.items()):
        order = np.lexsort((keys, days))
        days, codes = days[order], np.searchsorted(dictionary, keys[order])
        starts = np.flatnonzero(np.r_[True, days[1:] != days[:-1]])
        known, done, kept = bitmaps.bitset(codes_of_parents[:0], size), 0, []
        for a, b in zip(starts, [*starts[1:], len(days)]):
            upto = int(np.searchsorted(appeared, days[a], side="left"))
            if upto > done:
                known |= bitmaps.bitset(coming[done:upto], size)
                done = upto
            kept.append(bitmaps.and_not(bitmaps.container(codes[a:b], size), known))
        left = dictionary[np.unique(np.concatenate(kept))]
        at = np.minimum(np.searchsorted(parents, left), max(len(parents) - 1, 0))
        there = parents[at] == left if len(parents) else np.zeros(len(left), bool)
        when = first[at] if len(parents) else np.zeros(len(left), np.int64)
        reason = np.where(there, "late", np.where(np.isin(left, deleted), "deleted", "missing"))
        keep = ~(there & (when == _NEVER))
        out.append(pa.table([pa.array(np.full(keep.sum(), ref), pa.int32()), pa.array(left[keep], pa.int64()), pa.array(when[keep], pa.int64(), mask=~there[keep]).cast(pa.timestamp("us")), pa.array(reason[keep].tolist(), pa.string())], names=["ref", "refkey", "first", "reason"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.timestamp("us"), pa.string())], names=["ref", "refkey", "first", "reason"])


def _places(blocks: int, ref: Column, refkey: Column) -> tuple[Column, Column, Column]:
    """(block, first bit, second bit) of a key in the filter; the numbers are powers of two."""
    one, two = F.xxhash64(refkey, ref), F.xxhash64(refkey, ref, F.lit(1))
    low = lambda c, n: c.bitwiseAND(F.lit(n - 1).cast("bigint")).cast("int")
    return low(one, blocks), low(two, 32_768), low(F.shiftright(two, 20), 32_768)


def _filter(survivors: DataFrame) -> tuple[DataFrame, int]:
    """(blocks of 32,768 bits as 512 numbers each, their number): at most MOST_BITS in all."""
    wanted = max(32_768, BITS * survivors.count())
    blocks = min(MOST_BITS, 1 << (wanted - 1).bit_length()) // 32_768
    block, one, two = _places(blocks, F.col("ref"), F.col("refkey"))
    bits = survivors.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    words = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # 512 words a block at most
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("words")), blocks


def orphans(references: list[Reference], parents: dict[str, tuple[DataFrame, str, str]], deleted: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(`tablename`, `fieldname`, `rowkey`, `refkey`, `reason`, `refmonth`), no row twice, for each failing reference.

    `parents` maps a name to (records, key, time of creation), `deleted` to (log, key). A reference is
    `missing` if no record has its key and the log neither, `deleted` if only the log has it, `late`
    if the earliest record is younger than the referring row. Null references are none. A referring
    row without a time is never late (its refmonth is null), nor is a parent without one. Empty tables
    give no rows, a missing parent table counts as empty. Building the plan runs the jobs that
    find the surviving keys; the rows are found lazily.
    """
    cuts = _bounds(references, parents)
    names = {name: i for i, name in enumerate(parents)}
    parts = [_packed(r.frame, r.refkey, r.created, names[r.parent], i, cuts[r.parent]) for i, r in enumerate(references)]
    parts += [_packed(frame, key, created, names[name], _PARENT, cuts[name]) for name, (frame, key, created) in parents.items()]
    parts += [_packed(frame, key, None, names[name], _LOG, cuts[name]) for name, (frame, key) in deleted.items()]
    packed = parts[0]
    for part in parts[1:]:
        packed = packed.unionByName(part)
    survivors = settle(packed.groupBy("parent", "range").applyInArrow(_survivors, _SURVIVORS))
    blocks, n_blocks = _filter(survivors)

    found = None
    for i, r in enumerate(references):
        rows = r.frame.where(F.col(r.refkey).isNotNull()).select(F.lit(i).alias("ref"), _key(r.rowkey).alias("rowkey"), _key(r.refkey).alias("refkey"), F.col(r.created).cast("timestamp_ntz").alias("created"))
        found = rows if found is None else found.unionByName(rows)
    block, one, two = _places(n_blocks, F.col("ref"), F.col("refkey"))
    set_ = [F.expr(f"getbit(get(words, {p} >> 6), {p} & 63) = 1") for p in ("__one", "__two")]
    passed = found.withColumns({"__block": block, "__one": one, "__two": two}).join(F.broadcast(blocks), F.col("__block") == F.col("block")).where(set_[0] & set_[1]).select(*found.columns)  # at most MOST_BITS
    failing = passed.join(survivors.hint("merge"), ["ref", "refkey"]).where("reason <> 'late' OR first > created")
    named = [F.element_at(F.array(*(F.lit(x) for x in names)), F.col("ref") + 1) for names in ([r.tablename for r in references], [r.fieldname for r in references])]
    return failing.select(named[0].alias("tablename"), named[1].alias("fieldname"), "rowkey", "refkey", "reason", F.date_format("created", "yyyy-MM").alias("refmonth")).distinct()
