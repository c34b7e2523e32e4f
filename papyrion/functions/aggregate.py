"""The dialect's aggregate functions: builders from an argument to a Spark aggregate."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.dialect.lexer import DialectError
from papyrion.functions.values import Value, number, text


@dataclass(frozen=True)
class AggregateFunction:
    name: str
    returns: str
    build: Callable[..., Column]
    summary: str
    most: int = 1


def _geometric_mean(value: Value) -> Column:
    """exp of the mean logarithm, which overflows for no group size; a zero gives 0, a negative product of odd sign null."""
    x = number(value)
    logs = F.avg(F.when(x != 0, F.ln(F.abs(x))))
    negatives = F.sum((x < 0).cast("int"))
    return F.when(F.max((x == 0).cast("int")) == 1, F.lit(0.0)).when(negatives % 2 == 0, F.exp(logs))


def _mode(value: Value) -> Column:
    """The most frequent number, the least among equals."""
    return F.mode(number(value), True)


#: Aggregates that plans compute by `digests`, with the names Python has for them.
DIGESTS = {"sha1agg": "sha1", "sha256agg": "sha256", "sha512agg": "sha512"}


def digests(rows: DataFrame, keys: list[str], text_column: str, kind: str) -> DataFrame:
    """(`keys`, `digest`): per group the digest of its texts in binary order, one after another.

    Equal texts are counted first. Each group's texts are then sorted within one partition, which may spill, and
    run through the digest, which holds a few bytes: no group is gathered in memory. That one task goes
    through a group in order is in the nature of the digest. Null texts count for nothing.
    """
    counted = rows.where(F.col(text_column).isNotNull()).groupBy(*keys, F.col(text_column).alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    placed = (counted.repartition(*keys) if keys else counted.coalesce(1)).sortWithinPartitions(*keys, "__text")
    schema = T.StructType([*(counted.schema[k] for k in keys), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, held = None, None, None  # `held` is the group's keys, one row
        for batch in batches:
            own = [batch.column(i) for i in range(len(keys))]
            groups = list(zip(*(["nan" if v != v else v for v in c.to_pylist()] for c in own))) if keys else [()] * batch.num_rows
            ended, done = [], []
            for i, (g, text_, n) in enumerate(zip(groups, batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                if g != group:
                    if state is not None:
                        ended.append(held)
                        done.append(state.hexdigest())
                    group, state, held = g, hashlib.new(kind), [c.slice(i, 1) for c in own]
                data = text_.encode()
                for _ in range(n):
                    state.update(data)
            if done:
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([h[k] for h in ended]) for k in range(len(keys))), pa.array(done, pa.string())], names=[f.name for f in schema])
        if state is not None:
            yield pa.RecordBatch.from_arrays([*held, pa.array([state.hexdigest()], pa.string())], names=[f.name for f in schema])

    return placed.mapInArrow(run, schema)


def _joined(value: Value) -> Column:
    """The group's texts in binary order, one after another, gathered; used for streams only, whose state holds the group anyway."""
    return F.array_join(F.array_sort(F.collect_list(text(value))), "")


def _if_any(value: Value, digest: Column) -> Column:
    return F.when(F.count(value.column) > 0, digest)


def _count_distinct(value: Value, case_sensitive: Value | None = None) -> Column:
    if value.kind == "numeric" or value.kind == "time":
        return F.countDistinct(value.column)
    exact = bool(case_sensitive and case_sensitive.literal)
    return F.countDistinct(text(value) if exact else F.lower(text(value)))


REGISTRY = {
    f.name.lower(): f
    for f in (
        AggregateFunction("Avg", "numeric", lambda v: F.avg(number(v)), "mean"),
        AggregateFunction("Count", "numeric", lambda v: F.count(v.column), "number of values that are not null"),
        AggregateFunction("CountDistinct", "numeric", _count_distinct, "number of different values, case ignored unless the second argument is true", 2),
        AggregateFunction("GeometricMean", "numeric", _geometric_mean, "n-th root of the product"),
        AggregateFunction("Max", "numeric", lambda v: F.max(number(v)), "largest number"),
        AggregateFunction("Mean", "numeric", lambda v: F.avg(number(v)), "mean"),
        AggregateFunction("Median", "numeric", lambda v: F.median(number(v)), "middle value, the mean of the two middle ones"),
        AggregateFunction("Min", "numeric", lambda v: F.min(number(v)), "smallest number"),
        AggregateFunction("Mode", "numeric", _mode, "most frequent number, the least among equals"),
        AggregateFunction("Sum", "numeric", lambda v: F.coalesce(F.sum(number(v)), F.lit(0.0)), "sum, 0 for no values"),
        AggregateFunction("Variance", "numeric", lambda v: F.var_pop(number(v)), "population variance"),
        AggregateFunction("MinString", "string", lambda v: F.min(text(v)), "first text in binary order"),
        AggregateFunction("MaxString", "string", lambda v: F.max(text(v)), "last text in binary order"),
        AggregateFunction("Sha1Agg", "string", lambda v: _if_any(v, F.sha1(_joined(v))), "SHA-1 of the sorted texts"),
        AggregateFunction("Sha256Agg", "string", lambda v: _if_any(v, F.sha2(_joined(v), 256)), "SHA-256 of the sorted texts"),
        AggregateFunction("Sha512Agg", "string", lambda v: _if_any(v, F.sha2(_joined(v), 512)), "SHA-512 of the sorted texts"),
    )
}


def build(name: str, args: list[Value]) -> Value:
    function = REGISTRY[name]
    if not 1 <= len(args) <= function.most:
        raise DialectError(f"{function.name} takes 1{f' to {function.most}' if function.most > 1 else ''} argument, not {len(args)}")
    return Value(function.build(*args), function.returns)
