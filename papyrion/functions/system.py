"""The dialect's system functions: each gives rows about the engine, or acts on it."""

from __future__ import annotations

import platform
import resource
import threading
import time
from collections.abc import Callable

import pyspark

from papyrion import __version__
from papyrion.dialect.lexer import DialectError
from papyrion.functions import aggregate, scalar

#: name in lower case -> (name, parameters, for administrators only, field names, builder of rows)
REGISTRY: dict[str, tuple[str, int, bool, list[str], Callable]] = {}


def _register(name: str, fields: list[str], parameters: int = 0, admin: bool = True):
    def add(build):
        REGISTRY[name.lower()] = (name, parameters, admin, fields, build)
        return build

    return add


@_register("Cancel", [], 1)
def _cancel(engine, process):
    engine.cancel(process)
    return []


@_register("Terminate", [], 1)
def _terminate(engine, process):
    engine.terminate(process)
    return []


@_register("CheckpointHealthCounters", [])
def _checkpoint_counters(engine):
    engine.saved_counters = dict(engine.counters)  # ShowHealthCounters tells what came since
    return []


@_register("ClearHealthCounters", [])
def _clear_counters(engine):
    engine.counters.clear()
    return []


@_register("ShowHealthCounters", ["Counter", "Value", "SinceCheckpoint"])
def _show_counters(engine):
    saved = getattr(engine, "saved_counters", {})
    return sorted((k, str(v), str(v - saved.get(k, 0))) for k, v in engine.counters.items())


@_register("ClearCacheAllocations", [])
def _clear_cache(engine):
    engine.spark.catalog.clearCache()
    return []


@_register("ReleaseCacheAllocations", [])
def _release_cache(engine):
    engine.spark.catalog.clearCache()
    return []


@_register("Print", [], 1, admin=False)
def _print(engine, message):
    engine.messages.append("" if message is None else str(message))
    return []


@_register("RefreshMyRoles", ["Role"], admin=False)
def _refresh_roles(engine):
    return [(r,) for r in engine.policies.roles_of(engine.account)]


@_register("ShowAggregateFunctions", ["Name", "ReturnType", "Description"], admin=False)
def _show_aggregates(engine):
    return sorted((f.name, f.returns, f.summary) for f in aggregate.REGISTRY.values())


@_register("ShowScalarFunctions", ["Name", "ReturnType", "Parameters", "Description"], admin=False)
def _show_scalars(engine):
    return sorted((f.name, f.returns, ", ".join(f"{p.kind} {p.name}" for p in f.parameters), f.summary) for f in scalar.REGISTRY.values())


@_register("ShowSystemFunctions", ["Name", "Parameters", "RequiresAdmin"], admin=False)
def _show_system(engine):
    return sorted((n, str(p), str(a)) for n, p, a, _, _ in REGISTRY.values())


def _sessions(engine, process=None) -> list:
    """All sessions over the engine's schemas, or the one with a process id."""
    return [s for p, s in sorted(engine.catalog.sessions.items()) if process is None or p == int(float(process))]


@_register("ShowLocks", ["ProcessId", "Granularity", "Operation", "Object"], 1)
def _show_locks(engine, process=None):
    """What open transactions have changed: these schemas are theirs until they end."""
    return [(str(s.process), "Schema", "Write" if schema is not None else "Delete", key) for s in _sessions(engine, process) for key, schema in sorted(s.catalog.schemas.local.items())]


def _nothing(engine, process=None):
    """No session waits for another: readers see what is committed, and the later of two writers is refused at its commit."""
    return []


_register("ShowBlocks", ["ProcessId", "BlockedBy"], 1)(_nothing)
_register("ShowWaitingLocks", ["ProcessId", "Granularity", "Operation", "Object"], 1)(_nothing)
_register("ShowBlockTree", ["Tree"])(_nothing)


@_register("ShowMemoryUtilization", ["Component", "Bytes"])
def _show_memory(engine):
    jvm = engine.spark.sparkContext._jvm.Runtime.getRuntime()
    return [("driver Python", str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024)), ("driver JVM in use", str(jvm.totalMemory() - jvm.freeMemory())), ("driver JVM at most", str(jvm.maxMemory()))]


def _policy(engine, account: str, path) -> list[tuple]:
    return [(r.role, r.path, r.permission, "grant" if r.allowed else "deny", str(r.recursive)) for r in engine.policies.deciding(account, str(path or ""))]


@_register("ShowMySchemaPolicy", ["Role", "Schema", "Permission", "Rule", "Recursive"], 1, admin=False)
def _show_my_policy(engine, path):
    return _policy(engine, engine.account, path)


@_register("ShowSchemaPolicy", ["Role", "Schema", "Permission", "Rule", "Recursive"], 1, admin=False)
def _show_policy(engine, path):
    from papyrion.sources.catalog import normal

    return [(r.role, r.path, r.permission, "grant" if r.allowed else "deny", str(r.recursive)) for r in engine.policies.rules if r.path == normal(str(path or ""))]


@_register("ShowProcesses", ["ProcessId", "Account", "Statements", "InTransaction"], 1)
def _show_processes(engine, process=None):
    return [(str(s.process), s.account, str(s.counters.get("statements", 0)), str(s.catalog.schemas.depth > 0)) for s in _sessions(engine, process)]


@_register("ShowTransactions", ["ProcessId", "Depth", "Schemas"], 1)
def _show_transactions(engine, process=None):
    return [(str(s.process), str(s.catalog.schemas.depth), str(len(s.catalog.schemas.local))) for s in _sessions(engine, process) if s.catalog.schemas.depth]


@_register("ShowThreadPools", ["Pool", "Threads"])
def _show_pools(engine):
    context = engine.spark.sparkContext
    return [("executor cores", str(context.defaultParallelism)), ("driver threads", str(threading.active_count()))]


@_register("ShowVersion", ["Component", "Version"], 1, admin=False)
def _show_version(engine, every=None):
    rows = [("papyrion", __version__)]
    if every not in (None, 0, "0", "false"):
        rows += [("spark", engine.spark.version), ("pyspark", pyspark.__version__), ("python", platform.python_version())]
    return rows


@_register("Sleep", [], 1)
def _sleep(engine, milliseconds):
    time.sleep(max(0.0, float(milliseconds or 0)) / 1000)
    return []


def run(engine, name: str, args: list) -> tuple[list[str], list[tuple]]:
    """(fields, rows) of a system function's result."""
    if name.lower() not in REGISTRY:
        raise DialectError(f"no procedure or system function {name!r}")
    shown, most, admin, fields, build = REGISTRY[name.lower()]
    if len(args) > most:
        raise DialectError(f"{shown} takes {most} arguments at most")
    if admin and not engine.is_administrator:
        raise DialectError(f"{shown} is for administrators")
    try:
        return fields, build(engine, *args)
    except TypeError as error:
        if "positional argument" in str(error):
            raise DialectError(f"{shown} lacks an argument") from error
        raise
