"""Session settings and the shared folder in which lineage is cut.

Iterative operators write their state as parquet tables in the folder that the
session names in ``spark.checkpoint.dir``.  A written table survives the loss of
any executor, tells the optimizer its true size, and is computed once (an eager
checkpoint computes its last stage twice).
"""

from __future__ import annotations

import atexit
import py_compile
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

SHARED_DIR_KEY = "spark.checkpoint.dir"
#: Shuffle files of a finished write go at once; else they stay until the driver collects its garbage.
CLEAN_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "loupe", cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: the session's own setting.

    Where it is unset and the master is local, a temporary folder is made and
    set.  On a cluster an unset folder is an error: a machine-local folder there
    would lose data with its machine.
    """
    set_to = spark.conf.get(SHARED_DIR_KEY, None) or spark.sparkContext.getConf().get(SHARED_DIR_KEY)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
    made = tempfile.TemporaryDirectory(prefix="loupe-shared-")
    atexit.register(made.cleanup)
    spark.conf.set(SHARED_DIR_KEY, made.name)
    return made.name


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the application, once.

    Functions that run in workers refer to the package by name; on a cluster, or
    where the driver found it by its own search path, workers could not import it.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    made = tempfile.TemporaryDirectory(prefix="loupe-code-")  # served by the driver as long as it runs
    atexit.register(made.cleanup)
    archive = Path(made.name) / "loupe-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            name = source.relative_to(package.parent)
            out.write(source, name)
            # compiled as well, so that not every worker compiles; other Python versions take the source
            compiled = Path(made.name) / "module.pyc"
            py_compile.compile(str(source), str(compiled), doraise=True, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
            out.write(compiled, name.with_suffix(".pyc"))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def _path(spark: SparkSession, uri: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(uri)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, uri: str) -> None:
    try:
        fs, at = _path(spark, uri)
        fs.delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


_CLEANING = threading.Lock()
_WRITERS: dict[int, tuple[int, str]] = {}


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go at once; the setting returns with the last of parallel writers."""
    key = id(spark)
    with _CLEANING:
        n, before = _WRITERS.get(key) or (0, spark.conf.get(CLEAN_SHUFFLES_KEY, "false"))
        _WRITERS[key] = n + 1, before
        spark.conf.set(CLEAN_SHUFFLES_KEY, "true")
    try:
        yield
    finally:
        with _CLEANING:
            n, before = _WRITERS.pop(key)
            if n > 1:
                _WRITERS[key] = n - 1, before
            else:
                spark.conf.set(CLEAN_SHUFFLES_KEY, before)


_ROOTS: dict[str, SparkSession] = {}


def release() -> None:
    """Deletes the scratch tables of all operators run so far.

    For drivers that live long: call it when no result of theirs is still to be
    computed.  Otherwise the tables go when the Python process ends.
    """
    while _ROOTS:
        root, spark = _ROOTS.popitem()
        delete(spark, root)


atexit.register(release)


_PASSING = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables of the operators that this thread begins meanwhile are deleted at the end: nothing that is left may read them."""
    outer, made = getattr(_PASSING, "roots", None), []
    _PASSING.roots = made
    try:
        yield
    finally:
        _PASSING.roots = outer
        for root in made:
            _ROOTS.pop(root, None)
            delete(spark, root)


@dataclass
class Scratch:
    """Tables of one run of an operator, below the shared folder.

    ``cut`` writes a frame and reads it back.  ``drop`` removes tables nobody
    reads any more; the rest goes with ``release`` or when the Python process ends,
    since lazily evaluated results may still need them.
    """

    spark: SparkSession
    name: str
    root: str = ""
    tables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship_code(self.spark)
        self.root = f"{shared_dir(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        _ROOTS[self.root] = self.spark
        if (made := getattr(_PASSING, "roots", None)) is not None:
            made.append(self.root)

    def cut(self, df: DataFrame, name: str, *, by: str | None = None, **metrics) -> tuple[DataFrame, dict]:
        """Write ``df``, in a folder for each value of the column ``by`` if given; return the written table and the metrics observed."""
        at = f"{self.root}/{name}"
        schema = df.schema
        if metrics:
            seen = Observation()
            df = df.observe(seen, *(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in metrics.items()))
        with _clean_shuffles(self.spark):
            df.write.mode("overwrite").parquet(at, partitionBy=by)
        self.tables[name] = at
        return self.spark.read.schema(schema).parquet(at), (seen.get if metrics else {})

    def drop(self, *names: str) -> None:
        for name in names:
            if at := self.tables.pop(name, None):
                delete(self.spark, at)


def bounded(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, reading no more than needed."""
    return df.limit(most + 1).count() <= most


def small_join(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join that broadcasts ``small`` only if it was counted to have at most ``most`` rows."""
    return big.join(F.broadcast(small) if bounded(small, most) else small, on, how)


#: Rows with one key that a join may send to one task, and keys with more rows that may be broadcast.
HOT_ROWS, HOT_KEYS = 3_000_000, 10_000


def _is_selection(df: DataFrame) -> bool:
    """Whether the frame only filters and projects a table, so that reading it again costs a scan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(node in plan for node in ("Join", "Aggregate", "Generate", "Window", "Repartition", "Sort", "Distinct", "FlatMap", "MapIn", "Union"))


def follow(rows: DataFrame, found: DataFrame, on: str | list[str], n: int, *, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found``, which has each key once; no task gets all rows of a hot key.

    n: an upper bound of the number of rows.  Of n rows fewer than ``HOT_KEYS`` keys
    can each have more than max(``hot_rows``, n / HOT_KEYS), so what is found for
    these few keys is broadcast and their rows stay where they are; all others meet
    by a join on the key.  With fewer rows than that no key can be hot.

    Both frames are read several times then, so one that is more than a selection
    from a table is written first.
    """
    limit = max(hot_rows, n // HOT_KEYS)
    if n <= limit:
        return rows.join(found, on, how)
    keys = [on] if isinstance(on, str) else on
    scratch = Scratch(rows.sparkSession, "followed")
    rows = rows if _is_selection(rows) else scratch.cut(rows, "rows")[0]
    found = found if _is_selection(found) else scratch.cut(found, "found")[0]
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys)
    known = found.join(F.broadcast(hot), keys)
    of_hot = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(known), keys, how)
    return of_hot.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(found, keys, how))


class Cancelled(RuntimeError):
    """The work was stopped from outside."""


def cancellable(spark: SparkSession, work: Callable[[], T], stop: threading.Event, *, every: float = 0.2) -> T:
    """Runs ``work``; once ``stop`` is set its Spark jobs are cancelled and the tables it made so far are deleted.

    Jobs of other threads go on.  Returns what ``work`` returns, raises what it raises,
    and ``Cancelled`` where it was stopped.
    """
    group = f"loupe-{uuid.uuid4().hex}"
    before, outcome = set(_ROOTS), {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "cancellable work", interruptOnCancel=True)
        try:
            outcome["value"] = work()
        except BaseException as error:  # noqa: BLE001 - handed over to the caller
            outcome["error"] = error

    thread = InheritableThread(target=run)
    thread.start()
    while thread.is_alive():
        thread.join(every)
        if stop.is_set() and thread.is_alive():
            spark.sparkContext.cancelJobGroup(group)  # again and again: the work may start further jobs
    if stop.is_set() and "value" not in outcome:
        for root in set(_ROOTS) - before:
            _ROOTS.pop(root, None)
            delete(spark, root)
        raise Cancelled("stopped") from outcome.get("error")
    if "error" in outcome:
        raise outcome["error"]
    return outcome["value"]
