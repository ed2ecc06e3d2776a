"""Files of a collection: listing, header metadata, content and perceptual hashes.

Only JPEG and PNG are read here; HEIC files are listed, but without a decoder they
have no dimensions and count as unsupported.

Folders and files are opened by the tasks, through pyarrow's file systems (local
and mounted folders, HDFS, object stores); nothing is listed or read on the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from loupe.functions.text import image_not_supported, set_aside, supported_format
from loupe.session import Scratch, _clean_shuffles, _path, passing, ship_code

LISTED = "path string, file_size long, modified timestamp, root_ordinal int"
_ENTRY = "path string, is_folder boolean, file_size long, modified timestamp, root_ordinal int, twin boolean"
#: Bytes read of a file for its header at first; doubled while the header goes on.
HEADER_BYTES = 64 * 1024
#: Entries of folders that a task sends on at once, at least.
ENTRIES = 5_000
#: Bytes of a file held at once while its content is hashed.
PIECE_BYTES = 1 << 20
#: Pixels of the largest picture that is decoded from the bytes read for its header.
SMALL_PIXELS = 1 << 16


def _uri(root: str) -> str:
    if root.startswith("file:"):
        return "file:/" + root[5:].lstrip("/")  # one form, as in ``_listed_path``
    return root if "://" in root else f"file:{os.path.abspath(root)}"


def opened(uri: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def existing_roots(spark: SparkSession, roots: list[str]) -> list[tuple[int, str]]:
    """(ordinal, root) of the folders that exist, each once (case aside), first seen first."""
    seen: set[str] = set()
    out = []
    for k, root in enumerate(roots):
        key = root.rstrip("/\\").upper()
        if key in seen:
            continue
        seen.add(key)
        fs, at = _path(spark, root)
        if fs.exists(at):
            out.append((k, root))
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder (path, root_ordinal); a folder that cannot be listed has nothing.

    twin: whether another entry of the folder may have the same path, case aside.
    """
    from pyarrow import fs

    made, n = [], 0
    for batch in batches:
        for uri, ordinal in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                system, at = opened(uri)
                infos = system.get_file_info(fs.FileSelector(at))
            except OSError:
                continue
            start = uri.rstrip("/")
            rows = [(f"{start}/{i.base_name}", i.type == fs.FileType.Directory, i.size, i.mtime_ns) for i in infos if i.type != fs.FileType.NotFound]
            if rows:
                paths, folders, sizes, times = zip(*rows)
                times = [None if t is None else t // 1000 for t in times]
                twin = not all(map(str.isascii, paths)) or len({p.upper() for p in paths}) < len(paths)
                made.append(pa.RecordBatch.from_arrays(
                    [pa.array(paths), pa.array(folders), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC")),
                     pa.array([ordinal] * len(rows), pa.int32()), pa.array([twin] * len(rows))],
                    ["path", "is_folder", "file_size", "modified", "root_ordinal", "twin"],
                ))
                n += len(rows)
                if n >= ENTRIES:  # small folders share a batch
                    yield pa.concat_batches(made)
                    made, n = [], 0
    if made:
        yield pa.concat_batches(made)


def _listed(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, int, bool]:
    """(all files below the roots, how many, whether a path may be there twice, case aside); those below two roots are."""
    ship_code(spark)
    scratch = Scratch(spark, "listing")
    found = [(ordinal, _uri(root)) for ordinal, root in existing_roots(spark, roots)]
    level = spark.createDataFrame([(root, ordinal) for ordinal, root in found], "path string, root_ordinal int")
    files, depth, n_files = [], 0, 0
    n, twins = len(found), len(found) > 1
    while n:
        spread = level.repartition(min(n, spark.sparkContext.defaultParallelism * 4))
        entries, seen = scratch.cut(spread.mapInArrow(_entries, _ENTRY), f"level-{depth}", folders=F.count_if("is_folder"), files=F.count_if(~F.col("is_folder")), twins=F.count_if("twin"))
        files.append(entries.filter("NOT is_folder").select("path", "file_size", "modified", "root_ordinal"))
        level, n, depth = entries.filter("is_folder").select("path", "root_ordinal"), seen["folders"], depth + 1
        n_files, twins = n_files + seen["files"], twins or seen["twins"] > 0
    return (reduce(DataFrame.unionByName, files) if files else spark.createDataFrame([], LISTED)), n_files, twins


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Files below the roots: LISTED.

    Folders that do not exist or cannot be listed are skipped, files below a set-aside
    folder left out, and a path met below two roots counts for the first.  No file is
    opened.  Names that begin with a dot or an underscore are listed like others.
    Folders are listed level by level, each level by all tasks; links to folders that
    lead back to one above end with the depth of the file system's paths.
    """
    files, n, twins = _listed(spark, roots)
    # paths are few bytes, but each is a file to open: a number that is given is not coalesced to one task
    tasks = min(max(1, n), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    files = files.filter(~set_aside("path"))
    # below one root names that differ in each folder make paths that differ
    return first_by_path(files.repartition(tasks, F.upper("path")), "root_ordinal") if twins else files.repartition(tasks, "path")


def write_files(rows: DataFrame) -> DataFrame:
    """Writes a file for each row of (path, content); returns what was written (path, file_size).

    Files are written by the tasks, folders made as needed; one that exists is replaced,
    so a task that runs again leaves the same files.
    """
    ship_code(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        made: set[str] = set()
        for batch in batches:
            sizes = []
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = opened(uri)
                into = at.rsplit("/", 1)[0]
                if into not in made:
                    system.create_dir(into, recursive=True)
                    made.add(into)
                # a local file costs a tenth of the time without pyarrow's stream
                with open(at, "wb", buffering=0) if isinstance(system, fs.LocalFileSystem) else system.open_output_stream(at, compression=None) as file:
                    rest = memoryview(content)
                    while rest and (n := file.write(rest)) is not None:
                        rest = rest[n:]
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "file_size"])

    written = rows.select("path", "content").mapInArrow(write, "path string, file_size long")
    return Scratch(rows.sparkSession, "written").cut(written, "files")[0]


def rewrite_files(rows: DataFrame, content: Callable[[pa.RecordBatch], list[bytes | None]]) -> None:
    """Leaves in each folder the files (folder, name) of the rows and no others; a folder without files has a row without name.

    content: of a batch of rows the bytes of each file.  A folder is one task's, which
    gives its old files their new names and bytes as far as they go: where many have
    just been deleted, a local disk takes long to make new ones.
    """
    ship_code(rows.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        old: dict[str, tuple] = {}
        for batch in batches:
            folders, names = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("folder", "name"))
            for folder, name, data in zip(folders, names, content(batch)):
                if folder not in old:
                    system, into = opened(folder)
                    local = isinstance(system, fs.LocalFileSystem)
                    system.create_dir(into, recursive=True)
                    there = os.listdir(into) if local else [i.base_name for i in system.get_file_info(fs.FileSelector(into))]
                    old[folder] = system, into, local, dict.fromkeys(there)
                if name is None:
                    continue
                system, into, local, left = old[folder]
                at = f"{into}/{name}"
                if not local:
                    left.pop(name, None)
                    with system.open_output_stream(at, compression=None) as file:
                        file.write(data)
                    continue
                if name in left:  # of an attempt before
                    del left[name]
                elif left:
                    os.rename(f"{into}/{left.popitem()[0]}", at)
                file = os.open(at, os.O_WRONLY | os.O_CREAT, 0o666)
                try:
                    done = 0
                    while done < len(data):
                        done += os.write(file, data[done:])
                    if os.fstat(file).st_size > done:
                        os.ftruncate(file, done)
                finally:
                    os.close(file)
        for system, into, _, left in old.values():
            for name in left:
                system.delete_file(f"{into}/{name}")
        yield from ()

    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "folder")
    with _clean_shuffles(rows.sparkSession):
        spread.mapInArrow(rewrite, "folder string").write.format("noop").mode("overwrite").save()


def first_by_path(files: DataFrame, *order: str) -> DataFrame:
    """One row per path, case aside: the first by ``order``, then path."""
    place = F.row_number().over(Window.partitionBy(F.upper("path")).orderBy(*order, "path"))
    return files.withColumn("__place", place).filter("__place = 1").drop("__place")


def classify(files: DataFrame) -> DataFrame:
    """Adds format (null if not supported) and unsupported_image."""
    return files.withColumn("format", supported_format("path")).withColumn("unsupported_image", image_not_supported("path"))


# --- headers ---------------------------------------------------------------------

_EXIF_WIDTH, _EXIF_HEIGHT, _EXIF_SUB, _EXIF_TAKEN, _EXIF_TURN = 0xA002, 0xA003, 0x8769, 0x9003, 0x0112
#: Start-of-frame markers of JPEG: C0 to CF without C4, C8 and CC.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def _exif(data: bytes) -> dict[int, object]:
    """Tags of interest of a TIFF block; broken parts are left out."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        return {}
    end = "<" if data[:2] == b"II" else ">"
    found: dict[int, object] = {}
    todo, seen = [struct.unpack_from(end + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(end + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(end + "HHI", data, entry)
            if kind == 3:
                value: object = struct.unpack_from(end + "H", data, entry + 8)[0]
            elif kind == 4:
                value = struct.unpack_from(end + "I", data, entry + 8)[0]
            elif kind == 2:
                start = struct.unpack_from(end + "I", data, entry + 8)[0] if count > 4 else entry + 8
                value = data[start : start + count].split(b"\0")[0].decode("latin-1")
            else:
                continue
            if tag == _EXIF_SUB and isinstance(value, int):
                todo.append(value)
            elif tag in (_EXIF_WIDTH, _EXIF_HEIGHT, _EXIF_TAKEN, _EXIF_TURN):
                found.setdefault(tag, value)
    return found


def read_header(data: bytes | None) -> tuple[int | None, int | None, str | None, int]:
    """(width, height, time taken as text, orientation 1 to 8) of a JPEG or PNG; nulls where unknown."""
    return _parsed(data)[:4]


def _parsed(data: bytes | None) -> tuple[int | None, int | None, str | None, int, bool]:
    """``read_header``, and whether the data end before the header does."""
    width = height = taken = None
    turn = 1
    short = False
    if not data:
        return None, None, None, 1, True
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            short = len(data) < 24
            width, height = struct.unpack_from(">II", data, 16)
        elif data[:2] == b"\xff\xd8":
            at, short = 2, True
            while at + 4 <= len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                marker = data[at + 1]
                if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
                    at += 1 if marker == 0xFF else 2
                    continue
                if marker in (0xD9, 0xDA):
                    short = False
                    break
                size = struct.unpack_from(">H", data, at + 2)[0]
                if at + 2 + size > len(data):
                    break
                if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    tags = _exif(data[at + 10 : at + 2 + size])
                    taken = tags.get(_EXIF_TAKEN) or taken
                    turn = tags.get(_EXIF_TURN, turn)
                    width, height = tags.get(_EXIF_WIDTH) or width, tags.get(_EXIF_HEIGHT) or height
                elif marker in _FRAMES:
                    h, w = struct.unpack_from(">HH", data, at + 5)
                    width, height = width or w, height or h
                    short = False
                    if taken:
                        break
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return width or None, height or None, taken, turn if isinstance(turn, int) and 1 <= turn <= 8 else 1, short


HEADER = StructType([StructField(c, StringType() if c == "taken" else IntegerType()) for c in ("width", "height", "taken", "turn")])


def _header_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({
        "width": pd.array([r[0] for r in rows], dtype="Int32"), "height": pd.array([r[1] for r in rows], dtype="Int32"),
        "taken": [r[2] for r in rows], "turn": pd.array([r[3] for r in rows], dtype="Int32"),
    })


@F.pandas_udf(HEADER)
def header(content: pd.Series) -> pd.DataFrame:
    return _header_frame([read_header(bytes(c) if c is not None else None) for c in content])


def _read_local(file: int, wanted: int) -> bytes:
    """So many bytes of an open local file, fewer only at its end."""
    data = os.read(file, wanted)
    while len(data) < wanted and (more := os.read(file, wanted - len(data))):
        data += more
    return data


def _head_by(read: Callable[[int], bytes]) -> tuple[tuple, bytes]:
    data, wanted = b"", HEADER_BYTES
    while True:
        more = read(wanted)
        data += more
        *found, short = _parsed(data)
        if not short or len(more) < wanted:
            return tuple(found), data
        wanted = len(data)


def _head(uri: str) -> tuple[tuple, bytes]:
    """(``read_header`` of a file, what was read for it)."""
    try:
        if uri.startswith("file:") or "://" not in uri:  # a local file costs a third of the time without pyarrow's stream
            file = os.open("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri, os.O_RDONLY)
            try:
                return _head_by(partial(_read_local, file))
            finally:
                os.close(file)
        system, at = opened(uri)
        with system.open_input_stream(at, compression=None) as file:
            return _head_by(file.read)
    except OSError:
        return (None, None, None, 1), b""


def file_header(uri: str) -> tuple[int | None, int | None, str | None, int]:
    """``read_header`` of a file, of which no more is read than the header takes."""
    return _head(uri)[0]


@F.pandas_udf(HEADER)
def header_of(path: pd.Series) -> pd.DataFrame:
    return _header_frame([file_header(p) for p in path])


def _file_hash(uri: str) -> str | None:
    digest = hashlib.sha256()
    try:
        system, at = opened(uri)
        with system.open_input_stream(at, compression=None) as file:
            while piece := file.read(PIECE_BYTES):
                digest.update(piece)
    except OSError:
        return None
    return digest.hexdigest().upper()


@F.pandas_udf(StringType())
def content_hash(path: pd.Series) -> pd.Series:
    """SHA-256 of a file's bytes in upper-case hex, read piece by piece; null if it cannot be read."""
    return pd.Series([_file_hash(p) for p in path], dtype=object)


def _file_size(uri: str | None) -> int | None:
    if uri is None:
        return None
    try:
        system, at = opened(uri)
        info = system.get_file_info(at)
    except OSError:
        return None
    return info.size if info.is_file else None


@F.pandas_udf(LongType())
def content_size(path: pd.Series) -> pd.Series:
    """Bytes of a file, null if it is not there; the file is not opened."""
    return pd.Series([_file_size(p) for p in path], dtype="Int64")


def with_metadata(files: DataFrame) -> DataFrame:
    """Adds width, height, turn and capture_time to listed files, from their first bytes.

    capture_time is the time taken of the header, else the file's; a text that is
    no time counts as none.
    """
    return _with_header(files.withColumn("__h", header_of("path")))


SCANNED = ("path", "root_ordinal", "file_size", "format", "width", "height", "turn", "capture_time")


def _with_header(files: DataFrame, *more: str) -> DataFrame:
    taken = F.try_to_timestamp("__h.taken", F.lit("yyyy:MM:dd HH:mm:ss"))
    parts = {c: F.col(f"__h.{c}") for c in ("width", "height", "turn", *more)}
    return files.withColumns(parts | {"capture_time": F.coalesce(taken, F.col("modified"))}).drop("__h")


HEAD = StructType([*HEADER, StructField("known_sha", BinaryType()), StructField("known_dhash", LongType()), StructField("decoded", BooleanType())])
_HEAD_KINDS = pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()


def _head_of(roots: list[str]):
    """header_of, and of a file that was read whole by that its content hash and, of a simple picture, its perceptual hash."""
    starts = tuple(root.rstrip("/") + "/" for root in roots)

    @F.arrow_udf(HEAD)
    def head(path: pa.Array, file_size: pa.Array) -> pa.Array:
        rows = []
        for uri, size in zip(path.to_pylist(), file_size.to_pylist()):
            found, data = _head(uri)
            whole = 0 < len(data) == size
            picture = simple_png(data) if whole and found[3] == 1 and _is_shown(uri, starts) else None
            sha = hashlib.sha256(data).digest() if whole else None
            rows.append((*found, sha, None if picture is None else image_hash(*picture), picture is not None))
        columns = zip(*rows) if rows else [[]] * len(_HEAD_KINDS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _HEAD_KINDS)], HEAD.names)

    return head


def scan_contents(spark: SparkSession, roots: list[str], scratch: Scratch | None = None, name: str = "photos") -> tuple[DataFrame, dict]:
    """(photos of ``scan``, counts), with what else is known of files that the header's bytes hold whole.

    known_sha: the 32 bytes of the content hash, null of other files; decoded: whether
    known_dhash is the perceptual hash.  Counts: n_photos, n_unsupported, n_read
    (known_sha), n_decoded.  scratch: where they are written as ``name``, with the
    files that are not ``usable``.
    """
    scratch = scratch or Scratch(spark, "scan")
    with passing(spark):
        files = classify(list_files(spark, roots)).filter(F.col("format").isNotNull() | F.col("unsupported_image"))
        known = files.withColumn("__h", _head_of([_uri(root) for root in roots])("path", "file_size"))
        known = _with_header(known, "known_sha", "known_dhash", "decoded")
        usable = F.col("format").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
        known, seen = scratch.cut(
            known.withColumn("usable", usable), name, n_photos=F.count_if("usable"), n_unsupported=F.count_if(~F.col("usable")),
            n_read=F.count_if(F.col("usable") & F.col("known_sha").isNotNull()), n_decoded=F.count_if(F.col("usable") & F.col("decoded")),
        )
    return known.filter("usable").select(*SCANNED, "known_sha", "known_dhash", "decoded"), seen


def scan(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(photos, metrics) of the folders.

    photos: path, root_ordinal, file_size, format, width, height, turn, capture_time.
    metrics: one row with n_photos and n_unsupported, which counts images of other
    formats and supported files without readable dimensions; they are observed while
    the photos are written, so every file is opened once.
    """
    photos, seen = scan_contents(spark, roots)
    return photos.select(*SCANNED), spark.createDataFrame([(seen["n_photos"], seen["n_unsupported"])], "n_photos long, n_unsupported long")


# --- pixels ----------------------------------------------------------------------

GRID_WIDTH, GRID_HEIGHT = 9, 8


def oriented(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Rows x columns (x channels) turned and mirrored by an orientation of 1 to 8."""
    if turn in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


@lru_cache(maxsize=64)
def _weights(n: int, cells: int) -> np.ndarray:
    edges = np.linspace(0, n, cells + 1)
    left, right = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
    share = np.clip(np.minimum(right, edges[1:, None]) - np.maximum(left, edges[:-1, None]), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def shrink(gray: np.ndarray, width: int = GRID_WIDTH, height: int = GRID_HEIGHT) -> np.ndarray:
    """Mean brightness of a width x height grid of equal cells, aspect aside."""
    if gray.shape == (height, width):
        return gray
    return _weights(gray.shape[0], height) @ gray @ _weights(gray.shape[1], width).T


def grid_hash(grid: np.ndarray) -> int:
    """64 bits, row by row, highest first: whether a cell is brighter than the next in its row."""
    return int.from_bytes(np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes(), "big", signed=True)


def brightness(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows x columns of an image of Spark's image source (rows of gray, BGR or BGRA bytes)."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, 2] * 0.2126 + pixels[:, :, 1] * 0.7152 + pixels[:, :, 0] * 0.0722


def image_hash(data: bytes, height: int, width: int, channels: int, turn: int = 1) -> int:
    """Perceptual hash of an image of Spark's image source."""
    return grid_hash(shrink(oriented(brightness(data, height, width, channels), turn)))


#: Names that Spark's file sources pass over, of files and of folders.
_HIDDEN = re.compile(r"(^|/)[._]|\._COPYING_(/|$)")


def _is_shown(path: str, starts: tuple[str, ...]) -> bool:
    """Whether the image source lists the path below one of the roots; False where in doubt."""
    return any(path.startswith(start) and not _HIDDEN.search(path[len(start) :]) for start in starts)


def simple_png(data: bytes) -> tuple[bytes, int, int, int] | None:
    """(rows of gray, BGR or BGRA bytes, height, width, channels) of a small PNG, as the image source has them.

    Only what every decoder takes alike: whole files of 8 bits a channel, not
    interlaced, rows plain or by difference, without chunks that change colours.
    None for all others, which are left to the image source.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[8:16] != b"\0\0\0\rIHDR" or len(data) < 45:
        return None
    at, packed, last = 8, [], b""
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return None
        if name == b"IDAT":
            if packed and last != b"IDAT":
                return None
            packed.append(body)
        elif not (name == b"IHDR" and at == 8 or name == b"IEND" and not size or name == b"tEXt" and 0 < body.find(b"\0") < 80):
            return None
        at, last = at + 12 + size, name
        if name == b"IEND":
            break
    width, height, depth, kind, method, filtering, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    channels = {0: 1, 2: 3, 6: 4}.get(kind)
    if last != b"IEND" or at != len(data) or not channels or (depth, method, filtering, interlaced) != (8, 0, 0, 0) or not 0 < width * height <= SMALL_PIXELS:
        return None
    line, unpack = width * channels + 1, zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(packed), height * line + 1)
    except zlib.error:
        return None
    if len(raw) != height * line or not unpack.eof or unpack.unused_data:
        return None
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(height, line)
    filters, pixels = rows[:, 0], rows[:, 1:]
    if raw[::line].strip(b"\0"):
        if (filters > 2).any():
            return None
        pixels = pixels.copy()
        for y, way in enumerate(filters.tolist()):
            if way == 1:
                pixels[y] = np.cumsum(pixels[y].reshape(width, channels), axis=0, dtype=np.uint8).ravel()
            elif way == 2 and y:
                pixels[y] += pixels[y - 1]
    if channels > 1:
        pixels = pixels.reshape(height, width, channels)[:, :, [2, 1, 0, 3][:channels]]
    return pixels.tobytes(), height, width, channels


def _decoded(spark: SparkSession, roots: list[str]) -> DataFrame:
    """origin, height, width, nChannels, data of the JPEG and PNG files below the roots; height below 1 where one cannot be decoded."""
    found = [_uri(root) for _, root in existing_roots(spark, roots)]
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(found).select("image.*")


def _listed_path(origin: str) -> str:
    """The path of a listing for the escaped URI of the image source."""
    path = unquote(origin)
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _grids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        wide, tall = [], []
        for r in pdf.itertuples(index=False):
            gray = brightness(r.data, r.height, r.width, r.nChannels) if r.height > 0 and r.width > 0 else None
            wide.append(None if gray is None else shrink(gray).ravel())
            tall.append(None if gray is None else shrink(gray, GRID_HEIGHT, GRID_WIDTH).ravel())
        yield pd.DataFrame({"path": [_listed_path(o) for o in pdf["origin"]], "wide": wide, "tall": tall})


@F.pandas_udf(LongType())
def _turned_hash(wide: pd.Series, tall: pd.Series, turn: pd.Series) -> pd.Series:
    out = []
    for w, t, k in zip(wide, tall, turn):
        k = 1 if pd.isna(k) else int(k)
        grid = None if w is None else np.reshape(t, (GRID_WIDTH, GRID_HEIGHT)) if k >= 5 else np.reshape(w, (GRID_HEIGHT, GRID_WIDTH))
        out.append(None if grid is None else grid_hash(oriented(grid, k)))
    return pd.Series(out, dtype="Int64")


def image_hashes(spark: SparkSession, roots: list[str], turns: DataFrame | None = None) -> DataFrame:
    """(path, dhash) of the JPEG and PNG files below the roots; null where one cannot be decoded.

    turns: (path, turn), the orientation by the file's header; read here if not
    given.  Files are decoded where they are read and shrunk to two small grids, as
    they are and for pictures that lie on their side; only the grids leave the task
    and meet the orientation.  The image source passes over names that begin with a
    dot or an underscore, so these have no hash.
    """
    ship_code(spark)
    if not existing_roots(spark, roots):
        return spark.createDataFrame([], "path string, dhash long")
    if turns is None:
        turns = with_metadata(classify(list_files(spark, roots)).filter("format IS NOT NULL")).select("path", "turn")
    images = _decoded(spark, roots).select("origin", "height", "width", "nChannels", "data")
    grids = images.mapInPandas(_grids, "path string, wide array<double>, tall array<double>")
    return grids.join(turns.select("path", "turn"), "path", "left").select("path", _turned_hash("wide", "tall", "turn").alias("dhash"))


def resized(pixels: np.ndarray, most: int) -> np.ndarray:
    """Rows x columns x channels with the longer side cut down to ``most``, by the mean of what each pixel covers; never enlarged."""
    h, w = pixels.shape[:2]
    if max(h, w) <= most:
        return pixels
    height, width = max(1, round(h * most / max(h, w))), max(1, round(w * most / max(h, w)))
    return np.stack([shrink(pixels[:, :, c], width, height) for c in range(pixels.shape[2])], axis=2)


def bitmaps(spark: SparkSession, roots: list[str], most: int | None = None, turns: DataFrame | None = None) -> DataFrame:
    """(path, width, height, rgba): decoded, upright pictures, at most ``most`` pixels along the longer side.

    rgba holds four bytes a pixel, row by row, opaque where a picture has no alpha;
    null with width and height where a file cannot be decoded.  Pictures are resized
    where they are decoded, before they meet their orientation (turns, see
    ``image_hashes``), so what is shuffled has the size asked for.  Small simple PNGs
    are decoded by the tasks along the listing and written; only where there are other
    files does the image source list the folders again, which the driver does.
    """
    ship_code(spark)
    schema = "path string, width int, height int, rgba binary"
    if not existing_roots(spark, roots):
        return spark.createDataFrame([], schema)
    starts = tuple(_uri(root).rstrip("/") + "/" for root in roots)

    def fitted(data: bytes, height: int, width: int, channels: int) -> tuple[int, int, bytes]:
        x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
        colour = np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]
        alpha = x[:, :, 3:] if channels == 4 else np.full((*x.shape[:2], 1), 255, dtype=np.uint8)
        x = np.concatenate([colour, alpha], axis=2)
        if most and max(height, width) > most:
            x = np.rint(resized(x.astype(np.float64), most)).astype(np.uint8)
        return x.shape[1], x.shape[0], x.tobytes()

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = _head(uri)[1] if _is_shown(uri, starts) else b""
                picture = simple_png(data) if len(data) == size else None
                if picture is not None:
                    out.append((uri, *fitted(*picture)))
            columns = list(zip(*out)) or [[]] * 4
            kinds = pa.string(), pa.int32(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "width", "height", "rgba"])

    listed, n, _ = _listed(spark, roots)
    maybe = listed.filter((supported_format("path") == "Png") & (F.col("file_size") <= HEADER_BYTES)).select("path", "file_size")
    if len(roots) > 1:
        maybe = maybe.distinct()
    done, seen = Scratch(spark, "bitmaps").cut(maybe.mapInArrow(along, schema), "small", n=F.count(F.lit(1)))
    if seen["n"] == n and turns is None:
        return done  # nothing is read of the orientation of a PNG
    if turns is None:
        turns = with_metadata(classify(list_files(spark, roots)).filter("format IS NOT NULL")).select("path", "turn")

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.height < 1 or r.width < 1:
                    out.append((_listed_path(r.origin), None, None, None))
                    continue
                out.append((_listed_path(r.origin), *fitted(r.data, r.height, r.width, r.nChannels)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "rgba"]).astype({"width": "Int32", "height": "Int32"})

    def upright(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                turn = 1 if pd.isna(r.turn) else int(r.turn)
                if r.rgba is None or turn == 1:
                    out.append((r.path, r.width, r.height, r.rgba))
                    continue
                x = oriented(np.frombuffer(r.rgba, dtype=np.uint8).reshape(int(r.height), int(r.width), 4), turn)
                out.append((r.path, x.shape[1], x.shape[0], np.ascontiguousarray(x).tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "rgba"]).astype({"width": "Int32", "height": "Int32"})

    found = done
    if seen["n"] < n:
        others = _decoded(spark, roots).select("origin", "height", "width", "nChannels", "data").mapInPandas(small, schema)
        found = done.unionByName(others.join(done.select("path"), "path", "left_anti"))
    return found.join(turns.select("path", "turn"), "path", "left").mapInPandas(upright, schema)


def grid_hash_column(grid: str):
    """``grid_hash`` of an array of 72 numbers (8 rows of 9), in built-in functions."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (a, i) -> a | if({grid}[(i div 8) * 9 + i % 8] > {grid}[(i div 8) * 9 + i % 8 + 1], shiftleft(1L, 63 - i), 0L))"
    )


# --- other texts -----------------------------------------------------------------


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    """(slot, name, dhash, capture_time) of lines ``[slot] name | hash | yyyy-MM-dd HH:mm``; others are left out."""
    line = r"^\[(\d+)\] (.+?)\s*\| ([0-9a-f]{16}) \| (\S+ \S+)"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    return rows.select(
        part(1).cast("int").alias("slot"), part(2).alias("name"), F.conv(part(3), 16, -10).cast("long").alias("dhash"),
        F.try_to_timestamp(part(4), F.lit("yyyy-MM-dd HH:mm")).alias("capture_time"),
    )


def durations(probed: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``seconds``: a prober's printed seconds, null if it is no number."""
    return probed.withColumn("seconds", F.trim(output).try_cast("double"))


def resolve_assets(choices: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds ``asset``: the path of a preset, or a custom path if it is listed; else null.

    choices: preset, custom_path; assets: preset (null for other files), path.
    """
    presets = assets.filter("preset IS NOT NULL").select("preset", F.col("path").alias("__preset"))
    there = assets.select(F.col("path").alias("custom_path"), F.lit(True).alias("__there")).distinct()
    found = choices.join(presets, "preset", "left").join(there, "custom_path", "left")
    asset = F.when(F.col("preset") == "Custom", F.when(F.col("__there"), F.col("custom_path"))).otherwise(F.col("__preset"))
    return found.withColumn("asset", asset).drop("__preset", "__there")
