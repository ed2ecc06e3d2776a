import struct
import zlib

import numpy as np
import pytest

from loupe.sources import files


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit gray or RGB PNG of rows x columns (x 3)."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg_header(width=640, height=480, taken=None, exif_size=None, turn=1, order="<") -> bytes:
    entries, tail = [(0x0112, 3, 1, turn)], b""
    sub = []
    if exif_size:
        sub += [(0xA002, 4, 1, exif_size[0]), (0xA003, 4, 1, exif_size[1])]
    base = 8 + 2 + 12 * 2 + 4
    sub_at = base
    if taken:
        sub.append((0x9003, 2, 20, sub_at + 2 + 12 * (len(sub) + 1) + 4))
        tail = taken.encode() + b"\0"
    entries.append((0x8769, 4, 1, sub_at))

    def block(rows):
        out = struct.pack(order + "H", len(rows))
        for tag, kind, count, value in rows:
            out += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        return out + struct.pack(order + "I", 0)

    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + block(entries) + block(sub) + tail
    app1 = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_headers(order):
    assert files.read_header(jpeg_header(order=order)) == (640, 480, None, 1)
    assert files.read_header(jpeg_header(taken="2020:01:02 03:04:05", exif_size=(100, 50), turn=6, order=order)) == (100, 50, "2020:01:02 03:04:05", 6)
    assert files.read_header(png(np.zeros((3, 7)))) == (7, 3, None, 1)
    for bad in (None, b"", b"\xff\xd8", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"hello", jpeg_header()[:20]):
        assert files.read_header(bad)[:2] == (None, None)


def test_orientation_swaps_sides_and_turns():
    x = np.arange(6).reshape(2, 3)
    assert [files.oriented(x, t).shape for t in (1, 3, 6, 8)] == [(2, 3), (2, 3), (3, 2), (3, 2)]
    assert files.oriented(x, 3).tolist() == x[::-1, ::-1].tolist()
    assert files.oriented(x, 6).tolist() == np.rot90(x, -1).tolist() and files.oriented(x, 8).tolist() == np.rot90(x).tolist()
    assert files.oriented(x, 2).tolist() == x[:, ::-1].tolist() and files.oriented(x, 4).tolist() == x[::-1].tolist()
    assert files.oriented(x, 5).tolist() == x.T.tolist() and files.oriented(x, 7).tolist() == np.rot90(x, 2).T.tolist()


def test_grid_hash_agrees_with_the_column(spark):
    rng = np.random.default_rng(0)
    grids = rng.integers(0, 4, (40, 8, 9))
    df = spark.createDataFrame([(k, g.ravel().tolist()) for k, g in enumerate(grids)], "k long, g array<long>")
    got = {r.k: r.h for r in df.select("k", files.grid_hash_column("g").alias("h")).collect()}
    assert got == {k: files.grid_hash(g) for k, g in enumerate(grids)}
    assert files.grid_hash(np.tile(np.arange(9, 0, -1), (8, 1))) == -1 and files.grid_hash(np.zeros((8, 9))) == 0


def test_shrink_keeps_means():
    x = np.arange(16 * 18, dtype=float).reshape(16, 18)
    assert np.allclose(files.shrink(x), x.reshape(8, 2, 9, 2).mean(axis=(1, 3)))
    assert files.shrink(np.ones((3, 2))).shape == (8, 9)


def test_scan_of_folders(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "sub" / "PotentialDuplicates").mkdir(parents=True)
    b.mkdir()
    (a / "one.PNG").write_bytes(png(np.zeros((4, 6))))
    (a / "sub" / "two.jpg").write_bytes(jpeg_header(taken="2019:05:06 07:08:09"))
    (a / "sub" / "PotentialDuplicates" / "old.jpg").write_bytes(jpeg_header())
    (a / "broken.jpeg").write_bytes(b"nothing")
    (a / "x.gif").write_bytes(b"gif")
    (a / "notes.txt").write_text("x")
    (b / "three.png").write_bytes(png(np.zeros((2, 2, 3))))
    photos, metrics = files.scan(spark, [str(a), str(tmp_path / "none"), str(b), str(a).upper()])
    got = {r.path.rsplit("/", 1)[1]: r for r in photos.collect()}
    assert set(got) == {"one.PNG", "two.jpg", "three.png"}
    assert (got["one.PNG"].width, got["one.PNG"].height, got["one.PNG"].format) == (6, 4, "Png")
    assert str(got["two.jpg"].capture_time) == "2019-05-06 07:08:09" and got["three.png"].capture_time is not None
    assert tuple(metrics.first()) == (3, 2)
    assert files.list_files(spark, [str(tmp_path / "none")]).count() == 0
    assert "content" not in files.list_files(spark, [str(a)]).columns


def test_hashes_of_images(spark, tmp_path):
    y, x = np.mgrid[0:150, 0:200]
    (tmp_path / "gradient.png").write_bytes(png(np.stack([x, x, x], axis=2)))
    (tmp_path / "same.png").write_bytes(png(np.stack([x, x, x], axis=2)))
    (tmp_path / "checker.png").write_bytes(png(((x // 16 + y // 16) % 2 * 255)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: r.dhash for r in files.image_hashes(spark, [str(tmp_path)]).collect()}
    assert got["gradient.png"] == got["same.png"] == 0 and got["broken.png"] is None
    assert bin((got["gradient.png"] ^ got["checker.png"]) & (1 << 64) - 1).count("1") > 8


def test_ordering_dump_assets_and_durations(spark, tmp_path):
    (tmp_path / "dump.txt").write_text("head\n[1] a b.jpg   | 00000000000000ff | 2020-01-02 03:04\n[2] c | ffffffffffffffff | never\nx | y\n")
    got = [tuple(r) for r in files.read_ordering(spark, str(tmp_path / "dump.txt")).orderBy("slot").collect()]
    assert [(r[0], r[1], r[2], str(r[3])) for r in got] == [(1, "a b.jpg", 255, "2020-01-02 03:04:00")]
    probed = spark.createDataFrame([(" 12.5\n",), ("N/A",), (None,)], "output string")
    assert [r.seconds for r in files.durations(probed).collect()] == [12.5, None, None]
    choices = spark.createDataFrame([("Calm", None), ("Custom", "/m/x.mp3"), ("Custom", "/none"), ("None", None)], "preset string, custom_path string")
    assets = spark.createDataFrame([("Calm", "/p/calm.mp3"), (None, "/m/x.mp3")], "preset string, path string")
    got = {(r.preset, r.custom_path): r.asset for r in files.resolve_assets(choices, assets).collect()}
    assert got == {("Calm", None): "/p/calm.mp3", ("Custom", "/m/x.mp3"): "/m/x.mp3", ("Custom", "/none"): None, ("None", None): None}


def test_hidden_names_and_closed_folders(spark, tmp_path):
    for name in ("_x.jpg", ".y.png", "sub/_z/deep.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    got = {r.path.rsplit("/", 1)[1]: r.file_size for r in files.list_files(spark, [str(tmp_path), str(tmp_path / "sub")]).collect()}
    assert got == {"_x.jpg": 4, ".y.png": 4, "deep.jpg": 4}
    # a folder that cannot be listed has nothing, and stops nothing
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([str(tmp_path / "gone"), str(tmp_path)]), pa.array([0, 0], pa.int32())], ["path", "root_ordinal"])
    assert sum(b.num_rows for b in files._entries(iter([batch]))) == 3


def test_a_header_is_read_as_far_as_it_goes(tmp_path):
    comment = b"\xff\xfe" + struct.pack(">H", 65000) + b"c" * 64998
    whole = jpeg_header(taken="2019:05:06 07:08:09", turn=6)
    long = whole[:2] + comment * 3 + whole[2:-2] + b"\xff\xda" + b"z" * 400_000
    (tmp_path / "long.jpg").write_bytes(long)
    assert files.file_header(str(tmp_path / "long.jpg")) == files.read_header(long) == (640, 480, "2019:05:06 07:08:09", 6)
    assert files.file_header(str(tmp_path / "none.jpg")) == (None, None, None, 1)
    (tmp_path / "cut.jpg").write_bytes(whole[:30])
    assert files.file_header(str(tmp_path / "cut.jpg"))[:2] == (None, None)


@pytest.mark.parametrize("turn", range(1, 9))
def test_small_grids_turn_like_the_picture(turn):
    x = np.random.default_rng(turn).integers(0, 255, (37, 53)).astype(float)
    wide, tall = files.shrink(x), files.shrink(x, 8, 9)
    grid = files.oriented(tall if turn >= 5 else wide, turn)
    assert np.allclose(grid, files.shrink(files.oriented(x, turn)))


def test_bitmaps(spark, tmp_path):
    rng = np.random.default_rng(1)
    colour, gray = rng.integers(0, 255, (4, 6, 3)), rng.integers(0, 255, (40, 20))
    (tmp_path / "a b.png").write_bytes(png(colour))
    (tmp_path / "g.png").write_bytes(png(gray))
    (tmp_path / "bad.png").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.bitmaps(spark, [str(tmp_path)], 10).collect()}
    a = np.frombuffer(got["a b.png"].rgba, dtype=np.uint8).reshape(4, 6, 4)
    assert (a[:, :, :3] == colour).all() and (a[:, :, 3] == 255).all()
    assert (got["g.png"].width, got["g.png"].height, len(got["g.png"].rgba)) == (5, 10, 200) and got["bad.png"].rgba is None
    turns = spark.createDataFrame([(r.path, 6) for r in got.values()], "path string, turn int")
    turned = {r.path.rsplit("/", 1)[1]: r for r in files.bitmaps(spark, [str(tmp_path)], 10, turns).collect()}
    assert (turned["a b.png"].width, turned["a b.png"].height) == (4, 6)
    assert np.frombuffer(turned["a b.png"].rgba, dtype=np.uint8).reshape(6, 4, 4).tolist() == files.oriented(a, 6).tolist()


def test_folders_to_groups(spark, tmp_path):
    from loupe.operators import collection, dedup

    base = np.tile(np.arange(0, 180, 20), (8, 1))
    near, far = base.copy(), base[:, ::-1].copy()
    near[0, 3] = 200
    for name, x in (("a/1.png", base), ("a/2.png", base), ("b/near.png", near), ("b/far.png", far)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(png(x))
    from pyspark.sql import functions as F

    photos, metrics = collection.index_folders(spark, [str(tmp_path)], library=F.lit("all"))
    # a picture without any falling step has the hash 0, which counts as unknown
    by = {r.path.rsplit("/", 1)[1]: r for r in photos.collect()}
    assert by["1.png"].sha == by["2.png"].sha and by["1.png"].dhash is None and by["far.png"].dhash == -1
    assert {r.stage: r.rows for r in metrics.collect()}["scanned"] == 4
    found = dedup.detect(photos)
    assert {(r.group_id, r.classification, r.seq) for r in found.members.collect()} == {(1, "ExactOnly", 1), (1, "ExactOnly", 2)}
    assert collection.index_folders(spark, [str(tmp_path / "none")]).photos.count() == 0


def image(pixels: np.ndarray, filters=None, extra: bytes = b"", cut: int = 0) -> bytes:
    """An 8-bit PNG of rows x columns x 1, 3 or 4, with a filter of 0 to 2 for each row."""
    h, w, n = pixels.shape
    x, raw = pixels.astype(np.uint8), b""
    for y in range(h):
        way = filters[y % len(filters)] if filters else 0
        before = np.vstack([np.zeros((1, n), np.uint8), x[y, :-1]]) if way == 1 else x[y - 1] if way == 2 and y else np.zeros((w, n), np.uint8)
        raw += bytes([way]) + (x[y] - before).tobytes()

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(raw)[: -cut or None]) + chunk(b"IEND", b"")


def test_small_pictures_are_decoded_as_by_the_image_source(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    gamma = struct.pack(">I", 4) + b"gAMA" + struct.pack(">I", 45455) + struct.pack(">I", zlib.crc32(b"gAMA" + struct.pack(">I", 45455)))
    made = {f"{n}-{k}.png": image(rng.integers(0, 256, (11, 13, n)), f) for n in (1, 3, 4) for k, f in enumerate((None, [1], [2], [0, 1, 2]))}
    made |= {"gamma.png": image(rng.integers(0, 256, (5, 6, 3)), extra=gamma), "cut.png": image(rng.integers(0, 256, (5, 6, 3)), cut=9), "x.png": b"", "n.txt": b"x"}
    made |= {"_hidden.png": made["1-0.png"], ".d/y.png": made["1-0.png"], "PotentialDuplicates/z.png": made["3-1.png"], "name.jpg": made["3-2.png"], "a%20b +.png": made["3-3.png"]}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert all(files.simple_png(made[name]) for name in made if name[1] == "-") and not any(files.simple_png(made[x]) for x in ("gamma.png", "cut.png", "x.png"))

    def found(most):
        return sorted((r.path, r.width, r.height, r.rgba) for r in files.bitmaps(spark, [str(tmp_path)], most).collect())

    here = found(None), found(7)
    assert not any("hidden" in r[0] or "/.d/" in r[0] for r in here[0])
    monkeypatch.setattr(files, "HEADER_BYTES", -1)  # none is small
    assert (found(None), found(7)) == here


def test_small_files_need_no_image_source(spark, tmp_path, monkeypatch):
    """The source lists all files on the driver and opens each once more."""
    from pyspark.sql import functions as F

    from loupe.operators import collection

    base = np.tile(np.arange(180, 0, -20), (8, 1))
    for name, x in (("1.png", base), ("2.png", base), ("3.png", base.T)):
        (tmp_path / name).write_bytes(png(x))
    whole = {r.path: r.dhash for r in files.image_hashes(spark, [str(tmp_path)]).collect()}
    monkeypatch.setattr(files, "_decoded", None)
    monkeypatch.setattr(files, "content_hash", None)
    photos, _ = collection.index_folders(spark, [f"file://{tmp_path}"], library=F.lit("all"))
    got = {r.path: r for r in photos.collect()}
    assert {k: r.dhash or 0 for k, r in got.items()} == whole and len(whole) == 3
    assert [got[k].sha for k in sorted(got)][0] == [got[k].sha for k in sorted(got)][1] is not None


def test_bitmaps_of_small_files_need_no_image_source(spark, tmp_path, monkeypatch):
    (tmp_path / "1.png").write_bytes(png(np.zeros((3, 4))))
    monkeypatch.setattr(files, "_decoded", None)
    assert [(r.width, r.height, len(r.rgba)) for r in files.bitmaps(spark, [str(tmp_path)]).collect()] == [(4, 3, 48)]


def test_pictures_of_a_table_are_made_in_waves(spark, data_dir, monkeypatch):
    from pathlib import Path

    from loupe.plans import collection, common, registry

    photos = common.now(spark, data_dir, "library", "dhash").filter("library IS NOT NULL AND dhash IS NOT NULL")
    names = {str(r.seq) for r in photos.select("seq").collect()}
    root, whole = "", sorted(tuple(r) for r in registry.queries()["S0_folders_to_groups"](spark, data_dir).collect())
    for most, waves in ((10**9, 1), (300, 4)):
        monkeypatch.setattr(collection, "WAVE_FILES", most)
        seen = []
        for root in collection._pictures(spark, data_dir, "waves"):
            seen.append({p.stem for p in Path(root.removeprefix("file:")).rglob("*.png")})
        assert len(seen) == waves and sum(map(len, seen)) == len(names) and set().union(*seen) == names and max(map(len, seen)) < 2 * len(names) / waves
        assert not list(Path(root.removeprefix("file:")).rglob("*"))
    assert whole == sorted(tuple(r) for r in registry.queries()["S0_folders_to_groups"](spark, data_dir).collect())


def test_waves_have_equal_bytes_of_other_waves(spark, tmp_path):
    """Files that are not read whole for their header get their hashes while they are there."""
    import hashlib
    import shutil

    from loupe.operators import collection

    rng = np.random.default_rng(5)
    small, large = png(rng.integers(0, 256, (8, 9))), png(rng.integers(0, 256, (200, 400)))
    assert len(large) > files.HEADER_BYTES
    flat = png(np.full((8, 9), 7))

    def waves():
        for made in ({"a/1.png": small, "a/2.png": large}, {"b/3.png": small, "b/flat.png": flat}, {"a/4.png": large, "a/x.txt": b"x"}):
            shutil.rmtree(tmp_path / "files", ignore_errors=True)
            for name, content in made.items():
                (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / "files" / name).write_bytes(content)
            yield [str(tmp_path / "files")]
        shutil.rmtree(tmp_path / "files")

    got = {r.path.rsplit("/", 1)[1]: r for r in collection.index_waves(spark, waves()).collect()}
    assert set(got) == {"1.png", "2.png", "3.png", "4.png", "flat.png"} and got["flat.png"].dhash is None
    assert [bytes(got[n].sha) for n in ("1.png", "2.png", "3.png", "4.png")] == [hashlib.sha256(x).digest() for x in (small, large, small, large)]
    assert got["1.png"].dhash == got["3.png"].dhash == files.image_hash(*files.simple_png(small)) and got["2.png"].dhash == got["4.png"].dhash is not None


def test_a_path_is_listed_once_case_aside(spark, tmp_path):
    names = ("a/x.png", "a/X.png", "A/x.png", "b/y.png", "b/ß.png", "b/SS.png")
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = sorted(r.path[len(f"file:{tmp_path}/") :] for r in files.list_files(spark, [str(tmp_path)]).collect())
    assert got == ["A/x.png", "b/SS.png", "b/y.png"]
    plain = files.list_files(spark, [str(tmp_path / "A")])
    assert [r.path for r in plain.collect()] == [f"file:{tmp_path}/A/x.png"]
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
    twice = files.list_files(spark, [str(tmp_path / "b"), str(tmp_path)])
    assert {(r.path[len(f"file:{tmp_path}/") :], r.root_ordinal) for r in twice.collect()} == {("A/x.png", 1), ("b/SS.png", 0), ("b/y.png", 0)}


def test_groups_of_a_table_need_no_numbering_of_each_wave(spark, data_dir, monkeypatch):
    """Photos are named by their own numbers: what numbers and counts sizes in every wave is thrown away."""
    from loupe.operators import collection
    from loupe.plans import registry

    monkeypatch.setattr(collection, "with_position", None)
    monkeypatch.setattr(collection, "size_collisions", None)
    assert registry.queries()["S0_folders_to_groups"](spark, data_dir).count() > 0
