"""Consolidating pairwise matches into groups (problem 1): deterministic Borůvka.

Every component selects its smallest outgoing edge.  With edges ordered by
(smaller end, larger end) that is the edge to the component's smallest
neighbour, so one ``min`` per component finds it.  The selected edges form trees
whose only cycles are pairs that chose each other; the smaller of such a pair is
the root, and it is the smallest id of its tree: along the pointers an id is
followed, at the latest two steps on, by a smaller one.  Trees collapse by
pointer doubling, edges take the labels of their roots, equal ones merge, and
rounds go on until no edge is left.  Each round at least halves the components
that still have edges; a chain of any length takes one round with a logarithmic
number of doublings.

All state is in written tables of two BIGINT columns; nothing but row counts
reaches the driver, and no operation gathers a component in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.keys import NEAR_BITS, path_key, sha_key, usable_hash
from loupe.llm.near import _hashed_photos, class_members, group_sizes, near_classes, near_pairs
from loupe.operators.current import current_photos
from loupe.session import HOT_ROWS, Scratch, follow


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    return pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter(u.isNotNull() & v.isNotNull() & (u != v)).distinct()


def _doubled(parents: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """(c, p, up): each of at most n components, its pointer, and its pointer's pointer."""
    up = parents.select(F.col("c").alias("p"), F.col("p").alias("up"))
    return follow(parents, up, "p", n, hot_rows=hot_rows).select("c", "p", "up")


def _forest(edges: DataFrame, scratch: Scratch, round_: int, n: int, hot_rows: int) -> DataFrame:
    """(c, p): every component that has one of the n edges, and the root of its tree."""
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("p")).unionByName(
        edges.select(F.col("v").alias("c"), F.col("u").alias("p"))
    )
    chosen = both.groupBy("c").agg(F.min("p").alias("p"))
    mutual = (F.col("up") == F.col("c")) & (F.col("c") < F.col("p"))
    rooted = _doubled(chosen, 2 * n, hot_rows).select("c", F.when(mutual, F.col("c")).otherwise(F.col("p")).alias("p"))
    parents, seen = scratch.cut(rooted, f"tree-{round_}-0", n=F.count(F.lit(1)))
    n = seen["n"]
    step = 0
    while True:
        once = _doubled(parents, n, hot_rows).select("c", F.col("up").alias("p"))
        twice = _doubled(once, n, hot_rows)
        step += 1
        parents, seen = scratch.cut(
            twice.select("c", F.col("up").alias("p"), (F.col("p") != F.col("up")).cast("long").alias("moved")),
            f"tree-{round_}-{step}",
            moved=F.sum("moved"),
        )
        parents = parents.select("c", "p")
        scratch.drop(f"tree-{round_}-{step - 1}")
        if not seen["moved"]:
            return parents


def connected(pairs: DataFrame, a: str = "src", b: str = "dst", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``id``, ``component``): ids that are linked directly or through others.

    component is the smallest id of its group.  Pairs may repeat, run in either
    direction or tie an id to itself; pairs with a null end are left out.  An id
    without a pair to another id is in no group and gets no row; no pairs give no
    rows.  Other columns are not read.  Runs jobs; the state is written below the
    session's shared folder.  An id with very many edges and a root with very many
    ids below it are followed by broadcast, see ``follow``; ``hot_rows`` is its bound.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    edges, seen = scratch.cut(_edges(pairs, a, b), "edges-0", n=F.count(F.lit(1)))
    forests: list[DataFrame] = []
    most = 2 * seen["n"]  # ids
    while seen["n"]:
        forest = _forest(edges, scratch, len(forests), seen["n"], hot_rows)
        forests.append(forest)
        end_u = forest.select(F.col("c").alias("u"), F.col("p").alias("a"))
        end_v = forest.select(F.col("c").alias("v"), F.col("p").alias("b"))
        ends = follow(follow(edges, end_u, "u", seen["n"], hot_rows=hot_rows), end_v, "v", seen["n"], hot_rows=hot_rows)
        relabelled = _edges(ends, "a", "b")
        edges, seen = scratch.cut(relabelled, f"edges-{len(forests)}", n=F.count(F.lit(1)))
        scratch.drop(f"edges-{len(forests) - 1}")
    if not forests:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    labels = forests.pop()
    while forests:
        later = labels.select(F.col("c").alias("p"), F.col("p").alias("root"))
        labels = follow(forests.pop(), later, "p", most, hot_rows=hot_rows, how="left").select("c", F.coalesce("root", "p").alias("p"))
    return labels.select(F.col("c").alias("id"), F.col("p").alias("component"))


def _digest(kind: str, *columns: str):
    """16 bytes that stand for a library and a value of it; null where a value is null.

    128 bits of MD5: for 10**12 keys the odds of any two different ones meeting
    are below 10**-14.
    """
    parts = [F.lit(kind)]
    for c in columns:
        parts += [F.lit("\0"), F.col(c)]
    return F.unhex(F.md5(F.concat(*parts)))


def _stars(now: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """(u, v): of the n rows, those with equal keys, each tied to the first of them."""
    keyed = now.select("seq", F.explode(F.array("file", "path")).alias("key")).filter(F.col("key").isNotNull())
    firsts = keyed.groupBy("key").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "first")
    return follow(keyed, firsts, "key", 2 * n, hot_rows=hot_rows).filter("first != seq").select(F.col("first").alias("u"), F.col("seq").alias("v"))


def photo_ties(photos: DataFrame, recorded: DataFrame, *, distance: int = NEAR_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``u``, ``v``): ties between photos of one library that span all ties.

    Ties are equal usable ``sha256``, hashes within ``distance`` bits, equal
    paths (case and slash direction aside) and rows of ``recorded`` (src, dst,
    kind) of kind exact or visual.  Of n photos tied by one value n - 1 ties are
    given, of equal hashes the first photo stands for all, which leaves the groups
    unchanged.  Photos with a null library have no ties; null or unusable values
    tie nothing; recorded ends that are not photos are left out.
    """
    scratch = Scratch(photos.sparkSession, "ties")
    sizes = group_sizes(photos)
    now = current_photos(
        photos.select(
            "seq", "library", "dhash", "loaded_at",
            F.hex(sha_key("sha256")).alias("file"), path_key("path").alias("path"),
        ),
        "library",
        usable_hash("dhash").alias("dhash"),
        _digest("f", "library", "file").alias("file"),
        _digest("p", "library", "path").alias("path"),
    )
    now = now.filter(F.col("library").isNotNull())
    now, seen = scratch.cut(now, "now", n=F.count(F.lit(1)))

    close = near_pairs(now, distance=distance, sizes=sizes, expand=False, hot_rows=hot_rows)
    wanted = recorded.filter(F.lower("kind").isin("exact", "visual"))
    seen_in = now.select(F.col("seq"), F.col("library"))
    kept = (
        _edges(wanted, "src", "dst")
        .join(seen_in.toDF("u", "library"), "u")
        .join(seen_in.toDF("v", "library"), ["v", "library"])
    )
    return (
        _stars(now, seen["n"], hot_rows)
        .unionByName(close.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
        .unionByName(kept.select("u", "v"))
    )


def photo_groups(photos: DataFrame, recorded: DataFrame, *, distance: int = NEAR_BITS) -> DataFrame:
    """(``seq``, ``component``) of every photo tied to another, see ``photo_ties``."""
    groups = connected(photo_ties(photos, recorded, distance=distance), "u", "v")
    return groups.select(F.col("id").alias("seq"), "component")


def near_groups(photos: DataFrame, *, distance: int = NEAR_BITS) -> DataFrame:
    """(``seq``, ``representative``, ``component``): photos whose picture is nearly another's, by group.

    One row for each photo that ``near.near_photos`` pairs with another: component
    is the smallest seq of all photos linked so, directly or through others;
    representative the smallest seq of the library with the same hash, which stands
    for its copies while groups are formed.  Copies of one file alone make no group.
    """
    scratch = Scratch(photos.sparkSession, "alike")
    slim = _hashed_photos(photos).select(F.col("library").alias("grp"), F.col("seq").alias("id"), F.col("dhash").alias("hash"), F.col("file").alias("same"))
    near = near_classes(slim, distance=distance, sizes=group_sizes(photos), group="library")
    classes, _ = scratch.cut(near.classes, "classes")
    label = connected(near.pairs.select("id_a", "id_b"), "id_a", "id_b").toDF("first", "component")
    # rows with one hash that are not all one file are near each other
    mixed = F.col("component").isNull() & (F.col("n") > 1) & F.col("same").isNull()
    placed = classes.join(label, "first", "left").withColumn("component", F.when(mixed, F.col("first")).otherwise(F.col("component")))
    placed = placed.filter("component IS NOT NULL").select("first", "n", "component")
    members = class_members(slim, near).select("first", "id")
    several = follow(members, placed.filter("n > 1").select("first", "component"), "first", near.rows)
    alone = placed.filter("n = 1").select("first", F.col("first").alias("id"), "component")
    return several.unionByName(alone).select(F.col("id").alias("seq"), F.col("first").alias("representative"), "component")
