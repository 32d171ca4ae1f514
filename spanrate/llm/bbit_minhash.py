"""Near-duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

1. Each text becomes a set of shingle hashes. Texts with equal sets form a class; one row per class
   goes on, so exact copies cost nothing further.
2. Of ``PERMUTATIONS`` minima per class, bands of ``ROWS`` minima give bucket keys, and the low
   ``BITS`` bits of all minima are packed into planes of 64-bit words.
3. In each bucket the class with the smallest number leads. Of the leaders a class met, the
   ``LEADERS`` most alike by the collision-corrected estimate are confirmed on full sets. That
   joins almost every group at a cost in proportion to its members: no group emits its pairs.
4. Buckets that still hold several components are settled exactly: members outside the bucket's
   largest component are compared with all of that one, and with each other, in blocks of bounded
   size. A block returns one link per member and component, never its pairs.

Two texts at exactly the threshold share no bucket with a chance of 3e-6, more similar ones less.

Null, empty and white-space texts have an empty set and no links. A text with fewer words than a
shingle is one shingle. Rows with a null id get no component and are kept; rows that repeat an id
get the component of their own text. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrate.llm import textbytes
from spanrate.llm.components import connected_components
from spanrate.llm.text import put_back, set_apart, text_key
from spanrate.llm.work import keep, send_package

PERMUTATIONS = 256
ROWS = 6
BANDS = PERMUTATIONS // ROWS
BITS = 2
WORDS = PERMUTATIONS // 64
#: Seven standard deviations of the estimate at a similarity of 0.8.
MARGIN = 0.21
LEADERS = 3
MEMBER_BLOCK = 512
QUERY_BLOCK = 256

_random = np.random.default_rng(90210)
_FACTORS = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_BAND_FACTORS = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

SIGNATURES = "n_shingles long, class binary, planes array<long>, bands array<long>"


def shingle_sets(
    data: np.ndarray, ends: np.ndarray, width: int
) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    hashes, _, _, first = textbytes.word_hashes(data, ends, lower=True)
    windows = textbytes.window_hashes(hashes, width)
    for i in range(len(ends) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield textbytes.window_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every permutation."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(small), 1024):
        value = _FACTORS[:, None] * small[None, at : at + 1024] + _SHIFTS[:, None]
        np.minimum(least, value.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """BITS planes of WORDS 64-bit words."""
    low = textbytes.mixed(least.astype(np.uint64)).astype(np.uint8)
    planes = [np.packbits((low >> np.uint8(k)) & np.uint8(1)).view(np.int64) for k in range(BITS)]
    return np.concatenate(planes)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    total = (textbytes.mixed(rows + np.uint64(1)) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return textbytes.mixed(total + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _signer(width: int):
    def sign(batches):
        none = np.zeros(0, np.int64)
        for block in textbytes.blocks(batches, "text"):
            sizes, classes, planes, bands = [], [], [], []
            for shingles in shingle_sets(*textbytes.utf8(block.column("text")), width):
                sizes.append(len(shingles))
                if len(shingles):
                    classes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    least = minima(shingles)
                    planes.append(packed(least))
                    bands.append(band_keys(least))
                else:
                    classes.append(None)
                    planes.append(none)
                    bands.append(none)
            names = [name for name in ("doc_id", "version") if name in block.schema.names]
            yield pa.RecordBatch.from_arrays(
                [
                    *[block.column(name) for name in names],
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    _lists(planes),
                    _lists(bands),
                ],
                names=[*names, "n_shingles", "class", "planes", "bands"],
            )

    return sign


def _set_maker(width: int):
    def make(batches):
        for block in textbytes.blocks(batches, "text"):
            nodes, sets = [], []
            named = zip(block.column("node").to_pylist(), block.column("class").to_pylist(), strict=True)
            shingles = shingle_sets(*textbytes.utf8(block.column("text")), width)
            for (node, name), own in zip(named, shingles, strict=True):
                raw = own.tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == name:
                    nodes.append(node)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"]
            )

    return make


def estimate(a: Column, b: Column) -> Column:
    """Similarity from equal b-bit values, corrected for values that are equal by chance."""
    equal = F.lit(0)
    for word in range(WORDS):
        differ = F.lit(0).cast("long")
        for plane in range(BITS):
            at = plane * WORDS + word
            differ = differ.bitwiseOR(a[at].bitwiseXOR(b[at]))
        equal = equal + (64 - F.bit_count(differ))
    chance = 2.0**-BITS
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def _confirmer(percent: int):
    """Of each query of a block, one link to each part among the block's members but its own."""

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        members, queries = frame[~frame["query"]], frame[frame["query"]]
        found_x, found_y = [], []
        if len(members):
            sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
            sizes = np.array([len(x) for x in sets])
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            nodes, parts = members["node"].to_numpy(), members["part"].to_numpy()
            held = np.zeros(len(values), bool)
            for x, part, raw in zip(queries["node"], queries["part"], queries["shingles"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                at = at[values[at] == own]
                held[at] = True
                shared = np.add.reduceat(held[place].astype(np.int64), begin)
                held[at] = False
                linked = 100 * shared >= percent * (len(own) + sizes - shared)
                linked = np.flatnonzero(linked & (parts != part))
                _, first = np.unique(parts[linked], return_index=True)
                found_x += [x] * len(first)
                found_y += nodes[linked[first]].tolist()
        return pd.DataFrame({"a": np.array(found_x, np.int64), "b": np.array(found_y, np.int64)})

    return confirm


def _confirm(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the ``queries`` and ``members`` (grp, node, part) of equal groups.

    Both sides of a group are dealt to blocks, and every query meets every member in one of them.
    """
    n = queries.groupBy("grp").agg(F.count("*").alias("n_x")).join(
        members.groupBy("grp").agg(F.count("*").alias("n_y")), "grp"
    )
    n = n.select(
        "grp",
        F.ceil(F.col("n_x") / QUERY_BLOCK).cast("int").alias("n_q"),
        F.ceil(F.col("n_y") / MEMBER_BLOCK).cast("int").alias("n_b"),
    )
    n = keep(n, "block-counts")
    asked = queries.join(n, "grp").select(
        "grp",
        F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("block"),
        F.pmod(F.xxhash64("node"), F.col("n_q")).cast("int").alias("q_block"),
        "node",
        "part",
        F.lit(True).alias("query"),
    )
    answers = members.join(n, "grp").select(
        "grp",
        F.pmod(F.xxhash64("node"), F.col("n_b")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("q_block"),
        "node",
        "part",
        F.lit(False).alias("query"),
    )
    rows = asked.union(answers).join(sets, "node")
    return rows.groupBy("grp", "block", "q_block").applyInPandas(_confirmer(percent), "a long, b long")


def _star_pairs(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, lead): the leaders that a class resembles most."""
    pairs = members.where(F.col("node") != F.col("lead")).select("node", "lead").distinct()
    close = _estimated(pairs, "lead", classes).where(_may_link(threshold))
    rank = F.struct(F.round(estimate(F.col("p_a"), F.col("p_b")), 6).alias("e"), (-F.col("lead")).alias("l"))
    best = close.groupBy("node").agg(F.collect_list(rank).alias("all"))
    best = best.select("node", F.slice(F.sort_array("all", asc=False), 1, LEADERS).alias("best"))
    return best.select("node", F.explode("best").alias("r")).select("node", (-F.col("r.l")).alias("lead"))


def _estimated(pairs: DataFrame, other: str, classes: DataFrame) -> DataFrame:
    """``pairs`` of node and ``other`` with the sizes and planes of both."""
    own = classes.select("node", F.col("n").alias("n_a"), F.col("planes").alias("p_a"))
    theirs = classes.select(F.col("node").alias(other), F.col("n").alias("n_b"), F.col("planes").alias("p_b"))
    return pairs.join(own, "node").join(theirs, other)


def _may_link(threshold: float) -> Column:
    sizes = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))
    return sizes & (estimate(F.col("p_a"), F.col("p_b")) >= threshold - MARGIN)


def _open_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, part, main, alone): members of buckets that hold several components, without
    those of the largest one, ``main``; ``alone`` if that is a single class."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    placed = members.join(parts.join(sizes, "part"), "node").select("key", "node", "part", "size")
    largest = F.max(F.struct("size", "part"))
    spread = placed.groupBy("key").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), largest.alias("largest")
    )
    spread = spread.where(F.col("low") != F.col("high")).select(
        "key", F.col("largest.part").alias("main"), (F.col("largest.size") == 1).alias("alone")
    )
    placed = placed.join(keep(spread, "open-buckets"), "key")
    rest = placed.where(F.col("part") != F.col("main")).select("key", "node", "part", "main", "alone")
    return keep(rest, "open-members")


def _settle(
    members: DataFrame, parts: DataFrame, classes: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """The links between components that share a bucket.

    Members of smaller components are compared with all of the bucket's largest, once however
    many buckets they share, and with each other bucket by bucket. Where the largest is a single
    class too, the estimate must leave a chance.
    """
    rest = _open_members(members, parts)
    asked = rest.select(F.col("main").alias("grp"), "node", "part", "alone").distinct()
    single = _estimated(asked.where("alone"), "grp", classes).where(_may_link(percent / 100))
    single = single.select("grp", "node", "part")
    asked = keep(asked.where("NOT alone").select("grp", "node", "part").union(single), "asked")
    mains = parts.join(asked.select(F.col("grp").alias("part")).distinct(), "part", "left_semi")
    mains = mains.select(F.col("part").alias("grp"), "node", "part")
    several = rest.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    several = several.where(F.col("low") != F.col("high")).select("key")
    among = keep(rest.join(several, "key").select(F.col("key").alias("grp"), "node", "part"), "among")
    links = _confirm(asked, mains, sets, percent)
    return keep(links.union(_confirm(among, among, sets, percent)), "more-links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(rows, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, part, component_id, kept) per row of (doc_id, text), with its version
    if the rows have one; ``part`` tells groups apart whose smallest ids are equal."""
    send_package(rows.sparkSession)
    threshold = percent / 100
    named = ["doc_id", "version"] if "version" in rows.columns else ["doc_id"]
    schema = ", ".join(f"{name} long" for name in named) + ", " + SIGNATURES
    signed = keep(rows.mapInArrow(_signer(width), schema), "signatures")
    filled = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    # One doc_id may have several texts, so classes get numbers of their own.
    groups = filled.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    classes = filled.join(groups, ["class", "doc_id"]).dropDuplicates(["class", "doc_id"])
    classes = classes.select(
        F.monotonically_increasing_id().alias("node"),
        "class",
        "doc_id",
        F.col("n_shingles").alias("n"),
        "planes",
        "bands",
    )
    classes = keep(classes, "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lead"))
    buckets = buckets.where(F.col("size") > 1).select("key", "lead")
    members = keep(banded.join(buckets, "key").select("key", "node", "lead"), "members")
    wanted = members.select("node").distinct().join(classes.select("node", "class", "doc_id"), "node")
    wanted = wanted.withColumnsRenamed({"doc_id": "__id", "class": "__class", "node": "__node"})
    # An id with several texts meets all its classes here; the maker keeps the right set of each.
    texts = rows.where(F.col("doc_id").isNotNull()).join(wanted, F.col("doc_id") == F.col("__id"))
    texts = texts.select(F.col("__node").alias("node"), "text", F.col("__class").alias("class"))
    sets = keep(texts.mapInArrow(_set_maker(width), "node long, shingles binary"), "sets")
    star = keep(_star_pairs(members, classes, threshold), "stars")
    leads = star.select(F.col("lead").alias("grp"), F.col("lead").alias("node"), F.col("lead").alias("part"))
    followers = star.select(F.col("lead").alias("grp"), "node", F.col("node").alias("part"))
    links = keep(_confirm(leads.distinct(), followers, sets, percent), "star-links")
    parts = _parts(members, connected_components(links))
    more = _settle(members, parts, classes, sets, percent)
    parts = connected_components(links.union(more))
    placed = classes.join(parts, "node", "left").select(
        "class", "doc_id", F.coalesce("part", "node").alias("part")
    )
    names = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    placed = keep(placed.join(names, "part").select("class", "part", "component_id"), "components")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.select(*named, "n_shingles", "class")
        .join(placed, "class", "left")
        .select(*named, "n_shingles", "part", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _parts(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, part) for every class that shares a bucket."""
    nodes = members.select("node").distinct()
    return keep(
        nodes.join(found, "node", "left").select("node", F.coalesce("part", "node").alias("part")), "parts"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each group: the smallest id; of an id's repeats, one row.

    Rows are told apart by id and text. Where an id stands for several groups, the ones it does not
    stay for go to their next id that is not taken.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("version")
    ).where(F.col("doc_id").isNotNull())
    found = _grouped(rows, width, percent).groupBy("doc_id", "version").agg(
        F.min("part").alias("part"), F.min("kept").alias("kept"), F.count("*").alias("n")
    )
    found = keep(found, "grouped-rows")
    chosen = _one_version_each(found)
    removed = found.join(chosen.select("doc_id", "version"), ["doc_id", "version"], "left_anti")
    removed = keep(removed.select(F.col("doc_id").alias("gone"), F.col("version").alias("gone_version")), "removed")
    names = {"doc_id": id_col, "text": text_col}
    kept = set_apart(docs, **names)
    gone = (F.col("doc_id") == F.col("gone")) & (text_key(F.col("text")) == F.col("gone_version"))
    left = kept.join(removed, gone, "left_anti")
    repeated = found.where("n > 1").select(F.col("doc_id").alias("twice")).distinct()
    repeated = keep(repeated, "repeated-ids")
    once = left.join(repeated, F.col("doc_id") == F.col("twice"), "left_anti")
    more = left.join(repeated, F.col("doc_id") == F.col("twice"), "left_semi").dropDuplicates(["doc_id"])
    return put_back(once.unionByName(more), docs.columns, **names)


def _one_version_each(found: DataFrame) -> DataFrame:
    """(doc_id, version, part) of the rows that stay: each id once, rows with words before empty ones."""
    stay = found.where("kept")
    first = F.min(F.struct(F.col("part").isNull(), "version", "part")).alias("first")
    chosen = stay.groupBy("doc_id").agg(first).select("doc_id", "first.version", "first.part")
    chosen = keep(chosen, "chosen")
    lost = stay.select("part").distinct().join(chosen.select("part").distinct(), "part", "left_anti")
    lost = keep(lost.where(F.col("part").isNotNull()), "groups-without-row")
    if lost.isEmpty():
        return chosen
    members = keep(found.join(lost, "part").select("doc_id", "version", "part"), "members-without-row")
    while True:
        # Ids and groups that are settled leave; each round settles at least one more.
        members = members.join(chosen.select("doc_id"), "doc_id", "left_anti")
        members = members.join(chosen.select("part").distinct(), "part", "left_anti")
        best = members.groupBy("part").agg(F.min(F.struct("doc_id", "version")).alias("row"))
        best = best.groupBy("row.doc_id").agg(F.min(F.struct("part", "row.version")).alias("own"))
        best = keep(best.select("doc_id", "own.version", "own.part"), "stand-ins")
        if best.isEmpty():
            return chosen
        chosen = keep(chosen.union(best), "chosen")
