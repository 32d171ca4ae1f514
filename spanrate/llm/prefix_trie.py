"""Conversation prefix trie: what is saved if equal beginnings of conversations are stored once.

A node is a distinct sequence of first turns (role, text); its members are the conversations that
begin with it, and the root, of no turn, holds all. Turns become digests where they are scanned, and
a prefix is the exclusive-or of the hashes of its (position, digest) pairs in two lanes of 64 bits, so
prefixes need neither the texts nor a chain of steps along the conversation. Conversations are
ordered by a range shuffle and numbered by running counts of its partitions, so that one very long
conversation is spread over tasks like many short ones.

Subtree totals are found by time-forward processing: nodes are sorted in reverse level order, and
each takes the totals that its children have sent from a priority queue that spills to disk, adds
its own and sends the sum to its parent. The shards are subtrees: a node with more than ``m`` members
is heavy, ``m`` being the root of the number of rows (``LEAST_HEAVY`` at least), and below heavy
nodes every subtree goes whole to one partition, which processes its subtrees as one forest. Totals of
the subtrees' roots are added up per heavy parent before a last pass over the heavy nodes, of which
there are at most rows / m. Nodes of one member have one leaf and save nothing; they need no queue.

The children and members of a node are only ever counted by partial aggregates. The ids that end in
a node are streamed in order through one hash: sequential by definition, in constant memory.

Turns are ordered by number, null first, ties by role and the MD5 of role and text. Null role or text
is empty. Rows without a conversation id are left out. Repeated rows are repeated turns. An empty
table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrate.llm.text import space_words
from spanrate.llm.work import discard, keep, send_package

LEAST_HEAVY = 1024
#: Positions of a conversation whose hashes are run up in one task.
BLOCK = 1024
#: Messages that a priority queue holds before it spills.
QUEUE_LIMIT = 1 << 17
NO_IDS = hashlib.sha256(b"").hexdigest()

Node = tuple[int, int, int]


class SpillingQueue:
    """A priority queue of integer tuples; beyond ``limit`` it moves to sorted runs on disk."""

    def __init__(self, limit: int = QUEUE_LIMIT):
        self.limit = limit
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []
        self.n_runs = 0

    @staticmethod
    def _read(file, width: int) -> Iterator[tuple[int, ...]]:
        with file:
            file.seek(0)
            while block := file.read(8 * width * 4096):
                yield from map(tuple, np.frombuffer(block, np.int64).reshape(-1, width).tolist())

    def _spill(self) -> None:
        """The file has no name: it goes with the task, and nobody else reads it."""
        file = tempfile.TemporaryFile()
        rows = np.array(sorted(self.heap), np.int64)
        file.write(rows.tobytes())
        self.heap = []
        run = self._read(file, rows.shape[1])
        self.n_runs += 1
        heapq.heappush(self.runs, (next(run), self.n_runs, run))

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def least(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        item, number, run = self.runs[0]
        if (after := next(run, None)) is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (after, number, run))
        return item


def time_forward(rows: Iterator[tuple], limit: int = QUEUE_LIMIT) -> Iterator[tuple[int, int]]:
    """Subtree totals of rows (depth, k1, k2, p1, p2, is_top, leaves, saved) in reverse level order."""
    queue = SpillingQueue(limit)
    for depth, k1, k2, p1, p2, is_top, leaves, saved in rows:
        own = (-depth, k1, k2)
        while (least := queue.least()) is not None and least[:3] <= own:
            if least[:3] != own:
                raise ValueError(f"a total was sent to node {least[:3]}, which is not in this shard")
            message = queue.pop()
            leaves += message[3]
            saved += message[4]
        if not is_top:
            queue.push((1 - depth, p1, p2, leaves, saved))
        yield leaves, saved
    if queue.least() is not None:
        raise ValueError("totals were sent to nodes that are not in this shard")


def _run_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace leaves and saved of every node by its subtree's."""
    names = ["depth", "k1", "k2", "p1", "p2", "is_top", "leaves", "saved"]
    pending: list[pa.RecordBatch] = []

    def rows():
        for batch in batches:
            pending.append(batch)
            yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)

    totals: list[tuple[int, int]] = []
    for total in time_forward(rows()):
        totals.append(total)
        batch = pending[0]
        if len(totals) == batch.num_rows:
            done = np.array(totals, np.int64)
            for at, name in enumerate(("leaves", "saved")):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(done[:, at]))
            yield batch
            totals = []
            pending.pop(0)


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, digest, n_words, part, seq) in the order of conversations and turns."""
    speaker, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        speaker.alias("role"),
        F.unhex(F.md5(F.concat(F.md5(speaker), said))).alias("digest"),
        F.size(space_words(said)).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("row"),  # spreads rows that are equal in all else
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "row"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(
        dealt.select(
            "conv_id",
            "digest",
            "n_words",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("seq"),
        ),
        "turns",
    )


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, nth, digest, n_words), and (conv_id, n_turns)."""
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("seq"))
    numbered = turns.withColumn("local", local).join(before, ["conv_id", "part"])
    nth = (F.col("before") + F.col("local")).alias("nth")
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    return numbered.select("conv_id", nth, "digest", "n_words"), sizes


def rebuilt_turns(turns: DataFrame, sizes: DataFrame, every: int = 20, head: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, n_words) of conversations that begin like the first of their ``every``.

    Conversation c takes the first h turns of c - c % every, then its own after its first h, with h
    the CRC-32 of c in decimal modulo ``head``. Also (conv_id, n_turns) of the rebuilt ones.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head))
    model = F.col("conv_id") - F.col("conv_id") % every
    heads = (
        turns.where((F.col("conv_id") % every == 0) & (F.col("nth") < head))
        .groupBy(F.col("conv_id").alias("model"))
        .agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "n_words"))).alias("head"))
    )
    convs = sizes.withColumn("model", model).join(heads, "model", "left")
    convs = convs.select(
        "conv_id", h.alias("h"), F.filter("head", lambda t: t["nth"] <= h).alias("head"), "n_turns"
    )
    n_head = F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))
    convs = keep(
        convs.select(
            "conv_id",
            "head",
            (n_head - F.col("h")).alias("shift"),
            (n_head + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"),
        ),
        "conversations",
    )
    taken = convs.select("conv_id", F.inline("head")).withColumnRenamed("nth", "depth")
    own = turns.where(F.col("nth") > h).join(convs.select("conv_id", "shift"), "conv_id")
    own = own.select("conv_id", (F.col("nth") + F.col("shift")).alias("depth"), "digest", "n_words")
    return taken.unionByName(own), convs.select("conv_id", "n_turns")


def _lane(number: int) -> Column:
    return F.xxhash64(F.lit(number), F.col("digest"), F.col("depth"))


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_words, is_end): the nodes on the way of each conversation."""
    rows = turns.withColumns(
        {"l1": _lane(1), "l2": _lane(2), "block": F.floor(F.col("depth") / BLOCK)}
    )
    way = Window.partitionBy("conv_id", "block").orderBy("depth")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("l1").alias("b1"), F.bit_xor("l2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    before = blocks.join(sizes, "conv_id").select(
        "conv_id",
        "block",
        "n_turns",
        *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), none).alias(f"b{i}") for i in (1, 2)],
    )
    run = rows.withColumns({f"r{i}": F.bit_xor(f"l{i}").over(way) for i in (1, 2)})
    run = run.join(before, ["conv_id", "block"])
    key = {i: F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    found = run.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        *[key[i].alias(f"k{i}") for i in (1, 2)],
        *[key[i].bitwiseXOR(F.col(f"l{i}")).alias(f"p{i}") for i in (1, 2)],
        "n_words",
        (F.col("depth") == F.col("n_turns")).alias("is_end"),
    )
    roots = sizes.select(
        "conv_id",
        none.alias("depth"),
        *[none.alias(c) for c in ("k1", "k2", "p1", "p2", "n_words")],
        (F.col("n_turns") == 0).alias("is_end"),
    )
    return found.unionByName(roots)


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes in which conversations end."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "conv_id")]
            for *here, conv in zip(*columns, strict=True):
                if here != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield _end_rows(done)
        if node is not None:
            yield _end_rows([(*node, state.hexdigest())])

    key = ["depth", "k1", "k2"]
    ends = paths.where("is_end").select(*key, "conv_id")
    dealt = ends.repartition(*key).sortWithinPartitions(*key, "conv_id")
    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _end_rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.record_batch(arrays, names=["depth", "k1", "k2", "ends_sha256"])


def prefix_trie(paths: DataFrame, least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """The nodes of the trie over ``paths`` (of ``prefixes``), with their subtree totals.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    send_package(paths.sparkSession)
    paths = keep(paths, "paths")
    key, parent = ["depth", "k1", "k2"], [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"k{i}") for i in (1, 2)]]
    nodes = paths.groupBy(*key).agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.max("n_words").alias("n_words"),
    )
    nodes = keep(nodes, "nodes")
    m = max(least_heavy, math.isqrt(paths.count()))
    heavy = keep(nodes.where(F.col("n_convs") > m).select(*key, F.lit(True).alias("is_heavy")), "heavy-nodes")

    alone = F.col("n_convs") == 1
    children = nodes.where("depth > 0").groupBy(*parent).agg(
        F.count("*").alias("n_children"), F.count_if(alone).alias("leaves_alone")
    )
    above = nodes.select(*key, F.col("conv_id").alias("parent_conv_id"))
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id")
    full = nodes.join(children, key, "left").join(above, ["depth", "p1", "p2"], "left").join(heavy, key, "left")
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    full = keep(
        full.select(
            *key,
            "p1",
            "p2",
            "conv_id",
            "parent_conv_id",
            "n_convs",
            n_children.alias("n_children"),
            F.when(alone | (n_children == 0), 1).otherwise(F.col("leaves_alone")).alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
            F.coalesce("is_heavy", F.lit(False)).alias("is_heavy"),
        ),
        "trie",
    )
    # The first node that is not heavy on the way of a conversation is the root of its subtree.
    top = F.min(F.when(F.col("is_heavy").isNull(), F.struct(*key))).alias("top")
    tops = paths.join(heavy, key, "left").groupBy("conv_id").agg(top).where(F.col("top").isNotNull())
    shared = full.where((F.col("n_convs") > 1) & ~F.col("is_heavy")).join(tops, "conv_id")
    order = [F.desc("depth"), "k1", "k2"]
    shared = shared.withColumn("is_top", F.col("top") == F.struct(*key))
    dealt = shared.repartition("top").drop("top").sortWithinPartitions(*order)
    light = keep(dealt.mapInArrow(_run_forward, dealt.schema), "light-subtrees")
    sent = light.where("is_top AND depth > 0").groupBy(*parent).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    upper = full.where("is_heavy").join(sent, key, "left").withColumns(
        {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
    )
    upper = upper.drop("more_leaves", "more_saved").withColumn("is_top", F.col("depth") == 0)
    upper = upper.select(*light.columns).repartition(1).sortWithinPartitions(*order)
    upper = upper.mapInArrow(_run_forward, light.schema)
    single = full.where(alone & ~F.col("is_heavy")).withColumn("is_top", F.lit(False)).select(*light.columns)
    trie = light.unionByName(upper).unionByName(single).join(_ends(paths), key, "left")
    found = keep(
        trie.select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
        ),
        "prefix-trie",
    )
    discard(paths.sparkSession, paths, nodes, heavy, full, light)
    return found


def conversation_prefixes(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    rebuild: bool = False,
) -> DataFrame:
    """The ways of all conversations, as they are or rebuilt by ``rebuilt_turns``."""
    turns, sizes = _numbered(_turns(rows, conv_col, turn_col, role_col, text_col))
    if rebuild:
        return prefixes(*rebuilt_turns(turns, sizes))
    return prefixes(turns.withColumnRenamed("nth", "depth"), sizes)
