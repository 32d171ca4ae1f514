"""Quality rules: base measures of a text, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model of symbols in context, one per language. A text's symbols are
its code points; A-Z are lower-cased, and ASCII digits, ASCII white space and other ASCII signs are one
symbol each. Beyond ASCII nothing is folded and their number has no limit, so any script is modelled
like Latin, and the model grows with the corpus. All n-grams of all different texts are counted: tasks count what they read, Spark adds up.

Spark derives all orders from the counts: continuation counts, discounts from counts of counts,
back-off weights by context. No model comes to the driver and none is broadcast by hand, however
large it is or however many languages there are; a language is a key like any other. The model is
stored as a table of n-gram hashes and logarithms, sorted within ranges of hashes.

Texts are packed, compressed, in blocks of about ``BLOCK_BYTES`` of what one task reads. The different n-grams of a block are joined to the
model, and what is found comes back to the block as one sorted array of hashes beside an array of
logarithms, read by binary search. As the texts judged are the texts counted, all n-grams are found.

A text is judged by what others say: an n-gram that only one text holds counts as unseen there and is
read through the back-off weight of its context, or the next shorter context if that one is in no
other text either. Otherwise junk would be its own model.

The mean negative logarithm per symbol of a text is its score. A language's bands are the quartiles
of the scores of its different texts, moved out by ``reach`` times the distance between them, which
counts as ``LEAST_DISTANCE`` of the median at least; texts outside are rejected. Texts that fail the base rules are rejected too.

Null language is a language of its own. Null and empty texts have no words and fail the base rules.
Repeated rows count once in the model and the bands, and are judged each. Only id, text and language are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrate.llm import textbytes
from spanrate.llm.text import text_key
from spanrate.llm.work import keep, new_path, send_package

ORDER = 4
#: Bits of a code point; an n-gram is two numbers, ``hi`` and ``lo``, of two symbols each.
BITS = 21
LOW = 2**BITS - 1
#: Different n-grams that a task holds before it passes them on.
HELD = 1 << 20
#: Bytes of text that share one look into the model.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are turned into n-grams at once, and bytes of text to a bucket of blocks.
PIECE_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 100_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Steps of a logarithm that are told apart.
FINE = 2**24
#: The distance between quartiles counts as at least this share of the median, however alike texts are.
LEAST_DISTANCE = 0.01

_FOLDED = textbytes.ASCII_LOWER.astype(np.uint64)
_FOLDED[[i for i in range(128) if not chr(i).isalnum()]] = ord("#")
_FOLDED[textbytes.SPACE] = ord(" ")
_FOLDED[48:58] = ord("0")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[ends[1:]] - running[ends[:-1]]


def symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): the folded code points of every text."""
    begins = (data & 0xC0) != 0x80
    start = np.flatnonzero(begins)
    width = np.minimum(np.diff(np.append(start, len(data))), 4)
    code = _FOLDED[data[start]]
    wide = np.flatnonzero(width > 1)
    if len(wide):
        at, size = start[wide], width[wide]
        value = (data[at] & (0xFF >> (size + 1))).astype(np.uint64)
        for k in (1, 2, 3):
            more = size > k
            value[more] = (value[more] << np.uint64(6)) | (data[at[more] + k] & 0x3F).astype(np.uint64)
        code[wide] = value & np.uint64(LOW)
    return code, np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[ends]


def grams(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of every n-gram of ORDER symbols inside a text, before which spaces stand.

    Each text has as many n-grams as symbols: the first ones reach into the spaces before it.
    """
    before = []
    for back in range(1, ORDER):
        earlier = np.full(len(code), ord(" "), np.uint64)
        earlier[back:] = code[:-back]
        # Nothing is read across the beginning of a text.
        for ahead in range(back):
            at = ends[:-1][ends[:-1] + ahead < ends[1:]] + ahead
            earlier[at] = ord(" ")
        before.append(earlier)
    shift = np.uint64(BITS)
    return (before[2] << shift) | before[1], (before[0] << shift) | code


def gram_hashes(tongue: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One number for a language and an n-gram."""
    return textbytes.mixed(textbytes.mixed(textbytes.mixed(tongue) + hi) + lo)


def base_measures(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of every text."""
    hashes, start, stop, first = textbytes.word_hashes(data, ends, lower=False)
    counts = np.diff(first)
    begins = (data & 0xC0) != 0x80
    inside = begins & ~textbytes.SPACE[data]
    return {
        "n_words": counts,
        "word_chars": _sums(inside, ends),
        "n_symbols": _sums(_IS_SYMBOL[data], ends),
        "n_dup_lines": _repeated_lines(data, ends),
        "n_repeat_words": _repeated_words(hashes, first),
    }


def _repeated_lines(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    found = np.zeros(len(ends) - 1, np.int64)
    for i in range(len(found)):
        lines = [x for x in raw[ends[i] : ends[i + 1]].split(b"\n") if x and not x.isspace()]
        found[i] = len(lines) - len(set(lines))
    return found


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside windows of WINDOW words that are found at least twice in their text."""
    windows = textbytes.window_hashes(hashes, WINDOW)
    found = np.zeros(len(first) - 1, np.int64)
    for i in range(len(found)):
        a, b = int(first[i]), int(first[i + 1])
        n = b - a - WINDOW + 1
        if n < 2:
            continue
        own = windows[a : a + n]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        twin = np.zeros(n, bool)
        equal = ranked[1:] == ranked[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        if not equal.any():
            continue
        at = np.sort(order[twin])
        covered = np.minimum(np.diff(np.append(at, at[-1] + WINDOW)), WINDOW)
        found[i] = covered.sum()
    return found


def _block_grams(block: pa.RecordBatch):
    """(gram, tongue, hi, lo, offsets) of every n-gram of a block of texts."""
    code, ends = symbols(*textbytes.utf8(block.column("text")))
    hi, lo = grams(code, ends)
    tongue = np.repeat(block.column("tongue").to_numpy().view(np.uint64), np.diff(ends))
    return gram_hashes(tongue, hi, lo), tongue, hi, lo, ends


def _counted(gram, tongue, hi, lo, owner, n):
    """One row per n-gram; ``owner`` stays the only text that holds it, or becomes 0 for several."""
    order = np.argsort(gram)
    gram, owner = gram[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    kept = order[first]
    n = np.add.reduceat(n[order], first)
    return gram[first], tongue[kept], hi[kept], lo[kept], np.where(least == most, least, 0), n


def _count_grams(batches):
    """(gram, tongue, hi, lo, owner, n): what one task has read, added up as far as it can be held."""
    held, size = [], 0
    for block in textbytes.blocks(batches, "text", PIECE_BYTES):
        *new, ends = _block_grams(block)
        if not len(new[0]):
            continue
        owner = np.repeat(block.column("key").to_numpy(), np.diff(ends))
        held.append(_counted(*new, owner, np.ones(len(owner), np.int64)))
        size += len(held[-1][0])
        if size > 2 * HELD:
            held = [_counted(*[np.concatenate(x) for x in zip(*held, strict=True)])]
            size = len(held[0][0])
            if size > HELD:
                yield from _gram_batches(held[0])
                held, size = [], 0
    if held:
        yield from _gram_batches(_counted(*[np.concatenate(x) for x in zip(*held, strict=True)]))


def _gram_batches(held):
    for at in range(0, len(held[0]), 65_536):
        part = [pa.array(x[at : at + 65_536].view(np.int64)) for x in held]
        yield pa.RecordBatch.from_arrays(part, names=["gram", "tongue", "hi", "lo", "owner", "n"])


def _owner(over: Window | None = None) -> Column:
    """The only text among the owners, or 0."""
    least, most = F.min("owner"), F.max("owner")
    if over is not None:
        least, most = least.over(over), most.over(over)
    return F.when(least == most, least).otherwise(0)


def _levels(four: DataFrame) -> list[DataFrame]:
    """Counts (tongue, hi, lo, n, owner) by order, 1 first: below the top, how many symbols stand before."""

    def shorter(level: DataFrame, hi: Column, lo: Column) -> DataFrame:
        grouped = level.groupBy("tongue", hi.alias("hi"), lo.alias("lo"))
        return grouped.agg(F.count("*").alias("n"), _owner().alias("owner"))

    hi, lo, none = F.col("hi"), F.col("lo"), F.lit(0).cast("long")
    three = keep(shorter(four, hi.bitwiseAND(LOW), lo), "grams-3")
    two = shorter(three, none, lo)
    return [shorter(two, none, lo.bitwiseAND(LOW)), two, three, four]


def _discounts(levels: list[DataFrame]) -> DataFrame:
    """(order, tongue, d1, d2, d3) from the counts of counts; a count that never occurs is taken as one."""
    c1, c2, c3, c4 = (F.greatest(F.lit(1), F.count_if(F.col("n") == k)) for k in (1, 2, 3, 4))
    y = c1 / (c1 + 2 * c2)

    def discount(k: int, here: Column, above: Column) -> Column:
        return F.least(F.lit(k - 0.05), F.greatest(F.lit(0.05), k - (k + 1) * y * above / here))

    every = None
    for order, level in enumerate(levels, 1):
        own = level.groupBy("tongue").agg(
            discount(1, c1, c2).alias("d1"), discount(2, c2, c3).alias("d2"), discount(3, c3, c4).alias("d3")
        )
        own = own.withColumn("order", F.lit(order))
        every = own if every is None else every.unionByName(own)
    return keep(every, "discounts")


def _probabilities(levels: list[DataFrame], discounts: DataFrame) -> DataFrame:
    """The n-grams of the top order with p, the probability of the last symbol after the others, and
    p_others, which is the same for n-grams of several texts and the back-off's for those of one.

    A context's rows are the symbols that follow it: at most as many as there are code points.
    """
    context = Window.partitionBy("tongue", "hi", F.shiftright("lo", BITS))
    n = F.col("n")
    off = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    shares = [F.col(f"d{k}") * F.sum((n == k if k < 3 else n >= 3).cast("long")).over(context) for k in (1, 2, 3)]
    total = F.sum("n").over(context)
    # What follows a shorter context: without the first symbol.
    suffixes = {
        2: (F.lit(0).cast("long"), F.col("lo").bitwiseAND(LOW)),
        3: (F.lit(0).cast("long"), F.col("lo")),
        4: (F.col("hi").bitwiseAND(LOW), F.col("lo")),
    }
    below = None
    for order, level in enumerate(levels, 1):
        rows = level.join(discounts.where(F.col("order") == order).drop("order"), "tongue").select(
            *level.columns,
            ((n - off) / total).alias("own"),
            ((shares[0] + shares[1] + shares[2]) / total).alias("weight"),
            (1 / F.count("*").over(context)).alias("even"),
            _owner(context).alias("context_owner"),
        )
        if below is None:
            p_below = others_below = F.col("even")
        else:
            hi, lo = suffixes[order]
            rows = rows.withColumns({"hi_b": hi, "lo_b": lo}).join(below, ["tongue", "hi_b", "lo_b"])
            p_below, others_below = F.col("p_b"), F.col("others_b")
        p = F.col("own") + F.col("weight") * p_below
        unseen = F.when(F.col("context_owner") == 0, F.col("weight")).otherwise(1.0) * others_below
        others = F.when(F.col("owner") == 0, p).otherwise(unseen)
        rows = rows.select(*level.columns, p.alias("p"), others.alias("p_others"))
        below = rows.select(
            "tongue",
            F.col("hi").alias("hi_b"),
            F.col("lo").alias("lo_b"),
            F.col("p").alias("p_b"),
            F.col("p_others").alias("others_b"),
        )
    return rows


def _tongue(lang: Column) -> Column:
    return F.xxhash64(lang, lang.isNull())


def train(docs: DataFrame) -> DataFrame:
    """(gram, tongue, hi, lo, n, owner, p, p_others): every n-gram of all rows (lang, text, key)."""
    send_package(docs.sparkSession)
    counted = docs.select(_tongue(F.col("lang")).alias("tongue"), "text", "key").mapInArrow(
        _count_grams, "gram long, tongue long, hi long, lo long, owner long, n long"
    )
    added = counted.groupBy("gram", "tongue", "hi", "lo").agg(F.sum("n").alias("n"), _owner().alias("owner"))
    four = keep(added, "grams-4")
    levels = _levels(four)
    return _probabilities(levels, _discounts(levels))


def _packed(batches):
    """(block, texts): rows in blocks, each one compressed value."""
    first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for piece in textbytes.blocks(batches, "text", PIECE_BYTES):
        held.append(piece)
        size += int(textbytes.utf8(piece.column("text"))[1][-1])
        if size >= BLOCK_BYTES:
            yield _pack(first + n, held)
            n, held, size = n + 1, [], 0
    if held:
        yield _pack(first + n, held)


def _pack(block: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, pieces[0].schema, options=options) as out:
        for piece in pieces:
            out.write_batch(piece)
    columns = [pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "texts"])


def _asked(batches):
    """(block, gram): the different n-grams of each block."""
    for batch in batches:
        for block, texts in zip(batch.column("block"), batch.column("texts"), strict=True):
            parts = [np.zeros(0, np.uint64)]
            for piece in pa.ipc.open_stream(texts.as_buffer()):
                parts.append(np.unique(_block_grams(piece)[0]))
            found = np.unique(np.concatenate(parts)).view(np.int64)
            own = np.full(len(found), block.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found)], names=["block", "gram"])


def _scores(packed: pa.Table, known: pa.Table) -> pa.Table:
    """Base measures and score of one block's texts; ``known`` holds the logarithms of its n-grams."""
    hashes = known.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, values = hashes[order], known.column("log").to_numpy()[order].astype(np.int64)
    scored = []
    for piece in pa.ipc.open_stream(packed.column("texts")[0].as_buffer()):
        measures = base_measures(*textbytes.utf8(piece.column("text")))
        gram, *_, ends = _block_grams(piece)
        size = np.diff(ends)
        # Sums of whole numbers: equal texts score equally wherever they stand.
        logs = values[np.searchsorted(hashes, gram)] if len(gram) else np.zeros(0, np.int64)
        mean = -_sums(logs, ends) / FINE / np.maximum(size, 1)
        columns = [piece.column("doc_id"), piece.column("lang"), piece.column("key")]
        columns += [pa.array(measures[k].astype(np.int64)) for k in BASE]
        columns.append(pa.array(mean, pa.float64(), mask=size == 0))
        scored.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "key", *BASE, "score"]))
    return pa.Table.from_batches(scored)


def _scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Base measures and score of all rows. Packed texts are stored in buckets by block and stay there:
    what the model says about a block's n-grams comes to its bucket."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    rows = rows.select("doc_id", "lang", "key", _tongue(F.col("lang")).alias("tongue"), "text")
    path = new_path(spark, "blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = min(MAX_BUCKETS, size // BUCKET_BYTES + 8)
    packed = rows.mapInArrow(_packed, "block long, texts binary")
    packed.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    asked = blocks.mapInArrow(_asked, "block long, gram long")
    known = asked.join(model, "gram").select("block", "gram", "log")
    schema = "doc_id long, lang string, key long, " + ", ".join(f"{k} long" for k in BASE) + ", score double"
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scores, schema)


def _different(rows: DataFrame) -> DataFrame:
    """One row of each language and text; only repeated texts are moved."""
    seen = rows.groupBy(F.col("lang").alias("__lang"), F.col("key").alias("__key")).agg(F.count("*").alias("n"))
    twice = keep(seen.where("n > 1").drop("n"), "repeated-texts")
    same = (F.col("key") == F.col("__key")) & F.col("lang").eqNullSafe(F.col("__lang"))
    once = rows.join(twice, same, "left_anti")
    return once.union(rows.join(twice, same, "left_semi").dropDuplicates(["lang", "key"]))


def _bands(scored: DataFrame, score: str, reach: float) -> DataFrame:
    """(band_lang, low, high) from one score of each different text of a language."""
    texts = scored.groupBy("lang", "key").agg(F.min(score).alias("score"))
    q = F.percentile_approx("score", [0.25, 0.5, 0.75], 10_000).alias("q")
    distance = F.greatest(F.col("q")[2] - F.col("q")[0], LEAST_DISTANCE * F.col("q")[1])
    return texts.groupBy(F.col("lang").alias("band_lang")).agg(q).select(
        "band_lang",
        (F.col("q")[0] - reach * distance).alias("low"),
        (F.col("q")[2] + reach * distance).alias("high"),
    )


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    reach: float = 2.0,
) -> DataFrame:
    """Base columns, base_failed, perplexity and kept per row of ``docs``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        text_key(F.col(text_col)).alias("key"),
    )
    log = F.round(F.log("p_others") * FINE).cast("int").alias("log")
    model = train(_different(rows)).select("gram", log).repartitionByRange("gram").sortWithinPartitions("gram")
    scored = keep(_scored(rows, keep(model, "model")), "scores")
    bands = keep(_bands(scored, "score", reach), "bands")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    inside = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").select(
        "doc_id",
        *BASE,
        failed.alias("base_failed"),
        F.exp("score").alias("perplexity"),
        (~failed & inside).alias("kept"),
    )
