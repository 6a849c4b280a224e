"""Mixture-controlled packing of token ids into sequences of a fixed length.

Every source is a queue of its documents, in order of id; a document of more than
UNIT_IDS ids is dealt in units of that many.  Deficit round-robin serves the queues in
rounds: each round adds a queue's share of a window (its quantum) to its credit, and
the queue is served its next units while the credit lasts; what a unit takes beyond
the credit, or leaves of it, is carried to the next round.  The units of all rounds in
order, and inside a round of all sources, are one stream, and each window is LENGTH ids
of it: every window is full, and a document is cut where its units or a window end.
When a queue is empty the others keep their quanta, and so their proportions.

No task serves all rounds.  The credit that a queue has been given by a round is the
round's number times the quantum, so a unit's round follows from its place in its
queue alone: it is the first at whose start the credit covers all units before it and
a fixed part of the unit (a part of its source's own, by hash, so that sources smaller
than a quantum don't all wait for the same round).  Places in queues are running totals
over (part, source) rows; places in the stream are running totals of rounds, by ranges
of rounds and over them.  So deficits cross windows and partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, shuffled, use_package, written
from .token_blocks import in_order
from .tokens import encoder

LENGTH = 2048
#: Ids of a document that are served together at most.
UNIT_IDS = 512
#: Weights are whole numbers of these steps, so that their sum is the same in any order.
WEIGHT_STEPS = 1 << 20
#: Rounds that are numbered together.
RANGE_ROUNDS = 512

ENCODED = "part int, row long, source string, doc_id long, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Ids of every document, and how many of its source come before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        so_far: dict[str, int] = {}
        done = part << 40
        for batch in batches:
            names, sources, ids, before = [], [], [], []
            size = 0
            triples = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode(x.as_py() for x in batch.column(2)), strict=True)
            for name, source, got in triples:
                got = np.append(got, np.uint32(end_id))
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + len(got)
                names.append(name)
                sources.append(source)
                ids.append(got)
                size += len(got)
                if size > 1 << 20:
                    yield block(part, done, sources, names, before, ids)
                    done += len(ids)
                    names, sources, ids, before, size = [], [], [], [], 0
            if ids:
                yield block(part, done, sources, names, before, ids)
                done += len(ids)

    def block(part: int, row: int, sources: list, names: list, before: list, ids: list) -> pa.RecordBatch:
        cols = [pa.array([part] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(sources, pa.string()), pa.array(names, pa.int64()), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([_bytes(x) for x in ids], pa.binary())]
        return pa.record_batch(cols, ["part", "row", "source", "doc_id", "before", "n_tokens", "ids"])

    rows = columns(docs, doc_id=id_column, source=source_column, text=text_column)
    rows = in_order(rows.withColumn("source", F.coalesce("source", F.lit("")))).select("doc_id", "source", "text")
    return written(rows.mapInArrow(run, ENCODED), "encoded")


def _bytes(ids: np.ndarray) -> bytes:
    """Two bytes an id and a zero byte where all fit, else four and a one."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\0" if small else b"\1") + ids.astype("<u2" if small else "<u4").tobytes()


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] else "<u2", -1, 1).astype("<u4")


def quanta(totals: DataFrame, length: int, targets: dict[str, float] | None, temper: float) -> DataFrame:
    """source, n (its ids), quantum (ids a round) and first (the round that serves it first).

    Shares are `targets`, relative to each other; sources without one follow when those
    are empty.  Without targets the share of a source of n ids is n ** temper of the sum.
    """
    sums = totals.groupBy("source").agg(F.sum("n").alias("n"))
    steps = lambda x: F.greatest(F.round(x * WEIGHT_STEPS), F.lit(1.0)).cast("decimal(38,0)")
    named = F.lit(None).cast("decimal(38,0)")
    if targets is not None:
        if not targets or min(targets.values()) < 0 or not any(targets.values()):
            raise ValueError("targets must be weights of 0 or more, and one above 0")
        pairs = [F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))]
        named = F.element_at(F.create_map(*pairs), F.col("source"))
        named = F.when(named > 0, steps(named))
    rows = sums.withColumn("named", named).withColumn("weight", F.coalesce("named", steps(F.pow("n", F.lit(1.0 if targets is not None else float(temper))))))
    rows = rows.withColumn("late", F.lit(targets is not None) & F.col("named").isNull())
    whole = rows.groupBy("late").agg(F.sum("weight").cast("double").alias("all"), F.max(F.col("n") / F.col("weight").cast("double")).alias("longest"))
    whole = whole.select("late", "all", (F.floor(F.col("longest") * F.col("all") / length) + 1).alias("rounds"))
    each = rows.join(whole.drop("rounds"), "late")
    waits = whole.where(~F.col("late")).select(F.lit(True).alias("late"), "rounds")  # a row, or none
    each = each.join(waits, "late", "left")
    return each.select("source", "n", (F.col("weight").cast("double") / F.col("all") * length).alias("quantum"), F.coalesce("rounds", F.lit(0)).alias("first"))


def served(table: DataFrame, length: int, targets: dict[str, float] | None, temper: float, unit_ids: int) -> DataFrame:
    """row, units: an array of (start, size, place) for each document, the place being that in the stream."""
    totals = table.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    bases = bases.join(quanta(totals, length, targets, temper), "source")
    docs = table.select("part", "source", "row", "before", "n_tokens")
    docs = shuffled(docs).join(bases, ["part", "source"])
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(unit_ids).cast("long"))).alias("start")
    units = docs.select("row", "source", "quantum", "first", "n_tokens", (F.col("base") + F.col("before")).alias("low"), starts)
    part_of_unit = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    units = units.withColumn("size", F.least(F.lit(unit_ids).cast("long"), F.col("n_tokens") - F.col("start")))
    round_ = F.floor((F.col("low") + F.col("start") + part_of_unit * F.col("size")) / F.col("quantum")) + F.col("first")
    units = units.select("row", "source", "start", "size", (F.col("low") + F.col("start")).alias("at"), round_.alias("round"), F.floor(round_ / RANGE_ROUNDS).alias("range"))
    units = written(units, "units")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = units.groupBy("range").agg(F.sum("size").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_base"))
    inside = Window.partitionBy("range").orderBy("round", "source", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, "range")
    one = F.struct("start", "size", (F.col("range_base") + F.col("inner")).alias("place"))
    return placed.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("units"))


def cuts(units: list[dict], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, size, sequence, offset) of the pieces of a document; neighbours in one window are one piece."""
    merged: list[list[int]] = []
    for u in units:
        if merged and merged[-1][2] + merged[-1][1] == u["place"]:
            merged[-1][1] += u["size"]
        else:
            merged.append([u["start"], u["size"], u["place"]])
    for start, size, place in merged:
        while size:
            n = min(size, length - place % length)
            yield start, n, place // length, place % length
            start, size, place = start + n, size - n, place + n


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1, targets: dict[str, float] | None = None, temper: float = 1.0,
    unit_ids: int = UNIT_IDS, with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """Pieces of documents and their places in sequences; `sequences` joins them.

    One row for each piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.  All sequences are
    full but the last.  `targets` and `temper` are those of `quanta`.  A null text is an
    empty one (its end id alone), a null source and an empty one are the same source,
    equal rows are packed each; targets of absent sources count for nothing.
    """
    use_package(docs.sparkSession)
    table = encoded(docs, tokenizer, end_id, id_column, text_column, source_column)
    units = served(table, length, targets, temper, unit_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, n, raw, parts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ids = _ids(raw)
                for start, size, sequence, offset in cuts(parts, length):
                    piece = ids[start : start + size]
                    row = (doc_id, start, size, zlib.crc32(piece.tobytes()), n, sequence, offset, piece)
                    for values, x in zip(out, row):
                        values.append(x)
                if len(out[0]) > 50_000:
                    yield block(out)
                    out = [[] for _ in out]
            yield block(out)

    def block(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [*(x.split()[0] for x in PIECES.split(", ")), "ids"][: len(out)])

    placed = shuffled(table.select("row", "doc_id", "n_tokens", "ids")).join(units, "row").select("doc_id", "n_tokens", "ids", "units")
    return placed.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, ids (padded to `length`), doc_ids, n_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_ids"))
    pad = F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_ids")).cast("int"))
    return rows.select("sequence_id", F.concat(F.flatten("p.ids"), pad).alias("ids"), F.array_distinct("p.doc_id").alias("doc_ids"), "n_ids")
