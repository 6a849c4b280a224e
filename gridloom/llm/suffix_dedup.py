"""Byte strings that repeat in a corpus, by two-stage suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.
Beside that, passages are reported: the string from a place to the end of the 50th
word that it touches (PASSAGE_WORDS; WINDOW bytes at least, LENGTH at most) is one if
its bytes also start anywhere else.

The corpus is cut so that equal strings meet.  A window is WINDOW bytes at any place
of a text; its minimizer is the K-byte string in it with the least hash (the leftmost
of equals), so equal windows have equal minimizers.  Consecutive windows with one
minimizer form a piece, with the bytes that follow up to LENGTH from its last window.
Pieces with the same bytes are one class, which counts as often as they occur; copies
of texts fall together here.  Classes whose minimizer occurs once in the corpus hold
no repeated string.  The others are brought together by minimizer and suffix-sorted:

1. Suffixes smaller than their successors (in order of bytes) are sorted directly.
2. Buckets of first bytes are scanned in ascending order; every suffix met induces
   its predecessor, if that is larger than it, at the next place of its own bucket.
3. The common prefixes of neighbours in the order are computed, byte by byte; a place
   repeats if one of them is as long as its string.

A minimizer with more than GROUP_CLASSES classes (a passage in that many different
surroundings) is split before it is sorted.  Windows are equal only if the minimizer
stands at the same distance in them, so classes are cut at ranges of that distance,
and the cuts are brought together by the bytes that all windows of a range share:
cuts inside the passage become one class, those at its edges have different keys.  What
is still too frequent is cut again, down to single strings, which are equal or not.
So no task gathers a passage's surroundings, and every repeat comes out of the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, use_package, written

LENGTH = 400
PASSAGE_WORDS = 50
#: Bytes that strings must share to be brought together, and of a minimizer.
WINDOW, K = 256, 32
#: Bytes of a text looked at together, and bytes of classes sorted together.
CHUNK_BYTES, BLOCK_BYTES = 1_000_000, 1_000_000
#: Classes of one key that meet in a sort, about a block; more are split by ranges of so many distances.
GROUP_CLASSES = 2000
SPLITS = (16, 1)

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: `at` is the minimizer's place in the piece; (minimizer, h) names its class.
PIECES = "doc_id long, text_hash long, start int, n_windows int, at int, minimizer long, h long"
CLASSES = "key long, h long, n long, n_classes long, n_windows int, at int, bytes binary"


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of every stretch of `size` bytes."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(_ODD))]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - size, np.uint64(_INVERSE))]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_CODES[codes] * up, dtype=np.uint64)])
    found = (sums[size:] - sums[: n - size + 1]) * down
    found ^= found >> np.uint64(32)
    return found * np.uint64(0xD6E8FEB86659FD93)


def _pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimizer's place and hash of each piece of a stretch of text."""
    hashes = _rolling(np.frombuffer(raw, np.uint8), K)
    place = np.uint64((1 << 24) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    span = WINDOW - K + 1
    n = len(keys) - span + 1
    padded = np.concatenate([keys, np.full(-len(keys) % span, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = (least[first] & place).astype(np.int64)
    return first, np.diff(np.append(first, n)), at, hashes[at]


def _class_hash(part: bytes, n_windows: int, at: int) -> int:
    return xxhash.xxh3_64_intdigest(part, n_windows << 12 | at)


def pieces(rows: DataFrame) -> DataFrame:
    """A row of PIECES for each piece of (doc_id, text_hash, text)."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            waiting = 0
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                for low in range(0, len(raw) - WINDOW + 1, CHUNK_BYTES):
                    first, n, at, minimizer = _pieces(raw[low : low + CHUNK_BYTES + WINDOW - 1])
                    at = at - first
                    start = first + low
                    ends = (start + n + LENGTH - 1).tolist()
                    own = zip(start.tolist(), ends, n.tolist(), at.tolist(), strict=True)
                    h = np.array([_class_hash(raw[a:b], k, m) for a, b, k, m in own], np.uint64)
                    k = len(first)
                    for values, x in zip(out, ([doc_id] * k, [text_hash] * k, start, n, at, minimizer.view(np.int64), h.view(np.int64)), strict=True):
                        values.append(x)
                    waiting += k
                if waiting > 50_000:
                    yield block(out)
                    out, waiting = [[] for _ in names], 0
            yield block(out)

    def block(out: list[list]) -> pa.RecordBatch:
        ids = [pa.array([x for part in c for x in part], pa.int64()) for c in out[:2]]
        kinds = (np.int32, np.int32, np.int32, np.int64, np.int64)
        rest = [pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k)) for c, k in zip(out[2:], kinds, strict=True)]
        return pa.record_batch([*ids, *rest], names)

    return rows.mapInArrow(run, PIECES)


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The order of the wanted places' suffixes by two-stage sorting.

    `text` holds bytes plus one, as int16, and a zero behind each piece; a suffix goes
    to that zero.  `wanted` marks places.
    """
    n = len(text)
    change = np.append(np.sign(np.diff(text)), 1).astype(np.int8)  # > 0: smaller than its successor
    unlike = np.where(change != 0, np.arange(n), n - 1)
    change = change[np.minimum.accumulate(unlike[::-1])[::-1]]
    small = (change > 0) | (text == 0)
    # larger suffixes are induced from their successors, up to one that is sorted directly
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    edges = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(edges, at, 1)
    np.add.at(edges, next_small[at] + 1, -1)
    used = np.cumsum(edges[:-1]) > 0
    induced = used & ~small

    direct = np.flatnonzero(used & small)
    first = text[direct]
    by_first = np.argsort(first, kind="stable")
    direct = direct[by_first]
    cuts = np.searchsorted(first[by_first], np.arange(258))
    ends = np.flatnonzero(text == 0)
    stop = ends[np.searchsorted(ends, direct)]
    raw = (text - 1).astype(np.uint8).tobytes()
    for low, high in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):  # strings of one bucket at a time
        if high - low > 1:
            strings = [raw[a:b] for a, b in zip(direct[low:high].tolist(), stop[low:high].tolist(), strict=True)]
            direct[low:high] = direct[low:high][sorted(range(high - low), key=strings.__getitem__)]
    inbox: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    for c in range(257):
        mine = inbox[c]
        fresh = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        bucket = [fresh]
        while len(fresh):  # runs of one byte: predecessors in this bucket
            before = fresh - 1
            before = before[before >= 0]
            fresh = before[induced[before] & (text[before] == c)]
            bucket.append(fresh)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        order.append(whole)
        before = whole - 1
        before = before[before >= 0]
        before = before[induced[before]]
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        if not len(byte):
            continue
        by_byte = np.argsort(byte, kind="stable")
        before, byte = before[by_byte], byte[by_byte]
        starts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        for low, high in zip(starts, [*starts[1:], len(byte)], strict=True):
            inbox[byte[low]].append(before[low:high])
    found = np.concatenate(order) if order else np.zeros(0, np.int64)
    return found[wanted[found]]


def common_prefixes(raw: bytes, stop: np.ndarray, order: np.ndarray, least: int, most: int) -> np.ndarray:
    """Common prefix, in bytes, of each place in `order` with the place before it there.

    Strings go to `stop` (of their first place) and are at least `least` long; prefixes
    shorter than `least` come out as 0, longer ones than `most` as `most`.  Places that
    follow each other in the text often follow each other's neighbours too: such a stretch
    is compared once, as a whole.
    """
    found = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return found
    data = np.frombuffer(raw, np.uint8)
    maybe = np.arange(1, len(order))
    for k in {0, max(0, least - 8)} if least >= 8 else ():  # most neighbours differ in their first or last eight bytes
        eight = np.lib.stride_tricks.as_strided(data[k:], (len(data) - k - 7, 8), (1, 1)).copy().view(np.uint64)[:, 0]
        maybe = maybe[eight[order[maybe - 1]] == eight[order[maybe]]]
    by_place = maybe[np.argsort(order[maybe])]
    if not len(by_place):
        return found
    here, other = order[by_place], order[by_place - 1]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(here) != 1) | (np.diff(other) != 1)]))
    room = np.minimum(stop[here] - here, stop[other] - other)
    lengths = np.zeros(len(here), np.int64)
    for low, high in zip(new.tolist(), [*new[1:].tolist(), len(here)], strict=True):
        while low < high:
            a, b, size = int(here[low]), int(other[low]), min(int(room[low]), high - low - 1 + most)
            same = size
            if raw[a : a + size] != raw[b : b + size]:
                same = int(np.argmax(data[a : a + size] != data[b : b + size]))
            n = min(high - low, max(1, same - least + 1))  # from the first place on as long as prefixes are long enough
            lengths[low : low + n] = same - np.arange(n)
            low += n
    found[by_place] = np.where(lengths >= least, np.minimum(lengths, most), 0)
    return found


def passage_lengths(raw: bytes, starts: np.ndarray, stop: np.ndarray, clipped: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bytes of the passage that starts at each of the places: to the end of its 50th word.

    `starts` and `stop` are those of joined parts, one byte apart; `clipped`: the text ends
    where the part ends, and so does its last word.
    """
    white = np.append(_WHITE[np.frombuffer(raw, np.uint8)], True)
    white[stop] = clipped
    word = ~white[:-1]
    word[stop] = False
    ends = np.flatnonzero(word & white[1:]) + 1
    at = np.searchsorted(ends, places, "right") + PASSAGE_WORDS - 1
    last = np.append(ends, len(raw) + LENGTH)[np.minimum(at, len(ends))]
    last = np.where(last > stop[np.searchsorted(starts, places, "right") - 1], places + LENGTH, last)
    return np.clip(last - places, WINDOW, LENGTH)


def repeats(parts: list[bytes], counts: list[int], n_windows: list[int]) -> list[tuple[bytes, bytes]]:
    """For each class (its bytes, occurrences, windows): runs of repeated strings and of passages."""
    sizes = np.array([len(x) + 1 for x in parts])
    stop = np.cumsum(sizes) - 1
    starts = stop + 1 - sizes
    raw = b"\0".join([*parts, b""])
    text = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    text[stop] = 0
    edges = np.zeros(len(text) + 1, np.int32)
    edges[starts] += 1
    np.add.at(edges, starts + n_windows, -1)
    wanted = np.cumsum(edges[:-1]) > 0
    order = suffix_order(text, wanted)
    to = np.repeat(stop, sizes)
    prefix = common_prefixes(raw, to, order, WINDOW, LENGTH)
    longest = np.zeros(len(text), np.int64)
    longest[order] = np.maximum(prefix, np.append(prefix[1:], 0))
    several = np.repeat(np.array(counts) > 1, sizes) & wanted
    room = to - np.arange(len(text))
    longest[several] = np.minimum(room, LENGTH)[several]
    places = np.flatnonzero(longest)
    clipped = sizes - 1 < np.array(n_windows) - 1 + LENGTH
    size = passage_lengths(raw, starts, stop, clipped, places)
    whole = places[longest[places] >= LENGTH]
    some = (longest[places] >= size) & (size <= room[places])
    runs = _runs(whole, np.full(len(whole), LENGTH), starts)
    return list(zip(runs, _runs(places[some], size[some], starts), strict=True))


def _runs(places: np.ndarray, size: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """First byte and end of each run of places (ascending), for each part from its start, as uint32 pairs."""
    if not len(places):
        return [b""] * len(starts)
    part = np.searchsorted(starts, places, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (np.diff(part) != 0)]))
    last = np.append(first[1:], len(places)) - 1
    pairs = (np.stack([places[first], places[last] + size[last]], axis=1) - starts[part[first], None]).astype("<u4").tobytes()
    cuts = 8 * np.searchsorted(part[first], np.arange(len(starts) + 1))
    return [pairs[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _zipped(rows: DataFrame) -> DataFrame:
    """Texts as compressed bytes, for shuffles: doc_id, text_hash, zipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            zipped = [packer.compress((x.as_py() or "").encode()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(zipped, pa.binary())], ["doc_id", "text_hash", "zipped"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, zipped binary")


def _with_list(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Zipped texts joined with `lists` (doc_id, text_hash, list)."""
    other = lists.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    return _zipped(rows).join(other, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), how)


def _class_bytes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """A row of CLASSES for each class (minimizer, h, n, n_classes, rep), cut from one of its texts."""
    lists = classes.groupBy("rep.doc_id", "rep.text_hash").agg(F.collect_list(F.struct("minimizer", "h", "n", "n_classes", "rep.n_windows", "rep.at", "rep.start")).alias("list"))
    names = [x.split()[0] for x in CLASSES.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for zipped, items in zip(batch.column(0), batch.column(1), strict=True):
                raw = unpacker.decompress(zipped.as_py())
                parts = items.values.flatten()
                start, n = parts[6].to_numpy(), parts[4].to_numpy()
                cut = [raw[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]
                yield pa.record_batch([x.cast(t) for x, t in zip([*parts[:6], pa.array(cut, pa.binary())], kinds, strict=True)], names)

    return _with_list(rows, lists, "inner").select("zipped", "list").mapInArrow(run, CLASSES)


def _sorted_blocks(classes: DataFrame) -> DataFrame:
    """key, h, runs, passages of the classes (CLASSES) that repeat, brought together by key."""
    names = ["key", "h", "runs", "passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            found = repeats([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows]) if rows else []
            some = [(r[0], r[1], *f) for r, f in zip(rows, found, strict=True) if any(f)]
            cols = list(zip(*some, strict=True)) if some else [[]] * 4
            return pa.record_batch([pa.array(list(c), pa.binary() if i > 1 else pa.int64()) for i, c in enumerate(cols)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield block()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        yield block()

    dealt = classes.select("key", "h", "n", "n_windows", "bytes").repartition("key").sortWithinPartitions("key", "h")
    return dealt.mapInArrow(run, "key long, h long, runs binary, passages binary")


def _split(classes: DataFrame, size: int) -> DataFrame:
    """Cuts of classes at ranges of `size` distances to the minimizer: p_key and p_h (the class), shift, CLASSES.

    Windows of a cut share the bytes from its last window to the end of its first; that is
    the key.  Cuts of one window are whole strings, one of LENGTH and its passage, and each
    its own key.
    """
    names = ["p_key", "p_h", "shift", *(x.split()[0] for x in CLASSES.split(", ") if "n_classes" not in x)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def cuts(n_windows: int, at: int, part: bytes) -> Iterator[tuple]:
        sizes = None
        if size == 1:
            clipped = np.array([len(part) < n_windows - 1 + LENGTH])
            sizes = passage_lengths(part + b"\0", np.array([0]), np.array([len(part)]), clipped, np.arange(n_windows))
        for low in range((at - n_windows + 1) // size * size, at + 1, size):
            first, last = max(0, at - low - size + 1), min(n_windows - 1, at - low)
            if first > last:
                continue
            n, to = last - first + 1, at - first
            if sizes is None:
                own = part[first : last + LENGTH]
                core = part[at - low : at - low - size + 1 + WINDOW]
                yield first, xxhash.xxh3_64_intdigest(core, low), _class_hash(own, n, to), n, to, own
                continue
            for end in {LENGTH, int(sizes[first])}:
                if len(own := part[first : first + end]) == end:
                    h = _class_hash(own, n, to)
                    yield first, h, h, n, to, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, h, count, n_windows, at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, h, first, _signed(k), _signed(x), count, n, to, own) for first, k, x, n, to, own in cuts(n_windows, at, part)]
                if len(rows) > 5_000:
                    yield block(rows)
                    rows = []
            yield block(rows)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    fields = "p_key long, p_h long, shift int, " + CLASSES.replace("n_classes long, ", "")
    return classes.select("key", "h", "n", "n_windows", "at", "bytes").mapInArrow(run, fields)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _repeating(classes: DataFrame, group_classes: int, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """key, h and list of the written CLASSES that repeat: an array of (shift, runs, passages), counted from shift."""
    fits = (F.col("n_classes") <= group_classes) if splits else F.lit(True)
    found = _sorted_blocks(classes.where(fits)).select("key", "h", F.array(F.struct(F.lit(0).alias("shift"), "runs", "passages")).alias("list"))
    hot = classes.where(~fits)
    if not splits or not hot.limit(1).count():
        return found
    parts = written(_split(hot, splits[0]), "cuts")
    one = parts.groupBy("key", "h").agg(F.sum("n").alias("n"), F.first(F.struct("n_windows", "at", "bytes")).alias("one"))
    groups = parts.groupBy("key").agg(F.count_distinct("h").alias("n_classes"), F.sum("n").alias("total")).where("total > 1").drop("total")
    again = written(one.join(groups, "key").select("key", "h", "n", "n_classes", "one.n_windows", "one.at", "one.bytes"), "classes")
    inner = written(_repeating(again, group_classes, splits[1:]), "inner")
    back = parts.select("p_key", "p_h", "shift", "key", "h").join(inner, ["key", "h"])
    moved = F.transform("list", lambda x: F.struct((x["shift"] + F.col("shift")).alias("shift"), x["runs"].alias("runs"), x["passages"].alias("passages")))
    whole = back.select("p_key", "p_h", moved.alias("list")).groupBy("p_key", "p_h").agg(F.flatten(F.collect_list("list")).alias("list"))
    return found.union(whole)


def spans(at: np.ndarray, runs: list[bytes]) -> np.ndarray:
    """Byte spans (first, end) that runs cover, merged; `at` are the places that they count from."""
    pairs = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return pairs
    pairs += np.repeat(at, [len(r) // 8 for r in runs])[:, None]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    first, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return np.stack([first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, spans array<array<long>>, passages array<array<long>>, kept binary"


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group_classes: int = GROUP_CLASSES) -> DataFrame:
    """A row of RESULT for every document.

    spans are the removed bytes (first, end) and kept the others, which needn't be UTF-8;
    passages are spans of passages, removed or not, that the document shares with
    another place.  Null and empty texts and those of fewer than WINDOW bytes keep all.
    Equal rows count as two occurrences and come out alike.
    """
    use_package(docs.sparkSession)
    rows = columns(docs, doc_id=id_column, text=text_column).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = written(pieces(rows), "pieces")
    by_class = found.groupBy("minimizer", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "n_windows", "at")).alias("rep"))
    groups = by_class.groupBy("minimizer").agg(F.sum("n").alias("total"), F.count("*").alias("n_classes")).where("total > 1").drop("total")
    classes = written(_class_bytes(rows, by_class.join(groups, "minimizer")), "classes")
    runs = written(_repeating(classes, group_classes), "runs").withColumnRenamed("key", "minimizer")
    marked = found.join(runs, ["minimizer", "h"]).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "list")).alias("list"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    lists = pa.list_(pa.list_(pa.int64()))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), lists, lists, pa.binary()]

    none = np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, zipped, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, gone, shared = unpacker.decompress(zipped.as_py()), none, none
                if items.is_valid:
                    start, marks = items.values.flatten()
                    shift, runs, passages = marks.flatten().flatten()
                    at = np.repeat(start.to_numpy(), marks.value_lengths().to_numpy()) + shift.to_numpy()
                    gone, shared = spans(at, runs.to_pylist()), spans(at, passages.to_pylist())
                edges = [0, *gone.ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(shared), int((shared[:, 1] - shared[:, 0]).sum()), gone.tolist(), shared.tolist(), kept)
                for values, x in zip(out, row, strict=True):
                    values.append(x)
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return _with_list(rows, marked, "left").select("doc_id", "zipped", "list").mapInArrow(run, RESULT)
