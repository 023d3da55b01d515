"""Removal of long byte strings that occur more than once, by suffix arrays.

Every byte covered by a ``length``-byte string that also starts anywhere else,
in the same text or in another, is removed.  Strings are judged on the input.

No suffix array of a whole corpus fits one task, so starts are first brought
together by content.  The anchor of a start is the smallest hashed ``gram``-byte
string inside its ``length`` bytes, the leftmost on ties; equal strings have
equal anchors at equal offsets.  A text so falls into runs of starts with the
same anchor, and only anchors that occur twice can hold repeats.  A run's
segment is the text of its starts.  Equal segments of an anchor are aggregated:
two copies stand for any number.

Segments meet by anchor, and each batch of anchors gets a suffix array by
two-stage sorting: suffixes smaller than their successors are sorted directly,
the others are induced by a scan over the buckets of first bytes.  Adjacent
common prefixes of ``length`` bytes mark repeated starts.

A group of over ``group_bytes`` bytes is divided before it is sorted, so that no
task holds more.  Equal strings lie at equal distances before their anchor, so a
segment is cut into pieces by that distance, ``width`` distances each.  All
strings of a piece share its middle, ``length - width + 1`` bytes; pieces meet by
it, equal pieces are aggregated again, and a middle found once ends there.  What
still is too large is divided at a quarter of the width, down to single strings,
which are all equal.  A segment that differs from the others in one place leaves
at most one piece a width undecided, so the rows grow with the segments only.

Defined results for odd input: a null text is empty; texts shorter than
``length`` lose nothing; each row is a text of its own, so a repeated row
repeats all its strings; a null id is an id; strings never cross texts; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.workspace import written

GRAM = 32
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
PAD = b"\xff" * 8  # no UTF-8 text holds this byte; a segment's last suffix is then smaller than its successor
WORDS = 8


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, np.uint64(base)
    while done < n:  # out[done:2 * done] = out[:done] * base ** done
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * step
            step = step * step
        done += more
    return out


class RollingHash:
    """Polynomial hashes of all substrings of a buffer, modulo 2 ** 64."""

    up = down = np.ones(1, dtype=np.uint64)

    def __init__(self, flat: np.ndarray) -> None:
        n = len(flat) + 1
        if len(RollingHash.up) < n:
            RollingHash.up = _powers(BASE, n)
            RollingHash.down = _powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, dtype=np.uint64)
        terms = flat.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.up[: n - 1]
        np.cumsum(terms, out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hashes of the ``width`` bytes at each position that has them."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.down[: len(out)]
        return out

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes, in place."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def anchored_runs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text number, anchor, segment hash, first, last.

    Text ``i`` is ``flat[starts[i]:ends[i]]``; texts follow one another without gaps.
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if len(flat) < length:
        return none
    rolling = RollingHash(flat)
    grams = mixed(rolling.every(gram))
    packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    low = window_minima(packed, length - gram + 1)
    valid = np.zeros(len(low) + 1, dtype=np.int8)
    long = ends - starts >= length
    if not long.any():
        return none
    valid[starts[long]] += 1
    valid[ends[long] - length + 1] -= 1
    at = np.nonzero(np.cumsum(valid[:-1]))[0]
    anchor = (low[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.nonzero(first)[0]
    end = np.concatenate([begin[1:], [len(at)]]) - 1
    lo, hi = at[begin], at[end]
    segment = mixed(rolling.at(lo, hi + length)) ^ (hi - lo).astype(np.uint64)
    text = np.searchsorted(starts, lo, side="right") - 1
    while (empty := ends[text] <= lo).any():
        text = text - empty
    return text, grams[anchor[begin]].view(np.int64), segment.view(np.int64), lo - starts[text], hi - starts[text]


def _run_finder(length: int):
    names = ["doc_id", "text_hash", "anchor", "segment", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for rows, flat, starts, ends, skipped in _chunks(batch.column("text"), length):
                text, anchor, segment, lo, hi = anchored_runs(flat, starts, ends, length)
                if len(text):
                    take = pa.array(rows[text])
                    arrays = [ids.take(take), hashes.take(take), pa.array(anchor), pa.array(segment), pa.array(lo + skipped), pa.array(hi + skipped)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _chunks(texts: pa.Array, length: int) -> Iterator[tuple]:
    """Whole texts in buffers of about CHUNK_BYTES; longer texts in pieces whose starts don't overlap."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_binary(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        size = int(offsets[j] - offsets[i])
        if j == i + 1 and size > CHUNK_BYTES:
            for at in range(0, size - length + 1, CHUNK_BYTES):
                piece = data[offsets[i] + at : min(offsets[i] + at + CHUNK_BYTES + length - 1, offsets[j])]
                yield np.array([i]), piece, np.array([0]), np.array([len(piece)]), at
        else:
            yield np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], 0
        i = j


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a byte later."""
    differs = np.nonzero(text[:-1] != text[1:])[0]
    if not len(differs):
        return np.ones(len(text), dtype=bool)
    nearest = np.searchsorted(differs, np.arange(len(text)))
    at = differs[np.minimum(nearest, len(differs) - 1)]
    out = text[at] < text[at + 1]
    out[nearest == len(differs)] = True
    return out


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a big-endian number."""
    padded = np.concatenate([text, np.full(WORDS, 255, dtype=np.uint8)]).astype(np.uint64)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def sort_directly(at: np.ndarray, words: np.ndarray, same: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of the ``depth`` bytes there, ties by position.

    ``same`` holds hashes of those bytes: a group in which all are equal is done.
    """
    keys = words[at]
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if len(at) else at
    active = np.arange(len(at))
    for skip in range(WORDS, depth, WORDS):
        if not len(active):
            break
        begin = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
        size = np.diff(np.concatenate([begin, [len(group)]]))
        hashes = same[at[active]]
        mixed_group = (np.minimum.reduceat(hashes, begin) != np.maximum.reduceat(hashes, begin)) & (size > 1)
        keep = np.repeat(mixed_group, size)
        active, group = active[keep], group[keep]
        if not len(active):
            break
        keys = words[np.minimum(at[active] + skip, len(words) - 1)]
        order = np.lexsort((keys, group))
        at[active] = at[active][order]
        keys, group = keys[order], group[order]
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]) | (group[1:] != group[:-1]))])
    return at


def induce(text: np.ndarray, seeds: np.ndarray, induced: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the sorted ``seeds``.

    ``induced`` says which positions are larger than their successor and wanted.
    Buckets of first bytes are scanned in order; what precedes a scanned suffix,
    if larger than it, goes to the end of its own bucket's first part.
    """
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    cuts = np.searchsorted(text[seeds], np.arange(257))
    out = []

    def before(scanned: np.ndarray) -> np.ndarray:
        scanned = scanned[scanned > 0] - 1
        return scanned[induced[scanned]]

    def deal(found: np.ndarray) -> None:
        first = text[found]
        order = np.argsort(first, kind="stable")
        found, first = found[order], first[order]
        ends = np.nonzero(np.concatenate([first[1:] != first[:-1], [True]]))[0] + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            waiting[first[a]].append(found[a:b])

    for c in range(256):
        scanned = np.concatenate(waiting[c]) if waiting[c] else seeds[:0]
        while len(scanned):
            out.append(scanned)
            found = before(scanned)
            own = text[found] == c
            if not own.all():
                deal(found[~own])
            scanned = found[own]
        own_seeds = seeds[cuts[c] : cuts[c + 1]]
        if len(own_seeds):
            out.append(own_seeds)
            found = before(own_seeds)
            if len(found):
                deal(found)
    return np.concatenate(out) if out else seeds


def repeated_starts(segments: list[bytes], length: int) -> np.ndarray:
    """Which starts of the segments repeat, all segments' starts in a row.

    A segment of ``n`` bytes has ``n - length + 1`` starts.
    """
    text = np.frombuffer(PAD.join(segments) + PAD, dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + len(PAD))[:-1]])
    last = begin + sizes - length
    small = smaller_than_successor(text)
    edge = np.zeros(len(text) + 1, dtype=np.int8)
    edge[begin] += 1
    edge[last + 1] -= 1
    start = np.cumsum(edge[:-1]).astype(bool)
    small_at = np.nonzero(small)[0]
    until = small_at[np.searchsorted(small_at, last)]  # the next directly sorted suffix after the last start
    edge[last + 1] += 1
    edge[until + 1] -= 1
    wanted = np.cumsum(edge[:-1]).astype(bool)
    words, rolling = words_at(text), RollingHash(text)
    same = rolling.every(length)
    same = np.concatenate([same, np.arange(len(text) - len(same), dtype=np.uint64)])
    seeds = sort_directly(np.nonzero(wanted & small)[0], words, same, length)
    order = induce(text, seeds, wanted & ~small)
    order = order[start[order]]
    repeated = np.zeros(len(text), dtype=bool)
    left, right = order[:-1], order[1:]
    maybe = same[left] == same[right]
    left, right = left[maybe], right[maybe]
    by_left = np.argsort(left, kind="stable")
    left, right = left[by_left], right[by_left]
    equal = common_prefix_reaches(text, words, left, right, length)
    repeated[left[equal]] = True
    repeated[right[equal]] = True
    return repeated[start]


def common_prefix_reaches(text: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether adjacent suffixes share ``length`` bytes; ``left`` ascends.

    A pair one byte after a pair that shares them needs its last byte compared only.
    """
    follows = np.concatenate([[False], (left[1:] == left[:-1] + 1) & (right[1:] == right[:-1] + 1)]) if len(left) else np.zeros(0, bool)
    equal = text[left + length - 1] == text[right + length - 1]
    heads = np.nonzero(~follows)[0]
    for skip in range(0, length, WORDS):
        skip = min(skip, length - WORDS)
        alive = equal[heads]
        equal[heads[alive]] = words[left[heads[alive]] + skip] == words[right[heads[alive]] + skip]
    # A failed link breaks the run after it, which is then compared in full.
    broken = np.nonzero(follows & ~np.concatenate([[True], equal[:-1]]))[0] if len(left) else heads
    for i in broken.tolist():
        equal[i] = bool((text[left[i] : left[i] + length] == text[right[i] : right[i] + length]).all())
    return equal


def _sorter(length: int, batch_bytes: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        segments, mine = [], []
        for *_, copies, content in rows:
            mine.append(len(segments))
            segments.extend([content] * min(2, copies))
        repeated = repeated_starts(segments, length)
        sizes = np.array([len(s) - length + 1 for s in segments])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        number = np.repeat(np.arange(len(segments)), sizes)
        on = np.concatenate([[False], repeated, [False]])
        new = np.concatenate([[True], number[1:] != number[:-1], [True]])
        first = np.nonzero(on[1:-1] & (~on[:-2] | new[:-1]))[0]
        last = np.nonzero(on[1:-1] & (~on[2:] | new[1:]))[0]
        of = number[first]
        row = np.searchsorted(np.array(mine), of, side="right") - 1
        own = np.array(mine)[row] == of
        first, last, of, row = first[own], last[own], of[own], row[own]
        anchors, keys, base = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
        base = base[row] - begin[of]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[row], keys[row], first + base, last + base)], names=["anchor", "segment", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, now = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("family", "anchor", "segment", "base", "copies", "content")), strict=True):
                if held > batch_bytes and row[0] != now:
                    yield flush(rows)
                    rows, held = [], 0
                now = row[0]
                rows.append(row)
                held += len(row[5]) * min(2, row[4])
        if rows:
            yield flush(rows)

    return run


def _anchor_places(length: int):
    """Where the anchor lies in each segment, which is one run of one anchor."""

    @F.pandas_udf("int")
    def places(contents: pd.Series) -> pd.Series:
        return pd.Series([anchor_place(np.frombuffer(c, dtype=np.uint8), length) for c in contents], dtype="int32")

    return places


def anchor_place(segment: np.ndarray, length: int, gram: int = GRAM) -> int:
    grams = mixed(RollingHash(segment).every(gram))
    packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    return int(packed[: length - gram + 1].min() & np.uint64(0xFFFFFF))


def widths(length: int, gram: int = GRAM) -> list[int]:
    """How many distances to the anchor a piece spans, division after division."""
    out = [1]
    while out[-1] * 4 <= length - gram + 1:
        out.append(out[-1] * 4)
    return out[::-1]


def pieces_of(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Each part cut at multiples of ``width`` distances to its anchor.

    Adds the key of a piece's middle (``family``) and of its whole.
    """
    starts = F.octet_length("content") - length + 1
    far, near = F.col("place"), F.col("place") - starts + 1  # distances of the first and the last start
    cell = F.explode(F.sequence(F.floor(near / width).cast("int"), F.floor(far / width).cast("int")))
    cut = parts.select("*", cell.alias("cell"))
    far = F.least("place", F.col("cell") * width + width - 1)
    near = F.greatest(F.col("place") - starts + 1, F.col("cell") * width)
    skip = F.col("place") - far
    middle = F.substring("content", F.col("place") - F.col("cell") * width + 1, F.lit(length - width + 1))
    cut = cut.select(
        "anchor", "segment", "copies", (F.col("base") + skip).alias("base"), far.alias("place"), (far - near).alias("more"),
        F.substring("content", skip + 1, far - near + length).alias("content"),
        F.struct("anchor", "cell", F.xxhash64(middle).alias("a"), F.xxhash64(F.lit(1), middle).alias("b")).alias("family"),
    )
    return cut.withColumn("whole", F.struct("place", "more", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b")))


def divided(parts: DataFrame, length: int, group_bytes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Families small enough to be sorted, and starts already known to repeat.

    ``parts`` (anchor, segment, copies, content) are the segments of large anchors.
    """
    small, marks = [], []
    hot = parts.select("*", F.lit(0).alias("base"), _anchor_places(length)("content").alias("place"))
    for width in widths(length):
        pieces = written(pieces_of(hot, width, length), "pieces")
        sample = F.min(F.struct("anchor", "segment", "base", "place", "content")).alias("one")
        wholes = written(pieces.groupBy("family", "whole").agg(F.sum("copies").alias("n"), sample), "piece-wholes")
        again = wholes.where("n > 1").select("family", "whole")
        marks.append(pieces.join(again, ["family", "whole"], "left_semi").select("anchor", "segment", F.col("base").cast("long").alias("first"), (F.col("base") + F.col("more")).cast("long").alias("last")))
        held = F.sum(F.octet_length("one.content") * F.least("n", F.lit(2)))
        open_ = wholes.groupBy("family").agg(F.count(F.lit(1)).alias("wholes"), held.alias("bytes")).where("wholes > 1")
        left = wholes.join(open_, "family").select(F.xxhash64("family").alias("family"), "one.*", F.least("n", F.lit(2)).alias("copies"), "bytes")
        left = written(left, "piece-families")
        small.append(left.where(F.col("bytes") <= group_bytes).select("family", "anchor", "segment", "base", "copies", "content"))
        hot = left.where(F.col("bytes") > group_bytes).select("anchor", "segment", "copies", "content", "base", "place")
        if hot.isEmpty():
            break
    return small, marks


def repeated_runs(keyed: DataFrame, length: int = 200, group_bytes: int = 1 << 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, text_hash, runs``: sorted runs of repeated starts per text.

    ``keyed`` has ``doc_id long, text_hash long, content binary``.
    """
    spark = keyed.sparkSession
    shaped = "doc_id long, text_hash long, anchor long, segment long, lo long, hi long"
    runs = keyed.select("doc_id", "text_hash", F.col("content").alias("text")).mapInArrow(_run_finder(length), shaped)
    shared = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    found = written(runs.join(shared, "anchor"), "anchor-runs")
    place = F.struct("doc_id", "text_hash", "lo", "hi")
    distinct = found.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("place"))
    distinct = written(distinct.select("anchor", "segment", F.least("copies", F.lit(2)).alias("copies"), "place.*"), "segments")
    size = F.sum((F.col("hi") - F.col("lo") + length) * F.col("copies"))
    large = written(distinct.groupBy("anchor").agg(size.alias("bytes")).where(F.col("bytes") > group_bytes).select("anchor", F.lit(True).alias("large")), "large-anchors")
    marked = distinct.join(large, "anchor", "left").fillna(False, ["large"])
    wanted = marked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "segment", "copies", "large", "lo", "hi")).alias("wanted"))

    ids = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["text_hash"] == wanted["text_hash"])
    piece = F.col("content").substr(F.col("w.lo").cast("int") + 1, (F.col("w.hi") - F.col("w.lo")).cast("int") + length)
    cut = keyed.join(wanted, ids).select("content", F.explode("wanted").alias("w")).select("w.anchor", "w.segment", "w.copies", "w.large", piece.alias("content"))
    cut = written(cut.dropDuplicates(["anchor", "segment"]), "segment-texts")

    small, marks = [cut.where("not large").select(F.col("anchor").alias("family"), "anchor", "segment", F.lit(0).alias("base"), "copies", "content")], []
    if not large.isEmpty():
        more, marks = divided(cut.where("large").select("anchor", "segment", "copies", "content"), length, group_bytes)
        small += more
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = reduce(DataFrame.unionAll, small).repartition(n, "family").sortWithinPartitions("family")
    marks.append(sorted_.mapInArrow(_sorter(length, batch_bytes), "anchor long, segment long, first long, last long"))
    again = reduce(DataFrame.unionAll, marks).groupBy("anchor", "segment").agg(F.collect_set(F.struct("first", "last")).alias("starts"))

    hits = found.join(written(again, "repeated-starts"), ["anchor", "segment"])
    moved = F.transform("starts", lambda r: F.struct((F.col("lo") + r["first"]).alias("first"), (F.col("lo") + r["last"]).alias("last")))
    return hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list(moved))).alias("runs"))


REMOVED = "struct<kept:binary,n_removed:long,n_spans:long>"


def drop_runs(content: bytes, runs, length: int) -> tuple[bytes, int, int]:
    """The bytes outside all runs; how many bytes and maximal runs went."""
    kept, at, spans, end = [], 0, 0, -1
    for run in runs:
        first, stop = run["first"], run["last"] + length
        if first > end:
            kept.append(content[at:first])
            spans += 1
        end = max(end, stop)
        at = end
    kept.append(content[at:])
    left = b"".join(kept)
    return left, len(content) - len(left), spans


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) per row."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(content).alias("text_hash"), content.alias("content"))
    runs = repeated_runs(keyed, length, **limits)

    @F.pandas_udf(REMOVED)
    def removed(contents: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [drop_runs(c, r if r is not None else (), length) for c, r in zip(contents, found, strict=True)]
        return pd.DataFrame({"kept": [r[0] for r in rows], "n_removed": [r[1] for r in rows], "n_spans": [r[2] for r in rows]})

    same = keyed["doc_id"].eqNullSafe(runs["doc_id"]) & (keyed["text_hash"] == runs["text_hash"])
    joined = keyed.join(runs, same, "left").select(keyed["doc_id"], "content", "runs")
    out = joined.withColumn("out", removed("content", "runs"))
    return out.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "out.n_removed", "out.n_spans", "out.kept")
