"""Removal of long repeated byte strings by an enhanced suffix array and its common-prefix interval tree.

A string of ``length`` bytes counts as repeated when it also starts anywhere else, in the same text or another. Each
window of that length has an anchor: the 100-byte gram in it with the least hash. Equal windows have equal anchors at
equal places, so windows need comparing only within an anchor. The windows of one occurrence of an anchor form a segment
of at most 700 bytes.

1. Every text gives its segments as narrow rows: anchor, hash of the segment, place. Periodic text (a run of one letter, a
   ruler) is a run of equal segments one after another, which is one row. Those whose anchor is met only once go.
2. Equal segments are counted. All windows of a segment that is there twice are repeated: exact and near copies, however
   many, end here as one row a task.
3. Where an anchor has several different segments, one copy of each is fetched. A task builds the suffix array of a batch
   of such groups by prefix doubling, finds the longest common prefixes of neighbours, and scans them with a stack: each
   interval of the tree is a set of suffixes with a common prefix; if the bytes to their left differ, it is a maximal
   repeat, given with all its occurrences.
4. An anchor with more than ``GROUP`` different segments is not brought into one task. Its windows are hashed instead and
   counted by (anchor, hash), with partial counts in every task. Segments and windows are told apart by two 64-bit hashes
   each: the anchor's and their own.
5. Ranges go back to the places of the segments, and each text is cut once.

Passages of over 50 words are often shorter than 400 bytes. They are found in the same way and nothing is cut for them:
the windows of ``PASSAGE`` words, from a word's first byte to another's last, have anchors and segments of their own, and
``n_shared`` counts the windows of a text that another row's text holds too.

Defined results: a null or short text loses nothing; a very long text is scanned whole, in pieces that overlap; where two
windows of an anchor tie, the later place counts in every copy; overlapping repeats count, so a run of one letter repeats itself;
rows repeated in full repeat each other and both lose their bytes; an empty table gives an empty result; what is left
need not be valid UTF-8 and is given as bytes; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import drop, materialize, release, with_rows

LENGTH = 400
GRAM = 100
PASSAGE = 51  #: words in a passage that is looked for in other texts
PASSAGE_GRAM = 8  #: and words in its anchor
SCAN_WORDS = 1 << 17  #: words scanned for anchors at once
GROUP = 2000  #: different segments of one anchor that a task takes at most
SCAN_BYTES = 1 << 20  #: text scanned for anchors at once
BATCH_BYTES = 1 << 20  #: segments in one suffix array, or one group
LOW = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values."""
    n = len(x)
    size = -(-n // width) * width
    full = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    table = full.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """row, first window, last window, anchor's place, anchor hash, segment hash of every segment of the texts."""
    gram = min(GRAM, length)
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), SCAN_BYTES):
        piece = data[at : at + SCAN_BYTES + length - 1]
        sums = words.prefix_hash(piece, lower=False)
        grams = words.mix((sums[gram:] - sums[:-gram]) * words.powers(len(sums))[1][: len(sums) - gram])
        place = np.arange(len(grams), dtype=np.uint64)
        best = sliding_min((grams & ~LOW) | (LOW - place), length - gram + 1)
        anchor = (LOW - (best & LOW)).astype(np.int64)
        edges = offsets[(offsets > at) & (offsets < at + len(piece))] - at
        valid = np.ones(len(anchor), bool)  # no window holds the end of a text
        change = np.zeros(len(anchor) + 1, np.int64)
        np.add.at(change, np.maximum(edges - length + 1, 0), 1)
        np.add.at(change, np.minimum(edges, len(anchor)), -1)
        valid = np.cumsum(change[:-1]) == 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        mark = words.mix(words.span_hash(sums, lo, hi + length) ^ (anchor[lo] - lo).astype(np.uint64))
        row = np.searchsorted(offsets, lo + at, "right") - 1
        parts.append((row, lo + at - offsets[row], hi + at - offsets[row], anchor[lo] + at - offsets[row], grams[anchor[lo]], mark))
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def passages(block: words.Block, k: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """row, first byte, end, windows, anchor hash, segment hash of every segment of the windows of k words."""
    found = words.split(block)
    n = len(found.starts) - k + 1
    parts = []
    for at in range(0, max(n, 0), SCAN_WORDS):
        m = min(SCAN_WORDS, n - at)
        starts, ends, row = (x[at : at + m + k - 1] for x in (found.starts, found.ends, found.row))
        base = starts[0]
        sums = words.prefix_hash(block.data[base : ends[-1]], lower=False)
        starts, ends = starts - base, ends - base
        grams = words.span_hash(sums, starts[: len(starts) - PASSAGE_GRAM + 1], ends[PASSAGE_GRAM - 1 :])
        best = sliding_min((grams & ~LOW) | (LOW - np.arange(len(grams), dtype=np.uint64)), k - PASSAGE_GRAM + 1)
        anchor = (LOW - (best & LOW)).astype(np.int64)
        valid = row[:m] == row[k - 1 :]
        new = (anchor[1:] != anchor[:-1]) | (row[1:m] != row[: m - 1])
        first, last = valid.copy(), valid.copy()
        first[1:] &= ~valid[:-1] | new
        last[:-1] &= ~valid[1:] | new
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        mark = words.mix(words.span_hash(sums, starts[lo], ends[hi + k - 1]) ^ (anchor[lo] - lo).astype(np.uint64))
        first_byte = block.offsets[row[lo]] - base
        parts.append((row[lo], starts[lo] - first_byte, ends[hi + k - 1] - first_byte, hi - lo + 1, grams[anchor[lo]], mark))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(common length, all places) of the maximal repeats of at least length bytes among the suffixes that begin at the
    first windows[i] bytes of each segment starts[i]..ends[i] of data. No suffix goes beyond its segment. A byte that no
    text holds (0xFF) follows each segment, so that suffixes which end do not sort by what stands behind them."""
    n = len(data)
    byte = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | byte[k : k + n]
    left = np.maximum(np.repeat(ends, np.diff(np.append(starts, n))) - np.arange(n), 0)  # bytes to the segment's end
    ranks = [np.unique(word, return_inverse=True)[1]]
    half = 8
    while 2 * half <= length:
        rank = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: n - half] = rank[half:] + 1
        ranks.append(np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1])
        half *= 2
    # the suffix array of the windows: by the first half bytes, the next, ... as far as any segment goes
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    rank = ranks[-1]
    longest = int((ends - starts).max()) if len(starts) else 0
    keys = [np.where(left[at] > d, rank[np.minimum(at + d, n - 1)], -1) for d in range(0, longest, half)]
    array = at[np.lexsort(keys[::-1])]
    # longest common prefixes of neighbours, by whole levels from the widest down, then by single bytes
    a, b = array[:-1], array[1:]
    room = np.minimum(left[a], left[b])
    common = np.zeros(len(a), np.int64)
    for level in [len(ranks) - 1] * (longest // half) + list(range(len(ranks) - 2, -1, -1)):
        width = 8 << level
        more = common + width <= room
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += width * (more & (ranks[level][i] == ranks[level][j]))
    for _ in range(7):
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += (common < room) & (data[i] == data[j])
    # roots: runs of neighbours with a common prefix of length; without different bytes to their left, none of their
    # intervals has them
    joined = common >= length
    edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.where(np.isin(array, starts), -1 - np.arange(len(array)), data[np.maximum(array - 1, 0)].astype(np.int64))
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    out = []
    for lo, hi in zip(first[changes[last] != changes[first]].tolist(), last[changes[last] != changes[first]].tolist()):
        out += [(size, array[x : y + 1]) for size, x, y in intervals(common[lo:hi].tolist(), lo) if changes[y] != changes[x]]
    return out


def intervals(common: list[int], at: int) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last) of the tree's intervals over suffixes at .. at+len(common), by a stack."""
    stack: list[tuple[int, int]] = []
    for k, size in enumerate([*common, 0], at):
        begin = k
        while stack and stack[-1][0] > size:
            top, begin = stack.pop()
            yield top, begin, k
        if size and (not stack or stack[-1][0] < size):
            stack.append((size, begin))


def covered(places: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for size, at in places:
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


PLACES = "anchor long, seg long, row long, lo int, end int, windows int, passage boolean, times int"


def folded(row: np.ndarray, lo: np.ndarray, windows: np.ndarray, anchor: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal segments of which each begins where the windows of the one before end, as in periodic text: the first
    of each run, and how many there are. A run's segments are as far apart as each has windows."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (mark[1:] == mark[:-1]) & (lo[1:] - lo[:-1] == windows[:-1]) & (windows[1:] == windows[:-1])
    first = np.flatnonzero(np.append(True, ~goes_on))
    return first, np.diff(np.append(first, len(row)))


def _places_task(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for block in words.blocks(batch.column("text")):
                row, lo, hi, _, anchor, mark = segments(block.data, block.offsets, length)
                for by_word, found in ((False, (row, lo, hi + length, hi - lo + 1, anchor, mark)), (True, passages(block))):
                    first, times = (np.arange(len(found[0])), np.ones(len(found[0]))) if by_word else folded(row, lo, hi - lo + 1, anchor, mark)
                    if len(first):
                        own, begins, ends, windows, anchors, marks = (x[first] for x in found)
                        ints = [pa.array(x.astype(np.int32)) for x in (begins, ends, windows)]
                        yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(marks.view(np.int64)), pa.array(ids[block.first + own]), *ints, pa.array(np.full(len(own), by_word)), pa.array(times.astype(np.int32))], ["anchor", "seg", "row", "lo", "end", "windows", "passage", "times"])

    return task


CONTENTS = "anchor long, seg long, n long, first long, last long, wide boolean, passage boolean, windows int, content binary"
CONTENT_NAMES = ["anchor", "seg", "n", "first", "last", "wide", "passage", "windows", "content"]


def _fetch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wants = batch.column("wants").to_pylist()
        data, at = words.buffers(batch.column("text"))
        out, size = [], 0
        for k, want in enumerate(wants):
            for x in want:
                content = data[at[k] + x["lo"] : at[k] + x["end"]].tobytes()
                out.append((*[x[c] for c in CONTENT_NAMES[:-1]], content))
                size += len(content)
                if size > 4 << 20:
                    yield _contents(out)
                    out, size = [], 0
        if out:
            yield _contents(out)


def _contents(rows: list) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], CONTENT_NAMES)


FOUND = "anchor long, seg long, ranges array<int>, shared int"


def _found(rows: list[tuple[int, int, list[int] | None, int | None]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "seg", "ranges", "shared"])


def packed(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments one after another, 0xFF after each; where they start and end."""
    size = np.array([len(x) for x in contents])
    starts = np.cumsum(size + 1) - size - 1
    return np.frombuffer(b"\xff".join([*contents, b""]), np.uint8), starts, starts + size


def passage_hashes(contents: list[bytes], k: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """The segment and the hash of each window of k words."""
    data, starts, ends = packed(contents)
    found = words.split(words.Block(0, np.where(data == 0xFF, np.uint8(32), data), np.append(starts, len(data))))
    i = np.flatnonzero(found.row[: max(len(found.row) - k + 1, 0)] == found.row[k - 1 :])
    return found.row[i], words.span_hash(words.prefix_hash(data, lower=False), found.starts[i], found.ends[i + k - 1])


def _tree_task(length: int):
    """Rows come sorted by anchor; groups are worked on in batches of about BATCH_BYTES."""

    def cut(group: list) -> list:
        data, starts, ends = packed([x[5] for x in group])
        hit = covered(maximal_repeats(data, starts, ends, np.array([x[7] for x in group]), length), len(data))
        rows = []
        for x, s, e in zip(group, starts.tolist(), ends.tolist()):
            if x[2] == 1 and hit[s:e].any():
                a, b = runs(hit[s:e])
                rows.append((x[0], x[1], np.stack([a, b], 1).ravel().tolist(), None))
        return rows

    def shared(group: list) -> list:
        seg, mark = passage_hashes([x[5] for x in group])
        anchor, first, last = (np.array([x[c] for x in group], np.int64)[seg] for c in (0, 3, 4))
        order = np.lexsort((mark, anchor))
        edge = np.flatnonzero(np.concatenate([[True], (mark[order][1:] != mark[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]))
        both = np.minimum.reduceat(first[order], edge) != np.maximum.reduceat(last[order], edge)
        count = np.bincount(seg[order], np.repeat(both, np.diff(np.append(edge, len(order)))), len(group)).astype(np.int64)
        return [(x[0], x[1], None, c) for x, c in zip(group, count.tolist()) if c and x[3] == x[4]]

    def solve(group: list) -> Iterator[pa.RecordBatch]:
        by_byte, by_word = [x for x in group if not x[6]], [x for x in group if x[6]]
        rows = (cut(by_byte) if by_byte else []) + (shared(by_word) if by_word else [])
        if rows:
            yield _found(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for x in zip(*[batch.column(c).to_pylist() for c in ("anchor", "seg", "n", "first", "last", "content", "passage", "windows")]):
                if size >= BATCH_BYTES and x[0] != group[-1][0]:
                    yield from solve(group)
                    group, size = [], 0
                group.append(x)
                size += len(x[5])
        if group:
            yield from solve(group)

    return task


WINDOWS = "anchor long, seg long, n long, first long, last long, passage boolean, at int, mark long"


def _window_task(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("anchor", "seg", "n", "first", "last", "passage")]
            content, passage, windows = (batch.column(c).to_pylist() for c in ("content", "passage", "windows"))
            for k, (raw, by_word, n) in enumerate(zip(content, passage, windows)):
                if by_word:
                    mark = passage_hashes([raw])[1]
                else:
                    at = np.arange(n)
                    mark = words.span_hash(words.prefix_hash(np.frombuffer(raw, np.uint8), lower=False), at, at + length)
                one = pa.array(np.full(len(mark), k))
                yield pa.RecordBatch.from_arrays([*[c.take(one) for c in columns], pa.array(np.arange(len(mark), dtype=np.int32)), pa.array(mark.view(np.int64))], ["anchor", "seg", "n", "first", "last", "passage", "at", "mark"])

    return task


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = words.buffers(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        kept, cuts = [], []
        for k, own in enumerate(spans):
            text = data[at[k] : at[k + 1]]
            if not own:
                kept.append(text.tobytes())
                cuts.append([])
                continue
            change = np.zeros(len(text) + 1, np.int64)
            ranges = np.concatenate([x["lo"] + np.asarray(x["ranges"]).reshape(-1, 2) for x in own])
            np.add.at(change, ranges[:, 0], 1)
            np.add.at(change, ranges[:, 1], -1)
            mask = np.cumsum(change[:-1]) > 0
            kept.append(text[~mask].tobytes())
            cuts.append([{"start": int(a), "end": int(b)} for a, b in zip(*runs(mask))])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.diff(at)), pa.array(cuts, kind), pa.array(kept, pa.binary())], [*names, "n_bytes", "removed", "kept"])


def repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, spans, n_shared: for each text of rows (row, text) with repeats, segments' places and the ranges in them to
    remove, and how many of its windows of PASSAGE words another row's text holds."""
    all_places = materialize(rows.mapInArrow(_places_task(length), PLACES), "repeat-places")
    # most anchors are met once: they go before anything wide is grouped
    met = all_places.groupBy("anchor", "passage").agg(F.sum("times").alias("c"), F.min("row").alias("least"), F.max("row").alias("most")).filter("if(passage, least <> most, c > 1)")
    met = materialize(met.select("anchor", "passage"), "repeat-anchors")  # read again, so that AQE can split a frequent anchor's rows in the join
    places = materialize(all_places.join(met, ["anchor", "passage"], "left_semi"), "repeat-places")
    drop(all_places)
    drop(met)
    del all_places, met
    release(rows.sparkSession)
    kinds = materialize(places.groupBy("anchor", "seg").agg(F.sum("times").alias("n"), F.min(F.struct("row", "lo", "end", "windows", "passage")).alias("one"), F.max("row").alias("last")), "repeat-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("one.row").alias("least"), F.max("last").alias("most")).filter("m > 1")
    wanted = kinds.join(several, "anchor").filter("not one.passage or least <> most").select("anchor", "seg", "n", F.col("one.row").alias("first"), "last", (F.col("m") > GROUP).alias("wide"), "one.*")
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "seg", "n", "first", "last", "wide", "passage", "windows", "lo", "end")).alias("wants"))  # as many as a text has segments
    release(rows.sparkSession)
    contents = materialize(rows.join(asked, "row").select("wants", "text").mapInArrow(_fetch_task, CONTENTS), "repeat-contents")

    narrow = contents.filter("not wide").drop("wide")
    by_tree = narrow.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_tree_task(length), FOUND)
    windows = contents.filter("wide").mapInArrow(_window_task(length), WINDOWS)
    twice = windows.groupBy("anchor", "mark", "passage").agg(F.count("*").alias("c"), F.min("first").alias("least"), F.max("last").alias("most")).filter("if(passage, least <> most, c > 1)").select("anchor", "mark", "passage")
    hit = windows.filter("if(passage, first = last, n = 1)").join(twice, ["anchor", "mark", "passage"]).groupBy("anchor", "seg", "passage")
    ranges = F.flatten(F.collect_list(F.array("at", F.col("at") + length)))  # 301 windows at most
    by_hash = hit.agg(ranges.alias("ranges"), F.count("*").cast("int").alias("shared")).select("anchor", "seg", F.when(~F.col("passage"), F.col("ranges")).alias("ranges"), F.when(F.col("passage"), F.col("shared")).alias("shared"))
    passage = F.col("one.passage")
    same = kinds.filter("if(one.passage, one.row <> last, n > 1)").select("anchor", "seg", F.when(~passage, F.array(F.lit(0), F.col("one.end") - F.col("one.lo"))).alias("ranges"), F.when(passage, F.col("one.windows")).alias("shared"))
    found = same.unionByName(by_tree).unionByName(by_hash)
    # a run of equal segments goes as a whole
    run = F.array(F.lit(0), F.col("end") - F.col("lo") + (F.col("times") - 1) * F.col("windows"))
    span = F.when(F.col("ranges").isNotNull(), F.struct("lo", F.when(F.col("times") > 1, run).otherwise(F.col("ranges")).alias("ranges")))
    spans = materialize(places.select("anchor", "seg", "row", "lo", "end", "windows", "times").join(found, ["anchor", "seg"]).groupBy("row").agg(F.collect_list(span).alias("spans"), F.coalesce(F.sum("shared"), F.lit(0)).alias("n_shared")), "repeat-spans")
    # the texts are shuffled once more for the cut: make room
    for done in (places, kinds, contents):
        drop(done)
    del several, wanted, asked, narrow, by_tree, windows, twice, hit, by_hash, same, found, places, kinds, contents
    release(spans.sparkSession)
    return spans


def _groups_task(length: int):
    """The tree's maximal repeats as rows: a number for each repeat, its bytes, and a place in a segment for each occurrence."""

    def solve(group: list) -> Iterator[pa.RecordBatch]:
        data, starts, ends = packed([x[2] for x in group])
        for size, at in maximal_repeats(data, starts, ends, np.array([x[3] for x in group]), length):
            seg = np.searchsorted(starts, at, "right") - 1
            mark = int(words.span_hash(words.prefix_hash(data[at[0] : at[0] + size], lower=False), np.zeros(1, np.int64), np.array([size])).view(np.int64)[0])
            columns = [pa.array(np.full(len(at), mark)), pa.array(np.full(len(at), size)), pa.array([group[k][0] for k in seg], pa.int64()), pa.array([group[k][1] for k in seg], pa.int64()), pa.array((at - starts[seg]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["repeat", "n_bytes", "anchor", "seg", "place"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for x in zip(*[batch.column(c).to_pylist() for c in ("anchor", "seg", "content", "windows")]):
                if size >= BATCH_BYTES and x[0] != group[-1][0]:
                    yield from solve(group)
                    group, size = [], 0
                group.append(x)
                size += len(x[2])
        if group:
            yield from solve(group)

    return task


OPENINGS = "anchor long, seg long, at int, mark long, before int"
PREFIXES = "anchor long, seg long, place int, before int, n_bytes int, repeat long, after int"
EDGE = -1  #: stands for the byte before or after a segment, which differs from every other


def _openings_task(length: int):
    """A row for each window of a segment: the hash of its bytes and the byte before it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, content, n in zip(*[batch.column(c).to_pylist() for c in ("anchor", "seg", "content", "windows")]):
                data, at = np.frombuffer(content, np.uint8), np.arange(n, dtype=np.int32)
                mark = words.span_hash(words.prefix_hash(data, lower=False), at, at + length)
                before = np.append(np.int32(EDGE), data[: n - 1].astype(np.int32))
                yield pa.RecordBatch.from_pydict({"anchor": np.full(n, anchor), "seg": np.full(n, seg), "at": at, "mark": mark.view(np.int64), "before": before})

    return task


def _prefixes_task(length: int):
    """A row for each prefix, from length bytes to the segment's end, of the suffixes at the places asked for: its hash and
    the bytes before and after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, content, places in zip(*[batch.column(c).to_pylist() for c in ("anchor", "seg", "content", "places")]):
                data = np.frombuffer(content, np.uint8)
                sums, follow = words.prefix_hash(data, lower=False), np.append(data.astype(np.int32), np.int32(EDGE))
                for at in places:
                    ends = np.arange(at + length, len(data) + 1)
                    n = len(ends)
                    mark = words.span_hash(sums, np.full(n, at), ends)
                    before = data[at - 1] if at else EDGE
                    yield pa.RecordBatch.from_pydict({"anchor": np.full(n, anchor), "seg": np.full(n, seg), "place": np.full(n, at, np.int32), "before": np.full(n, before, np.int32), "n_bytes": (ends - at).astype(np.int32), "repeat": mark.view(np.int64), "after": follow[ends]})

    return task


def wide_repeats(contents: DataFrame, length: int) -> DataFrame:
    """repeat, n_bytes, anchor, seg, place: the maximal repeats among the segments (anchor, seg, content, windows) of each
    anchor, as the tree gives them, without an anchor's segments in one task. An interval of the tree is a set of equal
    prefixes; it is one whose bytes behind differ, and is given if those before differ too. Both are told by counts, with
    partial counts in every task: first of windows, since prefixes of those that one byte stands before have it as well,
    then of all prefixes of the windows left."""
    differ = "({0}_least < 0 or {0}_least <> {0}_most)"
    ends = lambda c: (F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_most"))
    openings = materialize(contents.mapInArrow(_openings_task(length), OPENINGS), "repeat-openings")
    roots = openings.groupBy("anchor", "mark").agg(F.count("*").alias("c"), *ends("before")).filter("c > 1 and " + differ.format("before"))
    asked = openings.join(roots, ["anchor", "mark"], "left_semi").groupBy("anchor", "seg").agg(F.collect_list("at").alias("places"))  # as many as a segment has windows
    prefixes = contents.join(asked, ["anchor", "seg"]).select("anchor", "seg", "content", "places").mapInArrow(_prefixes_task(length), PREFIXES)
    prefixes = materialize(prefixes, "repeat-prefixes")
    drop(openings)
    of = ["anchor", "n_bytes", "repeat"]
    maximal = prefixes.groupBy(of).agg(F.count("*").alias("c"), *ends("before"), *ends("after")).filter(f"c > 1 and {differ.format('before')} and {differ.format('after')}")
    return prefixes.join(maximal, of, "left_semi").select("repeat", F.col("n_bytes").cast("long").alias("n_bytes"), "anchor", "seg", F.col("place").cast("long").alias("place"))


def repeat_groups(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """repeat, n_bytes, doc_id, start: a row for each occurrence of each maximal repeat among the segments of an anchor. A
    repeat longer than a segment shows as one for each anchor it holds; of texts that are equal around an anchor, the
    segment itself is the repeat. Copies join their segment by key, so a repeat with many occurrences is no one row. Where
    an anchor has more than GROUP different segments, the same repeats are found by counts, not in one task's tree."""
    docs, number = with_rows(docs)
    rows = docs.select(F.col(number).alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    places = rows.select("row", "text").mapInArrow(_places_task(length), PLACES).filter("not passage")
    places = places.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumns({c: F.col(c) + F.col("k") * F.col("windows") for c in ("lo", "end")}).drop("k", "times")
    places = materialize(places, "repeat-places")
    kinds = materialize(places.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "end", "windows")).alias("one")), "repeat-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    wanted = kinds.join(several, "anchor").select("anchor", "seg", (F.col("m") > GROUP).alias("wide"), "one.*")
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "seg", F.lit(1).cast("long").alias("n"), F.col("row").alias("first"), F.col("row").alias("last"), "wide", F.lit(False).alias("passage"), "windows", "lo", "end")).alias("wants"))
    contents = materialize(rows.join(asked, "row").select("wants", "text").mapInArrow(_fetch_task, CONTENTS).select("anchor", "seg", "wide", "content", "windows"), "repeat-contents")
    by_count = wide_repeats(contents.filter("wide"), length)
    trees = contents.filter("not wide").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_groups_task(length), "repeat long, n_bytes long, anchor long, seg long, place long")
    same = kinds.filter("n > 1").select(F.xxhash64("anchor", "seg").alias("repeat"), (F.col("one.end") - F.col("one.lo")).cast("long").alias("n_bytes"), "anchor", "seg", F.lit(0).cast("long").alias("place"))
    found = places.select("anchor", "seg", "row", "lo").join(trees.unionByName(by_count).unionByName(same), ["anchor", "seg"])
    return found.join(rows.select("row", "doc_id"), "row").select("repeat", "n_bytes", "doc_id", (F.col("lo") + F.col("place")).alias("start")).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shared, n_bytes, removed array<struct<start,end>>, kept binary for every row of docs."""
    docs, number = with_rows(docs)
    rows = docs.select(F.col(number).alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    spans = repeats(rows.select("row", "text"), length)
    return rows.join(spans, "row", "left").select("doc_id", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"), "text", "spans").mapInArrow(_cut_task, "doc_id long, n_shared long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared of remove_repeats() rows."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
