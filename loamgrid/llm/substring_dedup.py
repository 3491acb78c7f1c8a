"""Op 4: removal of long word sequences that an earlier document holds, by recompression.

Local pass.  A document's words become 64-bit names; runs of equal names (up to three words) and two rounds of
coin-chosen pairs (up to four, then eight words) shrink the stream without any shuffle.  A local symbol depends on no word more than
``_MARGIN`` away, so every occurrence of a passage has the same ones inside.  Each window of ``wide`` words
picks the longest pair of symbols in its inner part; only windows whose pick stands in two documents
can repeat.  They form *segments*, about a quarter of the words or less, and only these go on.

Rounds.  In each round Spark lists the runs of equal names, or the pairs whose left name draws 0 and right name draws 1 in the
round's coin, counts the documents of each, and gives those of two or more a new global name by
a join; the segments take the names over.  Whether two neighbours merge depends on their two names and the corpus alone, so
equal substrings get equal interior symbols.  Which neighbours had a say in a symbol is kept as its *context*, in words.
Rounds go on until hardly anything gets a name (an eighth of the symbols or less) or symbols are an eighth of a window
long, beyond which their contexts no longer fit into a window; the result is the same after any number of rounds.

Verifying.  Each window takes the longest symbol whose context lies in it (else the longest local one): equal windows
take equal symbols.  A *stretch* is a run of windows around one symbol.  Two stretches are equal if
their symbol, its place, and the words on either side of it are: these edge words are compared by a
64-bit hash beside the 64-bit name.  Stretches that a smaller document holds go whole.  Where one symbol stands in different
stretches, the windows of one document for each stretch are compared in the same way.

Shuffles: symbols of about one word in ten; the texts of documents with segments once, to cut these out;
the segments' symbols once a round; all texts once, to meet what is to be removed from them.  Names that a
thousandth of all rows hold are met by broadcast, never in one task.

Symbols, words and windows stand in tables as packed bytes, a value a segment, so that the JVM copies them whole; only numpy looks into them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.shared import discard, join_copies, saved, table
from loamgrid.llm.words import Words, mix, powers, slices

_U64 = np.uint64
#: Words of a run, and of a pair in each round, of the local pass.
_RUN = 3
_PAIR_CAPS = (4, 8)
#: Symbols in a row that make one key.
_GRAM = 2
#: Words at either end of a repeat whose local symbols may depend on the surroundings:
#: one more than a run, then the longest symbol of each level below.
_MARGIN = _RUN + 1 + _RUN + _PAIR_CAPS[0]
#: A context that reaches beyond its segment.
_OPEN = 1 << 14
_SLICE_WORDS = 1 << 19


def _merge(name: np.ndarray, start: np.ndarray, size: np.ndarray, take: np.ndarray, new: np.ndarray, span: np.ndarray):
    """Symbols after joining each ``take``-marked one with its right neighbour."""
    keep = np.ones(len(name), bool)
    keep[1:] = ~take[:-1]
    return np.where(take, new, name)[keep], start[keep], np.where(take, span, size)[keep]


def recompress(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and lengths of the symbols of all rows after all rounds."""
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    short = size <= _RUN
    drop = np.zeros(n, bool)
    for k in range(1, _RUN):
        drop[head[short & (size > k)] + k] = True
    start = np.flatnonzero(~drop)
    length = np.ones(n, np.int64)
    length[head[short]] = size[short]
    length = length[start]
    name = np.where(length > 1, mix(hashes[start] + length.astype(_U64)), hashes[start])
    for number, cap in enumerate(_PAIR_CAPS):
        if len(name) < 2:
            break
        coin = mix(name + _U64(number + 11)) & _U64(1)
        take = np.zeros(len(name), bool)
        span = length[:-1] + length[1:]
        take[:-1] = (coin[:-1] == 0) & (coin[1:] == 1) & (span <= cap) & (row[start[:-1]] == row[start[1:]])
        both, total = name.copy(), length.copy()
        both[:-1] = mix(mix(name[:-1] + _U64(number + 101)) + name[1:])
        total[:-1] = span
        name, start, length = _merge(name, start, length, take, both, total)
    return name, start, length


def _grams(name: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank (longest first, then by name) and end of each ``k`` consecutive symbols; they may cross rows."""
    n = max(0, len(name) - k + 1)
    key = name[:n]
    for j in range(1, k):
        key = mix(mix(key + _U64(j)) + name[j : n + j])
    end = start[k - 1 :] + length[k - 1 :]
    span = (end - start[:n]).astype(_U64)
    return ((_U64(31) - span) << _U64(59)) | (mix(key) >> _U64(5)), end


def _range_min(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``a[low:high]`` for each pair; all ones where the range is empty."""
    size = np.maximum(high - low, 0)
    out = np.full(len(low), ~_U64(0))
    level, table = 0, a
    while True:
        now = np.flatnonzero((size >> level) == 1)
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << level)])
        level += 1
        if not (size >> level).any():
            return out
        table = np.minimum(table[: -(1 << level - 1)], table[1 << level - 1 :])


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64), pa.int64())


def _flat(part: pa.RecordBatch, name: str) -> np.ndarray:
    """Items of a list column of longs."""
    return part.column(name).flatten().to_numpy(zero_copy_only=False).view(_U64)


def _sizes(part: pa.RecordBatch, name: str) -> np.ndarray:
    """Items of each row of a list column, or of one of packed words."""
    column = part.column(name)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    size = pc.binary_length(column) if binary else pc.list_value_length(column)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64) // (8 if binary else 1)


def _unpacked(part: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    """Items of all rows of a packed column (rows are never null)."""
    column = part.column(name).cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(kind) if len(column) else np.zeros(0, kind)


def _packed(sizes: np.ndarray, items: np.ndarray) -> pa.Array:
    """Rows of ``sizes`` items as bytes, which pass through the JVM as one value and not item by item."""
    items = np.ascontiguousarray(items)
    width = items.dtype.itemsize * (items.shape[1] if items.ndim > 1 else 1)
    off = np.concatenate([[0], np.cumsum(sizes) * width]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(items)]).cast(pa.binary())


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int32), pa.int32())


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with about ``_SLICE_WORDS`` items in a list or packed column."""
    for batch in batches:
        end, at = np.cumsum(_sizes(batch, column)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + _SLICE_WORDS, "right")))
            yield batch.slice(at, to - at)
            at = to


# ---- local pass ----


class Picks:
    """Windows of the rows of a text column, by first word, and the key that each picks."""

    def __init__(self, column: pa.Array, wide: int) -> None:
        self.words = words = Words(column)
        self.names = words.hashes()
        n = len(self.names)
        self.window = np.flatnonzero(np.arange(n) + wide <= words.ends())
        self.name, self.start, self.length = recompress(self.names, words.row)
        low = np.searchsorted(self.start, self.window + _MARGIN)
        rank, end = _grams(self.name, self.start, self.length, _GRAM)
        self.key = _range_min(rank, low, np.searchsorted(end, self.window + wide - _MARGIN, "right")) if len(self.window) else np.zeros(0, _U64)


def _keys(wide: int):
    schema = pa.schema([("symbol", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Picks(part.column("text"), wide)
                row = p.words.row[p.window]
                new = np.ones(len(row), bool)
                new[1:] = (p.key[1:] != p.key[:-1]) | (row[1:] != row[:-1])
                key, row = p.key[new], row[new]
                _, once = np.unique(mix(key + mix(row.astype(_U64) + _U64(1))), return_index=True)
                yield pa.RecordBatch.from_arrays([_long(key[once]), part.column("doc_id").take(pa.array(row[once]))], schema=schema)

    return run


#: A segment's symbols, which follow each other without a gap: the first one's place, their number, and packed their names (64 bits)
#: and their lengths and contexts to the left and right (16 bits each).
_PARSE = ("start", "n", "name", "shape")
_PARSE_TYPES = "start int, n int, name binary, shape binary"


def _shapes(length: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.stack([length, left, right], 1).astype(np.int16)


def _segments(wide: int):
    """Segments with their words' names and the local symbols that lie in them; ``at``: the first word's number; ``span``: words in symbols."""
    names = ["seg", "doc_id", "text_key", "at", "words", "span", *_PARSE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                p = Picks(part.column("text"), wide)
                row = p.words.row[p.window]
                listed, of = _flat(part, "listed"), np.repeat(np.arange(part.num_rows), _sizes(part, "listed"))
                can = np.isin(mix(p.key + mix(row.astype(_U64) + _U64(1))), mix(listed + mix(of.astype(_U64) + _U64(1))))
                window, row = p.window[can], row[can]
                new = np.ones(len(window), bool)
                new[1:] = (window[1:] > window[:-1] + wide) | (row[1:] != row[:-1])
                head = np.flatnonzero(new)
                begin = window[head]
                end = window[np.append(head[1:], len(window)) - 1] + wide if len(head) else begin
                row = row[head]
                low, high = np.searchsorted(p.start, begin), np.searchsorted(p.start + p.length, end, "right")
                inside = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
                word = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
                size, margin = high - low, np.full(len(inside), _MARGIN)
                last = np.maximum(high - 1, 0)
                of_row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + len(row))),
                        part.column("doc_id").take(of_row),
                        part.column("text_key").take(of_row),
                        _ints(begin - p.words.first[row]),
                        _packed(end - begin, p.names[word]),
                        _ints(p.start[last] + p.length[last] - p.start[low]),
                        _ints(p.start[low] - begin),
                        _ints(size),
                        _packed(size, p.name[inside]),
                        _packed(size, _shapes(p.length[inside], margin, margin)),
                    ],
                    names=names,
                )
                number += len(row)

    return run


# ---- rounds ----


class Parse:
    """The symbols of some segments in one row after another."""

    def __init__(self, part: pa.RecordBatch, prefix: str = "") -> None:
        self.size = _sizes(part, prefix + "name")
        self.row = np.repeat(np.arange(part.num_rows), self.size)
        self.name = _unpacked(part, prefix + "name", _U64)
        length, self.left, self.right = _unpacked(part, prefix + "shape", np.int16).reshape(-1, 3).astype(np.int64).T
        before = np.concatenate([[0], np.cumsum(length)])
        first = part.column(prefix + "start").to_numpy(zero_copy_only=False) - before[np.cumsum(self.size) - self.size]
        self.start = before[:-1] + first[self.row]
        self.end = self.start + length
        #: whether a symbol has a right neighbour in the segment
        self.joined = np.zeros(len(self.name), bool)
        self.joined[:-1] = self.row[1:] == self.row[:-1]

    def coins(self, number: int) -> np.ndarray:
        return (mix(self.name + _U64(number + 1)) & _U64(1)).astype(bool)

    def heads(self) -> np.ndarray:
        """Whether a symbol is the first of a run of equal names, maybe its only one."""
        new = np.ones(len(self.name), bool)
        new[1:] = ~(self.joined[:-1] & (self.name[1:] == self.name[:-1]))
        return new

    def groups(self, number: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that may merge in this round: first symbol, count, and what stands beside its name in the dictionary."""
        n = len(self.name)
        if not number:
            head = np.flatnonzero(self.heads())
            count = np.diff(np.append(head, n))
            keep = (count > 1) & (self.end[head + count - 1] - self.start[head] <= wide)
            return head[keep], count[keep], count[keep].astype(_U64)
        coin = self.coins(number)
        head = np.flatnonzero(self.joined[:-1] & ~coin[:-1] & coin[1:] & (self.end[1:] - self.start[:-1] <= wide)) if n > 1 else np.zeros(0, np.int64)
        return head, np.full(len(head), 2), self.name[head + 1]

    def merge(self, number: int, head: np.ndarray, count: np.ndarray, name: np.ndarray) -> None:
        """Symbols after ``count`` from each ``head`` have become one of ``name``; contexts take in the neighbours that decided."""
        n = len(self.name)
        begin, end = self.start - self.left, self.end + self.right
        before, after = np.full(n, -_OPEN), np.full(n, 2 * _OPEN + self.end.max(initial=0))
        at = np.flatnonzero(self.joined)
        before[at + 1], after[at] = begin[at], end[at + 1]
        taken = np.zeros(n, bool)
        taken[np.repeat(head, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = True
        low, high = begin.copy(), end.copy()
        if not number and n:
            # whether a run gets a name depends on the whole of it and on both neighbours, for each of its symbols and also where it gets none
            first = np.flatnonzero(self.heads())
            size = np.diff(np.append(first, n))
            low = np.repeat(np.minimum.reduceat(np.minimum(begin, before), first), size)
            high = np.repeat(np.maximum.reduceat(np.maximum(end, after), first), size)
        elif number:
            # a symbol without its pair depends on the one its coin looks to
            coin = self.coins(number)
            low = np.where(~taken & coin, np.minimum(begin, before), low)
            high = np.where(~taken & ~coin, np.maximum(end, after), high)
        keep = ~taken
        keep[head] = True
        last = np.arange(n)
        last[head] = head + count - 1
        made = self.name.copy()
        made[head] = name
        if len(head):
            bounds = np.stack([head, head + count], 1).ravel()
            grown = np.append(low, 0), np.append(high, 0)
            low[head], high[head] = np.minimum.reduceat(grown[0], bounds)[::2], np.maximum.reduceat(grown[1], bounds)[::2]
        stop = self.end[last[keep]]
        self.size = np.bincount(self.row[keep], minlength=len(self.size))
        self.name, self.row = made[keep], self.row[keep]
        self.left, self.right = np.minimum(self.start[keep] - low[keep], _OPEN), np.minimum(high[keep] - stop, _OPEN)
        self.start, self.end = self.start[keep], stop


def _occurring(number: int, wide: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "name"):
            p = Parse(part)
            head, _, b = p.groups(number, wide)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[p.row[head]]
            _, once = np.unique(mix(mix(mix(p.name[head]) + b) + ids.astype(_U64)), return_index=True)
            yield pa.RecordBatch.from_arrays([_long(p.name[head][once]), _long(b[once]), pa.array(ids[once])], schema=schema)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by doc_id, joined and cut so that each document's rows lie in one."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, 8 * _SLICE_WORDS
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        rows = pa.concat_batches(held)
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
        size = held[0].nbytes
        limit = max(8 * _SLICE_WORDS, 2 * size)
    if held:
        yield pa.concat_batches(held)


def _renamed(number: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _documents(batches):
            segment = pc.is_valid(rows.column("seg"))
            part, named = rows.filter(segment), rows.filter(pc.invert(segment))
            p = Parse(part)
            head, count, b = p.groups(number, wide)
            doc = lambda of: of.column("doc_id").to_numpy(zero_copy_only=False).view(_U64)
            key = lambda a, b, doc: mix(mix(mix(a) + b) + mix(doc + _U64(1)))
            a_, b_, new = (named.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(_U64) for c in ("a", "b", "new"))
            known = key(a_, b_, doc(named))
            order = np.argsort(known)
            known, new = known[order], new[order]
            wanted = key(p.name[head], b, doc(part)[p.row[head]])
            at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
            found = known[at] == wanted if len(known) else np.zeros(len(head), bool)
            p.merge(number, head[found], count[found], new[at[found]] if len(known) else np.zeros(0, _U64))
            made = [part.column("start"), _ints(p.size), _packed(p.size, p.name), _packed(p.size, _shapes(p.end - p.start, p.left, p.right))]
            yield pa.RecordBatch.from_arrays([part.column("seg"), part.column("doc_id"), *made], names=["seg", "doc_id", *_PARSE])

    return run


def rename(parse: DataFrame, wide: int, words: int) -> DataFrame:
    """Segments' symbols (seg, doc_id and ``_PARSE``) of ``words`` words in all after all rounds."""
    number, given, before = 0, parse, None
    while True:
        found = saved(parse.select("doc_id", *_PARSE).mapInArrow(_occurring(number, wide), "a long, b long, doc_id long"), "pairs")
        held = found.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("copies")).where("low < high")
        new = F.shiftleft(F.lit(number + 1).cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
        names = saved(held.select("a", "b", "copies", new.alias("new")), "names")
        named = join_copies(found, names, ["a", "b"]).select("doc_id", "a", "b", "new")
        # a document's segments and names come together in order, not as lists
        rows = parse.unionByName(named, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id")
        old, parse = parse, saved(rows.mapInArrow(_renamed(number, wide), f"seg long, doc_id long, {_PARSE_TYPES}"), "parse")
        if old is not given:
            discard(old)
        discard(found, names)
        symbols = parse.agg(F.sum("n")).first()[0]
        if number and (not symbols or 8 * words >= wide * symbols or 8 * symbols > 7 * before):
            return parse
        number, before = number + 1, symbols


# ---- verifying ----


def _paint(n: int, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of n places the least value of the intervals (ends included) that hold it."""
    level = np.zeros(len(low), np.int64)
    while (more := (high - low + 1) >> (level + 1) > 0).any():
        level += more
    none = np.iinfo(np.int64).max
    best = [np.full(n, none) for _ in range(int(level.max(initial=0)) + 1)]
    for k, b in enumerate(best):
        here = level == k
        np.minimum.at(b, low[here], value[here])
        np.minimum.at(b, high[here] - (1 << k) + 1, value[here])
    for k in range(len(best) - 1, 0, -1):
        half = 1 << k - 1
        np.minimum(best[k - 1], best[k], out=best[k - 1])
        best[k - 1][half:] = np.minimum(best[k - 1][half:], best[k][:-half])
    return best[0]


class Edges:
    """Hashes of ranges of words."""

    def __init__(self, names: np.ndarray) -> None:
        self.down = powers(len(names) + 1)[1]
        self.sums = np.zeros(len(names) + 1, _U64)
        np.cumsum(mix(names + _U64(7)) * powers(len(names) + 1)[0][:-1], out=self.sums[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]


def _stretches(wide: int):
    schema = pa.schema([("symbol", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int32()), ("n", pa.int32()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "words"):
            size = _sizes(part, "words")
            first = np.cumsum(size) - size
            edges = Edges(_unpacked(part, "words", _U64))
            # symbols of the last round, then local ones, which every window holds
            name, start, end, left, right, row, level = ([] for _ in range(7))
            for k, prefix in enumerate(("top_", "")):
                p = Parse(part, prefix)
                for into, of in ((name, p.name), (start, p.start), (end, p.end), (left, p.left), (right, p.right), (row, p.row), (level, np.full(len(p.row), k))):
                    into.append(of)
            name, start, end, left, right, row, level = map(np.concatenate, (name, start, end, left, right, row, level))
            low, high = np.maximum(end + right - wide, 0), np.minimum(start - left, size[row] - wide)
            fits = np.flatnonzero(low <= high)
            order = fits[np.lexsort((start[fits], name[fits], start[fits] - end[fits], level[fits]))]
            chosen = _paint(int(size.sum()), first[row[order]] + low[order], first[row[order]] + high[order], np.arange(len(order)))
            at = np.concatenate([np.arange(f, f + n - wide + 1) for f, n in zip(first, size, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
            if not len(at):
                continue
            symbol = order[chosen[at]]
            new = np.ones(len(at), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (at[1:] != at[:-1] + 1)
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(at)))
            opens, closes = (first[row[symbol]] + x[symbol] for x in (start, end))

            def content(i: np.ndarray, last: np.ndarray) -> np.ndarray:
                place = mix((opens[i] - at[i]).astype(_U64) + ((last - at[i]).astype(_U64) << _U64(32)))
                return mix(mix(edges(at[i], opens[i]) + place) + edges(closes[i], last + wide))

            stretch, window = content(head, at[head + count - 1]), content(np.arange(len(at)), at)
            of = row[symbol[head]]
            begin = at[head] - first[of] + part.column("at").to_numpy(zero_copy_only=False)[of]
            ids = [part.column(c).take(pa.array(of)) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([_long(name[symbol[head]]), _long(stretch), *ids, _ints(begin), _ints(count), _packed(count, window)], schema=schema)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the stretches, by its own first word."""
    for part in _pieces(batches, "windows"):
        size = _sizes(part, "windows")
        row = np.repeat(np.arange(part.num_rows), size)
        begin = part.column("begin").to_numpy(zero_copy_only=False)[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        symbol, *ids = (part.column(c).take(pa.array(row)) for c in ("symbol", "doc_id", "text_key"))
        yield pa.RecordBatch.from_arrays([symbol, _long(_unpacked(part, "windows", _U64)), *ids, _ints(begin)], names=["symbol", "window", "doc_id", "text_key", "begin"])


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string()), ("kept_sha256", pa.string())])
    for batch in batches:
        for part in slices(batch):
            total, kept = [], []
            gone, of = _flat(part, "gone").astype(np.int64), np.concatenate([[0], np.cumsum(_sizes(part, "gone"))])
            for i, text in enumerate(part.column("text").to_pylist()):
                words = (text or "").encode().split()
                total.append(len(words))
                begin, end = (x[of[i] : of[i + 1]] for x in (gone >> 32, gone & 0xFFFFFFFF))
                if len(begin):
                    edge = np.bincount(begin, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[: len(words)]) == 0)]
                kept.append(words)
            text = [b" ".join(w) for w in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.array([n - len(w) for n, w in zip(total, kept, strict=True)], pa.int64()), pa.array(text, pa.large_binary()).cast(pa.large_string()), pa.array([hashlib.sha256(k).hexdigest() for k in text])],
                schema=schema,
            )


def remove_repeats(docs: DataFrame, wide: int = 50) -> DataFrame:
    """Each document without the words of ``wide``-word windows that start in a smaller document.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns doc_id,
    n_words, n_removed, kept_text (kept words joined by one space) and
    kept_sha256, a row for every input row.

    Null or empty texts have no words.  Windows repeated within one document
    only, and texts under ``wide`` words, stay.  Rows that share a doc_id count
    as one document: a window in several of them stays.  Rows without doc_id
    keep all words and remove none from others.  An empty table gives an empty
    one.  ``wide`` must be 46 or more and less than 16,384.
    """
    if wide < (least := 2 * _MARGIN + (_GRAM + 1) * _PAIR_CAPS[-1]):
        raise ValueError(f"wide must be {least} or more, so that every window's inner part holds {_GRAM} whole symbols")
    if wide >= _OPEN:
        raise ValueError(f"wide must be less than {_OPEN}: lengths of symbols and contexts are held in 16 bits")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    keys = saved(docs.where("doc_id is not null").mapInArrow(_keys(wide), "symbol long, doc_id long"), "keys")
    shared = saved(keys.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("copies")).where("low < high").select("symbol", "copies"), "shared")
    listed = saved(join_copies(keys, shared, "symbol").groupBy("doc_id").agg(F.collect_list("symbol").alias("listed")), "listed")
    discard(keys, shared)
    # the lists are the small side: texts are not sorted to meet them
    met = docs.join(listed.hint("shuffle_hash"), "doc_id")
    local = saved(met.mapInArrow(_segments(wide), f"seg long, doc_id long, text_key long, at int, words binary, span int, {_PARSE_TYPES}"), "segments")
    last = rename(local.select("seg", "doc_id", *_PARSE), wide, local.agg(F.sum("span")).first()[0])
    both = local.drop("span").join(last.select("seg", *(F.col(c).alias("top_" + c) for c in _PARSE)), "seg")
    found = saved(both.mapInArrow(_stretches(wide), "symbol long, stretch long, doc_id long, text_key long, begin int, n int, windows binary"), "stretches")
    discard(listed, local)

    least = saved(found.groupBy("symbol", "stretch").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "least")
    varied = saved(least.groupBy("symbol").agg((F.count("*") > 1).alias("varied"), F.count("*").alias("copies")), "varied")
    # a stretch that stands once, with a symbol in no other, has nothing to meet
    kinds = saved(join_copies(least, varied, "symbol").where("copies > 1 or varied"), "kinds")
    open_ = join_copies(found, kinds, ["symbol", "stretch"]).where("doc_id > least or varied")
    open_ = saved(open_.select("symbol", "doc_id", "text_key", "begin", "n", "least", F.expr("if(doc_id = least, windows, null)").alias("windows")), "open")
    discard(found, least, varied, kinds)
    gone = open_.where("doc_id > least").select("doc_id", "text_key", "begin", (F.col("begin") + F.col("n") - 1 + wide).alias("end"))
    single = open_.where("doc_id = least").select("symbol", "doc_id", "text_key", "begin", "windows").mapInArrow(_windows, "symbol long, window long, doc_id long, text_key long, begin int")
    first = saved(single.groupBy("symbol", "window").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "windows")
    partly = join_copies(single, first, ["symbol", "window"]).where("doc_id > first").select("doc_id", "text_key", "begin", (F.col("begin") + wide).alias("end"))
    span = F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    removed = gone.union(partly).groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("gone"))
    return docs.join(removed.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select("doc_id", "text", "gone").mapInArrow(
        _removal, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
