"""Op 9: packing token sequences to target proportions by deficit round robin.

Every source is a queue of documents.  A round adds to each queue's deficit its quantum, the
target share of one window, and the queue sends as many whole tokens as the deficit
holds; what is left of it, a fraction of a token, is carried into the next round.  Documents are cut where a
round ends.  So a round sends one window's worth of every queue, and each
window holds the target proportions, however long the documents are, until a queue has run out; then
the others share what it leaves.

Quanta are fractions of one denominator: a queue gets ``amount`` tokens in ``period`` rounds, and after r rounds
it has sent floor(r * amount / period) tokens, or all it has.  Hence the place of every token in the stream follows from its
place in its queue: deficits pass over windows and partitions without any sequential pass, and
no stream of all documents is ever sorted.  Only the documents' places in their queues are summed up, in
three levels (within a part; over the parts of a block; over the blocks), so that no
queue meets in one task.  The stream is cut every ``window`` tokens; only the corpus' last window is padded.

Tokens are computed once, saved, and met again by row number to take the pieces' checksums.  What a
task holds of the plan is ``period`` numbers for each source.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.llm.shared import saved, table
from loamgrid.llm.words import slices

WINDOW = 2048
END = 1
#: Rounds in which amounts of tokens are whole numbers, at least.
_PERIOD = 64
#: Low bits of a document's place in its queue that don't tell its part, and its block of parts: by hash (63 bits), or by
#: row number (a file's number, then 33 bits within the file).
_HASH_BITS = (43, 53)
_ORDERED_BITS = (11, 43)
_SLICE = 4 << 20
#: White space before a space: there pieces of the tokenizer may run over a space.
_ODD = re.compile(r"\s ")


class Tokens:
    """Token ids of texts, as the tokenizer file ``vocabulary`` gives them without special tokens added.

    ``ranks`` holds the same vocabulary for a faster library.  A text is cut before every space that follows
    a visible character; no piece of the tokenizer's pattern runs over such a place, so that
    each distinct word of a batch is encoded once.  Texts where that isn't certain are encoded whole, and
    those with a special token's string by the tokenizer file itself.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.size = np.zeros(max(merges.values()) + 1, np.int64)
        for piece, number in merges.items():
            self.size[number] = len(piece)
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def one(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a space before it, and their bounds."""
        text = " " + " ".join(words.to_pylist())
        ids = np.array(self.fast.encode_ordinary(text), np.int64)
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t or t[-1].isspace() or _ODD.search(t) or any(s in t for s in self.special):
                out[i] = np.array(self.one(t), np.int64)
            else:
                plain.append(i)
        if not plain:
            return out
        first, rest = zip(*(texts[i].partition(" ")[::2] for i in plain), strict=True)
        spaced = [r is not None and len(f) < len(texts[i]) for i, f, r in zip(plain, first, rest, strict=True)]
        parts = pc.split_pattern(pa.array([r for r, s in zip(rest, spaced, strict=True) if s], pa.large_string()), " ")
        count = np.zeros(len(plain), np.int64)
        count[spaced] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        ids, bound = self._words(coded.dictionary) if len(coded) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = np.diff(bound)[code]
        end = np.cumsum(size)
        flat = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(bound[:-1][code] - end + size, size)]
        edge = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        for n, i in enumerate(plain):
            out[i] = np.concatenate([np.array(self.one(first[n]), np.int64), flat[edge[n] : edge[n + 1]]])
        return out


@lru_cache(1)
def _tokens(vocabulary: str, ranks: str) -> Tokens:
    return Tokens(vocabulary, ranks)


_TOKENS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.large_binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _tokenize(vocabulary: str, ranks: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary, ranks)
        kind = "<u2" if max(len(tokens.size), end) < 1 << 16 else "<u4"
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                ids = [np.append(x, end) for x in tokens([t or "" for t in part.column("text").to_pylist()])]
                rows = part.column("row") if "row" in part.schema.names else pa.array(np.arange(number, number + len(ids)))
                number += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.large_binary())], schema=_TOKENS
                )

    return run


class Rounds:
    """Places in the stream of deficit round robin.

    ``size``: tokens of each queue; ``share``: its target, any positive scale.  ``amount`` tokens of each are
    sent in ``period`` rounds; the amounts add up to ``period`` windows (largest remainders, one token at least).
    """

    def __init__(self, size: np.ndarray, share: np.ndarray, window: int) -> None:
        self.size, self.window = size.astype(np.int64), window
        self.period = max(_PERIOD, -(-8 * len(size) // window))
        ideal = share / share.sum() * (self.period * window) if len(size) else share
        amount = np.maximum(1, np.floor(ideal)).astype(np.int64)
        spare = self.period * window - int(amount.sum())
        if spare > 0:
            amount[np.argsort(amount - ideal, kind="stable")[:spare]] += 1
        self.amount = amount
        #: A queue runs out within cycle ``size // amount`` (a cycle is ``period`` rounds) and is empty from ``ends`` on.
        self.ends = -(-self.size // amount)
        order = np.argsort(self.ends, kind="stable")
        self.sorted_ends = self.ends[order]
        self.out = np.concatenate([[0], np.cumsum(self.size[order])])
        self.left = amount.sum() - np.concatenate([[0], np.cumsum(amount[order])])
        self.broken = np.unique((self.size // amount)[self.size % amount > 0])
        self.tables: dict[tuple[bool, int], np.ndarray] = {}

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round (from 0) that sends token ``at`` of a queue."""
        return ((at + 1) * self.period - 1) // self.amount[queue]

    def sent(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue has sent after so many rounds, if it hasn't run out."""
        return rounds * self.amount[queue] // self.period

    def _table(self, cycle: int) -> np.ndarray:
        """For each round of a cycle and queue the tokens sent in the cycle before that queue's turn; equal for cycles between two ends."""
        broken = bool(np.isin(cycle, self.broken))
        key = (broken, cycle if broken else int(np.searchsorted(self.sorted_ends, cycle, "right")))
        if key not in self.tables:
            if len(self.tables) >= 16:
                self.tables.clear()
            has = np.clip(self.size - cycle * self.amount, 0, self.amount)
            upto = np.minimum(has, np.arange(self.period + 1)[:, None] * self.amount // self.period)
            turn = np.diff(upto, axis=0)
            self.tables[key] = upto[:-1].sum(1, keepdims=True) + np.cumsum(turn, axis=1) - turn
        return self.tables[key]

    def turn(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of the whole stream before a queue's turn in a round."""
        cycle, place = np.divmod(rounds, self.period)
        cycles, back = np.unique(cycle, return_inverse=True)
        gone = np.searchsorted(self.sorted_ends, cycles, "right")
        before = (self.out[gone] + cycles * self.left[gone])[back]
        kind = np.where(np.isin(cycles, self.broken), -1 - cycles, gone)
        for k in np.unique(kind):
            here = np.flatnonzero((kind == k)[back])
            before[here] += self._table(int(cycles[kind == k][0]))[place[here], queue[here]]
        return before

    def pieces(self, queue: np.ndarray, ahead: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start in it, length and place in the stream of each piece of documents of ``n`` tokens that stand behind ``ahead`` tokens of their queue."""
        first, last = self.round_of(queue, ahead), self.round_of(queue, ahead + n - 1)
        slow = self.amount[queue] < self.period  # at most one token a round: go by tokens
        count = np.where(slow, n, last - first + 1)
        doc = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        q = queue[doc]
        rounds = np.where(slow[doc], self.round_of(q, ahead[doc] + step), first[doc] + step)
        opens = self.sent(q, rounds)
        a = np.maximum(ahead[doc], opens)
        length = np.minimum(ahead[doc] + n[doc], self.sent(q, rounds + 1)) - a
        at = self.turn(q, rounds) + a - opens
        start = a - ahead[doc]
        # turns of one document that follow each other in the stream are one piece
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + length[:-1])
        head = np.flatnonzero(head)
        doc, start, at = doc[head], start[head], at[head]
        length = np.add.reduceat(length, head) if len(head) else length
        cuts = (at + length - 1) // self.window - at // self.window + 1
        part = np.repeat(np.arange(len(doc)), cuts)
        edge = (at[part] // self.window + np.arange(len(part)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * self.window
        begin, end = np.maximum(at[part], edge), np.minimum(at[part] + length[part], edge + self.window)
        return doc[part], start[part] + begin - at[part], end - begin, begin


def _cut(rounds: Rounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", _SLICE):
                n, queue, ahead = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "queue", "ahead"))
                doc, start, length, at = rounds.pieces(queue, ahead, n)
                sums, of = np.empty(len(doc), np.int64), np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, ids in enumerate(part.column("ids").to_pylist()):
                    data = memoryview(np.frombuffer(ids, f"<u{len(ids) // n[i]}").astype("<u4").tobytes())
                    a, b = (4 * start[of[i] : of[i + 1]]).tolist(), (4 * (start + length)[of[i] : of[i + 1]]).tolist()
                    sums[of[i] : of[i + 1]] = [zlib.crc32(data[x:y]) for x, y in zip(a, b, strict=True)]
                made = (start, length, sums, n[doc], at // rounds.window, at % rounds.window)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), *map(pa.array, made)], schema=_PIECES)

    return run


def _before(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of the earlier rows' values."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def queue_places(tokens: DataFrame, ordered: bool = False) -> DataFrame:
    """row, source and ahead (tokens before the document in its source's queue) from row, source, n.

    Queues are in an order by hash, or, if ``ordered``, in that of row.  Sums go by parts, blocks of parts, and blocks.
    """
    place = F.col("row") if ordered else F.shiftrightunsigned(F.xxhash64("row"), 1)
    small, large = _ORDERED_BITS if ordered else _HASH_BITS
    tokens = tokens.select("row", "source", "n", place.alias("place"))
    tokens = tokens.withColumn("part", F.shiftright("place", small)).withColumn("block", F.shiftright("place", large))
    parts = tokens.groupBy("source", "block", "part").agg(F.sum("n").alias("n"))
    blocks = parts.groupBy("source", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("source", "block", _before("n", ["source"], ["block"]).alias("far"))
    parts = parts.select("source", "block", "part", _before("n", ["source", "block"], ["part"]).alias("near"))
    offsets = parts.join(blocks, ["source", "block"]).select("source", "part", (F.col("near") + F.col("far")).alias("offset"))
    within = tokens.withColumn("within", _before("n", ["source", "part"], ["place", "row"]))
    return within.join(offsets, ["source", "part"]).select("row", "source", (F.col("offset") + F.col("within")).alias("ahead"))


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, shares: DataFrame | None = None, window: int = WINDOW, end: int = END, order: str | None = None) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id, text and source; other columns are ignored.  Each document's ids are followed by ``end``; a null or
    empty text is that id alone.  Every row is packed, repeated rows each on their own; null sources form one queue.
    ``shares`` (source, share): target token proportions, any positive scale; by default the corpus' own, with which all queues last
    to the end.  A source that it misses, or gives no positive share, gets the least share given.  ``order`` names a
    column of longs, another one in each row, by which queues are served (by default a hash).
    ``vocabulary`` and ``ranks`` are file paths that every executor can open, by default those of the public 50k byte-level BPE.
    """
    if not (vocabulary and ranks):
        import public_tokenizers

        vocabulary, ranks = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    row = [F.col(order).cast("long").alias("row")] if order else []
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), F.col("text").cast("string"), *row)
    tokens = saved(docs.mapInArrow(_tokenize(str(vocabulary), str(ranks), end), "row long, doc_id long, source string, n long, ids binary"), "tokens")
    queues = tokens.groupBy("source").agg(F.sum("n").alias("size")).withColumn("share", F.col("size").cast("double"))
    if shares is not None:
        given = shares.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), F.col("share").cast("double").alias("given")).where("given > 0")
        queues = queues.drop("share").join(given, "source", "left").select("source", "size", F.coalesce("given", F.min("given").over(W.partitionBy()), F.lit(1.0)).alias("share"))
    plan = queues.toPandas().sort_values("source", ignore_index=True)  # one row a source
    rounds = Rounds(plan["size"].to_numpy(np.int64), plan["share"].to_numpy(float), window)
    numbers = tokens.sparkSession.createDataFrame([(s, i) for i, s in enumerate(plan["source"])], "source string, queue int")
    placed = queue_places(tokens, bool(order)).join(numbers, "source").select("row", "queue", "ahead")
    return tokens.select("row", "doc_id", "n", "ids").join(placed, "row").select("doc_id", "n", "queue", "ahead", "ids").mapInArrow(
        _cut(rounds), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
