"""Packing token sequences: deficit round-robin over source queues, in closed form.

A source's documents, in input order, are one queue of tokens.  In each round every queue is credited its target share of
a window; it sends whole grains of ``grain`` tokens and carries the rest of its credit (its deficit) into the next round.
Targets are the sources' natural shares, or weights; a queue that has run dry leaves its share to the others, which begins
a new phase.  As documents may be cut, what a queue has sent after r rounds depends on the phases alone:
``grain * floor(credit at their start + rounds since * credit a round)``.  So any task can place any document: its queue's
tokens before it, counted per partition and summed once, say in which rounds its grains go, and what all queues have sent
by then says where in the stream of windows that is.  Deficits so pass between partitions by arithmetic, not by a chain of
tasks.  Windows are cut from the stream without gaps; only the last one may be short.

Every source has a queue and a deficit of its own.  Of more than ``fan`` sources the largest half are queues of the stream
itself; the others are dealt into pools, each a stream of its own by the same rule, which is one queue of the stream above.
The driver and the tasks hold one number a source; a document is placed grain by grain, in slices of bounded size.

Defined results: a null text is empty and yields the end id alone; a null source is a source; null and repeated
doc_ids are packed row by row; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store, tidy

FRACTION = 20  # bits; rounds * grains a round * 2**20 stays below 2**63 for 10**14 tokens
MOST_BROADCAST = 200_000  # rows of four numbers and a source's name
#: Texts of these characters alone are split alike by both tokenizer libraries; others go to the slower one.
PLAIN = re.compile(r"[\n\x20-\x7e¡-¬®-ɏΑ-Ωα-ωА-я‘-”]*")


@functools.lru_cache(maxsize=1)  # once a worker
def byte_bpe(json_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """text -> uint16/uint32 ids of a tokenizer file.  With the same vocabulary as ranks, plain texts take the faster library."""

    @functools.lru_cache(maxsize=1)  # and only if a text needs it
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    if ranks_path is None:
        return lambda text: np.array(slow().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|" not in text and (text.replace("\n", " ").isprintable() if text.isascii() else PLAIN.fullmatch(text)):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(slow().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def tokenize(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids little-endian, of two bytes if all fit; ``before``
    counts the tokens of the same source earlier in the same partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, sent = byte_bpe(json_path, ranks_path, pattern), TaskContext.get().partitionId(), {}
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                before, n, ids = [], [], []
                sources = some.column("source").to_pylist()
                for source, text in zip(sources, some.column("text").to_pylist(), strict=True):
                    tokens = np.concatenate([encode(text or "").astype("<u4"), end])
                    before.append(sent.get(source, 0))
                    sent[source] = before[-1] + len(tokens)
                    n.append(len(tokens))
                    ids.append((tokens.astype("<u2") if tokens.max() < 65536 else tokens).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return store(narrow.mapInArrow(tidy(run), "doc_id long, source string, part int, before long, n long, ids binary"))


SLICE = 1 << 20  # numbers that a table of rounds by queues holds at once


class Rounds:
    """Where the tokens of each queue go, for queues of the given totals.  Without weights all run dry together."""

    def __init__(self, totals: list[int], window: int, grain: int, weights: list[float] | None = None):
        self.totals, self.grain = np.array(totals, dtype=np.int64), grain
        self.whole = -(-self.totals // grain) << FRACTION  # the credit that sends a queue's last token
        #: the round in which each phase begins, and the end; the credit by then; the credit a round
        self.turn, base, credit = [0], [np.zeros(len(totals), dtype=np.int64)], []
        if weights is None:
            everything = sum(totals)
            credit.append(np.array([(window * t << FRACTION) // (everything * grain) for t in totals], dtype=np.int64))
            self.turn.append(-(-everything // window))
            base.append(self.whole)
        else:
            self._phases(window, np.array(weights, dtype=np.float64), base, credit)
        self.base, self.credit, self.turn = np.array(base), np.array(credit), np.array(self.turn)

    def _phases(self, window: int, weights: np.ndarray, base: list[np.ndarray], credit: list[np.ndarray]) -> None:
        while (active := base[-1] < self.whole).any():
            heft = np.where(active, weights, 0.0)
            if not heft.sum():  # queues of no weight come last, by their size
                heft = np.where(active, self.totals, 0).astype(np.float64)
            each = np.ceil(window / self.grain * (1 << FRACTION) * (heft / heft.sum())).astype(np.int64)
            each = np.where(heft > 0, np.maximum(each, 1), 0)
            going = each > 0
            rounds = int((-(-(self.whole - base[-1])[going] // each[going])).min())
            credit.append(each)
            base.append(np.minimum(base[-1] + rounds * each, self.whole))
            self.turn.append(self.turn[-1] + rounds)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) sent before each round (rows); the last round sends all that is left."""
        phase = np.clip(np.searchsorted(self.turn, rounds, side="right") - 1, 0, len(self.credit) - 1)
        quota = self.base[phase] + (rounds - self.turn[phase])[:, None] * self.credit[phase]
        return np.where(rounds[:, None] >= self.turn[-1], self.totals, np.minimum(self.grain * (quota >> FRACTION), self.totals))

    def round_of(self, queue: np.ndarray, grains: np.ndarray) -> np.ndarray:
        """The round in which each grain (by its number in its queue) is sent."""
        need, out = (grains + 1) << FRACTION, np.full(len(queue), self.turn[-1] - 1)
        for q in np.unique(queue).tolist():
            at = np.flatnonzero(queue == q)
            phase = np.minimum(np.searchsorted(self.base[1:, q], need[at], side="left"), len(self.credit) - 1)
            credit = self.credit[phase, q]
            found = self.turn[phase] - 1 - (-(need[at] - self.base[phase, q]) // np.maximum(credit, 1))
            out[at] = np.where(credit > 0, np.minimum(found, self.turn[-1] - 1), self.turn[-1] - 1)
        return out

    def segments(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs that documents' tokens fall into, for documents of ``n`` tokens of which ``first`` come before in
        their queues: (document, start in it, length, place in the stream)."""
        a = first // self.grain
        each = (first + n - 1) // self.grain - a + 1
        of = np.repeat(np.arange(len(n)), each)
        grains = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        rounds = self.round_of(queue[of], grains)
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (rounds[1:] != rounds[:-1])
        at = np.flatnonzero(new)
        of, rounds = of[at], rounds[at]
        start = np.maximum(grains[at] * self.grain, first[of])
        last = np.ones(len(of), dtype=bool)
        last[:-1] = of[1:] != of[:-1]
        end = np.where(last, (first + n)[of], np.append(start[1:], 0))
        place = np.empty(len(of), dtype=np.int64)
        step = max(SLICE // len(self.totals), 1)
        for i in range(0, len(of), step):
            part = slice(i, i + step)
            sent, taken = self.sent(rounds[part]), self.sent(rounds[part] + 1)
            own = queue[of[part]]
            earlier = np.arange(len(self.totals))[None, :] < own[:, None]
            place[part] = np.where(earlier, taken, sent).sum(axis=1) + start[part] - sent[np.arange(len(own)), own]
        return of, start - first[of], end - start, place


class Streams:
    """Rounds over queues that may be streams themselves; sources are numbered, and every one has a total above zero."""

    def __init__(self, totals: list[int], window: int, grain: int, weights: list[float] | None = None, fan: int = 256, members: list[int] | None = None):
        members = list(range(len(totals))) if members is None else members
        groups = [[i] for i in members]
        if len(groups) > fan:
            alone = fan // 2
            groups = groups[:alone] + [members[alone + k :: fan - alone] for k in range(fan - alone)]
        self.queue = {i: k for k, group in enumerate(groups) for i in group}
        self.pools = {k: Streams(totals, window, grain, weights, fan, group) for k, group in enumerate(groups) if len(group) > 1}
        heavy = None if weights is None else [sum(weights[i] for i in group) for group in groups]
        self.rounds = Rounds([sum(totals[i] for i in group) for group in groups], window, grain, heavy)

    def segments(self, source: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """As :meth:`Rounds.segments`, for documents of sources."""
        queue = np.array([self.queue[i] for i in source.tolist()], dtype=np.int64)
        of, start, queued, place = np.arange(len(n)), np.zeros(len(n), dtype=np.int64), n, first
        inner = np.isin(queue, list(self.pools))
        if inner.any():  # their runs in the pool's stream are what is queued here
            parts = [(of[~inner], start[~inner], queued[~inner], place[~inner])]
            for k in np.unique(queue[inner]).tolist():
                docs = np.flatnonzero(queue == k)
                d, *rest = self.pools[k].segments(source[docs], first[docs], n[docs])
                parts.append((docs[d], *rest))
            of, start, queued, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        run, at, length, place = self.rounds.segments(queue[of], place, queued)
        return of[run], start[run] + at, length, place


def queues(tokens: DataFrame, weights: dict[str | None, float] | None) -> tuple[DataFrame, list[int], list[float] | None]:
    """Per (part, source): the source's number and its tokens before that part; and the sources' totals and weights."""
    per_part = store(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
    per_source = per_part.groupBy("source").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "source").collect()  # a row a source
    index = tokens.sparkSession.createDataFrame([(r["source"], i) for i, r in enumerate(per_source)], "q_source string, queue int")
    named = per_part.join(F.broadcast(index), F.col("source").eqNullSafe(F.col("q_source")))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = named.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("base"))
    return base, [r["total"] for r in per_source], None if weights is None else [float(weights.get(r["source"], 0.0)) for r in per_source]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _bounded(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` tokens, one row at least."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def pack(tokens: DataFrame, window: int = 1024, grain: int = 16, weights: dict[str | None, float] | None = None, fan: int = 256) -> DataFrame:
    """Pieces of all documents of :func:`tokenize`'s table, each with its window (sequence_id) and place there.

    ``weights``: what share of a window each source is to get while it lasts; sources not named come after the others.
    Without weights each gets its share of all tokens.
    """
    base, totals, heavy = queues(tokens, weights)
    if not totals:
        return tokens.sparkSession.createDataFrame([], PIECES)
    if base.count() <= MOST_BROADCAST:  # partitions times sources of the input; beyond, Spark joins by exchange
        base = F.broadcast(base)
    plan = tokens.sparkSession.sparkContext.broadcast(Streams(totals, window, grain, heavy, fan))  # a number a source
    joined = tokens.join(base, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))).select(
        "doc_id", "source", "n", "ids", "queue", (F.col("base") + F.col("before")).alias("first")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in _bounded(batch.column("n").to_numpy(), 1 << 17):
                some = batch.slice(at, stop - at)
                n = some.column("n").to_numpy()
                of, start, length, place = plan.value.segments(some.column("queue").to_numpy().astype(np.int64), some.column("first").to_numpy(), n)
                # split where a window ends inside a segment
                over = (place + length - 1) // window - place // window
                owner = np.repeat(np.arange(len(of)), over + 1)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(over + 1) - over - 1, over + 1)
                edge = np.where(step == 0, place[owner], (place[owner] // window + step) * window)
                size = np.minimum((edge // window + 1) * window, (place + length)[owner]) - edge
                start, document = start[owner] + edge - place[owner], of[owner]
                raw = [x.as_buffer() for x in some.column("ids")]
                ids = np.concatenate([np.frombuffer(x, dtype="<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(raw, n.tolist(), strict=True)])
                data = memoryview(ids.tobytes())
                begin = 4 * ((np.cumsum(n) - n)[document] + start)
                crcs = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * size).tolist(), strict=True)]
                take = pa.array(document)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(take), pa.array(start), pa.array(size), pa.array(crcs, pa.int64()), some.column("n").take(take), pa.array(edge // window), pa.array(edge % window), some.column("source").take(take)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    return joined.mapInArrow(tidy(cut), PIECES)
