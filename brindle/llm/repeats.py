"""Removal of byte strings that documents of smaller id have already: maximal repeats from suffix arrays.

A suffix array of all text at once would move every suffix's beginning.  Here only passages that can repeat move:

1. Every ``least``-byte window has an anchor: the smallest hash among its ``KMER``-byte strings.  Equal windows have
   equal anchors.  Each chunk of documents sends its distinct anchors, cut to 32 bits within a bucket; a bucket's
   task answers for each whether another document has it too, and whether very many have.
2. Successive windows of one shared anchor, up to ``RUN`` of them, make one string (the bytes they cover).  A chunk
   sends each of its strings once, those for one task together and compressed.
3. All strings of an anchor meet in one task.  An anchor with several distinct strings has their suffixes sorted and
   the interval tree scanned for maximal repeats (see :mod:`suffix_array`): all occurrences of a window are there, as
   its anchor brought it.  One distinct string alone repeats as a whole only.
4. An anchor of more than ``most_strings`` strings (the edges of a passage in a third of all documents, each time in
   other surroundings) would outgrow a task's array.  Its strings' windows are cut out, and equal windows meet by their
   128-bit hash, where combining before the exchange leaves one row each.  The bytes that go are the same either way.
5. The answers go back to the chunks, where bytes are dropped and the rest is hashed.

The chunk table is bucketed by chunk, so that text moves once for all of this.

Defined results: a null text counts as empty; a null doc_id counts as larger than any other, and two of them do not
precede each other; rows that repeat an id never remove each other's bytes; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, store, store_bucketed
from .suffix_array import covered_by_lower
from .wordhash import column_bytes, mix

KMER = 20
RUN = 64  # windows of a string at most: periodic text then has few distinct strings
BLOCK = 1 << 18  # window starts that are held as 8-byte numbers at once
NO_ID = 2**63 - 1
_rng = np.random.default_rng(50)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1


def _joined(a: np.ndarray, b: np.ndarray, length_b: int) -> np.ndarray:
    """Hashes of strings from those of their first and second parts."""
    return a * np.uint64(pow(_BASE, length_b, 2**64)) + b


def anchors(data: np.ndarray, least: int) -> np.ndarray:
    """The anchor of each window of ``data``."""
    span = least - KMER + 1
    h1 = _VALUE[data]
    h2 = _joined(h1[:-1], h1[1:], 1)
    h4 = _joined(h2[:-2], h2[2:], 2)
    h8 = _joined(h4[:-4], h4[4:], 4)
    h16 = _joined(h8[:-8], h8[8:], 8)
    h = mix(_joined(h16[:-4], h4[16:], 4))
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if span > width else h


def strings(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, end, key, document) of each run of windows of one anchor; it ends with its document, its block or at RUN windows."""
    out = []
    document_end = offsets[1:]
    for at in range(0, max(len(data) - least + 1, 0), BLOCK):
        part = data[at : at + BLOCK + least - 1]
        anchor = anchors(part, least)
        place = np.arange(at, at + len(anchor))
        # the document that a start lies in, where it does; windows that cross its end do not count
        first = int(np.searchsorted(document_end, at, side="right"))
        last = int(np.searchsorted(document_end, place[-1], side="right"))
        bounds = np.clip(np.append(offsets[first : last + 1], document_end[last]), at, at + len(anchor)) - at
        document = np.repeat(np.arange(first, last + 1), np.diff(bounds))
        inside = np.flatnonzero(place + least <= document_end[document])
        if not len(inside):
            continue
        anchor, place, document = anchor[inside], place[inside], document[inside]
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
        since = np.arange(len(inside)) - np.maximum.accumulate(np.where(new, np.arange(len(inside)), 0))
        begin = np.flatnonzero(since % RUN == 0)
        end = np.append(begin[1:], len(inside)) - 1
        out.append((place[begin], place[end] + least, mix(anchor[begin] + np.uint64(1)), document[begin]))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, offsets, packed): documents by the few megabytes, their bytes compressed; a chunk is one task's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, made, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids: list[np.ndarray] = []
        texts: list[bytes] = []

        def told() -> pa.RecordBatch:
            offsets = np.cumsum([0] + [len(t) for t in texts], dtype=np.int64)
            row = [[(part << 32) + made], [np.array(ids, dtype=np.int64).tobytes()], [offsets.tobytes()], [pack.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *[pa.array(x, pa.binary()) for x in row[1:]]], ["chunk", "ids", "offsets", "packed"])

        size = 0
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                if texts and size + len(text) > chunk_bytes:
                    yield told()
                    made, size, ids, texts = made + 1, 0, [], []
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield told()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, ids binary, offsets binary, packed binary")
    return store_bucketed(rows, "chunk", max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))


def _open(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The chunks of a batch, one after another."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for chunk, ids, offsets, packed in zip(*[batch.column(k) for k in ("chunk", "ids", "offsets", "packed")], strict=True):
        data = np.frombuffer(unpack.decompress(packed.as_py()), dtype=np.uint8)
        yield chunk.as_py(), np.frombuffer(ids.as_py(), dtype=np.int64), np.frombuffer(offsets.as_py(), dtype=np.int64), data
    release()


def _keys(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys cut to bits + 32 bits, place of each key among them): bucket in the high bits, 32 low bits."""
    return np.unique(key >> np.uint64(32 - bits), return_inverse=True)


STEPS = 5  # of the scale, for each doubling: seven bits reach 2**25, more than a chunk has


def scaled(n: np.ndarray) -> np.ndarray:
    """Counts of one and more on a scale of seven bits, rounded up by less than 15 %."""
    return np.minimum(np.ceil(STEPS * np.log2(np.maximum(n, 1)) - 1e-9), 127).astype(np.uint8)


def unscaled(code: np.ndarray) -> np.ndarray:
    return 2.0 ** (code / STEPS)


def shared_anchors(chunks: DataFrame, least: int, bits: int, most_strings: int) -> DataFrame:
    """(chunk, marks, n): for each bucket with shared anchors one bit per distinct key of the chunk there, in order, in
    ``marks``; ``hot`` likewise tells the keys of more than ``most_strings`` strings, where there are any.  n: the bits set."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, offsets, data in _open(batch):
                _, _, key, document = strings(data, offsets, least)
                if not len(key):
                    continue
                distinct, place = _keys(key, bits)
                lowest, highest = np.full(len(distinct), NO_ID), np.full(len(distinct), -(2**63))
                np.minimum.at(lowest, place, ids[document])
                np.maximum.at(highest, place, ids[document])
                # bit 7: several documents; below it the number of strings, on a scale
                told = scaled(np.bincount(place, minlength=len(distinct))) | np.where(lowest < highest, 128, 0).astype(np.uint8)
                cut = np.searchsorted(distinct >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
                rows = [(b, distinct[i:j].astype("<u4").tobytes(), told[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["bucket", "chunk", "low", "told"],
                )

    def answer(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x.as_py(), dtype="<u4") for x in table.column("low")]
        flat, told = np.concatenate(lows), np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint8) for x in table.column("told")])
        order = np.argsort(flat)
        ordered = flat[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        n = np.diff(np.append(begin, len(flat)))
        again, hot = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
        again[order] = np.repeat(n > 1, n)
        again |= told > 127
        hot[order] = np.repeat(np.add.reduceat(unscaled(told[order] & 127), begin) > most_strings, n)
        cut = np.cumsum([0] + [len(x) for x in lows])
        pairs = list(zip(cut[:-1], cut[1:], strict=True))
        bits_of = lambda x: pa.array([np.packbits(x[i:j]).tobytes() if x[i:j].any() else None for i, j in pairs], pa.binary())
        n_marks = pa.array([int(again[i:j].sum()) for i, j in pairs], pa.int64())
        out = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "marks": bits_of(again), "hot": bits_of(again & hot), "n": n_marks})
        return out.filter(out.column("marks").is_valid())

    sent = chunks.mapInArrow(send, "bucket int, chunk long, low binary, told binary")
    told = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, marks binary, hot binary, n long")
    return store(told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "marks", "hot")).alias("marks"), F.sum("n").alias("n")))


# A row has either.  runs: per chunk the place (4 bytes), length (2) and string number (4) of each run of a shared anchor;
# they pass through a task to meet the answers.  packed: the strings of a chunk for a task (see _pack).
SENT = "chunk long, task int, runs binary, packed binary"
# A window of a string of a very frequent anchor: the string's number (ref), the window's place there (i) and hash (w),
# and the lowest and highest id that has it in the chunk.
WINDOWS = "chunk long, ref int, lowest long, highest long, w binary, i int"
RUNS = np.dtype([("at", "<i4"), ("n", "<u2"), ("ref", "<i4")])


def _pack(ref: np.ndarray, key: np.ndarray, lowest: np.ndarray, highest: np.ndarray, texts: list[bytes]) -> bytes:
    """Strings of one chunk for one task: columns after one another, so that they compress."""
    n = np.array([len(t) for t in texts], dtype="<u2")
    columns = [np.diff(ref, prepend=0).astype("<i4"), (key & np.uint64(0xFFFFFFFF)).astype("<u4"), np.diff(lowest, prepend=0).astype("<i8"), (highest - lowest).astype("<i8"), n]
    return b"".join([len(ref).to_bytes(4, "little"), *[c.tobytes() for c in columns], *texts])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for kind in ("<i4", "<u4", "<i8", "<i8", "<u2"):
        columns.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += columns[-1].nbytes
    ends = at + np.cumsum(columns[4], dtype=np.int64)
    lowest = np.cumsum(columns[2])
    return np.cumsum(columns[0]), columns[1], lowest, lowest + columns[3], [raw[a:b] for a, b in zip((ends - columns[4]).tolist(), ends.tolist(), strict=True)]


class _Strings:
    """The distinct strings of a chunk's shared anchors, numbered in order of their first places."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, offsets: np.ndarray, marks: list[dict], least: int, bits: int):
        start, end, key, document = strings(data, offsets, least)
        distinct, place = _keys(key, bits)
        cut = np.searchsorted(distinct >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        flags = np.zeros((2, len(distinct)), dtype=bool)
        for m in marks:
            i, j = cut[m["bucket"]], cut[m["bucket"] + 1]
            for flag, known in zip(flags, (m["marks"], m["hot"]), strict=True):
                if known is not None:
                    flag[i:j] = np.unpackbits(np.frombuffer(known, dtype=np.uint8), count=int(j - i))
        keep = np.flatnonzero(flags[0][place])
        raw, refs, first = data.tobytes(), {}, []
        ref = np.empty(len(keep), dtype=np.int32)
        for k, (a, b) in enumerate(zip(start[keep].tolist(), end[keep].tolist(), strict=True)):
            r = refs.setdefault(raw[a:b], len(refs))
            if r == len(first):
                first.append(k)
            ref[k] = r
        self.runs = np.empty(len(keep), dtype=RUNS)
        self.runs["at"], self.runs["n"], self.runs["ref"] = start[keep], end[keep] - start[keep], ref
        self.texts, owner = list(refs), ids[document[keep]]
        self.lowest, self.highest = np.full(len(refs), NO_ID), np.full(len(refs), -(2**63))
        np.minimum.at(self.lowest, ref, owner)
        np.maximum.at(self.highest, ref, owner)
        self.key, self.hot = key[keep[first]], flags[1][place[keep[first]]]


def strings_of(chunks: DataFrame, marked: DataFrame, least: int, bits: int, tasks: int) -> DataFrame:
    """SENT: what each chunk sends to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for (chunk, ids, offsets, data), marks in zip(_open(batch), batch.column("marks").to_pylist(), strict=True):
                s = _Strings(data, ids, offsets, marks, least, bits)
                cold = np.flatnonzero(~s.hot)
                task_of = ((s.key[cold] >> np.uint64(32)) % np.uint64(tasks)).astype(np.int32)
                by_task = cold[np.argsort(task_of, kind="stable")]
                names, starts = np.unique(np.sort(task_of), return_index=True)
                packed = [pack.compress(_pack(r, s.key[r], s.lowest[r], s.highest[r], [s.texts[x] for x in r.tolist()])) for r in np.split(by_task, starts[1:])] if len(cold) else []
                own = int(mix(np.array([chunk], dtype=np.uint64))[0] % np.uint64(tasks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * (1 + len(names)), pa.int64()), pa.array([own, *names.tolist()], pa.int32()), pa.array([pack.compress(s.runs.tobytes()), *[None] * len(names)], pa.binary()), pa.array([None, *packed], pa.binary())],
                    ["chunk", "task", "runs", "packed"],
                )

    return chunks.join(marked, "chunk").select("chunk", "ids", "offsets", "packed", "marks").mapInArrow(run, SENT)


def windows_of(chunks: DataFrame, marked: DataFrame, least: int, bits: int) -> DataFrame:
    """WINDOWS of the very frequent anchors; only chunks that have such are opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for (chunk, ids, offsets, data), marks in zip(_open(batch), batch.column("marks").to_pylist(), strict=True):
                s = _Strings(data, ids, offsets, marks, least, bits)
                for r in np.flatnonzero(s.hot).tolist():
                    n = len(s.texts[r]) - least + 1
                    names = [xxhash.xxh3_128_digest(s.texts[r][i : i + least]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * n, pa.int64()), pa.array([r] * n, pa.int32()), pa.array([s.lowest[r]] * n, pa.int64()), pa.array([s.highest[r]] * n, pa.int64()), pa.array(names, pa.binary()), pa.array(range(n), pa.int32())],
                        ["chunk", "ref", "lowest", "highest", "w", "i"],
                    )

    with_hot = marked.where(F.exists("marks", lambda m: m["hot"].isNotNull()))
    return store(chunks.join(with_hot, "chunk").select("chunk", "ids", "offsets", "packed", "marks").mapInArrow(run, WINDOWS))


ANSWER = "chunk long, ref int, spans array<struct<low:long,a:int,b:int>>, runs binary"


def answers(sent: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    """(chunk, ref, spans, runs): who has an id above ``low`` loses bytes a to b of that string; or a chunk's runs."""
    kind = pa.list_(pa.struct([("low", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    def scan(table: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        passing = table.filter(table.column("runs").is_valid())
        table = table.filter(table.column("packed").is_valid())
        parts = [_unpack(unpack.decompress(x.as_py())) for x in table.column("packed")] or [_unpack(bytes(4))]
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(p[0]) for p in parts])
        ref, keys, lows, highs = (np.concatenate([p[k] for p in parts]) for k in range(4))
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(t, len(number)) for p in parts for t in p[4]], dtype=np.int64)
        low, key_of = np.full(len(number), NO_ID), np.empty(len(number), dtype=np.uint32)
        np.minimum.at(low, of, lows)
        key_of[of] = keys
        _, back, n = np.unique(key_of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[back] > 1)
        distinct = list(number)
        inner: dict[int, list[tuple[int, int]]] = {}
        if len(several):
            spans = covered_by_lower([distinct[k] for k in several.tolist()], low[several], least)
            inner = {k: x for k, x in zip(several.tolist(), spans, strict=True) if x}
        least_id = low[of]
        has_inner = np.zeros(len(number), dtype=bool)
        has_inner[list(inner)] = True
        keep = np.flatnonzero((highs > least_id) | (has_inner[of] & (lows == least_id)))
        said = []
        for row, d, lowest in zip(keep.tolist(), of[keep].tolist(), least_id[keep].tolist(), strict=True):
            mine = [{"low": lowest, "a": 0, "b": len(distinct[d])}] if highs[row] > lowest else []
            if d in inner and lows[row] == lowest:  # those with the lowest id lose what smaller ids have in other strings
                mine += [{"low": lowest - 1, "a": a, "b": b} for a, b in inner[d]]
            said.append(mine)
        n, m = len(keep), len(passing)
        chunks_ = pa.concat_arrays([pa.array(chunk[keep], pa.int64()), *passing.column("chunk").chunks])
        spans_ = pa.concat_arrays([pa.array(said, kind), pa.nulls(m, kind)])
        runs_ = pa.concat_arrays([pa.nulls(n, pa.binary()), *[c.cast(pa.binary()) for c in passing.column("runs").chunks]])
        return pa.table([chunks_, pa.array([*ref[keep].tolist(), *[None] * m], pa.int32()), spans_, runs_], ["chunk", "ref", "spans", "runs"])

    def scanned(table: pa.Table) -> pa.Table:
        out = scan(table)
        release()
        return out

    by_array = sent.groupBy("task").applyInArrow(lambda t: scanned(t), ANSWER)
    least_of = windows.groupBy("w").agg(F.min("lowest").alias("low"))
    lost = windows.join(least_of, "w").where("highest > low").groupBy("chunk", "ref").agg(F.collect_list(F.struct("low", F.col("i").alias("a"), (F.col("i") + least).alias("b"))).alias("spans"))
    return by_array.union(lost.select("chunk", "ref", "spans", F.lit(None).cast("binary").alias("runs")))


def removed(docs: DataFrame, least: int = 50, chunk_bytes: int = 4 << 20, most_strings: int = 50_000, task_strings: int = 25_000) -> DataFrame:
    """The chunk table with what to remove: runs (RUNS) and answers (ref, spans)."""
    spark = docs.sparkSession
    chunks = chunked(docs, chunk_bytes)
    n = chunks.count()
    bits = min(max(6, (n // 8).bit_length()), 31)  # about two million anchors a bucket
    marked = shared_anchors(chunks, least, bits, most_strings)
    n_marks = marked.agg(F.sum("n")).first()[0] or 0
    sent = strings_of(chunks, marked, least, bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_marks // task_strings)))
    said = answers(sent, windows_of(chunks, marked, least, bits), least)
    per_chunk = said.groupBy("chunk").agg(
        F.collect_list(F.when(F.col("spans").isNotNull(), F.struct("ref", "spans"))).alias("answers"), F.max("runs").alias("runs")
    )
    return chunks.join(per_chunk, "chunk", "left").select("chunk", "ids", "offsets", "packed", "runs", "answers")


def _marks(size: int, ids: np.ndarray, offsets: np.ndarray, runs: bytes | None, answers_: pa.ListScalar) -> np.ndarray:
    """Which bytes of a chunk go."""
    change = np.zeros(size + 1, dtype=np.int32)
    if answers_.is_valid and len(answers_):
        items = answers_.values
        spans = items.field("spans")
        n = np.diff(spans.offsets.to_numpy())
        ref = np.repeat(items.field("ref").to_numpy(), n)
        low, a, b = (spans.flatten().field(k).to_numpy() for k in ("low", "a", "b"))
        order = np.argsort(ref, kind="stable")
        ref, low, a, b = ref[order], low[order], a[order], b[order]
        import zstandard

        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(runs), dtype=RUNS)
        first, last = np.searchsorted(ref, table["ref"], side="left"), np.searchsorted(ref, table["ref"], side="right")
        each = last - first
        run = np.repeat(np.arange(len(table)), each)
        span = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        at = table["at"].astype(np.int64)
        owner = ids[np.searchsorted(offsets, at, side="right") - 1]
        hit = owner[run] > low[span]
        np.add.at(change, at[run[hit]] + a[span[hit]], 1)
        np.add.at(change, at[run[hit]] + b[span[hit]], -1)
    return np.cumsum(change[:-1]) > 0


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, least: int = 50, with_text: bool = False, **settings) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also the bytes that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, ids, offsets, data), runs, said in zip(_open(batch), batch.column("runs").to_pylist(), batch.column("answers"), strict=True):
                keep = ~_marks(len(data), ids, offsets, runs, said)
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    k = keep[a:b]
                    left = data[a:b][k].tobytes()
                    runs = int((~k[1:] & k[:-1]).sum() + (not k[0])) if b > a else 0
                    rows.append((b - a, b - a - len(left), runs, hashlib.sha256(left).hexdigest(), left if with_text else None))
                size, gone, runs, digest, left = zip(*rows, strict=True)
                doc_ids = pa.array(ids, mask=ids == NO_ID)
                cols = [doc_ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(left, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return removed(docs, least, **settings).mapInArrow(run, DIGEST + (", kept binary" if with_text else ""))
