"""Language-model scores by a probabilistic suffix tree over words, whose counts and states grow with the corpus.

A context is the one to ``depth`` words before a token, all in one text.  It is looked at if it occurs ``least_context``
times in training, and becomes a state if its next-token distribution diverges from that of its suffix one word shorter:
its count times the Kullback-Leibler divergence of the observed shares must reach ``divergence`` bits.  A state gives each
next token seen ``least_next`` times in it that count less ``discount``, over its own count; what is left goes to the
shorter suffix states.  The root is the additively smoothed distribution of single tokens, unseen words counting as one.
A token is scored from the longest suffix of its history that is a state.  All distributions sum to one.  The thresholds
are counts and bits, the same at every size of the corpus, and no count or state is dropped for room.

Nothing that grows is broadcast or collected.  Texts are kept by chunks of a few megabytes as word numbers into the chunk's
sorted word hashes.  For each order a chunk sends the hashes of its distinct (context, next) pairs with their training
counts, dealt to buckets by hash; a bucket's task adds up and answers every chunk with the totals, in the order of what it
sent.  An order's contexts are known by the order below, and a pair is no more frequent than the one a word shorter, so only pairs
that can matter are sent.  One chunk in which a pair
occurs then adds it to its context's sums, contexts being dealt likewise, and is told which contexts are states; an order's
sums go with the next order's pairs, the first order's last of all, so that no step moves those of all orders.  A hot word,
pair or context is one entry a chunk.  Words are told apart by 64-bit hashes, alike in A-Z and a-z, pairs and contexts by 48
bits or more.

Defined results: a null text counts as empty (its end alone is scored); a null doc_id belongs to no fold and is
trained on; repeated rows count each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MOST_BUCKETS, crc_bucket, discard, forget_shuffles, numbers_for, release, store, store_bucketed, tidy
from .wordhash import chunks as blocks
from .wordhash import column_bytes, mix, words

ALPHA = 0.1  # of the root
END = np.uint64(0x6A09E667F3BCC909)  # the text end's hash
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)
CHUNKS = "chunk long, ids array<long>, held array<boolean>, sizes binary, vocab binary, stream binary"


@dataclass(frozen=True)
class Rule:
    depth: int = 4
    least_context: int = 4
    least_next: int = 2
    discount: float = 0.5
    divergence: float = 8.0


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _split(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte of all, compressed."""
    return _zip(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def _join(raw: bytes, kind: str) -> np.ndarray:
    """What :func:`_split` was given."""
    planes = np.frombuffer(_unzip(raw), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_tokens(vocab: np.ndarray, stream: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted words, and per token its word's number, len(vocab) being the end.  Frequent words get small numbers, the end
    none, and words as frequent stand in order, as their gaps."""
    often = np.bincount(stream, minlength=len(vocab) + 1)[:-1]
    order = np.lexsort((vocab, -often))
    rank = np.zeros(len(vocab) + 1, dtype="<i4")
    rank[order] = np.arange(1, len(vocab) + 1)
    return _split(np.diff(vocab[order], prepend=np.uint64(0)).astype("<u8")), _split(rank[stream])


def unpack_tokens(vocab: bytes, stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    words_ = np.cumsum(_join(vocab, "<u8"), dtype=np.uint64)  # gaps and sums wrap around
    order = np.argsort(words_)
    number = np.full(len(words_) + 1, len(words_), dtype="<i4")
    number[order + 1] = np.arange(len(words_))
    return words_[order], number[_join(stream, "<i4")]


def pack_sorted(keys: np.ndarray, shift: int = 0) -> bytes:
    """Sorted uint64, their last ``shift`` bits being none, as the first and the gaps, byte by byte of all, compressed."""
    gaps = np.diff(keys >> np.uint64(shift))
    width = -(-int(gaps.max(initial=1)).bit_length() // 8)
    return bytes([width, shift]) + keys[:1].tobytes() + _zip(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    width, shift, first = raw[0], raw[1], np.frombuffer(raw[2:10], dtype="<u8")
    planes = np.frombuffer(_unzip(raw[10:]), dtype=np.uint8).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel() << np.uint64(shift)]), dtype=np.uint64)


def _planes(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, byte by byte of all."""
    width = max(-(-int(counts.max(initial=1)).bit_length() // 8), 1)
    return bytes([width]) + counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``n`` numbers that begin at place ``at``, and where they end."""
    width, out = raw[at], np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at + 1).reshape(width, n).T
    return out.view("<i8").ravel(), at + 1 + width * n


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, number of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], number


TURNS = 2  # buckets a partition, so that a bucket has few chunks


def chunked(docs: DataFrame, chunk_bytes: int, buckets: int) -> DataFrame:
    """CHUNKS of rows (doc_id, held_out, text).  vocab, stream: as by :func:`pack_tokens`; sizes: tokens of each text, its
    end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = numbers_for(TaskContext.get().partitionId(), buckets, TURNS)
        ids, held, hashes, counts, size = [], [], [], [], 0

        def told() -> pa.RecordBatch:
            n = np.concatenate(counts)
            vocab, _, number = distinct(np.concatenate(hashes))
            stream = np.full(int(n.sum()) + len(n), len(vocab), dtype="<i4")
            ends = np.cumsum(n + 1) - 1
            word = np.ones(len(stream), dtype=bool)
            word[ends] = False
            stream[word] = number
            row = [_zip((n + 1).astype("<i4").tobytes()), *pack_tokens(vocab, stream)]
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in row]], ["chunk", "ids", "held", "sizes", "vocab", "stream"])

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            doc_ids, folds = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for a, b in blocks(offsets):
                if size and size + offsets[b] - offsets[a] > chunk_bytes:
                    yield told()
                    size, ids, held, hashes, counts = 0, [], [], [], []
                found, per_row = words(data, offsets[a : b + 1])
                ids += doc_ids[a:b]
                held += folds[a:b]
                hashes.append(found)
                counts.append(per_row)
                size += int(offsets[b] - offsets[a]) + b - a
        if ids:
            yield told()

    rows = docs.mapInArrow(tidy(run), CHUNKS)
    return store_bucketed(rows, "chunk", buckets, dealt=True)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """In four bytes where all fit: no pair is more frequent than its words."""
    return counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts.astype(np.int64)


#: Bits by which pairs and contexts are told apart: so many in all, and within a bucket, at least; words keep all 64.  A
#: bucket has some millions of keys at every size, so that one in about a million shares its bits with another.
IN_ALL, IN_BUCKET = 48, 40


class Chunk:
    """One chunk's tokens, with what the answers so far say of them; ``shift``: bits that pairs and contexts go without."""

    def __init__(self, row: dict, rule: Rule, shift: int):
        self.rule, self.number, self.shift = rule, row["chunk"], np.uint64(shift)
        self.sizes = np.frombuffer(_unzip(row["sizes"]), dtype="<i4")
        self.vocab, self.stream = unpack_tokens(row["vocab"], row["stream"])
        self.held = np.array(row["held"], dtype=bool)
        self.ids = row["ids"]
        ends = np.cumsum(self.sizes)
        self.place = (np.arange(len(self.stream)) - np.repeat(ends - self.sizes, self.sizes)).astype(np.int32)  # of each token in its text
        self.trained = np.repeat(~self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        """Of each word of vocab, in training texts of this chunk."""
        return np.bincount(self.stream[self.trained], minlength=len(self.vocab) + 1)[:-1]

    def learn_words(self, counts: np.ndarray, ends: int) -> None:
        self.count = [_narrow(np.append(counts, ends))[self.stream]]  # by order: training count of the pair that ends at each token
        self.hash = np.append(self.vocab, END)[self.stream]
        self.order, self.keys = 0, np.zeros(len(self.stream), dtype=np.uint64)
        self.total, self.open = [], []  # by order: the context's training count, and whether it may be a state

    def grow(self) -> None:
        """Go on to contexts one word longer.

        A context that occurs as often as its shorter one is always that one's, and so are its pairs: it tells nothing
        more, and its counts are known.
        """
        self.order += 1
        k, n = self.order, len(self.stream)
        total = np.zeros(n, dtype=self.count[k - 1].dtype)
        total[1:] = self.count[k - 1][:-1]  # the context is the pair that ends at the word before
        total[self.place < k] = 0
        open_ = total >= self.rule.least_context
        self.same = open_ & (total == self.total[-1]) if k > 1 else np.zeros(n, dtype=bool)
        open_ &= ~self.same
        may = open_ & self._may_diverge(total, self.total[-1]) if k > 1 else open_
        older = np.zeros(n, dtype=np.uint64)
        older[k:] = self.hash[: n - k] if k < n else older[k:]
        self.keys = mix(self.keys * _STEP + older + np.uint64(k))
        self.total.append(total)
        self.open.append(may)
        counted = may if k == self.rule.depth else open_  # shorter ones' pairs are longer contexts too
        self.sent = np.flatnonzero(counted & (self.count[k - 1] >= self.rule.least_next))  # no pair is more frequent than its shorter one
        self.pairs, self.first, self.numbers = distinct(self._cut(mix(self.keys[self.sent] ^ (self.hash[self.sent] * _NEXT))))

    def _may_diverge(self, total: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Whether a context's divergence can reach the threshold.

        What occurs in a context occurs in its shorter one too, so no share exceeds that one's by more than the ratio of
        their counts, of whose logarithm the divergence is at most.
        """
        t = np.maximum(total, 1).astype(np.float64)
        return t * np.log2(np.maximum(below, 1) / t) >= self.rule.divergence - 1e-3

    def _cut(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift) << self.shift

    def pair_counts(self) -> np.ndarray:
        """Of each distinct pair of this order, in training texts of this chunk."""
        return np.bincount(self.numbers[self.trained[self.sent]], minlength=len(self.pairs))

    def learn_pairs(self, counts: np.ndarray) -> None:
        here = np.where(self.same, self.count[-1], 0)
        here[self.sent] = counts[self.numbers]
        self.count.append(here)

    def sums(self, owned: np.ndarray, words_: int) -> tuple[np.ndarray, ...]:
        """Over the owned pairs of this order that are frequent enough: (context, its count, and the pairs' number, sum of
        counts, sum of shares of the shorter context, and sum of divergence)."""
        at = self.sent[self.first[owned]]
        at = at[(self.count[-1][at] >= self.rule.least_next) & self.open[-1][at]]
        c, total = self.count[-1][at].astype(np.float64), self.total[-1][at].astype(np.float64)
        below_total = self.total[-2][at] if self.order > 1 else np.full(len(at), words_)
        q = self.count[self.order - 1][at] / below_total
        context, first, number = distinct(self._cut(self.keys[at]))
        add = lambda x=None: np.bincount(number, weights=x, minlength=len(context))
        return context, self.total[-1][at][first], add(), add(c).astype(np.int64), add(q), add(c / total * np.log2(c / total / q))

    def contexts(self) -> np.ndarray:
        return self._cut(self.keys[self.open[-1]])


# What chunks send: sorted keys of one order for one bucket, and what goes with them; kind is the order, and STATES more for
# what makes its states.
SENT = "kind int, bucket int, chunk long, keys binary, told binary"
ANSWER = "kind int, bucket int, chunk long, told binary"
STATES = 100
TALLY = -1  # the chunk number of a bucket's own row: its distinct keys of a count above zero


def _dealt(kind: int, chunk: int, keys: np.ndarray, bits: int, shift: int, counts: np.ndarray) -> Iterator[tuple]:
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if j > i:
            yield kind, b, chunk, pack_sorted(keys[i:j], shift), _zip(_planes(counts[i:j]))


def _asked(chunk: Chunk, speaks: np.ndarray, total: int, bits: int, shift: int) -> Iterator[tuple]:
    """The contexts of a chunk's order, with what it adds to the sums of some of them: each is one that it asks for."""
    keys = np.unique(chunk.contexts())
    context, *rest = chunk.sums(np.flatnonzero(speaks), total)
    ends_ = np.arange((1 << bits) + 1, dtype=np.uint64)
    cut, own = (np.searchsorted(x >> np.uint64(64 - bits), ends_) for x in (keys, context))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        k, o = keys[cut[b] : cut[b + 1]], slice(own[b], own[b + 1])
        yield STATES + chunk.order, b, chunk.number, pack_sorted(k, shift), _pack_sums(k, context[o], *[x[o] for x in rest])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _add_up(table: pa.Table, rule: Rule) -> pa.Table:
    """A bucket's counts: each chunk is told the sums of its keys, and for which pairs, if frequent enough, it is to speak."""
    keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    sizes = [len(k) for k in keys]
    counts = np.concatenate([_narrow(_from_planes(_unzip(x.as_py()), n)[0]) for x, n in zip(table.column("told"), sizes, strict=True)])
    whole = np.concatenate(keys)
    del keys  # they and the counts are most of what a task holds
    first, number = distinct(whole)[1:]
    del whole
    sums = np.bincount(number, weights=counts, minlength=len(first)).astype(np.int64)  # exact below 2**53
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    speaks = np.zeros(len(number), dtype=bool)
    speaks[first] = (sums >= rule.least_next) & (kind > 0)
    rows, at = [(kind, bucket, TALLY, int((sums > 0).sum()).to_bytes(8, "little"))], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), sizes, strict=True):
        mine = slice(at, at + n)
        rows.append((kind, bucket, chunk, _zip(n.to_bytes(4, "little") + _planes(sums[number[mine]]) + np.packbits(speaks[mine]).tobytes())))
        at += n
    release()
    return pa.Table.from_batches([_rows(rows, ANSWER)])


def _told_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_add_up` tells: a count and a bit of each key."""
    data = _unzip(raw)
    n = int.from_bytes(data[:4], "little")
    counts, at = _from_planes(data, n, 4)
    return counts, np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=at), count=n).astype(bool)


def _pack_sums(keys: np.ndarray, context: np.ndarray, total: np.ndarray, n: np.ndarray, c: np.ndarray, q: np.ndarray, gain: np.ndarray) -> bytes:
    """Sums of contexts that are among ``keys``: which ones, then whole numbers, then the rest; one pair's divergence follows
    from the others."""
    which = np.zeros(len(keys), dtype=bool)
    which[np.searchsorted(keys, context)] = True
    return _zip(b"".join([np.packbits(which).tobytes(), *[_planes(x) for x in (total, n, c)], q.astype("<f4").tobytes(), gain[n > 1].astype("<f4").tobytes()]))


def _unpack_sums(keys: np.ndarray, told: bytes) -> tuple[np.ndarray, ...]:
    raw = _unzip(told)
    which = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-len(keys) // 8)), count=len(keys)).astype(bool)
    n, at, columns = int(which.sum()), -(-len(keys) // 8), []
    for _ in range(3):
        whole, at = _from_planes(raw, n, at)
        columns.append(whole)
    rest = np.frombuffer(raw, dtype="<f4", offset=at).astype(np.float64)
    total, pairs, c = (x.astype(np.float64) for x in columns)
    q, p = rest[:n], c / total
    gain = p * np.log2(p / q)
    gain[pairs > 1] = rest[n:]
    return keys[which], total, pairs, c, q, gain


def _decide(table: pa.Table, rule: Rule) -> pa.Table:
    """A bucket's contexts: sums over their pairs make states, and each chunk is told those of its contexts that are, with
    what they keep.  A chunk's row has the keys it asks for, and as told the sums of those that it adds to."""
    asked = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    parts = [_unpack_sums(keys, told.as_py()) for keys, told in zip(asked, table.column("told"), strict=True)]
    context, total, n, c, q, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
    contexts, first, number = distinct(context)
    n, c, q, gain = (np.bincount(number, weights=x, minlength=len(contexts)) for x in (n, c, q, gain))
    total = total[first]
    left, rest = np.maximum(1 - c / total, 0), np.maximum(1 - q, 1e-12)
    gain = gain + np.where(left > 0, left * np.log2(np.maximum(left, 1e-12) / rest), 0)
    state = total * gain >= rule.divergence
    states, c, n = contexts[state], c[state].astype(np.int64), n[state].astype(np.int64)
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    rows = []
    for chunk, keys in zip(table.column("chunk").to_pylist(), asked, strict=True):
        at = np.minimum(np.searchsorted(states, keys), max(len(states) - 1, 0))
        hit = states[at] == keys if len(states) else np.zeros(len(keys), dtype=bool)
        rows.append((kind, bucket, chunk, _zip(len(keys).to_bytes(4, "little") + np.packbits(hit).tobytes() + _planes(c[at[hit]]) + _planes(n[at[hit]]))))
    release()
    return pa.Table.from_batches([_rows(rows, ANSWER)])


def _answer(table: pa.Table, rule: Rule) -> pa.Table:
    return (_decide if table.column("kind")[0].as_py() >= STATES else _add_up)(table, rule)


def _told_states(raw: bytes) -> np.ndarray:
    """What :func:`_decide` tells, for each key: its state's sum of counts and number of pairs; a state has pairs."""
    data = _unzip(raw)
    n = int.from_bytes(data[:4], "little")
    hit = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-n // 8), offset=4), count=n).astype(bool)
    out, at = np.zeros((2, n), dtype=np.int64), 4 + -(-n // 8)
    for k in range(2):
        out[k, hit], at = _from_planes(data, int(hit.sum()), at)
    return out


def _opened(batch: pa.RecordBatch, rule: Rule, ends: int, shift: int) -> Iterator[tuple[Chunk, dict[int, list[bytes]]]]:
    """The chunks of a batch, with the answers to them by kind, in order of bucket."""
    for row in range(batch.num_rows):
        fields = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
        chunk, answers = Chunk(fields, rule, shift), {}
        for name, told in fields.items():
            if name.startswith("answers_") and told is not None:
                answers[int(name[8:])] = [a["told"] for a in sorted(told, key=lambda a: a["bucket"])]
        if 0 in answers or not len(chunk.vocab):
            chunk.learn_words(_counts(answers.get(0, []))[0], ends)
        yield chunk, answers
        del chunk, answers, fields  # before the next is opened
    release()


def _counts(told: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_told_counts(x) for x in told] or [(np.zeros(0, np.int64), np.zeros(0, bool))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _by_chunk(answers: DataFrame, kinds: list[int], buckets: int) -> DataFrame:
    """Answers of some kinds, bucketed as the chunks are, so that they move once."""
    dealt = answers.where(F.col("chunk") != TALLY).repartition(buckets, "chunk")
    lists = [F.collect_list(F.when(F.col("kind") == k, F.struct("bucket", "told"))).alias(f"answers_{k}") for k in kinds]
    kept = store_bucketed(dealt.groupBy("chunk").agg(*lists), "chunk", buckets, dealt=True)
    forget_shuffles(answers.sparkSession)
    return kept


def _with(chunks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    for more in answers:
        chunks = chunks.join(more.hint("merge"), "chunk", "left")
    return chunks


def scores(docs: DataFrame, folds: int = 10, rule: Rule = Rule(), chunk_bytes: int = 4 << 20) -> DataFrame:  # noqa: B008
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on the rows not held out."""
    fold = F.coalesce(crc_bucket(F.col("doc_id"), folds) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("held_out"))
    buckets = min(TURNS * rows.rdd.getNumPartitions(), MOST_BUCKETS)
    chunks = chunked(rows, chunk_bytes, buckets)
    n_chunks, ends = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    bits = max(3, (n_chunks // 16).bit_length())  # some millions of keys a bucket
    shift = max(64 - max(bits + IN_BUCKET, IN_ALL), 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(np.frombuffer(_unzip(s.as_py()), dtype="<i4")[~np.array(h.as_py(), dtype=bool)].sum()) for b in batches for s, h in zip(b.column("sizes"), b.column("held"), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    total = chunks.select("sizes", "held").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def asks(step: int) -> list[int]:
        """The orders whose states a step asks for: after words and first pairs, the second pairs are most of what moves."""
        return [k for k in range(1, rule.depth + 1) if step == (k + 1 if k > 1 else rule.depth + 1)]

    def send(kind: int, known: list[DataFrame]) -> DataFrame:
        """Answers to the pairs of an order, if there is one, and to the contexts of those that :func:`asks` tells."""
        asked = asks(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, answers in _opened(batch, rule, ends, shift):
                    rows = []
                    for order in range(1, kind):
                        chunk.grow()
                        counts, speaks = _counts(answers.get(order, []))
                        chunk.learn_pairs(counts)
                        if order in asked:
                            rows += _asked(chunk, speaks, total, bits, shift)
                    if kind == 0:
                        rows += _dealt(0, chunk.number, chunk.vocab, bits, 0, chunk.word_counts())
                    elif kind <= rule.depth:
                        chunk.grow()
                        rows += _dealt(kind, chunk.number, chunk.pairs, bits, shift, chunk.pair_counts())
                    yield _rows(rows, SENT)
                    del chunk, answers, rows

        sent = _with(chunks, known).mapInArrow(run, SENT)
        return sent.groupBy("kind", "bucket").applyInArrow(lambda t: _answer(t, rule), ANSWER)

    first = store(send(0, []), "none")
    vocabulary = sum(int.from_bytes(r["told"], "little") for r in first.where(F.col("chunk") == TALLY).select("told").collect())  # a row a bucket
    answers = [_by_chunk(first, [0], buckets)]
    discard(first)
    distinct_tokens = vocabulary + (1 if ends else 0)
    for step in range(1, rule.depth + 2):
        kinds = [step] * (step <= rule.depth) + [STATES + k for k in asks(step)]
        answers.append(_by_chunk(send(step, answers), kinds, buckets))

    scale = total + ALPHA * (distinct_tokens + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, known in _opened(batch, rule, ends, shift):
                starts = np.cumsum(chunk.sizes) - chunk.sizes
                p = (chunk.count[0] + ALPHA) / scale
                base, found = np.add.reduceat(np.log10(p), starts), np.add.reduceat((chunk.count[0] > 0).astype(np.int64), starts)
                p = _from_states(chunk, known, p)
                scored = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes.astype(np.int64)), pa.array(found), pa.array(np.full(len(starts), total)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), starts))]
                del chunk, known, p
                yield pa.RecordBatch.from_arrays(scored, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with(chunks, answers).mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _from_states(chunk: Chunk, known: dict[int, list[bytes]], p: np.ndarray) -> np.ndarray:
    """Each token's probability by its longest suffix state, shorter ones taking what it leaves; p: the root's."""
    rule = chunk.rule
    for order in range(1, rule.depth + 1):
        chunk.grow()
        chunk.learn_pairs(_counts(known.get(order, []))[0])
        told = [np.zeros((2, 0), dtype=np.int64), *[_told_states(x) for x in known.get(STATES + order, [])]]
        kept, pairs = np.concatenate(told, axis=1)[:, distinct(chunk.contexts())[2]]
        here = np.flatnonzero(chunk.open[-1])
        here, kept, pairs = here[pairs > 0], kept[pairs > 0], pairs[pairs > 0]
        c, total = chunk.count[order][here], chunk.total[order - 1][here]
        own = np.where(c >= rule.least_next, (c - rule.discount) / total, 0)
        p[here] = own + (1 - (kept - rule.discount * pairs) / total) * p[here]
    return p
