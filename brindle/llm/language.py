"""Language identification by compression.

Each language's dictionary is raw text of that language.  A text goes to the language whose dictionary lets
zstandard encode it in the fewest bytes; it is rejected if the runner-up needs hardly more.

The dictionaries come from a bounded sample of labelled rows: per language the ``sample_docs`` rows of smallest
hash, at most ``sample_bytes`` of each, ``dictionary_bytes`` together, and ``all_bytes`` for all languages, which share
them evenly.  Every label is learned, however many there are: a task encodes against ``GROUP`` languages at a time and
keeps the two smallest sizes.  Everything else covers whole texts: they are encoded in blocks, all of which count.

Defined results: a null text, or one without a letter, is `und` with score 0 and is rejected; rows repeated get
equal answers; equal sizes go to the language first in order; without labelled rows every text is `und`; an empty
table gives no rows; extra columns are kept by :func:`keep_known`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_bucket, tidy

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    """What is encoded: lower-case letters with single spaces between runs."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text else b""


def fit(labelled: DataFrame, sample_docs: int = 400, sample_bytes: int = 2048, dictionary_bytes: int = 1 << 18, all_bytes: int = 1 << 26, seed: int = 5) -> dict[str, bytes]:
    """Dictionaries by language from rows (doc_id, text, lang)."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    each = min(dictionary_bytes, max(all_bytes // max(languages, 1), 1024))
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    narrow = rows.select("lang", "doc_id", (F.xxhash64(F.lit(seed), "doc_id") % 2**40).alias("order"), F.substring("text", 1, sample_bytes).alias("some"))
    # the smallest hashes lie below this bound, so that about 4 * sample_docs rows a language move
    below = F.col("order") < (F.lit(8.0 * sample_docs) / F.col("count") - 1) * 2**40
    ranked = narrow.join(F.broadcast(counts), "lang").where(below).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
    before = F.coalesce(F.sum(F.char_length("some")).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = ranked.withColumn("before", before).where(F.col("before") < 2 * each)
    found: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "rank").collect():  # about 2 * all_bytes at most
        found.setdefault(row["lang"], []).append(letters(row["some"])[:sample_bytes])
    return {lang: b" ".join(dict.fromkeys(texts))[:each] for lang, texts in found.items()}


GROUP = 64  # languages whose prepared dictionaries a task holds at once


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = 8192, level: int = 6, group: int = GROUP):
        self.block, self.level, self.dictionaries = block, level, dictionaries
        languages = sorted(dictionaries)
        self.groups = [languages[i : i + group] for i in range(0, len(languages), group)]
        self._kept: dict[int, list] = {}

    def _encoders(self, number: int) -> list:
        """Of one group; they are kept if there is no other."""
        import zstandard as z

        if number not in self._kept:
            made = []
            for lang in self.groups[number]:
                d = z.ZstdCompressionDict(self.dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                made.append(z.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._kept = {number: made}
        return self._kept[number]

    def many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, margin) of each: the margin is the share of bytes that the best dictionary saves against the next."""
        data = [letters(t) if t and any(c.isalpha() for c in t) else b"" for t in texts]
        best: list[tuple[int, str]] = [(0, UNKNOWN)] * len(texts)
        second = [0] * len(texts)
        for number, languages in enumerate(self.groups):
            encoders = self._encoders(number)
            for k, d in enumerate(data):
                if not d:
                    continue
                blocks = [d[i : i + self.block] for i in range(0, len(d), self.block)]
                for lang, encoder in zip(languages, encoders, strict=True):
                    size = sum([len(encoder.compress(b)) for b in blocks])
                    if not best[k][0] or size < best[k][0]:
                        second[k] = best[k][0]
                        best[k] = (size, lang)
                    elif not second[k] or size < second[k]:
                        second[k] = size
        return [(lang, ((rest or 2 * size) - size) / (rest or 2 * size)) if size else (UNKNOWN, 0.0) for (size, lang), rest in zip(best, second, strict=True)]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.004) -> DataFrame:
    """``docs`` with lang_pred, score (the margin) and rejected; columns of these names are replaced."""
    new = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    kept = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # all_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        # several groups are prepared anew for each slice, so that a slice is then a whole batch
        step = 1024 if len(classify.groups) < 2 else 1 << 16
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                found = classify.many(some.column("text").to_pylist())
                rejected = [lang == UNKNOWN or margin < least_margin for lang, margin in found]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(rejected, pa.bool_())],
                    [*some.schema.names, *new],
                )

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in new.items())])
    return kept.mapInArrow(tidy(run), schema)


def held_out(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by dictionaries from those whose crc32(doc_id) mod 5 is not 0."""
    fold = crc_bucket(F.col("doc_id"), 5) == 0
    dictionaries = fit(docs.select("doc_id", "text", "lang").where(~F.coalesce(fold, F.lit(False))))
    found = predict(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with a margin."""
    columns = docs.columns
    dictionaries = fit(docs.select("doc_id", "text", "lang"))
    marked = {c: f"__{i}" for i, c in enumerate(columns)}  # input names may clash with the classifier's
    renamed = docs.select(*[docs[c].alias(marked[c] if c != "text" else "text") for c in columns])
    found = predict(renamed, dictionaries).where(~F.col("rejected"))
    return found.select(*[F.col(marked[c] if c != "text" else "text").alias(c) for c in columns])
