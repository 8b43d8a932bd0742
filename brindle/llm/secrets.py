"""Secret scans with DataFrame functions alone: certain patterns, and weak candidates linked to their counterparts.

Certain ("base") spans come from three patterns.  Access identifiers, secrets and endpoints also count as parts
of one credential: a bare 40-character secret or a URL proves nothing alone, and is reported only if a
complementary part lies within ``scope`` characters.  That is an interval join of candidates and parts of the
same text over bins of ``scope`` characters; a bin of one text bounds what can meet there.

Defined results: a null text counts as empty and has no spans; a null doc_id is a value like any other; rows
repeated whole get equal spans; positions are code points, ends exclusive; an empty table gives no rows; other
columns are kept by :func:`redact`, whatever their names, and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import store

KINDS = ("assign", "access", "hex", "secret", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of the class are maximal, so those of 16 and more are the long ones among all runs
SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i)(?:https?|s3|jdbc:[a-z]+|mongodb|redis|amqps?|mysql|postgres(?:ql)?)://[^\s"'<>()\[\]]+"""
NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
BLOCK = 256


def _running(steps: str) -> str:
    """SQL for the running sums of an int array: by blocks, so that the copying stays near linear in its length."""
    inner = f"""aggregate(slice({steps}, b * {BLOCK} + 1, {BLOCK}),
        named_struct('sum', 0, 'seen', cast(array() as array<int>)),
        (a, x) -> named_struct('sum', a.sum + x, 'seen', array_append(a.seen, a.sum + x)))"""
    return f"""flatten(aggregate(transform(sequence(0, (size({steps}) - 1) div {BLOCK}), b -> {inner}),
        named_struct('sum', 0, 'seen', cast(array() as array<array<int>>)),
        (a, x) -> named_struct('sum', a.sum + x.sum, 'seen', array_append(a.seen, transform(x.seen, y -> y + a.sum)))).seen)"""


def _find(df: DataFrame, kind: int, pattern: str, where: Column, keep: str = "true") -> DataFrame:
    """Add column KINDS[kind]: the spans of ``pattern`` in column text of the rows ``where`` holds.

    ``keep``: SQL over m (a match) and v (its second group for 'assign').  A split at the same pattern gives the
    gaps between matches, hence their places.
    """
    name, p = KINDS[kind], F.lit(pattern)
    empty = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_m", F.when(where, F.regexp_extract_all("text", p, F.lit(0))).otherwise(empty))
    found = F.size("_m") > 0
    df = df.withColumn("_gap", F.when(found, F.split("text", pattern, -1)).otherwise(empty))
    df = df.withColumn("_v", F.when(found, F.regexp_extract_all("text", p, F.lit(2))).otherwise(empty) if kind == 0 else F.col("_m"))
    df = df.withColumn("_step", F.expr("transform(_m, (m, i) -> char_length(_gap[i]) + if(i = 0, 0, char_length(_m[greatest(i - 1, 0)])))"))
    df = df.withColumn("_start", F.expr(f"if(size(_step) = 0, cast(array() as array<int>), {_running('_step')})"))
    spans = f"""transform(filter(transform(_m, (m, i) -> named_struct('m', m, 'v', _v[i], 'start', _start[i])), x -> {keep}),
        x -> named_struct('start', x.start, 'kind', {kind}, 'end', x.start + char_length(x.m)))"""
    return df.withColumn(name, F.when(found, F.expr(spans)).otherwise(F.expr(NO_SPANS))).drop("_m", "_gap", "_v", "_step", "_start")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash and the spans of each kind, weak ones unjudged; written once, as three plans read it."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    df = _find(df, 0, ASSIGN, F.lit(True), "char_length(x.v) >= 12")
    df = _find(df, 1, ACCESS, F.contains("text", F.lit("AKIA")), "char_length(x.m) >= 18")
    df = _find(df, 2, HEX, F.lit(True))
    df = _find(df, 4, ENDPOINT, F.contains("text", F.lit("://")))
    df = _find(df, 3, SECRET, F.size("access") + F.size("endpoint") > 0)
    return store(df.drop("text"))


def linked(scanned: DataFrame, scope: int = 256) -> DataFrame:
    """(doc_id, text_hash, added): the weak candidates with a complementary part within ``scope`` characters."""
    weak, parts = F.concat("secret", "endpoint"), F.concat("assign", "access", "hex", "secret", "endpoint")
    # a row without complements of its weak candidates, as of many with endpoints alone, has no link
    able = ((F.size("secret") > 0) & (F.size(F.concat("access", "endpoint")) > 0)) | ((F.size("endpoint") > 0) & (F.size(F.concat("assign", "access", "hex", "secret")) > 0))
    rows = scanned.where(able).select("doc_id", "text_hash", weak.alias("weak"), parts.alias("parts"))
    rows = rows.dropDuplicates(["doc_id", "text_hash"])
    binned = lambda spans, reach: rows.select("doc_id", "text_hash", F.explode(spans).alias("s")).select(
        "doc_id", "text_hash", "s", F.explode(F.expr(f"sequence(greatest(s.start - {reach}, 0) div {scope}, (s.end + {reach}) div {scope})")).alias("bin")
    )
    a, b = binned("weak", scope).alias("a"), binned("parts", 0).alias("b")
    secret, endpoint = KINDS.index("secret"), KINDS.index("endpoint")
    complement = F.when(F.col("a.s.kind") == secret, F.col("b.s.kind").isin(KINDS.index("access"), endpoint)).otherwise(F.col("b.s.kind") != endpoint)
    near = (F.col("b.s.start") < F.col("a.s.end") + scope) & (F.col("b.s.end") > F.col("a.s.start") - scope)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.bin") == F.col("b.bin"))
    return a.join(b, same & near & complement, "left_semi").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("added"))


def spans(docs: DataFrame, scope: int = 256) -> DataFrame:
    """Per row: doc_id, text_hash, base (certain spans) and spans (all), each array<struct<start, kind, end>> in order."""
    scanned = scan(docs)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    more = linked(scanned, scope)
    joined = scanned.alias("s").join(more.alias("m"), F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_hash") == F.col("m.text_hash")), "left")
    return joined.select(
        "s.doc_id", "s.text_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        base.alias("base"), F.array_sort(F.concat(base, F.coalesce("m.added", F.expr(NO_SPANS)))).alias("spans"),
    )


def written(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end)), ',')")


def digest(docs: DataFrame, scope: int = 256) -> DataFrame:
    return spans(docs, scope).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans")
    )


def redact(docs: DataFrame, mask: str = "[REDACTED]", scope: int = 256) -> DataFrame:
    """``docs`` with each found span's characters replaced by ``mask`` (overlapping spans by one), n_chars following.

    Only rows with spans enter the join's smaller side; the others pass through.
    """
    hits = spans(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    hits = hits.dropDuplicates(["__id", "__hash"])
    # the gaps between spans, in order: each starts at the largest end so far
    gaps = """aggregate(__spans, named_struct('at', 0, 'gaps', cast(array() as array<struct<a:int,b:int>>)),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'gaps',
            if(x.start >= s.at, array_append(s.gaps, named_struct('a', s.at, 'b', x.start)), s.gaps)),
        s -> array_append(s.gaps, named_struct('a', s.at, 'b', char_length(text))))"""
    clean = f"array_join(transform({gaps}, g -> substring(text, g.a + 1, g.b - g.a)), '{mask}')".replace("text", "__text")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    joined = rows.join(hits, F.col("__doc").eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__hash")), "left")
    done = joined.select("__row", F.when(F.col("__spans").isNotNull(), F.expr(clean)).alias("__clean"))
    columns = {c: F.col(f"__row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce("__clean", columns["text"])
    if "n_chars" in columns:
        length = F.char_length("__clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("__clean").isNotNull(), length).otherwise(columns["n_chars"])
    return done.select(*[c.alias(n) for n, c in columns.items()])
