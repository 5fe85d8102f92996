"""Documents: fingerprints, text extraction, quality, duplicates, splits, shards.

Every operator takes and returns DataFrames. ``documents`` rows have doc_id (the
order of the corpus), text, lang and source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_checkpoint
from .ranking import number_rows

#: What marks a source path or the head of a text as code.
CODE_PATHS = ("code", "python", "alpaca", ".py", ".cpp", ".c", ".java", ".js", ".ts", ".html", ".css", ".json", ".sql", ".sh")
CODE_WORDS = ("def ", "class ", "import ", "from ", "function ", "return ", "const ", "var ", "#include", "<!DOCTYPE", "SELECT ")
#: Limits of the quality rules.
MIN_WORDS, MIN_BYTES, MIN_CODE_BYTES, MIN_RAW_BYTES = 15, 80, 15, 32
TRIGRAM_SHARE, SYMBOL_SHARE, SYMBOL_CHARS = 0.15, 0.40, 50
BYTE_SHARE, BYTE_SAMPLE, LONG_BYTES = 0.95, 128, 8 << 20
EOS = 258


def fingerprint(docs: DataFrame) -> DataFrame:
    """Add raw_bytes and content_sha256 (null for a null text)."""
    return docs.withColumns({"raw_bytes": X.utf8_bytes("text"), "content_sha256": X.content_hash("text")})


def assign_split(docs: DataFrame, val_ratio: float) -> DataFrame:
    """Add split: val if the hash's fraction is below ``val_ratio``, else train."""
    return docs.withColumn("split", F.when(X.hash_fraction("content_sha256") < F.lit(val_ratio), "val").otherwise("train"))


def roundtrip_selected(sha: Column) -> Column:
    """One in ten thousand documents by the last 32 bits of the hash."""
    return F.conv(F.substring(sha, 57, 8), 16, 10).cast("long") % 10_000 == 0


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(p) for p in parts])


def is_code(text: Column, source: Column, strict: bool = False) -> Column:
    """Code by path or by the first 400 characters.

    Paths are tested by substring (``.json`` and ``.csv`` count as code then);
    ``strict`` tests whole extensions instead.
    """
    path = F.lower(F.coalesce(source, F.lit("")))
    if strict:
        ends = "|".join(p[1:] for p in CODE_PATHS if p[0] == ".")
        by_path = path.rlike(rf"\.({ends})$") | contains_any(path, CODE_PATHS[:3])
    else:
        by_path = contains_any(path, CODE_PATHS)
    return by_path | F.coalesce(contains_any(F.substring(text, 1, 400), CODE_WORDS), F.lit(False))


def trigram_share(words: Column) -> Column:
    """Share of the most frequent word trigram; null below three words. Row-local, no shuffle."""
    return X.let(X.ngrams(words, 3), lambda grams: F.when(F.size(grams) > 0, X.top_run(grams) / F.size(grams)))


def quality_flags(docs: DataFrame, pruning: bool = True, strict_code: bool = False) -> DataFrame:
    """Add the quality flags of every document; null texts are ambiguous and empty."""
    t = F.coalesce("text", F.lit(""))
    code = is_code(F.col("text"), F.col("source"), strict_code)
    prose = F.lit(pruning) & ~F.col("is_code") & (F.length(t) > 0)
    kept = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\x{900}-\x{D7F}]", ""))
    short_prose = (F.size("_words") < MIN_WORDS) | (F.col("raw_bytes") < MIN_BYTES)
    stripped = F.octet_length(F.regexp_replace(t, r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$", ""))
    base = (F.col("raw_bytes") > 0) & (F.col("raw_bytes") < MIN_RAW_BYTES)
    head = F.regexp_replace(F.hex(F.substring(F.encode(t, "utf-8"), 1, 65536)), "(..)", "$1 ")  # the bytes one by one
    nul = F.when(F.contains(t, F.lit("\0")), F.size(F.regexp_extract_all(head, F.lit("00 "), F.lit(0)))).otherwise(0)
    pruned = F.lit(pruning) & (F.length(t) > 0)
    # One struct after another keeps each text expression evaluated once.
    step = docs.withColumns({"raw_bytes": X.utf8_bytes("text"), "is_code": code, "_words": X.words("text")})
    share = F.when(prose & (F.size("_words") >= MIN_WORDS), trigram_share(F.col("_words"))).otherwise(F.lit(0.0))
    step = step.withColumns({"word_count": F.size("_words"), "_tri": share, "_byte": X.top_byte_share("text")})
    return step.withColumns(
        {
            "empty": F.col("raw_bytes") == 0,
            "short": F.when(prose, short_prose | base).when(pruned, stripped < MIN_CODE_BYTES).otherwise(base),
            "nul_heavy": F.when(F.length(t) > 0, nul / F.least(F.col("raw_bytes"), F.lit(65536)) > 0.01).otherwise(F.lit(False)),
            "extreme_repetition": ((F.col("raw_bytes") >= BYTE_SAMPLE) & (F.col("_byte") >= BYTE_SHARE)) | (F.col("_tri") > TRIGRAM_SHARE),
            "noisy_symbols": F.when(prose & (F.length(t) > SYMBOL_CHARS), kept / F.length(t) < SYMBOL_SHARE).otherwise(F.lit(False)),
            "extremely_long": F.col("raw_bytes") >= LONG_BYTES,
            "ambiguous": F.col("text").isNull(),
        }
    ).drop("_words", "_tri", "_byte")


def skip_reason() -> Column:
    """First reason to skip a flagged document; null if none."""
    return (
        F.when(F.col("ambiguous"), "ambiguous")
        .when(F.col("empty"), "empty")
        .when(F.col("short"), "short")
        .when(F.col("extreme_repetition"), "extreme_repetition")
        .when(F.col("noisy_symbols"), "noisy_symbols")
    )


def dispositions(flagged: DataFrame) -> DataFrame:
    """Disposition of every flagged document: skip, duplicate (a later equal text) or unique.

    Only documents that aren't skipped compete; the least doc_id of a hash wins.
    Texts are dropped and the rest is written once, so flags are computed once;
    the least id per hash is a partial aggregate, so a hot hash doesn't skew.
    """
    marked = flagged.withColumns({"reason": skip_reason(), "content_sha256": X.content_hash("text")}).drop("text")
    marked = shared_checkpoint(marked)
    first = marked.groupBy("content_sha256").agg(F.min(F.when(F.col("reason").isNull(), F.col("doc_id"))).alias("_first"))
    joined = marked.join(first, marked["content_sha256"].eqNullSafe(first["content_sha256"]), "left").drop(first["content_sha256"])
    return joined.withColumn(
        "disposition", F.when(F.col("reason").isNotNull(), "skip").when(F.col("doc_id") > F.col("_first"), "duplicate").otherwise("unique")
    ).drop("_first")


def first_occurrences(docs: DataFrame) -> DataFrame:
    """One row per content hash: its least doc_id, copies and bytes."""
    return fingerprint(docs).groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("raw_bytes").alias("raw_bytes"))


def _spread(rows: DataFrame) -> Column:
    """A last sort key that parts rows which differ in anything but maps."""
    return F.xxhash64(*[F.col(f"`{name}`") for name, kind in rows.dtypes if "map<" not in kind])


def running_sum(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in the order of a column.

    Rows that tie go by their value; null orders come last and null values count as
    nothing. Two levels: the rows are range-partitioned and written with the number of
    their range, whatever the orders' values are; ranges are summed, the small table
    of their sums gets its own running sum, and rows are summed within their range.
    """
    keys = (F.col(order).asc_nulls_last(), F.col(value), _spread(rows))
    ranged = shared_checkpoint(rows.orderBy(*keys).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.sum(value).alias("_s")).select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(F.broadcast(starts), "_range").withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_range", "_local", "_start")  # one row a range


def bucket_shards(docs: DataFrame, target: int) -> DataFrame:
    """Shard of each document by running tokens: ``shard_id`` and ``token_offset`` in it.

    A document belongs to the shard in which its first token falls, per split.
    """
    parts = []
    for split in ("train", "val"):
        part = running_sum(docs.where(F.col("split") == split), "doc_id", "n_tokens", "_start_token")
        parts.append(part.withColumn("shard_id", F.floor(F.col("_start_token") / target).cast("long")))
    rows = parts[0].unionByName(parts[1])
    first = rows.groupBy("split", "shard_id").agg(F.min("_start_token").alias("_first"))
    return rows.join(first, ["split", "shard_id"]).withColumn("token_offset", F.col("_start_token") - F.col("_first")).drop("_start_token", "_first")


class ShardFold:
    """The sequential fold of shard groups, fed with blocks of (is val, tokens) in corpus order."""

    def __init__(self, target: int):
        self.target, self.fill, self.at = target, [0, 0], 0

    def feed(self, val: np.ndarray, tokens: np.ndarray) -> list[int]:
        """Numbers of the rows of this block that start a group (but for the very first)."""
        sums = [np.cumsum(np.where(val == s, tokens, 0)) for s in (0, 1)]
        starts, i, base = [], 0, [0, 0]
        while True:
            reach = [int(np.searchsorted(c, self.target - f + b)) for c, f, b in zip(sums, self.fill, base)]
            j = max(i, min(reach))
            if j >= len(tokens):
                self.fill = [f + int(c[-1] if len(c) else 0) - b for c, f, b in zip(sums, self.fill, base)]
                self.at += len(tokens)
                return starts
            s = int(val[j])
            had = self.fill[s] + int(sums[s][j]) - int(tokens[j]) - base[s]
            i = j if had and had + tokens[j] > self.target else j + 1  # it goes into the next group, or fills this one
            starts.append(self.at + i)
            self.fill, base = [0, 0], [int(c[i - 1]) if i else 0 for c in sums]


def pack_shards(docs: DataFrame, target: int) -> DataFrame:
    """Greedy shards in corpus order, both splits cut together.

    A shard group ends before a document that would take a split's shard past
    ``target`` and after one that reaches it. Where a group ends depends on all
    before, so this one decision is a fold in order: rows, numbered by ranges and
    packed to five bytes each, stream past it block by block, and it jumps from group
    to group by searching running sums. Only the groups' first rows come out, and go
    to a table in portions. Null ids come last, ties go by split and tokens.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "split", F.col("n_tokens").cast("int").alias("n_tokens"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("split"), F.col("n_tokens"))
    numbered = shared_checkpoint(number_rows(narrow, "_k", *order))

    def blocks(batches):
        for batch in batches:
            val, tokens = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            first = batch.column(0)[0].as_py() if len(batch) else 0
            yield pa.RecordBatch.from_pydict({"_k": [first], "val": [val.astype(np.uint8).tobytes()], "tokens": [tokens.astype("<i4").tobytes()]})

    sorted_rows = numbered.select("_k", F.coalesce(F.col("split") == "val", F.lit(False)).alias("val"), F.coalesce("n_tokens", F.lit(0)).alias("n")).orderBy("_k")
    fold, starts, parts = ShardFold(target), [0], []
    for block in sorted_rows.mapInArrow(blocks, "_k long, val binary, tokens binary").toLocalIterator():
        starts += fold.feed(np.frombuffer(block["val"], dtype=np.uint8), np.frombuffer(block["tokens"], dtype="<i4").astype(np.int64))
        if len(starts) > 1_000_000:
            parts.append(shared_checkpoint(spark.createDataFrame(pd.DataFrame({"_k": starts}), "_k long")))
            starts = []
    parts.append(spark.createDataFrame([(k,) for k in starts], "_k long"))
    firsts = reduce(DataFrame.unionByName, parts).withColumn("_first", F.lit(1))
    marked = numbered.join(firsts, "_k", "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    grouped = running_sum(marked, "_k", "_first", "_before").withColumn("shard_id", F.col("_before") + F.col("_first") - 1)
    within = Window.partitionBy("shard_id", "split").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a shard of bounded tokens
    return grouped.select("doc_id", "split", "n_tokens", "shard_id", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("token_offset"))


#: Near-duplicate bands, 16 of 4 rows over sampled word bigrams, and the factors of their hash family.
BANDS, BAND_ROWS, NEAR_BANDS, NEAR_BANDS_CODE = 16, 4, 3, 12
_FACTORS = np.arange(BANDS * BAND_ROWS, dtype=np.uint64)
_MULTIPLY = _FACTORS * np.uint64(10007) + np.uint64(1)
_ADD = _FACTORS * np.uint64(31337) + np.uint64(7)


def band_values(words: list[str]) -> list[int]:
    """Band keys of a text's words: minima of an affine hash family over its bigrams."""
    import xxhash

    if len(words) < 5:
        return []
    step = max(1, (len(words) - 2) // 100)
    seeds = np.array([xxhash.xxh64_intdigest(f"{words[i]} {words[i + 1]}") for i in range(0, len(words) - 2, step)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        least = (seeds[:, None] * _MULTIPLY + _ADD).min(axis=0)
    return [int(np.uint64(xxhash.xxh64_intdigest(least[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), seed=b)).astype(np.int64)) for b in range(BANDS)]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, matching_bands, is_near_duplicate of distinct texts, in corpus order.

    A document is rejected if enough of its bands were seen in accepted earlier
    ones; only accepted documents add bands. ``docs`` has doc_id, text, is_code;
    equal texts are one row, that of the least id. Null texts count as one text without words.

    The sequential rule is settled in rounds without any pairs. Of every band key
    only the least accepted and the least open document count: enough bands seen
    for sure reject, too few that may yet be seen accept, the rest wait. The least
    open document of a key never waits for itself, so every round settles some, and
    rounds go on until all are. Texts themselves are never shuffled.
    """

    @F.pandas_udf("array<long>")
    def bands(words: pd.Series) -> pd.Series:
        return pd.Series([band_values(list(w)) for w in words])

    limit = F.when(F.col("is_code"), NEAR_BANDS_CODE).otherwise(NEAR_BANDS)
    hashed = docs.select("doc_id", "is_code", F.sha2("text", 256).alias("h"), bands(X.words("text")).alias("bands"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("is_code").alias("is_code"), F.min("bands").alias("bands"))
    banded = first.select("doc_id", limit.alias("limit"), "bands")
    keys = shared_checkpoint(banded.select("doc_id", "limit", F.posexplode_outer("bands").alias("band", "key")))
    common = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1 and key is not null").select("band", "key")
    shared = shared_checkpoint(keys.join(common, ["band", "key"]))
    state = shared.select("doc_id").distinct().withColumn("status", F.lit("open"))
    while True:
        rows = shared.join(state, "doc_id")
        of = lambda s: F.min(F.when(F.col("status") == s, F.col("doc_id")))
        least = rows.groupBy("band", "key").agg(of("kept").alias("kept"), of("open").alias("open"))
        seen = rows.join(least, ["band", "key"]).groupBy("doc_id", "limit", "status").agg(
            F.count(F.when(F.col("kept") < F.col("doc_id"), 1)).alias("sure"),
            F.count(F.when(F.least("kept", "open") < F.col("doc_id"), 1)).alias("may"),
        )
        settled = F.when(F.col("status") != "open", F.col("status")).when(F.col("sure") >= F.col("limit"), "rejected").when(F.col("may") < F.col("limit"), "kept").otherwise("open")
        state = shared_checkpoint(seen.select("doc_id", settled.alias("status")))
        if state.where("status = 'open'").isEmpty():
            break
    kept = shared.join(state.where("status = 'kept'"), "doc_id").groupBy("band", "key").agg(F.min("doc_id").alias("kept"))
    counts = shared.join(kept, ["band", "key"]).groupBy("doc_id").agg(F.count(F.when(F.col("kept") < F.col("doc_id"), 1)).alias("matching_bands"))
    ids = keys.select("doc_id").distinct()
    return ids.join(counts, "doc_id", "left").join(state, "doc_id", "left").select(
        "doc_id", F.coalesce("matching_bands", F.lit(0)).cast("int").alias("matching_bands"), F.coalesce(F.col("status") == "rejected", F.lit(False)).alias("is_near_duplicate")
    )


def chat_text(turns: DataFrame) -> DataFrame:
    """One document per conversation: its messages in turn order.

    A conversation with a null text has none itself. Role names lose line ends
    and ``|>`` and are cut at 80 characters.
    """
    role = F.substring(F.replace(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.lit(" ")), F.lit("|>"), F.lit("")), 1, 80)
    message = F.concat(F.lit("<|message:"), role, F.lit("|>\n"), F.col("text"), F.lit("\n<|end_message|>"))
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"), F.count("*").alias("messages"), F.count(F.when(message.isNull(), 1)).alias("bad")
    )
    return grouped.select("conv_id", "messages", F.when(F.col("bad") == 0, F.array_join(F.transform("ms", lambda x: x["m"]), "\n")).alias("text"))


def paired_fields(first: str, second: str) -> Column:
    """Two named fields rendered one after the other; null if either is empty."""
    part = lambda f: F.concat(F.lit(f"<|field:{f}|>\n"), F.col(f), F.lit("\n<|end_field|>"))
    return F.when((F.col(first) != "") & (F.col(second) != ""), F.concat(part(first), F.lit("\n"), part(second)))


def extract_text(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Text of dynamic records by field priority: pairs first, then the first non-empty field.

    Adds text, fields and ambiguity; only columns that exist are read.
    """
    present = [f for f in fields if f in rows.columns]
    has = lambda f: F.coalesce(F.col(f), F.lit("")) != ""
    text, used = F.lit(None).cast("string"), F.array().cast("array<string>")
    for f in reversed(present):
        text, used = F.when(has(f), F.col(f)).otherwise(text), F.when(has(f), F.array(F.lit(f))).otherwise(used)
    for a, b in (("question", "answer"), ("prompt", "response")):
        if a in present and b in present:
            both = has(a) & has(b)
            text, used = F.when(both, paired_fields(a, b)).otherwise(text), F.when(both, F.array(F.lit(a), F.lit(b))).otherwise(used)
    others = [c for c, t in rows.dtypes if t == "string" and c not in present]
    names = F.array_compact(F.array(*[F.when(has(c), F.lit(c)) for c in others])) if others else F.array().cast("array<string>")
    why = F.concat(F.lit("no configured text field; string fields=["), F.array_join(F.transform(F.slice(names, 1, 12), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    return rows.withColumns({"text": text, "fields": used}).withColumn("ambiguity", F.when(F.col("text").isNull(), why))


def labels_of(row_columns: dict[str, Column]) -> Column:
    """Label map of the given columns: nulls left out, values cut at 512 characters."""
    pairs = [x for k, v in row_columns.items() for x in (F.lit(k), F.left(v.cast("string"), F.lit(512)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
