"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, let, text_rows

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
BITS_A_GRAM = 16
FILTER_BITS = 1 << 16, 1 << 26  # least and most
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words: A-Z lower-cased, then runs of a-z, 0-9 and everything beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), WORD_BREAK), "")


def windows_of(words: Column, size: int) -> Column:
    """Hash of each window of the given size, in order; empty if there are fewer words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (size, gram, items): every window of `window` item words, or all words of a shorter item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    items = items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("size"))
    grams = items.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.col("size"))))).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.collect_set("item").alias("items"))


def filter_bits(grams: int) -> int:
    """A power of two with BITS_A_GRAM or more bits a gram, within FILTER_BITS: beyond, more windows pass, and none is lost."""
    return min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (BITS_A_GRAM * grams).bit_length()))


def bit_filter(grams: DataFrame, size: int, bits: int) -> Column:
    """A literal of bits/64 longs: bit (hash mod bits) is set for each gram."""
    slot = F.pmod(F.xxhash64(F.split("gram", " ")), F.lit(bits))
    words = grams.where(F.col("size") == size).select(slot.alias("s")).distinct().groupBy(F.floor(F.col("s") / 64).cast("int").alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("v"))
    held = [0] * (bits // 64)
    for k, v in words.collect():  # at most bits/64 rows
        held[k] = v
    return F.from_json(F.lit(json.dumps(held)), "array<bigint>")


def gram_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, id_type: str = "long") -> tuple[DataFrame, DataFrame]:
    """(rows: rid, doc_id, n_words) and (hits: rid, pos, size, items), one hit per occurrence of a benchmark window."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    grams = scratch.table(benchmark_grams(benchmark, window), "grams")
    items_bytes = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    of_sizes = grams.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram") + items_bytes + 64).alias("bytes")).collect()  # at most `window` rows
    sizes = {r["size"]: filter_bits(r["n"]) for r in of_sizes}

    def of_size(words: Column, size: int) -> Column:
        bits = bit_filter(grams, size, sizes[size])
        slots = F.transform(windows_of(words, size), lambda h, i: F.struct(F.pmod(h, F.lit(sizes[size])).cast("int").alias("s"), i.alias("i")))
        maybe = F.filter(slots, lambda x: F.getbit(F.element_at(bits, F.shiftright(x.s, 6) + 1), x.s.bitwiseAND(63)) == 1)
        return F.transform(maybe, lambda x: F.struct(x.i.alias("pos"), F.lit(size).alias("size"), F.concat_ws(" ", F.slice(words, x.i + 1, size)).alias("gram")))

    def candidates(words: Column) -> Column:
        return F.concat(*(of_size(words, size) for size in sizes)) if sizes else F.array().cast("array<struct<pos:int,size:int,gram:string>>")

    seen = text_rows(docs, id_type=id_type).select(F.monotonically_increasing_id().alias("rid"), "doc_id", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), candidates(w).alias("maybe"))).alias("x"))
    seen = scratch.table(seen.select("rid", "doc_id", F.col("x.n").cast("long").alias("n_words"), F.col("x.maybe").alias("maybe")), "scanned")
    # The bit filter only narrows; equality of the whole window decides.
    small = sum(r["bytes"] for r in of_sizes) <= broadcast_bytes
    maybe = seen.select("rid", F.explode("maybe").alias("m")).select("rid", "m.pos", "m.size", "m.gram")
    hits = maybe.join(F.broadcast(grams) if small else grams, ["size", "gram"]).select("rid", "pos", "size", "items")
    return seen.select("rid", "doc_id", "n_words"), scratch.table(hits, "hits")


def spans(hits: DataFrame) -> DataFrame:
    """Per row: merged word spans [start, end) that lie inside a benchmark window, and the items hit."""
    ends = F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("size")).alias("end"))))
    held = hits.groupBy("rid").agg(ends.alias("s"))
    merged = F.aggregate(
        "s", F.array().cast("array<struct<pos:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x.pos <= F.element_at(acc, -1).end), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).pos.alias("pos"), F.greatest(F.element_at(acc, -1).end, x.end).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    items = hits.select("rid", F.explode("items").alias("item")).distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return held.select("rid", merged.alias("spans")).join(items, "rid", "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_type: str = "long") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    A word is hit if it lies inside any occurrence of a benchmark window (13 consecutive item words, or all words of
    a shorter item). Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and no
    hits; benchmark rows with null or wordless texts have no window; a null item_id has no name and is left out of
    items. Repeated rows are judged each on its own; an empty table gives an empty result, an empty benchmark none hit.

    Each text is read once. Inside its row, window hashes are held against a bit filter sized by the number of benchmark
    windows; the few windows that pass leave as rows and meet the windows themselves in a hash join, broadcast up to a
    bound on their bytes.
    """
    rows, hits = gram_hits(docs, benchmark, window, id_type=id_type)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x.end - x.pos).cast("long")
    found = rows.join(spans(hits), "rid", "left")
    found = found.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<pos:int,end:int>>")).alias("spans"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input without contaminated documents; columns stay as they are. A row goes if its id and text were judged contaminated."""
    names = docs.columns
    # 256 bits of id and text, so that no clean row shares them with a contaminated one.
    own = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.withColumn("_tl_key", own)
    judged = decontaminate(keyed.select(F.col("_tl_key").alias("doc_id"), "text"), benchmark, window, "string").where("contaminated").select(F.col("doc_id").alias("_tl_key")).distinct()
    return keyed.join(judged, "_tl_key", "left_anti").select(*names)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM bs)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, n, k FROM dw JOIN bw USING (n, gram)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
