"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, a scan of token windows, exact verification.

The hash of every word window of every text is looked up in the set of the benchmark's window hashes; the few places
that pass get their window's text built and compared with the benchmark's. What a text has in common with the benchmark
depends on the text alone, so findings go by its digest and meet the rows again in one join. Only findings are shuffled.
Everything is DataFrame functions, at any size of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampline.llm.common import release, stage, words

SIZE = 13
#: Distinct window hashes up to which their set is broadcast (some 32 bytes each); beyond, windows meet it by a shuffled join.
BROADCAST_HASHES = 4_000_000
#: Bytes of findings, or of benchmark windows with their items, up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: A word before A-Z are lower-cased, for texts as they are written.
WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOUND = "__d string, n_hit long, items array<string>, spans array<struct<first:int,words:int>>"


def _hash(w: str, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(w), i + F.lit(p)) for p in range(k)])


def _places(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Each window of the word arrays __w, of each length: __i (place), len, h (hash), beside the other columns."""
    at = df.where(F.size("__w") >= min(lengths)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.size("__w") - min(lengths))))
    own = [F.struct(F.lit(k).alias("len"), _hash("__w", F.col("__i"), k).alias("h")) for k in lengths]
    if len(own) == 1:
        return at.withColumn("len", F.lit(lengths[0])).withColumn("h", _hash("__w", F.col("__i"), lengths[0]))
    each = at.withColumn("__x", F.explode(F.array(*own))).where(F.col("__i") + F.col("__x.len") <= F.size("__w"))
    return each.withColumn("len", F.col("__x.len")).withColumn("h", F.col("__x.h")).drop("__x")


def _window() -> Column:
    return F.array_join(F.slice("__w", F.col("__i") + 1, F.col("len")), " ")


def benchmark_windows(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", size: int = SIZE) -> DataFrame:
    """Distinct (len, h, window, item): the windows of each item; one of fewer words than size, but not none, is one window.

    Items of null text, or without words, have none; a null id is no item.
    """
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("__w")).where("size(__w) > 0 and item is not null")
    whole = w.where(F.size("__w") >= size)
    out = _places(whole, [size]).select("len", "h", _window().alias("window"), "item")
    for k in range(1, size):
        out = out.unionByName(_places(w.where(F.size("__w") == k), [k]).select("len", "h", _window().alias("window"), "item"))
    return out.distinct()


def _bounded(df: DataFrame, size: Column, most: int) -> DataFrame:
    """df, broadcast if its bytes are known to be few."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE, bench_text: str = "text", bench_id: str = "item_id", hashes: int = BROADCAST_HASHES, most: int = BROADCAST_BYTES) -> DataFrame:
    """(__d, n_hit, items, spans) of each distinct text, by its MD5, that holds a window of the benchmark.

    n_hit: words inside any occurrence; spans: their runs as (first word, words); items: sorted ids of the items found.
    The table is written in the shared folder.
    """
    bench = stage(benchmark_windows(benchmark, bench_text, bench_id, size))
    lengths = sorted(r["len"] for r in bench.select("len").distinct().collect())  # at most size
    if not lengths:
        return stage(df.sparkSession.createDataFrame([], FOUND))
    known = bench.select("h").distinct()
    if known.count() <= hashes:
        known = F.broadcast(known)
    texts = df.select(F.md5(F.col(text_col).cast("binary")).alias("__d"), words(F.col(text_col)).alias("__w"))
    passed = _places(texts, lengths).join(known, "h").select("__d", "__i", "len", _window().alias("window"))
    owned = _bounded(bench.select("len", "window", "item"), F.octet_length("window") + F.octet_length("item") + 32, most)
    hits = stage(passed.distinct().join(owned, ["len", "window"]).select("__d", "__i", (F.col("__i") + F.col("len")).alias("e"), "item"))
    # runs of hit words: a place beyond all ends before it begins a new one
    places = hits.groupBy("__d", "__i").agg(F.max("e").alias("e"))
    order = W.partitionBy("__d").orderBy("__i")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = places.withColumn("__new", (F.coalesce(before, F.lit(-1)) < F.col("__i")).cast("int"))
    runs = new.withColumn("__run", F.sum("__new").over(order)).groupBy("__d", "__run").agg(F.min("__i").alias("first"), F.max("e").alias("e"))
    spans = runs.groupBy("__d").agg(F.sum(F.col("e") - F.col("first")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", (F.col("e") - F.col("first")).alias("words")))).alias("spans"))
    items = hits.groupBy("__d").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = stage(spans.join(items, "__d").select("__d", "n_hit", "items", "spans"))
    release(bench, hits)
    return out


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE, bench_text: str = "text", bench_id: str = "item_id", keep: list[str] | None = None, hashes: int = BROADCAST_HASHES, most: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: the columns `keep` (all by default), n_words, n_hit, items (sorted strings), contaminated, spans.

    A word is hit if it lies in an occurrence of a benchmark window; contaminated: at least a word in twenty is hit.
    spans: the hit words' runs as (first word, words). Null text has no words. Rows that repeat keep their number;
    columns of df that are named like a result are replaced. An empty benchmark hits nothing. Above `hashes` distinct
    window hashes, or `most` bytes of findings, joins shuffle where they broadcast below; the results are the same.
    """
    keep = [c for c in (keep or df.columns) if c not in ("n_words", "n_hit", "items", "contaminated", "spans")]
    found = find_contamination(df, benchmark, text_col, size, bench_text, bench_id, hashes, most)
    found = _bounded(found, F.lit(64) + F.size("spans") * 16 + F.octet_length(F.array_join("items", " ")), most)
    rows = df.select(*[F.col(c).alias(f"__k_{c}") for c in keep], F.md5(F.col(text_col).cast("binary")).alias("__d"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, "__d", "left").select(
        *[F.col(f"__k_{c}").alias(c) for c in keep], "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<first:int,words:int>>")).alias("spans"),
    )


def remove_spans(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Take the words of the spans (first word, words; ascending and apart) out of the text, each with what stands between
    it and the next word. Texts without spans, and nulls, stay as they are."""
    t, spans = F.col(text_col), F.col(spans_col)
    units = F.zip_with(F.regexp_extract_all(t, F.lit(WRITTEN), F.lit(0)), F.slice(F.split(t, WRITTEN, -1), F.lit(2), F.greatest(F.size(F.split(t, WRITTEN, -1)) - 1, F.lit(0))), lambda w, gap: F.concat(w, gap))
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get(spans, j - 1)["first"] + F.get(spans, j - 1)["words"])
    kept = lambda u: F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda j: F.slice(u, begin(j) + 1, F.coalesce(F.get(spans, j)["first"], F.size(u)) - begin(j))))
    rest = F.element_at(F.transform(F.array(units), lambda u: F.array_join(kept(u), "")), 1)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, F.concat(F.get(F.split(t, WRITTEN, -1), F.lit(0)), rest)).otherwise(t))


def decontaminate(df: DataFrame, benchmark: DataFrame, how: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """df without its contaminated rows (how="documents"), or with all hit words taken out of every text (how="spans").

    Columns and row order of names stay as they are; for nulls, repeats and empty tables see contamination().
    """
    if how not in ("documents", "spans"):
        raise ValueError("how must be documents or spans")
    own = df.select(F.struct(*df.columns).alias("__row"), F.col(text_col).alias("__text"))
    found = contamination(own, benchmark, "__text", keep=["__row", "__text"], **options)
    if how == "documents":
        return found.where("not contaminated").select("__row.*")
    cleaned = remove_spans(found, "__text").select("__row", "__text")
    return cleaned.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in df.columns])
