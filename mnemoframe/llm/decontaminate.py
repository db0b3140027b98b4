"""Benchmark decontamination by winnowing, in DataFrame expressions only.

The hash of every K consecutive words is a k-gram hash; of every WINDOW - K + 1 consecutive ones the smallest is kept.
Two texts that share WINDOW words keep the same hash there, whatever surrounds it, so joining the kept hashes of
documents and items misses no shared window. Items of fewer words are one window of their own length; for each such
length that occurs, the documents' hashes of that length join too. Hits are extended: in the documents that
share a hash, the windows with that hash are compared with the items' windows word by word, and the words of equal
windows are counted once.

Kept hashes per document are written to the shared folder. The items' hashes and windows are broadcast only while
their counted number of rows is below BROADCAST_ROWS, else joined by shuffle. Rows are found again by id and text hash, so
repeated ids and rows, and null ids, keep their own results. Null and empty texts have no words; items without words
occur nowhere; an item with a null id marks words but is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of, with_words, written

WINDOW = 10
K = 5
BROADCAST_ROWS = 200_000


def gram_hashes(words: str, n: int, *salt: Column) -> Column:
    """Hash of each run of n words."""
    each = F.transform(words, lambda w, i: F.xxhash64(*salt, w, *[F.get(words, i + j) for j in range(1, n)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def least_hashes(hashes: str, n: int) -> Column:
    """The smallest of each n consecutive hashes."""
    each = F.transform(hashes, lambda h, i: F.least(h, *[F.get(hashes, i + j) for j in range(1, n)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def worded(docs: DataFrame, text: Column) -> DataFrame:
    return with_words(docs.withColumn("_text", text), ascii_lower(F.col("_text"))).drop("_text", "_line")


def with_marks(df: DataFrame, short: list[int], window: int, k: int) -> DataFrame:
    """_marks: for each window length the hash of each window, in order of position."""
    df = df.withColumn("_grams", gram_hashes("_words", k))
    lists = [least_hashes("_grams", window - k + 1), *[gram_hashes("_words", n, F.lit(n)) for n in short]]
    return df.withColumn("_marks", F.array(*lists)).drop("_grams")


def item_windows(items: DataFrame, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """(item_id, n, mark, line): every window of the items, with its hash and its words."""
    w = worded(items.select(F.col(item_id).alias("item_id"), text_of(text).alias("_item")), F.col("_item")).select("item_id", "_words").where(F.size("_words") > 0)
    n = F.least(F.size("_words"), F.lit(window))
    at = w.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.slice("_words", i, n))).alias("_words"))
    grams = at.withColumn("_grams", gram_hashes("_words", k))
    short = F.xxhash64("n", *[F.get("_words", F.lit(j)) for j in range(window - 1)])
    return grams.select("item_id", "n", F.when(F.col("n") == window, F.array_min("_grams")).otherwise(short).alias("mark"), F.array_join("_words", " ").alias("line"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, text_hash, n_words, n_hit, items): one row per row of docs; items are the ids as text, sorted."""
    known = written(item_windows(items, item_id, item_text, window, k), "items")
    count = known.count()
    short = sorted(r.n for r in known.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 lengths
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("_doc")).withColumn("text_hash", F.xxhash64("_doc"))
    all_marks = with_marks(worded(plain, F.col("_doc")).drop("_doc"), short, window, k)
    kept = written(all_marks.select("id", "text_hash", F.size("_words").cast("long").alias("n_words"), F.array_distinct(F.flatten("_marks")).alias("marks")), "marks")
    met = kept.select("id", "text_hash", F.explode("marks").alias("mark")).join(small(known.select("mark").distinct(), count), "mark")
    found = written(met.groupBy("id", "text_hash").agg(F.collect_set("mark").alias("found")), "met")
    other = found.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "found")
    again = plain.join(other, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).select("id", "text_hash", "found", "_doc")
    marked = with_marks(worded(again, F.col("_doc")).drop("_doc"), short, window, k)

    def places(j: int, n: int) -> Column:
        starts = F.filter(F.transform(F.get("_marks", F.lit(j)), lambda m, i: F.when(F.array_contains("found", m), i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("_words", i + 1, F.lit(n)), " ").alias("line")))

    spots = marked.select("id", "text_hash", F.explode(F.concat(*[places(j, n) for j, n in enumerate([window, *short])])).alias("s")).select("id", "text_hash", "s.at", "s.n", "s.line")
    shared = spots.join(small(known.select("line", F.col("item_id").cast("string").alias("item")).distinct(), count), "line")
    by_doc = shared.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spots"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate("spots", F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), lambda a, s: F.struct(
        F.greatest(a.end, s.at + s.n).alias("end"), (a.total + F.greatest(F.lit(0), s.at + s.n - F.greatest(a.end, s.at))).alias("total")), lambda a: a.total)
    result = by_doc.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), covered.cast("long").alias("n_hit"), "items")
    return kept.select("id", "text_hash", "n_words").join(result, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left").select(
        "id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs in which no window of an item occurs, columns as given."""
    bad = hits(docs, items, doc_id, text, **how).where("n_hit > 0").select(F.col("id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_i"]) & (F.xxhash64(text_of(text)) == bad["_h"]), "left_anti")
