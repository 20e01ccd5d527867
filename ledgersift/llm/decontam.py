"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed once, k consecutive word hashes make a gram hash, and of each w consecutive grams the smallest hash is
kept. A span of k + w - 1 words holds exactly one such window of grams, so with k + w - 1 = 10 each ten-word window
has one winnowed fingerprint, the same in a document and in a benchmark item: every shared span of that length is found.
Items shorter than a window are one window of their own length (at most nine more lengths, only those that occur).

A document reports each distinct fingerprint once, the fingerprints that a benchmark item has too come out of one join, and for
those documents alone the hits are extended: at the places of these fingerprints, and nowhere else, the window's words are compared with the
items' windows. Items come in once a document, by the sets of items that share a window. What is broadcast is counted first, in rows and bytes: the
benchmark's fingerprints and windows, and the documents with a fingerprint, each up to ``broadcast_rows``; beyond that the join is shuffled and Spark
splits its skewed partitions. So while few documents have a fingerprint, no text is shuffled.

Defined cases: a very long text is one row, its words one array; null text and text without words have n_words 0 and no hit; an item without words, or null, matches nothing; an
item with a null id makes hits but is in no list; equal rows get equal results (rows are told apart by id and text, not by position);
empty tables on either side give no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.sizes import BROADCAST_ROWS, sent
from ledgersift.scratch import Scratch

SPAN = 10
GRAM = 6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: a lambda's variable is never inlined."""
    return F.transform(F.array(value), then)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    each = text
    for code in range(ord("A"), ord("Z") + 1):
        each = F.replace(each, F.lit(chr(code)), F.lit(chr(code).lower()))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(each)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(span: int, gram: int) -> int:
    return gram if span == SPAN else max(1, (span * gram + SPAN - 1) // SPAN)


def winnow(hashes: Column, span: int, gram: int = GRAM) -> Column:
    """For each place where ``span`` words start, the smallest gram hash among the span's grams."""
    k = _gram(span, gram)
    w = span - k + 1
    runs = lambda a, n: F.slice(a, 1, F.greatest(F.size(a) - (n - 1), F.lit(0)))
    grams = lambda h: F.transform(runs(h, k), lambda x, i: F.xxhash64(F.lit(span), x, *[F.get(h, i + j) for j in range(1, k)]))
    if w == 1:
        return grams(hashes)
    return let(grams(hashes), lambda g: F.transform(runs(g, w), lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, w)])))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _winnowed(span: int, gram: int):
    return lambda hashes: winnow(hashes, span, gram)


def _print(span: int):
    return lambda fp: F.struct(F.lit(span).alias("span"), fp.alias("fp"))


def _spots(hashes: Column, span: int, gram: int) -> Column:
    """The places whose fingerprint the benchmark has (``fps``), and the words of their windows."""
    places = F.transform(winnow(hashes, span, gram), lambda fp, i: F.struct(i.alias("at"), fp.alias("fp")))
    met = F.filter(places, lambda p: F.array_contains("fps", p["fp"]))
    words = lambda p: F.array_join(F.slice("words", p["at"] + 1, span), " ")
    return F.transform(met, lambda p: F.struct(F.lit(span).alias("span"), p["at"].alias("at"), p["fp"].alias("fp"), words(p).alias("window")))


def _items(bench: DataFrame, span: int, gram: int, text: str, key: str) -> tuple[DataFrame, list[int]]:
    """Windows of the benchmark: (span, fp, window, item_id); and the lengths of windows that occur."""
    words = bench.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("span", F.least(F.size("words"), F.lit(span)))
    lengths = sorted(r[0] for r in words.select("span").distinct().collect())  # span numbers at most
    parts = []
    for n in lengths:
        at = F.posexplode(let(hashes_of(F.col("words")), _winnowed(n, gram))).alias("at", "fp")
        part = words.filter(F.col("span") == n).select("item_id", "words", at)
        parts.append(part.select(F.lit(n).alias("span"), "fp", F.array_join(F.slice("words", F.col("at") + 1, n), " ").alias("window"), "item_id"))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, lengths


def contamination(docs: DataFrame, bench: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items`` (ids as sorted strings)."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    none = F.array().cast("array<string>")
    items, lengths = _items(bench, span, gram, item_text, item_key)
    if not lengths:
        return base.select("doc_id", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    grouped = items.groupBy("span", "fp", "window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    grouped = scratch.save(grouped.withColumn("item_set", F.md5(F.to_json("items"))), "windows")
    windows = sent(grouped.select("span", "fp", "window", "item_set"), F.octet_length("window") + 48, broadcast_rows)
    item_sets = scratch.save(grouped.groupBy("item_set").agg(F.first("items").alias("items")), "item-sets")
    item_sets = sent(item_sets, F.octet_length(F.to_json("items")) + 32, broadcast_rows)
    marks = sent(grouped.select("span", "fp").distinct(), F.lit(16), broadcast_rows)

    # span 0 marks the row that stands for the document itself; its fp is only there to spread those rows
    own = F.struct(F.lit(0).alias("span"), F.col("text_hash").alias("fp"))
    prints = lambda h: F.concat(F.array(own), *[F.transform(F.array_distinct(winnow(h, n, gram)), _print(n)) for n in lengths])
    reported = base.select("doc_id", "text_hash", let(hashes_of(words_of(F.col("text"))), lambda h: F.struct(F.size(h).alias("n"), prints(h).alias("prints"))).alias("r"))
    exploded = reported.select("doc_id", "text_hash", F.col("r.n").alias("n"), F.inline("r.prints"))
    met = exploded.join(marks.withColumn("met", F.lit(True)), ["span", "fp"], "left").filter(F.col("met") | (F.col("span") == 0))
    per_doc = scratch.save(
        met.groupBy("doc_id", "text_hash").agg(
            F.max("n").cast("long").alias("n_words"), F.sum(F.when(F.col("span") == 0, 1).otherwise(0)).alias("rows"), F.collect_set(F.when(F.col("span") > 0, F.col("fp"))).alias("fps")
        ),
        "reported",
    )
    # extend: the candidates' windows at those fingerprints, whole words against whole words
    cand = per_doc.filter(F.size("fps") > 0).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "fps")
    cand = sent(cand, F.size("fps") * 8 + 32, broadcast_rows)
    texts = base.join(cand, base.text_hash.eqNullSafe(cand.t) & base.doc_id.eqNullSafe(cand.d)).dropDuplicates(["doc_id", "text_hash"])
    worded = texts.select("doc_id", "text_hash", "fps", words_of(F.col("text")).alias("words"))
    spots = let(hashes_of(F.col("words")), lambda h: F.concat(*[_spots(h, n, gram) for n in lengths]))
    found = worded.select("doc_id", "text_hash", F.inline(spots))
    hits = found.join(windows, ["span", "fp", "window"]).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("at", "span")).alias("places"), F.collect_set("item_set").alias("item_sets")
    )
    hits = scratch.save(hits, "hits")
    named = hits.select("doc_id", "text_hash", F.explode("item_sets").alias("item_set")).join(item_sets, "item_set")
    named = named.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_place = hits.join(named, hits.text_hash.eqNullSafe(named.t) & hits.doc_id.eqNullSafe(named.d)).drop("d", "t")
    reach = F.aggregate(
        F.sort_array("places"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.greatest(p["at"] + p["span"] - F.greatest(acc["end"], p["at"]), F.lit(0))).alias("n"), F.greatest(acc["end"], p["at"] + p["span"]).alias("end")),
        lambda acc: acc["n"],
    )
    hit = per_place.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), reach.alias("n_hit"), "items")
    joined = per_doc.join(hit, per_doc.text_hash.eqNullSafe(hit.t) & per_doc.doc_id.eqNullSafe(hit.d), "left")
    out = joined.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "rows")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows", "copy")
