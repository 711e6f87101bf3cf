"""Benchmark decontamination by winnowing, DataFrame operations only.

Words are what is left of a text between ASCII characters that are no digits or
letters, with A to Z lower-cased. A window is ``WINDOW`` consecutive words of an
item; an item of fewer words, but not none, is one window. A document's word
inside any occurrence of a window is hit.

1. Documents are taken in pieces of ``PIECE_WORDS`` words, each followed by the
   first words of the next, so that every window lies in one piece and no array
   grows with a text.
2. Winnowing: of the hashes of ``GRAM`` consecutive words the least of every
   ``WINDOW - GRAM + 1`` consecutive ones is kept, on both sides. A shared span
   of ``WINDOW`` words has the same hashes on both sides, so the same least one:
   it is never missed. Shorter items lower the span to their length; those with
   fewer words than ``GRAM`` have hashes of their own length, all kept.
3. The documents' kept hashes meet those of the items in a semi-join: a broadcast
   if the items' are counted to be few, a shuffle otherwise.
4. A hit is extended, in the pieces that have one only: the windows around it are
   compared, word by word, with the items'. So the result is exact, whatever
   hashes meet.
5. Windows name the set of items that have them, and documents of equal sets of
   sets share one list of items: it is made once, not for each document. Equal
   texts are searched once.

Defined results: null has no words; null and empty items have no windows;
items of equal text count each, by their ids (null ids last of all, as empty
strings); repeated documents give repeated rows; empty tables give no hits, or
no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import join_by_key
from .common import broadcast_if_small, let, text_of, written

WINDOW = 10
GRAM = 5
PIECE_WORDS = 4096
# Characters that are in no word, and those that are; then runs of a bounded number of words.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _runs(most: int) -> str:
    """A pattern of up to ``most`` words; possessive, so that it does not recurse."""
    return f"{_WORD}++(?:{_BETWEEN}++{_WORD}++){{0,{most - 1}}}+"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; nothing else changes. ``lower`` does the same, faster, where all characters have one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words of a text that begins and ends with one, or is empty."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _BETWEEN + "+", -1))


def pieces(text: Column, words: int = PIECE_WORDS, window: int = WINDOW) -> Column:
    """The text's runs of ``words`` words, each with the first ``window - 1`` words of the next."""

    def overlapping(runs: Column) -> Column:
        more = F.transform(F.slice(runs, 2, F.size(runs)), lambda r: F.concat(F.lit(" "), F.regexp_extract(r, _runs(window - 1), 0)))
        return F.when(F.size(runs) < 2, runs).otherwise(F.zip_with(runs, more, lambda r, m: F.concat(r, F.coalesce(m, F.lit("")))))

    return let(F.regexp_extract_all(text, F.lit(_runs(words)), F.lit(0)), overlapping)


def grams(words: Column, n: int) -> Column:
    """(hash, -place) of ``n`` consecutive words, from the words' hashes."""

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        made = F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)]).alias("hash"), (-i).alias("at")))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))

    return let(words, hashed)


def winnowed(placed: Column, width: int) -> Column:
    """The least of every ``width`` consecutive grams (the last of equal ones), each once."""
    if width == 1:
        return placed

    def least(g: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(g) - width + 1)
        return F.when(F.size(g) >= width, F.transform(at, lambda i: F.array_min(F.slice(g, i, width)))).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))

    # The same least gram comes once or several times running: it stays where it differs from the one before.
    return let(let(placed, least), lambda m: F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["at"] != x["at"])))


def tiers(lengths: list[int], gram: int = GRAM) -> list[tuple[int, int, list[int]]]:
    """(words of a gram, grams of which one is kept, lengths of windows) that find windows of all the given lengths."""
    long = [n for n in lengths if n >= gram]
    return [(n, 1, [n]) for n in lengths if n < gram] + ([(gram, min(long) - gram + 1, long)] if long else [])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, n): every window of every item, as text with one space between words; n is its length."""
    text = lower_ascii(text_of())
    inner = F.regexp_extract_all(text, F.lit(_WORD + "+"), F.lit(0))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), inner.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    made = let(F.col("w"), lambda w: F.transform(starts, lambda i: F.array_join(F.slice(w, i, window), " ")))
    return rows.select("item_id", F.explode(made).alias("words"), F.least(F.size("w"), F.lit(window)).alias("n"))


def _struct_join(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A broadcast if ``small`` is counted to be few rows, else a join in which AQE can split a hot key."""
    marked = broadcast_if_small(small)
    return rows.join(marked, key, how) if marked is not small else join_by_key(rows, small, key, how)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, piece_words: int = PIECE_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = written(item_windows(items, window), "leak-items")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``window`` numbers
    levels = tiers(lengths, gram)

    digest = F.unhex(F.sha2(text_of().cast("binary"), 256))
    text = lower_ascii(text_of())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"), F.posexplode_outer(pieces(text, piece_words, window)).alias("piece", "words"))
    rows = rows.select("doc_id", "digest", F.coalesce("piece", F.lit(0)).alias("piece"), words_of(F.coalesce("words", F.lit(""))).alias("w"))
    rows = rows.select("doc_id", "digest", "piece", (F.col("piece").cast("bigint") * piece_words + F.size("w")).alias("upto"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    kept = F.concat(*[_tiered(winnowed(grams(F.col("h"), n), width), k) for k, (n, width, _) in enumerate(levels)]) if levels else F.array()
    rows = written(rows.select("doc_id", "digest", "piece", "upto", kept.cast(_KEPT).alias("kept")), "leak-documents")

    # Fingerprints of the items: every window's own, so that short items have theirs.
    each = windows.select("words", "n").distinct().withColumn("h", F.transform(F.split("words", " "), lambda x: F.xxhash64(x)))
    known = None
    for k, (n, width, of) in enumerate(levels):
        some = each.filter(F.col("n").isin(of)).select(F.explode(winnowed(grams(F.col("h"), n), width)).alias("x")).select(F.col("x.hash").alias("hash"), F.lit(k).alias("tier"))
        known = some if known is None else known.union(some)
    if known is None:
        found = rows.select("digest", F.lit(0).cast("bigint").alias("n_hit"), F.lit(None).cast("string").alias("sets")).limit(0)
        sets = windows.select(F.lit(None).cast("string").alias("set_id"), "item_id").limit(0)
    else:
        found, sets = _found(docs, rows, windows, written(known.distinct(), "leak-known"), levels, piece_words, window)
    lists = _lists(found, sets)
    told = written(found.join(lists, "sets", "left").select("digest", "n_hit", "n_items", "items_sha256"), "leak-told") if known is not None else found.select("digest", "n_hit", F.lit(0).cast("bigint").alias("n_items"), F.lit("").alias("items_sha256"))

    whole = rows.groupBy("digest").agg(F.max("upto").alias("n_words"))
    each_doc = rows.filter("piece = 0").select("doc_id", "digest")
    out = _struct_join(_struct_join(each_doc, written(whole, "leak-words"), "digest"), told, "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _tiered(placed: Column, tier: int) -> Column:
    return F.transform(placed, lambda x: F.struct(x["hash"].alias("hash"), F.lit(tier).alias("tier"), (-x["at"]).alias("at")))


_KEPT = "array<struct<hash:bigint,tier:int,at:int>>"


def _found(docs: DataFrame, rows: DataFrame, windows: DataFrame, known: DataFrame, levels: list, piece_words: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(digest, n_hit, sets) of the texts that have a window, and (set_id, item_id)."""
    # A piece's number of 64 bits is enough here: were two to meet, both would be searched at places of the other, without finding more.
    piece_key = F.xxhash64("digest", "piece").alias("row")
    kept = rows.select(piece_key, F.explode("kept").alias("k")).select("row", "k.hash", "k.tier", "k.at")
    marked = broadcast_if_small(known)
    if marked is not known:
        hits = kept.join(marked, ["hash", "tier"], "left_semi")
    else:
        key = known.select(F.struct("hash", "tier").alias("_key"))
        hits = kept.join(key, F.struct("hash", "tier") == F.col("_key"), "left_semi")
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("tier", "at")).alias("hits"))
    hits = rows.select("digest", "piece", piece_key).distinct().join(hits, "row").drop("row")
    hits = written(hits, "leak-hits")

    # The texts with a hit, each once, and their pieces with one.
    text = lower_ascii(text_of()).alias("text")
    digests = written(hits.select("digest").distinct(), "leak-digests")
    marked = broadcast_if_small(digests)
    texts = docs.select(F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"), text)
    texts = texts.join(marked, "digest", "left_semi") if marked is not digests else texts.join(digests.select(F.struct("digest").alias("_key")), F.struct("digest") == F.col("_key"), "left_semi")
    texts = texts.dropDuplicates(["digest"])
    parts = texts.select("digest", F.posexplode(pieces(F.col("text"), piece_words, window)).alias("piece", "words")).join(hits, ["digest", "piece"])
    parts = parts.select("digest", "piece", words_of(F.col("words")).alias("w"), "hits")
    by_tier = F.concat(*[_around(F.col("hits"), k, n, of) for k, (n, _, of) in enumerate(levels)])
    parts = parts.select("digest", "piece", "w", F.array_distinct(by_tier).alias("tried"))
    begin = F.col("piece").cast("bigint") * piece_words

    def shown_in(w: Column) -> Column:
        there = F.filter("tried", lambda x: x["start"] + x["n"] <= F.size(w))
        return F.transform(there, lambda x: F.struct((begin + x["start"]).alias("start"), F.array_join(F.slice(w, x["start"] + 1, x["n"]), " ").alias("words")))

    shown = let(F.col("w"), shown_in)
    tried = parts.select("digest", F.explode(shown).alias("x")).select("digest", "x.start", "x.words")

    # The items of a window: equal lists share a name.
    of_window = windows.groupBy("words", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("set_id", F.sha2(F.to_json("items").cast("binary"), 256))
    of_window = written(of_window, "leak-windows")
    sets = of_window.select("set_id", "items").dropDuplicates(["set_id"]).select("set_id", F.explode("items").alias("item_id"))
    found = _struct_join(tried, of_window.select("words", F.col("n").cast("bigint").alias("n"), "set_id"), "words")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))))
    found = found.groupBy("digest").agg(spans.alias("spans"), F.array_join(F.array_sort(F.collect_set("set_id")), ",").alias("sets"))
    # Spans by start: each adds what is beyond the ends before it.
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["end"]), F.lit(0).cast("bigint"))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end"))
    return written(found.select("digest", F.aggregate("spans", none, step)["n"].alias("n_hit"), "sets"), "leak-found"), sets


def _around(hits: Column, tier: int, gram: int, lengths: list[int]) -> Column:
    """The windows of a tier's lengths that hold the gram of one of its hits."""
    of_tier = F.filter(hits, lambda h: h["tier"] == tier)
    return F.flatten(F.transform(of_tier, lambda h: F.flatten(F.array(*[_starts(h["at"], gram, length) for length in lengths]))))


def _starts(at: Column, gram: int, length: int) -> Column:
    """Where windows of a length may begin that hold the gram at a place."""
    return F.transform(F.sequence(F.greatest(at + gram - length, F.lit(0)), at), lambda s: F.struct(F.lit(length).alias("n"), s.alias("start")))


def _lists(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(sets, n_items, items_sha256) of each combination of sets of items that some text has."""
    each = found.select("sets").distinct().select("sets", F.explode(F.split("sets", ",")).alias("set_id"))
    ids = each.join(sets, "set_id").groupBy("sets").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    return ids.select("sets", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
