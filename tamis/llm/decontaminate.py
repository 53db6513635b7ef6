"""Benchmark decontamination through a positional inverted index, in DataFrame functions only.

A benchmark item's windows are its runs of ``window`` consecutive words (the whole item, if
shorter). For each window the two terms that are rarest in the corpus are looked up: the
index holds the training postings (word, doc, position) of those terms. A posting less the
term's place in the item is the document position at which the item would begin; windows
whose two rarest terms agree on that position are candidates, and their whole phrase is then
compared with the document's words. ``proximity_matches`` asks for the rarest terms near to
each other instead.

The benchmark (its words, windows and terms) is broadcast while its counted size is under
``BROADCAST_ROWS``, else joined by shuffles. Corpus frequencies are counted over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle

WINDOW = 10
BROADCAST_BYTES = 16_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def pieces(text: Column) -> Column:
    """Words in order: ASCII letters (A-Z lower-cased), digits and whatever isn't ASCII.

    The first and the last piece may be empty; no other is.
    """
    return F.split(F.translate(text, UPPER, LOWER), BREAKS)


def folded(text: Column) -> Column:
    """All letters lower-cased, the final sigma as any other: a faster and coarser form for the index."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def index_pieces(text: Column) -> Column:
    """As many pieces, folded: the index may find more places than there are phrases, never fewer."""
    return F.split(folded(text), BREAKS)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast if its measured bytes allow it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def benchmark_words(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, item_ids, words, span): one row per distinct word sequence; span is the length of its windows."""
    text = whole(F.col("text"))
    named = F.filter(pieces(text), lambda w: w != "").alias("words")
    slim = payload(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), named)
    held = slim.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return held.select(F.sha2(F.array_join("words", " "), 256).alias("item"), "item_ids", "words", F.least(F.size("words"), F.lit(window)).alias("span"))


def term_frequencies(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(word, df): how often each benchmark word occurs in the whole corpus."""
    vocabulary = items.select(F.explode("terms").alias("word")).distinct()
    seen = docs.select(F.explode("words").alias("word"))
    counted = seen.join(small(vocabulary, size), "word", "left_semi").groupBy("word").count()
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("df"))


def rarest_terms(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(item, at, first, second): for each window its start and the item positions of its two rarest terms."""
    placed = items.select("item", "span", F.size("words").alias("n"), F.posexplode("terms").alias("p", "word"))
    ranked = placed.join(frequencies, "word").groupBy("item", "span", "n").agg(
        F.array_sort(F.collect_list(F.struct("p", "df"))).alias("terms")
    )
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("span"))).alias("at")
    by_rarity = F.array_sort(
        F.transform(F.slice("terms", F.col("at") + 1, F.col("span")), lambda t: F.struct(t["df"].alias("df"), t["p"].alias("p")))
    )
    picked = ranked.select("item", "span", "terms", starts).select("item", "span", "at", by_rarity.alias("r"))
    # a window with an unseen term cannot occur
    return picked.where(F.col("r")[0]["df"] > 0).select(
        "item", "span", "at", F.col("r")[0]["p"].alias("first"), F.coalesce(F.get("r", F.lit(1))["p"], F.col("r")[0]["p"]).alias("second")
    )


def postings(docs: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """(doc_id, item, p, begin): occurrences of asked terms; begin is where the item would start."""
    index = docs.select("doc_id", F.posexplode("words").alias("pos", "word"))
    return index.join(small(terms, size), "word").select("doc_id", "item", "p", (F.col("pos") - F.col("p")).alias("begin"))


class PhraseIndex:
    """The benchmark's windows, their rarest terms and those terms' training postings."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        self.rows = docs
        self.docs = payload(docs, "doc_id", "text").select("doc_id", index_pieces(whole(F.col("text"))).alias("words"))
        items = settle(benchmark_words(benchmark, window))
        self.size = 200 * (items.agg(F.sum(F.size("words"))).first()[0] or 0)  # with hash, places and windows
        items = items.withColumn("terms", F.transform("words", folded))
        frequencies = term_frequencies(self.docs, items, self.size)
        windows = rarest_terms(items, frequencies).groupBy("item").agg(F.collect_list(F.struct("at", "first", "second")).alias("windows"))
        self.items = settle(items.join(windows, "item"))
        ends = F.flatten(F.transform("windows", lambda w: F.array(w["first"], w["second"])))
        places = self.items.select("item", F.explode(F.array_distinct(ends)).alias("p"), "terms")
        self.terms = places.select("item", "p", F.get("terms", F.col("p")).alias("word"))

    def candidates(self) -> DataFrame:
        """(doc_id, ask): item places in a document where some window has its two rarest terms."""
        found = postings(self.docs, self.terms, self.size)
        aligned = found.groupBy("doc_id", "item", "begin").agg(F.collect_set("p").alias("ps"))
        held = F.filter("windows", lambda w: F.array_contains("ps", w["first"]) & F.array_contains("ps", w["second"]))
        starts = F.transform(held, lambda w: w["at"])
        hit = aligned.join(small(self.items, self.size), "item").select(
            "doc_id", F.struct("begin", starts.alias("starts"), "words", "span", "item_ids").alias("ask")
        )
        return hit.where(F.size("ask.starts") > 0)

    def phrases(self) -> tuple[DataFrame, Column, Column]:
        """The input rows, each row's number of words, and its matches (start, span, item_ids): windows whose whole phrase is there."""
        by_doc = settle(self.candidates().groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("ask").alias("__asks")))
        asked = by_doc.select(F.explode("__asks").alias("ask")).agg(F.sum(F.size("ask.words") + F.size("ask.starts") + 8)).first()[0] or 0
        asks = small(by_doc, 24 * asked)
        docs = self.rows
        text = whole(docs["text"])
        # columns of their own, so that a text is split once; its exact words only where they are asked for
        rows = docs.join(asks, docs["doc_id"].eqNullSafe(F.col("__id")), "left").withColumns(
            {"__pieces": F.split(text, BREAKS), "__words": F.when(F.col("__asks").isNotNull(), pieces(text))}
        )
        words, every = F.col("__words"), F.col("__pieces")

        def there(ask: Column) -> Column:
            def same(at: Column) -> Column:
                begin = ask["begin"] + at
                return (begin >= 0) & (F.slice(words, F.greatest(begin, F.lit(0)) + 1, ask["span"]) == F.slice(ask["words"], at + 1, ask["span"]))

            return F.transform(
                F.filter(ask["starts"], same),
                lambda at: F.struct((ask["begin"] + at).alias("start"), ask["span"].alias("span"), ask["item_ids"].alias("item_ids")),
            )

        none = F.expr("cast(array() as array<struct<start:int,span:int,item_ids:array<string>>>)")
        blank = (every[0] == "").cast("long") + ((F.size(every) > 1) & (F.element_at(every, -1) == "")).cast("long")
        matches = F.when(F.col("__asks").isNull(), none).otherwise(F.flatten(F.transform("__asks", there)))
        return rows, F.size(every) - blank, matches


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, item_ids (sorted strings) and contaminated.

    A word is hit if it lies inside any occurrence of any window of an item. Null and empty
    texts have no words. Items without words have no window; a null item_id hits words but is
    not listed. Rows that share a doc_id, or have none, are each compared with their own
    text. Other input columns are ignored.
    """
    rows, n_words, matches = PhraseIndex(docs, benchmark, window).phrases()
    found = rows.select(docs["doc_id"], n_words.alias("n_words"), matches.alias("matches"))
    places = F.array_distinct(
        F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["span"] - 1)))
    )
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["item_ids"]))))
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), ids.alias("item_ids"), (F.size("matches") > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input rows, with all their columns, in which no window of an item occurs."""
    rows, _, matches = PhraseIndex(docs, benchmark, window).phrases()
    return rows.where(F.size(matches) == 0).select(*(docs[c] for c in docs.columns))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 5) -> DataFrame:
    """(doc_id, item, at, start, shift): windows whose two rarest terms stand in a document in
    their order of the item but for at most ``slop`` words more or fewer between them; shift 0 is
    the exact distance. A document's row holds each place once.
    """
    index = PhraseIndex(docs, benchmark, window)
    found = settle(postings(index.docs, index.terms, index.size))
    cell = F.floor(F.col("begin") / (slop + 1))
    wanted = index.items.select(F.col("item").alias("of"), F.inline("windows"))
    one = found.join(small(wanted, index.size), (F.col("item") == F.col("of")) & (F.col("p") == F.col("first"))).select(
        "doc_id", "item", "at", "second", "begin", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
    )
    two = found.select(F.col("doc_id").alias("d"), F.col("item").alias("i"), F.col("p").alias("q"), F.col("begin").alias("b"), cell.alias("c"))
    near = one.join(
        two,
        one["doc_id"].eqNullSafe(two["d"]) & (one["item"] == two["i"]) & (one["second"] == two["q"]) & (one["cell"] == two["c"])
        & (F.abs(one["begin"] - two["b"]) <= slop),
    )
    return near.select(
        "doc_id", "item", "at", (F.col("begin") + F.col("at")).alias("start"), (F.col("b") - F.col("begin")).alias("shift")
    ).distinct()


def digest(found: DataFrame) -> DataFrame:
    ids = F.col("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
