"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, document, position) for every place in the training documents
where a benchmark word stands; it is written to the shared folder once, and corpus frequencies are
counted from it. A phrase is found by its rarest terms: their postings, moved back by the terms'
offsets, must name the same start in the same document. The starts that survive are checked word
by word against the document, so matches are exact. Only built-in Spark functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import WORD_ANY_CASE, lower_ascii, small_enough, stored

WINDOW = 13
#: Terms of a phrase whose postings are intersected before documents are opened.
PROBES = 3
#: A document is contaminated if at least one word in so many of its words is hit.
SHARE = 20


def words_of(text: Column) -> Column:
    """All words in order, capitals as they stand; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), F.array().cast("array<string>"))


def phrases(items: DataFrame) -> DataFrame:
    """phrase_id, words, item_ids: the distinct word sequences of the items; items without words have none."""
    words = items.select("item_id", F.transform(words_of(F.col("text")), lower_ascii).alias("words"))
    grouped = words.filter(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return grouped.select(F.xxhash64("words").alias("phrase_id"), "words", "item_ids")


def window_length(window: int) -> Column:
    """A phrase shorter than the window is one window."""
    return F.least(F.lit(window), F.size("words"))


class PositionalIndex:
    """Postings of the given terms in all documents.

    ``postings`` has doc_id, term, position (from 0), ``frequencies`` has term and n. Words are
    compared after A-Z are lowered and nothing else.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame):
        """``terms``: one column ``term`` of distinct lowered words."""
        terms = stored(terms, "index-terms")
        side = terms.select("term", F.lower("term").alias("folded"))
        # A term takes some 100 bytes in a hash table; beyond 16 MB the words are shuffled instead.
        side = F.broadcast(side) if small_enough(terms, 100) else side
        standing = docs.select("doc_id", F.posexplode(words_of(docs["text"])).alias("position", "word"))
        matched = standing.withColumn("folded", F.lower("word")).join(side, "folded")
        exact = matched.filter(lower_ascii(F.col("word")) == F.col("term"))
        self.postings = stored(exact.select("doc_id", "term", "position"), "index-postings")
        self.terms = terms

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("n"))

    def alignments(self, phrases: DataFrame, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
        """phrase_id, doc_id, shift: where documents may hold a window of a phrase, its first word being at ``shift``.

        Each window is looked up by its ``probes`` rarest terms. A posting at position p of the term
        at offset q of the phrase names the shift p - q; the offset-adjusted lists are intersected by
        grouping on (phrase, document, shift), and a shift stays if all probes of a window named it.
        Every true place is among them. Overlapping windows share their probes' postings.
        """
        at = F.explode(F.sequence(F.lit(0), F.size("words") - window_length(window)))
        windows = phrases.select("phrase_id", "words", window_length(window).alias("length"), at.alias("window"))
        inside = windows.select(
            "phrase_id", "window", F.posexplode(F.slice("words", F.col("window") + 1, F.col("length"))).alias("i", "term")
        ).withColumn("offset", F.col("window") + F.col("i"))
        counted = inside.join(self.frequencies(), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("phrase_id", "window").orderBy("n", "term", "offset"))
        chosen = stored(
            counted.withColumn("rank", rank).filter(F.col("rank") <= probes).select("phrase_id", "window", "offset", "term"),
            "index-probes",
        )
        lookups = stored(chosen.select("phrase_id", "offset", "term").distinct(), "index-lookups")
        needed = chosen.groupBy("phrase_id", "window").agg(F.collect_set("offset").alias("offsets"))
        needed = stored(
            needed.groupBy("phrase_id").agg(F.collect_set("offsets").alias("windows")), "index-windows"
        )
        named = (
            self.postings.join(if_small(lookups, 200), "term")
            .groupBy("phrase_id", "doc_id", (F.col("position") - F.col("offset")).alias("shift"))
            .agg(F.collect_set("offset").alias("named"))
        )
        agreed = F.exists("windows", lambda offsets: F.size(F.array_except(offsets, F.col("named"))) == 0)
        return named.join(if_small(needed, 4000), "phrase_id").filter(agreed).select("phrase_id", "doc_id", "shift")


def if_small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, marked for broadcast if its real number of rows allows it."""
    return F.broadcast(rows) if small_enough(rows, row_bytes) else rows


def phrase_places(
    docs: DataFrame, wanted: DataFrame, window: int = WINDOW, index: PositionalIndex | None = None
) -> DataFrame:
    """doc_id, phrase_id, start, length of every exact place of a window of the stored phrases in ``docs``."""
    if index is None:
        index = PositionalIndex(docs, wanted.select(F.explode("words").alias("term")).distinct())
    shifts = stored(index.alignments(wanted, window), "phrase-shifts")
    # Per document, the shifts to check; documents without any are not opened.
    checks = (
        shifts.join(if_small(wanted.select("phrase_id", "words"), 4000), "phrase_id")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("shift", "phrase_id", "words")).alias("checks"))
    )
    opened = docs.select("doc_id", "text").join(checks, "doc_id")
    lowered = opened.select("doc_id", "checks", F.transform(words_of(F.col("text")), lower_ascii).alias("own"))
    each = lowered.select("doc_id", F.explode(F.transform("checks", lambda c: F.struct(
        c["phrase_id"].alias("phrase_id"),
        c["shift"].alias("shift"),
        F.transform(c["words"], lambda word, i: F.coalesce(
            (c["shift"] + i >= 0) & (F.try_element_at(F.col("own"), F.greatest(c["shift"] + i + 1, F.lit(1))) == word),
            F.lit(False),
        )).alias("words"),
    ))).alias("c")).select("doc_id", "c.*")  # ``words`` now says of each word whether it stands there
    length = window_length(window)
    true_starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - length),
        lambda s: F.forall(F.slice(F.col("words"), s + 1, length), lambda ok: ok),
    )
    places = each.select("doc_id", "phrase_id", "shift", length.alias("length"), F.explode(true_starts).alias("s"))
    return places.select("doc_id", "phrase_id", (F.col("shift") + F.col("s")).alias("start"), "length").distinct()


def proximity_matches(index: PositionalIndex, pairs: DataFrame, distance: int) -> DataFrame:
    """doc_id, pair_id, first, second: places of two terms at most ``distance`` words apart, in either order.

    ``pairs`` has pair_id, first_term, second_term. Positions are met in blocks of ``distance``, so a
    place meets only those in its own and the neighbouring blocks.
    """
    block = F.floor(F.col("position") / distance)
    one = index.postings.join(
        pairs.select("pair_id", F.col("first_term").alias("term")), "term"
    ).select("pair_id", "doc_id", F.col("position").alias("first"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    two = index.postings.join(
        pairs.select("pair_id", F.col("second_term").alias("term")), "term"
    ).select("pair_id", "doc_id", F.col("position").alias("second"), block.alias("block"))
    near = one.join(two, ["pair_id", "doc_id", "block"])
    apart = F.abs(F.col("first") - F.col("second"))
    return near.filter((apart <= distance) & (apart > 0)).select("doc_id", "pair_id", "first", "second").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    Null and empty texts, and documents when the benchmark has no words, have no hits; the hash of no
    items is that of the empty string. Rows that repeat a doc_id are taken as one document when hits
    are counted: a place counts if any of them has it. Null ids are compared as equal.
    """
    # Null ids cannot meet in joins: they travel as a struct that is never null.
    keyed = docs.select(F.struct("doc_id").alias("doc_id"), "text")
    wanted = stored(phrases(items), "phrases")
    places = phrase_places(keyed, wanted, window)
    places = stored(places, "phrase-places")

    item_side = if_small(wanted.select("phrase_id", "item_ids"), 1000)
    matched_items = (
        places.select("doc_id", "phrase_id").distinct().join(item_side, "phrase_id")
        .select("doc_id", F.explode("item_ids").alias("item_id")).distinct()
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    ends = (
        places.groupBy("doc_id", "start").agg((F.max("length") + F.col("start")).alias("end"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    # Union of the intervals, from left to right: words beyond the furthest end so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda done, span: F.struct(
            F.greatest(done["end"], span["end"]).alias("end"),
            (done["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(done["end"], span["start"]))).alias("n"),
        ),
    )["n"]
    hits = ends.select("doc_id", covered.cast("long").alias("n_hit")).join(matched_items, "doc_id")
    hits = stored(hits, "hits")
    counted = keyed.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words")
    )
    joined = counted.join(if_small(hits, 300), "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_text = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    return joined.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(items_text, 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
