"""Personal data: exact patterns, and terms that reveal them by what the corpus knows.

The patterns find the protected entities. A term discloses an entity as far as seeing the term
tells who is meant: with document counts over the whole corpus,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N n_te / (n_t n_e)) / log(N / n_e)

which is 1 when the term stands only beside the entity and 0 when it is independent of it. It grows with the share
n_te / n_t of the term's documents that mention the entity, and for that share its lower confidence bound is
taken, so that few documents say less than many; and what chance alone would bring together among so many
rare terms does not count. In documents that mention the entity, terms beyond one threshold are
removed and beyond a lower one generalised.

Copies of one document prove nothing, however many there are and even if some are edited: documents of an entity that are
the same or nearly so as a whole, directly or through others, are one witness (shared bands of minima over pairs of neighbouring
words of the whole text). A signature, a form or a passage that letters share does not make them copies. A term
needs two witnesses: of a single document nobody can tell which of its rare words belong to the entity. Document counts
n are over all documents. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import WORD_ANY_CASE, lower_ascii, small_enough, stored
from wattline.llm.components import connected_components
from wattline.llm.decontaminate import words_of

# The kinds and patterns of the contract, in its order. Possessive repeats and the
# condition on where a match may begin only keep Java from trying starts that cannot match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a pattern to have a chance; cheap to test.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Independent documents with an entity and a term before the term may count.
WITNESSES = 2
#: The confidence bound lies so many standard deviations below (one-sided 90 %).
DEVIATIONS = 1.28
#: A term must stand beside an entity more often than it would by chance with this probability (a corpus has very many rare terms).
CHANCE = 1e-4
#: Disclosure from which a term is removed, and from which it is generalised.
REMOVE, GENERALISE = 0.8, 0.6
#: Minima in bands: whole texts that have 0.8 of their pairs of words in common share a band with probability 0.99,
#: those with 0.2 with probability 0.001.
BANDS, ROWS = 16, 6

#: What documents mention is broadcast up to this size, by its real lengths.
BROADCAST_BYTES = 16 << 20

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: leftmost matches that do not overlap, in code points from 0."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    nothing = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans")
    )

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(done["spans"], span).alias("spans"))

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, nothing, add)["spans"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.array(*(F.lit((2 * d) // 10 + (2 * d) % 10) for d in range(10)))
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    values = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.get(doubled, d)).otherwise(d))
    return F.aggregate(values, F.lit(0), lambda total, v: total + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Leading zeros do not make a part larger.
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = digits_of(value)
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, value), by kind as listed, then start; empty for a null text."""
    none = F.array().cast(f"array<{SPAN}>")

    def of_kind(kind: str) -> Column:
        found = F.filter(placed(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
        named = F.transform(
            found,
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
        )
        chance = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        return F.coalesce(F.when(chance, named), none)

    return F.concat(*map(of_kind, KINDS))


def entity_of(span: Column) -> Column:
    """The protected entity behind a span: its kind and value, written one way."""
    written = F.when(span["kind"] == "email", F.lower(span["value"])).when(
        span["kind"] == "ip", span["value"]
    ).otherwise(digits_of(span["value"]))
    return F.concat_ws(":", span["kind"], written)


def _bands(text: Column) -> tuple[Column, Column]:
    """Pairs of neighbouring words of a whole text as digests, and from a column ``pairs`` of these its bands of minima."""
    words = F.concat(F.array(F.lit("|")), F.transform(words_of(text), lower_ascii))
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))

    def least(seed: int) -> Column:
        return F.array_min(F.transform("pairs", lambda p: F.xxhash64(p, F.lit(seed))))

    rows = F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))
    return pairs, rows


def _witnesses(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """key, entity, group: which documents of an entity are copies of each other; ``mentions`` has key, entity."""
    keys = stored(mentions.select("key").distinct(), "pii-keys")
    side = F.broadcast(keys) if small_enough(keys, 200) else keys
    pairs, rows = _bands(F.col("text"))
    texts = docs.join(side, "key").dropDuplicates(["key"]).select("key", pairs.alias("pairs")).select("key", rows.alias("bands"))
    # Equal bands are one node, so that exact copies do not multiply.
    sketched = mentions.join(texts, "key").withColumn("node", F.xxhash64("entity", "bands"))
    sketched = stored(sketched, "pii-sketches")
    keyed = sketched.dropDuplicates(["node"]).select("entity", "node", F.explode("bands").alias("band"))
    keyed = stored(keyed, "pii-bands")
    first = keyed.groupBy("entity", "band").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter(F.col("a") < F.col("z"))
    edges = keyed.join(first.select("entity", "band", "a"), ["entity", "band"]).filter(F.col("a") < F.col("node"))
    edges = stored(edges.select("a", F.col("node").alias("b")).distinct(), "pii-copies")
    if edges.isEmpty():
        return sketched.select("key", "entity", F.col("node").alias("group"))
    groups = connected_components(edges)
    return sketched.join(groups, "node", "left").select("key", "entity", F.coalesce("component", "node").alias("group"))


def lower_bound(successes: Column, trials: Column, deviations: float = DEVIATIONS) -> Column:
    """The lower confidence bound of a share (Wilson's)."""
    z2 = F.lit(deviations**2)
    share = successes / trials
    spread = F.lit(deviations) * F.sqrt(share * (1 - share) / trials + z2 / (4 * trials * trials))
    return (share + z2 / (2 * trials) - spread) / (1 + z2 / trials)


def surprise(successes: Column, trials: Column, rate: Column) -> Column:
    """Minus the logarithm of a bound (Chernoff's) on the probability of so many successes, or more, at a rate below theirs."""
    share = successes / trials
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(F.lit(0.0))
    return F.when(share > rate, trials * (share * F.log(share / rate) + other)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, *, witnesses: float = WITNESSES, generalise: float = GENERALISE):
    """(mentions, terms): key and entity of each mention; entity, term and disclosure from ``generalise`` on.

    ``docs`` has key and text. All documents count. An entity in all documents tells nothing apart
    and is left out. Words of the entity's own text are terms like others.
    """
    spotted = docs.select("key", "text", base_spans(F.col("text")).alias("base")).filter(F.size("base") > 0)
    mentions = spotted.select("key", F.explode(F.array_distinct(F.transform("base", entity_of))).alias("entity"))
    mentions = stored(mentions.distinct(), "pii-mentions")

    known = mentions.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= witnesses)
    known = stored(known, "pii-entities")
    side = F.broadcast(known) if small_enough(known, 300) else known
    several = stored(mentions.join(side.select("entity"), "entity").select("key", "entity"), "pii-several")
    groups = stored(_witnesses(several, docs), "pii-groups")
    enough = groups.groupBy("entity").agg(F.countDistinct("group").alias("n")).filter(F.col("n") >= witnesses).select("entity")
    enough = stored(enough, "pii-enough")
    side = F.broadcast(enough) if small_enough(enough, 300) else enough
    relevant = stored(groups.join(side, "entity").select("key", "entity", "group"), "pii-relevant")

    by_document = relevant.groupBy("key").agg(F.collect_set(F.struct("entity", "group")).alias("of"))
    by_document = stored(by_document, "pii-documents")
    size = by_document.agg(F.sum(F.size("of") * 100 + 200)).first()[0] or 0
    near = F.broadcast(by_document) if size <= BROADCAST_BYTES else by_document
    terms = F.array_distinct(F.transform(words_of(F.col("text")), lower_ascii))
    together = (
        docs.join(near, "key").select(F.explode("of").alias("o"), terms.alias("terms"))
        .select("o.entity", "o.group", F.explode("terms").alias("term"))
        .groupBy("entity", "term", "group").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("groups"))
        .filter(F.col("groups") >= witnesses)
    )
    together = stored(together, "pii-together")
    wanted = stored(together.select("term").distinct(), "pii-terms")
    side = F.broadcast(wanted) if small_enough(wanted, 100) else wanted
    frequency = (
        docs.select(F.explode(terms).alias("term")).join(side, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    )
    n_docs = F.lit(docs.count()).cast("double")
    # Witnesses among the term's documents, others counted one by one.
    trials = F.col("groups") + F.col("n_term") - F.col("n_both")
    share = lower_bound(F.col("groups"), trials)
    unlikely = surprise(F.col("groups"), trials, F.col("n_entity") / n_docs) >= F.lit(-math.log(CHANCE))
    disclosure = F.log(share * n_docs / F.col("n_entity")) / F.log(n_docs / F.col("n_entity"))
    scored = (
        together.join(frequency, "term").join(known, "entity")
        .filter(F.col("n_entity") < n_docs)
        .filter(unlikely)
        .select("entity", "term", disclosure.alias("disclosure"))
        .filter(F.col("disclosure") >= generalise)
    )
    return relevant, scored


def _key() -> Column:
    """What tells rows apart: the id and the text."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("content"))


def with_spans(docs: DataFrame, *, witnesses: float = WITNESSES, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """row (all columns of ``docs``), ``base`` and ``extra`` (arrays of (kind, start, end, value)) for each row.

    ``docs`` has doc_id, text and any others. ``extra`` are the disclosing terms, of kind ``removed`` or ``general``, outside base spans. Null
    and empty texts have none. Rows with the same doc_id and text share the terms found for them; of rows with the same
    id, or none, and different texts each has its own.
    """
    keyed = docs.select(_key().alias("key"), "text")
    mentions, terms = disclosing_terms(keyed, witnesses=witnesses, generalise=generalise)
    terms = stored(terms, "pii-disclosing")
    chosen = (
        mentions.select("key", "entity").join(F.broadcast(terms) if small_enough(terms, 300) else terms, "entity")
        .groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("disclosing"))
    )
    chosen = stored(chosen, "pii-chosen")
    side = F.broadcast(chosen) if small_enough(chosen, 2000) else chosen
    packed = docs.select(_key().alias("key"), F.struct("*").alias("row"), F.col("text").alias("text"))
    marked = packed.join(side, "key", "left").withColumn("base", base_spans(F.col("text")))
    outside = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    told = lambda s: F.try_element_at("disclosing", lower_ascii(s["value"]))
    terms_here = F.filter(placed(F.col("text"), WORD_ANY_CASE), lambda s: told(s).isNotNull() & outside(s))
    kind = lambda s: F.when(told(s) >= remove, F.lit("removed")).otherwise(F.lit("general"))
    extra = F.transform(terms_here, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    none = F.array().cast(f"array<{SPAN}>")
    return marked.withColumn("extra", F.coalesce(F.when(F.col("disclosing").isNotNull(), extra), none)).select(
        "row", "base", "extra"
    )


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans per kind, base_sha256, spans for each row of ``docs``."""
    found = with_spans(docs.select("doc_id", "text"))
    by_kind = F.array_sort(
        F.col("extra"),
        lambda a, b: F.when(a["kind"] == b["kind"], a["start"] - b["start"]).when(a["kind"] == "general", -1).otherwise(1),
    )

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "row.doc_id",
        *map(number, KINDS),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", by_kind)).alias("spans"),
    )


def sanitised_text(text: Column, base: Column, extra: Column) -> Column:
    """The text with each span replaced: base by its kind, general terms by a placeholder, removed ones by nothing."""
    spans = F.array_sort(F.concat(base, extra), lambda a, b: a["start"] - b["start"])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        label = F.when(span["kind"] == "removed", F.lit("")).when(span["kind"] == "general", F.lit("[TERM]")).otherwise(
            F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        )
        # A span that begins inside an earlier one only lengthens it.
        piece = F.when(span["start"] >= done["at"], F.concat(gap, label)).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["out"], piece).alias("out"))

    done = F.aggregate(spans, begin, add)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``; all other columns as they are."""
    marked = with_spans(docs)
    text = sanitised_text(F.col("row.text"), F.col("base"), F.col("extra"))
    return marked.select(*(text.alias("text") if name == "text" else F.col("row")[name].alias(name) for name in docs.columns))
