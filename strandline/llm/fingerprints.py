"""Document fingerprints by winnowing.

Tokens are words (runs of characters other than ASCII white space) of WORD_CHARS characters at most; a longer run, as in
texts without spaces, is taken code point by code point, so that no token depends on where its run begins. Grams are
GRAM tokens, hashed by Rabin and Karp's rolling function (a polynomial of the tokens' hashes modulo a prime); a text of
fewer tokens is one gram. From every WINDOW consecutive grams the smallest hash is kept, the rightmost of equal ones,
with its position. Two texts that share a passage of GRAM + WINDOW - 1 tokens share a fingerprint, wherever the passage
stands: positions don't enter the hash.

A document's edited text needs the next document. Ids are dealt into ranges whose firsts also go to the range before
(broadcast lists, CUTS + 1 times RANGES long at most), so that each range is complete and no task sees all documents.

Defined results: a null or empty text has n_chars 0 and the empty fingerprint; two empty fingerprints are alike (1.0),
one is not (0.0); equal ids are ordered by text; null ids come last; a single document is its own next; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

GRAM = 5
WINDOW = 4
WORD_CHARS = 16
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
RANGES, CUTS = 131_072, 2
ROWS_PER_RANGE = 500
POSITIONS = 1 << 32
_SOLID = r"[^\x20\x09-\x0D]"
_TOKEN = rf"((?<!{_SOLID}){_SOLID}{{1,{WORD_CHARS}}}+(?!{_SOLID})|{_SOLID})"


def bound(value: Column, body) -> Column:
    """body(value), with value computed once for each row: a lambda's variable isn't inlined as a column is."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column) -> Column:
    """array<bigint>, by position: hash * 2^32 + (2^32 - 1 - position), so that a smaller value is a smaller hash or, of equal ones, further right."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    hashes = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))

    def filled(h: Column) -> Column:
        """Few tokens are one gram: nothing stands where the others would."""
        return F.when((F.size(h) > 0) & (F.size(h) < GRAM), F.concat(h, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(GRAM - F.size(h), F.lit(0))))).otherwise(h)

    def grams(h: Column) -> Column:
        def gram(x: Column, i: Column) -> Column:
            for k in range(1, GRAM):
                x = (x * F.lit(BASE) + F.get(h, i + k)) % F.lit(PRIME)
            return x * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - i.cast("long"))

        rolled = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (GRAM - 1), F.lit(1))), gram)
        return F.when(F.size(h) > 0, rolled).otherwise(F.array().cast("array<bigint>"))

    def kept(v: Column) -> Column:
        least = F.transform(
            F.slice(v, F.lit(1), F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))),
            lambda x, i: F.least(x, *[F.get(v, i + k) for k in range(1, WINDOW)]),
        )
        return F.array_distinct(least)

    return bound(bound(bound(hashes, filled), grams), kept)


def shown(fingerprint: Column) -> Column:
    """position:hash of each kept gram, in order of position."""
    one = lambda v: F.concat((F.lit(POSITIONS - 1) - F.pmod(v, F.lit(POSITIONS))).cast("string"), F.lit(":"), F.hex(F.shiftright(v, 32)))
    return F.array_join(F.transform(fingerprint, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two fingerprints' hashes."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def _dealt(docs: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """docs with __at, an array that orders ranges of doc_id: bins of equal width, then, CUTS times, parts of those bins that hold too many rows,
    cut between their own smallest and largest ids, so that clustered ids and outliers spread as well. A cut adds RANGES ranges at most."""
    width = min(max(1, -(-(high - low + 1) // max(1, min(RANGES, n // ROWS_PER_RANGE)))), (1 << 63) - 1)
    target = max(ROWS_PER_RANGE, -(-n // RANGES))
    ids, rows = (df.withColumn("__at", F.array(F.coalesce(F.expr(f"doc_id div {width}L"), F.lit((1 << 63) - 1)))) for df in (docs.select("doc_id"), docs))
    for _ in range(CUTS):
        bins = ids.groupBy("__at").agg(F.min("doc_id").alias("__low"), F.max("doc_id").alias("__high"), F.count("*").alias("__n"))
        step = F.when(F.col("__n") > 2 * target, F.expr(f"try_subtract(__high, __low) div ceil(__n / {target}) + 1"))
        bins = F.broadcast(bins.select("__at", "__low", step.alias("__step")))
        cut = F.concat("__at", F.array(F.coalesce(F.expr("try_subtract(doc_id, __low) div __step"), F.lit(0).cast("long"))))
        ids, rows = (df.join(bins, "__at").withColumn("__at", cut).drop("__low", "__step") for df in (ids, rows))
    return rows


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with next_<column> of the next row by (doc_id, text), the first after the last."""
    cols = docs.columns
    ids = docs.select("doc_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if not ids["n"]:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in cols])
    facts = ids["n"], ids["low"] or 0, ids["high"] or 0
    firsts = _dealt(docs.select("doc_id"), *facts).groupBy(F.col("__at").alias("at")).agg(F.min("doc_id").alias("first"))
    before = F.coalesce(F.lag("at").over(W.orderBy("at")), F.max("at").over(W.partitionBy()))
    firsts = F.broadcast(firsts.select("at", "first", before.alias("before")))

    rows = _dealt(docs, *facts)
    rows = rows.join(firsts, (F.col("__at") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own, guest = F.struct(F.col("__at").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("at"), F.lit(1).alias("guest"))
    rows = rows.withColumn("__to", F.explode(F.when(F.col("before").isNotNull(), F.array(own, guest)).otherwise(F.array(own))))
    order = W.partitionBy("__to.at").orderBy("__to.guest", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.select(*cols, "__to", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols])
    return rows.filter(F.col("__to.guest") == 0).drop("__to")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.text_or_empty(text).alias("text"))
    rows = with_next(rows)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    marks = bound(
        F.struct(winnow(F.col("text")).alias("own"), winnow(F.col("edited")).alias("edited"), winnow(F.col("next_text")).alias("next")),
        lambda v: F.struct(
            shown(v["own"]).alias("fingerprint"),
            shown(v["edited"]).alias("edited_fingerprint"),
            bound(
                F.struct(*[F.transform(v[c], lambda x: F.shiftright(x, 32)).alias(c) for c in ("own", "edited", "next")]),
                lambda h: F.struct(likeness(h["own"], h["edited"]).alias("near_edited"), likeness(h["own"], h["next"]).alias("near_next")),
            ).alias("near"),
        ),
    )
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), marks.alias("marks"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "marks.fingerprint", "marks.edited_fingerprint", "marks.near.near_edited", "marks.near.near_next"
    )
