"""Mixing sources to target weights by weighted fair queueing.

Every document of a source joins that source's queue in a shuffled order (by the MD5 of its id, source and text). A queue is served at a
rate of its target, so a document's virtual finish time is the source's cumulative words up to and with the document,
divided by the target. A source whose target is above its size is played again, MAX_REPEATS times at most. All
(document, pass) entries are range-sorted by finish time, and the mix is the longest prefix that fits the total budget.

Nothing is ordered in one task: queues are cut into cells by hash prefix and the global order into ranges of finish
time; windows run inside a cell or range, and sums of cells and ranges are themselves summed in blocks first.

Defined results: a null or empty text has size 0 and taken 0; a null source is a source of its own, ordered last; rows
with a repeated doc_id are separate documents, and those with equal source and text too are interchangeable; a null
doc_id is shuffled as the empty text; an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAX_REPEATS = 3
ROWS_PER_CELL = 4096


def _running(order_by: list, *partition: str):
    return W.partitionBy(*partition).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, is_null, rank, source_size, n_docs, weight, target) from one row per document.

    The targets are the water level of the weights: a source whose cap is reached gives up its excess, which the others
    share by weight. Sorted by cap / weight, the capped sources are a prefix, so one pass over running sums finds them.
    The window is over one row per source, not over documents.
    """
    sources = sizes.groupBy("is_null", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = W.orderBy("is_null", "source_key")
    sources = sources.withColumn("rank", F.row_number().over(ordered).cast("long"))
    sources = sources.withColumn("weight", (F.pmod(F.col("rank") - 1, F.lit(3)) + 1).cast("long"))
    everything = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    sources = (
        sources.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left_budget", F.col("total") - MAX_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_budget").cast("double") / F.col("left_weight"))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("source_size") * MAX_REPEATS)
    )
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(W.partitionBy())
    return sources.withColumn("water", final["level"]).select(
        "is_null", "source_key", "rank", "source_size", "n_docs", "weight", "total",
        F.least(F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight"), (F.col("source_size") * MAX_REPEATS).cast("double")).alias("target"),
    )


def _shuffle_key(doc_id: str, source: str, text: str) -> Column:
    """Rows with one key are equal in all that the mix looks at, so neither null nor repeated ids gather in one cell."""
    own = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    body = F.md5(common.text_or_empty(text).cast("binary"))
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), own, body).cast("binary"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, h): one row per row of docs. See the module for the rules."""
    sizes = common.materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).isNull().alias("is_null"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_key"),
            common.word_count(common.text_or_empty(text)).alias("size"),
            _shuffle_key(doc_id, source, text).alias("h"),
        ),
        "mix-sizes",
    )
    targets = common.materialize(source_targets(sizes), "mix-targets")
    facts = targets.agg(F.max("total").alias("total"), F.sum("n_docs").alias("n")).first()
    budget, n = facts["total"] or 0, facts["n"] or 0
    by_source = ["is_null", "source_key"]

    # A document's place in its source's shuffled queue: running sums inside cells of hash prefixes, plus what the cells before hold.
    cells = sizes.join(targets.select(*by_source, "source_size", "n_docs", "target", "rank"), by_source)
    share = F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * F.ceil(F.col("n_docs") / ROWS_PER_CELL)
    cells = cells.withColumn("cell", F.shiftright(share, 24))
    offsets = common.sums_before(cells.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size")), ["rank"], "cell", "cell_size", "offset").drop("cell_size")
    inside = F.sum("size").over(_running(["h"], "rank", "cell"))
    queued = cells.withColumn("inside", inside).join(offsets, ["rank", "cell"])
    queued = queued.withColumn("upto", F.col("offset") + F.col("inside")).drop("cell", "inside", "offset")
    queued = common.materialize(queued, "mix-queued")

    # The global range sort: sums of ranges of finish time show which range holds the cut; only that one is ordered entry by entry.
    n_ranges = max(8, -(-n // ROWS_PER_CELL))
    finish = (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target")
    entries = (
        queued.filter("size > 0 AND target > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
        .withColumn("finish", finish)
        .withColumn("range", F.floor(F.least(F.col("finish"), F.lit(1e6)) * n_ranges))
    )
    ranges = entries.groupBy("range").agg(F.sum("size").alias("range_size"))
    ranges = common.materialize(common.sums_before(ranges, [], "range", "range_size", "before"), "mix-ranges")
    split = ranges.filter(F.col("before") + F.col("range_size") > F.lit(budget)).orderBy("range").first()
    if split is None:
        copies = F.lit(MAX_REPEATS)
    else:
        key = ["finish", "rank", "pass"]
        room = budget - split["before"]
        served = entries.filter(F.col("range") == split["range"]).withColumn("served", F.sum("size").over(_running([*key, "h"])))
        last = served.filter(F.col("served") <= room).agg(F.max(F.struct(*key)).alias("last")).first()["last"]
        copies = F.lit(0)
        for k in range(MAX_REPEATS):
            f = (F.col("upto") + F.lit(k) * F.col("source_size")) / F.col("target")
            before = F.floor(F.least(f, F.lit(1e6)) * n_ranges) < split["range"]
            if last is not None:
                in_order = F.struct(f, F.col("rank"), F.lit(k)) <= F.struct(F.lit(last["finish"]), F.lit(last["rank"]).cast("long"), F.lit(last["pass"]))
                before = before | in_order
            copies = copies + before.cast("int")
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0).cast("long")
    return queued.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "h"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs' rows as the mix plays them: a row for every pass that takes it, none for a row that the budget leaves out."""
    h, nth, copies = common.unused(docs, "h", "nth", "copies")
    number = F.row_number().over(W.partitionBy(h).orderBy(F.lit(0)))  # rows of one key are interchangeable
    plan = mix(docs).select(F.col("h").alias(h), F.col("copies").alias(copies)).withColumn(nth, number)
    rows = docs.withColumn(h, _shuffle_key("doc_id", "source", "text")).withColumn(nth, number)
    rows = rows.join(plan, [h, nth]).filter(F.col(copies) > 0)
    # sequence() of a pass number: explode multiplies the row, under a name that nothing else has.
    return rows.select(*common.quoted(*docs.columns), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(h)).drop(h)


#: DuckDB SQL for (doc_id, size, source_size, target, taken) over documents.
ORACLE = f"""
WITH d AS (SELECT doc_id, source IS NULL AS is_null, coalesce(source, '') AS k,
             md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce('s' || source, '') || '|' || md5(coalesce(text, ''))) AS h,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT is_null, k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY is_null, k) AS rank FROM d GROUP BY is_null, k),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total,
        (sum(source_size) OVER () - {MAX_REPEATS} * coalesce(sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, [source_size / weight, rank]) AS water FROM l WHERE level * weight <= source_size * {MAX_REPEATS}),
t AS (SELECT l.*, least(coalesce(water, 0.0) * weight, (source_size * {MAX_REPEATS})::DOUBLE) AS target FROM l, water),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.total, t.rank, d.h,
        sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.k = t.k AND d.is_null = t.is_null),
e AS (SELECT q.*, p AS pass, (upto + p * source_size)::DOUBLE / target AS finish FROM q, (SELECT unnest(range({MAX_REPEATS})) AS p) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, h ROWS UNBOUNDED PRECEDING) AS served FROM e),
n AS (SELECT rank, upto, count(*) AS copies FROM c WHERE served <= total GROUP BY rank, upto)
SELECT q.doc_id, q.size, q.source_size, q.target, (CASE WHEN q.size > 0 THEN q.size * coalesce(n.copies, 0) ELSE 0 END)::BIGINT AS taken
FROM q LEFT JOIN n ON q.rank = n.rank AND q.upto = n.upto"""
