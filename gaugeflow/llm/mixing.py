"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, written
from .words import BLANKS, words_of

SALTS = 64  # parts of a source's rows that meet its goal apart
BIN_ROWS = 4096  # rows of a source's shuffled order that are summed apart, about
CHUNK = 1 << 16  # slots that are counted apart
#: The golden ratio's fraction of 2^64, odd: slot i has the point (i + 1) * GOLDEN modulo 2^64, exact for any number of slots.
GOLDEN, WHOLE = "11400714819323198485BD", "18446744073709551616BD"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def placed(sources: DataFrame) -> DataFrame:
    """``sources`` (a row a source), written, with ``place``: its rank from 0 by code point, null last; and ``part``, a stretch of that order.

    Ranges of sources are sorted apart, and the ranges' sizes cumulated, so any number of sources will do.
    """
    order = F.col("source").asc_nulls_last()
    marked = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("mark", F.monotonically_increasing_id()), "sources")
    marked = marked.selectExpr("*", "shiftright(mark, 33) AS part", "mark & ((1L << 33) - 1) AS inside").drop("mark")
    parts = marked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).selectExpr("part", f"coalesce(sum(n) OVER (ORDER BY part {_BEFORE}), 0) AS first")  # a row a task
    return marked.join(parts, "part").selectExpr("*", "first + inside AS place").drop("first", "inside")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """A row a source, from rows (source, size): place, source, docs, source_size, target, words (the target cut to whole words), above (the words of the places before).

    Sources by code point, null last, take ``weights`` in turn, over and over. Targets share all sizes by weight, none above ``cap``
    times its source's size: what full sources leave raises the level that the others share, round by round until none is above;
    a round is one aggregate, of which one row comes to the driver.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    weight = f"element_at(array({', '.join(map(str, weights))}), CAST(1 + place % {len(weights)} AS INT))"
    rows = written(placed(by_source).selectExpr("place", "part", "source", "docs", "source_size", f"CAST({weight} AS BIGINT) AS weight", f"{cap} * source_size AS most"), "weighted")
    level, before = 0.0, None
    while level != before:
        before = level
        full = F.col("most") / F.col("weight") < level
        left, open_weight = rows.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        level = left / open_weight if open_weight else level
    target = F.when(F.col("weight") * F.lit(level) < F.col("most"), F.col("weight") * F.lit(level)).otherwise(F.col("most").cast("double"))
    rows = rows.withColumn("target", target).withColumn("words", F.col("target").cast("long"))
    parts = rows.groupBy("part").agg(F.sum("words").alias("n")).selectExpr("part AS p", f"coalesce(sum(n) OVER (ORDER BY part {_BEFORE}), 0) AS start")
    inside = rows.selectExpr("*", f"coalesce(sum(words) OVER (PARTITION BY part ORDER BY place {_BEFORE}), 0) AS own")
    return inside.join(parts, F.col("part") == F.col("p")).selectExpr("place", "source", "docs", "source_size", "target", "words", "start + own AS above")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """The order in which blocks of ``block`` words of the sources follow each other: place, slot, nth (the slot's rank within its source, from 0).

    There is a slot for each block of all targets. Slot i has the golden-ratio point frac((i + 1) / phi), in steps of whole numbers modulo
    2^64, which falls into one source's part of the cumulated targets; so any stretch of slots holds the sources close to their shares, and
    a source gets as many slots as points fall to it. A source with a target but without a point gets one slot after all others.

    Points and parts meet by equal stretches of the unit interval, so neither one source nor the number of sources makes a hot key; ranks
    are counted in chunks of slots and cumulated.
    """
    spark = goals.sparkSession
    total, sources = goals.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    slots, stretches = -(-total // block), max(1024, 4 * sources)
    points = spark.range(slots).selectExpr("id AS slot", f"CAST(id + 1 AS DECIMAL(18, 0)) * {GOLDEN} % {WHOLE} AS point").selectExpr("slot", f"point * {stretches}BD DIV {WHOLE} AS stretch", f"point * {total}BD DIV {WHOLE} AS position")
    ends = [f"CAST({x} / {max(total, 1)} * {stretches} AS BIGINT)" for x in ("above", "(above + words)")]
    parts = goals.where("words > 0").selectExpr("place", "above", "above + words AS upto", f"explode(sequence({ends[0]} - 1, {ends[1]} + 1)) AS stretch")
    drawn = written(points.join(parts, "stretch").where("position >= above AND position < upto").selectExpr("place", "slot", f"slot DIV {CHUNK} AS chunk"), "drawn")
    chunks = drawn.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n")).selectExpr("place AS p", "chunk AS c", f"coalesce(sum(n) OVER (PARTITION BY place ORDER BY chunk {_BEFORE}), 0) AS earlier")
    ranked = drawn.selectExpr("*", "row_number() OVER (PARTITION BY place, chunk ORDER BY slot) - 1 AS inside")
    ranked = ranked.join(chunks, (F.col("place") == F.col("p")) & (F.col("chunk") == F.col("c"))).selectExpr("place", "slot", "earlier + inside AS nth")
    without = goals.where("words > 0").join(drawn.select("place").distinct(), "place", "left_anti").selectExpr("place", f"{slots} + place AS slot", "0L AS nth")
    return ranked.unionByName(without)


def row_key(docs: DataFrame) -> Column:
    """Tells rows apart as far as the mix cares: by doc_id and, since ids may repeat, by text."""
    return F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit(""))))


def streams(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows (key, copy, source, size) with their source's goal and ``begin``: the words of its source before the row, in an order by hash.

    A source's rows meet its goal in ``SALTS`` parts. Its order is cut into bins by hash, which are summed apart and then cumulated. So a
    source with a third of all rows is many groups.
    """
    keyed = sizes.withColumns({"row": F.concat("key", F.lit("#"), "copy"), "mark": F.md5(F.concat("key", F.lit("#"), "copy"))}).withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)))
    many = goals.withColumnRenamed("source", "g_source").selectExpr("*", f"explode(sequence(0L, {SALTS - 1}L)) AS g_salt")
    met = keyed.join(many, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt"))).drop("g_source", "g_salt", "salt")
    met = met.withColumn("bin", F.expr(f"CAST(conv(substring(mark, 1, 8), 16, 10) AS BIGINT) * (1 + docs DIV {BIN_ROWS}) DIV {1 << 32}"))
    bins = met.groupBy("place", "bin").agg(F.sum("size").alias("n")).selectExpr("place AS p", "bin AS b", f"coalesce(sum(n) OVER (PARTITION BY place ORDER BY bin {_BEFORE}), 0) AS earlier")
    inside = met.selectExpr("*", f"coalesce(sum(size) OVER (PARTITION BY place, bin ORDER BY mark, row {_BEFORE}), 0) AS own")
    return inside.join(bins, (F.col("place") == F.col("p")) & (F.col("bin") == F.col("b"))).selectExpr("*", "earlier + own AS begin").drop("p", "b", "bin", "mark", "row", "earlier", "own")


def taken_words(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 64) -> DataFrame:
    """How many words the mix takes of each row of ``docs`` (doc_id, text, source): key, copy, doc_id, source, size, source_size, target, taken, begin, slots, n_slots.

    A source's documents, in shuffled order and again from the front up to ``cap`` times, are a stream of words, cut into blocks of
    equal words for all sources; the n-th slot that the schedule gives a source takes its n-th block. So a source gets as many words as
    the schedule has slots for it times the block, the last one cut where the target ends: a few blocks less than its target at most. A
    document's words are taken as often as blocks cover them, so none is taken more than ``cap`` times. Blocks have ``block_words``
    words, whatever the size of the corpus. ``begin`` is the words of the source before the row; ``slots`` has the first slot that takes words of it in each pass over the source (null where none does), and n_slots says how
    many slots do.

    Null texts have size 0; a null source is a source of its own; rows equal in doc_id, text and source are told apart by ``copy``
    (from 0). Reruns agree. An empty table gives an empty one.
    """
    out, slots = _plan(docs, weights, cap, block_words)
    forget(slots)
    return out.drop("place")


def _plan(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int) -> tuple[DataFrame, DataFrame]:
    """What ``taken_words`` returns, with ``place``, and the schedule; both written."""
    sized = docs.select(row_key(docs).alias("key"), docs["doc_id"], docs["source"], F.size(words_of(docs["text"])).cast("long").alias("size"))
    grouped = sized.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    sizes = written(grouped.selectExpr("key", "doc_id", "source", "size", "explode(sequence(CAST(0 AS BIGINT), times - 1)) AS copy"), "mix")
    goals = written(targets(sizes.select("source", "size"), weights, cap), "goals")
    slots = written(schedule(goals, block), "slots")
    counts = slots.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    limits = written(goals.join(counts, "place", "left").selectExpr("place", "source", "docs", "source_size", "target", f"least(coalesce(n, 0) * {block}, words) AS goal"), "limits")

    passes = f"filter(transform(sequence(0L, {cap - 1}L), p -> struct(p AS pass, begin + p * source_size AS a, least(begin + p * source_size + size, goal) AS b)), x -> x.a < x.b)"
    each = streams(sizes, limits).selectExpr("*", f"explode_outer({passes}) AS x").selectExpr("*", "x.pass", "x.b - x.a AS words", f"x.a DIV {block} AS nth", f"(x.b - 1) DIV {block} - x.a DIV {block} + 1 AS in_slots").drop("x")
    met = each.join(slots.withColumnsRenamed({"place": "s_place", "nth": "s_nth"}), (F.col("place") == F.col("s_place")) & (F.col("nth") == F.col("s_nth")), "left")
    firsts = F.array(*[F.min(F.when(F.col("pass") == k, F.col("slot"))) for k in range(cap)])
    own = [F.any_value(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    out = met.groupBy("key", "copy", "place").agg(*own, F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.any_value("begin").alias("begin"), firsts.alias("slots"), F.coalesce(F.sum("in_slots"), F.lit(0)).alias("n_slots"))
    out = written(out, "taken")
    forget(sizes, goals, limits)
    return out, slots


def _with_plans(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """row (a struct of docs' columns) and plan for each row that has one. Rows equal in doc_id, text and source are numbered to meet their ``copy``; rows without a word have no plan and stay behind."""
    rows = docs.select(row_key(docs).alias("key"), docs["source"], F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).where(F.btrim(F.coalesce("row.text", F.lit("")), F.lit(BLANKS)) != "")
    # Texts and plans meet by windows rather than by a join, whose three keys would deal the texts out once more.
    both = rows.unionByName(plan, allowMissingColumns=True).repartition("key")
    both = both.selectExpr("*", "coalesce(copy, row_number() OVER (PARTITION BY key, source, row IS NULL ORDER BY key) - 1) AS nth")
    return both.selectExpr("row", "max(plan) OVER (PARTITION BY key, source, nth) AS plan").where("row IS NOT NULL AND plan IS NOT NULL")


def mix_blocks(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 64) -> DataFrame:
    """The mix block by block: slot, offset (words of the block before), n_words and the columns of ``docs``, ``text`` cut to the words that lie in the block, joined by one space.

    Each source's shuffled stream is cut into blocks of ``block_words`` words, and the n-th of them is joined with the source's n-th slot;
    rows are in the order of slots and offsets. A block holds pieces of one or several documents, and a document lies in as many blocks as
    it reaches; a source's last block may be cut. Columns of ``docs`` named like the first three give way.
    """
    plans, slots = _plan(docs, weights, cap, block_words)
    each = _with_plans(docs, plans.where("taken > 0").selectExpr("key", "source", "CAST(copy AS BIGINT) AS copy", "struct(place, taken, size, begin, source_size) AS plan"))
    other = [c for c in docs.columns if c not in ("slot", "offset", "n_words", "text")]
    passes = each.selectExpr("*", "explode(sequence(0L, (plan.taken - 1) DIV plan.size)) AS p").selectExpr("*", "plan.begin + p * plan.source_size AS a", "least(plan.size, plan.taken - p * plan.size) AS n").withColumn("words", words_of(F.col("row.text")))

    def piece(k: Column) -> Column:
        first, upto = F.greatest(F.lit(0), k * block_words - F.col("a")), F.least(F.col("n"), (k + 1) * block_words - F.col("a"))
        text = F.array_join(F.slice(F.col("words"), (first + 1).cast("int"), (upto - first).cast("int")), " ")
        return F.struct(k.alias("nth"), F.greatest(F.lit(0), F.col("a") - k * block_words).cast("long").alias("offset"), (upto - first).alias("n_words"), text.alias("text"))

    blocks = F.transform(F.expr(f"sequence(a DIV {block_words}, (a + n - 1) DIV {block_words})"), piece)
    parts = passes.select(F.col("plan.place").alias("place"), F.struct(*[F.col("row")[c].alias(c) for c in other]).alias("row"), F.explode(blocks).alias("piece"))
    met = parts.join(slots.withColumnRenamed("place", "s_place"), (F.col("place") == F.col("s_place")) & (F.col("piece.nth") == F.col("nth")))
    columns = [F.col("piece.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("slot", "offset", "n_words")]
    return met.orderBy("slot", "piece.offset").select("slot", "piece.offset", "piece.n_words", *columns)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix in whole documents, with the columns of ``docs``: each row as often as all its words are taken, and once more with its first words for the rest.

    Rows are in the order of the schedule: by the first slot that takes words of them in a pass over their source, then by their place in
    the source's stream. Written, the files in order of their names hold that order. What is cut off is at a source's last block only.
    Rows of which no word is taken go. ``mix_blocks`` gives the blocks instead.
    """
    plan = taken_words(docs, **how).where("taken > 0").selectExpr("key", "source", "CAST(copy AS BIGINT) AS copy", "struct(taken DIV size AS whole, taken % size AS rest, begin, source_size, slots) AS plan")
    both = _with_plans(docs, plan)
    each = both.selectExpr("row", "plan.*", "explode(sequence(CAST(1 AS BIGINT), plan.whole + CAST(plan.rest > 0 AS BIGINT))) AS n")
    each = each.selectExpr("row", "whole", "rest", "n", "slots[CAST(n - 1 AS INT)] AS slot", "begin + (n - 1) * source_size AS at").orderBy("slot", "at")
    cut = F.when(F.col("n") <= F.col("whole"), F.col("row.text")).otherwise(F.array_join(F.slice(words_of(F.col("row.text")), F.lit(1), F.col("rest").cast("int")), " "))
    return each.select(*[cut.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
