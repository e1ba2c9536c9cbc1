"""Tamper-evident log: hash chains that can be written and verified in parallel.

One chain over all rows would be one task.  The log is cut into segments of ``SEGMENT`` sequence
numbers; each segment is a chain of its own and the heads of the segments are chained in turn, so a
task never holds more than ``SEGMENT`` rows however many rows one run or unit writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.operators import accumulator

SEGMENT = 1024
GENESIS = "0" * 64
FIELDS = ("seq", "at", "actor", "action", "subject_pid", "unit_id", "purpose", "detail")


def json_value(name: str) -> Column:
    """A column as JSON text, without its wrapper object."""
    whole = f"to_json(struct({name} AS v))"
    return F.expr(f"substring({whole}, 6, length({whole}) - 6)")


def payload_parts(entries: DataFrame) -> DataFrame:
    """Canonical JSON (sorted keys, no spaces), split where the previous hash goes."""
    def pair(key: str) -> Column:
        return F.concat(F.lit(f'"{key}":'), json_value(key))

    head = F.concat(F.lit("{"), pair("action"), F.lit(","), pair("actor"), F.lit(","), pair("at"),
                    F.lit(","), pair("detail"), F.lit(',"prev_hash":"'))
    tail = F.concat(F.lit('",'), pair("purpose"), F.lit(","), pair("seq"), F.lit(","),
                    pair("subject_pid"), F.lit(","), pair("unit_id"), F.lit("}"))
    return entries.withColumns({"_head": head, "_tail": tail,
                                "segment": F.floor(F.col("seq") / SEGMENT)})


def chained(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Fold (segment, seq, _head, _tail, keep...) into chains, one per segment.

    A segment is an array of at most ``SEGMENT`` rows; the fold carries the hashes only, and each
    row then reads its own hash and the one before it.
    """
    fields = ("seq", *keep)
    packed = rows.groupBy("segment").agg(
        F.collect_list(F.struct(*fields, "_head", "_tail")).alias("rows"))
    ordered = F.expr("array_sort(rows, (l, r) -> CASE WHEN l.seq < r.seq THEN -1 "
                     "WHEN l.seq > r.seq THEN 1 ELSE 0 END)")
    hashes = F.expr(f"aggregate(rows, array('{GENESIS}'), (acc, x) -> array_append(acc, "
                    "sha2(concat(x._head, element_at(acc, -1), x._tail), 256)))")
    named = ", ".join(f"'{c}', x.{c}" for c in fields)
    linked = F.expr(f"transform(rows, (x, i) -> named_struct({named}, "
                    "'prev_hash', hashes[i], 'entry_hash', hashes[i + 1]))")
    return (packed.withColumn("rows", ordered).withColumn("hashes", hashes)
            .select("segment", F.inline(linked)))


def seal(entries: DataFrame) -> DataFrame:
    """entries with FIELDS -> the same rows with segment, prev_hash and entry_hash."""
    return chained(payload_parts(entries), tuple(f for f in FIELDS if f != "seq"))


def heads(sealed: DataFrame) -> DataFrame:
    """Head of every segment, chained: verifying the heads verifies the order of the segments."""
    tops = sealed.groupBy("segment").agg(F.max_by("entry_hash", "seq").alias("head"),
                                         F.count("*").alias("rows"))
    level = tops.select(
        F.floor(F.col("segment") / SEGMENT).alias("segment"), F.col("segment").alias("seq"),
        "head", F.col("rows").alias("n"), F.col("head").alias("_head"), F.lit("").alias("_tail"))
    return chained(level, ("head", "n")).select(
        F.col("seq").alias("segment"), "head", F.col("n").alias("rows"),
        F.col("entry_hash").alias("chained_head"))


def root(sealed_heads: DataFrame) -> DataFrame:
    """One hash over all heads: the last of every block of heads, chained (a row per SEGMENT**2)."""
    tops = sealed_heads.groupBy(F.floor(F.col("segment") / SEGMENT).alias("seq")).agg(
        F.max_by("chained_head", "segment").alias("_head"))
    whole = chained(tops.withColumns({"segment": F.lit(0), "_tail": F.lit("")}), ())
    return whole.agg(F.max_by("entry_hash", "seq").alias("root"))


def verify(ledger: DataFrame, sealed_heads: DataFrame | None = None) -> DataFrame:
    """Every broken entry or segment with its reason; empty when the log holds.

    Recomputing a hash is row-local and the comparison with the neighbour is a window over one
    segment, so verification runs on all segments at once.  A segment that is consistent in itself
    may still be forged or gone: with the heads that were stored when it was sealed, every segment is
    compared with its own.  The heads are trusted here; ``audit`` trusts one root only.
    """
    broken = broken_entries(ledger)
    if sealed_heads is None:
        return broken
    now = ledger.withColumn("segment", F.floor(F.col("seq") / SEGMENT)).groupBy("segment").agg(
        F.max_by("entry_hash", "seq").alias("_head"), F.count("*").alias("_rows"))
    met = sealed_heads.select("segment", "head", "rows").join(now, "segment", "full")
    reason = (F.when(F.col("_head").isNull(), "segment missing")
              .when(F.col("head").isNull(), "segment was never sealed")
              .when((F.col("head") != F.col("_head")) | (F.col("rows") != F.col("_rows")),
                    "segment does not match its sealed head"))
    return broken.unionByName(met.select(
        "segment", (F.col("segment") * SEGMENT).alias("seq"), reason.alias("reason")
    ).filter(F.col("reason").isNotNull()))


def broken_entries(ledger: DataFrame) -> DataFrame:
    rows = payload_parts(ledger)
    order = Window.partitionBy("segment").orderBy("seq")
    rows = rows.withColumns({
        "_last": F.lag("entry_hash").over(order), "_last_seq": F.lag("seq").over(order)})
    first = F.col("_last_seq").isNull()
    reason = (
        F.when(~first & (F.col("seq") != F.col("_last_seq") + 1), "sequence gap")
        .when(first & (F.col("seq") != F.col("segment") * SEGMENT), "sequence gap")
        .when(F.col("prev_hash") != F.coalesce("_last", F.lit(GENESIS)),
              "prev_hash does not match the entry before")
        .when(F.sha2(F.concat("_head", "prev_hash", "_tail"), 256) != F.col("entry_hash"),
              "content does not match its hash"))
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "segment", "seq", "reason")


def audit(ledger: DataFrame, nodes: DataFrame, size: int, peaks: list[str], root: str) -> DataFrame:
    """Every broken entry, and every segment that is not the one sealed under the trusted ``root``.

    Only the root is trusted (``accumulator``): stored heads are not read, and the stored tree is
    checked on the way, so a segment that was removed or forged with its head is named as well.
    """
    tops = ledger.withColumn("segment", F.floor(F.col("seq") / SEGMENT)).groupBy("segment").agg(
        F.max_by("entry_hash", "seq").alias("head"), F.count("*").alias("rows"))
    found = accumulator.audit(tops, nodes, size, peaks, root)
    return broken_entries(ledger).unionByName(
        found.select("segment", (F.col("segment") * SEGMENT).alias("seq"), "reason"))


def first_break(ledger: DataFrame, sealed_heads: DataFrame | None = None) -> DataFrame:
    broken = verify(ledger, sealed_heads).agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))
    return broken.select(F.col("seq").isNull().alias("verified"), "seq",
                         F.coalesce("reason", F.lit("chain verified")).alias("reason"))


def latest(ledger: DataFrame, n: int) -> DataFrame:
    return ledger.orderBy(F.col("seq").desc()).limit(n)


def for_pid(ledger: DataFrame, pid: str) -> DataFrame:
    return ledger.filter(F.col("subject_pid") == pid)


def for_action(ledger: DataFrame, action: str) -> DataFrame:
    return ledger.filter(F.col("action") == action)

