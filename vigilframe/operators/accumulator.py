"""Merkle accumulator over the sealed segments of a ledger: one root stands for the whole log.

The heads of the segments are the leaves of a growing binary tree.  A node is made once, when both its
halves are complete, and never changes; it keeps the hashes of its halves beside its own.  The log of
``size`` segments is covered by the complete subtrees of the binary digits of ``size`` (its peaks); the
root hashes the size and the peaks from right to left.  Whoever kept one root can

* audit a later copy: every segment is compared with the hash that the authenticated node above it
  keeps, so a segment removed or forged *together with its stored head* is named;
* check that a later root only appended (``proofs``, ``consistent``): about two hashes a level suffice,
  and all pairs of seals are checked side by side.

Nodes are computed LEVELS levels at a time by one grouping, so a billion segments take four shuffles of
geometrically falling size, and ``extend`` touches only the groups behind the old end.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 8
#: no size has more binary digits
DIGITS = 62


def node_hash(left: str, right: str) -> str:
    return f"sha2(concat('node|', {left}, '|', {right}), 256)"


def leaves(heads: DataFrame) -> DataFrame:
    """(idx, hash) of every sealed segment, from (segment, head, rows)."""
    text = F.concat(F.lit("leaf|"), F.col("segment").cast("string"), F.lit("|"),
                    F.col("rows").cast("string"), F.lit("|"), "head")
    return heads.select(F.col("segment").cast("bigint").alias("idx"), F.sha2(text, 256).alias("hash"))


def _grouped(bottom: DataFrame, level: int) -> DataFrame:
    """(idx, hash) of one level -> the nodes of the LEVELS levels above it whose halves are there."""
    width = 1 << LEVELS
    packed = bottom.groupBy(F.shiftright("idx", LEVELS).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "hash"))).alias("by"))
    packed = packed.withColumn("a0", F.expr(
        f"transform(sequence(0, {width - 1}), i -> try_element_at(by, part * {width} + i))"))
    for k in range(1, LEVELS + 1):  # a missing half is null, and so is everything above it
        low = f"a{k - 1}"
        packed = packed.withColumn(f"a{k}", F.expr(
            f"transform(sequence(0, {(width >> k) - 1}), i -> {node_hash(f'{low}[2 * i]', f'{low}[2 * i + 1]')})"))
    rows = F.expr("flatten(array(" + ", ".join(
        f"transform(a{k}, (h, i) -> named_struct('level', {level + k}, 'idx', part * {width >> k} + i, "
        f"'left', a{k - 1}[2 * i], 'right', a{k - 1}[2 * i + 1], 'hash', h))" for k in range(1, LEVELS + 1)) + "))")
    return packed.select(F.inline(rows)).where("hash is not null")


def extend(nodes: DataFrame | None, heads: DataFrame, old: int, size: int) -> list[DataFrame]:
    """The nodes that appear when a log of ``old`` segments grows to ``size``, by round.

    ``heads`` holds at least the segments from the last multiple of 2**LEVELS below ``old`` on;
    ``nodes`` those made so far.
    """
    made, bottom, level = [], leaves(heads), 0
    while level == 0 or size >> level > 1:
        first = old >> level >> LEVELS << LEVELS  # of the first group that is not complete yet
        round_ = _grouped(bottom.where(F.col("idx") >= first), level)
        complete_before = F.expr(f"shiftleft(idx + 1, level) <= {old}")
        made.append(round_.where(~complete_before))
        level += LEVELS
        bottom = made[-1].where(F.col("level") == level).select("idx", "hash")
        if nodes is not None:
            bottom = bottom.unionByName(nodes.where(F.col("level") == level).select("idx", "hash"))
    return made


def accumulate(heads: DataFrame, size: int) -> DataFrame:
    """All nodes (level, idx, left, right, hash) of a log of ``size`` segments; no rows below two."""
    out = None
    for part in extend(None, heads, 0, size):
        out = part if out is None else out.unionByName(part)
    return out


def _hashes(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, idx, hash) of leaves and nodes."""
    return leaves(heads).select(F.lit(0).alias("level"), "idx", "hash").unionByName(
        nodes.select("level", "idx", "hash"))


def _set(number: str, digit: str) -> str:
    return f"shiftright({number}, {digit}) % 2 = 1"


def _peaks(sizes: DataFrame, column: str) -> DataFrame:
    """Each row with level and idx of every peak of the size in ``column``."""
    return sizes.select("*", F.explode(F.expr(
        f"filter(sequence(0, {DIGITS - 1}), d -> {_set(column, 'd')})")).alias("level")).withColumn(
        "idx", F.expr(f"shiftright({column}, level + 1) * 2"))


def root_hash(size: str, bagged: str) -> str:
    return f"sha2(concat('root|', cast({size} as string), '|', {bagged}), 256)"


def seals(heads: DataFrame, nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(size, peaks, root) of every ``size``: the peaks from the smallest (rightmost) on.

    A size whose peaks are not all there has a null root.
    """
    met = _peaks(sizes.select("size").distinct(), "size").join(_hashes(heads, nodes), ["level", "idx"], "left")
    packed = met.groupBy("size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", F.coalesce("hash", F.lit("")).alias("h")))),
                    lambda x: x["h"]).alias("peaks"))
    whole = F.expr("not exists(peaks, x -> x = '')")
    return packed.withColumn("root", F.when(whole, F.expr(root_of("size", "peaks"))))


def root_of(size: str, peaks: str) -> str:
    """The root from the peaks, smallest first."""
    bag = (f"aggregate(slice({peaks}, 2, size({peaks})), {peaks}[0], "
           f"(bag, x) -> {node_hash('x', 'bag')})")
    return root_hash(size, bag)


# ---------------------------------------------------------------------------- consistency ---
def proofs(heads: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """What shows that the log of ``size`` segments begins with that of ``before`` (1 <= before < size):
    (before, size, part, level, hash), part P (peaks of before), L and R (the cover of what was
    appended: halves to merge with, and peaks of the size)."""
    pairs = pairs.select("before", "size").distinct()
    peaks = _peaks(pairs, "before").withColumn("part", F.lit("P"))
    # of the appended segments, from the first to the last whole node of each level
    spans = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(DIGITS - 1))).alias("level"))
    spans = spans.withColumns({"first": F.expr("shiftright(before + shiftleft(1L, level) - 1, level)"),
                               "end": F.expr("shiftright(size, level)")}).where("first < end")
    left = spans.where("first % 2 = 1").withColumns({"idx": F.col("first"), "part": F.lit("L")})
    right = spans.where("end % 2 = 1").withColumns({"idx": F.col("end") - 1, "part": F.lit("R")})
    keep = ("before", "size", "part", "level", "idx")
    asked = peaks.select(*keep).unionByName(left.select(*keep)).unionByName(right.select(*keep))
    return asked.join(_hashes(heads, nodes), ["level", "idx"]).select("before", "size", "part", "level", "hash")


def consistent(proof: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (before, size, root_before, root) -> the same with ``consistent``: whether the proof leads to
    both roots.  One fold over the digits of the sizes; nothing but the proof and the roots is read."""
    def at(part: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("part") == part, F.struct("level", "hash")))).alias(part)

    packed = claims.join(proof, ["before", "size"], "left").groupBy("before", "size", "root_before", "root").agg(
        *[at(part) for part in "PLR"])
    peaks = "transform(array_sort(map_entries(P)), x -> x.value)"
    p, l, r = (f"try_element_at({part}, d)" for part in "PLR")
    # own: the node that holds the last old segment; once it is a peak of the new size, bag takes over
    merged = (f"CASE WHEN s.own IS NULL AND {p} IS NULL THEN NULL "
              f"WHEN s.own IS NULL THEN coalesce({node_hash(p, l)}, {p}) "
              f"WHEN {p} IS NOT NULL THEN {node_hash(p, 's.own')} "
              f"ELSE coalesce({node_hash('s.own', l)}, s.own) END")
    ends = f"({l} IS NULL AND (s.own IS NOT NULL AND {p} IS NULL OR s.own IS NULL AND {p} IS NOT NULL))"

    def onto(bag: str, peak: str) -> str:
        return f"coalesce({node_hash(peak, bag)}, {peak}, {bag})"

    step = (f"CASE WHEN s.done THEN named_struct('own', s.own, 'done', true, 'bag', {onto('s.bag', p)}) "
            f"ELSE named_struct('own', {merged}, 'done', {ends}, 'bag', "
            f"CASE WHEN {ends} THEN {onto(onto('s.bag', r), merged)} ELSE {onto('s.bag', r)} END) END")
    folded = (f"aggregate(sequence(0, {DIGITS - 1}), named_struct('own', cast(null as string), 'done', false, "
              f"'bag', cast(null as string)), (s, d) -> {step}, s -> s.bag)")
    found = packed.withColumns({
        "_before": F.when(F.size(F.map_keys("P")) > 0, F.expr(root_of("before", peaks))),
        "_size": F.expr(root_hash("size", folded))})
    held = (F.col("_before") == F.col("root_before")) & (F.col("_size") == F.col("root"))
    return found.select("before", "size", F.coalesce(held, F.lit(False)).alias("consistent"))


# ---------------------------------------------------------------------------------- audit ---
def root_from(size: int, peaks: list[str]) -> str:
    """The root of one seal, on the driver: its peaks are as many as the size has binary digits set."""
    def sha(*parts) -> str:
        return sha256("|".join(map(str, parts)).encode()).hexdigest()

    bag = peaks[0]
    for peak in peaks[1:]:
        bag = sha("node", peak, bag)
    return sha("root", size, bag)


def audit(heads: DataFrame, nodes: DataFrame, size: int, peaks: list[str], root: str) -> DataFrame:
    """Heads recomputed from a copy of the log, against one trusted root: (segment, reason).

    ``nodes``, ``size`` and ``peaks`` are stored beside the log and as untrusted as the log itself: a
    node counts if it hashes its halves and the node above it, or a peak, names it.  A node that does
    not hold is reported at its first segment.
    """
    spark = heads.sparkSession
    if size.bit_count() != len(peaks) or root_from(size, peaks) != root:
        return spark.createDataFrame([(0, "stored seal does not lead to the trusted root")],
                                     "segment bigint, reason string")
    at = [(d, size >> d + 1 << 1) for d in range(size.bit_length()) if size >> d & 1]
    named = spark.createDataFrame([(d, i, h) for (d, i), h in zip(at, peaks)], "level int, idx bigint, named string")
    named = named.unionByName(nodes.select(F.inline(F.expr(
        "array(named_struct('level', level - 1, 'idx', idx * 2, 'named', left), "
        "named_struct('level', level - 1, 'idx', idx * 2 + 1, 'named', right))"))))
    met = nodes.withColumn("holds", F.expr(node_hash("left", "right")) == F.col("hash")).join(
        named.where("level > 0"), ["level", "idx"], "full")
    wrong = met.where("not coalesce(holds and named = hash, false)").select(
        F.expr("shiftleft(idx, level)").alias("segment"),
        F.lit("a stored node above this segment does not hold").alias("reason"))
    met = named.where("level = 0").groupBy("idx").agg(F.min("named").alias("named")).join(
        leaves(heads).where(F.col("idx") < size).select("idx", F.col("hash").alias("found")), "idx", "full")
    reason = (F.when(F.col("found").isNull(), "segment missing")
              .when(F.col("named").isNull(), "segment was never sealed")
              .when(F.col("named") != F.col("found"), "segment does not match its sealed head"))
    out = met.select(F.col("idx").alias("segment"), reason.alias("reason")).where("reason is not null")
    return out.unionByName(wrong.distinct())
