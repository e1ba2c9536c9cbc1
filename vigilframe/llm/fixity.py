"""Fixity audit of WARC files by Merkle trees over ordered offset ranges.

Records lie one after the other in their file.  A leaf is the SHA-256 of a record's bytes; an inner
node covers the offset range of up to FANOUT nodes below it and hashes that range with their hashes.
Replicas are compared from the roots down: a level is looked at only below nodes that differ, so an
intact file costs one comparison and a damaged record a path.  A lost, added or longer record shifts
what lies behind it, so the leaves that differ are aligned before anything is named: equal bytes belong
together wherever they lie, then equal record ids, equal places, and the order between aligned records.
A record that was only shifted is no finding; one with a record before it in the replica that it
precedes here is reported as moved.

Defined results: a null or empty html is a record without content; a null url is written empty; rows
without a page_id go to files of their own, spread by content; repeated rows are records one after
the other; a record that a replica lacks is reported as lost, one that only the replica has as extra;
empty tables have no roots and no findings; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.tables import Scratch

FANOUT = 16
#: ids per file; nulls are spread over so many files
PER_FILE, NULL_FILES = 512, 1024


def record_text(url: Column, page_id: Column, html: Column) -> Column:
    """A WARC/1.1 resource record as text (its bytes are UTF-8)."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    ident = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), url).cast("binary"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), ident,
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def lay_out(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, seq, start, end, record): where every record of the pages lies."""
    record = record_text(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select("page_id", record.alias("record"))
    rows = rows.withColumn("file", F.coalesce(
        F.floor(F.col("page_id") / per_file).cast("long"),
        -1 - F.pmod(F.xxhash64("record"), F.lit(NULL_FILES))))
    order = Window.partitionBy("file").orderBy("page_id", "record")
    size = F.octet_length("record").cast("long")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq"),
                       (end - size).alias("start"), end.alias("end"), "record")


def leaves(records: DataFrame) -> DataFrame:
    ident = F.regexp_extract("record", r"WARC-Record-ID: <([^>\r]*)>", 1)
    return records.select("file", F.lit(0).alias("level"), F.col("seq").alias("idx"), "start", "end",
                          F.sha2(F.col("record").cast("binary"), 256).alias("hash"),
                          F.when(ident != "", F.xxhash64(ident)).alias("ident"))


def tree(records: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """All nodes (file, level, idx, start, end, hash, ident); level 0 are the records, the highest the root."""
    nodes = level = leaves(records)
    for k in range(1, levels(per_file) + 1):
        below = F.struct("idx", "start", "end", "hash")
        level = level.groupBy("file", F.floor(F.col("idx") / FANOUT).cast("long").alias("idx")).agg(
            F.array_sort(F.collect_list(below)).alias("below"))  # FANOUT nodes at most
        start, end = F.get("below.start", F.lit(0)), F.array_max("below.end")
        level = level.select("file", F.lit(k).alias("level"), "idx", start.alias("start"),
                             end.alias("end"), F.sha2(F.concat_ws(
                                 "|", start, end, F.concat_ws("|", "below.hash")), 256).alias("hash"),
                             F.lit(None).cast("long").alias("ident"))
        nodes = nodes.unionByName(level)
    return nodes


def levels(per_file: int) -> int:
    """So many levels bring a file of ``per_file`` records under one root."""
    k, held = 1, FANOUT
    while held < per_file:
        k, held = k + 1, held * FANOUT
    return k


def audit(ours: DataFrame, theirs: DataFrame, per_file: int = PER_FILE,
          scratch: Scratch | None = None) -> DataFrame:
    """Damaged records of a replica: where they lie, what is wrong, both hashes and both roots.

    Both sides are records as ``lay_out`` gives them, each laid out for itself; files with more than ``per_file`` records (ids
    that repeat) have several nodes on the highest level, compared alike.
    """
    scratch = scratch or Scratch(ours.sparkSession, "fixity")
    top = levels(per_file)
    a = scratch.write(tree(ours, per_file), "ours")
    b = scratch.write(tree(theirs, per_file), "theirs")

    def pairs(level: int, below: DataFrame | None) -> DataFrame:
        def side(nodes: DataFrame, name: str) -> DataFrame:
            rows = nodes.where(F.col("level") == level).withColumn(
                "up", F.floor(F.col("idx") / FANOUT).cast("long"))
            if below is not None:
                rows = rows.join(below.select("file", F.col("idx").alias("up")), ["file", "up"], "left_semi")
            return rows.select("file", "idx", *[F.col(c).alias(f"{name}_{c}") for c in ("start", "end", "hash", "ident")])

        met = side(a, "a").join(side(b, "b"), ["file", "idx"], "full")
        return met.where(~F.col("a_hash").eqNullSafe(F.col("b_hash"))
                         | ~F.col("a_start").eqNullSafe(F.col("b_start")))

    differ = roots = pairs(top, None)
    for level in range(top - 1, -1, -1):
        differ = pairs(level, differ)
    roots = roots.select("file", F.col("idx").alias("root_no"), F.col("a_hash").alias("root"),
                         F.col("b_hash").alias("found_root"))
    found = align(scratch.write(differ, "differ"), scratch)
    kind = F.when(F.col("b_hash").isNull(), "lost").when(F.col("a_hash").isNull(), "extra").when(
        F.col("a_hash") == F.col("b_hash"), "moved").otherwise("changed")
    found = found.withColumn("idx", F.coalesce("a_idx", "b_idx"))
    return found.withColumn("root_no", F.floor(F.col("idx") / FANOUT ** top).cast("long")).join(
        roots, ["file", "root_no"], "left").select(
        "file", F.col("idx").alias("seq"), F.coalesce("a_start", "b_start").alias("start_offset"),
        F.coalesce("a_end", "b_end").alias("end_offset"), kind.alias("kind"),
        F.col("a_hash").alias("expected_sha256"), F.col("b_hash").alias("found_sha256"), "root", "found_root")


def align(differ: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, a_*, b_*): which leaves of both sides belong together, without those only shifted."""
    sides = {n: differ.where(F.col(f"{n}_hash").isNotNull()).select(
        "file", F.col("idx").alias(f"{n}_idx"), *[f"{n}_{c}" for c in ("start", "end", "hash", "ident")])
        for n in "ab"}

    def by(rows: dict[str, DataFrame], columns: list[str]) -> DataFrame:
        """The k-th leaf of a file with these values on one side beside the k-th on the other."""
        met = []
        for n, side in rows.items():
            keyed = side.select("*", *[F.col(f"{n}_{c}").alias(f"_{c}") for c in columns])
            over = Window.partitionBy("file", *[f"_{c}" for c in columns]).orderBy(f"{n}_idx")
            met.append(keyed.withColumn("_k", F.row_number().over(over)))
        keys = ["file", *[f"_{c}" for c in columns], "_k"]
        on = met[0].alias("x").join(met[1].alias("y"), [
            F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) if c == "_gap" else F.col(f"x.{c}") == F.col(f"y.{c}")
            for c in keys], "full")
        return scratch.write(on.select(F.coalesce("x.file", "y.file").alias("file"), *[
            c for n in "ab" for c in rows[n].columns if c != "file"]), "by-" + "-".join(columns))

    def split(pairs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        both = F.col("a_hash").isNotNull() & F.col("b_hash").isNotNull()
        return pairs.where(both), {n: pairs.where(~both & F.col(f"{n}_hash").isNotNull()).select(
            *sides[n].columns) for n in "ab"}

    equal, rest = split(by(sides, ["hash"]))
    out = []
    for columns in (["ident"], ["idx", "start"]):
        pairs, rest = split(by(rest, columns))
        out.append(pairs)
    # what is left lies behind the same aligned record on both sides, or behind none
    for n in "ab":
        marks = equal.select("file", F.col(f"{n}_idx"), F.col("a_idx").alias("_mark"))
        marked = rest[n].unionByName(marks, allowMissingColumns=True)
        over = Window.partitionBy("file").orderBy(f"{n}_idx").rowsBetween(Window.unboundedPreceding, 0)
        rest[n] = marked.withColumn(f"{n}_gap", F.last("_mark", ignorenulls=True).over(over)).where(
            F.col(f"{n}_hash").isNotNull()).drop("_mark")
    out.append(by(rest, ["gap"]).drop("a_gap", "b_gap"))
    before = Window.partitionBy("file").orderBy("a_idx").rowsBetween(Window.unboundedPreceding, -1)
    moved = equal.withColumn("_last", F.max("b_idx").over(before)).where("_last > b_idx").drop("_last")
    for rows in out:
        moved = moved.unionByName(rows)
    return moved
