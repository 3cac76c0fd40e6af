"""Fixity audit of archive replicas by hash trees.

A record is a leaf. Records are dealt to files by a hash of their id and stand there in the order of
their ids, each with its offset range. A node hashes the hashes of up to FANOUT neighbours in order
and covers their joint range; the roots of files are grouped in the same way, up to one root for the
archive. An audit compares the roots, and from each differing node only looks at its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import store

FANOUT = 16
FILE_ROWS = 1000
#: File number of the nodes above the files.
ABOVE = -1


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """One response record as text: version, header lines, empty line, body, two line ends."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"),
    )


def leaves(replica: DataFrame, record_id: str, record: str) -> DataFrame:
    """(record_id, nth, length, copies, hash): one leaf per distinct content of an id.

    Only hashes and lengths leave the scan. Equal rows are one leaf that counts its copies. A null
    record is a leaf of its own kind, a null id is an id like any other.
    """
    data = F.col(record).cast("binary")
    rows = replica.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.coalesce(F.octet_length(data), F.lit(0)).cast("long").alias("length"),
        F.coalesce(F.sha2(data, 256), F.lit("")).alias("digest"))
    same = rows.groupBy("record_id", "length", "digest").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("record_id").orderBy("digest")
    return same.select(
        "record_id", F.row_number().over(order).alias("nth"), "length", "copies",
        F.sha2(F.concat_ws(":", F.lit("leaf"), "digest", "copies"), 256).alias("hash"))


def indexed(own: DataFrame, files: int) -> DataFrame:
    """Leaves with their place: file, ordinal, offset."""
    name = F.coalesce(F.col("record_id").cast("string"), F.lit(""))
    placed = own.withColumn("file", F.pmod(
        F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(files)).cast("int"))
    order = Window.partitionBy("file").orderBy("record_id", "nth")
    sofar = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumns({
        "ordinal": (F.row_number().over(order) - 1).cast("long"),
        "offset": F.coalesce(F.sum(F.col("length") * F.col("copies")).over(sofar), F.lit(0)),
    })


def tree(placed: DataFrame, files: int, longest: int) -> list[DataFrame]:
    """Levels from the leaves up to the root: nodes (file, ordinal, start, end, hash, up_file, up_ordinal).

    Inside files a parent has FANOUT children until each file has one root. Above, the roots are
    children in the order of the file numbers.
    """
    level = placed.select(
        "file", "ordinal", F.col("offset").alias("start"),
        (F.col("offset") + F.col("length") * F.col("copies")).alias("end"), "hash")
    up = F.floor(F.col("ordinal") / FANOUT)
    steps = [(F.col("file"), up)] * _height(longest)
    steps.append((F.lit(ABOVE), F.floor(F.col("file") / FANOUT)))
    steps += [(F.lit(ABOVE), up)] * _height(-(-files // FANOUT))
    levels = []
    for file, ordinal in steps:
        level = store(level.withColumns({"up_file": file.cast("int"), "up_ordinal": ordinal.cast("long")}), "tree")
        levels.append(level)
        parts = F.sort_array(F.collect_list(F.struct("file", "ordinal", "hash")))
        level = level.groupBy("up_file", "up_ordinal").agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.sha2(F.concat(F.lit("node"), F.array_join(F.transform(parts, lambda x: x["hash"]), "")), 256).alias("hash"),
        ).withColumnsRenamed({"up_file": "file", "up_ordinal": "ordinal"})
    return [*levels, store(level, "tree")]


def _height(nodes: int) -> int:
    """Levels above ``nodes`` neighbours, up to one."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // FANOUT), height + 1
    return height


def audit(primary: DataFrame, replica: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """Damaged places of ``replica``: record_id, file, ordinal, offset, length, status.

    ``primary`` gives the places. Status is ``changed`` or ``missing`` for its leaves, and ``extra`` for
    leaves of ``replica`` that it has no place for (there the place is null). An undamaged replica
    or two empty tables give no rows. See ``leaves`` for repeated rows and nulls; other columns play no part.
    """
    own = store(leaves(primary, record_id, record), "leaves")
    other = store(leaves(replica, record_id, record), "leaves")
    files = max(1, -(-own.count() // FILE_ROWS))
    places = store(indexed(own, files), "places")
    longest = (places.agg(F.max("ordinal")).first()[0] or 0) + 1
    same_id = [F.col("p.record_id").eqNullSafe(F.col("r.record_id")), F.col("p.nth") == F.col("r.nth")]
    found = places.alias("p").join(other.alias("r"), same_id, "left").select(
        *[F.col(f"p.{c}") for c in ("file", "ordinal", "offset", "length", "copies")],
        F.coalesce("r.hash", F.lit("missing")).alias("hash"))
    mine, theirs = tree(places, files, longest), tree(found, files, longest)
    bad = differing(mine, theirs)
    places = places.join(bad, ["file", "ordinal"])
    damaged = places.select(
        "record_id", "file", "ordinal", "offset", "length",
        F.when(F.col("their_hash") == "missing", "missing").otherwise("changed").alias("status"))
    extra = other.alias("r").join(own.alias("p"), same_id, "left_anti").select(
        "record_id", F.lit(None).cast("int").alias("file"), F.lit(None).cast("long").alias("ordinal"),
        F.lit(None).cast("long").alias("offset"), "length", F.lit("extra").alias("status"))
    return damaged.unionByName(extra)


def differing(mine: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves (file, ordinal, their_hash) that differ, found from the root down: below a differing
    node, and nowhere else, the children are compared."""
    suspects = None
    for a, b in zip(reversed(mine), reversed(theirs), strict=True):
        b = b.select("file", "ordinal", F.col("hash").alias("their_hash"))
        if suspects is not None:
            above = suspects.select(F.col("file").alias("up_file"), F.col("ordinal").alias("up_ordinal"))
            a = a.join(above, ["up_file", "up_ordinal"], "left_semi")
        suspects = a.join(b, ["file", "ordinal"]).where(F.col("hash") != F.col("their_hash")).select(
            "file", "ordinal", "their_hash")
    return suspects
