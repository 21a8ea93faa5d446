"""WARC fixity audit: Merkle trees over records, compared from the roots down.

A record's bytes are a WARC response header and its payload; its leaf is their SHA-256. Records are
ordered by their id and lie in segments of ``SEGMENT`` ids; a segment's offsets start at 0, so no sum runs
over more than a segment. A node covers ``FANOUT`` ids' ranges of the level below and hashes its children's
ranges and hashes in order; levels rise from records to segments, and one root covers a replica's segments.
Trees of two replicas are compared at the root first, then only below nodes that differ.

Nulls and edge cases: a record with a null id can't be placed and is left out; null URLs and payloads hash as
such, apart from empty ones; repeated rows of an id form one leaf, of their number, their least and greatest hash and two sums over
them (never a list, however many there are), so repeats are noticed; a record that one replica lacks is located as missing or extra; empty replicas have no root and every
record of the other is reported. Ids are whole numbers of either sign.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

FANOUT, LEVELS = 16, 3
SEGMENT = FANOUT**LEVELS


def record(url: str = "url", payload: str = "html", key: str = "page_id"):
    """A WARC record as text; a null URL or payload has no header line of its own."""
    body = F.col(payload)
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col(key).cast("string"), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.col(url)), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, offset, length, hash) of each record in its segment."""
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), record(url, payload, key).alias("r"))
    rows = rows.select("id", F.octet_length("r").cast("long").alias("n"), F.sha2("r", 256).alias("h"))
    total = lambda salt: F.sum(F.xxhash64("h", F.lit(salt)).cast("decimal(20,0)"))
    one = rows.groupBy("id").agg(F.sum("n").alias("length"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi"), total(1).alias("s"), total(2).alias("u"))
    many = F.sha2(F.concat_ws(",", *(F.col(c).cast("string") for c in ("rows", "lo", "hi", "s", "u"))), 256)
    one = one.select("id", "length", F.when(F.col("rows") == 1, F.col("lo")).otherwise(many).alias("hash"), F.floor(F.col("id") / SEGMENT).alias("segment"))
    w = Window.partitionBy("segment").orderBy("id")
    return one.select("id", (F.sum("length").over(w) - F.col("length")).alias("offset"), "length", "hash")


def _parent(nodes: DataFrame, fanout: int) -> DataFrame:
    up = F.floor(F.col("id") / fanout)
    child = F.struct("id", F.concat_ws(":", F.col("id").cast("string"), F.col("length").cast("string"), "hash").alias("v"))
    grouped = nodes.groupBy(up.alias("id")).agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sort_array(F.collect_list(child)).alias("c"))
    return grouped.select("id", "offset", "length", F.sha2(F.concat_ws("|", F.transform("c", lambda x: x["v"])), 256).alias("hash"))


class Tree:
    """Levels of a replica's nodes, 0 the records, up to one whose ids are all 0 or, of negative ids, -1."""

    def __init__(self, pages: DataFrame, **names):
        self.levels = [C.save(leaves(pages, **names))]
        while len(self.levels) <= LEVELS or not self.levels[-1].where("id not in (0, -1)").isEmpty():
            self.grow()

    def grow(self) -> None:
        self.levels.append(C.save(_parent(self.levels[-1], FANOUT)))

    def discard(self) -> None:
        """Delete the levels' tables."""
        C.discard(*self.levels)

    @property
    def root(self) -> str | None:
        """Hash over the top level, of two nodes at most."""
        top = sorted(self.levels[-1].collect(), key=lambda r: r.id)
        return hashlib.sha256("|".join(f"{r.id}:{r.length}:{r.hash}" for r in top).encode()).hexdigest() if top else None


def audit(original: Tree, replica: Tree) -> DataFrame:
    """(page_id, status, offset, length, hash, replica_hash), saved, of the records that differ; status is changed, missing or extra."""
    while len(original.levels) != len(replica.levels):
        min(original, replica, key=lambda t: len(t.levels)).grow()
    same, differ = original.root == replica.root, None
    for level in range(0 if same else len(original.levels) - 1, -1, -1):
        a = original.levels[level]
        b = replica.levels[level].select("id", F.col("offset").alias("offset_b"), F.col("length").alias("length_b"), F.col("hash").alias("hash_b"))
        if same:
            a, b = a.where("false"), b.where("false")
        if differ is not None:  # only children of nodes that differ
            up = C.small(differ, 16)
            a = a.join(up, F.floor(F.col("id") / FANOUT) == F.col("up"), "left_semi")
            b = b.join(up, F.floor(F.col("id") / FANOUT) == F.col("up"), "left_semi")
        wrong = a.join(b, "id", "full").where(~F.col("hash").eqNullSafe(F.col("hash_b")) | ~F.col("length").eqNullSafe(F.col("length_b")))
        if level:
            before, differ = differ, C.save(wrong.select(F.col("id").alias("up")))
            if before is not None:
                C.discard(before)
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    out = C.save(wrong.select(F.col("id").alias("page_id"), status.alias("status"), F.coalesce("offset", "offset_b").alias("offset"), F.coalesce("length", "length_b").alias("length"), "hash", F.col("hash_b").alias("replica_hash")))
    if differ is not None:
        C.discard(differ)
    return out
