"""Exact duplicates of texts through a cuckoo-filter index of live digests.

The index is a table in buckets of digests. Each bucket keeps its stored
content (digest, smallest facts of the group) and one cuckoo filter over it.
A digest that the filter doesn't know is new; a hit is verified against the
stored content, so false positives only cost a look-up. A filter that overflows
is built anew, larger, from the stored digests.

Hot groups: rows fold to one partial group per (digest, salt) before they meet
the index, so a digest sends at most SALTS rows to its bucket, whatever its size;
the way back to the rows is dealt over the same salts.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import attach_by_key, lower_ascii, salt_of, semi_by_id, text_of, unused
from usagelens.llm.cuckoo import CuckooFilter
from usagelens.session import materialise

BUCKET_KEYS = 20_000
ENTRY = "bucket int, digest binary, keep_id long, group_size long, filter binary"


@dataclass
class Index:
    """`live`: (doc_id, digest) rows. `table`: entries of ENTRY; a row without digest holds its bucket's filter."""

    live: DataFrame
    table: DataFrame
    buckets: int

    def groups(self) -> DataFrame:
        return self.table.filter(F.col("digest").isNotNull()).select("digest", "keep_id", "group_size")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(lower_ascii(text_of(F.col(text_col))).cast("binary"), 256)).alias("digest"))


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def partial_groups(live: DataFrame) -> DataFrame:
    """One row per (digest, salt): folded before the shuffle and small for a hot digest."""
    return live.groupBy("digest", salt_of(F.col("doc_id")).alias("_salt")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("_salt")


def _updated(bucket: int, stored: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """Apply changes to one bucket: `mode` 1 adds a partial group, 0 sets a group, -1 removes it."""
    content, known = {}, None
    for digest, keep, size, table in zip(stored["digest"], stored["keep_id"], stored["group_size"], stored["filter"]):
        if digest is None:
            known = CuckooFilter.from_bytes(table)
        else:
            content[digest] = (keep, size)
    known = known or CuckooFilter(CuckooFilter.room(len(changes)))
    for digest, keep, size, mode in zip(changes["digest"], changes["keep_id"], changes["group_size"], changes["mode"]):
        found = content.get(digest) if digest in known else None  # a hit counts only once the content confirms it
        if mode < 0:
            if found is not None:
                known.delete(digest)
                del content[digest]
            continue
        if found is not None and mode:
            olds = [x for x in (found[0], keep) if not pd.isna(x)]
            keep, size = max(olds) if olds else None, found[1] + size
        content[digest] = (keep, size)
        if found is None and not known.insert(digest):
            known = CuckooFilter.of(list(content), 2 * known.buckets)
    rows = [(bucket, d, None if pd.isna(k) else int(k), int(n), None) for d, (k, n) in content.items()]
    rows.append((bucket, None, None, None, known.to_bytes()))
    return pd.DataFrame(rows, columns=["bucket", "digest", "keep_id", "group_size", "filter"]).astype({"keep_id": "Int64", "group_size": "Int64"})


def _apply(changes: DataFrame, table: DataFrame | None, buckets: int) -> DataFrame:
    changes = changes.withColumn("bucket", bucket_of(F.col("digest"), buckets))
    if table is None:
        nothing = pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "filter": []})
        return changes.groupBy("bucket").applyInPandas(lambda key, new: _updated(int(key[0]), nothing, new), ENTRY)
    return table.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(
        lambda key, old, new: _updated(int(key[0]), old, new), ENTRY)


def build(live: DataFrame, label: str = "dedup") -> Index:
    """An index of `live` (doc_id, digest), which is stored; buckets follow the row count so that none grows."""
    live = materialise(live, f"{label}-live")
    buckets = max(16, -(-live.count() // BUCKET_KEYS))
    table = _apply(partial_groups(live).withColumn("mode", F.lit(1)), None, buckets)
    return Index(live, materialise(table, f"{label}-index"), buckets)


def insert(index: Index, added: DataFrame, label: str = "dedup") -> Index:
    """The index with further (doc_id, digest) rows; only their digests travel to the buckets."""
    added = materialise(added, f"{label}-added")
    table = _apply(partial_groups(added).withColumn("mode", F.lit(1)), index.table, index.buckets)
    return Index(materialise(index.live.unionByName(added), f"{label}-live"), materialise(table, f"{label}-index"), index.buckets)


def delete(index: Index, gone: DataFrame, label: str = "dedup") -> Index:
    """The index without the documents in `gone` (doc_id).

    Groups that lose a document are folded again from the live rows; a digest
    without live rows leaves the filter and the content.
    """
    gone = gone.select("doc_id").distinct()
    live = materialise(index.live.join(gone, "doc_id", "left_anti"), f"{label}-live")
    touched = index.live.join(gone, "doc_id", "left_semi").select("digest").distinct()
    left = partial_groups(live.join(touched, "digest", "left_semi")).groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    changes = touched.join(left, "digest", "left").withColumn("mode", F.when(F.col("group_size").isNull(), -1).otherwise(0))
    return Index(live, materialise(_apply(changes, index.table, index.buckets), f"{label}-index"), index.buckets)


def _judged(index: Index) -> DataFrame:
    rows = attach_by_key(index.live, index.groups(), "digest", "doc_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased) the row with the largest id stays. Null
    texts are empty texts. A null id never stays while its group has another id;
    of repeated rows with the same id all are marked kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    return _judged(build(digests(docs, id_col, text_col))).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns.

    Ids are looked up alone where they are unique. Rows that share an id (there
    are none in a sound table) are judged by id and digest, and one row of each
    pair stays.
    """
    index = build(digests(docs))
    judged = materialise(_judged(index).select("doc_id", "digest", "kept"), "dedup-kept")
    shared = materialise(index.live.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "dedup-shared")
    kept = judged.filter("kept")
    if shared.isEmpty():
        return semi_by_id(docs, kept.select("doc_id"))
    own, wanted = unused(docs, "_own"), unused(docs, "_digest")
    several = semi_by_id(docs, shared).withColumn(own, F.unhex(F.sha2(lower_ascii(text_of(F.col("text"))).cast("binary"), 256)))
    wanted_id = unused(docs, "_wanted")
    several = several.join(kept.select(F.col("doc_id").alias(wanted_id), F.col("digest").alias(wanted)),
                           F.col("doc_id").eqNullSafe(F.col(wanted_id)) & (F.col(own) == F.col(wanted)), "left_semi").dropDuplicates(["doc_id", own])
    return semi_by_id(semi_by_id(docs, shared, "left_anti"), kept.select("doc_id")).unionByName(several.drop(own))
