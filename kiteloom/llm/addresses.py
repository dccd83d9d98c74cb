"""Problem 5: records that differ only in how their address is written.

An address is brought to a canonical text by built-in expressions: character references and percent
codes are resolved, the fragment and tracking fields dropped, query fields sorted, and letter case,
blanks, punctuation and invisible characters removed. Two 64-bit hashes of that text (128 bits) are
the key; a check value of a third hash and the length tells colliding texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.skew import lookup_join
from kiteloom.plans.runtime import cut_lineage

# Tracking fields that do not belong to an address.
TRACKING_FIELDS = r"^(utm_.*|source|ref|fbclid|gclid)$"
# Named and numeric character references of signs that occur in addresses.
REFERENCES = {
    "&(amp|#0*38|#x0*26);": "&",
    "&(#0*47|#x0*2f|sol);": "/",
    "&(#0*61|#x0*3d|equals);": "=",
    "&(#0*63|#x0*3f|quest);": "?",
    "&(#0*35|#x0*23|num);": "#",
    "&(#0*\\d+|#x[0-9a-f]+|nbsp|shy|zwsp|zwnj|zwj|quot|apos|lt|gt|hyphen|dash|ndash|mdash|period|comma|colon|semi|excl|lowbar|plus|lpar|rpar);": "-",
}


def _decoded(text: Column) -> Column:
    """Percent codes resolved; a text with broken codes keeps them as they are."""
    plain = F.regexp_replace(text, r"%(?![0-9a-fA-F]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(plain), text)).otherwise(text)


def _bare(text: Column) -> Column:
    """Letters and digits only, in lower case; what is neither (marks too) is dropped, but for combining marks."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def canonical_address(url: Column) -> Column:
    """Canonical text of an address; empty where nothing is left of it (null, blank, signs only)."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\p{Z}\p{C}]+", "")
    resolved = text
    for pattern, sign in REFERENCES.items():
        resolved = F.regexp_replace(resolved, "(?i)" + pattern, sign)
    text = F.when(F.contains(text, F.lit("&")) & F.contains(text, F.lit(";")), resolved).otherwise(text)
    text = F.substring_index(text, "#", 1)
    path = F.substring_index(text, "?", 1)

    def field(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        value = _bare(_decoded(F.substring(part, F.length(name) + 2, F.length(part))))
        name = _bare(_decoded(name))
        kept = F.concat(name, F.lit("="), value)
        return F.when(F.lower(F.substring_index(part, "=", 1)).rlike(TRACKING_FIELDS) | (kept == "="), "").otherwise(kept)

    query = F.split(F.substring(text, F.length(path) + 2, F.length(text)), r"[&;?]")
    fields = F.array_sort(F.filter(F.transform(query, field), lambda f: f != ""))
    bare = _bare(_decoded(path))
    return F.when(F.contains(text, F.lit("?")), F.concat_ws("&", bare, fields)).otherwise(bare)


def keyed_addresses(df: DataFrame, key: str, url: str) -> DataFrame:
    """(rec_id, h1, h2, chk) of every row; chk is 0 where there is no address.

    The hashes are never null, so no filter on them has to be worked out a second time below.
    """
    canon = canonical_address(F.col(url))
    return df.select(F.col(key).cast("long").alias("rec_id"), canon.alias("canon")).select(
        "rec_id",
        F.xxhash64("canon").alias("h1"),
        F.xxhash64(F.lit("kiteloom"), "canon").alias("h2"),
        F.when(F.col("canon") == "", F.lit(0).cast("long"))
        .otherwise(F.crc32(F.encode("canon", "UTF-8")) * 65536 + F.length("canon") % 65536 + 1)
        .alias("chk"),
    )


def address_groups(keyed: DataFrame) -> DataFrame:
    """(h1, h2, chk, first_id, n): one row per address; rows without address or key are in no group."""
    return (
        keyed.groupBy("h1", "h2", "chk")
        .agg(F.min("rec_id").alias("first_id"), F.count("rec_id").alias("n"), F.max("chk").alias("real"))
        .filter((F.col("real") != 0) & (F.col("n") > 0))
        .drop("real")
    )


def copy_counts(df: DataFrame, key: str, url: str) -> DataFrame:
    """One row per distinct address: (first_id, n_copies, collided).

    `collided` tells that another text has the same 128 bits; the check value keeps them apart.
    Partial counts are made before the shuffle, so a group of any size moves as one row per task.
    Rows without an address belong to no group; an empty table gives none.
    """
    groups = address_groups(keyed_addresses(df, key, url))
    per_hash = groups.groupBy("h1", "h2").agg(
        F.collect_list(F.struct("first_id", "n")).alias("texts")  # one element but for collisions
    )
    return per_hash.select(F.explode("texts").alias("t"), (F.size("texts") > 1).alias("collided")).select(
        "t.first_id", F.col("t.n").alias("n_copies"), "collided"
    )


def address_copies(df: DataFrame, key: str, url: str) -> DataFrame:
    """(first_id, copy_id): every record but the first of its address, with the first.

    First means the smallest key; rows that share key and address count once. Null keys, null and blank
    addresses give no row. Members of groups above HOT_GROUP_ROWS are matched over SALTS salts.
    """
    rows = cut_lineage(keyed_addresses(df, key, url))  # 32 bytes a row; the canonical text is worked out once
    firsts = cut_lineage(address_groups(rows).filter(F.col("n") > 1))
    return (
        lookup_join(rows, firsts, ["h1", "h2", "chk"], size="n", spread="rec_id")
        .filter(F.col("rec_id") > F.col("first_id"))
        .select("first_id", F.col("rec_id").alias("copy_id"))
        .distinct()
    )
