"""Rendezvous hashing of record keys over weighted shards (DataFrame functions only)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, read_table

#: Parts into which the rows of a shard are dealt to number them.
SLOT_PARTS = 512


def unit_draw(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts joined by ':'; null parts read as 'null'."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def assign_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard s with the largest weights[s] / -ln(u(key, s)); ties go to the smaller shard.

    Adding a shard changes the draws of no other one, so a row either stays or moves to the new one.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.ln(unit_draw(key, F.lit(s)))).alias("score"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    return (-(F.greatest(*scores)["s"] if len(scores) > 1 else scores[0]["s"])).cast("int")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, new_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of len(weights) shards under the law `key`, and number the rows of each shard from 0.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard (the shard with one more of
    new_weight). A null or empty text has size 1 and CRC 0; a null key is the key 'null'; equal keys share a shard;
    repeated rows all stay. Only key and text are read, so other columns may have any names. An empty table gives none.

    The digest is written once and read twice: counts for each (shard, part) are summed into offsets (a table of
    shards x parts rows), and rows are numbered within a part, so no task ever holds a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    k = F.col(key)
    digest = materialize(
        docs.select(k.alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), assign_shard(k, weights).alias("shard"), assign_shard(k, [*weights, new_weight]).alias("grown_shard"))
        .withColumn("part", F.floor(unit_draw("doc_id", "text_crc32", "size") * SLOT_PARTS).cast("int")),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = digest.groupBy("shard", "part").agg(F.count("*").alias("rows")).select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        digest.withColumn("rn", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "part"])  # at most len(weights) * SLOT_PARTS rows
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rn") + F.col("offset") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op2_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_rendezvous_sharding": op2_rendezvous_sharding}


_DRAW = "((('0x' || substr(md5({0}), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0"


def _oracle(weights: Sequence[float] = (1.0,) * 8, new_weight: float = 1.0) -> str:
    key = "coalesce(cast(doc_id as varchar), 'null')"

    def pick(ws):
        scores = ", ".join(f"{w} / -ln({_DRAW.format(f"{key} || ':{s}'")})" for s, w in enumerate(ws))
        return f"cast(list_position([{scores}], list_max([{scores}])) - 1 as integer)"

    part = f"floor({_DRAW.format(f"{key} || ':' || text_crc32 || ':' || size")} * {SLOT_PARTS})"
    return f"""
with t as (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc_table
           from (select unnest(range(256)) i order by i)),
d as (select doc_id, strlen(coalesce(text, '')) + 1 as size, coalesce(text, '') body, {pick(weights)} shard, {pick([*weights, new_weight])} grown_shard from documents),
e as (select doc_id, cast(size as bigint) size, shard, grown_shard,
  cast(xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::bigint),
       lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) as bigint) as text_crc32 from d, t)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by {part}, doc_id, text_crc32, size) - 1 as slot, grown_shard from e"""


ORACLES = {"op2_rendezvous_sharding": _oracle()}
