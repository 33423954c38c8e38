"""Joins that keep working when one key holds a large share of the rows.

The left side is the big one throughout. When Spark's own size estimate puts the right side under the session's
``spark.sql.autoBroadcastJoinThreshold`` the join is written plainly and the planner broadcasts it. Otherwise both
sides shuffle, and the key is extended by a salt: left rows draw it from the number of their input partition (and
from columns named for it), and the right side carries one copy of each row per salt. Rows of one key, exact
copies included, then spread over that many tasks, and adaptive execution may split a task that is still too
large. Nothing random goes into the salt, so a task that is run again sends each row to the same place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 8

#: Bits of the map of keys that a semi join sends to all tasks: eight megabytes at most, whatever the number of keys.
MAP_BITS, _PART_BITS = 1 << 26, 1 << 15

_SALT = "_salt"


def _bytes(text: str) -> int:
    """A Spark size setting such as ``10485760b``, ``10MB`` or ``-1`` in bytes."""
    units = {"b": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}
    digits = text.strip().lower().removesuffix("b") or "0"
    power = units.get(digits[-1], 0)
    return int(digits.rstrip("kmgtp")) * 1024**power


def fits_in_broadcast(df: DataFrame) -> bool:
    """Whether Spark estimates ``df`` to be within the session's broadcast threshold."""
    limit = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    try:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session gives no access to the estimate
        return False
    return estimate <= limit


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    salts: int | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Join on equal keys; ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    ``salts=None`` decides by the size of ``small``, 1 never salts, a larger number always does. ``spread_by``
    names columns that differ among rows of one key, for a left side that may already be partitioned by it.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    keys = [on] if isinstance(on, str) else list(on)
    if salts is None:
        salts = 1 if fits_in_broadcast(small) else DEFAULT_SALTS
    if salts == 1:
        return big.join(small, keys, how)
    drawn = F.xxhash64(F.spark_partition_id(), *spread_by)
    salted = big.withColumn(_SALT, F.pmod(drawn, F.lit(salts)).cast("int"))
    copies = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)


def key_map(ids: DataFrame, keys: Sequence[str], bits: int = MAP_BITS) -> DataFrame:
    """(``_part``, ``_bits``): a bit for each hash of a key that occurs, in rows of 4096 bytes; ``bits`` / 32768 rows at most."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits).cast("bigint"))
    known = ids.where(F.concat(*[F.isnotnull(k).cast("string") for k in keys]) == F.lit("true" * len(keys)))
    placed = known.select(F.floor(place / _PART_BITS).alias("_part"), (place % _PART_BITS).alias("_bit"))
    return placed.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def in_key_map(df: DataFrame, found: DataFrame, keys: Sequence[str], bits: int = MAP_BITS) -> DataFrame:
    """Rows whose key may occur among those of :func:`key_map`: all that do, and by chance some that do not.

    The map is broadcast: its size is bounded by ``bits``.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits).cast("bigint"))
    placed = df.withColumns({"_part": F.floor(place / _PART_BITS), "_bit": (place % _PART_BITS).cast("int")})
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = (F.floor(byte / F.pow(F.lit(2.0), F.col("_bit") % 8)) % 2) == 1
    return placed.join(F.broadcast(found), "_part").where(held).select(*[F.col(f"`{c}`") for c in df.columns])


def semi_join(
    df: DataFrame, ids: DataFrame, on: str | Sequence[str], ids_on: str | Sequence[str] | None = None,
    salts: int | None = None, prefilter: bool | None = None,
) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``ids``. Neither side needs to be distinct.

    When ``ids`` outgrow a broadcast, a bit map of their hashes is made first and sent to all tasks, so that only rows whose
    key may occur are shuffled; ``ids`` are read twice then. ``prefilter`` says so in advance.
    """
    keys = [on] if isinstance(on, str) else list(on)
    names = keys if ids_on is None else ([ids_on] if isinstance(ids_on, str) else list(ids_on))
    wanted = ids.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)])
    columns = df.columns
    if prefilter is None:
        prefilter = salts is None and not fits_in_broadcast(wanted)
    if prefilter and all(df.schema[k].dataType == wanted.schema[k].dataType for k in keys):  # else hashes differ
        df = in_key_map(df, key_map(wanted, keys), keys)
    return spread_join(df, wanted, keys, "left_semi", salts).select(*columns)


def semi_join_value(
    df: DataFrame, value: Column, dictionary: DataFrame, entry: str = "value", salts: int | None = None
) -> DataFrame:
    """Rows whose computed ``value`` equals an entry of a one-column dictionary."""
    columns = df.columns
    keyed = df.withColumn("_entry", value)
    return semi_join(keyed, dictionary, "_entry", entry, salts).select(*columns)


def join_demographics(
    stays: DataFrame, persons: DataFrame, key: str = "SUBJECT_ID", salts: int | None = None
) -> DataFrame:
    """Stays with the attributes of their person; stays without one are dropped."""
    return spread_join(stays, persons, key, "inner", salts)
