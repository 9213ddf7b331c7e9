"""Entity-attribute-value rows into one typed row per entity.

The latest usable value of every (entity, attribute) is chosen first, which needs no order among
the rows and shrinks an entity that holds a large part of the table to a row per attribute before
it is shuffled. Entities are then hash-bucketed; each bucket is streamed in Arrow batches in which
entities and attributes are dictionary-encoded and the values scattered, by row and column index,
into one numpy array per type.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U32_MAX, U64_MAX = (1 << 32) - 1, (1 << 64) - 1

#: Arrow and numpy form of the types a column can have.
TYPES = {"bigint": (pa.int64(), np.int64, T.LongType()), "double": (pa.float64(), np.float64, T.DoubleType()), "string": (pa.string(), object, T.StringType())}


@dataclass(frozen=True)
class Field:
    """A column of the wide table: the attribute ``name``, as ``column`` of ``type``."""

    name: str
    column: str
    type: str = "bigint"


def name_key(c: Column) -> Column:
    """A name without case, spaces and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def with_whole_number(df: DataFrame, text: str, out: str, most: Column, bases: Column) -> DataFrame:
    """``df`` with the bigint column ``out``: the one whole number 0..``most`` that ``text`` denotes; else null.

    Understood are decimal digits of any number with a sign, commas between groups of three, a
    fraction or an exponent (if the value is whole), hexadecimal with 0x, all of it within white
    space or double quotes, and where ``bases`` holds a sequence of 1 to 32 bases in either case,
    packed two bits each. Values from 2**63 on are given as the signed number with the same 64
    bits. ``most`` is a decimal(20,0), below 2**64; a null ``most`` gives null.
    """
    # in steps, so that no text is looked at once more for each use of what it gave
    df = df.withColumn("__t", F.regexp_replace(F.col(f"`{text}`"), r'^[\s\u00a0"]+|[\s\u00a0"]+$', ""))
    number = r"^([+-]?)(\d+|\d{1,3}(?:,\d{3})+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$"
    other = (
        F.when(bases & F.col("__t").rlike("^[ACGTacgt]{1,32}$"), F.conv(F.translate(F.upper("__t"), "ACGT", "0123"), 4, 10))
        .when(F.col("__t").rlike(r"^\+?0[xX]0*[0-9a-fA-F]{1,16}$"), F.conv(F.regexp_extract("__t", r"0[xX]0*([0-9a-fA-F]{1,16})$", 1), 16, 10))
    )
    df = df.withColumn("__is", most.isNotNull() & F.col("__t").rlike(number))
    part = lambda i: F.when(F.col("__is"), F.regexp_extract("__t", number, i))
    df = df.withColumn("__f", F.coalesce(part(3), F.lit(""))).withColumn("__e", part(4))
    df = df.withColumn("__m", F.ltrim(F.concat(F.regexp_replace(part(2), ",", ""), F.col("__f")), F.lit("0")))
    # digits right of the point, once the exponent has moved it
    right = F.length("__f") - F.when(F.col("__e") == "", 0).otherwise(F.col("__e").try_cast("int")).cast("bigint")
    df = df.withColumn("__r", right).withColumn("__left", F.length("__m") - F.col("__r"))
    plain = (
        F.when(F.col("__m") == "", "0")
        .when((F.col("__left") < 1) | (F.col("__left") > 20), None)
        .when(F.col("__r") <= 0, F.rpad("__m", F.col("__left").cast("int"), F.lit("0")))
        .when(F.ltrim(F.substr("__m", F.col("__left").cast("int") + 1), F.lit("0")) == "", F.substr("__m", F.lit(1), F.col("__left").cast("int")))
    )
    good = (part(1) != "-") | (F.col("__m") == "")
    digits = F.when(most.isNull(), None).when(F.col("__is"), F.when(good, plain)).otherwise(other)
    df = df.withColumn("__w", digits.try_cast("decimal(20,0)"))
    signed = F.when(F.col("__w") >= F.expr(f"{1 << 63}BD"), F.col("__w") - F.expr(f"{1 << 64}BD")).otherwise(F.col("__w"))
    return df.withColumn(out, F.when(F.col("__w") <= most, signed.cast("bigint"))).drop("__t", "__is", "__f", "__e", "__m", "__r", "__left", "__w")


def latest_values(rows: DataFrame, entity: str, attribute: str, value: Column, order: Sequence[str]) -> DataFrame:
    """(entity, attribute, value): of the non-null values of each pair the one that is last by ``order``.

    Nulls in ``order`` come first. Of rows equal in all of ``order`` the largest value holds.
    """
    # not filtered before: a filter would be pushed below the making of the value and repeat it
    own = rows.withColumn("__value", value)
    last = F.max(F.when(F.col("__value").isNotNull(), F.struct(*[F.col(f"`{c}`") for c in order], F.col("__value"))))
    best = own.groupBy(F.col(f"`{entity}`").alias("entity"), F.col(f"`{attribute}`").alias("attribute")).agg(last.alias("b"))
    return best.where("b is not null").select("entity", "attribute", F.col("b.__value").alias("value"))


def scatter(batches: Iterator[pa.RecordBatch], fields: Sequence[Field]) -> Iterator[pa.RecordBatch]:
    """Wide batches from long ones that come in order of entity; the last entity of a batch may go on in the next."""
    names = [f.name for f in fields]
    by_type: dict[str, list[int]] = {}
    for i, f in enumerate(fields):
        by_type.setdefault(f.type, []).append(i)
    place = {i: (t, k) for t, cols in by_type.items() for k, i in enumerate(cols)}
    schema = pa.schema([("entity", pa.int64())] + [(f.column, TYPES[f.type][0]) for f in fields])

    def wide(table: pa.Table) -> pa.RecordBatch:
        entity = table.column("entity").combine_chunks().dictionary_encode()
        rows = entity.indices.to_numpy(zero_copy_only=False)
        code = pa.compute.index_in(table.column("attribute").combine_chunks(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        n, out = len(entity.dictionary), {}
        for t, cols in by_type.items():
            source = table.column(f"v_{t}").combine_chunks()
            values = np.zeros((n, len(cols)), TYPES[t][1])
            known = np.zeros((n, len(cols)), bool)
            position = np.full(len(names) + 1, -1)
            position[cols] = np.arange(len(cols))
            at = position[np.where(np.isnan(code), len(names), code).astype(np.int64)] if code.dtype.kind == "f" else position[code]
            hit = (at >= 0) & source.is_valid().to_numpy(zero_copy_only=False)
            given = source.to_numpy(zero_copy_only=False) if t == "string" else pa.compute.fill_null(source, 0).to_numpy(zero_copy_only=False)
            values[rows[hit], at[hit]] = given[hit]
            known[rows[hit], at[hit]] = True
            out[t] = (values, known)
        arrays = [entity.dictionary]
        for i, f in enumerate(fields):
            t, k = place[i]
            values, known = out[t]
            arrays.append(pa.array(values[:, k], TYPES[t][0], mask=~known[:, k]))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        ids = table.column("entity").combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(ids, ids[-1], "left"))  # the last entity may go on
        held = table.slice(cut)
        if cut:
            yield wide(table.slice(0, cut))
    if held is not None and held.num_rows:
        yield wide(held)


def widen(latest: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """One row (entity, a column per field) for each non-null bigint entity of ``latest``.

    ``latest`` has (entity, attribute, value or v_bigint/v_double/v_string), at most one row per
    entity and attribute (of more, any one holds); a ``value`` is cast to the type of its field, and
    is missing where it cannot be. Attributes that are no field are passed over;
    their entities keep a row. Missing values are null.
    """
    kinds = sorted({f.type for f in fields})
    if "value" in latest.columns:
        latest = latest.withColumns({f"v_{k}": F.col("value").try_cast(k) for k in kinds})
    long = latest.select(F.col("entity").cast("bigint").alias("entity"), "attribute", *[F.col(f"v_{k}").cast(k).alias(f"v_{k}") for k in kinds]).where("entity is not null")
    buckets = long.repartition("entity").sortWithinPartitions("entity")
    schema = T.StructType([T.StructField("entity", T.LongType())] + [T.StructField(f.column, TYPES[f.type][2]) for f in fields])
    fixed = tuple(fields)
    return buckets.mapInArrow(lambda it: scatter(it, fixed), schema)


def attribute_counts(rows: DataFrame, attribute: str) -> DataFrame:
    """(attribute, n): how often each spelling-free attribute name occurs; null names count as null."""
    return rows.groupBy(name_key(F.col(f"`{attribute}`")).alias("attribute")).agg(F.count(F.lit(1)).alias("n"))


def bus_records_wide(attrs: DataFrame, terms: DataFrame) -> DataFrame:
    """(rec_id, cb, ec, cnt): one row per rec_id of attribute-value rows of BUS records.

    A name counts as the field of a term of ``terms`` it is a spelling of. Of several usable values
    the one written last holds, among equals the one with the larger row_no. Every non-null rec_id
    has a row; fields without a usable value are null.
    """
    known = terms.select(name_key(F.col("term")).alias("name"), F.upper("field").alias("field")).where("field in ('CB', 'EC', 'COUNT')").distinct()
    rows = attrs.select("rec_id", "row_no", "written_at", "attr_val", name_key(F.col("attr")).alias("name")).where("rec_id is not null")
    named = rows.join(known, "name", "left")
    most = F.expr(f"case when field = 'CB' then {U64_MAX}BD when field is not null then {U32_MAX}BD end")
    named = with_whole_number(named, "attr_val", "number", most, F.col("field") == "CB")
    usable = latest_values(named.where("field is not null"), "rec_id", "field", F.col("number"), ["written_at", "row_no"])
    # records without any usable value keep a row of nulls
    every = named.groupBy(F.col("rec_id").alias("entity")).agg(F.lit(1).alias("one")).select("entity", F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("bigint").alias("value"))
    wide = widen(usable.unionByName(every), [Field("CB", "cb"), Field("EC", "ec"), Field("COUNT", "cnt")])
    return wide.withColumnRenamed("entity", "rec_id")
