"""Request payloads (A9, B18, Q6): JSON text holding ``{"instance": {...}}``,
``{"instances": [...]}`` or a bare object, parsed with ``from_json`` and split into good and
error rows without any Python per record. Works identically on a batch DataFrame and on a
streaming one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}


def parse_requests(df: DataFrame, payload_col: str, fields: T.StructType,
                   required: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``instances`` (array<struct>) and ``error`` (NULL when the request is usable).

    error values: 'invalid JSON' (anything but one strict JSON text, so also single quotes or text
    after it), 'provide instance or instances' (valid JSON that is not an object, or an empty or
    null list), 'invalid instance' (an instance that is not an object, or a field of another
    type), 'missing field <f>' (a required field absent in some instance). Any other object is
    one bare instance; unknown fields are ignored, missing and null ones are NULL.
    """
    text = F.concat(F.lit("["), F.col(payload_col), F.lit("]"))
    # the whole text must be the one element of an array; its elements come back as JSON text. Every
    # step is a column of its own, so that no text is parsed again for each use of it
    whole = F.from_json(text, T.ArrayType(T.StringType()), {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    out = df.withColumn("_ok", F.size(whole) == 1)
    # outer white space is no instance text; JSON's own brackets tell objects from other values
    out = out.withColumn("_body", F.when(F.col("_ok"), F.trim(F.col(payload_col))))
    body, keys = F.col("_body"), F.col("_keys")
    out = out.withColumn("_keys", F.when(body.startswith("{"), F.json_object_keys(body)))
    single, many = F.array_contains(keys, "instance"), F.array_contains(keys, "instances")
    listed = F.from_json(F.get_json_object(body, "$.instances"), T.ArrayType(T.StringType()), {"allowSingleQuotes": "false"})
    texts = (F.when(single, F.array(F.get_json_object(body, "$.instance")))
             .when(many, listed).when(keys.isNotNull(), F.array(body)))
    schema = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    out = out.withColumn("_texts", texts)
    typed = F.transform("_texts", lambda x: F.from_json(x, schema, STRICT))
    out = out.withColumn("_typed", typed)
    bad = F.exists("_texts", lambda x: x.isNull() | ~F.ltrim(x).startswith("{")) | F.exists("_typed", lambda x: x["_corrupt"].isNotNull())
    err: Column = (F.when(~F.coalesce("_ok", F.lit(False)), F.lit("invalid JSON"))
                   .when(F.col("_texts").isNull() | (F.size("_texts") == 0), F.lit("provide instance or instances"))
                   .when(bad, F.lit("invalid instance")))

    def absent(field: str):
        return lambda x: x[field].isNull()

    for f in required:
        err = err.when(F.exists("_typed", absent(f)), F.lit(f"missing field {f}"))
    plain = F.transform("_typed", lambda x: F.struct(*[x[f.name].alias(f.name) for f in fields.fields]))
    return out.withColumn("instances", plain).withColumn("error", err).drop("_ok", "_body", "_keys", "_texts", "_typed")


def explode_instances(parsed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Good requests only, one row per instance with its position in the request."""
    return (parsed.where(F.col("error").isNull())
            .select(*keep, F.posexplode("instances").alias("pos", "inst"))
            .select(*keep, "pos", "inst.*"))


def coerce_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """true/false or 0/1 flags to int, numeric text to double (NULL when not a number)."""
    out = df
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.BooleanType):
            out = out.withColumn(c, F.col(c).cast("int"))
        elif isinstance(dt, T.StringType):
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out
