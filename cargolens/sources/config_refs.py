"""Code references in bundle configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens import fixed


def config_references(configs: DataFrame) -> DataFrame:
    """(bundle_id, config) JSON text -> (bundle_id, field, target).

    A field holds a string, a mapping of strings, or a mapping of lists of strings; list
    items are named ``field.key[i]``.  Anything else is ignored.
    """
    parsed = configs.select("bundle_id", F.try_parse_json("config").alias("config"))
    fields = parsed.select(
        "bundle_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("field"),
                        F.try_variant_get("config", f"$.{name}", "variant").alias("value"),
                    )
                    for name in fixed.BUNDLE_REF_FIELDS
                ]
            )
        ),
    ).filter(F.col("value").isNotNull())
    kind = F.schema_of_variant("value")

    plain = fields.filter(kind == "STRING").select(
        "bundle_id", "field", F.try_variant_get("value", "$", "string").alias("target")
    )
    mapped = fields.filter(kind.startswith("OBJECT")).select(
        "bundle_id",
        "field",
        F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("key", "item"),
    ).withColumn("field", F.concat("field", F.lit("."), "key"))
    item_kind = F.schema_of_variant("item")
    single = mapped.filter(item_kind == "STRING").select(
        "bundle_id", "field", F.try_variant_get("item", "$", "string").alias("target")
    )
    listed = (
        mapped.filter(item_kind.startswith("ARRAY"))
        .select(
            "bundle_id",
            "field",
            F.posexplode(F.try_variant_get("item", "$", "array<variant>")).alias("i", "item"),
        )
        .filter(F.schema_of_variant("item") == "STRING")
        .select(
            "bundle_id",
            F.concat("field", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("field"),
            F.try_variant_get("item", "$", "string").alias("target"),
        )
    )
    return plain.unionByName(single).unionByName(listed).filter(F.col("target") != "")
