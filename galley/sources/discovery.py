"""Input files, manifests and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def discover(spark: SparkSession, root: str, suffix: str = "pdf", skip: str | None = None) -> DataFrame:
    """(path, rel, length, output, clash): files below root by their suffix in any case, in the order of their lower-cased relative paths.

    Files below skip (an output folder inside the input) are left out. output is the name to write, clash says
    that another file would write the same. Only names and sizes are read.
    """
    glob = "*.[" + "][".join(c.lower() + c.upper() for c in suffix) + "]"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    rel = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    found = files.withColumn("rel", rel)
    if skip:
        found = found.where(~F.col("rel").startswith(skip.strip("/") + "/"))
    output = F.concat(F.regexp_replace(F.lower("rel"), "\\.[^.]*$", ""), F.lit(".docx"))
    made = found.withColumn("output", output)
    return made.withColumn("clash", F.count("*").over(Window.partitionBy("output")) > 1).orderBy(F.lower("rel"))


def keyed_json(spark: SparkSession, path: str, key: str, value: StructType, field: str, version: tuple[str, int]) -> DataFrame:
    """Rows of a JSON object of objects under `field`, one per key; another version, or other fields than the schema's, raise.

    version is the name and the number that the document must carry.
    """
    name, number = version
    entry = value.simpleString()
    schema = f"{name} bigint, {field} map<string,{entry}>"
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{field} map<string,string>")[field].alias("m"))
    names = {f.name for f in value.fields}
    if whole.where(~F.col(name).eqNullSafe(number)).limit(1).count():
        raise ValueError(f"{name} must be {number}")
    fields = raw.select(F.explode("m").alias("k", "v")).select("k", F.explode(F.json_object_keys("v")).alias("f"))
    unknown = fields.where(~F.col("f").isin(*names)).limit(1).collect()
    if unknown:
        raise ValueError(f"{unknown[0].k}: unknown field {unknown[0].f}")
    return whole.select(F.explode(field).alias(key, "__e")).select(key, "__e.*")


def refusal(bytes_: Column, pages: Column, form_pages: Column, most_bytes: int = 250 << 20, most_pages: int = 250) -> Column:
    """Why a file is not converted, or null: too large, too many pages, a form."""
    return F.when(bytes_ > most_bytes, "too_large").when(pages > most_pages, "too_many_pages").when(form_pages >= F.greatest(F.lit(1.0), 0.1 * pages), "form_unsupported")
