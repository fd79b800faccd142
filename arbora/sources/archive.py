"""Archives of morphologies: metadata as JSON beside the files' texts.

The download of a public archive is no query and is left out; what was downloaded is filtered, grouped
and written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA = "neuron_id long, neuron_name string, species string, strain string, archive string, brain_region array<string>, cell_type array<string>, note string, age_classification string, gender string, scientific_name string, soma_surface string, surface string, volume string, upload_date string, deposition_date string"
#: Records of the public archive that are known to be damaged.
BAD_IDS = (33294, 79791, 81062, 86970, 268441)


def metadata(raw: DataFrame, column: str = "json") -> DataFrame:
    """raw with meta, its JSON text as a struct of the usual fields (others stay in the text)."""
    return raw.withColumn("meta", F.from_json(column, METADATA))


def is_valid(neuron_id: Column) -> Column:
    return ~neuron_id.isin(*BAD_IDS)


def convert(files: DataFrame, folder: str, where: Column | None = None, group_by: str | None = None, encoding: str = "UTF-8") -> None:
    """Writes the texts of rows (neuron_id, content binary, meta) as a table of SWC texts, in a folder per group.

    ``where`` filters by fields of meta; ``group_by`` names one of them. Contents are decoded by
    ``encoding``.
    """
    rows = files.where(is_valid(F.col("neuron_id")))
    if where is not None:
        rows = rows.where(where)
    rows = rows.select("neuron_id", F.decode("content", encoding).alias("text"), *([F.col(f"meta.{group_by}").cast("string").alias(group_by)] if group_by else []))
    w = rows.write.mode("overwrite")
    (w.partitionBy(group_by) if group_by else w).parquet(folder)


def detect_encoding(content: Column) -> Column:
    """UTF-8 or UTF-16 by its mark, UTF-8 if the bytes are valid, else ISO-8859-1."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(head == "EFBBBF", "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when(utf8, "UTF-8").otherwise("ISO-8859-1")
