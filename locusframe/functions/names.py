"""Column functions on sample names, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import OTHER_KITS

# Donor letters of each data set number (fixed values).
DONORS = {
    "1": ["A", "B", "C", "D", "E"],
    "2": ["F", "G", "H", "I", "J"],
    "3": ["K", "L", "M", "N", "O"],
    "4": ["P", "Q", "R", "S", "T"],
    "5": ["U", "V", "W", "X", "Y"],
    "6": ["Z", "AA", "AB", "AC", "AD"],
}


def is_rd_sample(name: Column) -> Column:
    return F.coalesce(F.substring(name, 1, 3).rlike("^[0-9][A-F][0-9]$"), F.lit(False))


def sample_prefix(name: Column, strict: bool = False) -> Column:
    """Text before the first underscore; null (or an error if strict) for other names."""
    other = F.raise_error(F.concat(F.lit("not an R&D sample: "), name)) if strict else F.lit(None)
    return F.when(is_rd_sample(name), F.split_part(name, F.lit("_"), F.lit(1))).otherwise(other.cast("string"))


def sample_noc(name: Column) -> Column:
    return F.when(is_rd_sample(name), F.concat(F.substring(name, 3, 1), F.lit("p")))


def is_control_sample(name: Column) -> Column:
    return F.lower(name).rlike("blanco|ladder|pocon|controle") | F.startswith(name, F.lit("A"))


def is_candidate_ladder(name: Column) -> Column:
    return F.lower(name).contains("ladder") & ~F.lower(name).rlike("|".join(OTHER_KITS))


def path_hash(path: Column) -> Column:
    """crc32 of the file name."""
    return F.crc32(F.encode(F.regexp_extract(path, "([^/]+)$", 1), "UTF-8"))


def locus_allele_key(marker: Column, allele: Column) -> Column:
    return F.concat_ws("_", marker, allele)


def strip_ob(allele: Column) -> Column:
    """Without the characters O, B and _ at either end."""
    return F.regexp_replace(allele, "^[OB_]+|[OB_]+$", "")


def scan_to_base(px: Column) -> Column:
    return F.lit(65.0) + px * F.lit(410.0) / F.lit(4096.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def threshold_mask(prob: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """1 at and above the threshold (calling, pixel metrics), or only above it (IoU)."""
    return (prob >= threshold if inclusive else prob > threshold).cast("int")


def prediction_label(classification: Column) -> Column:
    """The entry (key, value) of a map with the highest score, the first on ties; an error when empty."""
    entries = F.map_entries(classification)
    best = F.aggregate(F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0))), F.get(entries, F.lit(0)), lambda a, x: F.when(x["value"] > a["value"], x).otherwise(a))
    return F.when(F.size(entries) > 0, best).otherwise(F.raise_error(F.lit("no classification")).cast("struct<key:string,value:double>"))


def annotation_label(labels: Column) -> Column:
    """The single distinct label; an error on none or several."""
    own = F.array_distinct(labels)
    return F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(F.raise_error(F.lit("not exactly one label")).cast("string"))


def donors_of_sample(name: Column) -> Column:
    """File stems of a sample's donors, e.g. 1A2 -> [1A, 1B]; null for other names."""
    letters = F.create_map(*[x for k, v in DONORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    number = F.substring(name, 1, 1)
    many = F.try_to_number(F.substring(name, 3, 1), F.lit("9")).cast("int")
    return F.when(is_rd_sample(name), F.transform(F.slice(F.try_element_at(letters, number), F.lit(1), many), lambda x: F.concat(number, x)))
