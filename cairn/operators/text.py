"""Sentences, chunks, units and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors to the base unit of each family (fixed values of the SI and of common usage).
UNITS = {
    "g": ("mass", 1e-3), "kg": ("mass", 1.0), "mg": ("mass", 1e-6), "t": ("mass", 1000.0),
    "m": ("length", 1.0), "mm": ("length", 1e-3), "cm": ("length", 1e-2), "km": ("length", 1000.0), "um": ("length", 1e-6),
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "d": ("time", 86400.0),
    "Pa": ("pressure", 1.0), "kPa": ("pressure", 1e3), "MPa": ("pressure", 1e6), "GPa": ("pressure", 1e9), "bar": ("pressure", 1e5),
    "mg/L": ("concentration", 1e-3), "g/L": ("concentration", 1.0),
}


def sentences(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, place, sentence): text cut after ., ! or ? before white space; nothing empty."""
    marked = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")
    rows = docs.select(F.col(id_).alias("id"), F.posexplode(F.filter(F.transform(marked, lambda s: F.trim(s)), lambda s: s != "")).alias("place", "sentence"))
    return rows.withColumn("place", F.col("place").cast("long"))


def chunks(docs: DataFrame, id_: str, text: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """(id, chunk, words, body): windows of words, each starting size - overlap after the last; the end is covered once."""
    w = F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")
    step = size - overlap
    rows = docs.select(F.col(id_).alias("id"), w.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    rows = rows.select("id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    body = F.slice("w", F.col("chunk") * step + 1, F.lit(size))
    return rows.select("id", F.col("chunk").cast("long").alias("chunk"), F.size(body).cast("long").alias("words"), F.array_join(body, " ").alias("body"))


def next_chunks(chunked: DataFrame) -> DataFrame:
    """Edges from each chunk to the next of its document."""
    a = chunked.select("id", "chunk")
    b = chunked.select("id", (F.col("chunk") - 1).alias("chunk"), F.col("chunk").alias("next"))
    return a.join(b, ["id", "chunk"])


def to_base(value: Column, unit: Column) -> tuple[Column, Column]:
    """Value in its family's base unit, and the family; null for a unit that is unknown."""
    factor = F.create_map(*(F.lit(x) for u, (_, f) in UNITS.items() for x in (u, f)))[unit]
    family = F.create_map(*(F.lit(x) for u, (k, _) in UNITS.items() for x in (u, k)))[unit]
    return value * factor, family


def redact(text: Column) -> Column:
    """Mail addresses, network addresses and long numbers as marks."""
    out = F.regexp_replace(text, r"[0-9a-zA-Z._%+-]+@[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)+", "[MAIL]")
    out = F.regexp_replace(out, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]")
    return F.regexp_replace(out, r"[0-9]{9,}", "[NUMBER]")


def snippet(text: Column, term: Column, around: int = 40) -> Column:
    """The text around the first place of a term, null where it is missing."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - around), F.least(at - 1, F.lit(around)) + F.length(term) + around))
