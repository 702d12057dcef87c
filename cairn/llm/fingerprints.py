"""Document fingerprints: threshold-scaled sketches. All of it is DataFrame operations.

A sketch is the set of a document's shingle hashes below a fixed fraction of the range. Every document is held
to the same threshold (a quarter of the range), so the sketch of a union is the union of sketches, and the share of a small document's
sketch that a large one has estimates containment however unequal they are. A short text may have no hash below
the threshold. Its sketch stays empty then, and its least hash stands beside it: of two empty sketches it tells
whether the texts are alike, as a MinHash of one slot does, and the least of a union is the lesser of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

WIDTH = 5


def hashes(text: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """Two steps: the words' hashes, and from a column _w of these the shingles'. A shorter text is one shingle."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = F.col("_w")
    n = F.size(w)
    shingle = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    whole = F.when(n > 0, F.array(F.xxhash64(*(F.get(w, F.lit(k)) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(words, lambda x: F.xxhash64(x)), F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), shingle)).otherwise(whole)


def retained(all_hashes: Column, fraction: float) -> Column:
    """The hashes below the threshold, by their lower 32 bits, sorted, and the least of all (null of an empty text)."""
    limit = int(-(2**63) + fraction * 2**64)
    lower = lambda h: F.shiftright(F.shiftleft(h, 32), 32).cast("int")
    low = F.array_sort(F.array_distinct(F.transform(F.filter(all_hashes, lambda h: h < F.lit(limit)), lower)))
    return F.struct(low.alias("low"), F.array_min(all_hashes).alias("least"))


def with_sketch(df: DataFrame, text: str, to: str, fraction: float) -> DataFrame:
    """df with the sketch (low, least) of a text column; each step is a projection of its own so that none is evaluated twice."""
    w, h = hashes(F.col(text))
    return df.withColumn("_w", w).withColumn("_h", h).drop("_w").withColumn(to, retained(F.col("_h"), fraction)).drop("_h")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.struct(F.array_sort(F.array_union(a["low"], b["low"])).alias("low"), F.least(a["least"], b["least"]).alias("least"))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all of either. Of two empty sketches the least hashes decide; two texts without words are alike."""
    both, of_a, of_b = F.size(F.array_intersect(a["low"], b["low"])), F.size(a["low"]), F.size(b["low"])
    return F.when((of_a == 0) & (of_b == 0), a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(both / (of_a + of_b - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null where a has words but too few for a sketch, 1 where it has none."""
    n = F.size(a["low"])
    return F.when(n > 0, F.size(F.array_intersect(a["low"], b["low"])) / n).when(a["least"].isNull() | (a["least"] == b["least"]), 1.0)


def as_text(sketch: Column) -> Column:
    """The hashes in hexadecimal; of an empty sketch "~" and the least hash, or nothing for a text without words."""
    digits = lambda h, n: F.lower(F.lpad(F.right(F.hex(h), F.lit(n)), n, "0"))
    low = F.array_join(F.transform(sketch["low"], lambda h: digits(h, 8)), "")
    return F.when(F.size(sketch["low"]) > 0, low).otherwise(F.coalesce(F.concat(F.lit("~"), digits(sketch["least"], 16)), F.lit("")))


def followers(ids: DataFrame) -> DataFrame:
    """ids (doc_id, h, n) with the same of the document each is next to: before_id, before_h, before_n.

    Documents are ordered by descending doc_id (null last), then h; after the last comes the first. ids are
    dealt by range, looked up within each range, and the ranges' last rows, one for each, link the ranges up.
    """
    place = F.struct(F.col("doc_id").isNull().alias("nul"), F.bitwise_not("doc_id").alias("inv"), "h", "n", "doc_id")
    dealt = cut(ids.select(place.alias("o")).repartitionByRange("o").withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max("o").alias("last"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    link = ends.select("part", F.coalesce(F.lag("last").over(every), F.max("last").over(Window.partitionBy(F.lit(0)))).alias("end"))
    before = F.coalesce(F.lag("o").over(Window.partitionBy("part").orderBy("o")), F.col("end"))
    return dealt.join(link, "part").select("o.doc_id", "o.h", "o.n", before.alias("b")).select("doc_id", "h", "n", F.col("b.doc_id").alias("before_id"), F.col("b.h").alias("before_h"), F.col("b.n").alias("before_n"))


def fingerprint(docs: DataFrame, fraction: float = 1 / 4) -> DataFrame:
    """One row per document: doc_id, text, sketch. Null texts are empty; rows that repeat stay."""
    return with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch", fraction)


def compare_edited(docs: DataFrame, fraction: float = 1 / 4) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch.

    The edited text has the last third of the code points replaced by as many (or all) of the first of the next
    document's. The next document is found on ids and text hashes alone. Texts are dealt once by id, and what a
    document gives to the one before it is no more than the start of its text and its sketch.

    Defined results: null texts are empty; rows that agree in doc_id and text are one document in the order and
    each has its row; of an only document the next is itself; an empty table gives an empty table; other columns
    are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = cut(rows.groupBy("doc_id", "h").agg(F.max(F.char_length("text").cast("long")).alias("n"), F.count("*").alias("copies")))
    many = ids.where("copies > 1").select(F.col("doc_id").alias("i"), F.col("h").alias("ih"), "copies")
    repeated = not many.isEmpty()
    if repeated:
        rows = rows.dropDuplicates(["doc_id", "h"])
    chain = followers(ids.select("doc_id", "h", "n")).select(F.col("doc_id").alias("i"), F.col("h").alias("ih"), "before_id", "before_h", "before_n")
    given = rows.join(chain, rows.doc_id.eqNullSafe(chain.i) & (rows.h == chain.ih))
    prefix = F.substring(F.col("text"), F.lit(1), F.floor(F.col("before_n") / 3).cast("int"))
    given = with_sketch(given.select("text", prefix.alias("prefix"), "before_id", "before_h"), "text", "next_sketch", fraction).drop("text")
    own = rows.join(given, rows.doc_id.eqNullSafe(given.before_id) & (rows.h == given.before_h)).select("doc_id", "h", "text", "prefix", "next_sketch")
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("prefix"))
    own = with_sketch(own.withColumn("edited_text", edited).withColumn("n_chars", n.cast("long")).drop("prefix"), "text", "sketch", fraction).drop("text")
    out = with_sketch(own, "edited_text", "edited_sketch", fraction)
    if repeated:
        out = out.join(many, out.doc_id.eqNullSafe(many.i) & (out.h == many.ih), "left").drop("i", "ih")
        out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long"))))).drop("_", "copies")
    return out.drop("h")
