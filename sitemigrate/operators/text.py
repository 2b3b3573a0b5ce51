"""Text hygiene over a corpus: invalid UTF-8, noncharacters, lengths, double encodings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONCHARACTERS = r"[\uFDD0-\uFDEF\uFFFE\uFFFF]|[\x{1FFFE}\x{1FFFF}\x{2FFFE}\x{2FFFF}\x{3FFFE}\x{3FFFF}\x{4FFFE}\x{4FFFF}\x{5FFFE}\x{5FFFF}\x{6FFFE}\x{6FFFF}\x{7FFFE}\x{7FFFF}\x{8FFFE}\x{8FFFF}\x{9FFFE}\x{9FFFF}\x{AFFFE}\x{AFFFF}\x{BFFFE}\x{BFFFF}\x{CFFFE}\x{CFFFF}\x{DFFFE}\x{DFFFF}\x{EFFFE}\x{EFFFF}\x{FFFFE}\x{FFFFF}\x{10FFFE}\x{10FFFF}]"
#: Well-formed sequences of one to four bytes, each byte as the Latin-1 character of its number.
WELL_FORMED = (
    "[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    "|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def invalid_parts(data: Column) -> Column:
    """The maximal parts of binary data that aren't UTF-8, as binaries in an array.

    Bytes are read as Latin-1, so that each is one character and well-formed sequences can be matched by their bytes.
    """
    bytes_ = F.decode(data, "ISO-8859-1")
    wrong = F.regexp_replace(bytes_, WELL_FORMED, "\u0100")
    return F.transform(F.filter(F.split(wrong, "\u0100+"), lambda x: x != ""), lambda x: F.encode(x, "ISO-8859-1"))


def utf8_report(df: DataFrame, bytes_col: str, by: str) -> DataFrame:
    """Rows, invalid rows and the bytes that make them invalid, by a column; ``bytes_col`` is binary."""
    bad = ~F.is_valid_utf8(F.col(bytes_col).cast("string"))
    wrong = F.aggregate(invalid_parts(F.col(bytes_col)), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_invalid"), F.coalesce(F.sum(F.when(bad, wrong)), F.lit(0)).alias("invalid_bytes"))


def scrub_text(df: DataFrame, bytes_col: str, out: str = "text") -> DataFrame:
    """``df`` with ``out``: the bytes as text, each maximal invalid part one U+FFFD; and ``changed``."""
    text = F.col(bytes_col).cast("string")
    return df.withColumn(out, F.make_valid_utf8(text)).withColumn("changed", ~F.is_valid_utf8(text))


def noncharacter_report(df: DataFrame, text_col: str) -> DataFrame:
    """Noncharacters by code point: how often, and in how many rows."""
    marked = df.withColumn("__row", F.monotonically_increasing_id()).filter(F.col(text_col).rlike(NONCHARACTERS))
    each = marked.select("__row", F.explode(F.regexp_extract_all(text_col, F.lit(f"({NONCHARACTERS})"), F.lit(1))).alias("c"))
    return each.groupBy(F.hex(F.encode("c", "UTF-32")).alias("code_point")).agg(F.count("*").alias("n"), F.count_distinct("__row").alias("n_rows"))


def length_profile(df: DataFrame, text_col: str, by: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Code points and bytes by a column: sums, largest, median, and quantiles of both at ``shares`` (arrays).

    Quantiles are exact: the value whose rank is ``share`` times the rows, rounded up. Rows are first counted by length, so what
    is put in order are distinct lengths.
    """
    points, size = F.length(text_col), F.octet_length(text_col)
    sums = df.groupBy(by).agg(F.count(text_col).alias("n_rows"), F.sum(points).alias("code_points"), F.sum(size.cast("long")).alias("n_bytes"), F.max(points).alias("longest"))
    lengths = df.filter(F.col(text_col).isNotNull()).select(F.col(by).alias("__by"), F.explode(F.array(F.struct(F.lit(0).alias("__of"), points.alias("__len")), F.struct(F.lit(1).alias("__of"), size.alias("__len")))).alias("__x")).select("__by", "__x.*")
    counts = lengths.groupBy("__by", "__of", "__len").agg(F.count("*").alias("__n"))
    group = Window.partitionBy("__by", "__of")
    ranked = counts.withColumn("__upto", F.sum("__n").over(group.orderBy("__len").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(group))

    def quantile(of: int, share: float) -> Column:
        rank = F.greatest(F.ceil(F.col("__all").cast("decimal(20,0)") * F.lit(Decimal(str(share)))), F.lit(1))
        return F.min(F.when((F.col("__of") == of) & (F.col("__upto") >= rank), F.col("__len")))

    found = ranked.groupBy("__by").agg(
        quantile(0, 0.5).alias("median_code_points"), F.array(*(quantile(0, s) for s in shares)).alias("code_point_quantiles"), F.array(*(quantile(1, s) for s in shares)).alias("byte_quantiles"),
    )
    return sums.join(found, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def repair_encoding(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``repaired`` and ``repair``: UTF-8 that was read as Latin-1 is read again; other text stays.

    A text qualifies if all its characters are below U+0100, some above U+007F, and its Latin-1 bytes are valid UTF-8.
    """
    c = F.col(text_col)
    narrow = c.rlike(r"[\x80-\xFF]") & ~c.rlike(r"[^\x00-\xFF]")
    again = F.encode(c, "ISO-8859-1").cast("string")
    fits = F.coalesce(narrow & F.is_valid_utf8(again), F.lit(False))
    return df.withColumn("repaired", F.when(fits, again).otherwise(c)).withColumn("repair", F.when(fits, "latin-1 read as utf-8").otherwise("none"))


def repair_bytes(df: DataFrame, bytes_col: str, out: str = "text") -> DataFrame:
    """``df`` with ``out`` and ``repair``: bytes that aren't UTF-8 but were taken for it are read as Latin-1; others as UTF-8.

    Every byte is a Latin-1 character, so nothing is lost; ``bytes_col`` is binary, and null stays null.
    """
    c = F.col(bytes_col)
    valid = F.is_valid_utf8(c.cast("string"))
    return df.withColumn(out, F.when(valid, F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1"))).withColumn("repair", F.when(valid, "none").when(~valid, "utf-8 read as latin-1"))
