"""Sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from compframe import schemas
from compframe.operators import filters

# Code pages tried for agency pages, in order.
AGENCY_CHARSETS = ("cp1251", "utf-8", "latin1")


def _single_byte(content: Column, charset: str) -> Column:
    """Bytes of a one-byte code page: read as the first 256 characters, then the upper half exchanged."""
    upper = bytes(range(128, 256))
    return F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin1"), upper.decode(charset, errors="replace"))


def decode_text(content: Column, charsets: tuple[str, ...] = ("utf-8",)) -> Column:
    """Bytes to text by the first code page that accepts them; the last one takes what is left."""
    if charsets == ("utf-8",):
        return F.decode(content, "UTF-8")

    def taken(name: str) -> Column:
        if name == "utf-8":
            return F.is_valid_utf8(content.cast("string"))
        free = [b for b in range(128, 256) if bytes([b]).decode(name, errors="ignore") == ""]
        return ~F.exists(F.array(*[F.lit(bytes([b])) for b in free]), lambda b: F.contains(content, b)) if free else F.lit(True)

    def text(name: str) -> Column:
        return F.make_valid_utf8(content.cast("string")) if name == "utf-8" else _single_byte(content, name)

    out = text(charsets[-1])
    for name in reversed(charsets[:-1]):
        out = F.when(taken(name), text(name)).otherwise(out)
    return out


def read_raw_pages(spark: SparkSession, path: str, charsets: tuple[str, ...] = ("utf-8",)) -> DataFrame:
    """Stored pages: Parquet with an ``html`` text or a ``content`` bytes column, or plain files."""
    df = spark.read.parquet(path)
    return df if "html" in df.columns else df.withColumn("html", decode_text(F.col("content"), charsets)).drop("content")


def read_page_files(spark: SparkSession, path: str, charsets: tuple[str, ...] = ("utf-8",)) -> DataFrame:
    """One page per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), decode_text(F.col("content"), charsets).alias("html"),
                        F.col("modificationTime").alias("fetched_at"))


def read_auctions(spark: SparkSession, path: str) -> DataFrame:
    """Live auctions with size and price, as the export reads them."""
    return spark.read.schema(schemas.AUCTIONS).parquet(path).where(filters.active_and_sized()).select(
        "id", "city", "neighborhood", "address", "price_eur", "size_sqm", "floor", "property_type",
        "is_partial_ownership", "auction_start", "auction_end", "is_expired")


def read_market(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MARKET).parquet(path)


def read_snapshot(spark: SparkSession, path: str, city: str) -> DataFrame:
    """The stored market extract of one town; other towns' files are not opened."""
    return spark.read.parquet(path).where(F.col("city") == city)


def resolve_deals(raw: DataFrame) -> DataFrame:
    """Current field names from current or older ones: the first that is not null, zero included."""
    price = F.coalesce("auction_price", "effective_price", "price", "price_eur")
    return raw.withColumns({
        "id": F.coalesce("bcpea_id", "id"),
        "effective_price": price.cast("bigint"), "price": F.coalesce("price", "price_eur", "auction_price").cast("bigint"),
        "discount": F.coalesce("discount_pct", "discount"),
        "comparables_count": F.coalesce("comparables_count", "market_sample_size"),
        "market_price": F.coalesce("market_price", "market_median_eur").cast("bigint"),
        "sqm": F.coalesce("sqm", "size_sqm"),
    }).drop("bcpea_id", "auction_price", "price_eur", "discount_pct", "market_sample_size", "market_median_eur", "size_sqm")


def read_deals(spark: SparkSession, path: str, form: str = "envelope") -> DataFrame:
    """Published deals: an ``envelope`` document, a bare ``array`` of deals, or JSON ``lines``."""
    deal = f"{schemas.DEALS}, {schemas.DEAL_ALIASES}"
    if form == "envelope":
        doc = spark.read.schema(f"generated_at string, sources array<string>, deals array<struct<{deal}>>")
        rows = doc.option("multiLine", True).json(path).select(F.explode("deals").alias("d")).select("d.*")
    else:
        rows = spark.read.schema(deal).option("multiLine", form == "array").json(path)
    return resolve_deals(rows)
