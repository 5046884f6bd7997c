"""The detection cascade: bytes -> (charset, has_bom).

Order matters and the first hit wins: entropy gate, byte-order mark, UTF-32, UTF-16, ASCII, UTF-8,
legacy code page. ASCII is decided in the JVM first, which is exact: such a sample has at most 98
distinct bytes (under 6.7 bits/byte), no NUL and no mark, so no earlier rule can claim it. The bulk of
a usual corpus therefore never leaves the JVM; the rest makes one pass per Arrow helper inside the
scan's own tasks. No rule shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import byte_features, once, strict_heads
from ..functions.constants import (
    ENTROPY_LIMIT, ENTROPY_MIN_BYTES, SAMPLE_BYTES, UNKNOWN, UTF16_CHI2_MIN, UTF16_MIN_BYTES,
    UTF16_NUL_HIGH, UTF16_NUL_LOW, UTF16_NUL_MIN, UTF32_MIN_BYTES,
)
from ..functions.text import bom_charset, is_ascii_text, looks_like_text, utf8_head
from .code_pages import CodePageModel
from .legacy import best_legacy, passes_text_test, rank_legacy


def sample_of(content: Column | str, sample_bytes: int = SAMPLE_BYTES) -> Column:
    if sample_bytes <= 0:
        raise ValueError("sample_bytes must be positive")
    return F.substring(F.col(content) if isinstance(content, str) else content, 1, sample_bytes)


def is_binary(size: Column, entropy: Column) -> Column:
    return (size >= ENTROPY_MIN_BYTES) & (entropy > ENTROPY_LIMIT)


def utf32_candidates(f: Column) -> tuple[Column, Column]:
    """(little-endian, big-endian): every unit's high byte is NUL."""
    enough = F.floor(f["size"] / 4) * 4 >= UTF32_MIN_BYTES
    return enough & f["last_lane_clear"], enough & f["first_lane_clear"]


def utf16_candidates(f: Column) -> tuple[Column, Column]:
    """(little-endian, big-endian): NUL density first, channel chi-square when that is inconclusive."""
    units = F.floor(f["size"] / 2)
    enough = units * 2 >= UTF16_MIN_BYTES
    be_nul = F.when(enough, f["even_nul"] / units)
    le_nul = F.when(enough, f["odd_nul"] / units)
    strong_be = (be_nul > UTF16_NUL_HIGH) & (le_nul < UTF16_NUL_LOW)
    strong_le = (le_nul > UTF16_NUL_HIGH) & (be_nul < UTF16_NUL_LOW)
    inconclusive = ~strong_be & ~strong_le & ((be_nul >= UTF16_NUL_MIN) | (le_nul >= UTF16_NUL_MIN))
    weak_be = inconclusive & (f["even_chi2"] >= UTF16_CHI2_MIN) & (f["even_chi2"] > f["odd_chi2"])
    weak_le = inconclusive & (f["odd_chi2"] >= UTF16_CHI2_MIN) & (f["odd_chi2"] > f["even_chi2"])
    no = F.lit(False)
    return F.coalesce(strong_le | weak_le, no), F.coalesce(strong_be | weak_be, no)


def unicode_candidates(f: Column) -> Column:
    """BOM-less UTF-32/UTF-16 charsets worth a strict decode, in trial order."""
    le32, be32 = utf32_candidates(f)
    le16, be16 = utf16_candidates(f)
    return F.array_compact(F.array(
        F.when(le32, "utf-32"), F.when(be32, "utf-32BE"),
        F.when(le16, "utf-16"), F.when(be16 & ~le16, "utf-16BE"),
    ))


def whole_units(sample: Column, charset: Column) -> Column:
    """Cut a sample to whole code units of a UTF-16/32 charset."""
    width = F.when(charset.startswith("utf-32"), 4).otherwise(2)
    return F.substring(sample, F.lit(1), F.length(sample) - F.length(sample) % width)


def accepted_unicode(heads: Column) -> Column:
    """First candidate whose decoded head looks like text."""
    good = F.filter(heads, lambda h: looks_like_text(h["head"]))
    return F.get(good, F.lit(0))["charset"]


def detect(
    df: DataFrame, content: str = "content", sample_bytes: int = SAMPLE_BYTES,
    legacy: bool | CodePageModel = True,
) -> DataFrame:
    """Add ``charset`` (``(Unknown)`` when nothing fits) and ``has_bom`` for a binary column.

    ``legacy`` ranks code pages by the fixed letter lists (True), by a learned model, or not at all (False).
    """
    if sample_bytes <= 0:
        raise ValueError("sample_bytes must be positive")
    staged = df.withColumn("_sample", sample_of(content, sample_bytes)).withColumns({
        "_size": F.coalesce(F.length("_sample"), F.lit(0)),
        "_mark": bom_charset(F.col("_sample")),
        "_ascii": F.coalesce((F.length("_sample") > 0) & is_ascii_text(F.col("_sample")), F.lit(False)),
    })
    # a marked sample below the entropy floor is settled too; the condition keeps settled rows out of Python
    unsettled = (F.col("_size") > 0) & ~F.col("_ascii") & (
        F.col("_mark").isNull() | (F.col("_size") >= ENTROPY_MIN_BYTES)
    )
    staged = staged.withColumn("_f", once(byte_features)(F.when(unsettled, F.col("_sample"))))
    f = F.col("_f")
    staged = staged.withColumn("_binary", F.coalesce(is_binary(f["size"], f["entropy"]), F.lit(False)))
    bomless = f.isNotNull() & ~F.col("_binary") & F.col("_mark").isNull()
    staged = staged.withColumn("_trials", F.when(bomless, unicode_candidates(f)))
    tried = F.coalesce(F.size("_trials"), F.lit(0)) > 0
    staged = staged.withColumns({
        "_heads": once(strict_heads)(F.when(tried, F.col("_sample")), F.col("_trials")),
        "_utf8": F.when(bomless, utf8_head(F.col("_sample"))),
    })
    staged = staged.withColumn(
        "_found",
        F.when(F.col("_binary") | (F.col("_size") == 0), F.lit(UNKNOWN))
        .when(F.col("_mark").isNotNull(), F.col("_mark"))
        .when(F.col("_ascii"), F.lit("us-ascii"))
        .otherwise(F.coalesce(
            accepted_unicode(F.col("_heads")),
            F.when(looks_like_text(F.col("_utf8")), F.lit("utf-8")),
        )),
    )
    helper = ["_sample", "_size", "_mark", "_ascii", "_f", "_binary", "_trials", "_heads", "_utf8", "_found"]
    charset = F.col("_found")
    if legacy:
        rest = F.col("_found").isNull()
        ranker = legacy.ranker() if isinstance(legacy, CodePageModel) else rank_legacy
        staged = staged.withColumn("_ranked", once(ranker)(F.when(rest, F.col("_sample"))))
        staged = staged.withColumn("_best", best_legacy(F.col("_ranked")))
        charset = F.coalesce(charset, F.when(passes_text_test(F.col("_best")), F.col("_best.charset")))
        helper += ["_ranked", "_best"]
    return staged.withColumns({
        "charset": F.coalesce(charset, F.lit(UNKNOWN)),
        "has_bom": F.col("_mark").isNotNull() & ~F.col("_binary"),
    }).drop(*helper)
