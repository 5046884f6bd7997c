"""The charset dimension: names, aliases, byte-order marks and the codec that implements each.

It is a fixed table of a few hundred short rows, so joins against it are always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .constants import BOMS

# Charset name, Python codec, offered in charset pickers, aliases.
CHARSETS = [
    ("us-ascii", "ascii", True, "ascii ansi_x3.4-1968 iso-ir-6 iso646-us us cp367 csascii"),
    ("utf-8", "utf-8", True, "utf8 unicode-1-1-utf-8 unicode-2-0-utf-8"),
    ("utf-16", "utf-16-le", True, "utf-16le unicode ucs-2 iso-10646-ucs-2"),
    ("utf-16BE", "utf-16-be", True, "unicodefffe"),
    ("utf-32", "utf-32-le", True, "utf-32le"),
    ("utf-32BE", "utf-32-be", True, ""),
    ("euc-jp", "euc_jp", True, "x-euc x-euc-jp cseucpkdfmtjapanese"),
    ("euc-kr", "euc_kr", True, "cseuckr"),
    ("iso-2022-kr", "iso2022_kr", True, "csiso2022kr"),
    ("iso-2022-jp", "iso2022_jp", True, ""),
    ("big5", "cp950", True, "big5-hkscs cn-big5 csbig5 x-x-big5"),
    ("GB18030", "gb18030", True, ""),
    ("gb2312", "gbk", False, "chinese cn-gb gbk gb_2312-80 csgb2312 iso-ir-58"),
    ("hz-gb-2312", "hz", True, ""),
    ("shift_jis", "cp932", True, "shift-jis sjis x-sjis ms_kanji csshiftjis x-ms-cp932"),
    ("ks_c_5601-1987", "cp949", True, "cp949 korean ks_c_5601 ks-c5601 ksc5601 ksc_5601 iso-ir-149"),
    ("IBM437", "cp437", False, "cp437 437 cspc8codepage437"),
    ("ibm850", "cp850", False, "cp850"),
    ("ibm852", "cp852", True, "cp852"),
    ("IBM855", "cp855", True, "cp855"),
    ("cp866", "cp866", True, "ibm866"),
    ("iso-8859-1", "latin-1", True, "latin1 l1 iso_8859-1 iso8859-1 cp819 ibm819 iso-ir-100"),
    ("iso-8859-2", "iso8859-2", True, "latin2 l2 iso_8859-2 iso8859-2 iso-ir-101"),
    ("iso-8859-3", "iso8859-3", True, "latin3 l3 iso_8859-3 iso-ir-109"),
    ("iso-8859-4", "iso8859-4", True, "latin4 l4 iso_8859-4 iso-ir-110"),
    ("iso-8859-5", "iso8859-5", True, "cyrillic iso_8859-5 iso-ir-144"),
    ("iso-8859-6", "iso8859-6", True, "arabic iso_8859-6 ecma-114 iso-ir-127"),
    ("iso-8859-7", "iso8859-7", True, "greek greek8 iso_8859-7 ecma-118 elot_928 iso-ir-126"),
    ("iso-8859-8", "iso8859-8", True, "hebrew iso_8859-8 visual iso-ir-138"),
    ("iso-8859-9", "iso8859-9", True, "latin5 l5 iso_8859-9 iso-ir-148"),
    ("iso-8859-13", "iso8859-13", True, ""),
    ("iso-8859-15", "iso8859-15", True, "latin9 l9 iso_8859-15"),
    ("windows-1250", "cp1250", True, "x-cp1250 cp1250"),
    ("windows-1251", "cp1251", True, "x-cp1251 cp1251"),
    ("windows-1252", "cp1252", True, "x-ansi cp1252"),
    ("windows-1253", "cp1253", True, "cp1253"),
    ("windows-1254", "cp1254", False, "cp1254"),
    ("windows-1255", "cp1255", True, "cp1255"),
    ("windows-1256", "cp1256", True, "cp1256"),
    ("windows-1257", "cp1257", True, "cp1257"),
    ("windows-1258", "cp1258", True, "cp1258"),
    ("windows-874", "cp874", True, "tis-620 iso-8859-11 dos-874"),
    ("macintosh", "mac_roman", False, ""),
    ("x-mac-ce", "mac_latin2", True, ""),
    ("x-mac-cyrillic", "mac_cyrillic", True, ""),
    ("koi8-r", "koi8-r", True, "koi koi8 koi8r cskoi8r"),
    ("koi8-u", "koi8-u", False, "koi8-ru"),
]

BOM_OF = {name: bytes.fromhex(mark) for name, mark in BOMS}
CODEC_OF = {name: codec for name, codec, _, _ in CHARSETS}
# Encoders that refuse what they cannot represent; code pages substitute "?" and fail verification.
STRICT_ENCODERS = ["us-ascii", "utf-8", "utf-16", "utf-16BE", "utf-32", "utf-32BE", "iso-8859-1"]

_BY_ALIAS = {
    alias.lower(): name
    for name, _, _, aliases in CHARSETS
    for alias in [name, *aliases.split()]
}


def resolve(name: str) -> str:
    """Canonical name of one charset given by any alias; ValueError when there is none."""
    try:
        return _BY_ALIAS[name.lower()]
    except KeyError:
        raise ValueError(f"'{name}' is not a recognized encoding") from None


def charset_alias(spark: SparkSession) -> DataFrame:
    """One row per alias: (alias, charset, codec, bom binary or NULL, listed)."""
    codecs = {name: (codec, listed) for name, codec, listed, _ in CHARSETS}
    rows = [
        (alias, name, codecs[name][0], bytearray(BOM_OF[name]) if name in BOM_OF else None, codecs[name][1])
        for alias, name in sorted(_BY_ALIAS.items())
    ]
    return spark.createDataFrame(
        rows, "alias string, charset string, codec string, bom binary, listed boolean"
    )


def supported_labels(spark: SparkSession) -> DataFrame:
    """Labels a user may pick: every listed charset, plus a -bom variant where a mark exists."""
    t = charset_alias(spark).filter("listed").select("charset", "bom").distinct()
    variants = F.when(
        F.col("bom").isNotNull(), F.array(F.lit(""), F.lit("-bom"))
    ).otherwise(F.array(F.lit("")))
    return t.select(
        F.explode(variants).alias("suffix"), "charset"
    ).select(F.concat("charset", "suffix").alias("label"), "charset", (F.col("suffix") != "").alias("has_bom"))


def resolve_charsets(df: DataFrame, name_col: str, prefix: str = "") -> DataFrame:
    """Left join of a name column with the alias table; unknown names get NULL columns."""
    a = charset_alias(df.sparkSession).select(
        F.col("alias").alias("_alias"),
        F.col("charset").alias(prefix + "charset"),
        F.col("codec").alias(prefix + "codec"),
        F.col("bom").alias(prefix + "bom"),
    )
    joined = df.join(F.broadcast(a), F.lower(F.col(name_col)) == F.col("_alias"), "left")
    return joined.drop("_alias")


def canonical(name: Column) -> Column:
    """Canonical charset of a name column as an expression (NULL when unknown)."""
    table = F.create_map(*[F.lit(x) for pair in sorted(_BY_ALIAS.items()) for x in pair])
    return table[F.lower(name)]
