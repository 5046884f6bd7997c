"""Ranking legacy code pages for samples that no Unicode rule claims.

The ranking is our own and approximate: a weighted mean over the non-ASCII characters each strict
decoding yields (expected script, usual letters, case), lowered when runs of high bytes do not fit
the script. Acceptance of the winner - strict decode plus the text test - is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.arrow import _decode, _rows, give_back
from ..functions.constants import TEXT_MIN_FRACTION, TEXT_SCALARS

# Usual non-ASCII letters per script, most frequent first where it matters.
WESTERN = "éèàêçâîôûùëïœæöäüßáíóúñåøãõìò"
CENTRAL = "áčďéěíňóřšťúůýžąćęłńśźżőűăâîșțşţöüäßđ"
SOUTHERN = "ċġħżàèìòùĉĝĥĵŝŭ"
BALTIC = "āčēģīķļņōŗšūžąęėįųäöüõ"
TURKISH = "çğıöşüâîİ"
VIETNAMESE = "ăâđêôơưàáãéèíìóòõúùýạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
CYRILLIC = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъіїєґ"
GREEK = "αοιετσνηυρπκμλςωδγχθφβξζψάέήίόύώ"
ARABIC = "اليمونرتبةعدسفهكقأحجشطصخإىضذزثءغئظآؤ"
HEBREW = "יוהלארתבשמנכדםחפקעטגזסץןצךף"
THAI = "านรอกเงมยลวดทสต่้ปบคหแจพชขใไโผถซณศฐญธภษ็ัิีึืุูะำเ"

# Single-byte candidates in priority order: charset, usual letters, block of the script.
LATIN = (0x00C0, 0x024F)
SINGLE_BYTE = [
    ("windows-1252", WESTERN, LATIN), ("iso-8859-1", WESTERN, LATIN), ("iso-8859-15", WESTERN, LATIN),
    ("windows-1250", CENTRAL, LATIN), ("iso-8859-2", CENTRAL, LATIN), ("ibm852", CENTRAL, LATIN),
    ("x-mac-ce", CENTRAL, LATIN),
    ("windows-1251", CYRILLIC, (0x0400, 0x04FF)), ("koi8-r", CYRILLIC, (0x0400, 0x04FF)),
    ("iso-8859-5", CYRILLIC, (0x0400, 0x04FF)), ("cp866", CYRILLIC, (0x0400, 0x04FF)),
    ("x-mac-cyrillic", CYRILLIC, (0x0400, 0x04FF)), ("IBM855", CYRILLIC, (0x0400, 0x04FF)),
    ("windows-1253", GREEK, (0x0370, 0x03FF)), ("iso-8859-7", GREEK, (0x0370, 0x03FF)),
    ("iso-8859-9", TURKISH, LATIN), ("iso-8859-3", SOUTHERN, LATIN),
    ("windows-1257", BALTIC, LATIN), ("iso-8859-13", BALTIC, LATIN), ("iso-8859-4", BALTIC, LATIN),
    ("windows-1255", HEBREW, (0x0590, 0x05FF)), ("iso-8859-8", HEBREW, (0x0590, 0x05FF)),
    ("windows-1256", ARABIC, (0x0600, 0x06FF)), ("iso-8859-6", ARABIC, (0x0600, 0x06FF)),
    ("windows-874", THAI, (0x0E00, 0x0E7F)), ("windows-1258", VIETNAMESE, LATIN),
]
# Multi-byte candidates in priority order: charset, usual lead bytes, weights of
# kana, hangul, usual ideographs and other ideographs.
MULTI_BYTE = [
    ("shift_jis", (0x88, 0x97), (1.0, -0.5, 0.9, 0.2)),
    ("euc-jp", (0xB0, 0xCF), (1.0, -0.5, 0.9, 0.2)),
    ("GB18030", (0xB0, 0xD7), (-0.2, -0.5, 0.95, 0.1)),
    ("big5", (0xA4, 0xC6), (-0.2, -0.5, 0.95, 0.1)),
    ("euc-kr", (0xB0, 0xC8), (-0.2, 1.0, 0.2, 0.2)),
    ("ks_c_5601-1987", (0xB0, 0xC8), (-0.2, 1.0, 0.2, 0.2)),
]
# What other Latin pages must be better by than the Western ones.
PRIOR = 0.12
CANDIDATES = [c for c, _, _ in SINGLE_BYTE] + [c for c, _, _ in MULTI_BYTE]

_RANKED_ARROW = pa.list_(pa.struct([
    ("charset", pa.string()), ("priority", pa.int32()), ("score", pa.float64()),
    ("head_scalars", pa.int32()), ("head_controls", pa.int32()), ("head_private", pa.bool_()),
]))
RANKED = from_arrow_type(_RANKED_ARROW)


def _weight(ch: str, usual: str, block: tuple[int, int]) -> float:
    if ch.isalpha() or block[0] <= ord(ch) <= block[1]:
        rank = usual.find(ch.lower()) / len(usual)
        if rank >= 0:
            upper = 0 if ch in usual else 0.25 if block == LATIN else 0.45
            # frequency tells scripts apart, not Latin languages; the short Hebrew alphabet is all common
            decay = 0.0 if block == LATIN else 0.1 if usual == HEBREW else 0.4
            return 1.0 - decay * rank - upper
        return 0.3 if block[0] <= ord(ch) <= block[1] else -0.5
    if ord(ch) < 0xA0:
        return -1.0
    return 0.3 if ch in " «»„“”‘’–—…°§·¿¡€" else -0.3


def _single_byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per charset and byte: weight, undefined, control, private use."""
    shape = (256, len(SINGLE_BYTE))
    weight, undefined = np.zeros(shape), np.zeros(shape, bool)
    control, private = np.zeros(shape, bool), np.zeros(shape, bool)
    for c, (charset, usual, block) in enumerate(SINGLE_BYTE):
        for b in range(256):
            try:
                ch = _decode(bytes([b]), charset, True)
            except UnicodeError:
                undefined[b, c] = True
                continue
            control[b, c] = (ord(ch) < 0x20 and ch not in "\r\n\t") or 0x7F <= ord(ch) <= 0x9F
            private[b, c] = 0xE000 <= ord(ch) <= 0xF8FF
            if b >= 0x80:
                weight[b, c] = _weight(ch, usual, block)
    return weight, undefined, control, private


def _usual_ideographs(charset: str, leads: tuple[int, int]) -> np.ndarray:
    usual = np.zeros(0x110000, bool)
    for lead in range(leads[0], leads[1] + 1):
        for trail in range(0x40, 0xFF):
            try:
                text = _decode(bytes([lead, trail]), charset, True)
            except UnicodeError:
                continue
            if len(text) == 1 and (charset != "GB18030" or trail >= 0xA1):
                usual[ord(text)] = True
    return usual


def _multi_byte_row(data: bytes, k: int, known: dict[int, np.ndarray]) -> dict | None:
    charset, _, (kana, hangul, common, rare) = MULTI_BYTE[k]
    try:
        text = _decode(data, charset, False)
    except UnicodeError:
        return None
    if k not in known:
        known[k] = _usual_ideographs(charset, MULTI_BYTE[k][1])
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    head = cp[:TEXT_SCALARS]
    high = cp[cp >= 0x80]
    ideograph = (high >= 0x4E00) & (high <= 0x9FFF)
    w = np.full(len(high), -0.5)
    w[ideograph] = rare
    w[ideograph & known[k][high]] = common
    w[(high >= 0x3041) & (high <= 0x30FE)] = kana
    w[(high >= 0xAC00) & (high <= 0xD7A3)] = hangul
    w[((high >= 0x3000) & (high <= 0x3020)) | ((high >= 0xFF01) & (high <= 0xFF5E))] = 0.8
    controls = ((head < 0x20) & ~np.isin(head, [9, 10, 13])) | ((head >= 0x7F) & (head <= 0x9F))
    private = ((head >= 0xE000) & (head <= 0xF8FF)) | (head >= 0xF0000)
    return {
        "charset": charset, "priority": len(SINGLE_BYTE) + k,
        "score": float(w.mean()) if len(w) else -1.0,
        "head_scalars": len(head), "head_controls": int(controls.sum()), "head_private": bool(private.any()),
    }


def _rank(v: np.ndarray, tables: tuple, known: dict[int, np.ndarray]) -> list[dict]:
    weight, undefined, control, private = tables
    high = v >= 0x80
    n_high = int(high.sum())
    if n_high == 0:
        return []  # every candidate extends ASCII, and ASCII already failed the text test
    hist = np.bincount(v, minlength=256)
    head = np.bincount(v[:TEXT_SCALARS], minlength=256)
    inner = int((high[1:] & high[:-1]).sum()) / n_high
    score, invalid = hist @ weight / n_high, hist @ undefined
    controls, privates = head @ control, head @ private
    out = []
    for c, (charset, usual, block) in enumerate(SINGLE_BYTE):
        if invalid[c]:
            continue
        # runs of high bytes speak for other scripts, unless there is nothing but high bytes
        misfit = 0.0 if n_high == len(v) else inner if block == LATIN else 1 - inner
        out.append({
            "charset": charset, "priority": c, "score": float(score[c] - 0.6 * misfit - PRIOR * (block == LATIN and usual != WESTERN)),
            "head_scalars": min(len(v), TEXT_SCALARS), "head_controls": int(controls[c]),
            "head_private": bool(privates[c]),
        })
    data = v.tobytes()
    out += [r for k in range(len(MULTI_BYTE)) if (r := _multi_byte_row(data, k, known))]
    return out


@arrow_udf(RANKED)
def rank_legacy(samples: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Score of every legacy charset in which the whole sample decodes."""
    tables, known = None, {}
    for batch in samples:
        if tables is None and batch.null_count < len(batch):
            tables = _single_byte_tables()
        yield pa.array(
            [None if v is None else _rank(v, tables, known) for v in _rows(batch)], type=_RANKED_ARROW
        )
        give_back()


def best_legacy(ranked: Column) -> Column:
    """Winner of a ranked list: highest score, then lowest priority number; NULL for an empty list."""
    keyed = F.transform(ranked, lambda r: F.struct(
        F.round(r["score"], 9).alias("score"), (-r["priority"]).alias("order"), r["charset"].alias("charset"),
        r["head_scalars"].alias("head_scalars"), r["head_controls"].alias("head_controls"),
        r["head_private"].alias("head_private"),
    ))
    return F.array_max(keyed)


def passes_text_test(best: Column) -> Column:
    """The text test on the counts a ranked row carries."""
    n = best["head_scalars"]
    return F.coalesce(
        (n > 0) & ~best["head_private"] & ((n - best["head_controls"]) / n >= TEXT_MIN_FRACTION), F.lit(False)
    )


def candidate_trials(df: DataFrame, sample: Column, keys: list[str], rank=rank_legacy) -> DataFrame:
    """Relation of samples and the legacy charsets they decode in: (keys, charset, priority, score, accepted).

    ``rank`` is the column function that scores: the letter lists, or ``code_pages.CodePageModel.ranker()``. Scores are computed where the sample lies and only then unfolded, so no sample is copied per candidate.
    """
    ranked = df.select(*keys, rank(sample).alias("ranked"))
    flat = ranked.select(*keys, F.explode("ranked").alias("r"))
    return flat.select(
        *keys, "r.charset", "r.priority", F.round("r.score", 6).alias("score"),
        passes_text_test(F.col("r")).alias("accepted"),
    )


def pick_from_trials(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Best candidate per key out of stored trials; at most a few dozen rows share a key."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("priority"))
    first = trials.withColumn("_position", F.row_number().over(w)).filter("_position = 1")
    return first.filter("accepted").drop("_position", "accepted")
