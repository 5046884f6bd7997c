"""Code pages by a learned model: byte-pair likelihoods per (page, language).

``count_pairs`` encodes labelled texts in every page that can hold them and counts adjacent bytes; ``code_page_model`` turns the
counts into a first-order Markov model per (page, language); its ``ranker`` replaces the fixed letter lists of ``legacy`` in
``detect(..., legacy=model)`` and ``candidate_trials(..., rank=model.ranker())``. A sample is scored in every page it strictly
decodes in by the best of the page's languages, all on the same bytes, so the scores are comparable likelihoods.

Learning reads a bounded sample: ``ROWS`` texts a language in hash order, 64 KiB of each like detection itself. The counts hold
at most 65,536 rows a model and can be stored and read again; the model is shipped as 128 KiB a (page, language), refused above
``MODELS``. Scoring is a scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.arrow import _decode, _rows, give_back
from ..functions.charsets import CODEC_OF, resolve
from ..functions.constants import SAMPLE_BYTES, TEXT_SCALARS
from .legacy import _RANKED_ARROW, CANDIDATES, RANKED

ROWS = 400     # texts learned per language
MODELS = 400   # (page, language) pairs shipped with the model: 52 MB
SHARE = 0.5    # of a language's texts a page must hold to be learned for it
UNIT = 256     # log2 likelihoods are kept in whole 256ths, so sums do not depend on their order
PRIOR = 8.0    # weight of the byte's own frequency against that after its predecessor
SALTS = 32

COUNTS = "page string, language string, pair int, n long, texts long"
_COUNTS_ARROW = pa.schema([("page", pa.string()), ("language", pa.string()), ("pair", pa.int32()), ("n", pa.int64()), ("texts", pa.int64())])


def training_texts(labelled: DataFrame, rows: int = ROWS, beyond_ascii: bool = True) -> DataFrame:
    """(text, language): per language the first ``rows`` texts in hash order, by default among those with a non-ASCII character.

    Repeated texts count once. NULL texts and languages teach nothing. Only hashes are shuffled; their rank is taken in two
    steps, first within salts, so that one language holding most rows is not one task. Texts are fetched by the chosen hashes.
    """
    useful = labelled.where("text is not null and language is not null").select("text", "language")
    if beyond_ascii:
        useful = useful.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    useful = useful.withColumn("_h", F.xxhash64("text"))
    chosen = useful.select("language", "_h").distinct().withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for keys in (["language", "_salt"], ["language"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
        chosen = chosen.withColumn("_r", rank).where(F.col("_r") <= rows).drop("_r")
    # at most ``rows`` hashes a language
    kept = useful.join(F.broadcast(chosen.drop("_salt")), ["language", "_h"])
    return kept.dropDuplicates(["language", "_h"]).select("text", "language")


def _pairs(data: np.ndarray) -> np.ndarray:
    """Adjacent bytes as one number each; a space stands before the first."""
    before = np.empty(len(data), np.int32)
    before[:1] = 0x20
    before[1:] = data[:-1]
    return before * 256 + data


def count_pairs(labelled: DataFrame, pages: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """(page, language, pair, n, texts): how often byte ``pair % 256`` follows ``pair // 256``, in how many texts.

    ``pair`` -1 carries the number of texts the page holds, ``page`` NULL the number of all texts of the language.
    """
    names = [resolve(p) for p in (pages or CANDIDATES)]

    def count(batches):
        for batch in batches:
            by_language: dict[str, list[str]] = {}
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_language.setdefault(language, []).append(text[:SAMPLE_BYTES])
            for language, texts in by_language.items():
                out = [(None, language, -1, 0, len(texts))]
                for page in names:
                    held, n = 0, np.zeros(65536, np.int64)
                    for text in texts:
                        try:
                            data = np.frombuffer(text.encode(CODEC_OF[page])[:SAMPLE_BYTES], np.uint8)
                        except UnicodeEncodeError:
                            continue
                        held += 1
                        n += np.bincount(_pairs(data), minlength=65536)
                    if held:
                        out.append((page, language, -1, 0, held))
                        pairs = np.flatnonzero(n)
                        out += [(page, language, p, c, 0) for p, c in zip(pairs.tolist(), n[pairs].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out), _COUNTS_ARROW)], schema=_COUNTS_ARROW)
        give_back()

    counted = training_texts(labelled, rows).mapInArrow(count, COUNTS)
    return counted.groupBy("page", "language", "pair").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


@dataclass(frozen=True)
class CodePageModel:
    """Log likelihoods of byte pairs: one row of ``table`` per entry of ``models``; ``pages`` in the order that settles ties."""

    pages: tuple[str, ...]
    models: tuple[tuple[str, str], ...]
    table: np.ndarray

    def rank(self, v: np.ndarray) -> list[dict]:
        """Every page the whole sample decodes in: its score (mean log2 likelihood of a byte) and head facts."""
        data = v.tobytes()
        texts = {}
        for page in self.pages:
            try:
                texts[page] = _decode(data, page, False)
            except UnicodeError:
                continue
        if not texts or not len(v):
            return []
        n = np.bincount(_pairs(v), minlength=65536)
        pairs = np.flatnonzero(n)
        total = self.table[:, pairs].astype(np.int64) @ n[pairs]
        learned, best = set(), {}
        for (page, _), value in zip(self.models, total.tolist()):
            if page in texts:
                learned.add(page)
                # pages in which the sample is the same text are told apart by their order alone
                best[texts[page]] = max(value, best.get(texts[page], value))
        out = []
        for page in (p for p in self.pages if p in learned):
            head = np.frombuffer(texts[page][:TEXT_SCALARS].encode("utf-32-le", "surrogatepass"), np.uint32)
            controls = ((head < 0x20) & ~np.isin(head, [9, 10, 13])) | ((head >= 0x7F) & (head <= 0x9F))
            private = ((head >= 0xE000) & (head <= 0xF8FF)) | (head >= 0xF0000)
            out.append({
                "charset": page, "priority": self.pages.index(page), "score": best[texts[page]] / (UNIT * len(v)), "head_scalars": len(head),
                "head_controls": int(controls.sum()), "head_private": bool(private.any()),
            })
        return out

    def ranker(self):
        """Column function from a sample to its ranked pages, as ``legacy.rank_legacy``."""
        model = self

        @arrow_udf(RANKED)
        def rank_code_pages(samples: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in samples:
                yield pa.array([None if v is None else model.rank(v) for v in _rows(batch)], type=_RANKED_ARROW)
                give_back()

        return rank_code_pages


def code_page_model(counts: DataFrame, pages: list[str] | None = None, share: float = SHARE) -> CodePageModel:
    """The model of stored counts. What comes to the driver is bounded by the number of models, not by the texts."""
    names = tuple(resolve(p) for p in (pages or CANDIDATES))
    texts = {(r.page, r.language): r.texts for r in counts.where("pair = -1").collect()}
    models = sorted(
        (m for m, n in texts.items() if m[0] in names and n >= share * texts[(None, m[1])]),
        key=lambda m: (names.index(m[0]), m[1]))
    if not models:
        raise ValueError("no labelled text with a character outside ASCII fits any of the pages")
    if len(models) > MODELS:
        raise ValueError(f"{len(models)} models of a page and a language; at most {MODELS} are shipped: give fewer pages or languages")
    listed = counts.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(models)], "model int, page string, language string")
    rows = counts.where("pair >= 0").join(F.broadcast(listed), ["page", "language"]).select("model", "pair", "n").toArrow()
    at, pair, n = (rows.column(c).to_numpy() for c in ("model", "pair", "n"))
    table = np.empty((len(models), 65536), np.int16)
    for i in range(len(models)):
        seen = np.zeros(65536)
        seen[pair[at == i]] = n[at == i]
        seen = seen.reshape(256, 256)
        after = seen.sum(0)
        own = (after + 0.5) / (after.sum() + 128)
        p = (seen + PRIOR * own) / (seen.sum(1, keepdims=True) + PRIOR)
        table[i] = np.maximum(np.round(UNIT * np.log2(p)), -32768).astype(np.int16).ravel()
    return CodePageModel(names, tuple(models), table)


def fit_code_pages(labelled: DataFrame, pages: list[str] | None = None, rows: int = ROWS) -> CodePageModel:
    """Learn from (text, language) rows in one go."""
    counts = count_pairs(labelled, pages, rows).persist()
    try:
        return code_page_model(counts, pages)
    finally:
        counts.unpersist()
