"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import functools
import itertools

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane.llm import common

UNDETERMINED = "und"
#: Bytes of text in a language's dictionary, and the documents sampled for it.
DICT_BYTES = 32 << 10
SAMPLE_DOCS = 200
#: A sampled document is at most this long, so that a sample's size is bounded.
SAMPLE_DOC_BYTES = 16 << 10
#: Labels beyond this number raise an error: each has a dictionary in memory.
MAX_LANGUAGES = 500
CHUNK = 2048
LEVEL = 11
#: A share saved below this part of what clean documents save is too narrow. Clean
#: documents are labelled ones outside the dictionaries, at most so many; their
#: share is the quantile CLEAN_QUANTILE. Where there are none, DEFAULT_SHARE holds.
NARROW, CLEAN_QUANTILE, CLEAN_DOCS, DEFAULT_SHARE = 0.5, 0.05, 200, 0.02

_LETTER = regex.compile(r"\p{L}")
_BLANKS = {i: " " for i in range(128) if not chr(i).isalpha()}


class Model(dict):
    """Dictionaries by language, and the share a text must save to be told."""

    min_share = DEFAULT_SHARE


def letters(text: str) -> bytes:
    """Lower-case words alone, joined by blanks: ASCII digits and marks say
    nothing of a language."""
    return " ".join(text.lower().translate(_BLANKS).split()).encode()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> Model:
    """A dictionary of raw text for every label of ``lang_col``, and the least
    share of a text that is told, from drawn documents outside the dictionaries.

    Rows with a null label or without letters teach nothing. Of each language
    about ``2 * sample_docs`` distinct texts are drawn by a hash, and more of them
    in the same order until ``dict_bytes`` are there or all texts are; a text over
    ``SAMPLE_DOC_BYTES`` gives a slice. So the draw depends on neither order,
    partitions nor copies, what reaches the driver is bounded by the parameters
    and the number of languages, and every label has a dictionary. An empty table
    gives no dictionaries.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model()
    # a slice begins at a letter; a character has four bytes at most
    part = F.when(F.octet_length("text") <= SAMPLE_DOC_BYTES, F.col("text")).otherwise(F.substring(F.regexp_replace("text", r"^[^\p{L}]+", ""), 1, SAMPLE_DOC_BYTES // 4))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rates, drawn, out = {r.lang: min(1.0, 2 * sample_docs / max(r.n, 1)) for r in counts}, {}, {}
    while rates:
        rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
        got = known.where(draw < rate[F.col("lang")] * F.lit(float(1 << 40))).select("lang", draw.alias("at"), part.alias("text")).distinct().collect()
        for lang in list(rates):
            drawn[lang] = [r.text for r in sorted((r for r in got if r.lang == lang), key=lambda r: (r.at, r.text))]
            size = sum(len(letters(t)) + 1 for t in drawn[lang])
            if size > dict_bytes or rates[lang] >= 1:
                del rates[lang]
            else:
                # twice what is likely to fill it; a few texts say little of the others' length
                rates[lang] = min(1.0, rates[lang] * min(64.0, max(4.0, 2 * dict_bytes / max(size, 1))))
    clean = []
    for lang, docs in sorted(drawn.items()):
        texts = [letters(t) for t in docs]
        out[lang] = b" ".join(texts)
        ends = itertools.accumulate(len(t) + 1 for t in texts)
        clean += [(i, lang, t) for i, t in enumerate(t for t, x, end in zip(docs, texts, ends) if end - len(x) > dict_bytes)]
    model = Model((lang, text[:dict_bytes]) for lang, text in sorted(out.items()))
    model.min_share = least_share(model, [(lang, t) for _, lang, t in sorted(clean)[:CLEAN_DOCS]])
    return model


def least_share(model: dict[str, bytes], clean: list[tuple[str, str]], level: int = LEVEL) -> float:
    """``NARROW`` times the share that all but the lowest ``CLEAN_QUANTILE`` of the
    labelled texts save, of those that are told rightly."""
    frozen = tuple(sorted(model.items()))
    told = [(lang, *classify(text, frozen, level)) for lang, text in clean]
    shares = sorted(score for lang, pred, score, _ in told if lang == pred)
    return NARROW * shares[int(CLEAN_QUANTILE * len(shares))] if shares else DEFAULT_SHARE


@functools.lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for lang, text in model:
        # zstandard refuses an empty dictionary
        shared = zstandard.ZstdCompressionDict(text or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False).compress))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...], level: int = LEVEL) -> tuple[str, float, int]:
    """(language, score, margin in bytes) of a whole text.

    The text is compressed in pieces of ``CHUNK`` bytes, so that the dictionary
    weighs as much at its end as at its start. The smallest sum of sizes wins, ties
    go to the first language by name. The score is the share of the second
    smallest that the smallest saves. With one language known the margin is taken
    against the text's own size.
    """
    if not text or not model or not _LETTER.search(text):
        return UNDETERMINED, 0.0, 0
    raw = letters(text)
    sizes = sorted((sum(len(pack(raw[a : a + CHUNK])) for a in range(0, len(raw), CHUNK)), lang) for lang, pack in _compressors(model, level))
    best, lang = sizes[0]
    second = sizes[1][0] if len(sizes) > 1 else max(best, len(raw))
    return lang, min(1.0, max(0.0, 1 - best / second)) if second else 0.0, second - best


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: int = 1, level: int = LEVEL, min_share: float | None = None) -> DataFrame:
    """``id_col``, ``lang_pred`` string, ``score`` double, ``margin`` long (bytes)
    and ``rejected`` boolean of every whole text.

    A text is rejected if its score is below ``min_share`` (that of the model
    unless given) or its margin below ``min_margin`` bytes, or if it is null, empty
    or has no letters (``lang_pred`` is then ``und``, as it is with an empty model). One row per input row; null and
    repeated ids keep their rows. Other columns are not read. The model, at most
    ``MAX_LANGUAGES`` dictionaries of ``DICT_BYTES``, travels with the tasks.
    """
    schema = T.StructType([common.field(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.LongType()), T.StructField("rejected", T.BooleanType())])
    frozen = tuple(sorted(model.items()))
    share = getattr(model, "min_share", DEFAULT_SHARE) if min_share is None else min_share

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                got = [classify(t, frozen, level) for t in part.column(1).to_pylist()]
                lang, score, margin = zip(*got)
                rejected = [x == UNDETERMINED or m < min_margin or s < share for x, s, m in zip(lang, score, margin)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()), pa.array(rejected, pa.bool_())], schema.names)

    return common.spread(docs.select(id_col, text_col)).mapInArrow(run, schema)
