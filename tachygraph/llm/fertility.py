"""Quality rules by tokeniser fertility.

Public vocabularies are run over whole texts. Three measures come out: characters per token (of each vocabulary), the
share of byte-fallback tokens (of a piece vocabulary with byte fallback), and the entropy of the token ids in bits. A
text outside its band is rejected. Bands are of two sorts: wide ones by script, given as parameters, and narrow ones by
language (without one, by script), learned from all texts: the median of the characters per token, and the spread of
what a text is off it times the root of its tokens. A text is outside its narrow band if with both vocabularies it is off on
the same side by more than WIDTH spreads and by more than a share LEAST_OFF of the median. A band learned from n texts is wider
by the factor 1 + PRIOR_TEXTS / n, so that few texts of a language reject next to nothing. The base rule rejects very short texts and texts that mostly repeat themselves.

Nulls: a null text counts as empty (no words, base_failed). A null or unknown ``lang`` falls back to the script's band.
Texts without tokens have null measures. Repeated rows each get their own equal row; an empty table gives an empty one.
Columns beyond those read are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.llm import shingles
from tachygraph.llm.scratch import small, table

#: Where the vocabulary files lie; the driver reads them and ships their bytes with the tasks.
VOCABULARY_DIR = "/opt/tokenizers"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Fixed value: the split pattern published with the byte-level vocabulary.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed values of the base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"


#: Narrow bands: their width, the share of the median that counts at all, and the texts at which they are twice as wide as with very many.
WIDTH = 6.0
LEAST_OFF = 0.05
PRIOR_TEXTS = 100


@dataclass(frozen=True)
class Band:
    """Ordinary values; entropy is held against the least share of the entropy that so many tokens could have."""

    min_chars: float
    max_chars: float
    max_fallback: float
    min_entropy_share: float


#: Wide bands: text of a known script that splits as text does. Scripts the vocabularies hardly know get bands of their own.
BANDS = {
    "latin": Band(1.2, 8.0, 0.35, 0.45),
    "greek": Band(0.35, 3.0, 0.60, 0.40),
    "cyrillic": Band(0.35, 6.0, 0.60, 0.40),
    "semitic": Band(0.30, 3.0, 0.95, 0.35),
    "indic": Band(0.15, 3.0, 1.00, 0.25),
    "cjk": Band(0.25, 3.0, 0.95, 0.35),
    "hangul": Band(0.25, 3.0, 1.00, 0.30),
    "other": Band(0.15, 8.0, 1.00, 0.25),
}
#: First UTF-8 bytes of a script's letters.
_LEADS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)], "greek": [(0xCE, 0xCF)], "cyrillic": [(0xD0, 0xD3)], "semitic": [(0xD6, 0xDB)], "indic": [(0xE0, 0xE0)],
    "cjk": [(0xE3, 0xE9)], "hangul": [(0xEA, 0xED)],
}
#: Bands by language code, for languages whose band is not their script's.
LANGUAGE_BANDS: dict[str, Band] = {"en": Band(1.3, 8.0, 0.25, 0.45)}

_loaded: dict[int, tuple] = {}


def vocabularies(folder: str = VOCABULARY_DIR) -> tuple[bytes, bytes]:
    """The bytes of the byte-level and of the piece vocabulary; read on the driver."""
    out = []
    for name in (BYTE_VOCABULARY, PIECE_VOCABULARY):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def _load(files: tuple[bytes, bytes]) -> tuple:
    import base64

    import sentencepiece
    import tiktoken

    key = hash(files)
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in files[0].splitlines() if x)}
        pieces = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        _loaded[key] = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}), pieces, is_byte
    return _loaded[key]


def script_of(counts: np.ndarray) -> str:
    """The script with most letters, by a text's counts of byte values."""
    letters = {k: sum(int(counts[a : b + 1].sum()) for a, b in v) for k, v in _LEADS.items()}
    best = max(letters, key=letters.get)
    return best if letters[best] else "other"


def entropy(ids: np.ndarray) -> float:
    """Shannon entropy of the ids' frequencies, in bits."""
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def in_band(band: Band, n_tokens: int, chars: float, chars_pieces: float, fallback: float, bits: float) -> bool:
    """Both vocabularies' characters per token, the fallback share and the entropy are ordinary."""
    ordinary = band.min_chars <= chars <= band.max_chars and band.min_chars <= chars_pieces <= band.max_chars * 1.25
    return ordinary and fallback <= band.max_fallback and bits >= band.min_entropy_share * np.log2(min(max(n_tokens, 2), 256))


def base_counts(text: str, hashes: np.ndarray) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, given its word hashes."""
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
    rows = shingles.windows(hashes)
    if not len(rows):
        return dup, 0
    _, inverse, counts = np.unique(rows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return dup, 0
    inside = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(inside, again, 1)
    np.add.at(inside, again + shingles.WORDS, -1)
    return dup, int((np.cumsum(inside[:-1]) > 0).sum())


_FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(),
    "kept": pa.bool_(), "script": pa.string(), "n_tokens": pa.int64(), "n_pieces": pa.int64(), "chars_per_token": pa.float64(), "chars_per_piece": pa.float64(),
    "fallback_share": pa.float64(), "token_entropy": pa.float64(),
}
_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
MEASURES = tuple(_FIELDS)


def measure_batch(batch: pa.RecordBatch, files: tuple[bytes, bytes], bands: dict[str, Band], languages: dict[str, Band]) -> dict[str, list]:
    """All measures of the texts in ``batch`` (columns text and lang)."""
    encoder, pieces, is_byte = _load(files)
    column, langs = batch.column("text"), batch.column("lang").to_pylist()
    out: dict[str, list] = {k: [] for k in _FIELDS}
    for at, data, bounds in shingles.text_bytes(column):
        hashes, first = shingles.word_hashes(data, bounds, lower=False)
        texts = [x or "" for x in column.slice(at, len(bounds) - 1).to_pylist()]
        piece_ids = pieces.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            own = data[bounds[i] : bounds[i + 1]]
            counts = np.bincount(own, minlength=256)
            spaces = int(counts[32] + counts[9:14].sum())
            n_chars = len(own) - int(counts[0x80:0xC0].sum())
            n_words = int(first[i + 1] - first[i])
            dup, repeated = base_counts(text, hashes[first[i] : first[i + 1]])
            failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words
            script, ids, ids2 = script_of(counts), encoder.encode_to_numpy(text, disallowed_special=()), np.array(piece_ids[i], np.int64)
            chars = chars2 = fallback = bits = None
            good = False
            if len(ids) and len(ids2):
                chars, chars2, fallback, bits = n_chars / len(ids), n_chars / len(ids2), float(is_byte[ids2].mean()), entropy(ids)
                good = in_band(languages.get(langs[at + i]) or bands.get(script, bands["other"]), len(ids), chars, chars2, fallback, bits)
            row = (n_words, n_chars - spaces, int(counts[list(SYMBOLS)].sum()), dup, repeated, failed, good and not failed, script, len(ids), len(ids2), chars, chars2, fallback, bits)
            for k, v in zip(_FIELDS, row, strict=True):
                out[k].append(v)
    return out


def measured(docs: DataFrame, keep: list[str], folder: str = VOCABULARY_DIR, bands: dict[str, Band] | None = None, languages: dict[str, Band] | None = None) -> DataFrame:
    """``keep``'s columns of ``docs`` with MEASURES; one row for each row of ``docs``, in one pass without a shuffle.

    A measure with the name of a kept column has m_ before it. ``kept`` is the verdict of the base rule and the wide bands.
    """
    files, bands, languages = vocabularies(folder), bands or BANDS, LANGUAGE_BANDS if languages is None else languages
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept_row"), F.col("text"), lang.alias("lang"))
    schema = f"kept_row {rows.schema['kept_row'].dataType.simpleString()}, " + ", ".join(f"{k} {_TYPES[v]}" for k, v in _FIELDS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure_batch(batch, files, bands, languages)
            yield pa.RecordBatch.from_arrays([batch.column("kept_row"), *(pa.array(got[k], t) for k, t in _FIELDS.items())], ["kept_row", *_FIELDS])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("kept_row")[c].alias(c) for c in keep], *[F.col(k).alias(f"m_{k}" if k in keep else k) for k in _FIELDS])


def _quantiles(values: DataFrame, step: float, shares: dict[str, float]) -> DataFrame:
    """(key, n, name...): quantiles of ``x`` for each key by counts of bins ``step`` wide, so that equal rows give equal results."""
    bins = values.filter("x is not null").groupBy("key", F.floor(F.col("x") / step).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("bin"))
    whole = F.sum("n").over(Window.partitionBy("key"))
    bins = bins.withColumn("upto", upto).withColumn("whole", whole)
    picked = [((F.min(F.when(F.col("upto") >= share * F.col("whole"), F.col("bin"))) + 0.5) * step).alias(name) for name, share in shares.items()]
    return bins.groupBy("key").agg(F.first("whole").alias("n"), *picked)


_VOCABULARIES = (("chars_per_token", "n_tokens"), ("chars_per_piece", "n_pieces"))


def language_bands(rows: DataFrame) -> DataFrame:
    """(key, centre0, spread0, centre1, spread1) of each language: rows have key, base_failed and the measures."""
    good = rows.filter("not base_failed")
    out = None
    for k, (chars, n) in enumerate(_VOCABULARIES):
        values = good.select("key", F.col(chars).alias("x"), F.col(n).alias("tokens"))
        centre = table(_quantiles(values, 0.01, {f"centre{k}": 0.5}).drop("n"), "centres")
        off = values.join(small(centre), "key").select("key", ((F.col("x") - F.col(f"centre{k}")) * F.sqrt("tokens")).alias("x"))
        spread = _quantiles(off, 0.05, {"low": 0.25, "high": 0.75}).select(
            "key", (F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(0.05)) * (1 + PRIOR_TEXTS / F.col("n"))).alias(f"spread{k}"),
        )
        both = centre.join(spread, "key")
        out = both if out is None else out.join(both, "key")
    return out


def judged(docs: DataFrame, keep: list[str], folder: str = VOCABULARY_DIR) -> DataFrame:
    """``measured`` with the verdict of all bands in ``kept``: the measures are written once, the narrow bands learned from all of them."""
    renamed = {c: f"m_{c}" if c in keep else c for c in MEASURES}
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select(F.struct(*keep).alias("doc"), "text", lang.alias("lang"))
    rows = table(measured(whole, ["doc", "lang"], folder), "fertility").withColumn("key", F.coalesce("lang", "script"))
    bands = table(language_bands(rows), "bands")
    off = []
    for k, (chars, n) in enumerate(_VOCABULARIES):
        d = F.col(chars) - F.col(f"centre{k}")
        off.append(F.when((F.abs(d) > LEAST_OFF * F.col(f"centre{k}")) & (F.abs(d) * F.sqrt(n) > WIDTH * F.col(f"spread{k}")), F.signum(d)).otherwise(0))
    outside = F.coalesce((off[0] == off[1]) & (off[0] != 0), F.lit(False))
    got = rows.join(small(bands), "key", "left").withColumn("kept", F.col("kept") & ~outside)
    return got.select(*[F.col("doc")[c].alias(c) for c in keep], *[F.col(c).alias(renamed[c]) for c in MEASURES])


def quality_filter(docs: DataFrame, folder: str = VOCABULARY_DIR) -> DataFrame:
    """The rows of ``docs`` that the base rule and the bands keep, with the same columns."""
    got = judged(docs, docs.columns, folder)
    return got.filter(F.col("m_kept" if "kept" in docs.columns else "kept")).select(*docs.columns)
