"""Quality rules by tokeniser fertility.

Public vocabularies measure each document. A sentence-piece one gives characters per token, the share of byte-fallback
tokens and token entropy; a byte-level one, if named, its own characters per token and entropy. Bands per language (or
per script, where no language is given) say which values are acceptable; a document is rejected if a measure lies
outside its band by every vocabulary that has it, so what is odd to one vocabulary alone stays. A language's band is
fitted on the measures of all its documents in the table that pass the base rule, and backs off to a fixed band the fewer
these are; fitted bands can be saved, and given as a parameter. Base counts (words, symbols, repeated lines and word windows) come from the same pass.

One narrow pass over the texts without any shuffle: a row is measured by itself, so skew does not matter, and a lost
executor only repeats its own rows. Memory is bounded by one Arrow batch and memos of bounded bytes. To fit the bands,
the measured rows are written once and their rounded measures counted by language, which bounds that aggregate by the
number of different rounded values, not by documents.

Defined results: null or empty text has no words, no tokens and fails the base rule; very long texts are measured
whole; repeated rows and ties are judged alike; an empty table gives an empty result; a null or unknown language takes
the band of the text's script; extra columns pass through, and the added column avoids their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm import textkit as K
from quirefold.llm.chunks import CHUNK_PATTERNS, ENTRY_BYTES, LONG_CHUNK, MEMO_BYTES, Memo, RankEncoder
from quirefold.llm.store import keyed, materialize, prepare, settle, unused

#: Largest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


@dataclass(frozen=True)
class Band:
    """Acceptable values. Entropy is in bits, as a share of the most that so many tokens can have."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy_share: float
    min_bpe_chars_per_token: float = 0.2
    max_bpe_chars_per_token: float = 8.0
    min_bpe_entropy_share: float = 0.3


#: Bands by language, and by script for other languages, where no band can be fitted. Parameters, chosen wide enough to
#: keep running prose.
LANGUAGE_BANDS = {
    "en": Band(1.5, 6.5, 0.02, 0.47),
    "de": Band(1.4, 6.5, 0.02, 0.47),
    "fr": Band(1.4, 6.5, 0.02, 0.47),
    "es": Band(1.4, 6.5, 0.02, 0.47),
}
SCRIPT_BANDS = {
    "latin": Band(1.4, 7.0, 0.05, 0.40),
    "cyrillic": Band(1.0, 7.0, 0.05, 0.40),
    "cjk": Band(0.4, 4.0, 0.60, 0.40),
    "other": Band(0.3, 7.0, 0.90, 0.30),
}

#: A fitted band's limits are means of what its documents say and of the fixed band, which counts as so many documents.
PRIOR_DOCUMENTS = 4
#: Limits of a fitted band lie so many interquartile ranges outside the quartiles. A parameter: quartiles hardly move
#: with the junk, as long as it is well below a quarter of a language's documents.
FENCE = 2.0
#: Least interquartile range, as a share of the median: tables of nearly equal texts do not reject each other.
MIN_SPREAD = 0.01
#: Decimals of the measures that quartiles are taken of.
FIT_DECIMALS = 3

MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "bpe_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "entropy", "entropy_share", "bpe_chars_per_token", "bpe_entropy", "bpe_entropy_share")]
    + [T.StructField("script", T.StringType())]
)

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Weight of a lead byte for each script: letters of ASCII and Latin supplements, Cyrillic, CJK with kana and Hangul.
_SCRIPTS = ("latin", "cyrillic", "cjk", "other")
_SCRIPT_OF = np.full(256, 255, dtype=np.uint8)
for _spans, _script in ((((65, 91), (97, 123), (0xC3, 0xCA)), 0), (((0xD0, 0xD4),), 1), (((0xE3, 0xEE),), 2), (((0xCA, 0xD0), (0xD4, 0xE2), (0xEE, 0xF5)), 3)):
    for _a, _b in _spans:
        _SCRIPT_OF[_a:_b] = _script


def _entropy(ids: np.ndarray, pieces: int) -> tuple[float, float]:
    """The entropy of the pieces in bits, and its share of the most that so many tokens can have."""
    n = len(ids)
    if n < 4000:
        ordered = np.sort(ids)
        used = np.diff(np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [n]]))
    else:
        used = np.bincount(ids)
        used = used[used > 0]
    entropy = float(np.log2(n) - (used * np.log2(used)).sum() / n)
    most = float(np.log2(min(n, pieces))) if n > 1 else 0.0
    return max(entropy, 0.0), (entropy / most if most else 1.0)


class FertilityMeter:
    """Token statistics of texts under a sentence-piece model with byte fallback, and under a byte-level vocabulary."""

    def __init__(self, model: bytes, ranks: bytes | None = None, pattern: str | None = None) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.pieces.get_piece_size()
        white = {self.pieces.piece_to_id(f"<0x{b:02X}>") for b in (9, 10, 11, 12, 13)}
        self.fallback = np.array([self.pieces.is_byte(i) and i not in white for i in range(n)])
        self.first, self.second = Memo(MEMO_BYTES // 2), Memo(MEMO_BYTES // 2)
        self.ranks = None
        if ranks is not None:
            self.ranks = RankEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}, pattern)
            self.by_chunk = pattern in CHUNK_PATTERNS

    def _learn(self, split: list[list[str]]) -> None:
        """Encode the short chunks of some texts that are not known yet, by both vocabularies at once."""
        new = set().union(*split).difference(self.first)
        size = sum(map(len, new))
        if ENTRY_BYTES * len(new) > MEMO_BYTES // 2:
            return  # too many to be remembered: such texts are encoded as a whole
        self.first.room_for(len(new), size)
        self.second.room_for(len(new), size)
        if not (self.first and self.second):  # forgotten: what these texts need is needed again
            self.first.clear()
            self.second.clear()
            new = set().union(*split)
        chunks = [c for c in new if c and len(c) <= LONG_CHUNK]
        self.first.update(zip(chunks, (array("H", x).tobytes() for x in self.pieces.encode(chunks, num_threads=1)), strict=True))
        if self.ranks is not None and self.by_chunk:
            plain = [c for c in chunks if not c[0].isspace()]
            self.second.update(zip(plain, self.ranks.many(plain), strict=True))

    def _pieces_of(self, text: str, chunks: list[str]) -> np.ndarray:
        """No piece holds a blank after another character, so chunks between single blanks are encoded one by one."""
        if not text:
            return np.zeros(0, dtype="<u2")
        try:
            return np.frombuffer(b"".join(map(self.first.__getitem__, chunks)), dtype="<u2")
        except KeyError:  # an empty chunk, or a long one
            return np.asarray(self.pieces.encode(text), dtype="<u2")

    def _ranks_of(self, text: str, chunks: list[str]) -> np.ndarray:
        """After a leading blank the first chunk is empty: the blank belongs to the next."""
        try:
            rest = [*map(self.second.__getitem__, chunks[1:])]
        except KeyError:
            return np.frombuffer(self.ranks.whole(text), dtype="<u4")
        return np.frombuffer(b"".join([self.ranks.whole(chunks[0]) if chunks[0] else b"", *rest]), dtype="<u4")

    def measure(self, texts: list[str]) -> dict[str, list]:
        """Columns of MEASURES that need a tokeniser; without tokens, or without a second vocabulary, they are null."""
        out: dict[str, list] = {n: [] for n in ("n_tokens", "chars_per_token", "byte_share", "entropy", "entropy_share", "bpe_tokens", "bpe_chars_per_token", "bpe_entropy", "bpe_entropy_share")}

        def add(*values) -> None:
            for name, value in zip(out, values, strict=True):
                out[name].append(value)

        split = [t.split(" ") for t in texts]
        self._learn(split)
        for text, chunks in zip(texts, split, strict=True):
            ids = self._pieces_of(text, chunks)
            first, second = (0, None, None, None, None), (None, None, None, None) if self.ranks is None else (0, None, None, None)
            if len(ids):
                first = len(ids), len(text) / len(ids), float(np.count_nonzero(self.fallback[ids]) / len(ids)), *_entropy(ids, len(self.fallback))
            if self.ranks is not None and text:
                own = self._ranks_of(text, chunks)
                second = len(own), len(text) / len(own), *_entropy(own, self.ranks.size)
            add(*first, *second)
        return out


def base_counts(w: K.Words) -> dict[str, np.ndarray]:
    """Counts per document that need no tokeniser."""
    raw, off = w.raw, w.offsets
    n_docs = len(off) - 1
    doc_of = w.doc_of()
    lead = (raw & 0xC0) != 0x80
    grams, fits = w.ngrams(3)
    where = np.flatnonzero(fits)
    with np.errstate(over="ignore"):
        keys = K.mix(grams[where] + doc_of[where].astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(w), dtype=bool)
    for j in range(3):
        covered[where[again] + j] = True
    dup = np.zeros(n_docs, dtype=np.int64)
    blob = raw.tobytes()
    for d in range(n_docs):
        seen: set[bytes] = set()
        lines = blob[off[d] : off[d + 1]].split(b"\n")
        if len(lines) > 1:
            for line in lines:
                if line in seen:
                    dup[d] += 1
                elif line.strip():
                    seen.add(line)
    script = np.stack([K.sums_by_doc(_SCRIPT_OF[raw] == s, off) for s in range(len(_SCRIPTS))])
    return {
        "n_words": w.counts().astype(np.int64),
        "word_chars": K.sums_by_doc(lead & K._IS_WORD[raw], off),
        "n_symbols": K.sums_by_doc(_SYMBOLS[raw], off),
        "n_dup_lines": dup,
        "n_repeat_words": K.sums_by_doc(covered, w.doc),
        "script": np.where(script.sum(0) > 0, np.array(_SCRIPTS)[script.argmax(0)], "other"),
    }


_meters: dict[str, FertilityMeter] = {}


def _measure_batches(model, digest: str, ranks, pattern: str | None, column: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{digest} {ranks and ranks[1]} {pattern}"
        if key not in _meters:  # workers are reused: the memos then are, too
            _meters.clear()
            _meters[key] = FertilityMeter(model.value, ranks and ranks[0].value, pattern)
        meter = _meters[key]
        kind = pa.struct([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in MEASURES])
        for batch in batches:
            text = batch.column(column)
            parts: dict[str, list] = {f.name: [] for f in MEASURES}
            for a, b, w in K.per_slice(text):
                for name, values in base_counts(w).items():
                    parts[name].extend(values.tolist())
                for name, values in meter.measure([t or "" for t in text.slice(a, b - a).to_pylist()]).items():
                    parts[name].extend(values)
            struct = pa.StructArray.from_arrays([pa.array(parts[f.name], type=f.type) for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, into])

    return run


def broadcast_file(spark, path: str):
    """A file's bytes as a broadcast variable, after a check of its size, and their digest."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def measure(df: DataFrame, model_path: str, text: str = "text", into: str = "measures", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with a struct of MEASURES; `into` gets leading underscores until no column of df has that name. ranks_path and
    pattern: the byte-level vocabulary and its pre-token pattern."""
    spark = prepare(df.sparkSession)
    into = unused(df, into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, MEASURES)])
    ranks = broadcast_file(spark, ranks_path) if ranks_path else None
    return df.mapInArrow(_measure_batches(*broadcast_file(spark, model_path), ranks, pattern, text, into), schema)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def in_band(m: Column, lang: Column | None = None, languages: dict[str, Band] = LANGUAGE_BANDS, scripts: dict[str, Band] = SCRIPT_BANDS) -> Column:
    """Whether the measures lie in the band of the language, else of the script: characters per token and entropy by one
    vocabulary at least, the share of byte-fallback tokens by the one that has them."""

    def fits(b: Band) -> Column:
        by_second = lambda c: F.coalesce(c, F.lit(False))  # null: that vocabulary was not used
        length = m["chars_per_token"].between(b.min_chars_per_token, b.max_chars_per_token) | by_second(m["bpe_chars_per_token"].between(b.min_bpe_chars_per_token, b.max_bpe_chars_per_token))
        entropy = (m["entropy_share"] >= b.min_entropy_share) | by_second(m["bpe_entropy_share"] >= b.min_bpe_entropy_share)
        return length & (m["byte_share"] <= b.max_byte_share) & entropy

    cases = [(lang == name, fits(band)) for name, band in languages.items()] if lang is not None else []
    cases += [(m["script"] == name, fits(band)) for name, band in scripts.items() if name != "other"]
    verdict = F
    for case in cases:
        verdict = verdict.when(*case)
    verdict = verdict.otherwise(fits(scripts["other"])) if cases else fits(scripts["other"])
    return F.coalesce(verdict, F.lit(False))


def fit_bands(measured: DataFrame, into: str, lang: str | None = None) -> dict[str, dict[str, Band]]:
    """`languages` and `scripts` for in_band, fitted on the rows that pass the base rule: rows with a language by
    language, the others by script. There is no least number of rows: a limit is the mean of the rows' limit, weighed by
    their number, and the fixed one, weighed by PRIOR_DOCUMENTS."""
    m = F.col(into)
    of = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    good = measured.filter(~base_failed(m)).select(of.alias("_l"), F.when(of.isNull(), m["script"]).alias("_s"), m.alias("_m"))
    has = measured.schema[into].dataType.names
    names = [n for n in ("chars_per_token", "byte_share", "entropy_share", "bpe_chars_per_token", "bpe_entropy_share") if n in has]
    quartiles = [F.percentile(F.round(F.col("_m")[n], FIT_DECIMALS), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n in names]
    languages, scripts = dict(LANGUAGE_BANDS), dict(SCRIPT_BANDS)
    for r in good.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("_n"), *quartiles).collect():
        found = [n for n in names if r[n] is not None]
        reach = {n: FENCE * max(r[n][2] - r[n][0], MIN_SPREAD * r[n][1]) for n in found}
        low, high = ({n: r[n][i] + sign * reach[n] for n in found} for i, sign in ((0, -1), (2, 1)))
        fixed = languages.get(r["_l"]) or scripts.get(r["_s"]) or LANGUAGE_BANDS["en"]
        mean = lambda own, given: (r["_n"] * own + PRIOR_DOCUMENTS * given) / (r["_n"] + PRIOR_DOCUMENTS)  # noqa: B023, E731
        # most texts have no byte-fallback token at all: the fixed limit is the least one
        bytes_ = mean(max(high["byte_share"], fixed.max_byte_share), fixed.max_byte_share)
        band = replace(fixed, min_chars_per_token=mean(low["chars_per_token"], fixed.min_chars_per_token), max_chars_per_token=mean(high["chars_per_token"], fixed.max_chars_per_token), max_byte_share=bytes_, min_entropy_share=mean(low["entropy_share"], fixed.min_entropy_share))
        if "bpe_chars_per_token" in found:
            band = replace(
                band, min_bpe_chars_per_token=mean(low["bpe_chars_per_token"], fixed.min_bpe_chars_per_token), max_bpe_chars_per_token=mean(high["bpe_chars_per_token"], fixed.max_bpe_chars_per_token),
                min_bpe_entropy_share=mean(low["bpe_entropy_share"], fixed.min_bpe_entropy_share),
            )
        if r["_l"] is not None:
            languages[r["_l"]] = band
        else:
            scripts[r["_s"]] = band
    return {"languages": languages, "scripts": scripts}


def save_bands(spark: SparkSession, bands: dict[str, dict[str, Band]], path: str) -> None:
    """Bands as a table, a row for each language and script; with them, `judge` gives a row the same verdict in any table."""
    rows = [(kind, name, *astuple(band)) for kind, group in sorted(bands.items()) for name, band in sorted(group.items())]
    spark.createDataFrame(rows, f"kind string, name string, {', '.join(f'{f.name} double' for f in fields(Band))}").coalesce(1).write.mode("overwrite").parquet(path)


def load_bands(spark: SparkSession, path: str) -> dict[str, dict[str, Band]]:
    out: dict[str, dict[str, Band]] = {"languages": {}, "scripts": {}}
    for r in spark.read.parquet(path).collect():
        out[r["kind"]][r["name"]] = Band(*(r[f.name] for f in fields(Band)))
    return out


def judge(df: DataFrame, model_path: str, text: str = "text", lang: str | None = "lang", carry: tuple[str, ...] | None = None, ranks_path: str | None = None, pattern: str | None = None, **bands) -> DataFrame:
    """df with the measures' struct (last column), `base_failed` and `kept` inside it.

    carry: the columns of df that the result has, `lang` among them; all by default. bands: `languages`, `scripts` of
    in_band; without any, they are fitted on df."""
    measured = measure(df, model_path, text, ranks_path=ranks_path, pattern=pattern)
    into = measured.columns[-1]
    if carry is not None:
        measured = measured.select(*carry, into)
    lang = lang if lang and lang in measured.columns else None
    if not bands:
        measured = materialize(measured, "measures")
        bands = fit_bands(measured, into, lang)
    m = F.col(into)
    failed = base_failed(m)
    kept = ~failed & in_band(m, F.col(lang) if lang else None, **bands)
    return measured.withColumn(into, m.withField("base_failed", failed).withField("kept", kept))


def keep_good(df: DataFrame, model_path: str, id_col: str = "doc_id", lang: str | None = "lang", **options) -> DataFrame:
    """The rows of df that pass, with df's columns. Only keys and measures are written, no text."""
    whole, key = keyed(df, id_col)
    lang = lang if lang and lang in whole.columns else None

    def rejected() -> DataFrame:
        judged = judge(whole, model_path, lang=lang, carry=(key, lang) if lang else (key,), **options)
        return judged.filter(~F.col(judged.columns[-1])["kept"]).select(F.col(key).alias("_gone"))

    gone = settle(df.sparkSession, "rejected", rejected)
    out = whole.join(gone, whole[key] == gone["_gone"], "left_anti")
    return out if key == id_col else out.drop(key)
