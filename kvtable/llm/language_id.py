"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the
sum over all its segmentations into pieces of the product of their probabilities; the forward
algorithm gets it in one pass, for all languages at once. Probabilities are fitted by expectation
maximisation: expected piece counts over all segmentations, from the forward and backward passes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_training, materialize, table

WORD = re.compile(r"[^\W\d_]+")
#: Words of more letters than this are scored with logarithms, as their probabilities may fall below the smallest double.
SHORT = 40
#: Probability of a single character that is no piece, in every language.
UNKNOWN = 1e-7
#: Words, and characters of words, whose scores a Python worker keeps before it starts afresh; bounds its memory.
KEPT_WORDS, KEPT_CHARACTERS = 50_000, 1_000_000
#: Numbers in one of the tables for a group of long words (or a single word, if that is longer).
LONG_CELLS = 1 << 18
#: Text that is scored at a time (or one document, if that is longer).
SCORED_BYTES = 500_000
START = "▁"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces, lower-cased, without repeats."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in plain if p == START or p.strip(START).isalpha()})


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, whole."""
    return WORD.findall(text.lower())


class Segmenter:
    """Finds pieces in many words at once. Piece number len(pieces) stands for an unknown character, the one after it for none."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.tables = []
        for k in range(1, self.longest + 1):
            own = [(self.hashes(np.array([[ord(c) for c in p]], np.uint64), k)[0, 0], i) for i, p in enumerate(pieces) if len(p) == k]
            own.sort()
            self.tables.append((np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))

    @staticmethod
    def hashes(codes: np.ndarray, k: int) -> np.ndarray:
        """A hash of the k characters from each position on."""
        width = codes.shape[1] - k + 1
        out = np.zeros((codes.shape[0], width), np.uint64)
        for j in range(k):
            out = (out + codes[:, j : j + width] + np.uint64(1)) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def found(self, codes: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ... the piece of k characters at each position of each word."""
        out = []
        for k in range(1, min(self.longest, codes.shape[1]) + 1):
            keys, ids = self.tables[k - 1]
            h = self.hashes(codes, k)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                piece = np.where(keys[place] == h, ids[place], self.n + 1)
            else:
                piece = np.full(h.shape, self.n + 1)
            out.append(np.where(piece > self.n, self.n, piece) if k == 1 else piece)
        return out

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Of the words up to SHORT letters, those of equal length: their places in the list, and their pieces."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths[lengths <= SHORT]):
            at = np.flatnonzero(lengths == length)
            codes = np.array([START + words[i] for i in at]).view(np.uint32).reshape(len(at), length + 1).astype(np.uint64)
            yield at, self.found(codes)

    def long_groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of the longer words, those of about equal length, filled up with 0 (which is in no piece): places, lengths with the start mark, pieces."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(lengths > SHORT)
        long = long[np.argsort(lengths[long], kind="stable")]
        while len(long):
            width = int(lengths[long[0]] * 1.25) + 1
            n = min(int(np.searchsorted(lengths[long], width, "right")), max(1, LONG_CELLS // width))
            at, long = long[:n], long[n:]
            codes = np.zeros((n, int(lengths[at].max()) + 1), np.uint64)
            for row, i in enumerate(at):
                codes[row, : lengths[i] + 1] = np.frombuffer((START + words[i]).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield at, lengths[at] + 1, self.found(codes)

    def forward(self, found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """Probability of each word's first j characters, summed over segmentations: position, word, language."""
        words, width = found[0].shape
        alpha = np.zeros((width + 1, words, p.shape[1]))
        alpha[0] = 1
        for j in range(1, width + 1):
            for k in range(1, min(j, len(found)) + 1):
                piece = found[k - 1][:, j - k]
                hit = np.flatnonzero(piece <= self.n)
                if len(hit) == words:
                    alpha[j] += alpha[j - k] * p[piece]
                elif len(hit):
                    alpha[j, hit] += alpha[j - k, hit] * p[piece[hit]]
        return alpha

    def forward_logs(self, found: list[np.ndarray], logs: np.ndarray) -> np.ndarray:
        """The logarithms of the same probabilities, for words of any length."""
        words, width = found[0].shape
        alpha = np.full((width + 1, words, logs.shape[1]), -np.inf)
        alpha[0] = 0
        for j in range(1, width + 1):
            for k in range(1, min(j, len(found)) + 1):
                piece = found[k - 1][:, j - k]
                if k == 1 or (piece <= self.n).any():
                    alpha[j] = np.logaddexp(alpha[j], alpha[j - k] + logs[piece])
        return alpha

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language."""
        out = np.zeros((len(words), p.shape[1]))
        for at, found in self.groups(words):
            out[at] = np.log(self.forward(found, p)[-1])
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        for at, ends, found in self.long_groups(words):
            out[at] = self.forward_logs(found, logs)[ends, np.arange(len(at))]
        return out

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations of the words, each counted weights[word, language] times."""
        out = np.zeros((self.n + 2, p.shape[1]))
        for at, found in self.groups(words):
            alpha = self.forward(found, p)
            width = found[0].shape[1]
            beta = np.zeros_like(alpha)
            beta[width] = weights[at] / alpha[width]
            for j in range(width - 1, -1, -1):
                for k in range(1, min(width - j, len(found)) + 1):
                    piece = found[k - 1][:, j]
                    step = p[piece] * beta[j + k]
                    beta[j] += step
                    for lang in range(p.shape[1]):
                        out[:, lang] += np.bincount(piece, alpha[j, :, lang] * step[:, lang], self.n + 2)
        with np.errstate(divide="ignore"):
            logs, log_weights = np.log(p), np.log(weights)
        for at, ends, found in self.long_groups(words):
            alpha = self.forward_logs(found, logs)
            width = found[0].shape[1]
            beta = np.full_like(alpha, -np.inf)
            rows = np.arange(len(at))
            beta[ends, rows] = log_weights[at] - alpha[ends, rows]
            for j in range(width - 1, -1, -1):
                for k in range(1, min(width - j, len(found)) + 1):
                    piece = found[k - 1][:, j]
                    if k > 1 and not (piece <= self.n).any():
                        continue
                    step = logs[piece] + beta[j + k]
                    beta[j] = np.logaddexp(beta[j], step)
                    for lang in range(p.shape[1]):
                        out[:, lang] += np.bincount(piece, np.exp(alpha[j, :, lang] + step[:, lang]), self.n + 2)
        return out


class LanguageModel:
    """Piece probabilities by language (rows: pieces, unknown character, none)."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p


_segmenters: dict[int, Segmenter] = {}


def _segmenter(pieces: list[str]) -> Segmenter:
    key = hash(tuple(pieces))
    if key not in _segmenters:
        _segmenters[key] = Segmenter(pieces)
    return _segmenters[key]


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str | None = None,
    sample_per_language: int = 2000,
    rounds: int = 2,
) -> LanguageModel:
    """Fits piece probabilities on about sample_per_language whole training documents of each language.

    The sample is chosen by a hash of the id among rows with a language and a text, so reruns agree.
    Word counts of the sample are a distributed aggregate; each round of expectation maximisation
    is a Spark job whose result has at most (pieces x languages) rows.
    """
    pieces = read_pieces(vocabulary or default_vocabulary())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 2, 0)))
    share = rows.sparkSession.createDataFrame([(g, min(1.0, sample_per_language / counts[g])) for g in languages], "lang string, share double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(F.broadcast(share), "lang").filter(unit < F.col("share")).select("lang", "text")  # one row a language

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counted.update((lang, w) for w in words_of(text))
            keys = list(counted)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counted.values(), pa.int64())], ["lang", "word", "n"])

    by_word = sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    by_word = materialize(by_word, "language-words")

    place = {g: i for i, g in enumerate(languages)}
    p = np.zeros((len(pieces) + 2, len(languages)))
    p[: len(pieces)] = 1 / len(pieces)
    p[len(pieces)] = UNKNOWN
    for _ in range(rounds):
        now = p

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _segmenter(pieces)
            total = np.zeros((own.n + 2, len(languages)))
            for batch in batches:
                words = batch.column("word").to_pylist()
                weights = np.zeros((len(words), len(languages)))
                weights[np.arange(len(words)), [place[g] for g in batch.column("lang").to_pylist()]] = batch.column("n").to_numpy()
                total += own.expected(words, weights, now)
            piece, lang = np.nonzero(total[: own.n])
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        summed = by_word.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counted = np.full((len(pieces), len(languages)), 0.1)
        counted[summed["piece"], summed["lang"]] += summed["n"]
        p = p.copy()
        p[: len(pieces)] = counted / counted.sum(axis=0)
    return LanguageModel(pieces, languages, p)


class _Ids(dict):
    """Numbers words as they come; keeps the new ones until they are scored."""

    def __init__(self):
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.characters += len(word)
        return n


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the columns named in keep, lang_pred, score. A map over the scan, without a shuffle.

    lang_pred is the language under which the whole text is likeliest (ties: the first by name);
    score is its share among the languages' probabilities. Null text, text without a letter, and
    any text under a model that learned no language give 'und' and 0. Texts and words of any length are read
    whole; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
    """
    keep = keep or []
    whole = text_col in keep  # then the text travels once
    source = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).cast("string").alias(c) if c == text_col else c for c in keep if c != "doc_id"), *([] if whole else [F.col(text_col).cast("string").alias("__text")]))
    text_at = source.columns.index(text_col if whole else "__text")
    kept = source.schema.fields if whole else source.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    pieces, languages, p = model.pieces, model.languages, model.p

    def score_texts(texts: list[str | None], ids: _Ids, known: list[np.ndarray]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        letters = [any(map(str.isalpha, w)) or any(c.isalpha() for x in w for c in x) for w in words]
        if len(ids) > KEPT_WORDS or ids.characters > KEPT_CHARACTERS:
            ids.clear()
            ids.characters = 0
            known.clear()
        flat = [ids[w] for ws in words for w in ws]
        if ids.new:
            known.append(_segmenter(pieces).scores(ids.new, p))
            known[:] = [np.concatenate(known)]
            ids.new = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        totals = np.zeros((len(words), len(languages)))
        if flat:
            full = np.flatnonzero(lengths)
            totals[full] = np.add.reduceat(known[0][flat], np.concatenate([[0], np.cumsum(lengths[full])[:-1]]), axis=0)
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return [languages[b] if a else "und" for a, b in zip(letters, best, strict=True)], [float(s) if a else 0.0 for a, s in zip(letters, share, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = _Ids(), []
        for batch in batches:
            column = batch.column(text_at)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.searchsorted(np.cumsum(sizes), np.arange(SCORED_BYTES, sizes.sum() + SCORED_BYTES, SCORED_BYTES)) + 1
            names: list[str] = []
            scores: list[float] = []
            at = 0
            for end in np.unique(np.minimum(np.append(ends, len(column)), len(column))):  # about SCORED_BYTES of text at a time
                texts = column.slice(at, end - at).to_pylist()
                if languages:
                    a, b = score_texts(texts, ids, known)
                else:
                    a, b = ["und"] * len(texts), [0.0] * len(texts)
                names += a
                scores += b
                at = end
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    return source.mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = is_training(F.col("doc_id"))
    model = fit(docs.filter(training))
    scored = predict(docs, model)
    return scored.withColumn("held_out", F.coalesce(~is_training(F.col("doc_id")), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
