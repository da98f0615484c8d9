"""Language identification by multilingual mixtures.

Model: for every learned language, smoothed log-probabilities of hashed character trigrams of lower-cased words, counted
over all eligible rows. BUCKETS numbers a language (128 KB), so its size is bound by the languages, not by the corpus.

Inference, for each whole text: words are drawn from a mixture of the languages, a word's likelihood under each being
its trigrams'. Expectation-maximisation gives the proportions over all languages; languages in descending proportion
form nested sets; each set is fitted again, and the one of the highest log-likelihood less PENALTY * ln(words) / 2 for
each language is selected. lang_pred is its largest part and score that part's proportion.

Texts are handled CHARS characters at a time and EM runs for all documents of a piece at once; a longer text is a piece
by itself.

Defined results: a null text or one without a letter is `und` with score 0.0, and so is every text if nothing could be
learned; ties go to the language first in code-point order; rows without lang teach nothing, and repeated rows count as
they stand; more than MAX_LANGUAGES distinct values of lang (512 MB) are taken for a wrong column and refused; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted, slices, to_python, unused

BUCKETS = 1 << 15
MAX_LANGUAGES = 4_096
SMOOTHING = 0.1
ROUNDS = 12
PENALTY = 2.0
CHARS = 1 << 18
UNKNOWN = "und"
PREDICTED = ("__lang_pred", "__lang_score")
_SPACE = np.uint32(32)


class _Letters:
    """For each code point whether it is a letter; made once for each worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return cls.table


def _pieces(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts, together CHARS characters long or a single text."""
    held, size = [], 0
    for i, text in enumerate(texts):
        n = len(text or "") + 1
        if held and size + n > CHARS:
            yield held
            held, size = [], 0
        held.append(i)
        size += n
    if held:
        yield held


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, first trigram of each word, number of words of each text). A word is a run of letters, with a space before and after."""
    lowered = [(t or "").lower() for t in texts]
    text = np.frombuffer(f"  {' '.join(lowered)}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _Letters.of()[text]
    text = np.where(letter, text, _SPACE)
    # A trigram starts at each letter's predecessor, so a word of n letters has n of them: " ab", ..., "yz ".
    at = np.flatnonzero(letter)
    mixed = text[at - 1] * np.uint32(0x9E3779B1) ^ text[at] * np.uint32(0x85EBCA6B) ^ (text[at + 1] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    buckets = (mixed >> np.uint32(17)).astype(np.int64)
    first = np.flatnonzero(~letter[at - 1])
    ends = 2 + np.cumsum([len(t) + 1 for t in lowered])
    words = np.diff(np.searchsorted(at[first], ends), prepend=0) if len(first) else np.zeros(len(texts), np.int64)
    return buckets, first, words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, 0):
        by_language: dict[str, list] = {}
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            by_language.setdefault(lang.as_py(), []).append(text.as_py())
        for lang, texts in by_language.items():
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for piece in _pieces(texts):
                total += np.bincount(trigrams([texts[i] for i in piece])[0], minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """counts: BUCKETS x languages."""
        self.languages = languages
        share = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)
        self.log_p = np.ascontiguousarray(np.log(share).astype(np.float32).T)  # languages x BUCKETS


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows of docs with a lang."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counted = to_python(rows).mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    column, counts = {x: k for k, x in enumerate(languages)}, np.zeros((BUCKETS, len(languages)))
    for r in counted.toLocalIterator():
        counts[r["bucket"], column[r["lang"]]] = r["n"]
    return Model(languages, counts)


def _em(likelihood: np.ndarray, starts: np.ndarray, words: np.ndarray, of: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From theta (languages x documents; 0 keeps a language out): fitted proportions, and each document's log-likelihood, up to a constant of the document."""
    for _ in range(ROUNDS):
        joint = likelihood * theta[:, of].astype(np.float32)
        joint /= joint.sum(axis=0)
        theta = np.add.reduceat(joint, starts, axis=1, dtype=np.float64) / words
    total = (likelihood * theta[:, of].astype(np.float32)).sum(axis=0)
    return theta, np.add.reduceat(np.log(total), starts, dtype=np.float64)


def _mixture(likelihood: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Proportions (languages x documents) of each document's best language set. likelihood: languages x words."""
    n_languages, n_docs = len(likelihood), len(words)
    starts, of = np.cumsum(words) - words, np.repeat(np.arange(n_docs), words)
    theta, everything = _em(likelihood, starts, words, of, np.full((n_languages, n_docs), 1 / n_languages))
    order = np.argsort(-theta, axis=0, kind="stable")
    price = PENALTY * np.log(words + 1) / 2
    chosen, docs = np.zeros_like(theta), np.arange(n_docs)
    chosen[order[0], docs] = 1
    best = np.add.reduceat(np.log(likelihood[order[0][of], np.arange(len(of))]), starts, dtype=np.float64) - price
    # No set is likelier than all languages together, so a document goes on only while that likelihood could pay for the set's size.
    size, going = 2, np.flatnonzero(everything - 2 * price > best)
    while len(going) and size <= n_languages:
        own, n = likelihood[:, np.isin(of, going)], words[going]
        first = np.zeros((n_languages, len(going)))
        np.put_along_axis(first, order[:size, going], 1 / size, axis=0)
        fitted, log_likelihood = _em(own, np.cumsum(n) - n, n, np.repeat(np.arange(len(going)), n), first)
        value = log_likelihood - size * price[going]
        better = value > best[going]
        best[going[better]], chosen[:, going[better]] = value[better], fitted[:, better]
        size += 1
        going = going[everything[going] - size * price[going] > best[going]]
    return chosen


def identify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for piece in _pieces(texts):
        buckets, first, words = trigrams([texts[i] for i in piece])
        if not len(first) or not model.languages:
            continue
        log_p = np.stack([np.add.reduceat(c[buckets], first) for c in model.log_p])
        likelihood = np.maximum(np.exp(log_p - log_p.max(axis=0)), np.float32(1e-30))
        full = np.flatnonzero(words)
        chosen = _mixture(likelihood, words[full])
        top = chosen.argmax(axis=0)
        for k, i in enumerate(full):
            names[piece[i]] = model.languages[top[k]]
            scores[piece[i]] = min(1.0, max(0.0, float(chosen[top[k], k])))
    return names, scores


def predicted(docs: DataFrame, model: Model, text: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or only those named) with the prediction and its score: __lang_pred and __lang_score, with more underscores if docs has such."""
    lang_pred, score = unused(docs, *PREDICTED)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list[pa.Array]:
        names, scores = identify(texts, shipped.value)
        return [pa.array(names, pa.string()), pa.array(scores)]

    made = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return map_texts(docs, list(docs.columns if only is None else only), text, made, make)


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of all rows."""
    out = predicted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, only=("doc_id",))
    return out.toDF("doc_id", "lang_pred", "score")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose language is unknown; lang, where null, becomes the prediction."""
    lang_pred, _ = unused(docs, *PREDICTED)
    found = predicted(docs, model).filter(F.col(lang_pred) != UNKNOWN)
    return found.withColumn("lang", F.coalesce(F.col("lang"), F.col(lang_pred))).select(*quoted(*docs.columns))
