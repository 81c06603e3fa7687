"""Language identification with a linear-chain conditional random field over words.

States are the languages seen in labelled rows.  A word's features are its prefixes and suffixes of one to three letters, its
letter bigrams and trigrams (hashed), and membership in a lexicon of each language; transitions between languages are
learned too.  A run of more than `SEEN` letters is several words, one after the other, so that all its letters are read.
Forward-backward gives every word of a text, code-switched or not, a posterior for each language; a
document's language has the largest mean posterior, which is its score.

The model is fitted on the driver from a bounded sample: at most `per_language` labelled rows of each language, chosen by the
hash of id and text, and of each the first `FIT_CHARS` characters.  The model has a state for each language, so labels are
taken to be few.  One half builds the lexicon; the other half, cut into spans that are spliced across
languages so that switches are seen, trains the weights.  Prediction reads whole texts of any length.

Defined results: `und` with score 0 for a null text, a text without a letter, and for every text if no row is labelled; an
empty table gives an empty result; repeated rows each get the same prediction; extra columns pass through, and columns
named like the predictions are replaced; equal posteriors go to the language that comes first by name; a row without an id
counts as not held out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from brindle.llm.shared import fresh, table, with_checksum

SEEN = 32
LETTERS = re.compile(rf"[^\W\d_]{{1,{SEEN}}}")
FIT_CHARS = 32 * 1024
HASHED = 1 << 16
#: Texts are predicted in groups of about this many words.
GROUP_WORDS = 600_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numerals that are no digits may stand in a word, but are none alone."""
    words = LETTERS.findall(text.lower()) if text else []
    return words if "".join(words).isalpha() else [w for w in words if any(map(str.isalpha, w))]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a mark at either end, one row a word; lengths with the marks."""
    flat = np.array(["^" + w + "$" for w in words])
    grid = flat.view(np.uint32).reshape(len(words), -1)
    return grid, np.array([len(w) + 2 for w in words])


def word_hash(grid: np.ndarray) -> np.ndarray:
    value = np.full(len(grid), 1469598103934665603, np.uint64)
    for column in grid.T:
        value = np.where(column > 0, (value ^ column.astype(np.uint64)) * np.uint64(1099511628211), value)
    return value


def features(words: list[str], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Feature numbers, one row a word; HASHED + 0 is no feature, HASHED + 1 + k is the lexicon of language k."""
    grid, size = letters(words)
    wide = np.pad(grid, ((0, 0), (0, 3))).astype(np.uint64)
    n, width = grid.shape
    none = HASHED
    inside = np.arange(width)[None, :]
    spread = np.uint64(0x9E3779B97F4A7C15)

    def hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
        value = np.full(parts[0].shape, kind + 1, np.uint64)
        for part in parts:
            value = (value ^ part) * spread
            value ^= value >> np.uint64(29)
        return (value % np.uint64(HASHED)).astype(np.int32)

    a, b, c = wide[:, :width], wide[:, 1 : width + 1], wide[:, 2 : width + 2]
    bigrams = np.where(inside + 2 <= size[:, None], hashed(0, a, b), none)
    trigrams = np.where(inside + 3 <= size[:, None], hashed(1, a, b, c), none)
    row = np.arange(n)
    affixes = []
    for k in (1, 2, 3):
        long_enough = size - 2 >= k
        head = hashed(2 + k, *[wide[:, 1 + j] for j in range(k)])
        last = np.maximum(size - 1 - k, 0)
        tail = hashed(12 + k, *[wide[row, last + j] for j in range(k)])
        affixes += [np.where(long_enough, head, none), np.where(long_enough, tail, none)]
    known = np.full(n, none)
    if len(lexicon[0]):
        value = word_hash(grid)
        at = np.minimum(np.searchsorted(lexicon[0], value), len(lexicon[0]) - 1)
        known = np.where(lexicon[0][at] == value, HASHED + 1 + lexicon[1][at], none)
    return np.concatenate([bigrams, trigrams, np.stack([*affixes, known], axis=1)], axis=1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (HASHED + 1 + languages, languages)
    transitions: np.ndarray  # log weights, from row to column
    lexicon: tuple[np.ndarray, np.ndarray]

    def emissions(self, words: list[str], rows_at_once: int = 20_000) -> np.ndarray:
        parts = [self.weights[features(words[at : at + rows_at_once], self.lexicon)].sum(axis=1) for at in range(0, len(words), rows_at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def posteriors(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum over the words of each sequence of the posterior of each language.

        `emissions` holds the sequences one after the other.  All sequences advance together, longest first, so that step t
        touches the sequences that are still running; messages are scaled to sum to 1.
        """
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        length = sizes[order]
        running = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        forward = np.empty_like(local)
        message = None
        for t, n in enumerate(running):
            at = starts[:n] + t
            message = local[at] if message is None else (message[:n] @ step) * local[at]
            message /= message.sum(axis=1, keepdims=True)
            forward[at] = message
        total = np.zeros((len(sizes), len(self.languages)))
        message = np.zeros((0, len(self.languages)), np.float32)
        for t in range(len(running) - 1, -1, -1):
            n = running[t]
            fresh = np.ones((n - len(message), len(self.languages)), np.float32)
            message = np.concatenate([message, fresh])
            at = starts[:n] + t
            both = forward[at] * message
            total[:n] += both / both.sum(axis=1, keepdims=True)
            message = (local[at] * message) @ step.T
            message /= message.sum(axis=1, keepdims=True)
        out = np.zeros_like(total)
        out[order] = total
        return out


def spliced(texts: list[tuple[str, int]], length: int, count: int, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Training sequences of `length` words: one language, or spans of several languages one after the other."""
    by_language: dict[int, list[list[str]]] = defaultdict(list)
    for text, language in texts:
        words = words_of(text)
        if words:
            by_language[language].append(words)
    languages = sorted(by_language)
    sequences, labels = [], []
    for _ in range(count if languages else 0):
        row: list[str] = []
        label: list[int] = []
        switching = rng.random() < 0.5
        language = languages[rng.integers(len(languages))]
        while len(row) < length:
            words = by_language[language][rng.integers(len(by_language[language]))]
            take = int(rng.integers(3, 13)) if switching else length
            at = int(rng.integers(max(1, len(words) - take + 1)))
            span = words[at : at + take][: length - len(row)]
            row += span
            label += [language] * len(span)
            if switching:
                language = languages[rng.integers(len(languages))]
        sequences.append(row)
        labels.append(label)
    return sequences, np.array(labels)


def build_lexicon(texts: list[tuple[str, int]], least: int = 3, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that mostly occur in one language, and that language."""
    counts: Counter = Counter()
    for text, language in texts:
        counts.update((w, language) for w in words_of(text))
    total: Counter = Counter()
    for (word, _), n in counts.items():
        total[word] += n
    kept = [(word, language) for (word, language), n in counts.items() if n >= least and n >= share * total[word]]
    if not kept:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = word_hash(letters([w for w, _ in kept])[0])
    order = np.argsort(value)
    return value[order], np.array([x for _, x in kept])[order]


def fit(rows: list[tuple[str, str]], length: int = 24, sequences: int = 6000, batch: int = 64, rate: float = 0.15, penalty: float = 1e-5, seed: int = 7) -> Model:
    """Fit by stochastic gradients (AdaGrad) of the conditional log-likelihood."""
    languages = sorted({x for _, x in rows})
    number = {x: k for k, x in enumerate(languages)}
    labelled = [(text, number[x]) for text, x in rows]
    lexicon = build_lexicon(labelled[::2])
    k = len(languages)
    rng = np.random.default_rng(seed)
    weights, grad2 = np.zeros((HASHED + 1 + k, k)), np.full((HASHED + 1 + k, k), 1e-8)
    moves, moves2 = np.zeros((k, k)), np.full((k, k), 1e-8)
    texts, labels = spliced(labelled[1::2] or labelled, length, sequences, rng)
    for at in range(0, len(texts), batch):
        words = [w for row in texts[at : at + batch] for w in row]
        gold = labels[at : at + batch]
        rows_in = len(gold)
        found = features(words, lexicon)
        local = np.exp((e := weights[found].sum(axis=1)) - e.max(axis=1, keepdims=True)).reshape(rows_in, length, k)
        step = np.exp(moves - moves.max())
        forward, backward = np.empty_like(local), np.ones_like(local)
        forward[:, 0] = local[:, 0]
        for t in range(length):
            if t:
                forward[:, t] = (forward[:, t - 1] @ step) * local[:, t]
            forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            backward[:, t] = (local[:, t + 1] * backward[:, t + 1]) @ step.T
            backward[:, t] /= backward[:, t].sum(axis=1, keepdims=True)
        marginal = forward * backward
        marginal /= marginal.sum(axis=2, keepdims=True)
        pair = np.einsum("btk,kl,btl->btkl", forward[:, :-1], step, local[:, 1:] * backward[:, 1:])
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        wrong = marginal.copy()
        np.put_along_axis(wrong, gold[:, :, None], np.take_along_axis(wrong, gold[:, :, None], 2) - 1, 2)
        wrong = wrong.reshape(-1, k)
        touched, place = np.unique(found, return_inverse=True)
        change = np.zeros((len(touched), k))
        np.add.at(change, place.reshape(found.shape), wrong[:, None, :])
        change = change / rows_in + penalty * weights[touched]
        grad2[touched] += change**2
        weights[touched] -= rate * change / np.sqrt(grad2[touched])
        weights[HASHED] = 0
        shift = pair.sum(axis=(0, 1))
        np.subtract.at(shift, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
        shift = shift / rows_in + penalty * moves
        moves2 += shift**2
        moves -= rate * shift / np.sqrt(moves2)
    return Model(languages, weights.astype(np.float32), moves, lexicon)


def train(labelled: DataFrame, per_language: int = 400) -> Model:
    """Fit from columns doc_id, text, lang; see the module for the bound on rows and characters.

    The rows with the least hashes are taken.  A bound on the hash, set so that half as many again pass, keeps all but few rows
    from being ranked; rows that repeat an id and a text count once for it.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", F.substring("text", 1, FIT_CHARS).alias("text"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("rank"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((HASHED + 1, 0), np.float32), np.zeros((0, 0)), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.5 * per_language / n) * (1 << 30)))])
    chosen = usable.where(F.pmod("rank", F.lit(1 << 30)) < share[F.col("lang")])
    least = Window.partitionBy("lang").orderBy("rank", "text")
    rows = chosen.withColumn("place", F.row_number().over(least)).where(F.col("place") <= per_language).orderBy("lang", "place").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def predictor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[int]], list[str]]]:
        at, held, rows, known = 0, 0, [], {}
        for i, text in enumerate(batch.column("text")):
            words = words_of(text.as_py())
            rows.append([known.setdefault(w, len(known)) for w in words])
            held += len(words)
            if held >= GROUP_WORDS:
                yield batch.slice(at, i + 1 - at), rows, list(known)
                at, held, rows, known = i + 1, 0, [], {}
        if rows:
            yield batch.slice(at), rows, list(known)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, rows, known in groups(whole):
                names, scores = ["und"] * len(rows), np.zeros(len(rows))
                spoken = np.array([i for i, r in enumerate(rows) if r], np.int64)
                if len(spoken) and model.languages:
                    sizes = np.array([len(rows[i]) for i in spoken])
                    index = np.concatenate([np.array(rows[i], np.int64) for i in spoken])
                    mean = model.posteriors(model.emissions(known)[index], sizes) / sizes[:, None]
                    best = mean.argmax(axis=1)
                    scores[spoken] = np.clip(mean[np.arange(len(spoken)), best], 0.0, 1.0)
                    for i, b in zip(spoken.tolist(), best.tolist(), strict=True):
                        names[i] = model.languages[b]
                kept = [x for x in batch.schema.names if x not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in kept], pa.array(names), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score; only `text` is an input of the prediction."""
    kept = StructType([f for f in docs.schema.fields if f.name not in ("lang_pred", "score")])
    return docs.mapInArrow(predictor(model), StructType([*kept.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out(docs: DataFrame) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false without an id."""
    return F.coalesce(with_checksum(docs, 4) == 2, F.lit(False))


def spoken_only(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Documents with a recognised language; those without a letter or with a near-uniform prediction go."""
    columns = docs.columns
    labelled = docs.where(~held_out(docs)).select("doc_id", "text", "lang")
    names = {c: fresh(docs, f"_{c}") for c in columns if c in ("lang_pred", "score")}
    found = identify(docs.withColumnsRenamed(names), train(labelled))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).select(*columns)


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs)).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out(docs).alias("held_out")), model).drop("text")


QUERIES = {"op7_language_crf": op7_language_crf}
ORACLE_SQL: dict[str, str] = {}
