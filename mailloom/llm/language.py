"""Language of texts by averaged subword embeddings and a linear softmax.

Subwords are one to three letters with word ends; each is hashed to a row of an
embedding table. A text is the mean of its rows, and a linear layer with softmax
gives the languages. Both are trained by stochastic gradient descent in numpy on
stretches of labelled texts. As everything after the table is linear up to the
softmax, the trained table and layer fold into one table of scores per subword,
so a text costs one look-up per subword. On labelled texts kept from training, a
temperature makes the probabilities honest and a quantile of the scores of right
answers becomes the least score that is accepted.

A softmax is sure of texts that are like none of its languages, too. So a second
signal is the share of a text's subwords that hardly any training text has: low
for any learned language and for mixtures of them, high for others and for random
letters. How far it may rise above its mean is calibrated on the same texts, by
their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import hash_limit

BUCKETS = 1 << 15
WIDTH = 16
LONGEST = 3
#: Characters looked at together.
STRETCH = 1 << 20
UNKNOWN = "und"
#: Answers with this score are accepted, unless their subwords are too rare.
LEAST_SCORE = 0.4
#: Share of all subwords below which one is rare.
SELDOM = 1e-6
#: Subwords from which on a text is no surer to be usual, and room above the strangest right answer.
ENOUGH, ROOM = 400, 1.5

_LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    out = _LETTERS[np.minimum(codes, (1 << 16) - 1)]
    for at in np.flatnonzero(codes >= 1 << 16):
        out[at] = chr(codes[at]).isalpha()
    return out


def subwords(text: str) -> np.ndarray:
    """Table rows of all subwords of a text; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter(codes)
    # One zero stands for whatever lies between two words.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes = np.concatenate(([0], np.where(letter, codes, 0)[kept], [0])).astype(np.uint64)
    inside = codes > 0
    out = []
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        mixed = np.zeros(len(codes) - n + 1, np.uint64)
        whole = np.ones(len(mixed), bool)
        for k in range(n):
            mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            if 0 < k < n - 1 or n == 1:
                whole &= inside[k : k + len(mixed)]
        if n == 2:
            whole &= inside[:-1] | inside[1:]
        out.append(((mixed[whole] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    languages: list[str]
    #: Score of each language per subword and last whether the subword is rare; what is added once to the scores.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    #: Share of rare subwords in calibration texts, its spread per subword, and how many spreads are accepted.
    usual: tuple[float, float, float] = (0.0, 1.0, np.inf)

    def signals(self, text: str) -> tuple[np.ndarray, float, int] | None:
        """Scores before the softmax, share of rare subwords and number of subwords; None for a text without a letter."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for at in range(0, len(text), STRETCH):
            rows = subwords(text[at : at + STRETCH])
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            n += len(rows)
        return (total[:-1] / n + self.bias, float(total[-1] / n), n) if n else None

    def strangeness(self, rarity: float, n: int) -> float:
        """Spreads by which more of a text's subwords are rare than usual; longer texts must be closer, up to a length."""
        mean, spread, _ = self.usual
        return (rarity - mean) * np.sqrt(min(n, ENOUGH)) / spread

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the answer is rejected."""
        found = self.signals(text) if text and self.languages else None
        if found is None:
            return UNKNOWN, 0.0, True
        logits, rarity, n = found
        odds = logits / self.temperature
        odds = np.exp(odds - odds.max())
        best = int(odds.argmax())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < self.least or self.strangeness(rarity, n) > self.usual[2]


def _stretches(texts: list[str], rng: np.random.Generator) -> list[str]:
    """One stretch of each text, from some words to some lines long."""
    out = []
    for text in texts:
        size = int(np.exp(rng.uniform(np.log(20), np.log(600))))
        start = int(rng.integers(0, max(1, len(text) - size)))
        out.append(text[start : start + size])
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit(
    texts: list[str],
    languages: list[str],
    rounds: int = 8,
    rate: float = 4.0,
    batch: int = 64,
    least_steps: int = 600,
    reject_share: float = 0.0005,
    seed: int = 7,
) -> LanguageModel:
    """Train on labelled texts for ``rounds`` rounds, or as many as ``least_steps`` take; a fifth only calibrates.

    At most ``reject_share`` of the right answers on the calibration texts score
    below the least accepted score, which is never above ``LEAST_SCORE``.
    """
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in languages])
    order = rng.permutation(len(texts))
    kept_out = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    per_round = max(1, -(-len(train) // batch))
    rounds = max(rounds, -(-least_steps // per_round))
    steps = rounds * per_round
    step = 0
    for _ in range(rounds):
        train = rng.permutation(train)
        for at in range(0, len(train), batch):
            speed = rate * (1 - step / steps)
            step += 1
            chosen = train[at : at + batch]
            rows = [subwords(t) for t in _stretches([texts[k] for k in chosen], rng)]
            full = [k for k, r in enumerate(rows) if len(r)]
            if not full:
                continue
            y = label[chosen[full]]
            sizes = np.array([len(rows[k]) for k in full])
            flat = np.concatenate([rows[k] for k in full])
            mean = np.add.reduceat(embedding[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = np.repeat((error @ weights.T) / sizes[:, None], sizes, axis=0)
            weights -= speed * (mean.T @ error)
            bias -= speed * error.sum(axis=0)
            distinct, place = np.unique(flat, return_inverse=True)
            sums = np.stack([np.bincount(place, back[:, w], len(distinct)) for w in range(WIDTH)], axis=1)
            embedding[distinct] -= speed * batch * sums
    rare = _rarity([texts[k] for k in train])
    model = LanguageModel(names, np.column_stack((embedding @ weights, rare)).astype(np.float32), bias)
    _calibrate(model, [texts[k] for k in kept_out], label[kept_out], rng, reject_share)
    return model


def _rarity(texts: list[str]) -> np.ndarray:
    """1 for each subword that the training texts seldom have, 0 for the others."""
    counts = sum((np.bincount(subwords(text), minlength=BUCKETS) for text in texts), np.zeros(BUCKETS))
    return counts < SELDOM * counts.sum()


def _calibrate(model: LanguageModel, texts: list[str], label: np.ndarray, rng, reject_share: float) -> None:
    found = [model.signals(t) for t in [*texts, *_stretches(texts, rng), *_stretches(texts, rng)]]
    known = [k for k, x in enumerate(found) if x is not None]
    if not known:
        return
    table, y = np.stack([found[k][0] for k in known]), np.concatenate((label, label, label))[known]
    at = np.arange(len(y))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 81))
    loss = [-np.log(_softmax(table / t)[at, y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    chance = _softmax(table / model.temperature)
    is_right = chance.argmax(axis=1) == y
    if not is_right.any():
        return
    model.least = float(min(LEAST_SCORE, np.quantile(chance.max(axis=1)[is_right], reject_share)))
    rarity, n = (np.array([found[k][j] for k in known])[is_right] for j in (1, 2))
    mean = float(rarity.mean())
    spread = float(np.sqrt(np.mean((rarity - mean) ** 2 * np.minimum(n, ENOUGH)))) or 0.1
    model.usual = (mean, spread, np.inf)
    model.usual = (mean, spread, ROOM * max(1.0, max(map(model.strangeness, rarity, n))))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; false for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_model(
    docs: DataFrame,
    per_language: int = 1500,
    stretch: int = 20_000,
    most_languages: int = 200,
    most_texts: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> LanguageModel:
    """A model from about ``per_language`` labelled documents of each language.

    The counts per language come from all documents that may be learned from;
    the sample is picked by a hash of the id, and so is the stretch of at most
    ``stretch`` characters that a longer text gives. Documents without an id,
    language or text, and those ``held_out``, are not used. Of more than
    ``most_languages`` labels the commonest are learned, and with many labels
    there are fewer texts of each, so that about ``most_texts`` come to the driver.
    """
    over = F.greatest(F.length(text_column) - stretch, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64(F.lit("stretch"), id_column), over) + 1).cast("int")
    usable = docs.filter(F.col(id_column).isNotNull() & ~held_out(F.col(id_column))).select(
        F.col(id_column).alias("id"),
        F.col(language_column).cast("string").alias("language"),
        F.substring(F.col(text_column), start, F.lit(stretch)).alias("text"),
    )
    usable = usable.filter(F.col("language").isNotNull() & F.col("text").isNotNull())
    common = usable.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(most_languages)
    counts = {r["language"]: r["n"] for r in common.collect()}
    if not counts:
        return fit([], [])
    rows = max(1, min(per_language, most_texts // len(counts)))
    limits = {name: hash_limit(rows, n) or (1 << 63) - 1 for name, n in counts.items()}
    limit = F.create_map(*(F.lit(x) for item in limits.items() for x in item))[F.col("language")]
    # A language that is not learned has no limit, and its rows are left out.
    picked = usable.filter(F.shiftrightunsigned(F.xxhash64(F.lit("language"), "id"), 1) < limit)
    sample: pd.DataFrame = picked.select("id", "language", "text").toPandas().sort_values(["id", "text"])
    return fit(sample["text"].tolist(), sample["language"].tolist())


def predict(
    docs: DataFrame, model: LanguageModel, text_column: str = "text", columns: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (or the named columns) with ``lang_pred``, ``score`` and ``rejected``.

    Reads nothing but the text, and all of it. NULL texts and texts without a
    letter are ``und`` with score 0 and rejected; so is every text if the model
    has learned no language. Columns of the new names are replaced.
    """
    new = ("lang_pred", "score", "rejected")
    source = docs.withColumn("__text", F.col(text_column).cast("string")).drop(*new)
    kept = [c for c in (columns or docs.columns) if c in source.columns]
    source = source.select(*kept, "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            name, score, rejected = zip(*found) if found else ((), (), ())
            columns = [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, [*kept, *new])

    schema = source.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The documents that the model does not reject, unchanged; see ``predict``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_column)
            yield batch.filter(pa.array([not shared.value.predict(t.as_py())[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Train on the labelled documents and predict all of them.

    An empty table gives no rows; without labelled documents every answer is
    ``und``. Repeated rows give repeated results, columns pass through.
    """
    return predict(docs, train_model(docs, id_column=id_column, **options))
