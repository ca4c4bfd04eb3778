"""Main text of web pages by a recurrent labeller of blocks.

A page is a sequence of leaf blocks. Each block becomes a vector: hashed counts
of the tags and class names above it, hashed counts of its words, and some
measures. A bidirectional LSTM in numpy reads the sequence both ways, so each
block is judged with the whole page as context. It is trained on made-up pages
of many layouts, filled with words of the corpus, and on a bounded sample of real
pages whose own semantic tags say what is main.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import sampled
from mailloom.llm.html_blocks import Block, blocks_of
from mailloom.llm.html_pages import PageMaker

PATHS, WORDS, MEASURES = 512, 64, 8
INPUTS = PATHS + WORDS + MEASURES
HIDDEN = 24
#: Pages run through the network together.
TOGETHER = 64
#: Blocks run through the network at once, for longer pages too.
SPAN = 4096
#: Blocks of one real page that the training learns from.
LEARNED_BLOCKS = 2000


@lru_cache(1 << 16)
def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for k, block in enumerate(blocks):
        for token in block.path:
            out[k, _bucket(token, PATHS)] = 2
        if block.path:
            out[k, _bucket("leaf " + block.path[-1], PATHS)] = 1
        words = block.text.split(" ")
        slots = np.bincount([_bucket(w.lower(), WORDS) for w in words], minlength=WORDS)
        out[k, PATHS : PATHS + WORDS] = np.minimum(slots, 3) / 10
        n = len(block.text)
        out[k, PATHS + WORDS :] = (
            np.log1p(n) / 8,
            np.log1p(len(words)) / 6,
            min(1.0, block.linked / n),
            block.text[-1] in ".!?…",
            sum(map(block.text.count, ",.;:")) / len(words),
            (k + 1) / len(blocks),
            k == 0,
            k == len(blocks) - 1,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM; gates lie side by side as input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator):
        self.into = rng.normal(0, 0.08, (INPUTS, 4 * HIDDEN)).astype(np.float32)
        self.back = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros(4 * HIDDEN, np.float32)
        self.bias[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool):
        """Hidden states (time, page, HIDDEN); ``live`` is 0 behind the end of a page."""
        given = x @ self.into + self.bias
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        states, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            gates = given[t] + h @ self.back
            i, f, o = np.split(_sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(gates[:, 3 * HIDDEN :])
            new = f * c + i * g
            squashed = np.tanh(new)
            on = live[t][:, None]
            if keep:
                trace.append((i, f, o, g, c, h, squashed, on))
            c = on * new + (1 - on) * c
            h = on * (o * squashed) + (1 - on) * h
            states[t] = h
        return states, trace

    def backward(self, x: np.ndarray, trace: list, errors: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``into``, ``back`` and ``bias``."""
        d_given = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_back = np.zeros_like(self.back)
        dh, dc = np.zeros_like(errors[0]), np.zeros_like(errors[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, c, h, squashed, on = trace[t]
            dh = dh + errors[t]
            d_out, d_new = on * dh, on * dc
            d_new = d_new + d_out * o * (1 - squashed**2)
            d_gates = np.concatenate(
                (d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_out * squashed * o * (1 - o), d_new * i * (1 - g**2)), 1
            )
            d_given[t] = d_gates
            d_back += h.T @ d_gates
            dh = (1 - on) * dh + d_gates @ self.back.T
            dc = (1 - on) * dc + d_new * f
        flat = d_given.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, INPUTS).T @ flat, d_back, flat.sum(0)]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), INPUTS), np.float32)
    live = np.zeros((longest, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], live[: len(page), k] = page, 1
    return x, live


@dataclass
class Labeller:
    ahead: Direction
    behind: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        return cls(Direction(rng), Direction(rng), rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32))

    @classmethod
    def of(cls, weights: list[np.ndarray]) -> Labeller:
        model = cls.new(0)
        for own, given in zip(model.weights(), weights):
            own[...] = given
        return model

    def weights(self) -> list[np.ndarray]:
        return [w for d in (self.ahead, self.behind) for w in (d.into, d.back, d.bias)] + [self.out, self.bias]

    def _run(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        one, trace = self.ahead.forward(x, live, keep)
        # Read from the end of the longest page; shorter ones start when they are reached.
        two, trace_back = self.behind.forward(x[::-1], live[::-1], keep)
        both = np.concatenate((one, two[::-1]), 2)
        return both @ self.out + self.bias, both, trace, trace_back

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, the probability of each block to be main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            size = max(1, min(TOGETHER, SPAN // len(pages[order[min(at + TOGETHER, len(order)) - 1]])))
            chosen = order[at : at + size]
            logits = self._run(*_padded([pages[k] for k in chosen]))[0]
            for place, k in enumerate(chosen):
                out[k] = _sigmoid(logits[: len(pages[k]), place])
            at += size
        return out

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        x, live = _padded(pages)
        y, told = np.zeros_like(live), np.zeros_like(live)
        for k, label in enumerate(labels):
            y[: len(label), k], told[: len(label), k] = label == 1, label >= 0
        logits, both, trace, trace_back = self._run(x, live, keep=True)
        error = (_sigmoid(logits) - y) * told / max(1.0, told.sum())
        spread = error[..., None] * self.out
        ahead = self.ahead.backward(x, trace, spread[..., :HIDDEN])
        behind = self.behind.backward(x[::-1], trace_back, spread[::-1][..., HIDDEN:])
        return [*ahead, *behind, (both * error[..., None]).sum((0, 1)), error.sum(keepdims=True).reshape(1)]


def _batches(sizes: list[int], pages: int = 64, cells: int = 1 << 14) -> list[list[int]]:
    """Neighbours together: at most so many pages, and so many blocks when all are as long as the longest."""
    out: list[list[int]] = []
    longest = 0
    for k, size in enumerate(sizes):
        if not out or len(out[-1]) == pages or (len(out[-1]) + 1) * max(longest, size) > cells:
            out.append([])
            longest = 0
        out[-1].append(k)
        longest = max(longest, size)
    return out


def train(pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, rate: float = 0.015, seed: int = 3) -> Labeller:
    """Adam on batches of pages of like length; labels are 1 main, 0 other, -1 unknown."""
    model = Labeller.new(seed)
    rng = np.random.default_rng(seed)
    full = [k for k in range(len(pages)) if len(pages[k])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    step, total = 0, rounds * len(_batches([len(pages[k]) for k in sorted(full, key=lambda k: len(pages[k]))]))
    for _ in range(rounds):
        order = sorted(full, key=lambda k: len(pages[k]) + rng.uniform(0, 6))
        batches = [[order[k] for k in part] for part in _batches([len(pages[k]) for k in order])]
        for number in rng.permutation(len(batches)):
            chosen = batches[number]
            step += 1
            speed = rate * max(0.0, 1 - step / (total + 1))
            for w, g, (m, v) in zip(model.weights(), model.gradients([pages[k] for k in chosen], [labels[k] for k in chosen]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


#: Tags and class names that say themselves what a real page's block is.
SAYS_MAIN = {"article", "main"}
SAYS_OTHER = {"nav", "footer", "aside", "form", ".ad", ".ads", ".advert", ".sidebar", ".menu", ".footer", ".comments", ".comment", ".cookie"}


def own_labels(blocks: list[Block]) -> np.ndarray:
    """Labels by the nearest telling tag or class; unknown without one."""
    out = np.full(len(blocks), -1)
    for k, block in enumerate(blocks):
        for token in reversed(block.path):
            if token in SAYS_MAIN or token in SAYS_OTHER:
                out[k] = token in SAYS_MAIN
                break
    return out


def fit_labeller(real: list[str], made_pages: int) -> Labeller:
    """A labeller from made-up pages in the words of real ones, and these themselves."""
    parsed = [blocks_of(page)[:LEARNED_BLOCKS] for page in real]
    words = sorted({w for blocks in parsed for b in blocks for w in b.text.lower().split()})
    rows = [block_vectors(blocks) for blocks in parsed]
    labels = [own_labels(blocks) for blocks in parsed]
    maker = PageMaker(words or "the of and to in is that for it with as on be at by this".split(), seed=11)
    for _ in range(made_pages):
        page, known = maker.page()
        blocks = blocks_of(page)
        rows.append(block_vectors(blocks))
        labels.append(np.array([int(known[b.text]) if b.text in known else -1 for b in blocks], int))
    return train(rows, labels)


def train_labeller(
    pages: DataFrame,
    made_pages: int = 800,
    sample_pages: int = 400,
    sample_chars: int = 100_000,
    html_column: str = "html",
    key: str = "page_id",
) -> Labeller:
    """A labeller from ``made_pages`` made-up pages and about ``sample_pages`` real ones.

    The real ones are picked by a hash of their id and content. Of a long one the
    first ``sample_chars`` characters and ``LEARNED_BLOCKS`` blocks are learned
    from, so what comes to the driver and into the one task of the training has a
    bound. Predictions read whole pages.
    """
    usable = pages.select(F.col(key).alias("id"), F.col(html_column).cast("string").alias("html")).filter("html is not null")
    stretch = F.substring("html", 1, sample_chars).alias("html")
    real = sorted(r["html"] for r in sampled(usable, sample_pages, "id", "html").select(stretch).limit(4 * sample_pages).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = pickle.dumps(fit_labeller(real, made_pages).weights())
            yield pa.RecordBatch.from_arrays([pa.array([model] * batch.num_rows, pa.binary())], ["model"])

    trained = pages.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "model binary").first()["model"]
    return Labeller.of(pickle.loads(trained))


def extract(pages: DataFrame, model: Labeller, html_column: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns with ``text``, ``n_blocks`` and ``n_kept``.

    ``text`` has the blocks that the labeller takes for main text, in page order
    with an empty line between them; empty if there are none. Whole pages are
    read. NULL and empty pages have no blocks; broken markup is read as far as
    it goes. Repeated rows give repeated results; an empty table gives no rows.
    Other columns are not read.
    """
    source = pages.select(*columns, F.col(html_column).cast("string").alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parsed = [blocks_of(page.as_py()) for page in batch.column(len(columns))]
                chances = shared.value.chances([block_vectors(blocks) for blocks in parsed])
                kept = [[b.text for b, p in zip(blocks, c) if p > 0.5] for blocks, c in zip(parsed, chances)]
                new = [
                    pa.array(["\n\n".join(texts) for texts in kept], pa.string()),
                    pa.array([len(blocks) for blocks in parsed], pa.int64()),
                    pa.array([len(texts) for texts in kept], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, [*columns, "text", "n_blocks", "n_kept"])

    schema = source.select(*columns).schema.add("text", "string").add("n_blocks", "long").add("n_kept", "long")
    return source.mapInArrow(run, schema)
