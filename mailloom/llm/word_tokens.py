"""Token ids of texts, word by word."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mailloom.llm.common import words_in_pieces

#: Words whose ids a worker remembers.
REMEMBERED = 1 << 20
#: Words looked up at once.
TOGETHER = 4000
#: Bytes of short texts that are split together, and of a text that is read in stretches.
GROUP, LONG = 16 << 20, 1 << 20
#: Marks that the vocabulary joins to runs; the apostrophe has rules of its own.
MARKS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
#: Words of plain letters, digits and marks; the quick way takes these only. Each digit is a run.
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-ÿ0-9{MARKS}]+$"
RUNS = f"([a-zß-öø-ÿ]+|[0-9]|[{MARKS}]+)"
#: Ends of runs and of words in the text that the quick way encodes.
RUN_END, WORD_END = "\0", "\1"

_tokenizers: dict[str | None, WordTokenizer] = {}


def _letter_bytes() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class QuickWords:
    """The same merges with a faster encoder, for words of plain letters, digits and marks.

    The vocabulary marks the last letter of a run by a suffix. Here a zero byte
    after the run plays that part: it joins the letter before it first of all,
    and from there on the merges are those of the vocabulary, in its order.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        import tiktoken

        byte_of = _letter_bytes()

        def plain(token: str) -> bytes:
            ended = token.endswith(suffix) and len(token) > len(suffix)
            core = token[: -len(suffix)] if ended else token
            return bytes(byte_of[letter] for letter in core) + RUN_END.encode() * ended

        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        letters = sorted(byte_of, key=byte_of.get)
        order = [letter + suffix for letter in letters] + letters + joined
        ranks = {plain(token): rank for rank, token in enumerate(order)}
        self.ids = np.array([vocabulary.get(token, 0) for token in order], np.uint32)
        self.divider = ranks[WORD_END.encode()]
        self.encoder = tiktoken.Encoding(
            "runs", pat_str=r"[^\x00\x01]+\x00|\x01", mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        runs = pc.replace_substring_regex(pc.utf8_lower(words), RUNS, r"\1" + RUN_END)
        bounds = pa.array([*range(0, len(runs), TOGETHER), len(runs)], pa.int32())
        sizes, ids = [], []
        for text in pc.binary_join(pa.ListArray.from_arrays(bounds, runs), WORD_END).to_pylist():
            ranks = np.array(self.encoder.encode_ordinary(text), np.int64)
            ends = np.flatnonzero(ranks == self.divider)
            sizes.append(np.diff(ends, prepend=-1, append=len(ranks)) - 1)
            ids.append(self.ids[np.delete(ranks, ends)])
        return np.concatenate(sizes), np.concatenate(ids)


class WordTokenizer:
    """Ids of texts from the ids of their words.

    The vocabulary's words end at white space, so a text has the ids of its words
    one after the other. The distinct words of many texts are looked up together;
    a worker remembers the ids of those it has met, in one flat array.
    """

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        # Whole tokens that the library looks for in any text; words with one are left to it.
        added = [t["content"] for t in content.get("added_tokens") or []]
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        self.quick = None
        if model.get("type") == "BPE" and model.get("end_of_word_suffix"):
            self.quick = QuickWords(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in order."""
        sizes = np.zeros(len(words), np.int64)
        plain = np.zeros(len(words), bool)
        if self.quick:
            plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
            if self.added:
                plain = plain & ~pc.match_substring_regex(words, self.added).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        odd = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        sizes[rest] = [len(i) for i in odd]
        if not plain.any():
            return sizes, np.array([i for ids in odd for i in ids], np.uint32)
        sizes[plain], quick_ids = self.quick.encode(words.filter(pa.array(plain)))
        ids = np.empty(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(plain, sizes)
        ids[of_plain] = quick_ids
        ids[~of_plain] = [i for one in odd for i in one]
        return sizes, ids

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of some distinct words start in ``flat``, and how many they are."""
        row = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy()
        fresh = np.flatnonzero(row < 0)
        if len(fresh) and len(self.known) + len(fresh) > REMEMBERED and len(self.known) > len(words):
            # Only the words of these texts stay.
            held = np.flatnonzero(row >= 0)
            start, size, flat = self.start[row[held]], self.size[row[held]], self.flat
            self._forget()
            self._add(words.take(pa.array(held)), size, _gathered(flat, start, size))
            row = np.full(len(words), -1)
            row[held] = np.arange(len(held))
        if len(fresh):
            first = len(self.known)
            new = words.take(pa.array(fresh))
            self._add(new, *self._encoded(new))
            row = row.copy()
            row[fresh] = np.arange(first, first + len(fresh))
        return self.start[row], self.size[row]

    def _add(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, words])
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, ids))

    def ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that may repeat, and where those of each word end."""
        coded = words.dictionary_encode()
        start, size = self.places(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = size[which]
        return _gathered(self.flat, start[which], sizes), np.cumsum(sizes)

    def ids_of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short texts, and where those of each text end."""
        split = pc.ascii_split_whitespace(texts)
        ids, ends = self.ids_of_words(split.flatten())
        last = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        return ids, np.concatenate(([0], ends))[last]

    def stretches(self, text: bytes) -> Iterator[np.ndarray]:
        """Ids of a long text, a stretch at a time."""
        for words in words_in_pieces(text, LONG):
            yield self.ids_of_words(pa.array(words, pa.binary()).cast(pa.string()))[0]

    def encode(self, texts: pa.Array) -> Iterator[Iterator[np.ndarray]]:
        """For each text in order its ids, in one stretch or several. NULL counts as empty."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        group = np.cumsum(size) // GROUP
        bounds = np.flatnonzero((np.diff(group) > 0) | (size[1:] >= LONG) | (size[:-1] >= LONG)) + 1
        for first, last in zip([0, *bounds], [*bounds, len(texts)]):
            if last - first == 1 and size[first] >= LONG:
                yield self.stretches(texts[first].as_buffer().to_pybytes())
            elif last > first:
                ids, ends = self.ids_of_texts(texts.slice(first, last - first))
                for a, b in zip([0, *ends], ends):
                    yield iter([ids[a:b]])


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and sizes, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((start - ends + size).astype(kind), size) + np.arange(total, dtype=kind)]


def tokenizer_at(path: str | None) -> WordTokenizer:
    """The worker's tokenizer for a file; the installed public vocabulary if there is no path."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
