"""Statistics of whole texts, as numbers that a classifier can read."""

from __future__ import annotations

import numpy as np

NEWLINE, BLANKS = 10, b" \t\n\r\x0b\x0c"
#: Bytes that are counted together; every set gives one share of all bytes.
BYTE_SETS: dict[str, bytes] = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "blank": BLANKS,
    "newline": b"\n",
    "high": bytes(range(128, 256)),
    "control": bytes(b for b in range(32) if b not in BLANKS) + b"\x7f",
    "full_stop": b".",
    "comma": b",",
    "exclaim": b"!?",
    "pause": b";:",
    "quote": b"\"'`",
    "bracket": b"()[]{}",
    "angle": b"<>",
    "bar": b"|",
    "dash": b"-_~=",
    "symbol": b"#$%&*+@\\^",
    "slash": b"/",
}
LETTERS = BYTE_SETS["upper"] + BYTE_SETS["lower"] + BYTE_SETS["high"]
#: Marks that end a line or a word of ordinary prose.
ENDS, WORD_ENDS = b".!?:;\"')", b".,!?:;\"')-"
NAMES = (
    *(f"share_{name}" for name in BYTE_SETS),
    *("log_chars", "log_words", "log_lines", "upper_of_letters", "byte_entropy"),
    *("word_mean", "word_spread", "word_longest", "words_capital", "words_all_upper", "words_odd_end", "words_without_letter"),
    *("words_distinct", "word_commonest", "pairs_distinct", "runs_distinct"),
    *("line_mean", "line_longest", "lines_short", "lines_ended", "lines_repeated", "repeated_line_chars"),
    *("longest_same", "words_a_stop"),
)

_SETS = np.zeros((len(BYTE_SETS), 256))
for _k, _members in enumerate(BYTE_SETS.values()):
    _SETS[_k, list(_members)] = 1


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_BLANK, _UPPER, _LETTER, _WORD_END = map(_table, (BLANKS, BYTE_SETS["upper"], LETTERS, LETTERS + BYTE_SETS["digit"] + WORD_ENDS))
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _distinct_share(keys: np.ndarray) -> float:
    return len(np.unique(keys)) / len(keys) if len(keys) else 1.0


def _word_numbers(data: np.ndarray) -> dict[str, float]:
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return {}
    size = ends - starts
    inside = ~blank
    bytes_in = data[inside]
    first = np.cumsum(size) - size
    place = np.arange(len(bytes_in)) - np.repeat(first, size)
    keys = np.add.reduceat((bytes_in.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], first)
    _, counts = np.unique(keys, return_counts=True)
    letters = np.add.reduceat(_LETTER[bytes_in].astype(np.int64), first)
    upper = np.add.reduceat(_UPPER[bytes_in].astype(np.int64), first)
    pairs = keys[:-1] * np.uint64(31) + keys[1:]
    runs = pairs[:-3] * np.uint64(1009) + pairs[3:] if len(pairs) > 3 else pairs[:0]
    return {
        "log_words": np.log1p(len(size)),
        "word_mean": size.mean(),
        "word_spread": size.std(),
        "word_longest": np.log1p(size.max()),
        "words_capital": _UPPER[data[starts]].mean(),
        "words_all_upper": ((upper == letters) & (letters > 1)).mean(),
        "words_odd_end": 1 - _WORD_END[data[ends - 1]].mean(),
        "words_without_letter": (letters == 0).mean(),
        "words_distinct": len(counts) / len(size),
        "word_commonest": counts.max() / len(size),
        "pairs_distinct": _distinct_share(pairs),
        "runs_distinct": _distinct_share(runs),
        "words_a_stop": np.log1p(len(size) / (1 + np.isin(data[ends - 1], list(b".!?")).sum())),
    }


def _line_numbers(text: bytes) -> dict[str, float]:
    lines = [line for line in map(bytes.strip, text.split(b"\n")) if line]
    if not lines:
        return {}
    size = np.array([len(line) for line in lines])
    seen: set[bytes] = set()
    again = np.zeros(len(lines), bool)
    for k, line in enumerate(lines):
        again[k] = line in seen
        seen.add(line)
    return {
        "log_lines": np.log1p(len(lines)),
        "line_mean": np.log1p(size.mean()),
        "line_longest": np.log1p(size.max()),
        "lines_short": (size < 30).mean(),
        "lines_ended": np.mean([line[-1] in ENDS for line in lines]),
        "lines_repeated": again.mean(),
        "repeated_line_chars": size[again].sum() / size.sum(),
    }


def statistics(text: str | None) -> np.ndarray:
    """One number per name in ``NAMES``; all zero for a NULL or empty text, but for shares of distinct things."""
    out = dict.fromkeys(NAMES, 0.0)
    out.update(words_distinct=1.0, pairs_distinct=1.0, runs_distinct=1.0)
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    if len(data):
        counts = np.bincount(data, minlength=256)
        share = counts / len(data)
        out.update(zip((f"share_{name}" for name in BYTE_SETS), _SETS @ share))
        out["log_chars"] = np.log1p(len(text))
        out["upper_of_letters"] = share[_UPPER].sum() / max(share[_LETTER].sum(), 1e-9)
        used = share[share > 0]
        out["byte_entropy"] = float(-(used * np.log2(used)).sum())
        change = np.flatnonzero(np.diff(data))
        out["longest_same"] = np.log1p(np.diff(np.concatenate(([-1], change, [len(data) - 1]))).max())
        out.update(_word_numbers(data))
        out.update(_line_numbers(raw))
    return np.array([out[name] for name in NAMES])
