"""Quality rules from tokeniser fertility.

Each word (a run without ASCII white space) is split by a public vocabulary with byte
fallback. A document then has characters per token, the share of fallback bytes and the
entropy of its tokens relative to the most its length allows. Bands for the three come
from the corpus itself, per script: median and spread over all documents of the script (a
distributed sketch, one small row per script reaches the driver). Characters per token are
bad on both sides, bytes only when many, entropy only when low. A document outside its
script's band on any measure is rejected, as is one that fails the base rules: fewer than
50 words, or more than half of its words inside three-word windows that recur.

Null text has no words. Rows are independent; repeated rows repeat. A script with fewer than
`least` documents is judged by the band of all scripts together; a corpus of fewer rejects nothing by bands.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Bounded, stash

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
LEAST_DOCS = 50
WIDTH = 2.5  # half-width of a band in quartile ranges
FLOORS = {"chars_per_token": 0.12, "byte_share": 0.02, "entropy": 0.05}  # a spread counts as at least this
#: Sides on which a measure is bad, and so has a limit.
SIDES = {"chars_per_token": (True, True), "byte_share": (False, True), "entropy": (True, False)}
#: Fixed values of Unicode: first and last code points of the blocks that hold a script's letters.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)], "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "Indic": [(0x900, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)], "Lao": [(0xE80, 0xEFF)], "Tibetan": [(0xF00, 0xFFF)], "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)], "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)], "Khmer": [(0x1780, 0x17FF)], "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)], "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_STARTS = sorted((first, last, name) for name, blocks in SCRIPTS.items() for first, last in blocks)
_FIRSTS = [first for first, _, _ in _STARTS]


def script_of_letter(char: str) -> str:
    at = bisect_right(_FIRSTS, ord(char)) - 1
    return _STARTS[at][2] if at >= 0 and ord(char) <= _STARTS[at][1] else "Other"


def script_of(text: str) -> str:
    """The script with most letters; `None` without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "None"
    seen: Counter = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            seen[script_of_letter(char)] += n
    return max(sorted(seen), key=seen.__getitem__) if seen else "None"


def repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked[i:i + 3] = b"\x01\x01\x01"
    return sum(marked)


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


class Meter:
    """Tokens of words under a sentence-piece vocabulary, remembered by word."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
        self.size = model.vocab_size()
        self.is_byte = np.array([model.is_byte(i) for i in range(self.size)])
        self.words = Bounded(lambda word: np.array(model.encode(word.decode("utf-8", "replace")), np.uint16 if self.size < 65536 else np.uint32).tobytes())
        self.kind = np.uint16 if self.size < 65536 else np.uint32

    def measure(self, words: list[bytes], chars: int) -> tuple[float, float, float]:
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.kind)
        if not len(ids):
            return 0.0, 0.0, 0.0
        counts = np.diff(np.flatnonzero(np.concatenate(([True], np.diff(np.sort(ids)) != 0, [True]))))
        share = counts / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
        room = math.log2(min(len(ids), self.size)) if len(ids) > 1 else 1.0
        return chars / len(ids), float(self.is_byte[ids].mean()), entropy / room


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Base counts and the three measures of every document."""
    schema = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
              "script string, chars_per_token double, byte_share double, entropy double")
    names = [part.split()[0] for part in schema.split(", ")]

    def row(meter: Meter, text: str) -> tuple:
        data = text.encode("utf-8", "replace")
        words = data.split()
        chars = len(text) - sum(map(text.count, BLANKS))
        again = repeated(words)
        failed = len(words) < LEAST_WORDS or 100 * again > 50 * len(words)
        return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), repeated_lines(text), again, failed,
                script_of(text), *meter.measure(words, chars))

    def run(batches):
        meter = Meter(vocabulary)
        types = [pa.int64()] * 5 + [pa.bool_(), pa.string()] + [pa.float64()] * 3
        for batch in batches:
            columns = list(zip(*(row(meter, t or "") for t in batch.column(1).to_pylist()), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def bands(rows: DataFrame, least: int = LEAST_DOCS, width: float = WIDTH) -> dict[str, dict[str, tuple[float, float]]]:
    """Per script and measure the lowest and highest value accepted, from all documents that pass the base rules.

    The band of all scripts together stands under None, for scripts that have none of their own.
    """
    sketch = rows.filter("not base_failed").rollup("script").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in FLOORS]).collect()
    found = {}
    for r in sketch:
        if r["n"] >= least:
            spread = {m: width * max(r[m][2] - r[m][0], floor) for m, floor in FLOORS.items()}
            found[r["script"]] = {
                m: (r[m][1] - spread[m] if low else -math.inf, r[m][1] + spread[m] if high else math.inf) for m, (low, high) in SIDES.items()}
    return found


def judge(docs: DataFrame, least: int = LEAST_DOCS, width: float = WIDTH, **options) -> DataFrame:
    """Base counts, measures and verdict of every document."""
    rows = stash(measured(docs, **options), "fertility")
    outside = F.lit(False)
    known = bands(rows, least, width)
    named = [script for script in known if script is not None]
    for script, limits in known.items():
        own = ~F.col("script").isin(named) if script is None else F.col("script") == script
        for measure, (low, high) in limits.items():
            outside = outside | (own & ~F.col(measure).between(low, high))
    return rows.withColumn("kept", ~F.col("base_failed") & ~outside)
