"""Quality rules on tokeniser fertility, with base rules on words, symbols and repeats.

A text is cut into words, and each word into pieces of a public vocabulary, as in running text.
Characters per token, the share of byte-fallback pieces and the entropy of the pieces must lie in
the band of the text's language, or of its script where the language has none. Mean length and entropy of
few tokens vary more: the band of the mean is wider by a share of ``SLACK`` over the root of their number, and the
least entropy rises with the logarithm of their number up to ``FULL_TOKENS``. No text is exempt.

Defined results: a null or blank text has zero words, fails the base rules and has null measures;
every input row gives one row, also repeated rows and rows without an id; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetgrid.llm.blocks import WordCodes, blocks, flattened, per_text, split_words

WINDOW = 8
SLACK = 4.0
FULL_TOKENS = 200
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\r\x0b\x0c"

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, language string, script string, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


@dataclass(frozen=True)
class Band:
    """Accepted range of one language or script: characters a token, share of bytes, entropy in bits.

    The first and the last hold for many tokens, and are the wider the fewer tokens there are.
    """

    least_chars: float
    most_chars: float
    most_byte_share: float
    least_entropy: float

    def accepts(self, chars: float, byte_share: float, entropy: float, tokens: int) -> bool:
        slack = 1 + SLACK / math.sqrt(tokens)
        share = min(math.log2(tokens) / math.log2(FULL_TOKENS), 1.0)
        return (
            byte_share <= self.most_byte_share
            and self.least_chars <= chars * slack
            and chars <= self.most_chars * slack
            and entropy >= self.least_entropy * share
        )


# Code point ranges that decide the script of a text.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}

# Bands for the 32,000-piece vocabulary with byte fallback.
BANDS = {
    "en": Band(2.0, 7.0, 0.05, 4.5),
    "de": Band(2.0, 7.0, 0.05, 4.5),
    "fr": Band(1.8, 7.0, 0.05, 4.5),
    "es": Band(1.8, 7.0, 0.05, 4.5),
    "latin": Band(1.3, 8.0, 0.15, 3.5),
    "cyrillic": Band(1.2, 6.0, 0.15, 3.5),
    "greek": Band(0.6, 3.0, 0.3, 3.0),
    "hebrew": Band(0.6, 3.0, 0.3, 3.0),
    "arabic": Band(0.6, 3.0, 0.3, 3.0),
    "indic": Band(0.25, 2.5, 0.9, 3.0),
    "thai": Band(0.25, 2.5, 0.9, 3.0),
    "hangul": Band(0.3, 2.5, 0.8, 3.0),
    "kana": Band(0.3, 2.5, 0.8, 3.0),
    "han": Band(0.3, 2.5, 0.8, 3.0),
    "none": Band(0.0, 1e9, 1.0, 0.0),
}


def script_of(text: bytes) -> str:
    """The script most letters of the text are in; ``none`` without letters."""
    if text.isascii():
        return "none" if text.lower() == text.upper() else "latin"
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = {
        name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges)
        for name, ranges in SCRIPT_RANGES.items()
    }
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


@cache
def piece_codes(path: str) -> tuple[WordCodes, np.ndarray]:
    """Pieces per word of a sentencepiece vocabulary, and which pieces are bytes; one per worker."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.fromiter(map(pieces.is_byte, range(pieces.get_piece_size())), bool)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flattened(pieces.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))

    return WordCodes(encode), is_byte


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words in windows of ``WINDOW`` words found twice or more in that text.

    Windows are sorted by a hash; equal neighbours are compared word by word. Should two different
    windows ever share a hash, the texts are ranked by exact pairs instead.
    """
    n, text = len(words), np.repeat(np.arange(len(counts)), counts)
    m = n - WINDOW + 1
    if m < 2:
        return np.zeros(len(counts), np.int64)
    start = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
    key = np.zeros(n, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key[:m] = text[:m].astype(np.uint64)
    for step in range(WINDOW):
        key[:m] = key[:m] * np.uint64(0xD6E8FEB86659FD93) + mixed[step : m + step]
    order = start[np.argsort(key[start], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    exact = text[left] == text[right]
    for step in range(WINDOW):
        exact &= words[left + step] == words[right + step]
    if not exact.all():
        rank = words
        for size in (1, 2, 4):
            pairs = rank[:-size].astype(np.int64) * (int(rank.max()) + 1) + rank[size:]
            rank = np.unique(pairs, return_inverse=True)[1]
        _, rank, found = np.unique(
            np.stack([text[start], rank[start]]), axis=1, return_inverse=True, return_counts=True
        )
        twice = start[found[rank.ravel()] > 1]
    else:
        twice = np.union1d(left, right)
    covered = np.zeros(n + 1, np.int64)
    covered[twice] += 1
    np.subtract.at(covered, twice + WINDOW, 1)
    return per_text((np.cumsum(covered)[:n] > 0).astype(np.int64), counts)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(BLANK)]
    return len(lines) - len(set(lines))


def entropies(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of the tokens of each text."""
    texts = np.repeat(np.arange(len(counts)), counts)
    keys = np.sort((texts << 32) | tokens)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    held = np.bincount(keys[first] >> 32, times * np.log2(times), len(counts)) if len(keys) else np.zeros(len(counts))
    n = np.maximum(counts, 1)
    return np.maximum(np.log2(n) - held / n, 0.0)


def fertility(
    docs: DataFrame,
    vocabulary: str,
    bands: dict[str, Band] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    least_words: int = 20,
    most_repeat_percent: int = 30,
    carry: bool = False,
) -> DataFrame:
    """Counts, measures and verdict of every text; ``vocabulary`` is a sentencepiece file on all hosts.

    With ``carry`` the whole input row comes along as the last column, ``row``.
    """
    chosen = dict(BANDS if bands is None else bands)

    def work(batches):
        codes, is_byte = piece_codes(vocabulary)
        with codes:
            for block, texts in blocks(batches, "text"):
                yield run(block, texts, codes, is_byte)

    def run(block, texts, codes, is_byte):
        words, n_words = split_words(texts)
        numbers = codes.numbers(words)
        tokens, sizes = codes.tokens(numbers)
        n_tokens = per_text(sizes, n_words)
        n_bytes = per_text(is_byte[tokens].astype(np.int64), n_tokens)
        entropy = entropies(tokens.astype(np.int64), n_tokens)
        repeats = repeated_words(numbers, n_words)
        langs = block.column(1).to_pylist()
        rows = []
        for i, text in enumerate(texts):
            n, repeat, k = int(n_words[i]), int(repeats[i]), int(n_tokens[i])
            starts = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
            chars = starts - sum(text.count(blank) for blank in BLANK)
            failed = n < least_words or 100 * repeat > most_repeat_percent * n
            script = script_of(text)
            share, per, bits = (n_bytes[i] / k, chars / k, float(entropy[i])) if k else (None, None, None)
            band = chosen.get(langs[i]) or chosen.get(script) or chosen["none"]
            kept = not failed and k > 0 and band.accepts(per, share, bits, k)
            symbols = sum(text.count(symbol) for symbol in SYMBOLS)
            rows.append(
                (n, chars, symbols, repeated_lines(text), repeat, failed, kept, langs[i], script, k, per, share, bits)
            )
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] * 2 + [pa.int64()] + [pa.float64()] * 3
        measured = [block.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))]
        return pa.RecordBatch.from_arrays(measured + block.columns[2:] if carry else measured, schema.names)

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    read = [F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang")]
    schema = StructType.fromDDL(RESULT)
    if not carry:
        return docs.select(*read, F.col(text_col).alias("text")).mapInArrow(work, schema)
    # Columns go by place, so any name may occur; the text is among them and goes once.
    places = {name: "text" if name == text_col else f"c{place}" for place, name in enumerate(docs.columns)}
    read = docs.select(*read, *[F.col(f"`{name}`").alias(place) for name, place in places.items()])
    for place in places.values():
        schema = schema.add(place, read.schema[place].dataType)
    measured = read.mapInArrow(work, schema)
    row = F.struct(*[F.col(place).alias(name) for name, place in places.items()]).alias("row")
    return measured.select(*StructType.fromDDL(RESULT).names, row)
