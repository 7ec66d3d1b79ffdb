"""Quality rules: base word statistics and tokeniser fertility.

Public vocabularies are applied word by word (a word as it stands in running
text, after a blank; white space itself is not measured). Per text and
vocabulary: characters per token, share of tokens that are fallback bytes, and
Shannon entropy of the tokens over its largest possible value
log2(number of tokens). Each must lie in the band of the text's script.
Distinct words of a batch are encoded once, then counted back per text, so
nothing is left out.

A null text counts as empty; a text without a word has ratios null and is
never kept (fewer than 50 words). Rows are judged one by one: repeats, ties and
extra columns change nothing. White space is the six ASCII characters only.
"""

from __future__ import annotations

import base64
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from plotwise.llm.common import WORD, batches

VOCABULARIES = ("/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SYMBOLS = "#*$%&|<>"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pattern published with the rank files


@dataclass(frozen=True)
class Band:
    """What a text of a script may measure; the bounds are kept."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float


#: Rejection bands by script; scripts that a vocabulary spells by bytes have few characters a token.
BANDS = {"LATIN": Band((1.25, 12.0), 0.25, 0.30), "CYRILLIC": Band((0.9, 12.0), 0.40, 0.30), "GREEK": Band((0.5, 12.0), 0.60, 0.30), "": Band((0.25, 16.0), 1.0, 0.25)}


class Vocabulary:
    """Token ids of words, for a rank file or a piece model; opened once per worker."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
            self.many = lambda words: self.sp.encode(words, num_threads=1)
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
            self.byte = np.zeros(max(ranks.values()) + 1, bool)
            self.byte[[r for b, r in ranks.items() if len(b) == 1 and b[0] > 127]] = True
            self.many = lambda words: [enc.encode_ordinary(" " + w) for w in words]


@lru_cache(maxsize=8)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=65536)
def script_of(char: str) -> str:
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def script(text: str) -> str:
    """Script of most letters; the first in code order of ties."""
    counts: dict[str, int] = {}
    for c in set(text):
        if s := script_of(c):
            counts[s] = counts.get(s, 0) + text.count(c)
    return min(counts, key=lambda s: (-counts[s], s), default="")


def base(text: str, words: list[str], ids: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words; ids number the words."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    repeated = 0
    if len(ids) > 2:
        u, a = np.unique(ids, return_inverse=True)
        a, k = a.astype(np.int64), len(u)
        _, first, inv, n = np.unique((a[:-2] * k + a[1:-1]) * k + a[2:], return_index=True, return_inverse=True, return_counts=True)
        twice, cover = n[inv] > 1, np.zeros(len(ids), bool)
        for j in range(3):
            cover[j : len(ids) - 2 + j] |= twice
        repeated = int(cover.sum())
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated


def measures(counts: np.ndarray, chars: int, byte: np.ndarray, tokens: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, byte share and relative entropy of one text's token counts."""
    n = counts.sum()
    p = counts / n
    return chars / n, float(counts[byte[tokens]].sum() / n), float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 1.0


def rules(docs: DataFrame, vocabularies=VOCABULARIES, bands=BANDS, min_words: int = 50) -> DataFrame:
    """Base statistics, fertility per vocabulary, script and verdict for every row."""
    paths = tuple(vocabularies)

    def run(b):
        texts = [t or "" for t in b["text"].to_pylist()]
        index: dict[str, int] = {}
        split = [WORD.findall(t) for t in texts]
        flat = np.fromiter((index.setdefault(w, len(index)) for w in chain.from_iterable(split)), np.int64)
        ends = np.cumsum([len(w) for w in split])
        vocab = [vocabulary(p) for p in paths]
        coded = []
        for v in vocab:
            lists = v.many(list(index))
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            coded.append((np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size, np.cumsum(size) - size))
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "chars_per_token", "byte_share", "entropy")}
        for text, words, end in zip(texts, split, ends):
            ids = flat[end - len(words) : end]
            chars, symbols, dup, repeated = base(text, words, ids)
            failed = len(words) < min_words or 100 * repeated > 50 * len(words)
            kind = script(text)
            band = bands.get(kind, bands[""])
            ratios = []
            if words:
                u, c = np.unique(ids, return_counts=True)
                for v, (tokens, size, start) in zip(vocab, coded):
                    n = size[u]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[u], n)
                    t, inv = np.unique(tokens[at], return_inverse=True)
                    ratios.append(measures(np.bincount(inv, np.repeat(c, n)), chars, v.byte, t))
            good = all(band.chars_per_token[0] <= r[0] <= band.chars_per_token[1] and r[1] <= band.byte_share and r[2] >= band.entropy for r in ratios)
            for k, x in zip(out, (len(words), chars, symbols, dup, repeated, failed, not failed and good, kind, [r[0] for r in ratios], [r[1] for r in ratios], [r[2] for r in ratios])):
                out[k].append(x)
        return {"doc_id": b["doc_id"], **out}

    return batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token array<double>, byte_share array<double>, entropy array<double>")
