"""Token counts: rank-synchronous array merging.

Texts are cut into pre-tokens that the vocabulary can never merge across: a run of word marks
with the characters up to the next mark. The distinct pre-tokens of a batch that the worker has
not met before lie one after the other in a single array of symbols (a ragged array). In every
round each pre-token merges its lowest-rank pair, all pre-tokens at once; symbols that survive
are counted. A pre-token merges every occurrence of its lowest pair in one round where that
provably equals merging them one by one (no pair next to a merged symbol ranks as low), else only
the leftmost. Characters outside the vocabulary never merge and count as their UTF-8 bytes.

Defined results: a null or empty text has no tokens; repeated rows are counted separately; a null
doc_id stays null; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seqlake.llm.common import small_batches, texts

MARK = "▁"                     # stands for a blank
CACHED_UNITS = 250_000         # remembered pre-tokens per Python worker; beyond, the memory starts afresh
NO_PAIR = np.int64(1) << 40    # rank of a pair that does not merge
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceVocabulary:
    """The merge table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=model_file)
        if sp.normalize(" A\t ﬁ ") != f"{MARK}{MARK}A\t{MARK}ﬁ{MARK}":
            raise ValueError("only models that keep texts as they are (blanks marked, one put in front) are supported")
        ids = [i for i in range(sp.get_piece_size())
               if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): n for n, i in enumerate(ids)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece spans two words")
        _, ranks = np.unique([-sp.get_score(i) for i in ids], return_inverse=True)
        self.size = len(pieces) + 1    # the last symbol stands for all characters outside the vocabulary
        self.symbol = np.full(0x110000, len(pieces), dtype=np.int64)
        pairs = []
        for piece, n in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = n
            for k in range(1, len(piece)):
                a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a * self.size + b, ranks[n], n))
        pairs.sort()
        self.pair, self.rank, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, (1 << 62, 0, 0)))

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of the pairs a, b; NO_PAIR where they do not merge."""
        key = a * self.size + b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], NO_PAIR), self.merged[at]

    def count(self, units: list[str]) -> np.ndarray:
        """The number of tokens of each non-empty pre-token."""
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        sym, seq = self.symbol[points], np.repeat(np.arange(len(units)), lengths)
        extra = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        out = np.bincount(seq, weights=np.where(sym == self.size - 1, extra, 0), minlength=len(units)).astype(np.int64)
        rank, merged = np.full(len(sym), NO_PAIR), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], merged[inner] = self.look_up(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low, size = np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(seq)])
            out[seq[start]] += np.where(low == NO_PAIR, size, 0)
            live = np.repeat(low != NO_PAIR, size)
            low = np.repeat(low, size)[live]
            sym, seq, rank, merged = sym[live], seq[live], rank[live], merged[live]
            sym, seq, rank, merged = self._round(sym, seq, rank, merged, low)
        return out

    def _round(self, sym, seq, rank, merged, low):
        hit = np.flatnonzero(rank == low)
        if not len(hit):
            return sym, seq, rank, merged
        fresh = np.r_[True, hit[1:] != hit[:-1] + 1]                 # pairs that overlap: every other one of a run
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        several = np.r_[seq[hit[1:]] == seq[hit[:-1]], False] | np.r_[False, seq[hit[1:]] == seq[hit[:-1]]]
        if several.any():
            risky = np.unique(seq[hit[several]][self._disturbed(sym, seq, merged, low, hit, several)])
            leftmost = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
            hit = hit[leftmost | ~np.isin(seq[hit], risky)]
        sym = sym.copy()
        sym[hit] = merged[hit]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        place = np.cumsum(keep)[hit] - 1
        sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
        todo = np.unique(np.r_[place, place - 1])
        todo = todo[todo >= 0]
        rank[todo] = NO_PAIR
        todo = todo[todo < len(sym) - 1]
        todo = todo[seq[todo] == seq[todo + 1]]
        rank[todo], merged[todo] = self.look_up(sym[todo], sym[todo + 1])
        return sym, seq, rank, merged

    def _disturbed(self, sym, seq, merged, low, hit, several):
        """Which of the pairs ``hit[several]`` would make, before or after their neighbours merge, a pair that
        ranks as low as themselves."""
        new = sym.copy()
        new[hit] = merged[hit]
        taken = np.zeros(len(sym), dtype=bool)
        taken[hit + 1] = True
        h = hit[several]
        m, bad = merged[h], np.zeros(len(h), dtype=bool)
        left, right = h - 1, h + 2
        has_left = (left >= 0) & (seq[np.maximum(left, 0)] == seq[h])
        has_right = (right < len(sym)) & (seq[np.minimum(right, len(sym) - 1)] == seq[h])
        left, right = np.maximum(left, 0), np.minimum(right, len(sym) - 1)
        left_new = np.where(taken[left], np.maximum(left - 1, 0), left)
        for has, a, b in ((has_left, sym[left], m), (has_left, new[left_new], m),
                          (has_right, m, sym[right]), (has_right, m, new[right])):
            bad |= has & (self.look_up(a, b)[0] <= low[h])
        return bad


class TokenCounter:
    """Counts the tokens of whole texts, remembering the pre-tokens already counted."""

    def __init__(self, model_file: str):
        self.vocabulary = PieceVocabulary(model_file)
        self.known: dict[str, int] = {}

    @staticmethod
    def units(text: str) -> list[str]:
        """Pre-tokens without their first mark; a blank is a mark, and one is put in front."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]

    def count(self, batch: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_UNITS:
            self.known.clear()
        known, cut = self.known, [self.units(t) for t in batch]
        new = list({u for us in cut for u in us if u not in known})
        if new:
            known.update(zip(new, self.vocabulary.count([MARK + u for u in new]).tolist()))
        return np.array([sum(map(known.__getitem__, us)) for us in cut], dtype=np.int64)


@lru_cache(maxsize=1)
def counter_of(model_file: str) -> TokenCounter:
    """The worker's counter, kept for its later tasks."""
    return TokenCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per document row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(model_file)
        for pdf in batches:
            text = pdf.pop("text").tolist()
            pdf["n_bytes"] = [len(t.encode("utf-8", "replace")) for t in text]
            pdf["n_tokens"] = counter.count(text)
            yield pdf

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
