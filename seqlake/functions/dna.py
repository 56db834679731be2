"""DNA text functions (normalisation, masking, pre-tokenisation, base composition)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlake.functions.unicode import nfkc

# The base alphabet the tokenizer always has, and the ambiguous base.
BASES = "ACGTN"
AMBIGUOUS = "N"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def normalise_dna(c, unicode_normalise: bool = True) -> Column:
    """NFKC, then only ``a c g t n`` upper-cased; every other character keeps its case."""
    c = _col(c)
    if unicode_normalise:
        c = nfkc(c)
    return F.translate(c, "acgtn", "ACGTN")


def upper_dna(c) -> Column:
    """Full upper-casing, as the training and probing paths read sequences."""
    return F.upper(_col(c))


def mask_unknown(c, alphabet: str = BASES) -> Column:
    """Each character outside ``alphabet`` becomes one ``N`` (never fused)."""
    cls = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in alphabet)
    return F.regexp_replace(_col(c), f"[^{cls}]", AMBIGUOUS)


def pretokenise(c) -> Column:
    """Pieces of a sequence: every ``N`` on its own, N-free runs kept whole."""
    return F.regexp_extract_all(_col(c), F.lit("N|[^N]+"), 0)


def n_free_segments(c) -> Column:
    """Array of the non-empty N-free runs of a sequence."""
    return F.filter(F.split(_col(c), "N"), lambda s: s != "")


def count_char(c, ch: str) -> Column:
    """Occurrences of one character."""
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("bigint")


def text_to_dna(c) -> Column:
    """Test binding: letters folded onto A/C/G/T, everything else N (see README). The rest of ASCII goes with the
    letters (lower case has no A-Z), so that the expression has few characters to replace."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    others = "".join(ch for ch in map(chr, range(1, 128)) if ch not in letters and not "A" <= ch <= "Z")
    return F.regexp_replace(F.translate(F.lower(_col(c)), letters + others, "ACGTACGTACGTACGTACGTACGTAC" + "N" * len(others)),
                            "[^ACGTN]", "N")
