"""Shape features of a text; apart from the classifier, so that Python workers need not load the learner."""
from __future__ import annotations

import numpy as np

FEATURES = ["word_length", "same_again", "top_word", "upper", "letters", "digits", "blanks", "marks", "same_lines",
            "bare_marks"]    # none of them depends on how long the text is
_SENTENCE_MARKS = str.maketrans("", "", ".,;:'\"-?()")


def shape(text: str) -> list[float]:
    """The text's features, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    joined = "".join(words)
    solid = joined.translate(_SENTENCE_MARKS)
    kinds = np.frombuffer(solid.encode("utf-32-le", "replace"), dtype="<u4")
    upper = ((kinds >= 65) & (kinds <= 90)).sum()
    lower = ((kinds >= 97) & (kinds <= 122)).sum() + (kinds >= 0xC0).sum()
    digits = ((kinds >= 48) & (kinds <= 57)).sum()
    total = max(1, len(kinds))
    lines = [ln for ln in text.split("\n") if ln.strip()]
    bare = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:'\"?)")
    again = sum(map(str.__eq__, words, words[1:]))
    return [len(joined) / n, again / n, (max(counts.values()) - 1) / n, upper / total, (upper + lower) / total,
            digits / total, (chars - len(joined)) / chars, (total - upper - lower - digits) / total,
            1 - len(set(lines)) / len(lines), bare / n]
