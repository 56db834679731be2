"""BPE encoding and decoding: minimal acyclic transducer lexicon.

Pre-tokens that are frequent in the corpus are compiled, with their token ids as outputs, into a
minimal acyclic transducer: states whose remaining words and outputs are equal are one state
(shared suffixes), and ids are written as early on a path as all words through it agree. Its arcs
are flat arrays in a file in the shared checkpoint folder, which Spark hands to every executor; workers map
it into memory. Texts are cut at blanks into words, and only the distinct words of a slice of texts are looked at:
those the worker does not remember are cut into pre-tokens as the tokenizer cuts them, these walk the transducer
all at the same time, a byte a step, and those it does not accept are merged exactly: every pre-token
merges its lowest-ranked pair, all pre-tokens at once, until none is left. Decoding joins the tokens' bytes and reads
them as UTF-8.

Which pre-tokens are frequent is found by a Misra-Gries summary per task (``SUMMARY`` counters: a word
with more than a SUMMARY-th of a task's words is never missed), summed by Spark; the ``lexicon_words`` most
frequent are compiled. The choice decides speed alone: ids are the same with any lexicon.

Supported are byte-level BPE tokenizers without a normaliser whose merges each make a new token from
earlier ones (checked when loaded); then merging all pairs of the lowest rank at once equals merging them one
by one. Added tokens are found first, as the tokenizer does. Character classes come from the tokenizer itself.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded separately; a null doc_id stays null; an empty table gives an empty table; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import mmap
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import texts
from seqlake.llm.ragged import byte_slices, offsets_of, spread
from seqlake.session import checkpoint_dir

SUMMARY = 1 << 15          # counters of a task's summary of frequent words
LEXICON_WORDS = 1 << 16    # words compiled
WORD_BYTES = 64            # longer words are neither compiled nor remembered
SLICE_BYTES = 8 << 20      # of text encoded together
CACHE_BYTES = 48 << 20     # of words, and of pre-tokens, remembered by a worker, in either of two generations
ENTRY_BYTES = 200          # a remembered word besides its letters and ids
NO_PAIR = np.int64(1) << 40

# The public pattern of byte-level BPE pre-tokens (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START, LINE = "\x01", "\n"      # a word that begins a text is marked, one that begins a line keeps its break
# Texts with other white space than single blanks and line breaks, or with the mark, are cut by _BOUNDARY.
_ODD = "  |\n | \n|\n\n|[\x01\t\r\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]"
_BOUNDARY = re.compile("(?<=[^\\s\u180e\u200b])(?= )")
# Latin letters with a blank before or not, then punctuation: two pre-tokens with any version of the classes.
_SIMPLE = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


def cut_words(text: pa.Array, added: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words one after the other, their offsets by text, numbers of the odd texts, which have no words here).
    No pre-token spans two words. A word stands for itself after a blank, but for one that begins a text
    (after START) or a line (after LINE)."""
    odd = pc.match_substring_regex(text, _ODD)
    for token in added:
        odd = pc.or_(odd, pc.match_substring(text, token))
    plain = pc.if_else(pc.or_(odd, pc.equal(text, "")), pa.scalar(None, text.type), text)
    words = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(START, text.type), plain, pa.scalar("", text.type)), LINE, " " + LINE), " ")
    at = np.zeros(len(text) + 1, dtype=np.int64)
    np.cumsum(pc.list_value_length(words).fill_null(0), out=at[1:])
    return words.flatten(), at, np.flatnonzero(odd)


def spelled(word: str) -> str:
    """The text a word stands for."""
    return word[1:] if word[:1] == START else word if word[:1] == LINE else " " + word


# ---------------------------------------------------------------- transducer

def compile_lexicon(words: list[bytes], ids: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The minimal transducer of the distinct, non-empty, sorted ``words``, built a word at a time: what the next
    word no longer shares is frozen, and a frozen state equal to an earlier one is replaced by it. State 0 is the start."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    # a state under construction: [accepting, ids on acceptance, {byte: [target, ids]}]
    path, last = [[False, (), {}]], b""

    def freeze(down_to: int) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            accepting, out, arcs = path.pop()
            made = (accepting, out, tuple((b, t, o) for b, (t, o) in arcs.items()))
            number = register.setdefault(made, len(states) + 1)
            if number > len(states):
                states.append(made)
            path[-1][2][last[depth - 1]][0] = number

    for word, out in zip(words, ids):
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for depth in range(shared):    # ids stay on the path as far as both words agree, the rest moves on
            arc, below = path[depth][2][word[depth]], path[depth + 1]
            common = 0
            while common < min(len(arc[1]), len(out)) and arc[1][common] == out[common]:
                common += 1
            moved = arc[1][common:]
            if moved:
                arc[1] = arc[1][:common]
                for other in below[2].values():
                    other[1] = moved + other[1]
                if below[0]:
                    below[1] = moved + below[1]
            out = out[common:]
        for depth in range(shared, len(word)):
            path[-1][2][word[depth]] = [0, out if depth == shared else ()]
            path.append([False, (), {}])
        path[-1][0] = True
        path[-1][1] = out if shared == len(word) else ()
        last = word
    freeze(0)
    accepting, out, arcs = path[0]
    states.insert(0, (accepting, out, tuple((b, t, o) for b, (t, o) in arcs.items())))

    pool: dict[tuple, int] = {}
    flat: list[int] = []

    def pooled(o: tuple) -> int:
        if o not in pool:
            pool[o] = len(flat)
            flat.extend(o)
        return pool[o]

    keys, targets, at, size = [], [], [], []
    for s, (_, _, arcs) in enumerate(states):
        for b, t, o in sorted(arcs):
            keys.append(s << 8 | b)
            targets.append(t)
            at.append(pooled(o))
            size.append(len(o))
    final = [(pooled(o), len(o)) if acc else (0, -1) for acc, o, _ in states]
    return {"key": np.array(keys, np.int64), "target": np.array(targets, np.int64), "at": np.array(at, np.int64),
            "size": np.array(size, np.int64), "final_at": np.array([a for a, _ in final], np.int64),
            "final_size": np.array([n for _, n in final], np.int64), "ids": np.array(flat, np.int64)}


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A JSON line with names and lengths, then the arrays."""
    head = json.dumps([(k, len(v)) for k, v in arrays.items()]).encode() + b"\n"
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(v.astype("<i8").tobytes() for v in arrays.values())


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, mapped into memory."""
    with open(path, "rb") as f:
        return mapped_from(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def mapped_from(whole) -> dict[str, np.ndarray]:
    """The arrays in a buffer of that form, without a copy."""
    at = 8 + int.from_bytes(whole[:8], "little")
    out = {}
    for name, n in json.loads(whole[8:at]):
        out[name] = np.frombuffer(whole, dtype="<i8", count=n, offset=at)
        at += 8 * n
    return out


def look_up(lexicon: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray, length: np.ndarray):
    """(accepted, id counts, ids one after the other) of the words data[at:at+length], all walking at the same time."""
    n = len(at)
    state, alive = np.zeros(n, dtype=np.int64), np.arange(n)
    who, out_at, out_size = [], [], []
    key, edges = lexicon["key"], len(lexicon["key"])
    for step in range(int(length.max(initial=0))):
        alive = alive[length[alive] > step]
        want = state[alive] << 8 | data[at[alive] + step].astype(np.int64)
        arc = np.searchsorted(key, want)
        good = (arc < edges) & (key[np.minimum(arc, edges - 1)] == want) if edges else np.zeros(len(alive), dtype=bool)
        state[alive[~good]] = -1
        alive, arc = alive[good], arc[good]
        state[alive] = lexicon["target"][arc]
        says = lexicon["size"][arc] > 0
        who.append(alive[says])
        out_at.append(lexicon["at"][arc[says]])
        out_size.append(lexicon["size"][arc[says]])
    accepted = state >= 0
    end = lexicon["final_size"][np.maximum(state, 0)]
    accepted &= end >= 0
    says = np.flatnonzero(accepted & (end > 0))
    who.append(says)
    out_at.append(lexicon["final_at"][state[says]])
    out_size.append(end[says])
    who, out_at, out_size = (np.concatenate(x).astype(np.int64) for x in (who, out_at, out_size))
    keep = accepted[who]
    who, out_at, out_size = who[keep], out_at[keep], out_size[keep]
    order = np.argsort(who, kind="stable")    # steps were appended in order
    ids = lexicon["ids"][spread(out_at[order], out_size[order])]
    return accepted, np.bincount(who, weights=out_size, minlength=n).astype(np.int64), ids


# ---------------------------------------------------------------- exact merging

class Classes(dict):
    """Stand-ins of the characters beyond ASCII: one ASCII character of the same class, asked from the tokenizer."""

    def __init__(self, pre_tokenizer):
        self.cut = pre_tokenizer.pre_tokenize_str

    def __missing__(self, point: int) -> int:
        if point < 0x80:
            stand_in = point
        else:
            c = chr(point)
            stand_in = next((ord(s) for s in "q1!" if len(self.cut(s + c)) == 1), 9)
        self[point] = stand_in
        return stand_in


class BytePairs:
    """The vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (spec.get("normalizer") or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
                or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout")):
            raise ValueError("only byte-level BPE without a normaliser is supported")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]    # bytes that stand for themselves
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
        vocab = model["vocab"]
        self.token = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in byte_of.items():
            self.of_byte[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if a + b in made or made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("merges must each make a new token from earlier ones")
            made[a + b] = rank
        self.size = max(vocab.values()) + 1
        table = np.array(sorted((vocab[a] * self.size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)) + [(1 << 62, 0, 0)])
        self.pair, self.rank, self.merged = table.T.astype(np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must match exactly as they are")
        self.token |= {i: c.encode() for c, i in self.added.items()}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.classes, self.pattern = Classes(Tokenizer.from_file(tokenizer_file).pre_tokenizer), regex.compile(PATTERN)

    def pre_tokens(self, text: str) -> list[str]:
        simple = _SIMPLE.fullmatch(text)
        if simple:
            return [simple[1], simple[2]] if simple[2] else [text]
        if text.isascii():
            return self.pattern.findall(text)
        out, at = [], 0
        for piece in self.pattern.findall(text.translate(self.classes)):
            out.append(text[at:at + len(piece)])
            at += len(piece)
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], NO_PAIR), self.merged[at]

    def merge(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many) of non-empty pre-tokens: in every round each merges all its pairs of lowest rank."""
        if not units:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        length = np.array([len(u) for u in units], dtype=np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(units), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(units)), length)
        rank, merged = np.full(len(sym), NO_PAIR), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], merged[inner] = self._rank(sym[inner], sym[inner + 1])
        done_sym, done_seq = [], []
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, start)
            low = np.repeat(low, np.diff(np.r_[start, len(seq)]))
            over = low == NO_PAIR
            if over.any():
                done_sym.append(sym[over])
                done_seq.append(seq[over])
                sym, seq, rank, merged, low = (x[~over] for x in (sym, seq, rank, merged, low))
            if not len(sym):
                break
            hit = np.flatnonzero(rank == low)
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1)]              # of a run of overlapping pairs every other one, from the left
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep)[hit] - 1
            sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
            near = np.zeros(len(sym) + 1, dtype=bool)                   # pairs with a merged symbol; the last place stands for -1
            near[place] = near[place - 1] = True
            todo = np.flatnonzero(near[:-1])
            rank[todo] = NO_PAIR
            todo = todo[todo < len(sym) - 1]
            todo = todo[seq[todo] == seq[todo + 1]]
            rank[todo], merged[todo] = self._rank(sym[todo], sym[todo + 1])
        sym, seq = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_seq))
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(units))

    def merged_bytes(self, units: list[str]) -> list[bytes]:
        """The ids (little-endian uint32) of distinct pre-tokens, merged exactly."""
        ids, n = self.merge([u.encode("utf-8", "replace") for u in units])
        raw, at = ids.astype("<u4").tobytes(), (4 * offsets_of(n)).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


# ---------------------------------------------------------------- the codec

class Memory:
    """What was made for short keys, in two generations bounded in bytes: what is not asked for in the newer one goes."""

    def __init__(self, limit: int | None = None):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held, self.limit = 0, limit or CACHE_BYTES

    def recall(self, keys: list[str], make) -> list[bytes]:
        """The values of distinct keys; ``make`` gives those of a list of keys not remembered."""
        found = list(map(self.known.get, keys))
        gaps = [i for i, x in enumerate(found) if x is None]
        for i in gaps if self.older else ():
            found[i] = self.older.get(keys[i])
        new = [i for i in gaps if found[i] is None]
        for i, x in zip(new, make([keys[i] for i in new]) if new else ()):
            found[i] = x
        for i in gaps:
            key, x = keys[i], found[i]
            if len(key) <= WORD_BYTES:
                self.known[key] = x
                self.held += len(key) + len(x) + ENTRY_BYTES
        if self.held > self.limit:
            self.known, self.older, self.held = {}, self.known, 0
        return found


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, tokenizer_file: str, lexicon: dict[str, np.ndarray] | None = None):
        self.pairs, self.lexicon = BytePairs(tokenizer_file), lexicon
        self.words, self.units = Memory(), Memory()
        size = max(self.pairs.token) + 1
        length = np.zeros(size, dtype=np.int64)
        for i, t in self.pairs.token.items():
            length[i] = len(t)
        self.token_at, self.token_size = offsets_of(length), length
        self.token_bytes = np.frombuffer(b"".join(self.pairs.token.get(i, b"") for i in range(size)), dtype=np.uint8)

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens: those that the transducer accepts have them there, the others are merged."""
        if self.lexicon is None:
            return self.pairs.merged_bytes(units)
        raw = [u.encode("utf-8", "replace") for u in units]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        short = length <= WORD_BYTES
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        accepted, n, ids = look_up(self.lexicon, data, offsets_of(length)[:-1], np.where(short, length, 0))
        ids, at = ids.astype("<u4").tobytes(), (4 * offsets_of(n)).tolist()
        accepted = (accepted & short).tolist()
        merged = iter(self.pairs.merged_bytes([u for u, a in zip(units, accepted) if not a]))
        return [ids[x:y] if a else next(merged) for a, x, y in zip(accepted, at, at[1:])]

    def text_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of short texts from their pre-tokens."""
        cut = [self.pairs.pre_tokens(t) for t in texts]
        distinct = list({u for us in cut for u in us})
        known = dict(zip(distinct, self.units.recall(distinct, self.unit_ids)))
        return [known[us[0]] if len(us) == 1 else b"".join([known[u] for u in us]) for us in cut]

    def word_ids(self, words: list[str]) -> list[bytes]:
        return self.text_ids(list(map(spelled, words)))

    def _odd(self, text: str) -> bytes:
        """The ids of a text with an added token or odd white space."""
        parts = self.pairs.find_added.split(text) if self.pairs.find_added else [text]
        return b"".join([b"".join(self.text_ids(_BOUNDARY.split(p))) if i % 2 == 0 else np.array([self.pairs.added[p]], "<u4").tobytes()
                         for i, p in enumerate(parts)])      # every second part is an added token

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many of each text) of texts without nulls."""
        words, at, odd = cut_words(text, list(self.pairs.added))
        coded = words.dictionary_encode()
        which = np.asarray(coded.indices)
        raw = self.words.recall(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.word_ids)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        flat, first = np.frombuffer(b"".join(raw), "<u4"), offsets_of(size)[:-1]
        n_word = size[which]
        ids = flat[spread(first[which], n_word)]
        begin = offsets_of(n_word)[at]
        n = np.diff(begin)
        if len(odd):
            pieces, here = [], 0
            for i in odd.tolist():
                own = np.frombuffer(self._odd(text[i].as_py()), "<u4")
                pieces += (ids[here:begin[i]], own)
                here, n[i] = begin[i], len(own)
            ids = np.concatenate([*pieces, ids[here:]])
        return ids, n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The texts of ids, n[0] of the first one, n[1] of the second, and so on."""
        size = self.token_size[ids]
        data = self.token_bytes[spread(self.token_at[ids], size)]
        at = offsets_of(size)[offsets_of(n)]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:       # ids that cut a character
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())


@lru_cache(maxsize=1)
def codec_of(tokenizer_file: str, lexicon_name: str) -> Codec:
    """The worker's codec with its mapped lexicon, kept for its later tasks."""
    from pyspark import SparkFiles
    return Codec(tokenizer_file, mapped(SparkFiles.get(lexicon_name)))


class Summary:
    """Misra-Gries: at most ``size`` counters; a word's count falls short by less than all words / size."""

    def __init__(self, size: int = SUMMARY):
        self.size, self.counts = size, Counter()

    def add(self, words: pa.Array) -> None:
        """Words with repeats; a summary of their own is made first, and the two are added."""
        counted = words.value_counts()
        distinct, n = counted.field(0), np.asarray(counted.field(1))
        if len(n) > self.size:
            n = n - np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1]
            distinct, n = distinct.filter(pa.array(n > 0)), n[n > 0]
        for w, k in zip(distinct.to_numpy(zero_copy_only=False).tolist(), n.tolist()):
            self.counts[w] += k
        if len(self.counts) > 4 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            n = np.fromiter(self.counts.values(), dtype=np.int64, count=len(self.counts))
            least = int(np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1])
            self.counts = Counter({w: c - least for w, c in self.counts.items() if c > least})


def frequent_pre_tokens(docs: DataFrame, tokenizer_file: str, lexicon_words: int) -> list[str]:
    """The pre-tokens of the corpus' frequent words, at most ``lexicon_words`` of at most WORD_BYTES bytes. Odd texts do not count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, pairs = Summary(), BytePairs(tokenizer_file)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            summary.add(cut_words(part.column("text").combine_chunks(), list(pairs.added))[0])
        summary.shrink()
        found = Counter()
        for w, n in summary.counts.items():
            for u in pairs.pre_tokens(spelled(w)):
                if len(u.encode("utf-8", "replace")) <= WORD_BYTES:
                    found[u] += n
        yield pa.record_batch({"unit": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.select("text").mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r["unit"] for r in counted.orderBy(F.desc("n"), "unit").limit(lexicon_words).collect()]


def share_file(spark, content: bytes) -> str:
    """Write ``content`` to the shared checkpoint folder and hand it to all executors; returns the name for SparkFiles.get."""
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    fs = path.getFileSystem(conf)
    out = fs.create(path)
    out.write(bytearray(content))
    out.close()
    fs.deleteOnExit(path)
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def encode_decode(docs: DataFrame, tokenizer_file: str, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian uint32, decoded the text made from the ids alone."""
    spark, plain = docs.sparkSession, texts(docs, id_col, text_col)
    units = sorted(frequent_pre_tokens(plain, tokenizer_file, lexicon_words), key=lambda u: u.encode("utf-8", "replace"))
    ids = [tuple(np.frombuffer(x, "<u4").tolist()) for x in BytePairs(tokenizer_file).merged_bytes(units)]
    name = share_file(spark, to_bytes(compile_lexicon([u.encode("utf-8", "replace") for u in units], ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_file, name)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            ids, n = codec.encode(part.column("text").combine_chunks())
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * offsets_of(n)), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.record_batch({"doc_id": part.column("doc_id").combine_chunks(), "n_tokens": n, "ids": raw.cast(pa.binary()),
                                   "decoded": codec.decode(ids, n).cast(pa.string())})

    return plain.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
