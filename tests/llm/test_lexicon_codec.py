"""op13: the transducer against a dictionary, ids and decoded texts against the tokenizers library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from seqlake.llm import lexicon_codec as lc
from seqlake.llm import queries
from seqlake.llm.ragged import offsets_of
from llm_tables import docs

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def walk(lexicon, words):
    raw = [w.encode() for w in words]
    n = np.array([len(r) for r in raw], dtype=np.int64)
    accepted, count, ids = lc.look_up(lexicon, np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), offsets_of(n)[:-1], n)
    at = offsets_of(count)
    return [tuple(ids[at[i]:at[i + 1]].tolist()) if a else None for i, a in enumerate(accepted)]


def test_transducer_accepts_its_words_with_their_outputs():
    rng = random.Random(1)
    for alphabet, size in (("ab", 60), ("abcdef", 300), ("é x", 80)):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(size)}, key=str.encode)
        outs = [tuple(rng.randrange(4) for _ in range(rng.randrange(1, 4))) for _ in words]
        lexicon = lc.mapped_from(lc.to_bytes(lc.compile_lexicon([w.encode() for w in words], outs)))
        asked = words + [w + "a" for w in words] + [w[:-1] for w in words if len(w) > 1] + ["", "zzz"]
        known = dict(zip(words, outs))
        assert walk(lexicon, asked) == [known.get(w) for w in asked]


def test_transducer_is_minimal():
    """Words that share suffixes and outputs share states: as many as there are different rests (with outputs)."""
    stems, ends = ["walk", "talk", "jump", "rest"], ["", "ed", "er", "ing", "s"]
    words = sorted((s + e).encode() for s in stems for e in ends)
    ids = [(stems.index(next(s for s in stems if w.decode().startswith(s))), 10 + len(w)) for w in words]
    same = lc.compile_lexicon(words, [(7,) for _ in words])
    rests = {frozenset(w[i:] for w in words if w[:i] == p) for x in words for i in range(len(x) + 1) for p in [x[:i]]}
    assert len(same["final_size"]) == len(rests)
    assert len(lc.compile_lexicon(words, ids)["final_size"]) <= len(rests) + len(stems) * 4
    empty = lc.compile_lexicon([], [])
    assert walk(empty, ["a"]) == [None]


def odd_texts():
    rng = random.Random(7)
    chars = " \n\t\u00a0\u2003'sdlmtreav019!?.\u00e9\u00df\u4e2d\U0001f600\u0301\u0660\u200b\u180e\x1c\x85\u0558\ua7ce"
    out = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    out += ["", " ", "\n", "  a  b ", "don't we'll I'm 'tis", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext|", "a" * 3000,
            "ab" * 2500, "the cat " * 4000, "\u4e2d" * 500, "0" * 100 + " " * 100 + "z"]
    return out


def ids_of(codec, texts):
    ids, n = codec.encode(pa.array(texts, pa.string()))
    at = offsets_of(n)
    return [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))]


def test_codec_equals_the_library(library):
    texts = odd_texts() + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    pairs = lc.BytePairs(FILE)
    units = sorted({u for t in texts[-100:] for u in pairs.pre_tokens(t) if len(u) < 30}, key=str.encode)
    ids = [tuple(np.frombuffer(x, "<u4").tolist()) for x in pairs.merged_bytes(units)]
    lexicon = lc.compile_lexicon([u.encode() for u in units], ids)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for codec in (lc.Codec(FILE), lc.Codec(FILE, lexicon)):
        assert ids_of(codec, texts) == want
        n = np.array([len(x) for x in want])
        assert codec.decode(np.array([i for x in want for i in x]), n).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]
        assert ids_of(codec, []) == []
    # ids that cut a character in two decode to replacement characters, as in the library
    broken = [int(i) for i in (pairs.of_byte[0xE4], pairs.of_byte[0x61], pairs.of_byte[0xB8], 50256)]
    assert codec.decode(np.array(broken), np.array([4])).to_pylist() == [library.decode(broken, skip_special_tokens=False)]


def test_every_character_is_cut_as_the_library_cuts_it(library):
    pairs = lc.BytePairs(FILE)
    for block in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)} !{chr(c)}?" for c in range(block, block + 64))
        assert pairs.pre_tokens(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_memory_is_bounded_and_results_stay(library, monkeypatch):
    monkeypatch.setattr(lc, "CACHE_BYTES", 5000)
    rng, codec = random.Random(3), lc.Codec(FILE)
    for _ in range(20):
        batch = [" ".join(rng.choice(["alpha", "beta", "w" * 90, f"n{rng.randrange(200)}"]) for _ in range(40)) for _ in range(5)]
        assert ids_of(codec, batch) == [library.encode(t).ids for t in batch]
        for memory in (codec.words, codec.units):
            assert not any(len(w) > lc.WORD_BYTES for w in memory.known)
            assert memory.held <= 5000 and len(memory.older) < 100


def test_summary_never_misses_a_frequent_word():
    rng, s = random.Random(4), lc.Summary(size=20)
    words = [f"r{rng.randrange(5000)}" if rng.random() < 0.6 else f"f{rng.randrange(4)}" for _ in range(20_000)]
    for i in range(0, len(words), 50):
        s.add(pa.array(words[i:i + 50]))
    s.shrink()
    assert len(s.counts) <= 20 and {f"f{i}" for i in range(4)} <= set(s.counts)
    assert all(0 <= words.count(f"f{i}") - s.counts[f"f{i}"] <= len(words) / 20 for i in range(4))


def test_encode_decode_of_odd_tables(spark, library):
    rows = [(1, "the cat sat on the mat", "s"), (2, None, "s"), (3, "", "s"), (None, "no id <|endoftext|>", None), (4, "the " * 20_000, "s"),
            (5, "\u00e9 \t x", "s"), (5, "\u00e9 \t x", "s")]
    got = lc.encode_decode(docs(spark, rows), FILE, lexicon_words=3).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got) == sorted(
        (i or 0, len(library.encode(t or "").ids), library.encode(t or "").ids, t or "") for i, t, _ in rows)
    assert lc.encode_decode(docs(spark, []), FILE).count() == 0


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    want = {}
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op13_bpe_codec"](spark, folder).collect()}
    assert got == want
