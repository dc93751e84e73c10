"""Token counts and BPE equal the libraries on every code point of Unicode."""

import random
import sys

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from quillstack.llm import bpe, chunks, splits, tokens

EVERY = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def counter():
    path = public_tokenizers.path(tokens.TOKENIZER)
    tok = Tokenizer.from_file(path)
    return tok, tokens.Counter(path, tokens.whole_tokens(path), splits.of_tokenizer(tok))


def test_both_splitters_agree_on_every_code_point():
    tok, count = counter()
    for at in range(0, len(EVERY), 50_000):
        text = "".join(f"x{c}1{c}?{c} {c}\n" for c in EVERY[at:at + 50_000])
        starts = [a for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str(text)]
        own, place = [], 0
        for piece in count.pattern(text):
            own.append(place)
            place += len(piece)
        assert own == starts
    ranks = {bytes([i]): i for i in range(256)}
    for first in "x1?":
        ranks |= {first.encode() + bytes([lead]): len(ranks) + lead for lead in range(0xC0, 0x100)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = splits.Splitter(public_tokenizers.PATTERN, splits.of_tiktoken(public_tokenizers.PATTERN))
    byte = {v: k for k, v in ranks.items()}
    for at in range(0, len(EVERY), 50_000):
        text = "".join(f"x{c} 1{c} ?{c}\n" for c in EVERY[at:at + 50_000])
        joined = [len(byte[i]) > 1 for i in library.encode_ordinary(text) if byte[i][:1] in (b"x", b"1", b"?")]
        own = [len(p.strip()) > 1 for p in split(text) if p.strip()[:1] in ("x", "1", "?")]
        assert own == joined


def test_random_unicode_equals_the_libraries():
    tok, count = counter()
    rng = random.Random(8)
    new = splits.newer()
    assert len(new) > 1000
    texts = ["".join(rng.choice((rng.choice(new), rng.choice(EVERY), rng.choice("ab 1.\n"), "註")) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    assert [count(t) for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    ranks = bpe.ranks_of(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert list(codec.encode_all(texts)) == [library.encode_ordinary(t) for t in texts]


def test_long_texts_go_run_by_run(monkeypatch):
    tok, count = counter()
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", " ", "  ", "\n", "é", "12", "the", "."]) for _ in range(200_000))
    parts = list(chunks.runs(text, 1000))
    assert len(parts) > 100 and " ".join(parts) == text
    monkeypatch.setattr(chunks.runs, "__defaults__", (1000,))
    assert count(text) == len(tok.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(bpe, "GROUP", 1000)
    ranks = bpe.ranks_of(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert list(codec.encode_all(["a b", text, "c d", ""])) == [library.encode_ordinary(t) for t in ("a b", text, "c d", "")]
