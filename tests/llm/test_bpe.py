import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from palimpsest.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    content = open(PATH, encoding="utf-8").read()
    return bpe.Tokenizer(content), Library.from_str(content)


def by_merges(word, merges):
    """Merges applied one after the other, each from the left."""
    tokens = [*word[:-1], word[-1] + "</w>"]
    for u, v in merges:
        i, out = 0, []
        while i < len(tokens):
            if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) == (u, v):
                out.append(u + v)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


def test_automaton_as_merges():
    rng = random.Random(1)
    for _ in range(60):
        symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        merges = []
        for _ in range(rng.randint(0, 25)):
            u, v = rng.choice([s for s in symbols if not s.endswith("</w>")]), rng.choice(symbols)
            if u + v not in symbols:
                merges.append((u, v))
                symbols.append(u + v)
        machine = bpe.Automaton({s: i for i, s in enumerate(symbols)}, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [machine.labels[i] for i in machine.encode_word(word)] == by_merges(word, merges), (word, merges)


def test_as_library(both):
    own, library = both
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCDE'é ñß\n\t.,!?<|>endoftxt0123½²Σςİ日本́\x1c\xa0👍🏽"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "don't WE'LL", "x" * 3000, "!" * 500, "ha" * 400, "é", "é"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.written(t) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tables_stay_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 10)
    own = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    own.written(" ".join(f"word{i}" for i in range(200)))
    assert len(own._of_piece) <= 10 and len(own._of_word) <= 10


def test_queries(spark, awkward, nothing, both):
    rows = bpe.digests(awkward, PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in awkward.collect():
        ids = both[1].encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    encoded = bpe.encode(awkward, PATH)
    assert {r["doc_id"]: len(r["ids"]) for r in encoded.collect()} == {w[0]: w[1] for w in want if w[0] is not None} | {None: encoded.where("doc_id is null").collect()[-1]["n_tokens"]}
    decoded = {r["doc_id"]: sha(r["text"]) for r in bpe.decode(encoded.where("doc_id = 7"), PATH).collect()}
    assert decoded[7] == next(w[3] for w in want if w[0] == 7)
    assert bpe.digests(nothing, PATH).count() == 0 and bpe.encode(nothing, PATH).count() == 0
    with pytest.raises(ValueError, match="another kind"):
        bpe.Tokenizer(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
