import hashlib
import random

from llm.conftest import as_rows
from tokenizers import Tokenizer

from matchloom.llm import op5_bpe as op


def test_matches_the_library(docs, rows, no_docs):
    lib = Tokenizer.from_file(op.vocabulary())
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        dec = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, dec, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()))
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    assert as_rows(op.bpe(docs, outputs=outputs), "doc_id", *outputs) == sorted(want, key=repr)
    assert op.bpe(no_docs).count() == 0


def test_trie_walk_on_random_words_and_on_the_vocabulary():
    enc, lib = op.TrieEncoder(op.vocabulary(), cache=500), Tokenizer.from_file(op.vocabulary())
    rng = random.Random(9)
    xs = ["", "<|endoftext|>Hello<|startoftext|>", "don't I'LL 1234 ½", "a" * 3000, "ΣΑΣ İ ﬁ"]
    xs += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß'-.,09 !?AB") for _ in range(50)) for _ in range(1000)]
    xs += [" ".join(rng.sample(list(enc.text.values()), 20)) for _ in range(500)]
    xs += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x3000)])) for _ in range(40)) for _ in range(500)]
    for x, (n, ids, dec) in zip(xs, enc.encode(xs, group=2000), strict=True):
        want = lib.encode(x, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), x
        assert n == len(want) and dec == lib.decode(want, skip_special_tokens=False)
