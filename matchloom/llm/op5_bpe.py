"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding is decided left to right by its last tokens: the last token of a prefix `p` is the one token `t`
that ends `p` and may follow the last token of `p` without `t`. The distinct words of a batch form a trie; their sorted
order is its depth-first order, so the walk keeps one state (the last token) per depth of the current path and goes
back only to the first symbol in which the next word differs. Encodings of shared prefixes are computed once, and
memory is the longest word plus a bounded cache of finished words.

Defined results: a null or empty text has no tokens and empty outputs; repeated rows give repeated results; texts and
words of any length are encoded whole (the walk is linear in them).
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from matchloom.llm.common import map_batches, narrow, str_texts

END = 256  # added to the last symbol of a word
OUTPUTS = {"n_tokens": "n_tokens long", "ids": "ids array<int>", "decoded": "decoded string", "ids_sha256": "ids_sha256 string", "decoded_sha256": "decoded_sha256 string"}


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder of one vocabulary file with word ends; `words` encodes many distinct words in one traversal."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        symbols = byte_symbols()

        def inner(token: str) -> str:
            ends = token.endswith(self.suffix)
            body = [symbols[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + END * ends)

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        self.by_symbols = {inner(t): i for t, i in model["vocab"].items() if t not in special}
        self.length = {i: len(s) for s, i in self.by_symbols.items()}
        self.longest = max(self.length.values())
        self.merged, self.parts, self.rank = {}, {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = model["vocab"][a + b]
            pair = (model["vocab"][a], model["vocab"][b])
            self.merged.setdefault(pair, (r, whole))
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, r
        #: Tokens that their own merges really build; others never come out of an encoding.
        self.built: set[int] = {i for i, n in self.length.items() if n == 1}
        for whole, (a, b) in self.parts.items():  # in order of rank, so parts come first
            if a in self.built and b in self.built:
                self.built.add(whole)
        self.pairs: dict[int, bool] = {}
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.cached = cache
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_ids = special
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.plain = regex.compile(r"[\x00-ɏ]*")
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.library = Tokenizer.from_file(path)
        self.symbols = symbols
        self.spaces = regex.compile(r"\p{White_Space}+")

    def follows(self, a: int, b: int) -> bool:
        """Whether the tokens a, b side by side stay as they are, whatever merges run inside them.

        Undo the merges at the seam from the latest on; the pair is broken as soon as a merge across the seam
        would have come before the merge that hides it.
        """
        left, right, ok = a, b, True
        before = 1 << 60  # a merge across the seam counts only if it ran earlier than this one
        strict = True
        while True:
            m = self.merged.get((left, right))
            if m and (m[0] < before if strict else m[0] <= before):
                ok = False
                break
            rl, rr = self.rank.get(left, -1), self.rank.get(right, -1)
            if rl < 0 and rr < 0:
                break
            if rl > rr:  # the left token was made last; merges run left to right at one rank
                before, strict, left = rl, True, self.parts[left][1]
            elif rr > rl:
                before, strict, right = rr, False, self.parts[right][0]
            else:
                before, strict, right = rr, False, self.parts[right][0]
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[a << 20 | b] = ok
        return ok

    def words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct symbol strings (see `symbols`) by one depth-first walk over their trie."""
        out: dict[str, tuple[int, ...]] = {}
        get, follows, length, longest, whole, known = self.by_symbols.get, self.follows, self.length, self.longest, self.built, self.pairs
        last: list[int] = [-1]
        before = ""
        for w in sorted(words):
            n, depth = len(w), 0
            stop = min(n, len(before))
            while depth < stop and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, n + 1):
                found = -1
                # one token fits; the longer form of the last one is the likeliest
                first = end - 1 - length[last[-1]] if end > 1 else 0
                for start in (first, *range(end - 1, max(-1, end - longest - 1), -1)):
                    t = get(w[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        ok = t in whole
                    else:
                        a = last[start]
                        ok = known.get(a << 20 | t)
                        if ok is None:
                            ok = follows(a, t)
                    if ok:
                        found = t
                        break
                last.append(found)
            ids, end = [], n
            while end:
                ids.append(last[end])
                end -= length[last[end]]
            out[w] = tuple(ids[::-1])
            before = w
        return out

    def pieces(self, chunk: str) -> list[int | str]:
        """Pieces of a text without white space: symbol strings, and ids of special tokens written out in it."""
        out: list[int | str] = []
        at = 0
        if self.special and "<" in chunk:
            for m in self.special.finditer(chunk):
                out += self.pieces_plain(chunk[at : m.start()])
                out.append(self.special_ids[m.group()])
                at = m.end()
        return out + self.pieces_plain(chunk[at:])

    def pieces_plain(self, chunk: str) -> list[int | str]:
        if not self.plain.fullmatch(chunk):  # the library's own Unicode tables decide
            parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            found = ["".join(chr(self.symbols[c]) for c in p) for p, _ in parts if p]
            return [s[:-1] + chr(ord(s[-1]) + END) for s in found]
        out: list[int | str] = []
        for p in self.split.findall(chunk.lower()):
            s = p.encode("utf-8", "surrogatepass").decode("latin-1")
            out.append(s[:-1] + chr(ord(s[-1]) + END))
        return out

    def chunks(self, text: str) -> list[str]:
        return [c for c in self.spaces.split(text) if c] if self.odd_space.search(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Put ids and decoded text of the chunks that are not there into the caches; full caches keep what these chunks use."""
        if len(self.ids) + len(chunks) > self.cached:
            used = chunks & self.ids.keys()
            self.ids = {c: self.ids[c] for c in used}
            self.decoded = {c: self.decoded[c] for c in used}
        plain: dict[str, str] = {}  # a chunk of ASCII letters, the usual case, is one piece
        mixed: dict[str, list[int | str]] = {}
        for c in chunks - self.ids.keys():
            if c.isascii() and c.isalpha():
                low = c.lower()
                plain[c] = low[:-1] + chr(ord(low[-1]) + END)
            else:
                mixed[c] = self.pieces(c)
        enc = self.words(list({*plain.values(), *(p for ps in mixed.values() for p in ps if isinstance(p, str))}))
        text = self.text.__getitem__
        for c, p in plain.items():
            self.ids[c] = " ".join(map(str, enc[p]))
            self.decoded[c] = " ".join(map(text, enc[p]))
        for c, ps in mixed.items():
            ids = [t for p in ps for t in ([p] if isinstance(p, int) else enc[p])]
            self.ids[c] = " ".join(map(str, ids))
            self.decoded[c] = " ".join(map(text, ids))

    def encode(self, texts: list[str], group: int = 1 << 22):
        """(tokens, ids joined by a space, decoded text) of each text; texts are worked through in groups of bounded size."""
        at = 0
        while at < len(texts):
            end, size, split = at, 0, []
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= group):
                size += len(texts[end])
                split.append(self.chunks(texts[end]))
                end += 1
            self.learn(set().union(*split))
            ids_of, decoded_of = self.ids.__getitem__, self.decoded.__getitem__
            for cs in split:
                ids = " ".join(map(ids_of, cs))
                yield ids.count(" ") + bool(ids), ids, " ".join(map(decoded_of, cs))
            at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One per worker process, so finished words serve later tasks too."""
    return TrieEncoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bpe(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the named outputs of every row; `path` is a vocabulary file that every worker can read."""
    path = path or vocabulary()

    def make():
        enc = encoder(path)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: dict[str, list] = {o: [] for o in outputs}
            for n, ids, decoded in enc.encode(str_texts(b)):
                for o, to in cols.items():
                    if o == "n_tokens":
                        to.append(n)
                    elif o == "ids":
                        to.append([int(i) for i in ids.split()])
                    elif o == "decoded":
                        to.append(decoded)
                    else:
                        to.append(hashlib.sha256((ids if o == "ids_sha256" else decoded).encode("utf-8", "surrogatepass")).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, kinds.get(o, pa.string())) for o, v in cols.items()]], ["doc_id", *cols])

        return step

    return map_batches(narrow(docs, "doc_id", "text"), make, ", ".join(["doc_id long", *[OUTPUTS[o] for o in outputs]]))
