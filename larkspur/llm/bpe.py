"""Byte-level BPE by a trie of words.

The last token of each prefix of a word follows from shorter prefixes: token t may end a
prefix if t is a suffix of it, and t stays apart from the last token of what precedes. So
distinct words go into a trie in sorted, that is depth-first, order; each node gets its
last-token state once, and words share the states of their common prefixes. Ids of a word
are read backwards from its states. Words over LONGEST_KEPT bytes are walked in the same way, but leave no
nodes, as they hardly share prefixes. No shuffle: each task keeps its own trie and its own
cache of words, both of bounded size, and leaves nothing to the next task but the vocabulary.

Defined results: null text counts as empty; the empty text has no ids and decodes to the
empty text; repeated rows are encoded alike; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larkspur.llm.common import each

#: Fixed value: the pre-tokenizer's pattern of the byte-level family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points below this are split by the same pattern with their classes written out, which Python's own engine runs faster.
LATIN = 0x250
#: The trie, the cache of words and that of token pairs are emptied at these sizes.
MAX_NODES = 150_000
MAX_WORDS = 120_000
MAX_PAIRS = 150_000
LONGEST_KEPT = 64
#: Code points of documents whose words are held at once.
BLOCK_CHARS = 500_000


def _latin_pattern() -> str:
    """PATTERN for texts of code points below LATIN."""
    letters, numbers, blanks = ("".join(f"\\u{i:04x}" for i in range(LATIN) if regex.match(kind, chr(i))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins for the 256 bytes: themselves, or 256 onwards in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one vocabulary (the text of a tokenizer.json)."""

    def __init__(self, spec: str):
        data, alphabet = json.loads(spec), byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        # a special token is found in the text only as a whole, never made by merges
        self.id_of = {t: i for t, i in vocab.items() if i not in self.special.values()}
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.id_of))
        self.rank, self.parts, self.merge = {i: -1 for i in self.bytes_of}, {}, {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = (raw(p) for p in (pair if isinstance(pair, list) else pair.split(" ")))
            token = self.id_of[left + right]
            self.merge[self.id_of[left], self.id_of[right]] = rank
            if token not in self.parts:
                self.rank[token], self.parts[token] = rank, (self.id_of[left], self.id_of[right])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find_any, self.find_latin = regex.compile(PATTERN).findall, re.compile(_latin_pattern()).findall
        self.beyond_latin = re.compile(f"[^\x00-{chr(LATIN - 1)}]").search
        self.apart: dict[int, bool] = {}
        #: Tokens that merging their own bytes doesn't give; none may end a prefix.
        self.whole = {i: False for i in self.parts if not self.stay_apart_whole(i)}
        #: Ends of tokens, with the token that is all of it, if it may end a prefix.
        self.endings = {t[i:]: -1 for t in self.id_of for i in range(len(t))}
        self.endings |= {t: i for t, i in self.id_of.items() if self.whole.get(i, True)}
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        #: Words since the caches last changed places, and those before.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.state = [-1]
        self.restart()

    def restart(self) -> None:
        """The word before, its prefixes' last tokens and nodes."""
        self.before, self.path, self.nodes = b"", [-1], [0]

    def stay_apart(self, left: int, right: int) -> bool:
        """Undo the later merge of the two again and again; they stay apart unless a pair across the border would have merged before."""
        result = self.untouched(left, right, float("inf"))
        if len(self.apart) >= MAX_PAIRS:
            self.apart.clear()
        self.apart[left << 24 | right] = result
        return result

    def untouched(self, a: int, b: int, limit: float) -> bool:
        """No pair across the border of a and b merges before limit."""
        rank, parts, merge = self.rank, self.parts, self.merge
        while True:
            if (found := merge.get((a, b))) is not None and found < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = min(limit, rank[a]), parts[a][1]
            elif rank[b] >= 0:
                limit, b = min(limit, rank[b] + 1), parts[b][0]
            else:
                return True

    def stay_apart_whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token: its halves form by themselves and stay apart until its own merge."""
        return self.untouched(*self.parts[token], self.rank[token])

    def by_merges(self, word: bytes) -> list[int]:
        """Plain merging by rank, for single tokens and tests."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, at = min((self.merge.get(pair, float("inf")), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == float("inf"):
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    def encode_word(self, word: bytes) -> list[int]:
        """Walk the trie from where the word before it branches off, giving new nodes their last token; then read the states backwards."""
        kept = len(word) <= LONGEST_KEPT
        if kept and len(self.state) + len(word) > MAX_NODES:
            self.reset()
        child, state, endings, apart, path, nodes = self.child, self.state, self.endings, self.apart, self.path, self.nodes
        common = 0
        for x, y in zip(word, self.before):
            if x != y:
                break
            common += 1
        del path[common + 1 :], nodes[common + 1 :]
        node = nodes[-1]
        for end in range(common + 1, len(word) + 1):
            key = node << 8 | word[end - 1]
            token = state[node] if (node := child.get(key, 0)) and kept else -1
            if token < 0:
                for start in range(end - 1, -1, -1):
                    if (found := endings.get(word[start:end])) is None:
                        break
                    if found >= 0:
                        if not start:
                            token = found
                        elif (fits := apart.get(path[start] << 24 | found)) or fits is None and self.stay_apart(path[start], found):
                            token = found
                            break
                if kept:
                    node = child[key] = len(state)
                    state.append(token)
            path.append(token)
            nodes.append(node)
        self.before = word
        if not kept:
            self.restart()
        ids, end, length = [], len(word), self.length
        while end:
            ids.append(path[end])
            end -= length[path[end]]
        return ids[::-1]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words. Those of the cache before are kept if they are asked for again."""
        known = {}
        for word in words:
            if (ids := self.words.get(word)) is not None:
                known[word] = ids
            elif (ids := self.older.get(word)) is not None:
                known[word] = ids
                self.keep(word, ids)
        for word in sorted(words - known.keys()):
            data = word.encode("utf-8", "replace")
            known[word] = ids = array("I", self.encode_word(data)).tobytes()
            if len(data) <= LONGEST_KEPT:
                self.keep(word, ids)
        return known

    def keep(self, word: str, ids: bytes) -> None:
        """Both caches together hold MAX_WORDS at most."""
        if len(self.words) >= max(1, MAX_WORDS // 2):
            self.words, self.older = {}, self.words
        self.words[word] = ids

    def forget(self) -> None:
        """Empty the caches."""
        self.words, self.older = {}, {}
        self.apart.clear()
        self.reset()

    def find_words(self, text: str) -> list[str]:
        return self.find_any(text) if self.beyond_latin(text) else self.find_latin(text)

    def pieces(self, text: str) -> list[tuple[bytes, list[str]]]:
        """(ids of a special token or nothing, words) in order."""
        if not self.split_special or not any(s in text for s in self.special):
            return [(b"", self.find_words(text))]
        parts = self.split_special.split(text)
        return [(np.array([self.special[p]], "<u4").tobytes(), []) if p in self.special else (b"", self.find_words(p)) for p in parts if p]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        get = self.learn({w for doc in split for _, words in doc for w in words}).__getitem__
        return [b"".join(special or b"".join(map(get, words)) for special, words in doc) for doc in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Consecutive runs of texts of about BLOCK_CHARS."""
    block, size = [], 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_loaded: dict[str, TrieBpe] = {}


def _coder(spec: str) -> TrieBpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = TrieBpe(spec)
    return _loaded[key]


def _mapped(docs: DataFrame, vocabulary: str | None, schema: str, row) -> DataFrame:
    """The vocabulary is read once by the driver; its size does not depend on the data."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        coder, fields = _coder(spec.value), [pa.field(*f) for f in row.fields]
        try:
            for batch in batches:
                at = 0
                for block in blocks(each(batch.column("text"))):
                    columns = list(zip(*(row(coder, ids) for ids in coder.encode_block(block))))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(block)), *(pa.array(c, f.type) for c, f in zip(columns, fields))], ["doc_id", *(f.name for f in fields)])
                    at += len(block)
        finally:
            coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _typed(*fields):
    def note(function):
        function.fields = fields
        return function

    return note


@_typed(("ids", pa.list_(pa.int32())),)
def _ids_row(coder: TrieBpe, ids: bytes) -> tuple:
    return (np.frombuffer(ids, "<i4"),)


@_typed(("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
def _digest_row(coder: TrieBpe, ids: bytes) -> tuple:
    decoded = coder.decode(ids).encode("utf-8")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and its token ids."""
    return _mapped(docs, vocabulary, "doc_id long, ids array<int>", _ids_row)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the text decoded from them."""
    return _mapped(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest_row)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text from rows of encode()."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        coder = _coder(spec.value)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
