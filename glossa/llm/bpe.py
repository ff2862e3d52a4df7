"""BPE encoding and decoding of whole texts with a public byte-level vocabulary.

Distinct words (pre-tokens) go into a trie, walked depth first: sorted words
visit its nodes in that order and a word starts where it leaves its
predecessor, so the encoding of a shared prefix is computed once. A node's
state is the last token of its prefix's encoding. The last token of a prefix is
the one vocabulary entry ending there that may follow the last token of the
node where it begins; two tokens may be neighbours exactly when no merge across
their border would have come before the merges that made them. Following last tokens up the trie spells out
the encoding.

The vocabulary file (1.5 MB) is read on the driver and broadcast. A worker
keeps the words it has met, MEMORY bytes at most, and forgets them all beyond that;
nothing is shuffled.

Defined cases: a null text counts as empty, 0 tokens; strings of special
tokens in a text become those tokens; a very long text is encoded whole, and so
is a very long word; rows are encoded each on its own, equal texts alike; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.texts import map_chunks

VOCABULARY = "byte_bpe_50k.json"
MEMORY = 32_000_000  # bytes of remembered words, ENTRY for each beside its letters
ENTRY, PAIRS = 300, 300_000
NEVER = 1 << 30
#: White space of the pre-tokeniser, its pattern for any text, and the same for texts below U+0250.
_WHITE = r"\t-\r \x85\xa0  -     　"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_LOW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_WHITE}{_L}{_N}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")


def byte_alphabet() -> dict[str, int]:
    """The reversible printable alphabet of byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Words to tokens and back, for one vocabulary."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = byte_alphabet()
        raw = lambda piece: bytes(letters[c] for c in piece)
        self.ids = {raw(piece): i for piece, i in spec["model"]["vocab"].items()}
        self.pieces = {i: piece for piece, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.made = {token: (rank, pair) for pair, (rank, token) in self.merges.items()}
        self.ending = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.ending.add_word(piece.decode("latin-1"), (i, len(piece)))
        self.ending.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.neighbours: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.reached: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.text_ids: dict[str, str] = {s: str(i) for s, i in self.special.items()}
        self.decoded: dict[str, bytes] = {s: self.pieces[i] for s, i in self.special.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The plain merge procedure, for the bytes of one token."""
        line = [self.ids[piece[k : k + 1]] for k in range(len(piece))]
        while len(line) > 1:
            best = min((self.merges.get(pair, (NEVER, 0)) + (k,) for k, pair in enumerate(zip(line, line[1:], strict=False))), key=lambda x: (x[0], x[2]))
            if best[0] == NEVER:
                break
            line[best[2] : best[2] + 2] = [best[1]]
        return line

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at one side (0 first, 1 last) of the token while it
        is being merged: (token, rank that makes it, rank that absorbs it)."""
        if (out := self.edges[side].get(token)) is None:
            made, parts = self.made.get(token, (-1, None))
            inner = self.edge(parts[side], side) if parts else []
            out = self.edges[side][token] = [(token, made, NEVER)] + [(t, m, made if end == NEVER else end) for t, m, end in inner]
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those within the two.
        Merges go by rank, the leftmost first, so one across goes before an equal
        one at its right and after an equal one at its left."""
        key = left << 32 | right
        if (known := self.neighbours.get(key)) is None:
            merges, starts = self.merges, self.edge(right, 0)
            known = self.neighbours[key] = not any(
                (across := merges.get((a, b))) and max(made_a, made_b) < min(end_a, end_b) and across[0] < end_a and across[0] <= end_b
                for a, made_a, end_a in self.edge(left, 1)
                for b, made_b, end_b in starts
            )
        return known

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to it."""
        if (known := self.reached.get(token)) is None:
            known = self.reached[token] = self.merge(self.pieces[token]) == [token]
        return known

    def encode_sorted(self, words: list[bytes]):
        """Token ids of distinct words in byte order: the trie walked depth first.
        The automaton names the vocabulary entries that end at a node, the
        longest first."""
        pieces, neighbours, may_follow, stands, ending = self.pieces, self.neighbours, self.may_follow, self.stands, self.ending.iter
        last: list[int] = [0]  # last[d]: last token of the prefix of length d
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            depth = shared
            for at, (token, size) in ending(word.decode("latin-1")):
                if at >= depth:
                    start = at + 1 - size
                    if start:
                        fits = neighbours.get(last[start] << 32 | token)
                        fits = may_follow(last[start], token) if fits is None else fits
                    else:
                        fits = stands(token)
                    if fits:
                        last.append(token)
                        depth += 1
            tokens, depth = [], len(word)
            while depth:
                tokens.append(last[depth])
                depth -= len(pieces[last[depth]])
            before = word
            yield tokens[::-1]

    def learn(self, words: set[str]) -> None:
        """Encode and decode words that aren't known yet."""
        if self.held > MEMORY:
            self.forget()
        if len(self.neighbours) > PAIRS:
            self.neighbours.clear()
        new = sorted(w.encode("utf-8", "surrogatepass") for w in words if w not in self.text_ids)
        for word, tokens in zip(new, self.encode_sorted(new), strict=True):
            name = word.decode("utf-8", "surrogatepass")
            ids = self.text_ids[name] = ",".join(map(str, tokens))
            self.decoded[name] = b"".join([self.pieces[t] for t in tokens])
            self.held += ENTRY + 2 * len(word) + len(ids)

    def words(self, text: str) -> list[str]:
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            return [w for part in parts for w in ([part] if part in self.special else self.words(part))]
        return (_ANY if _BEYOND.search(text) else _LOW).findall(text)

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        ids, decoded = self.text_ids, self.decoded
        return [(",".join([ids[w] for w in words]), b"".join([decoded[w] for w in words]).decode("utf-8", "replace")) for words in split]


@functools.lru_cache(2)
def codec(content: bytes) -> Codec:
    return Codec(content)


def encode_texts(docs: DataFrame, *, doc_id="doc_id", text="text", vocabulary: str | None = None, keep_tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_tokens the ids
    and the decoded text themselves."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(chunk: list[dict]) -> list[tuple]:
        out = []
        for row, (ids, back) in zip(chunk, codec(content.value).encode([r["text"] or "" for r in chunk]), strict=True):
            digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (ids, back)]
            out.append((row["doc_id"], ids.count(",") + 1 if ids else 0, *digests, *((ids, back) if keep_tokens else ())))
        return out

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep_tokens
    coded = map_chunks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), encode, ddl)
    # No ids are an empty string, whose split is one empty string and no number.
    numbers = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return coded.withColumn("ids", numbers) if keep_tokens else coded
