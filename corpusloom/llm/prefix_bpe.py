"""Exact BPE by dynamic programming over prefixes, and decoding.

The ids of a word's prefix end in one token that is the same however the word goes on being read
from the left: a token ``t`` that ends at position ``e`` is the last of prefix ``e`` exactly if ``t``
may follow the last token of the prefix before it. Two tokens may stand side by side if the merge
rules, run over their joined text, never merge across their border. So one pass over a word fills
``last[e]`` for every prefix; following back-pointers from the end gives the ids.

* Tokens that end at a position come from an automaton with suffix links over the vocabulary, longest
  first.
* The border test walks the parts of both tokens that touch the border. Parts ``u`` and ``v`` are
  merged across it if their rule comes before the rule that takes ``u`` up, and not after the one
  that takes ``v`` up (among equal rules the leftmost pair goes first).

The end of a word is a symbol of its own that is fused to the last character, as in the vocabulary.

Texts are normalized and cut as the tokenizer file says: canonical composition, white space dropped,
lower case, then words, digits one by one, runs of other signs and English contractions. Workers
remember the ids of pieces between white space, up to a bound; the result never depends on it.

Defined results: a null or empty text gives no ids and an empty text back; ids and other columns of
the rows play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# The cut of the tokenizer file, and the mark of a word's end.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
STOP = "\0"
ODD = re.compile("[\x1c-\x1f]")
# Beyond Latin, Unicode versions differ in letters and cases: the library's own normalizer decides.
RARE = re.compile("[^\0-\u024f]")
REMEMBERED = 300_000
NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PrefixBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        vocab = model["vocab"]
        self.rule: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = {}  # the rule that makes a token; base symbols have none
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = vocab[a], vocab[b]
            self.rule.setdefault(pair, rank)
            token = vocab[a + b]
            if token not in self.parts:
                self.parts[token], self.made[token] = pair, rank
        self.merged = {pair: vocab[self.text_of[pair[0]] + self.text_of[pair[1]]] for pair in self.rule}
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            key = text[: -len(END)] + STOP if text.endswith(END) else text
            self.automaton.add_word(key, (token, len(key)))
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(WORDS).findall
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """Parts of ``token`` that touch its right (1) or left (0) end, with the rule that takes each up."""
        found = known.get(token)
        if found is None:
            found, part, taken = [], token, NEVER
            while True:
                found.append((part, taken))
                if part not in self.parts:
                    break
                taken, part = self.made[part], self.parts[part][side]
            known[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules leave ``a`` and ``b`` apart when one follows the other."""
        answer = self.fits.get((a, b))
        if answer is None:
            rule, answer = self.rule, True
            starts = self._edge(b, 0, self.left)
            for u, u_taken in self._edge(a, 1, self.right):
                for v, v_taken in starts:
                    rank = rule.get((u, v))
                    if rank is not None and rank < u_taken and rank <= v_taken:
                        answer = False
                        break
                if not answer:
                    break
            if len(self.fits) < 4_000_000:
                self.fits[a, b] = answer
        return answer

    def _stands(self, token: int) -> bool:
        """Whether the merge rules build ``token`` from its own text."""
        answer = self.whole.get(token)
        if answer is None:
            parts = self.parts.get(token)
            answer = parts is None or (self._stands(parts[0]) and self._stands(parts[1]) and self._joins(token, *parts))
            self.whole[token] = answer
        return answer

    def _joins(self, token: int, a: int, b: int) -> bool:
        """Whether nothing else is merged across the border of ``a`` and ``b`` before they join."""
        joined = self.made[token]
        for u, u_taken in self._edge(a, 1, self.right):
            for v, v_taken in self._edge(b, 0, self.left):
                rank = self.rule.get((u, v))
                if rank is None or (u, v) == (a, b):
                    continue
                if rank < min(u_taken, joined + (u != a)) and rank <= min(v_taken, joined):
                    return False
        return True

    def _spell(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.letters[b] for b in word.encode("utf-8")])

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word in byte letters."""
        found = self.words.get(word)
        if found is not None:
            return found
        n = len(word) + 1
        last: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        compatible, stands = self.compatible, self._stands
        for end, (token, length) in self.automaton.iter(word + STOP):
            end += 1
            if last[end] is not None:
                continue
            start = end - length
            if start == 0:
                if stands(token):
                    last[end], back[end] = token, 0
            else:
                before = last[start]
                if before is not None and compatible(before, token):
                    last[end], back[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        found = tuple(ids)
        if len(self.words) < REMEMBERED:
            self.words[word] = found
        return found

    def _piece(self, piece: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a piece without white space."""
        if RARE.search(piece):
            plain = self.library.normalizer.normalize_str(piece)
            spelled = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        else:
            spelled = [self._spell(w) for w in self.find(unicodedata.normalize("NFC", piece).lower())]
        ids = [i for w in spelled for i in self.word_ids(w)]
        found = array("I", ids).tobytes(), " ".join([self.text_of[i] for i in ids])
        if len(self.pieces) < REMEMBERED:
            self.pieces[piece] = found
        return found

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        get, make = self.pieces.get, self._piece
        if ODD.search(text):  # no white space to the tokenizer, though to Python
            return [get(p) or make(p) for p in regex.split(r"\s+", text) if p]
        return [get(p) or make(p) for p in text.split()]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as unsigned 32-bit integers in a row, and what they decode to."""
        if any(s in text for s in self.special):
            found = []
            for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
                if part in self.special:
                    found.append((array("I", [self.special[part]]).tobytes(), part))
                else:
                    found += self._plain(part)
        else:
            found = self._plain(text)
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])

    def decode(self, ids: list[int]) -> str:
        """Token texts with spaces between them: the tokenizer file names no decoder."""
        return " ".join([self.text_of[i] for i in ids])


_MODELS: dict[str, PrefixBpe] = {}


def model(path: str) -> PrefixBpe:
    if path not in _MODELS:
        _MODELS[path] = PrefixBpe(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``full`` also ids (binary) and decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = model(tokenizer)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids, decoded = bpe.encode(text)
                row = (
                    len(ids) // 4,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                )
                rows.append(row + (ids, decoded) if full else row)
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, decoded string" if full else ""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)
