"""Texts to ids with a byte-level tokenizer of the ``tokenizers`` library, remembering words.

The tokenizer encodes each word on its own, so a text's ids are the ids of its words in a row. Each
worker keeps the ids of words it has met and hands the library only new ones.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

# Control characters that Python counts as white space and the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")
OTHER = re.compile(r"[^\S \n]")
GAPS = " \n"
PAIRS = [a + b for a in GAPS for b in GAPS]
RUNS = re.compile(r"(\s*)(\S*)")
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
REMEMBERED = 700_000
_ENCODERS: dict[str, Callable] = {}


def _words(text: str) -> list[str] | None:
    """Words, with the line end in front of a line's first one, as if one stood before the text.

    None unless single spaces and single line ends are all the white space, and only between words.
    """
    if not text or text[0] in GAPS or text[-1] in GAPS or any(pair in text for pair in PAIRS) or OTHER.search(text):
        return None
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


def _pieces(text: str) -> list[str]:
    """``text`` cut where the tokenizer always cuts: before the last white space of a run.

    A single space belongs to the word after it; any other last character of a run stands alone,
    and so does what precedes it.
    """
    out = []
    for m in RUNS.finditer(text):
        gap, word = m[1], m[2]
        if gap and not word:
            out.append(gap)
        elif gap.endswith(" "):
            out += [gap[:-1], " " + word] if len(gap) > 1 else [" " + word]
        elif gap:
            out += [gap[:-1], gap[-1], word] if len(gap) > 1 else [gap, word]
        elif word:
            out.append(word)
    return out


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian uint32; one per worker and file."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def raw(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    line_end = raw(["\n"])[0]
    known: dict[str, bytes] = {}
    tails = {"": b""}

    def learn(words: set[str]) -> list[str]:
        """Note the ids of new words, and name what was noted; signs at the end of letters are cut off, as the tokenizer does."""
        if len(tails) > REMEMBERED:
            tails.clear()
            tails[""] = b""
        cores, cut = set(), {}
        for w in words:
            core = w if w[-1:].isalpha() else w.rstrip(SIGNS)
            if len(core) < len(w) and core[-1:].isalpha():
                cut[w] = core, w[len(core) :]
                if core not in known:
                    cores.add(core)
            else:
                cores.add(w)
        fresh = list(cores)
        ends = [e for e in {e for _, e in cut.values()} if e not in tails]
        ids = raw([w[1:] if w[:1] == "\n" else " " + w for w in fresh] + ends)
        tails.update(zip(ends, ids[len(fresh) :]))
        known.update([(w, line_end + i if w[:1] == "\n" else i) for w, i in zip(fresh, ids)])
        known.update([(w, known[c] + tails[e]) for w, (c, e) in cut.items()])
        return [*fresh, *cut]

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for low in range(0, len(texts), 256):
            some = texts[low : low + 256]
            split = [None if any(s in text for s in special) else _words(text) for text in some]
            fresh = learn(set().union(*[words for words in split if words]).difference(known))
            for text, words in zip(some, split):
                if words is not None:
                    out.append(b"".join(map(known.__getitem__, words))[len(line_end) :])
                elif ODD.search(text) or any(s in text for s in special):
                    out.append(raw([text])[0])
                else:
                    out.append(b"".join(raw(_pieces(text))))
            if len(known) > REMEMBERED:
                for w in fresh:
                    del known[w]
        return out

    _ENCODERS[path] = encode
    return encode
