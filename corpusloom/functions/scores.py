"""Per-row text scores that Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Words = list[str]
_NOT_WORD = re.compile(r"[^a-z0-9]+")


def rouge_words(text: str, stem: Callable[[str], str] | None = None) -> Words:
    words = [w for w in _NOT_WORD.split(text.lower()) if w]
    return [stem(w) if stem and len(w) > 3 else w for w in words]


def _bit_rows(a: Words) -> dict[str, int]:
    rows: dict[str, int] = {}
    for i, w in enumerate(a):
        rows[w] = rows.get(w, 0) | (1 << i)
    return rows


def lcs_length(a: Words, b: Words) -> int:
    """Longest common subsequence, one big-integer step per word of ``b``."""
    rows, full = _bit_rows(a), (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & rows.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_members(a: Words, b: Words) -> set[int]:
    """Positions of ``a`` on one longest common subsequence with ``b``."""
    rows, full = _bit_rows(a), (1 << len(a)) - 1
    states = [full]
    for w in b:
        v = states[-1]
        u = v & rows.get(w, 0)
        states.append(((v + u) | (v - u)) & full)

    def length(i: int, j: int) -> int:
        return i - (states[j] & ((1 << i) - 1)).bit_count()

    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


def edit_distance(a: Words, b: Words) -> int:
    """Word-level edit distance, one big-integer step per word of ``b``."""
    if not a:
        return len(b)
    rows, full, top = _bit_rows(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, dist = full, 0, len(a)
    for w in b:
        eq = rows.get(w, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(x | plus) & full), plus & x
        dist += 1 if up & top else -1 if down & top else 0
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus = down | (~((eq | minus) | up) & full)
        minus = up & (eq | minus)
    return dist


def _f(hit: float, n_target: int, n_pred: int) -> tuple[float, float, float]:
    p = hit / n_pred if n_pred else 0.0
    r = hit / n_target if n_target else 0.0
    return p, r, (2 * p * r / (p + r) if p + r > 0 else 0.0)


def _grams(words: Words, n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def rouge_n(target: Words, pred: Words, n: int) -> tuple[float, float, float]:
    t, p = _grams(target, n), _grams(pred, n)
    return _f(sum((t & p).values()), sum(t.values()), sum(p.values()))


def rouge_l(target: Words, pred: Words) -> tuple[float, float, float]:
    return _f(lcs_length(target, pred), len(target), len(pred))


def rouge_l_sum(target: list[Words], pred: list[Words]) -> tuple[float, float, float]:
    """Union of the longest common subsequences of each target sentence with all predicted ones."""
    left_t, left_p = Counter(w for s in target for w in s), Counter(w for s in pred for w in s)
    n_t, n_p = sum(left_t.values()), sum(left_p.values())
    hits = 0
    for sent in target:
        union = set().union(*(lcs_members(sent, other) for other in pred)) if pred else set()
        for i in sorted(union):
            w = sent[i]
            if left_t[w] > 0 and left_p[w] > 0:
                hits += 1
                left_t[w] -= 1
                left_p[w] -= 1
    return _f(hits, n_t, n_p)


def rouge_l_max(pred: str | Column, refs: str | Column, stem: Callable[[str], str] | None = None) -> Column:
    """Best F-measure over the references; null for null."""

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for text, targets in zip(p, r):
            if text is None or targets is None:
                out.append(None)
                continue
            words = rouge_words(text, stem)
            out.append(max((rouge_l(rouge_words(t, stem), words)[2] for t in targets if t is not None), default=0.0))
        return pd.Series(out, dtype="Float64")

    return score(pred, refs)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


ROUGE_KEYS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]


def rouge_scores(pred: str | Column, target: str | Column, stem: Callable[[str], str] | None = None) -> Column:
    """Struct of F-measures for the four variants; sentences are separated by newlines."""

    @F.pandas_udf(", ".join(f"{k} double" for k in ROUGE_KEYS))
    def score(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p, t):
            pa, tb = rouge_words(a, stem), rouge_words(b, stem)
            ps = [rouge_words(s, stem) for s in a.split("\n") if s]
            ts = [rouge_words(s, stem) for s in b.split("\n") if s]
            rows.append(
                (rouge_n(tb, pa, 1)[2], rouge_n(tb, pa, 2)[2], rouge_l(tb, pa)[2], rouge_l_sum(ts, ps)[2])
            )
        return pd.DataFrame(rows, columns=ROUGE_KEYS)

    both = F.coalesce(pred, F.lit("")), F.coalesce(target, F.lit(""))
    return F.when(_col(pred).isNotNull() & _col(target).isNotNull(), score(*both))


def word_edits(pred: str | Column, ref: str | Column) -> Column:
    @F.pandas_udf("long")
    def distance(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(b.split(), a.split()) for a, b in zip(p, r)])

    both = F.coalesce(pred, F.lit("")), F.coalesce(ref, F.lit(""))
    return F.when(_col(pred).isNotNull() & _col(ref).isNotNull(), distance(*both))


def ngram_overlap(pred: str | Column, refs: str | Column, order: int = 4) -> Column:
    """Clipped n-gram matches and totals per order, and both lengths, from token arrays."""
    fields = [f"match{n} long, total{n} long" for n in range(1, order + 1)]

    @F.pandas_udf(", ".join(fields) + ", pred_len long, ref_len long")
    def count(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for words, targets in zip(p, r):
            words = [] if words is None else list(words)
            targets = [[] if t is None else list(t) for t in ([] if targets is None else targets)] or [[]]
            row = []
            for n in range(1, order + 1):
                have, best = _grams(words, n), Counter()
                for t in targets:
                    best |= _grams(t, n)
                row += [sum((have & best).values()), sum(have.values())]
            nearest = min((abs(len(t) - len(words)), len(t)) for t in targets)[1]
            rows.append((*row, len(words), nearest))
        names = [x for n in range(1, order + 1) for x in (f"match{n}", f"total{n}")] + ["pred_len", "ref_len"]
        return pd.DataFrame(rows, columns=names)

    return count(pred, refs)


def multiset_f1(words: str | Column, refs: str | Column) -> Column:
    """Best F1 of token multisets over the reference token lists."""

    @F.pandas_udf("double")
    def score(pred: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for own, lists in zip(pred, targets):
            have, best = Counter(own), 0.0
            for other in lists:
                best = max(best, _f(sum((have & Counter(other)).values()), len(other), len(own))[2])
            out.append(best)
        return pd.Series(out)

    return score(words, refs)
