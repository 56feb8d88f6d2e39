"""Runs of periodic words, by maximal pairs of an LCP-interval tree.

A run is a stretch of words with smallest period q, of at least ``least`` words and two periods, that neither
neighbour extends. Its first word and the one a period later are a maximal pair: what
follows both is the same for all but the last q words of the run, and the words before and after that
match differ. So the runs are exactly the maximal pairs (p, p + d) of match length l with
d <= l and l + d >= ``least``. A long run is also met with multiples of its period; of the pairs with equal start and
end the least distance is the period. No match is extended word by word.

Each text is worked on whole, many texts of a batch at a time:

1. Words become numbers, told apart by text, with an end of its own behind each text. Ranks of 1, 2, 4 and 6 words
   follow by sorting pairs of ranks. Positions whose six words occur once in their text are in no
   run, as half of ``least`` words have to repeat; the others are sorted on by doubling.
2. Lengths of common prefixes of neighbours come from the positions in order, each
   match at least as long as the one before it less one.
3. The intervals of equal prefixes are closed bottom-up. A node of prefix length l gets the positions of its
   children, each with its class, the word before it. Pairs of different children and classes at a
   distance up to l are maximal. The smaller children look up theirs in the largest.

The class lists of a node are kept as one list in the order of positions. That is enough, for if x < y < z are
positions of one prefix of length l and z - x <= l, the prefix has period z - y, so the words
before y and z are equal: looking back from z at most the first position within reach has another
class, and looking ahead from x all have the same one. A text's pairs number at most the sum of its runs'
exponents, which is below three times its words.

NULL and empty texts have no words and no runs; repeated rows and ids are treated each for itself; texts
may be of any length, a text being one task's work.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelweave.llm.common import ship

LEAST = 12
#: Words that are sorted together, but for a longer text.
WORDS_TOGETHER = 300_000

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class _Numbers(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        return found


def _refined(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Order the positions ``at`` further by the rank ``step`` words on, in place; return those that still share a rank.

    A rank is the number of positions that sort before its group, so ranks of other positions stay as they are.
    """
    key = rank[at] * np.int64(len(rank) + 1) + rank[np.minimum(at + step, len(rank) - 1)]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    old = rank[at]
    index = np.arange(len(at))
    new_group, old_group = np.ones(len(at), bool), np.ones(len(at), bool)
    new_group[1:], old_group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
    first_new, first_old = np.maximum.accumulate(np.where(new_group, index, 0)), np.maximum.accumulate(np.where(old_group, index, 0))
    rank[at] = old + first_new - first_old
    alone = new_group & np.append(new_group[1:], True)
    return at[~alone]


def repeated_suffixes(codes: np.ndarray, half: int) -> np.ndarray:
    """Positions whose first ``half`` codes occur again, in the order of what follows them. Ends have codes of their own."""
    order = np.argsort(codes, kind="stable")
    group = np.ones(len(codes), bool)
    group[1:] = codes[order][1:] != codes[order][:-1]
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.maximum.accumulate(np.where(group, np.arange(len(codes)), 0))
    at = order[~(group & np.append(group[1:], True))]
    known = 1
    while known < half and len(at):
        step = min(known, half - known)
        at, known = _refined(rank, at, step), known + step
    kept = at
    while len(at):
        at, known = _refined(rank, at, known), 2 * known
    return kept[np.argsort(rank[kept])]


def common_prefixes(codes: list[int], order: list[int], half: int) -> list[int]:
    """For each place in ``order`` the length of the prefix shared with the place before it; 0 for the first."""
    before = dict(zip(order[1:], order))
    length = {}
    last, known = -2, 0
    for p in sorted(order):
        q = before.get(p)
        # What follows the word before p matched at least this much, if its partner's next position is in ``order`` too.
        known = known - 1 if p == last + 1 and known > half else 0
        if q is None:
            known = 0
        else:
            while codes[p + known] == codes[q + known]:
                known += 1
        length[p], last = known, p
    return [length[p] for p in order]


def maximal_pairs(codes: list[int], order: list[int], prefixes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(p, later p, match length) of the maximal pairs that are runs of ``least`` codes or more, multiples of their period included."""
    half = -(-least // 2)

    def joined(length: int, children: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        children.sort(key=len)
        big = children.pop()
        small = sorted((p, k) for k, child in enumerate(children) for p in child)
        first = 0
        for p, k in small:
            own = codes[p - 1] if p else 0
            # Pairs among the smaller children.
            while small[first][0] < p - length:
                first += 1
            x, j = small[first]
            if x < p and j != k and (codes[x - 1] if x else 0) != own:
                yield x, p, length
            # Pairs with the largest child, before and behind.
            i = bisect_left(big, p - length)
            if i < len(big) and big[i] < p and (codes[big[i] - 1] if big[i] else 0) != own:
                yield big[i], p, length
            i = bisect_right(big, p)
            while i < len(big) and big[i] <= p + length and codes[big[i] - 1] != own:
                yield p, big[i], length
                i += 1
        if 8 * len(small) < len(big):
            for p, _ in small:
                insort(big, p)
        else:
            big.extend(p for p, _ in small)
            big.sort()
        children.append(big)

    stack: list[tuple[int, list[list[int]]]] = []
    for p, length in zip(order, [*prefixes[1:], 0]):
        child = [p]
        while stack and stack[-1][0] > length:
            own, children = stack.pop()
            children.append(child)
            for a, b, match in joined(own, children):
                if b - a + match >= least:
                    yield a, b, match
            child = children[-1]
        if length >= half:
            if not stack or stack[-1][0] < length:
                stack.append((length, []))
            stack[-1][1].append(child)


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text by start and period. A text is an array of word numbers from 1 on."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not sizes.sum() - len(texts):
        return found
    ends = np.cumsum(sizes)
    words = np.zeros(ends[-1], np.int64)
    for t, end in zip(texts, ends):
        words[end - 1 - len(t) : end - 1] = t
    # Equal words of different texts differ, and so do the ends, which are word 0 of their text.
    codes = np.repeat(np.arange(len(texts)), sizes) * np.int64(words.max() + 1) + words
    half = -(-least // 2)
    order = repeated_suffixes(codes, half).tolist()
    if not order:
        return found
    plain = codes.tolist()
    period: dict[tuple[int, int], int] = {}
    for a, b, match in maximal_pairs(plain, order, common_prefixes(plain, order, half), least):
        whole = (a, b + match)
        period[whole] = min(b - a, period.get(whole, b - a))
    owners = np.searchsorted(ends, [a for a, _ in period], side="right").tolist()
    for owner, ((a, end), q) in zip(owners, period.items()):
        found[owner].append((a - int(ends[owner] - sizes[owner]), end - a, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, words_together: int = WORDS_TOGETHER) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed of every row.

    ``collapsed`` joins by one space the words that stay when each run is cut down to its first period.
    """
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"]]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")

    def of_texts(ids: list, split: list[list[bytes]]) -> pd.DataFrame:
        numbers = _Numbers()
        coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in split]
        out = []
        for doc, words, runs in zip(ids, split, runs_of(coded, least)):
            left = [words[i] for i in np.flatnonzero(_kept(len(words), runs)).tolist()] if runs else words
            said = [{"start": s, "length": n, "period": q} for s, n, q in runs]
            out.append((doc, len(words), said, b" ".join(left).decode()))
        return pd.DataFrame(out, columns=schema.names)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, split, held = [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = (text or "").encode().split()
                if ids and held + len(words) > words_together:
                    yield of_texts(ids, split)
                    ids, split, held = [], [], 0
                ids.append(doc)
                split.append(words)
                held += len(words)
            if ids:
                yield of_texts(ids, split)

    return docs.select("doc_id", "text").mapInPandas(find, schema)
