"""Token counts that follow edits without encoding the text again.

A text is cut into leaves of a few hundred characters. Cuts lie where a pre-token must start whatever the
rest of the text is: at a space between two letters, and at a line end between two characters that are not
white space. Each leaf is encoded by itself; a segment tree holds the sums of characters
and tokens over the leaves.

An edit (start, end, text; places count characters of the text as it then is) descends the tree to the
leaves it touches. Their region grows by a leaf where the edit reaches the character beside a
cut, since a cut holds only with both its neighbours in place. Only the region is cut and encoded
anew, and the sums above its leaves are updated. New leaves take the places of the old; a leaf with too
much text is cut by a rebuild of the tree, whose counts are known already.

NULL text is empty. Edits apply in the order of ``seq``; places outside the text are moved to its nearest end.
NULL replacements are empty. A document without edits keeps its counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import matches, ship
from panelweave.llm.tokenizer import byte_bpe, vocabulary_path

LEAF_CHARS = 256
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
CUT = re.compile(rf"(?<=[{LETTER}]) (?=[{LETTER}])|(?<=\S)\n(?=\S)")
#: Fixed patterns of personal data that the default edits replace.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER = r"\+?[0-9](?:[ ./-]?[0-9]){6,}"


def cut(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The leaves of a text, each of ``size`` characters or more but the last."""
    leaves, at = [], 0
    while found := CUT.search(text, at + size):
        leaves.append(text[at : found.start()])
        at = found.start()
    leaves.append(text[at:])
    return leaves


class SegmentTree:
    """Sums of characters and tokens over leaves; node 1 is the root, node k has the children 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(len(chars) - 1, 0).bit_length()
        self.n = len(chars)
        self.chars = np.zeros(2 * self.width, np.int64)
        self.tokens = np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + self.n] = chars
        self.tokens[self.width : self.width + self.n] = tokens
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` and where that leaf starts; the last leaf from the end on."""
        if place >= self.chars[1]:
            last = self.n - 1
            return last, int(self.chars[1] - self.chars[self.width + last])
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


class EditedText:
    """A text with its segment tree, under edits."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]):
        self.text, self.tree, self.count = text, SegmentTree(chars, tokens), count
        self.encoded_chars = 0

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        tree = self.tree
        # A cut before character p stands on p - 1, p and p + 1.
        first, region = tree.find(max(start - 2, 0))
        last, last_start = tree.find(end + 1)
        region_end = last_start + int(tree.chars[tree.width + last])
        fresh = self.text[region:start] + new + self.text[end:region_end]
        self.text = self.text[:region] + fresh + self.text[region_end:]
        self.encoded_chars += len(fresh)
        leaves = cut(fresh)
        counts = [self.count(x) for x in leaves]
        places = last - first + 1
        for k in range(places):  # the last of the old places takes what is left over
            own = slice(k, k + 1) if k < places - 1 else slice(k, None)
            tree.set(first + k, sum(map(len, leaves[own])), sum(counts[own]))
        if len(leaves) > 4 * places:
            old = [(int(c), int(t)) for c, t in zip(tree.chars[tree.width :][: tree.n], tree.tokens[tree.width :][: tree.n])]
            grown = old[:first] + [(len(x), c) for x, c in zip(leaves, counts)] + old[last + 1 :]
            self.tree = SegmentTree([c for c, _ in grown], [t for _, t in grown])


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Add the leaves of each text's tree to every row: ``leaf_chars`` and ``leaf_tokens``."""
    path = path or vocabulary_path()
    ship(docs.sparkSession)

    @F.pandas_udf("leaf_chars array<int>, leaf_tokens array<int>")
    def leaves(texts: pd.Series) -> pd.DataFrame:
        count = byte_bpe(path).count
        cuts = [cut(t) for t in texts]
        return pd.DataFrame({"leaf_chars": [[len(x) for x in c] for c in cuts], "leaf_tokens": [[count(x) for x in c] for c in cuts]})

    grown = docs.withColumn("__leaves", leaves(F.coalesce("text", F.lit(""))))
    return grown.withColumns({"leaf_chars": F.col("__leaves.leaf_chars"), "leaf_tokens": F.col("__leaves.leaf_tokens")}).drop("__leaves")


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Give each tree the edits (doc_id, seq, start, end, text) of its document, in order, as ``edits``."""
    edit = F.struct("seq", "start", "end", F.coalesce("text", F.lit("")).alias("text"))
    gathered = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    return trees.join(gathered, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Edit each text: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, encoded_chars.

    ``trees`` needs doc_id, text, the leaves of ``build_trees`` and ``edits``, an array of
    (start, end, text) in order.
    """
    path = path or vocabulary_path()
    ship(trees.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = byte_bpe(path).count
        for batch in batches:
            out = []
            for text, chars, tokens, edits in zip(batch["text"], batch["leaf_chars"], batch["leaf_tokens"], batch["edits"]):
                before = int(sum(tokens))
                if edits is None or not len(edits):
                    out.append((before, 0, before, int(sum(chars)), 0))
                    continue
                held = EditedText(text or "", list(chars), list(tokens), count)
                for e in edits:
                    held.edit(int(e["start"]), int(e["end"]), e["text"] or "")
                out.append((before, len(edits), int(held.tree.tokens[1]), int(held.tree.chars[1]), held.encoded_chars))
            found = pd.DataFrame(out, columns=["n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "encoded_chars"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], found], axis=1)

    kind = trees.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, encoded_chars long"
    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInPandas(run, schema)


def redactions(text: Column) -> Column:
    """Edits that put a mark in place of e-mail addresses and long numbers, the last place first, so that places stay valid."""

    def edits(pattern: str, mark: str) -> Column:
        return F.transform(
            matches(text, pattern),
            lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.char_length(m["match"])).alias("end"), F.lit(mark).alias("text")),
        )

    # Numbers inside addresses go with the address.
    mails, numbers = edits(EMAIL, "[email]"), edits(NUMBER, "[number]")
    apart = F.filter(numbers, lambda n: ~F.exists(mails, lambda m: (m["start"] < n["end"]) & (n["start"] < m["end"])))
    return F.sort_array(F.concat(mails, apart), asc=False)
