"""Token counts that follow edits.

A document's pre-tokens are leaves of a segment tree that holds sums of their token counts. An edit re-reads the text from
the last boundary it can't have moved to the first old boundary that the new reading meets again; only pre-tokens
between are encoded anew, and only the sums above them change. The text is held as its pre-tokens alone, so an edit lays out no more
than the chunks that it reads, however long the text is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, prepare
from quillstone.llm.packing import Encoder

LEAVES = 64  # pre-tokens in a leaf chunk
#: E-mail addresses, to be masked; the default edit.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


class Counts(dict):
    """Tokens of a pre-token; what was met once is kept, up to a bound."""

    def __init__(self, encoder: Encoder, most: int = 200_000):
        super().__init__()
        self.encoder, self.most = encoder, most

    def __missing__(self, pre: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[pre] = len(self.encoder.plain(pre))
        return n


_state: dict = {}


def tools():
    """The pre-token pattern and the counts of this worker."""
    if not _state:
        import public_tokenizers
        import regex

        _state["pattern"] = regex.compile(public_tokenizers.PATTERN)
        _state["counts"] = Counts(Encoder.get())
    return _state["pattern"], _state["counts"]


class SumTree:
    """Sums over a power of two of leaves, in one list."""

    def __init__(self, sums: list[int]):
        self.width = 1 << max(0, (len(sums) - 1).bit_length()) if sums else 1
        self.node = [0] * self.width + sums + [0] * (self.width - len(sums))
        for k in range(self.width - 1, 0, -1):
            self.node[k] = self.node[2 * k] + self.node[2 * k + 1]

    def set(self, leaf: int, value: int) -> None:
        k = leaf + self.width
        self.node[k] = value
        while k > 1:
            k >>= 1
            self.node[k] = self.node[2 * k] + self.node[2 * k + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf that holds the place, sum of the leaves before it); the last leaf beyond all."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if place >= before + self.node[k]:
                before += self.node[k]
                k += 1
        return k - self.width, before

    @property
    def total(self) -> int:
        return self.node[1]


@dataclass(frozen=True)
class Edit:
    start: int  # characters, in the text as it is when the edit comes
    stop: int
    text: str


class Document:
    """A text as its pre-tokens in chunks, and trees of their lengths and token counts."""

    def __init__(self, text: str):
        self.pattern, self.counts = tools()
        pre = self.pattern.findall(text)
        self.chunks = [pre[k : k + LEAVES] for k in range(0, len(pre), LEAVES)] or [[]]
        get = self.counts.__getitem__
        self.lengths = SumTree([sum(map(len, c)) for c in self.chunks])
        self.tokens = SumTree([sum(map(get, c)) for c in self.chunks])
        self.encoded = 0  # pre-tokens read anew for edits
        self.read = 0  # characters laid out to read them

    @property
    def text(self) -> str:
        return "".join(p for c in self.chunks for p in c)

    @property
    def n_tokens(self) -> int:
        return self.tokens.total

    def boundary(self, place: int) -> tuple[int, int, int]:
        """(chunk, index in it, place) of the start of the pre-token that holds the place; the start of an empty text."""
        if not self.lengths.total:
            return 0, 0, 0
        chunk, at = self.lengths.find(max(0, place))
        for k, p in enumerate(self.chunks[chunk]):
            if at + len(p) > place:
                return chunk, k, at
            at += len(p)
        return chunk, len(self.chunks[chunk]), at

    def apply(self, edit: Edit) -> None:
        """Read anew from the boundary before the edit until an old boundary is met beyond it; the rest of the text isn't touched."""
        shift = len(edit.text) - (edit.stop - edit.start)
        # two characters before the edit are the furthest that a pre-token's end looks ahead
        chunk, k, at = self.boundary(edit.start - 2)
        held, last = ["".join(self.chunks[chunk][k:])], chunk
        size = len(held[0])
        while at + size < edit.stop and last + 1 < len(self.chunks):
            last += 1
            held.append("".join(self.chunks[last]))
            size += len(held[-1])
        old = "".join(held)
        window = old[: edit.start - at] + edit.text + old[edit.stop - at :]
        old_chunk, old_k, old_at = chunk, k, at
        fresh: list[str] = []
        place = at
        while True:
            # old boundaries catch up; where both readings stop beyond the edit, they agree from there on
            while old_chunk < len(self.chunks) and old_at + shift < place:
                if old_k >= len(self.chunks[old_chunk]):
                    old_chunk, old_k = old_chunk + 1, 0
                    continue
                old_at += len(self.chunks[old_chunk][old_k])
                old_k += 1
            if place >= edit.start + len(edit.text) and old_at >= edit.stop and old_at + shift == place:
                break
            found = self.pattern.match(window, place - at)
            # an end that near to the window's could be another in the whole text
            while (found is None or found.end() + 2 > len(window)) and last + 1 < len(self.chunks):
                last += 1
                window += "".join(self.chunks[last])
                found = self.pattern.match(window, place - at)
            if found is None:
                old_chunk, old_k = len(self.chunks) - 1, len(self.chunks[-1])
                break
            fresh.append(found[0])
            place = at + found.end()
        self.encoded += len(fresh)
        self.read += len(window)
        if old_chunk >= len(self.chunks):
            old_chunk, old_k = len(self.chunks) - 1, len(self.chunks[-1])
        tail = self.chunks[old_chunk][old_k:]
        for c in range(chunk, old_chunk + 1):
            if c == chunk:
                self.chunks[c] = self.chunks[c][:k] + fresh + (tail if c == old_chunk else [])
            else:
                self.chunks[c] = tail if c == old_chunk else []
            self.lengths.set(c, sum(map(len, self.chunks[c])))
            self.tokens.set(c, sum(map(self.counts.__getitem__, self.chunks[c])))


def masks(text: str, pattern: re.Pattern, mask: str) -> list[Edit]:
    """Edits that put mask in place of each match, each in terms of the text after those before it."""
    out, shift = [], 0
    for m in pattern.finditer(text):
        out.append(Edit(m.start() + shift, m.end() + shift, mask))
        shift += len(mask) - (m.end() - m.start())
    return out


def count_edited(docs: DataFrame, pattern: str = EMAIL, mask: str = "<EMAIL>") -> DataFrame:
    """docs with n_tokens_before, n_edits, n_tokens and n_encoded in place of text: counts before and after masking matches.

    n_encoded is the number of pre-tokens read anew for the edits. A null text is empty. Whole texts are counted, row by row,
    repeated rows too; other columns stay, those named like a result are replaced. An empty table gives no rows.
    """
    prepare(docs.sparkSession, 256)
    results = ["n_tokens_before", "n_edits", "n_tokens", "n_encoded"]

    @F.pandas_udf("n_tokens_before long, n_edits long, n_tokens long, n_encoded long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        rx = re.compile(pattern)
        out = []
        for text in texts:
            text = text or ""
            doc = Document(text)
            before, edits = doc.n_tokens, masks(text, rx, mask)
            for e in edits:
                doc.apply(e)
            out.append((before, len(edits), doc.n_tokens, doc.encoded))
        return pd.DataFrame(out, columns=results)

    held = docs.drop(*results)
    (found,) = fresh(held, "found")
    return held.withColumn(found, counted("text")).select(*[c for c in held.columns if c.lower() != "text"], *[F.col(found)[r].alias(r) for r in results])
