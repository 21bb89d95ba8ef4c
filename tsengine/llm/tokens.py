"""Token counts of whole texts with a byte-level BPE vocabulary.

A huge text is encoded in overlapping chunks with offsets, and the chunks are spliced where both
encodings of an overlap agree at a place that is proven stable:

* before white space that follows another character. The vocabulary's pattern never joins such a
  pair, and what stands on either side cannot change the tokens of the other;
* behind a token without white space that both encodings hold at the same offsets, outside
  contractions. Any piece of the pattern that holds it goes on to the end of its run of letters,
  digits or other characters, whatever came before, and a token sequence is the encoding of such a
  run exactly if each pair of neighbours is. The pair on either side of the place is a pair of one
  of the two encodings, so the tokens of the one up to the place and of the other from there on are
  the encoding of the whole.

Neither place lies inside the text of an added token. Where an overlap has no such place it is
widened, up to the whole chunk; then the chunk doubles, so that even a text without any stable
place costs a bounded multiple of one encoding.

The first proof allows a text below the limit to be counted by its segments between spaces: the
library encodes every distinct segment once, and a bounded table keeps the counts.

Defined results: a null or empty text has no tokens; the text of a special token inside a text is
that token, as the library has it by default; texts of any length count in full, with memory for
one chunk unless a text has no stable place (a run of one repeated character can be such a text).
Input columns named like an output give way to it.
"""

from __future__ import annotations

import functools
import json
import os
import re
from bisect import bisect_left
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import map_texts, table

#: Characters from which a text is huge, of a chunk, and of the first overlap.
LIMIT, CHUNK, OVERLAP = 1 << 16, 1 << 15, 256
#: Distinct segments whose counts a Python worker keeps.
KEPT = 1_000_000
#: White space before a space: the places between segments are not all stable.
_UNSTABLE = re.compile(r"\s ")
_STABLE = re.compile(r"(?<=\S)(?= )")


class Counter:
    """Counts with one tokenizer file; ``splittable`` says whether stable places are proven for it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.splittable = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
        )
        model = spec["model"]
        # the second kind of place is proven for plain merges by rank
        self.plain = model.get("type") == "BPE" and not any(
            model.get(k)
            for k in ("dropout", "ignore_merges", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.kept: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str], limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if not self.splittable:
            return self.encode(texts)
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= limit]
        for i, t in enumerate(texts):
            if len(t) > limit:
                out[i] = self.spliced(t, chunk, overlap)
        parts = [texts[i].split(" ") if not _UNSTABLE.search(texts[i]) else None for i in small]
        odd = [k for k, p in enumerate(parts) if p is None]
        for k in odd:
            # segments keep their leading space; cutting it off makes them keys like the others
            first, *rest = _STABLE.split(texts[small[k]])
            parts[k] = [first, *[s[1:] for s in rest]]
        if len(self.kept) > KEPT:
            self.kept.clear()
        kept = self.kept
        new = list(set(chain.from_iterable(p[1:] for p in parts)).difference(kept))
        kept.update(zip(new, self.encode([" " + s for s in new])))
        firsts = self.encode([p[0] for p in parts])
        for i, p, first in zip(small, parts, firsts):
            out[i] = first + sum(map(kept.__getitem__, p[1:]))
        return out

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text from overlapping chunks."""
        total, begin, end = 0, 0, min(chunk, len(text))
        left, done = self.tokens(text, begin, end), 0  # tokens of the chunk before ``done`` are counted
        place = begin
        while end < len(text):
            width = overlap
            while True:
                low = max(end - width, begin)
                last = min(end + max(chunk, end - begin), len(text))
                right = self.tokens(text, low, last)
                found = self.common_place(text, max(low, place) + 1, end, left, right)
                if found:
                    place, until, after = found
                    total += until - done
                    begin, end, left, done = low, last, right, after
                    break
                if low == begin:  # the overlap is the whole chunk: both become one
                    end = last
                    left = self.tokens(text, begin, end)
                    break
                width *= 16
        return total + len(left[0]) - done

    def tokens(self, text: str, begin: int, end: int) -> tuple[list[int], list[int], list[int]]:
        """Ids, starts and ends of the tokens of a part of the text."""
        found = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return found.ids, [begin + s for s, _ in found.offsets], [begin + e for _, e in found.offsets]

    def common_place(self, text: str, low: int, high: int, left: tuple, right: tuple) -> tuple[int, int, int] | None:
        """The last stable place in [low, high] that both encodings share, and how many of their tokens lie before it."""
        ids, starts, ends = right
        for j in range(bisect_left(starts, high) - 1, -1, -1):
            s, e = starts[j], ends[j]
            if s < low - 1:
                return None
            i = bisect_left(left[1], s)
            if not (i < len(left[0]) and left[1][i] == s and clean(right, j) and clean(left, i)):
                continue
            if low <= s and text[s] in " \t\n\r" and not text[s - 1].isspace() and not self.inside(text, s):
                return s, i, j
            same = left[0][i] == ids[j] and left[2][i] == e and clean(right, j + 1) and clean(left, i + 1)
            if self.plain and same and low <= e <= high and own_run(text, s, e) and not self.inside(text, e):
                return e, i + 1, j + 1
        return None

    def inside(self, text: str, place: int) -> bool:
        """Whether the text of an added token stands across the place."""
        return any(t in text[max(place - len(t) + 1, 0) : place + len(t) - 1] for t in self.added)


def clean(tokens: tuple, i: int) -> bool:
    """Whether a token boundary before token ``i`` is a boundary of characters, too."""
    _, starts, ends = tokens
    return i == 0 or i == len(starts) or (ends[i - 1] <= starts[i])


def own_run(text: str, start: int, end: int) -> bool:
    """No white space in the token and no contraction that could hold it."""
    return not any(map(str.isspace, text[start:end])) and "'" not in text[max(start - 2, 0) : end]


@functools.cache
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, batch: int = 64) -> DataFrame:
    """``keep`` (default: all columns) and ``n_tokens``. ``path``: a file that all executors have."""

    def build():
        mine = counter(path)

        def work(texts: pa.Array) -> list:
            out = []
            for lo in range(0, len(texts), batch):
                out += mine.count([t or "" for t in texts.slice(lo, batch).to_pylist()])
            return [pa.array(out, pa.int64())]

        return work

    return map_texts(docs, text, [T.StructField("n_tokens", T.LongType())], build, keep)


def op6_tokens(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = token_counts(rows, str(public_tokenizers.path("byte_bpe_50k.json")), keep=["doc_id", "n_bytes"])
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)
