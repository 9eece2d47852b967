"""Exact byte-pair token counts of every prefix, by dynamic programming over last tokens.

For byte-pair encoding, the tokens of a word's prefix of length j end in the one token t for which
the encoding of the prefix of length j - len(t) followed by t is itself an encoding; that holds
exactly when its last token and t, put together, encode to those two. So one left-to-right pass
gives the last token, and with it the exact token count, of every prefix of a word. A text's store
holds these tables by word and the counts up to each word's end, and answers every question about
the text's prefixes by looking them up; nothing is encoded again.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Fixed values of the byte-level vocabulary format: the pattern that cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside the blocks on whose classes all Unicode versions from 12 on agree.
UNSETTLED = regex.compile("[^\\u0000-\\u0557\\u0590-\\u088e\\u0d00-\\u17ff\\u1e00-\\u208e\\u20a0-\\u2bff\\u3000-\\u9fef\\uac00-\\ud7a3\\U0001f300-\\U0001f6ff]")
#: Bytes of words and their tables that a Python worker keeps, in two generations, and pairs of tokens; bounds its memory.
KEPT_BYTES, KEPT_PAIRS = 128 << 20, 400_000


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Tables(dict):
    """Tables by word: the token count of each prefix, by bytes. A missing word's is computed on first use.

    A full generation becomes the old one, from which words that come again are taken over."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.bytes, self.old = counter, 0, {}

    def __missing__(self, word: str) -> bytes | array:
        table = self.old.get(word)
        if table is None:
            counts = self.counter.word_counts(word.encode("utf-8", "surrogatepass"))
            table = bytes(counts) if counts[-1] < 256 and max(counts) < 256 else array("I", counts)
        if self.bytes > KEPT_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self[word] = table
        self.bytes += 200 + len(word) + len(table) * (1 if isinstance(table, bytes) else 4)
        return table


class Prefixes:
    """The store of one text: its parts (words and special strings), and the exact token count up to the end of each.

    Between two ends the count is that of the word's own prefix, but where a cut changes how the
    text falls into words: within a run of white space, a contraction or a special string."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.parts: list[str] = []
        self.special: set[int] = set()
        at = 0
        for m in counter.specials.finditer(text) if counter.specials is not None else ():
            self.parts += counter.split(text[at : m.start()])
            self.special.add(len(self.parts))
            self.parts.append(m[0])
            at = m.end()
        self.parts += counter.split(text[at:] if at else text)
        table = counter.tables.__getitem__
        if self.special:
            counts = [1 if i in self.special else table(w)[-1] for i, w in enumerate(self.parts)]
        else:
            counts = [t[-1] for t in map(table, self.parts)]
        #: Tokens before each part, and of the whole text.
        self.before = list(accumulate(counts, initial=0))

    @property
    def total(self) -> int:
        return self.before[-1]

    def inside(self, i: int) -> list[int]:
        """Token counts of the text's prefixes that end after each character of part i."""
        part, base = self.parts[i], self.before[i]
        tables, split = self.counter.tables, self.counter.split
        if i in self.special:
            # A cut special string is ordinary text; only the three words before it can fall otherwise then.
            first = max([0, i - 3, *(j + 1 for j in range(max(0, i - 3), i) if j in self.special)])
            head = "".join(self.parts[first:i])
            cut = [self.before[first] + sum(tables[w][-1] for w in split(head + part[:n])) for n in range(1, len(part))]
            return [*cut, base + 1]
        table, out, at = tables[part], [], 0
        for c in part:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(base + table[at - 1])
        if i and i - 1 not in self.special and self.parts[i - 1].isspace() and part[0].isspace():
            # Cut here, the whole run of white space is one word.
            out[0] = self.before[i - 1] + tables[self.parts[i - 1] + part[0]][-1]
        if part in ("'re", "'ve", "'ll"):
            # Cut here, the apostrophe and the letter are two words.
            out[1] = base + tables[part[0]][-1] + tables[part[1]][-1]
        if i + 1 == len(self.parts) or i + 1 in self.special or not part.isspace():
            out[-1] = self.before[i + 1]
        return out

    def counts(self) -> list[int]:
        """Exact token counts of text[:0], text[:1], ... text, each as if the prefix were the whole text."""
        return [0, *(n for i in range(len(self.parts)) for n in self.inside(i))]

    def fitting(self, budget: int) -> int:
        """Characters of the longest prefix that has at most budget tokens."""
        if self.total <= budget:
            return len(self.text)
        ends = list(accumulate(map(len, self.parts), initial=0))
        # A cut can change the count of the last words only, by less than a special string has bytes.
        last = min(len(self.parts), bisect_right(self.before, budget + self.counter.slack))
        for i in range(last - 1, -1, -1):
            within = [n for n, count in enumerate(self.inside(i), 1) if count <= budget]
            if within:
                return ends[i] + within[-1]
        return 0


class PrefixCounter:
    """Token counts of all prefixes under one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {x["content"] for x in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        made = {a + b: (a, b) for a, b in self.ranks}
        tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.never = len(self.ranks)
        self.right_edges: dict[bytes, list[tuple[bytes, int]]] = {}
        self.left_edges: dict[bytes, list[tuple[bytes, int]]] = {}
        for token in sorted(tokens, key=len):
            first, second = made.get(token, (None, None))
            if first in self.left_edges and second in self.right_edges:
                rank = self.ranks[first, second]
                self.left_edges[token] = [*self.left_edges[first][:-1], (first, rank), (token, self.never)]
                self.right_edges[token] = [*self.right_edges[second][:-1], (second, rank), (token, self.never)]
            elif len(token) == 1:
                self.left_edges[token] = self.right_edges[token] = [(token, self.never)]
        #: Only tokens that encode to themselves can be a last token.
        self.tokens = {t for t in self.left_edges if len(t) == 1 or self.joins(*made[t], own=True)}
        #: Tokens (True) and other beginnings of tokens (False).
        self.beginnings = {t[:n]: False for t in self.tokens for n in range(1, len(t))} | dict.fromkeys(self.tokens, True)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.slack = max(map(len, special), default=0) + 3
        self.tables = _Tables(self)
        self.path = path
        self.library = None  # made on first use

    def joins(self, left: bytes, right: bytes, own: bool = False) -> bool:
        """Whether the two tokens stay as they are when they stand side by side.

        While merges run from the lowest rank up, the left token's right edge grows through its
        right parts, and the right token's left edge through its left parts; each part lasts until
        the rank at which it is merged on. A pair of parts that meet at the border is merged if its
        rank comes before the left part's end (of equal ranks, the one further left goes first) and
        not after the right part's. With ``own``, the merge that makes the token itself is allowed.
        """
        lefts, rights = self.right_edges[left], self.left_edges[right]
        i = j = 0
        while True:
            a, a_end = lefts[i]
            b, b_end = rights[j]
            rank = self.ranks.get((a, b))
            if rank is not None and rank < a_end and rank <= b_end:
                return own and (a, b) == (left, right)
            if a_end == b_end == self.never:
                return not own
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def word_counts(self, word: bytes) -> list[int]:
        """Token counts of word[:1], word[:2], ... word."""
        n = len(word)
        beginnings, pairs = self.beginnings.get, self.pairs
        last: list[bytes | None] = [b""] + [None] * n
        counts = [0] * (n + 1)
        for start in range(n):  # what ends here is settled, as its tokens begin further left
            left, count = last[start], counts[start] + 1
            for end in range(start + 1, n + 1):
                token = word[start:end]
                known = beginnings(token)
                if known:
                    if last[end] is None:
                        fits = True
                        if start:
                            fits = pairs.get((left, token))
                            if fits is None:
                                if len(pairs) >= KEPT_PAIRS:
                                    pairs.clear()
                                fits = pairs[left, token] = self.joins(left, token)
                        if fits:
                            last[end] = token
                            counts[end] = count
                elif known is None:
                    break
        return counts[1:]

    def split(self, text: str) -> list[str]:
        """The words of a text. Letters that differ between Unicode versions go by the library's own tables."""
        if not UNSETTLED.search(text):
            return self.words.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[i:j] for _, (i, j) in self.library.pre_tokenize_str(text)]

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text)

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token counts of text[:0], text[:1], ... text, each as if the prefix were the whole text."""
        return self.prefixes(text).counts()

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of text that has at most budget tokens."""
        return self.prefixes(text).fitting(budget)


_loaded: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The vocabulary's counter; each Python worker builds it once."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer: str | None = None, prefixes: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, fit_chars, over_limit (n_tokens > limit).

    All comes from the text's prefix store: n_tokens is the count at its end, and fit_chars
    the characters of the longest prefix that has at most limit tokens. With ``prefixes``, also
    prefix_tokens (the exact token count of each prefix, from the empty one to the whole text). A
    map over the scan, without a shuffle.

    Null text counts as empty: 0 bytes, 0 tokens. Texts of any length are counted whole. Repeated
    rows each give a row, a null id stays null, an empty table gives an empty result, other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_tokens", "fit_chars"))])
    if prefixes:
        schema = schema.add("prefix_tokens", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            totals, fits, lists = [], [], []
            for text in batch.column("text"):
                store = own.prefixes(text.as_py())
                totals.append(store.total)
                fits.append(store.fitting(limit))
                if prefixes:
                    lists.append(store.counts())
            more = [pa.array(totals, pa.int64()), pa.array(fits, pa.int64())] + ([pa.array(lists, pa.list_(pa.int32()))] if prefixes else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *more], schema.fieldNames())

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
