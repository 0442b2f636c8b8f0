"""Token counts: encoding with a public tokenizer and an exact histogram of lengths.

``Encoder`` gives the ids of texts as packed unsigned 32-bit numbers.  Where the
tokenizer's own file shows that white space only separates words, the ids of a
text are those of its words in turn; then each distinct word is encoded once
and kept in a bounded table.  Any other tokenizer encodes whole texts.

``histogram`` aggregates documents by encoded length.  Running sums from either
end then answer totals, quantiles and truncated totals for every context limit,
exactly, whatever the number of documents.

Defined results: a null or empty text has 0 tokens.  Repeated rows count each
time.  An empty table has an empty histogram; its totals are 0, its quantiles
null.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import settle
from canopy.session import ship_code

TOKENIZER = "word_bpe_49k.json"
#: Bytes of distinct words and their ids kept in a worker since it last put its table aside; as much again is in the table put aside.
KEPT_BYTES = 48 << 20
#: What an entry of the table takes besides its characters and ids, and the most characters of a word that is kept.
ENTRY_BYTES, KEPT_CHARS = 160, 64
#: Characters encoded at a time; a longer text is cut at a space.
PART = 1 << 20

#: White space to Python's split() but not to the tokenizers' patterns.
_ODD = re.compile("[\x1c-\x1f]")
#: Marks that stand alone after a word of letters.
_MARKS = ".,;:!?"
#: A word of Latin letters, and such letters with a run of ASCII marks after them.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
_MARKED = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@[-`{-~]*)").fullmatch
#: Marks that may join what stands before them.
_BOUND = re.compile(r"[!,.:;?](?=[ \n])(?<![a-z0-9\sÀ-ÖØ-öø-įı-ɏ].)")
#: Marks that may form one character with a letter before them, which an upper-case letter may not have.
_COMBINING = re.compile("[\u0300-\u036f]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer's file; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def words_are_separate(spec: dict) -> bool:
    """True if the file's rules never join or look across white space: it is made one blank, dropped between words, and no rule sees a neighbour."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = [s for s in steps if s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = splits[0] if splits else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in pattern and "[\\p{L}]+" in pattern
    rest = all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in splits[1:])
    added = all(not (x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"])) for x in spec.get("added_tokens", []))
    return len(plain) == len(steps) and drops and rest and added and spec.get("post_processor") is None


def byte_letters() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, the others for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts, without special tokens added."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = words_are_separate(spec)
        self.added = [x["content"].lower() for x in spec.get("added_tokens", [])]
        self.kept_bytes, self.held = kept_bytes, 0
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.bytes = dict(enumerate(byte_letters()))

    def _letters(self, word: str) -> bytes:
        """The ids of a word of lower-case Latin letters, which the rules before the model leave whole and as it is."""
        own = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Encode unknown words of at most ``KEPT_CHARS`` characters.  A word of Latin letters and a run of marks is its letters and the run, since the split pattern keeps letters apart from marks."""
        known, aside = self.known, self.aside
        if self.held > self.kept_bytes:
            self.aside, self.known, self.held = known, {}, 0
            known, aside = self.known, known
        before = len(known)
        todo: list[str] = []
        for w in new:
            ids = aside.get(w)
            if ids is not None:
                known[w] = ids
                continue
            form = _MARKED(w)
            if form:
                stem, run = form.groups()
                low = stem.lower()
                if low == w:
                    known[w] = self._letters(w)
                    continue
                if _LATIN(low):  # not so for İ, whose lower case has a mark
                    mark = known.get(run) if run else b""
                    if mark is None:
                        mark = known[run] = self._ids([run])[0]
                    ids = known.get(low)
                    if ids is None:
                        ids = aside.get(low)
                    if ids is None:
                        ids = known[low] = self._letters(low)
                    known[w] = ids + mark
                    continue
            todo.append(w)
        known.update(zip(todo, self._ids(todo), strict=True))
        # an id takes 4 bytes and has a character or more, a character at most 4 bytes
        self.held += (len(known) - before) * ENTRY_BYTES + 8 * sum(map(len, new))

    def _words(self, text: str) -> list[str]:
        """The words of a text, with as few forms as may be: A-Z in lower case, and a mark after a letter or digit as a word of its own.

        The tokenizer does the same with both, but for added tokens, for letters
        that a combining mark follows and for marks in a run; such texts are left as they are.
        """
        if text.isascii():
            low = text.lower()
        elif _COMBINING.search(text):
            return text.split()
        else:
            low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
        if any(x in low for x in self.added):
            return text.split()
        if not _BOUND.search(low):
            for m in _MARKS:
                if m in low:
                    low = low.replace(m + " ", f" {m} ").replace(m + "\n", f" {m}\n")
        return low.split()

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of words: one look-up for each word, and one more for the few that were unknown."""
        flat = list(chain.from_iterable(lists))
        found = list(map(self.known.get, flat))
        holes = [i for i, x in enumerate(found) if x is None]
        if holes:
            new = {flat[i] for i in holes}
            long = [w for w in new if len(w) > KEPT_CHARS]
            self._learn(new.difference(long))
            known, once = self.known, dict(zip(long, self._ids(long), strict=True)) if long else {}
            for i in holes:
                w = flat[i]
                found[i] = known[w] if w not in once else once[w]
        ends = list(accumulate(map(len, lists)))
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, packed."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if not self.by_word or _ODD.search(text):
                yield from self._joined(waiting) if waiting else ()
                waiting, size = [], 0
                yield self._ids([text])[0]
            elif len(text) > PART:
                yield from self._joined(waiting) if waiting else ()
                waiting, size = [], 0
                yield b"".join(self._joined([self._words(part)])[0] for part in parts(text))
            else:
                waiting.append(self._words(text))
                size += len(text)
                if size >= PART:
                    yield from self._joined(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from self._joined(waiting)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end before white space."""
    space = re.compile(r"\s")
    a = 0
    while a < len(text):
        cut = space.search(text, min(a + size, len(text)))
        b = cut.start() if cut else len(text)
        yield text[a:b]
        a = b if b > a else b + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """The number of ids of each text."""
    ship_code()

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(tokenizer_path(tokenizer))
        for texts in batches:
            yield pd.Series([len(x) // 4 for x in own.encode(texts)], dtype="int64")

    return of(text)


def histogram(lengths: DataFrame, length: str = "n_tokens", block: int = 256) -> DataFrame:
    """For each length that occurs: its documents and the sums from either end.

    ``docs_at_least`` and ``tokens_at_least`` are suffix sums; ``docs_up_to`` and
    ``tokens_up_to`` go from below; ``truncated_tokens`` is what remains if every
    document is cut to this length; ``quantile`` is the share of documents up to
    it.  The sums are made within blocks of ``block`` lengths and over the blocks, so no
    task holds more than a block or a row for each block.
    """
    h = settle(lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))  # read twice below
    h = h.withColumns({"block": F.floor(F.col("n_tokens") / block), "tokens": F.col("n_tokens") * F.col("n_docs")})
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before, every = Window.partitionBy("one").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("one")
    blocks = blocks.withColumn("one", F.lit(0)).select(
        "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t")
    )
    h = h.withColumns({"d": F.sum("n_docs").over(up), "t": F.sum("tokens").over(up)}).join(blocks, "block")
    d, t = F.col("d") + F.col("d0"), F.col("t") + F.col("t0")
    return h.select(
        "n_tokens", "n_docs", (F.col("all_d") - d + F.col("n_docs")).alias("docs_at_least"), (F.col("all_t") - t + F.col("tokens")).alias("tokens_at_least"),
        d.alias("docs_up_to"), t.alias("tokens_up_to"), (t + F.col("n_tokens") * (F.col("all_d") - d)).alias("truncated_tokens"), (d / F.col("all_d")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """The tokens that remain if every document is cut to ``limit``, from the histogram."""
    low = hist.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("docs_up_to", "tokens_up_to", (F.col("docs_at_least") - F.col("n_docs")).alias("above")), "n_tokens").alias("x")).first()["x"]
    if low is not None:
        return int(low["tokens_up_to"] + limit * low["above"])
    every = hist.agg(F.max("docs_at_least").alias("n")).first()["n"]
    return int((every or 0) * limit)


def quantile(hist: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents don't exceed."""
    return hist.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n")).first()["n"]


def total(hist: DataFrame) -> int:
    return int(hist.agg(F.max("tokens_at_least").alias("n")).first()["n"] or 0)
