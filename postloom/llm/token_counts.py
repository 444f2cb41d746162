"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair encodings.

For a word of the tokenizer's own splitting, the encoding of each prefix has one last token: a token that ends there and
that may follow the last token of the prefix before it (two tokens may stand side by side if encoding their joined bytes
gives the two again). So one pass over the prefixes finds every count from the counts of shorter prefixes, and no prefix is
encoded again. Over a text, the count at each word's end is the sum so far; a question about a prefix looks up the last word
end before it and the table of the one word that it cuts. Totals of words are kept by each worker, so a text is mostly
look-ups.

Defined results: a null text is empty (0 tokens); rows with repeated or null ids are counted one by one; other columns are
not read; a special token's string inside a text counts as the library's default takes it (one token).
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: Entries that one worker keeps of words' tables and of pairs of tokens, and of words' totals, before it begins anew; of the
#: tokenizer's own words, whose tables take the most time, four times as many. What is kept changes the time, never a count.
KEPT = 200_000
KEPT_TOTALS = 600_000


def tokenizer(name: str):
    """The tokenizer file of a public set by its name, or a file by its path; one thread, as Spark has the cores."""
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts divided by single spaces: the distinct words, each word's place among them, and where each text's words begin."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def slices(batch: pa.RecordBatch, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text, so that long texts don't add up in a worker."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield batch.slice(a, z - a)


def known_codes(index: dict[str, int], words: list[str], kept: int, learn: Callable[[list[str]], None], forget: Callable[[], None]) -> np.ndarray:
    """index of each word, once learn() has been called with those that are new; forget() when too many are kept."""
    if len(index) > kept:
        forget()
    got = list(map(index.get, words))
    if None in got:
        new = [w for w, g in zip(words, got) if g is None]
        for k in range(0, len(new), 20_000):
            learn(new[k : k + 20_000])
        got = list(map(index.__getitem__, words))
    return np.array(got, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_space(c: str) -> bool:
    """White space as the tokenizer's pattern has it, which leaves out the four ASCII separators."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class PrefixCounter:
    """Token counts of all prefixes (in code points) of texts, for a byte-level BPE tokenizer."""

    _SPACE = re.compile(r"\s")
    _SPACED = re.compile(r"\s | \s")
    _ODD = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}] | [\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]|<\\|"

    def __init__(self, name: str = TOKENIZER, kept: int = KEPT) -> None:
        self.library, self.kept = tokenizer(name), kept
        model = json.loads(self.library.to_str())["model"]
        of = byte_alphabet()
        to_bytes = lambda s: bytes(of[c] for c in s)
        self.bytes_of = of
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.vocab = {to_bytes(s): i for s, i in model["vocab"].items() if s not in added}
        tails: dict[bytes, set[int]] = {}
        for token in self.vocab:
            tails.setdefault(token[-3:] if len(token) > 2 else b"", set()).add(len(token))
        #: By a prefix's last three bytes, the sizes of tokens that may end there, from the longest.
        self.sizes = {tail: tuple(sorted(found | {1, 2}, reverse=True)) for tail, found in tails.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [(self.vocab[to_bytes(a)], self.vocab[to_bytes(b)], self.vocab[to_bytes(a + b)]) for a, b in pairs]
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(ids)}
        self.made = {whole: (k, a, b) for k, (a, b, whole) in reversed([*enumerate(ids)])}  # by its first merge
        self.never, self.byte = len(ids), (-1, -1, -1)
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.words: dict[str, bytes | list[int]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.totals: dict[str, int] = {}
        self.firsts: dict[str, int] = {}

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their joined bytes are encoded.

        Going back in time over the merges that make them, the pieces at the border are the token, then its half at the
        border, and so on down to bytes. The two are joined if some two pieces that are there at once have a merge that
        comes before either piece grows; of merges of one rank, the leftmost comes first.
        """
        got = self.beside.get((left, right))
        if got is not None:
            return got
        if len(self.beside) > self.kept:
            self.beside.clear()
        rank, made = self.rank, self.made
        a, b, a_until, b_until, apart = left, right, self.never, self.never, True
        while True:
            joins = rank.get((a, b))
            if joins is not None and joins < a_until and joins <= b_until:
                apart = False
                break
            (a_rank, _, a_half), (b_rank, b_half, _) = made.get(a, self.byte), made.get(b, self.byte)
            if a_rank > b_rank:
                a, a_until = a_half, a_rank
            elif b_rank >= 0:
                b, b_until = b_half, b_rank
            else:
                break
        self.beside[left, right] = apart
        return apart

    def word_counts(self, raw: bytes) -> list[int]:
        """counts[i]: tokens of the encoding of the first i bytes of one word."""
        n, vocab, sizes, beside = len(raw), self.vocab, self.sizes, self.beside
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            for size in sizes.get(raw[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - size
                token = vocab.get(raw[start:end]) if start >= 0 else None
                if token is None:
                    continue
                apart = not start or beside.get((last[start], token))
                if apart if apart is not None else self._may_follow(last[start], token):
                    counts[end], last[end] = counts[start] + 1, token
                    break
        return counts

    def _word(self, mapped: str) -> bytes | list[int]:
        got = self.words.get(mapped)
        if got is None:
            if len(self.words) > 4 * self.kept:
                self.words.clear()
            raw = bytes(map(self.bytes_of.__getitem__, mapped))
            counts = self.word_counts(raw)
            got = [counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            if len(got) == 3 and mapped in ("'re", "'ve", "'ll"):  # half of a contraction is split otherwise
                got = [1, 2, got[2]]
            self.words[mapped] = got = bytes(got) if got[-1] < 256 and max(got) < 256 else got
        return got

    def _pieces(self, texts: list[str]) -> Iterator[bytes]:
        """_piece() of texts without white space, each with a space before it, from one call of the library."""
        split = iter(self.library.pre_tokenizer.pre_tokenize_str(" " + " ".join(texts)))
        at = 0
        for text in texts:
            at += 1 + len(text)
            local: list[int] = []
            base = 0
            for mapped, (_, end) in split:
                local += [base + c for c in self._word(mapped)] if base else self._word(mapped)
                base = local[-1]
                if end == at:
                    break
            yield array("i", local).tobytes()

    def _piece(self, text: str) -> bytes:
        """int32 counts of every prefix of a piece that has no special token."""
        out: list[int] = []
        base = run = 0  # tokens before this word; where the white space before it begins
        for mapped, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text):
            local = self._word(mapped)
            for k in range(start, end):
                if not is_space(text[k]):
                    out.append(base + local[k - start])
                    run = k + 1
                else:  # a prefix that ends in white space has the whole run as one word, whatever follows in the text
                    out.append((out[run - 1] if run else 0) + self._run(text[run : k + 1]))
            base += local[-1]
        return np.array(out, np.int32).tobytes()

    def _run(self, spaces: str) -> int:
        return self._word("".join(m for m, _ in self.library.pre_tokenizer.pre_tokenize_str(spaces)))[-1]

    def _plain(self, text: str) -> np.ndarray:
        if self._SPACED.search(text):  # runs of white space are split by what follows them: take the text as one piece
            return np.frombuffer(self._piece(text), np.int32)
        if len(self.first) + len(self.later) > self.kept:
            self.first.clear(), self.later.clear()
        head, *rest = text.split(" ")
        try:
            parts = [self.first[head], *map(self.later.__getitem__, rest)]
        except KeyError:
            if head not in self.first:
                self.first[head] = self._piece(head)
            new = [w for w in {*rest} if w not in self.later]
            plain = [w for w in new if w and not self._SPACE.search(w)]
            self.later.update(zip(plain, self._pieces(plain)))
            for w in (w for w in new if w not in self.later):
                self.later[w] = self._piece(" " + w)
            parts = [self.first[head], *map(self.later.__getitem__, rest)]
        local = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.cumsum(sizes)
        totals = np.where(sizes > 0, local[np.maximum(ends, 1) - 1] if len(local) else 0, 0)
        return local + np.repeat(np.cumsum(totals) - totals, sizes).astype(np.int32)

    def counts(self, text: str | None) -> np.ndarray:
        """counts[i]: tokens of the first i + 1 code points of the text."""
        text = text or ""
        if not self.special or not (found := [m.span() for m in self.special.finditer(text)]):
            return self._plain(text)
        out, base, at = [], 0, 0
        for start, end in found:
            part = self._plain(text[at:end])  # until its last character, a special string is ordinary text
            whole = int(self._plain(text[at:start])[-1]) if start > at else 0
            out += [part[:-1] + base, [base + whole + 1]]
            base, at = base + whole + 1, end
        return np.concatenate([*out, self._plain(text[at:]) + base]).astype(np.int32)

    def _learn(self, words: list[str]) -> None:
        """Totals of words, each with a space before it: the last counts of their prefix tables, which are kept too."""
        if len(self.later) > self.kept:
            self.later.clear()
        plain = [w for w in words if w and not self._SPACE.search(w)]
        self.later.update(zip(plain, self._pieces(plain)))
        for w in words:
            if w not in self.later:
                self.later[w] = self._piece(" " + w)
            self.totals[w] = int.from_bytes(self.later[w][-4:], sys.byteorder)

    def budgets(self, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its tokens, and the code points of its longest prefix of at most `limit` tokens."""
        texts = pc.fill_null(texts, "")
        tokens, fit = np.zeros(len(texts), np.int64), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = pc.match_substring_regex(texts, self._ODD).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(odd).tolist():
            c = self.counts(texts[k].as_py())
            inside = np.flatnonzero(c <= limit)
            tokens[k], fit[k] = c[-1] if len(c) else 0, inside[-1] + 1 if len(inside) else 0
        rows = np.flatnonzero(~odd)
        words, code, begins = word_codes(texts.filter(pa.array(~odd)))
        if not len(rows):
            return tokens, fit
        total = known_codes(self.totals, words.to_pylist(), KEPT_TOTALS, self._learn, self.totals.clear)[code]
        for k in begins[:-1].tolist():  # a first word has no space before it
            total[k] = self._first(words[code[k]].as_py())
        ends = np.cumsum(total)
        before = np.concatenate([[0], ends])[begins[:-1]]
        tokens[rows] = np.concatenate([[0], ends])[begins[1:]] - before
        for i in np.flatnonzero(tokens[rows] > limit).tolist():
            a, z = begins[i], begins[i + 1]
            k = int(np.searchsorted(ends[a:z], before[i] + limit, "right"))  # the word that goes over
            text = words[code[a + k]].as_py()
            table = self.later.get(text) or self._piece(" " + text) if k else self._piece(text)
            inside = np.frombuffer(table, np.int32) + (ends[a + k - 1] - before[i] if k else 0)
            short = np.flatnonzero(inside <= limit)
            head = sum(len(w) for w in words.take(pa.array(code[a : a + k])).to_pylist()) + max(0, k - 1)
            fit[rows[i]] = head + (short[-1] + 1 if len(short) else 0)
        return tokens, fit

    def _first(self, word: str) -> int:
        got = self.firsts.get(word)
        if got is None:
            if len(self.firsts) > self.kept:
                self.firsts.clear()
            got = self.firsts[word] = int.from_bytes(self._piece(word)[-4:], sys.byteorder)
        return got


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    """One counter a worker, which reuses it for all its tasks."""
    if name not in _COUNTERS:
        _COUNTERS[name] = PrefixCounter(name)
    return _COUNTERS[name]


def prefix_counts(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """doc_id and counts: array<int>, the exact token count of every prefix, by code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "counts": [counter(name).counts(t) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, counts array<int>")


def token_budget(docs: DataFrame, limit: int, name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars: the longest prefix (code points) of at most `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, fit = counter(name).budgets(part.column("text"), limit)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(tokens), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "documents"), 1024)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE_SQL: dict[str, str] = {}
