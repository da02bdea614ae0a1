"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The tokenizer file (merges and vocabulary) is a parameter. A text comes in
blocks of any size; tokens leave as soon as no later input can change them.
"""

from __future__ import annotations

import codecs
import contextlib
import functools
import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import small_batches

#: The pre-tokenizer's pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a match that can still change it: a quote and two letters.
PATTERN_LOOKAHEAD = 3
#: Rows whose ids are in memory together.
ROWS = 200
#: Characters of a text that are looked at together.
BLOCK = 1 << 12
#: Pieces whose tokens are remembered by a worker, and the longest of them.
CACHED, CACHED_CHARS = 250_000, 48
#: In place of a rank, where no merge applies.
NONE = (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list over bytes, with the lookahead that its tokens need."""

    def __init__(self, definition: str):
        file = json.loads(definition)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        ids = {t: i for t, i in file["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: raw(t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[left], ids[right]] = (n, ids[left + right])
        self.lookahead = self._sufficient_lookahead()
        self.splitter = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}

    def _sufficient_lookahead(self) -> int:
        """Bytes after a token boundary beyond which input cannot move it.

        Suppose two texts agree up to some point and differ after it, and a merge
        is made in one and not in the other. Then its place was touched earlier,
        by a merge of lower rank that was made in one only and that reaches over
        its right end. So a difference travels left along a chain of tokens whose
        ranks rise, each starting inside the one on its left. For each merge the
        longest way that such a chain can reach beyond its token's end is found in
        the order of ranks: ``best[p]`` is the most that a merge made so far, whose
        token starts with p, reaches, counted from the start of that token.
        """
        best: dict[bytes, int] = defaultdict(int)
        most = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1][0]):
            token = self.bytes_of[a] + self.bytes_of[b]
            beyond = 0
            for start in range(1, len(token)):
                beyond = max(beyond, best.get(token[start:], 0) - (len(token) - start))
            most = max(most, len(token) + beyond)
            for end in range(1, len(token) + 1):
                best[token[:end]] = max(best[token[:end]], len(token) + beyond)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Apply the merge list to all of data: lowest rank first, then leftmost."""
        ids = [self.single[b] for b in data]
        rank = self.rank
        if len(ids) < 100:
            ranks = [rank.get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (low := min(ranks)) is not NONE:
                i = ranks.index(low)
                ids[i : i + 2] = [low[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((ids[i - 1], low[1]), NONE)
                if i < len(ranks):
                    ranks[i] = rank.get((low[1], ids[i + 1]), NONE)
            return ids
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank[a, b][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in rank:
                    heapq.heappush(heap, (rank[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def stable(self, data: bytes) -> tuple[list[int], bytes]:
        """The tokens of data that no continuation can change, and the bytes that are still open."""
        out, at = [], 0
        for x in self.merge(data):
            n = len(self.bytes_of[x])
            if at + n > len(data) - self.lookahead:
                break
            out.append(x)
            at += n
        return out, data[at:]


class Encoder:
    """The transducer: ``feed`` text in blocks, get packed 32-bit ids as soon as they are sure.

    Its memory is the open characters (a block at most) and, within one long
    piece, the open bytes of that piece (a block and the lookahead).
    """

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.m, self.block, self.text, self.open = merges, block, "", None
        self.longest = max(map(len, merges.special), default=0)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def piece(self, piece: str) -> bytes:
        found = self.m.cache.get(piece)
        if found is None:
            found = np.array(self.m.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            if len(piece) <= CACHED_CHARS:
                if len(self.m.cache) >= CACHED:
                    self.m.cache.clear()
                self.m.cache[piece] = found
        return found

    def _long(self, text: str, last: bool) -> bytes:
        """More of a piece that is longer than a block."""
        ids, self.open = self.m.stable((self.open or b"") + text.encode("utf-8", "surrogatepass"))
        if last:
            ids, self.open = ids + self.m.merge(self.open), None
        return np.array(ids, "<u4").tobytes()

    def _continues(self, text: str) -> int:
        """How far the long piece that is open goes on in text."""
        return self.run.match(text).end()

    def _plain(self, text: str, last: bool) -> tuple[list[bytes], str]:
        """Ids of text, and what is still open of it. After ``last`` nothing follows."""
        out: list[bytes] = []
        if self.open is not None:
            end = self._continues(text)
            if end == len(text) and not last:
                hold = 1 if self.kind == "space" else 0
                return [self._long(text[: end - hold], False)], text[end - hold :]
            if self.kind == "space" and end < len(text) and end > 0:
                end -= 1  # the last white space before a word belongs to what follows
            out.append(self._long(text[:end], True))
            text = text[end:]
        pieces = self.m.splitter.findall(text)
        get, make = self.m.cache.get, self.piece
        if last:
            out += [get(p) or make(p) for p in pieces]
            return out, ""
        at, sure = len(text), []
        while pieces and at > len(text) - PATTERN_LOOKAHEAD:
            at -= len(pieces[-1])
            sure.append(pieces.pop())
        out += [get(p) or make(p) for p in pieces]
        rest = text[at:]
        if sure and len(sure[-1]) > self.block:
            out += self._open(sure[-1])
            rest = rest[len(sure[-1]) - self.held :]
        return out, rest

    def _open(self, piece: str) -> list[bytes]:
        """Begin a piece that is longer than a block and may go on."""
        body = piece[1:2] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else piece[0]
        self.kind, self.run = next((k, r) for k, r in RUNS if r.match(body).end())
        self.held = 1 if self.kind == "space" else 0
        return [self._long(piece[: len(piece) - self.held], False)]

    def feed(self, text: str, last: bool = False) -> Iterator[bytes]:
        """Take more text and give what has become sure; ``last`` ends the text."""
        self.text += text
        while self.specials and (found := self.specials.search(self.text)):
            out, _ = self._plain(self.text[: found.start()], True)
            yield from out
            yield np.array([self.m.special[found[0]]], "<u4").tobytes()
            self.text = self.text[found.end() :]
        hold = 0 if last else max(0, self.longest - 1)
        cut = len(self.text) - hold
        if cut > 0 or last:
            out, rest = self._plain(self.text[:cut] if hold else self.text, last)
            yield from out
            self.text = rest + self.text[cut:] if hold else rest


#: The classes of the pattern whose runs have no end of their own.
RUNS = (("letter", regex.compile(r"\p{L}*")), ("number", regex.compile(r"\p{N}*")), ("space", regex.compile(r"\s*")), ("other", regex.compile(r"[^\s\p{L}\p{N}]*")))


def encode(merges: Merges, text: str, block: int = BLOCK) -> Iterator[bytes]:
    """Packed ids of a text, read block by block."""
    encoder = Encoder(merges, block)
    for at in range(0, len(text), block):
        yield b"".join(encoder.feed(text[at : at + block]))
    yield b"".join(encoder.feed("", last=True))


def decode(merges: Merges, ids: Iterable[bytes]) -> Iterator[str]:
    """Text of packed ids that come in blocks.

    A state machine over UTF-8 holds at most the three bytes of an unfinished
    character between blocks; what can never be one becomes U+FFFD.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    of = merges.bytes_of
    for block in ids:
        yield machine.decode(b"".join(map(of.__getitem__, np.frombuffer(block, "<u4").tolist())))
    yield machine.decode(b"", True)


@functools.lru_cache(2)
def load(definition: str) -> Merges:
    """The merge list of a tokenizer definition, once per worker."""
    return Merges(definition)


@contextlib.contextmanager
def lent(definition: str) -> Iterator[Merges]:
    """The merge list for one task, which leaves no pieces behind: idle workers keep what they hold."""
    merges = load(definition)
    try:
        yield merges
    finally:
        merges.cache.clear()


def definition_at(path: str) -> str:
    """The tokenizer definition at a path of the driver; it travels to the workers in a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(docs: DataFrame, path: str):
    small_batches(docs)
    context: SparkContext = docs.sparkSession.sparkContext
    return context.broadcast(definition_at(path))  # a vocabulary file: its size does not depend on the corpus


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Token ids of each whole text: ``id_col, ids`` (array of int).

    A null text is the empty text and has no ids. Repeated rows are encoded one
    by one; an empty table gives no rows; other columns are not read.
    """
    shared = _shared(docs, path)

    def run(batches):
        with lent(shared.value) as merges:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.iloc[at : at + ROWS]
                    yield part[["_id"]].assign(ids=[np.frombuffer(b"".join(encode(merges, t or "")), "<i4") for t in part["_text"]])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Texts of token ids: ``id_col, text``. A null array gives the empty text."""
    shared = _shared(encoded, path)

    def run(batches):
        with lent(shared.value) as merges:
            for batch in batches:
                packed = (np.asarray([] if x is None else x, "<u4") for x in batch["_ids"])
                yield batch[["_id"]].assign(text=["".join(decode(merges, (x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)))) for x in packed])

    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = encoded.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of each text's ids and of what they decode to, block by block.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256``. Neither the ids nor
    the decoded text of a document are ever held whole. Nulls, repeated rows and
    empty tables as in ``encode_documents``.
    """
    shared = _shared(docs, path)

    def digest(merges: Merges, text: str) -> tuple[int, str, str]:
        n, ids, out = 0, hashlib.sha256(), hashlib.sha256()

        def counted():
            nonlocal n
            for block in encode(merges, text):
                n += len(block) // 4
                ids.update(block)
                yield block

        for part in decode(merges, counted()):
            out.update(part.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), out.hexdigest()

    def run(batches):
        with lent(shared.value) as merges:
            for batch in batches:
                found = [digest(merges, t or "") for t in batch["_text"]]
                n, ids, out = map(list, zip(*found, strict=True)) if found else ([], [], [])
                yield batch[["_id"]].assign(n_tokens=n, ids_sha256=ids, decoded_sha256=out)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def encode_checked(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, n_tokens, ids, lossless``: each text's ids, and whether they decode to it again."""
    shared = _shared(docs, path)

    def run(batches):
        with lent(shared.value) as merges:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part, ids, same = batch.iloc[at : at + ROWS], [], []
                    for text in part["_text"]:
                        blocks = list(encode(merges, text or ""))
                        ids.append(np.frombuffer(b"".join(blocks), "<i4"))
                        same.append("".join(decode(merges, blocks)) == (text or ""))
                    yield part[["_id"]].assign(n_tokens=[len(x) for x in ids], ids=ids, lossless=same)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, n_tokens long, ids array<int>, lossless boolean").withColumnRenamed("_id", id_col)
