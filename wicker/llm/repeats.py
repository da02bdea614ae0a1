"""Remove every byte of a string that is long enough and occurs elsewhere too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import digest, materialize, only, small, small_batches
from wicker.llm.suffix_array import common_prefixes, suffix_array

#: Bytes hashed at each place; of all such in a string of the length looked for, the smallest hash is its anchor.
GRAM = 32
#: A place is the low part of a number, its hash the high part, so that equal hashes rank by place.
PLACE = 24
#: Bytes of a text that are looked at together; blocks overlap by the length looked for.
BLOCK = 1 << 22
#: Bytes of a passage that counts as shared: a little less than 51 words of the shortest kind take.
PASSAGE = 240
#: Different surroundings of one anchor that are sorted together; an anchor with more goes window by window.
TOGETHER = 20_000
#: Places between the strings that are looked at first in such an anchor's regions.
APART = 16
#: Strings that occur twice which are broadcast to the regions, at most; with more, all strings are dealt out to them.
AGAIN = 2_000_000
#: Texts whose spans are broadcast to the documents, at most.
SPANS = 200_000
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << PLACE) - 1)


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on; width a power of two."""
    h, span, factor = _BYTE[data], 1, _STEP
    while span < width:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor, span = factor * factor % (1 << 64), 2 * span
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all strings of ``length`` bytes in data: place, hash, first and last start.

    Each string's anchor is the place of its smallest gram hash, the leftmost of
    equals; that depends on its bytes alone. So equal strings, wherever they are,
    have the same anchor hash at the same distance from their start.
    """
    found = []
    for at in range(0, max(1, len(data) - length + 1), BLOCK):
        block = np.frombuffer(data[at : at + BLOCK + length - 1], np.uint8)
        if len(block) < length:
            break
        h = _grams(block, GRAM)
        ranked = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, length - GRAM + 1
        while 2 * span <= width:
            ranked, span = np.minimum(ranked[:-span], ranked[span:]), 2 * span
        if span < width:
            ranked = np.minimum(ranked[: len(ranked) - (width - span)], ranked[width - span :])
        places = (ranked & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        last = np.concatenate([first[1:], [len(places)]]) - 1
        place = places[first]
        found.append((place + at, h[place].view(np.int64), first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def _reach(strings: list[bytes]) -> tuple[list[int], set[int]]:
    """For each string, the longest prefix it shares with another; and the lengths that any two of them share.

    What two strings share is the least of what the neighbours between them share
    in sorted order, so the latter are all lengths there are.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    most, every = [0] * len(strings), set()
    for i, j in zip(order, order[1:], strict=False):
        n = _shared(strings[i], strings[j])
        most[i], most[j] = max(most[i], n), max(most[j], n)
        every.add(n)
    return most, every


def repeated_runs(regions: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """Where strings of ``length`` bytes of one region occur in another at the same distance from the anchor.

    ``regions`` are different byte strings, each with the place of its anchor.
    They are cut, relative to the anchor, wherever two of them begin or cease to
    agree; what lies between two cuts is one symbol, named by its place and bytes,
    and beyond the last cut a region agrees with no other. So the whole group
    becomes a short text of symbols; its suffix array brings equal runs together
    and the common prefix of neighbours, in bytes, is the longest run from there.
    """
    right, ends = _reach([r[a:] for r, a in regions])
    left, starts = _reach([r[:a][::-1] for r, a in regions])
    cuts = sorted({0, *ends, *(-n for n in starts)})
    names: dict[tuple[int, bytes], int] = {}
    text: list[int] = []
    begins: list[tuple[int, int]] = []  # the region and the byte at which each symbol begins
    for k, (r, a) in enumerate(regions):
        if left[k] + right[k] >= length:
            own = [c for c in cuts if -left[k] <= c <= right[k]]
            for c, d in zip(own, own[1:], strict=False):
                text.append(names.setdefault((c, r[a + c : a + d]), len(names)))
                begins.append((k, a + c))
            text.append(-1 - k)
            begins.append((k, a + own[-1]))
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    if not text:
        return out
    order = suffix_array([x + len(regions) + 1 for x in text])
    shared = [*common_prefixes(text, order), 0]
    for at, i in enumerate(order):
        n = max(shared[at], shared[at + 1])
        k, begin = begins[i]
        end = begins[i + n][1]
        if end - begin >= length:
            out[k].append((begin, end))
    return out


def _merged(spans) -> list[tuple[int, int]]:
    """The maximal runs that spans cover; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one key together, as tuples in the order of the columns, from batches that are sorted by it."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else []
        for i, j in zip(starts, [*starts[1:], len(rows)], strict=True):
            if held and keys[i] != now:
                yield now, held
                held = []
            now = keys[i]
            held += rows[i:j]
    if held:
        yield now, held


def _find_regions(docs: DataFrame, least: int, length: int) -> DataFrame:
    """``id, d1, d2, copy, n_bytes, sha, *_REGION``: each row's digest and where the strings lie that begin with a string of an anchor, side by side in arrays."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "sha", *_REGION)}
            for text in batch["text"]:
                data = text.encode("utf-8", "surrogatepass")
                place, key, first, last = anchors(data, least)
                end = np.minimum(last + length, len(data))
                named = [xxhash.xxh3_64_intdigest(data[i:j], seed=at) - (1 << 63) for i, j, at in zip(first.tolist(), end.tolist(), (place - first).tolist(), strict=True)]
                for c, x in zip(_REGION, (key, np.array(named, np.int64), first.astype(np.int32), end.astype(np.int32), (place - first).astype(np.int32)), strict=True):
                    out[c].append(x)
                out["n_bytes"].append(len(data))
                out["sha"].append(hashlib.sha256(data).hexdigest())
            yield batch[["id", "d1", "d2", "copy"]].assign(**out)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInPandas(run, f"id {kind}, d1 long, d2 long, copy long, n_bytes long, sha string, key array<long>, r array<long>, lo array<int>, hi array<int>, at array<int>")


#: What there is of a region: hash of its anchor and of its bytes, where it lies in its text, and the anchor in it.
_REGION = ["key", "r", "lo", "hi", "at"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, d1, d2, copy``: of equal texts, those with the smallest ``copy`` stand for all, so that no group of copies meets in one task."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *digest(F.col(text_col)), F.xxhash64(id_col).alias("copy"))


#: What names one text among its copies.
_OWNER = ["d1", "d2", "copy"]


def _counted_runs(regions: DataFrame, length: int, full: bool) -> DataFrame:
    """``key, r, runs`` of regions (key, r, at, bytes): where strings of ``length`` bytes occur in another at the same distance from the anchor.

    Equal strings are found by counting hashes, so an anchor's regions are never
    gathered. First only strings at every APART-th place: a little longer ones,
    which settle all places around them if they occur twice, and a little shorter
    ones, without which no string around them can. Then the strings at the places
    that are still open, a few at each end of a run; of the regions that share a
    longer one, which may hold such a string too, one gives it for all.
    """
    apart = max(1, min(APART, length // 4))
    kinds = (length - apart, length + apart)
    SHORT, LONG, OPEN = range(3)  # what a string is
    digests = "o long, kind long, h1 long, h2 long"
    place = ["key", "o", "kind", "h1", "h2"]

    def hashed(wanted) -> pd.DataFrame:
        """Rows of all of (key, r, at, bytes, starts, kind, length), whose strings begin at the starts."""
        found = {c: [np.zeros(0, np.int64)] for c in ("key", "r", "o", "kind", "h1", "h2")}
        for key, r, at, data, starts, kind, n in wanted:
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i : i + n]) for i in starts), ">i8").astype(np.int64)
            for c, x in zip(found, (np.full(len(starts), key), np.full(len(starts), r), np.array(starts, np.int64) - at, np.full(len(starts), kind), halves[::2], halves[1::2]), strict=True):
                found[c].append(x)
        return pd.DataFrame({c: np.concatenate(x) for c, x in found.items()})

    def coarse(batches):
        for batch in batches:
            yield hashed((key, r, at, data, list(range(at % apart, len(data) - n + 1, apart)), kind, n) for key, r, at, data in zip(batch["key"], batch["r"], batch["at"], batch["bytes"], strict=True) for kind, n in enumerate(kinds))

    def places(at: int, size: int, hits) -> list[int]:
        """Where the strings begin that are looked at one by one."""
        near = lambda kind, first=False: {x["o"] + at for x in hits if x["kind"] == kind and (x["first"] or not first)}
        around = lambda starts: {i for s in starts for i in range(s, s + apart + 1)}
        left = {i for s in near(SHORT) for i in range(s - apart + 1, s + 1)} - around(near(LONG))
        return sorted(i for i in left | around(near(LONG, True)) if 0 <= i <= size - length)

    def fine(batches):
        for batch in batches:
            yield hashed((key, r, at, data, places(at, len(data), hits), OPEN, length) for key, r, at, data, hits in zip(batch["key"], batch["r"], batch["at"], batch["bytes"], batch["hits"], strict=True))

    def twice(strings: DataFrame) -> DataFrame:
        again = strings.groupBy(*place).agg(F.count("*").alias("times"), F.min("r").alias("least")).filter("times > 1").select(*place, "least")
        return strings.join(small(again, AGAIN), place)

    first = materialize(twice(regions.mapInPandas(coarse, f"key long, r long, {digests}")).groupBy("key", "r").agg(F.collect_list(F.struct("kind", "o", (F.col("r") == F.col("least")).alias("first"))).alias("hits")))  # of one region
    later = twice(regions.join(first, ["key", "r"]).mapInPandas(fine, f"key long, r long, {digests}")).select("key", "r", "kind", "o")
    sure = first.select("key", "r", F.inline("hits")).filter(F.col("kind") == LONG).select("key", "r", "kind", "o")
    size = F.when(F.col("kind") == LONG, length + apart).otherwise(length)
    runs = sure.union(later).groupBy("key", "r").agg(F.collect_list(F.struct("o", size.alias("size"))).alias("found"))
    placed = runs.join(regions.select("key", "r", "at"), ["key", "r"])
    return _joined(placed, full)


def _joined(placed: DataFrame, full: bool) -> DataFrame:
    """``key, r, runs``: the strings (o, size) found from an anchor ``at`` in a region, merged."""
    schema = "key long, r long, runs array<struct<a: int, b: int, full: boolean>>"

    def run(batches):
        for batch in batches:
            merged = [_merged((x["o"] + at, x["o"] + at + x["size"]) for x in found) for at, found in zip(batch["at"], batch["found"], strict=True)]
            yield batch[["key", "r"]].assign(runs=[[{"a": a, "b": b, "full": full} for a, b in x] for x in merged])

    return placed.mapInPandas(run, schema)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What to remove: one row per document, and the spans of each text.

    The documents are ``id, d1, d2, n_bytes, sha``, the spans ``d1, d2, copy,
    spans`` (arrays of (a, b, full): from, to, in bytes, and whether a repeated
    string of ``length`` bytes covers them), where d1 and d2 are the text's digest;
    texts without spans are not among the latter. With a shorter ``passage`` the
    spans of repeated strings of that many bytes are there too.

    1. Every string of the shorter length has an anchor (see ``anchors``); the
       strings of ``length`` bytes that begin with a string of one anchor form a
       region. Only anchors whose hash occurs twice go on.
    2. Equal regions are counted before anything is grouped: one that occurs twice
       is repeated as a whole.
    3. Of anchors with several different regions the bytes are fetched, once per
       region, and each group goes through ``repeated_runs``: its suffix array.
    4. An anchor with over TOGETHER different regions is not gathered: its regions'
       strings are counted by their hashes (see ``_counted_runs``).
    """
    least = min(length, passage or length)
    rows = _rows(docs, id_col, text_col)
    found = materialize(_find_regions(small_batches(rows), least, length))
    documents = found.drop("copy", *_REGION)
    every = found.select(*_OWNER, F.inline(F.arrays_zip(*_REGION)))
    likely = materialize(only(every, every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), ["key"]))
    where = F.struct(*_OWNER, "lo", "hi", "at")
    regions = materialize(likely.groupBy("key", "r").agg(F.count("*").alias("n"), F.min(where).alias("w")).select("key", "r", "n", "w.*"))
    size = F.col("hi") - F.col("lo")
    whole = regions.filter("n > 1").select("key", "r", F.array(F.struct(F.lit(0).alias("a"), size.alias("b"), (size >= length).alias("full"))).alias("runs"))

    several = materialize(regions.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"))  # on its own, so that a join with it can split a hot key
    crowded = several.filter(F.col("kinds") > TOGETHER)

    def fetched(keys: DataFrame) -> DataFrame:
        """``key, r, at, bytes`` of the regions of some anchors; a text is read once for all of them."""
        region = F.struct("key", "r", "lo", "hi", "at")
        needs = regions.join(keys.select("key"), "key", "left_semi").groupBy(*_OWNER).agg(F.collect_list(region).alias("needs"))  # of one text, so bounded by it

        def fetch(batches):
            for batch in batches:
                out = []
                for text, needs in zip(batch["text"], batch["needs"], strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    out += [(x["key"], x["r"], x["at"], data[x["lo"] : x["hi"]]) for x in needs]
                yield pd.DataFrame(out, columns=["key", "r", "at", "bytes"])

        needs = materialize(needs)
        cut = only(rows.select(*_OWNER, "text"), needs, _OWNER).join(needs, _OWNER).dropDuplicates(_OWNER)
        return cut.select("text", "needs").mapInPandas(fetch, "key long, r long, at int, bytes binary")

    def sort(batches):
        out, schema = [], pa.schema([("key", pa.int64()), ("r", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("full", pa.bool_())])))])
        for key, group in _groups(batches, "key"):
            runs = repeated_runs([(data, at) for _, _, at, data in group], least)
            for (_, r, _, _), x in zip(group, runs, strict=True):
                if x:
                    full = _merged((a, b) for a, b in x if b - a >= length)
                    rest = _merged(x) if least < length else []
                    out.append({"key": key, "r": r, "runs": [{"a": a, "b": b, "full": True} for a, b in full] + [{"a": a, "b": b, "full": False} for a, b in rest]})
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    small = fetched(several.filter(F.col("kinds") <= TOGETHER)).repartition("key").sortWithinPartitions("key")
    found_runs = whole.unionByName(small.mapInArrow(sort, "key long, r long, runs array<struct<a: int, b: int, full: boolean>>"))

    if not crowded.isEmpty():
        hot = materialize(fetched(crowded))
        found_runs = found_runs.unionByName(_counted_runs(hot, least, least == length))
        if least < length:
            long = materialize(found_runs.filter(F.exists("runs", lambda x: x["b"] - x["a"] >= length)).join(crowded, "key", "left_semi").select("key", "r").distinct())
            found_runs = found_runs.unionByName(_counted_runs(hot.join(long, ["key", "r"], "left_semi"), length, True))

    runs = materialize(found_runs.groupBy("key", "r").agg(F.flatten(F.collect_list("runs")).alias("runs")))  # of one region
    shifted = F.transform("runs", lambda x: F.struct((x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b"), x["full"].alias("full")))
    places = likely.groupBy("d1", "d2", "key", "lo").agg(F.min("copy").alias("copy"), F.first("r").alias("r"))
    spans = places.join(runs, ["key", "r"]).select(*_OWNER, F.inline(shifted)).groupBy(*_OWNER).agg(F.collect_set(F.struct("a", "b", "full")).alias("spans"))
    return documents, materialize(spans)


def _full(spans) -> list[tuple[int, int]]:
    """The maximal runs that strings of the whole length cover."""
    return _merged((x["a"], x["b"]) for x in spans if x["full"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256``: each document without its repeated strings.

    A byte goes if any string of ``length`` bytes over it starts anywhere else,
    in the same document too; all strings are judged on the input. A null text is
    empty. Repeated rows are occurrences like any other, and each gets its row.
    Null ids are allowed; an empty table gives no rows; other columns are not
    read. With a shorter ``passage`` two more columns, ``passage_bytes`` and
    ``n_passages``, tell how many bytes repeated strings of that length cover, and
    in how many runs; those stay where they are.
    """
    documents, spans = removals(docs, id_col, text_col, length, passage)

    def apply(batches):
        for batch in batches:
            out = []
            for d1, d2, text, found in zip(batch["d1"], batch["d2"], batch["text"], batch["spans"], strict=True):
                data, runs, every = text.encode("utf-8", "surrogatepass"), _full(found), _merged((x["a"], x["b"]) for x in found)
                kept = hashlib.sha256(b"".join(_rest(data, runs))).hexdigest()
                out.append((d1, d2, sum(b - a for a, b in runs), len(runs), kept, sum(b - a for a, b in every), len(every)))
            yield pd.DataFrame(out, columns=["e1", "e2", "n_removed", "n_spans", "kept", "passage_bytes", "n_passages"])

    rows = _rows(docs, id_col, text_col).drop("id")
    cut = only(rows, spans, _OWNER).join(spans, _OWNER).dropDuplicates(_OWNER).mapInPandas(apply, "e1 long, e2 long, n_removed long, n_spans long, kept string, passage_bytes long, n_passages long")
    joined = documents.join(cut, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    counts = ["n_removed", "n_spans"] + (["passage_bytes", "n_passages"] if passage else [])
    filled = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts}
    return joined.select("id", "n_bytes", *map(filled.get, counts[:2]), F.coalesce("kept", "sha").alias("kept_sha256"), *map(filled.get, counts[2:]))


def _rest(data: bytes, runs: list[tuple[int, int]]) -> Iterator[bytes]:
    """What lies outside the runs."""
    at = 0
    for a, b in runs:
        yield data[at:a]
        at = b
    yield data[at:]


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """The documents without their repeated strings, in the columns of docs.

    Bytes of a character that is cut apart go with the string that cuts it. A
    null text stays null; extra columns may have any names.
    ``n_chars``, if there, is set to the new length. Documents of which nothing is
    left keep their row with an empty text.
    """
    _, spans = removals(docs, id_col, text_col, length)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), *digest(F.col(text_col)))
    found = small(spans.select("d1", "d2", "spans"), SPANS)
    joined = keyed.join(found, ["d1", "d2"], "left")

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else b"".join(_rest(t.encode("utf-8", "surrogatepass"), _full(s))).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)])

    out = joined.select("row", rest("text", "spans").alias("left"))
    new = {text_col: F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
