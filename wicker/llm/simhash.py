"""Near-duplicate documents by SimHash, found in an inverted index over byte positions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import components, digest, materialize, only, small, small_batches

BYTES = 8
#: Shingles whose hashes are in memory together.
SHINGLES = 1 << 15
SEED = 42
#: Fingerprints of a posting that are compared with each other, at most; one with more is split.
CROWDED = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned.

    ASCII letters are lower-cased; words are runs without ASCII white space; a
    bit is 1 if it is set in over half of the XXH64 hashes of all shingles,
    repeats included. Fewer words than a shingle make one shingle; none give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES):
        upto = min(n, at + SHINGLES)
        first, last = starts[at:upto].tolist(), ends[min(at + shingle, len(words)) - 1 : upto + shingle - 1].tolist()
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)), ">u8", upto - at)
        each = hashes.view(np.uint8).reshape(-1, 8)
        for p in range(8):
            counts[8 * p : 8 * p + 8] += np.bincount(each[:, p], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["_text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["_id"], "fp": found})

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"id {kind}, fp long")


def _shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of an exclusive or are zero."""
    return sum((F.shiftright(x, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(BYTES))


def covering(most: int) -> list[tuple[int, ...]]:
    """Sets of ``most + 1`` byte positions, few, such that any ``most`` positions are together in one of them."""
    left, out = set(combinations(range(BYTES), most)), []
    while left:
        best = max(combinations(range(BYTES), most + 1), key=lambda x: sum(y in left for y in combinations(x, most)))
        left -= set(combinations(best, most))
        out.append(best)
    return out


def _near(values: np.ndarray, most: int) -> Iterator[pd.DataFrame]:
    """Pairs ``a, b`` of distinct fingerprints of one posting that share ``BYTES - most`` bytes and differ in 1 to ``most`` bits."""
    values = np.unique(values)
    for start in range(0, len(values), 512):
        block = values[start : start + 512]
        for other in range(start, len(values), 512):
            x = (block[:, None] ^ values[None, other : other + 512]).view(np.uint64)
            tally = sum(((x >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(BYTES))
            i, j = np.nonzero((tally >= BYTES - most) & (np.bitwise_count(x) <= most))
            i, j = i + start, j + other
            if len(i := i[(up := i < j)]):
                yield pd.DataFrame({"a": values[i], "b": values[j[up]]})


def _mask(positions) -> int:
    """A signed long with the bytes at those positions set."""
    mask = sum(255 << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """``a, b``: all pairs of different fingerprints within ``most`` differing bits, a below b.

    Fingerprints that differ in at most d bits share 8 - d bytes at the same
    positions, the guaranteed minimum. The inverted index has a posting for the
    bytes at each of a few choices of 7 - d positions (see ``covering``), one of
    which holds for any pair that reaches the minimum. The shared positional bytes
    of the pairs of a posting are tallied; those that reach the minimum are
    verified bit by bit.

    The index holds distinct fingerprints only, so copies cost nothing. Postings of
    two, nearly all, come out of a plain aggregation; only fuller ones are
    gathered. One with over CROWDED members is split by each byte that is left, of
    which a pair must share one more, so that none has more than 256 ** d.
    """
    choices = [tuple(p for p in range(BYTES) if p not in out) for out in covering(most)]
    entries = F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_mask(own))).alias("v")) for c, own in enumerate(choices)))
    postings = prints.select("fp", F.inline(entries))
    summed = lambda rows: materialize(rows.groupBy("c", "v").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    full = summed(postings)
    pairs, gathered = full.filter("n = 2").select("a", "b"), [(postings, full.filter((F.col("n") > 2) & (F.col("n") <= CROWDED)))]
    crowded = full.filter(F.col("n") > CROWDED)
    if not crowded.isEmpty():
        finer = [(c, (*own, p)) for c, own in enumerate(choices) for p in range(BYTES) if p not in own]
        more = F.array(*(F.when(F.col("c") == c, F.struct(F.lit(BYTES + n).alias("c"), F.col("fp").bitwiseAND(F.lit(_mask(own))).alias("v"))) for n, (c, own) in enumerate(finer)))
        split = materialize(postings.join(crowded.select("c", "v"), ["c", "v"], "left_semi").select("fp", F.inline(F.filter(more, lambda x: x.isNotNull()))))
        fine = summed(split)
        pairs = pairs.union(fine.filter("n = 2").select("a", "b"))
        gathered.append((split, fine.filter("n > 2")))

    def run(batches):
        for batch in batches:
            for fps in batch["fps"]:
                yield from _near(np.asarray(fps, np.int64), most)

    for rows, keys in gathered:
        groups = rows.join(keys.select("c", "v"), ["c", "v"], "left_semi").groupBy("c", "v").agg(F.collect_list("fp").alias("fps"))
        pairs = pairs.union(groups.select("fps").mapInPandas(run, "a long, b long"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    return pairs.distinct().withColumn("tally", _shared_bytes(x)).filter(F.col("tally") >= BYTES - most).filter(F.bit_count(x) <= most).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """One row per document: ``id, fp, root, component`` by links of at most ``most`` bits.

    ``component`` is the smallest id that can be reached, ``root`` the smallest
    fingerprint of the component. Copies meet in their fingerprint before
    anything is paired; the links are between different fingerprints only and
    stay in the cluster.

    Texts without words have fingerprint 0 and are linked like any other. Null
    ids count only where all ids of a component are null, which then has none.
    Repeated rows each get their row. An empty table gives no rows; columns other
    than the id and the text are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    spread = distinct.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))  # the index makes many rows of one; by "fp" Spark would leave this out
    under = components(links(spread, most))
    rooted = distinct.join(under, distinct["fp"] == under["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    classes = rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "root", "component")
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("id", "fp", "root", "component")


# Near copies by the similarity of their shingles; a wider fingerprint says which of them to verify.

#: Bytes of the wide fingerprint.
WIDE = 24
#: Differing bits up to which a candidate is verified at once: shingle sets of similarity 0.8 differ in about 29 of 192, unrelated ones in 96. It decides which pairs come first, never which are looked at.
FAR = 64
#: Members of a posting that are compared with each other.
TOGETHER = 1000
#: Texts in which common shingles are looked for, how often one occurs there at least, and how many are broadcast at most.
SAMPLE, OFTEN, COMMON = 20_000, 4, 200_000
#: Texts to verify that are broadcast, at most; beyond that the texts are dealt out to them.
OWNERS = 2_000_000


def _families(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """n independent 64-bit hashes out of one, the first unchanged."""
    out = [hashes]
    for f in range(1, n):
        x = hashes ^ np.uint64(f * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return out


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of every shingle of a text, as in ``fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE / 8 signed longs: a SimHash of the distinct shingles in several families."""
    out, distinct = [], np.unique(hashes)
    for h in _families(distinct, WIDE // 8):
        each = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(each[:, p], minlength=256) @ _BITS for p in range(8)])
        out.append(int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big", signed=True))
    return out


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that are common in a sample of the texts, sorted, and their ranks, the most common last.

    They only decide which shingles a posting is made of, never which pairs meet.
    """
    step = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod("d1", F.lit(step)) == 0)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *(np.unique(shingle_hashes(t, shingle)) for t in batch["text"])]).view(np.int64)})

    counts = sample.select("text").mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(hashes), 0, -1)[order]


def rarest(distinct: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n distinct shingle hashes, in an order that is the same for all texts.

    Two sets of that similarity share so many shingles that the first they share
    is among these of both. Common shingles come last.
    """
    if not len(distinct):
        return distinct
    known, ranks = common
    rank = np.zeros(len(distinct), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        rank = np.where(known[at] == distinct, ranks[at], 0)
    most = len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1
    return distinct[np.lexsort((distinct, rank))[:most]]


def _wide_prints(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``id, d1, d2, copy, node, size, f0, f1, f2, keys`` of rows (id, text, d1, d2, copy): a digest of the shingle set, its size, fingerprint and rarest."""
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))  # bounded by COMMON

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch["text"]]
            found = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, WIDE // 8)
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = [rarest(s, similarity, common.value).view(np.int64) for s in sets]
            yield batch[["id", "d1", "d2", "copy"]].assign(node=node, size=[len(s) for s in sets], f0=found[:, 0], f1=found[:, 1], f2=found[:, 2], keys=keys)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, d1 long, d2 long, copy long, node long, size long, f0 long, f1 long, f2 long, keys array<long>")


def proposed(every: DataFrame, most: int = 2) -> DataFrame:
    """``a, b``: each node (node, f0) with the first of its group by SimHash, the smaller id first.

    Groups are the components of ``links``: fingerprints that the index over byte
    positions finds within ``most`` bits. So there are fewer pairs than nodes,
    however many of them are near each other.
    """
    prints = every.select("f0").distinct()
    spread = prints.select(F.col("f0").alias("fp")).repartition(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))  # as in near_duplicates
    under = components(links(spread, most)).select(F.col("node").alias("f0"), "root")
    grouped = every.join(under, "f0", "left").select("node", F.coalesce("root", "f0").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("root", "a")
    return grouped.join(heads, "root").filter("a < node").select("a", F.col("node").alias("b"))


def _forest(nodes: np.ndarray, prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The edges of a minimum spanning forest by differing bits, up to ``most``: no more than there are nodes."""
    left, out = np.arange(1, len(nodes)), []
    near = np.bitwise_count(prints[1:] ^ prints[0]).sum(axis=1)
    where = np.zeros(len(left), np.int64)
    while len(left):
        i = int(near.argmin())
        if near[i] <= most:
            out.append((int(min(nodes[left[i]], nodes[where[i]])), int(max(nodes[left[i]], nodes[where[i]]))))
        now = left[i]
        keep = np.arange(len(left)) != i
        left, near, where = left[keep], near[keep], where[keep]
        other = np.bitwise_count(prints[left] ^ prints[now]).sum(axis=1)
        closer = other < near
        near, where = np.where(closer, other, near), np.where(closer, now, where)
    return out


def _allowed(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of x and y (node, root, part, size, reach) have different roots and may have the similarity, as a matrix."""
    need = similarity / (1 + similarity) * (x[:, None, 3] + y[None, :, 3]) - 1e-6
    return (np.minimum(x[:, None, 4], y[None, :, 4]) >= need) & (x[:, None, 1] != y[None, :, 1])


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of documents (id, text, d1, d2, copy) whose shingle sets have that Jaccard similarity.

    Documents with the same shingle set are one node. Pairs come first from the
    SimHash of the set, by the inverted index over its byte positions (see
    ``proposed``). Texts of that similarity mostly differ in more bits than bytes
    can be shared, so a second index has a posting for each of a node's
    ``rarest`` shingles, in which all pairs of that similarity meet. Keys that no
    other node has count against a node: it shares at most its ``reach``, the
    shingles that are left, and two nodes go on only if that is enough for both of
    them.

    1. All that SimHash proposes goes on. Of a posting of shingles only a spanning forest by differing bits goes on at first, so
       groups of near copies cost as much as they have members; a posting with
       over TOGETHER members is dealt into parts by a hash that differs from key
       to key. These candidates are verified on their whole texts.
    2. Of postings whose members are not of one component yet, the members that
       are allowed a partner of another component, in whatever part, have all their
       shingles counted, which gives the reach without the shingles that one node
       alone has. Pairs of different components that it allows are verified
       likewise.

    So the components are those of all pairs of that similarity; links within one
    component may be missing. Returns ``id, d1, d2, node`` and ``a, b``.
    """
    prints = materialize(_wide_prints(small_batches(docs), shingle, similarity))
    three, owner = ["f0", "f1", "f2"], ["d1", "d2", "copy"]
    every = materialize(prints.groupBy("node").agg(F.min(F.struct(*owner)).alias("w"), *(F.first(c).alias(c) for c in ("size", *three, "keys"))).select("node", "size", *three, "keys", "w.*"))
    members = prints.select("id", "d1", "d2", "node")
    postings = every.select("node", F.explode("keys").alias("k"))
    met = materialize(postings.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1"))
    twos = met.filter("n = 2")
    shared = materialize(only(postings, met.filter("n > 2"), ["k"]))
    seen = twos.select(F.explode(F.array("a", "b")).alias("node")).unionAll(shared.select("node")).groupBy("node").agg(F.count("*").alias("met"))
    reach = F.col("size") - F.size("keys") + F.col("met")
    nodes = materialize(every.join(seen, "node").withColumn("reach", reach).filter(F.col("reach") >= similarity * F.col("size") - 1e-6).select("node", "size", "reach", *three, *owner))

    def sets(batches):
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "s": [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch["text"]]})

    def shingle_sets(wanted: DataFrame) -> DataFrame:
        """``node, s`` of some nodes; of equal texts only the owner's is looked at, which repeated rows may give twice."""
        owners = small(nodes.join(wanted, "node", "left_semi").select("node", *owner), OWNERS)
        return docs.select("text", *owner).join(owners, owner).select("node", "text").mapInPandas(sets, "node long, s array<long>")

    def allowed(pairs: DataFrame, far: int | None = None) -> DataFrame:
        """The pairs for which both reaches are enough, and that differ in no more bits than ``far``."""
        side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}{c}") for c in ("size", "reach", *three)))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        bits = sum(F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in three)
        found = joined.filter(F.least("areach", "breach") >= similarity / (1 + similarity) * (F.col("asize") + F.col("bsize")) - 1e-6)
        return (found if far is None else found.filter(bits <= far)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        own = materialize(shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()).dropDuplicates(["node"]))
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-6).select("a", "b"))

    # Postings with the same members are one, but for the largest, which are dealt out by their keys.
    who = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2)]
    alive = shared.join(nodes.select("node"), "node")
    full = materialize(alive.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), *who).filter("n > 1"))
    same = full.filter((F.col("n") > 2) & (F.col("n") <= TOGETHER)).groupBy("n", "a", "b", "x1", "x2").agg(F.min("k").alias("k"))
    crowd = materialize(same.select("k", "n", "a").union(full.filter(F.col("n") > TOGETHER).select("k", "n", "a")))
    fuller = materialize(alive.join(crowd, "k"))
    parts = F.ceil(F.col("n") / TOGETHER)
    # The least member of a posting is in all its parts, so that parts that are like it are linked.
    part = F.when(F.col("node") == F.col("a"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("k", "node"), parts)))
    gathered = fuller.select("k", "node", F.explode(part).alias("part")).join(nodes.select("node", *three), "node").groupBy("k", "part").agg(F.collect_list(F.struct("node", *three)).alias("members"))

    def run(batches):
        for batch in batches:
            found = set()
            for members in batch["members"]:
                x = np.array([(m["node"], m["f0"], m["f1"], m["f2"]) for m in members], np.int64)
                found.update(_forest(x[:, 0], x[:, 1:].view(np.uint64), FAR))
            yield pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

    pairs = proposed(every).union(twos.select("a", "b")).union(full.filter("n = 2").select("a", "b"))
    tried = materialize(allowed(pairs.distinct()).union(allowed(gathered.select("members").mapInPandas(run, "a long, b long").distinct(), FAR)).distinct())
    found = verified(tried)

    rooted = nodes.join(components(found), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "reach")

    def open_only(rows: DataFrame) -> DataFrame:
        """The rows (k, node, root ...) of postings whose members are not of one component, and how many a posting has."""
        keys = materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("k", "n"))
        return rows.join(keys, "k")

    def meetings(rows: DataFrame, *more: str) -> DataFrame:
        """All pairs of parts of a posting, as ``k, i, j, members``."""
        parts = F.ceil(F.col("n") / TOGETHER)
        dealt = rows.withColumn("own", F.pmod(F.xxhash64("k", "node"), parts))
        one = F.struct("node", "root", "own", "size", "reach", *more).alias("one")
        meets = dealt.select("k", one, "own", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
        return meets.groupBy("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("one").alias("members"))

    def sides(i: int, j: int, members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of either part, and which pairs of them are allowed."""
        x = np.array([(m["node"], m["root"], m["own"], m["size"], m["reach"]) for m in members], np.int64)
        x, y = x[x[:, 2] == i], x[x[:, 2] == j]
        return x[:, 0], y[:, 0], _allowed(x, y, similarity)

    def partnered(batches):
        for batch in batches:
            found = set()
            for i, j, members in zip(batch["i"], batch["j"], batch["members"], strict=True):
                x, y, ok = sides(i, j, members)
                found.update(x[ok.any(axis=1)].tolist(), y[ok.any(axis=0)].tolist())
            yield pd.DataFrame({"node": list(found)}, dtype="int64")

    def listed(batches):
        for batch in batches:
            found = set()
            for k, i, j, members in zip(batch["k"], batch["i"], batch["j"], batch["members"], strict=True):
                x, y, ok = sides(i, j, members)
                keys = {m["node"]: frozenset(m["keys"]) for m in members}
                for a, b in zip(*(v[at].tolist() for v, at in zip((x, y), np.nonzero(ok), strict=True)), strict=True):
                    if min(keys[a] & keys[b]) == k:  # of all postings they share, one lists them
                        found.add((min(a, b), max(a, b)))
            yield pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

    opened = materialize(open_only(fuller.select("k", "node").join(rooted, "node")))
    if opened.isEmpty():
        return members, found
    hopeful = materialize(meetings(opened).mapInPandas(partnered, "node long").distinct())
    shingles = shingle_sets(hopeful).select("node", F.explode("s").alias("s"))
    alone = shingles.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last").groupBy("node").agg(F.count("*").alias("alone"))
    left = opened.drop("n").join(hopeful, "node", "left_semi").join(alone, "node", "left").withColumn("reach", F.least("reach", F.col("size") - F.coalesce("alone", F.lit(0)))).drop("alone")
    left = materialize(open_only(materialize(left.filter(F.col("reach") >= similarity * F.col("size") - 1e-6))))
    own = left.groupBy("node").agg(F.collect_set("k").alias("keys"))  # no more than a node's rarest shingles
    rest = materialize(meetings(left.join(own, "node"), "keys").mapInPandas(listed, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))
    return members, found.union(verified(rest))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, in their columns, one of each group of near copies: that with the smallest id.

    Groups are the components of ``similar_links``. Texts without words are one
    group. Null ids come after all others; of rows that are equal in id and text
    one stays. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *digest(F.col(text_col)), F.xxhash64(id_col).alias("copy"))
    members, found = similar_links(rows, shingle, similarity)
    rooted = members.join(components(found), "node", "left").select("id", "d1", "d2", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "d1", "d2"))
    stays = rooted.groupBy("root").agg(first.alias("x")).select(F.col("x.id").alias("first"), F.col("x.d1").alias("e1"), F.col("x.d2").alias("e2"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), *digest(F.col(text_col)))
    kept = keyed.join(stays, F.col("id").eqNullSafe(F.col("first")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    return kept.dropDuplicates(["d1", "d2", "id"]).select("row.*")
