"""A quality classifier: perplexity under a Kneser-Ney model of trusted text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import materialize, only, small, small_batches

#: Characters in a row that the model looks at; the character that stands before each text.
ORDER, BEFORE = 4, " "
#: Parts into which trusted documents fall; each is judged by a model of the others.
FOLDS = 2
#: Ids of trusted documents that are broadcast, at most; with more, the texts are dealt out to them.
IDS = 2_000_000
#: Entries of the model that go to the documents together.
SHARD = 2_000_000
#: Characters of texts that are looked at together, and of one text.
CHARACTERS, BLOCK = 1 << 20, 1 << 18
#: Numbers up to which a table tells which of them are there, even for few characters.
DENSE = 1 << 21
#: Chances below this are those of no character at all.
LEAST = 1e-12
_MODEL = ["model", "lang"]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """The code points of each ``order`` characters in a row as a row, block by block."""
    held = np.full(order - 1, ord(BEFORE), np.uint32)
    for at in range(0, len(text), BLOCK):
        x = np.concatenate([held, _points(text[at : at + BLOCK])])
        held = x[len(x) - order + 1 :]
        yield np.lib.stride_tricks.sliding_window_view(x, order)


def portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in a row whose texts have about CHARACTERS characters together, or one longer text."""
    share = batch["text"].str.len().cumsum() // CHARACTERS
    for _, part in batch.groupby(share.to_numpy(), sort=False):
        yield part


def _numbered(x: np.ndarray, kinds: int) -> tuple[np.ndarray, int]:
    """Values below ``kinds`` as numbers without gaps, in their order, and how many there are; no sort unless they are few for their range."""
    if kinds > max(DENSE, 4 * len(x)):
        own, number = np.unique(x, return_inverse=True)
        return number, len(own)
    seen = np.zeros(kinds, bool)
    seen[x] = True
    own = np.flatnonzero(seen)
    number = np.empty(kinds, np.int64)  # only what was seen is read
    number[own] = np.arange(len(own))
    return number[x], len(own)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different row, and which of them each row is; rows are numbered character by character, without gaps."""
    if not rows.size:
        return np.arange(min(len(rows), 1)), np.zeros(len(rows), np.int64)
    seen = np.zeros(int(rows.max()) + 1, bool)
    for x in rows.T:
        seen[x] = True
    digit, base = np.cumsum(seen) - 1, int(np.count_nonzero(seen))
    which, kinds = digit[rows[:, 0]], base
    for x in rows.T[1:]:
        which, kinds = _numbered(which * base + digit[x], kinds * base)
    at = np.empty(kinds, np.int64)
    at[which] = np.arange(len(rows))
    return at, which


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(rows: np.ndarray, model: int, lang: str) -> np.ndarray:
    """A 64-bit hash of each row of code points in a model, which depends on the length of the row too."""
    seed = int.from_bytes(hashlib.blake2b(f"{model}/{lang}/{rows.shape[1]}".encode(), digest_size=8).digest(), "big")
    h = np.full(len(rows), seed, np.uint64)
    for x in rows.T:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def place(characters: np.ndarray, shards: int) -> np.ndarray:
    """In which part of the model a character's followers are looked up."""
    return (_mixed(characters.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``model, lang, gram, n``: how often each ``order`` characters in a row occur in docs (models, lang, text).

    ``models`` are the models that a text belongs to. What is read together is
    added up before anything is dealt out.
    """

    def run(batches):
        for part in (part for batch in batches for part in portions(batch)):
            for lang, own in part.groupby("lang", dropna=False):
                blocks = [(i, x) for i, text in enumerate(own["text"]) for x in grams(text, order)]
                every = np.concatenate([np.zeros((0, order), np.uint32), *(x for _, x in blocks)])
                at, which = _distinct(every)
                every, owner = every[at], np.repeat(np.array([i for i, _ in blocks], np.int64), [len(x) for _, x in blocks])
                whole = every.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode()
                found = np.array([whole[i : i + order] for i in range(0, len(whole), order)], object)
                for model in sorted({int(m) for models in own["models"] for m in models}):
                    n = np.bincount(which[np.array([model in models for models in own["models"]])[owner]], minlength=len(at))
                    yield pd.DataFrame({"model": model, "lang": lang, "gram": found[n > 0], "n": n[n > 0]})

    counted = docs.select("models", "lang", "text").mapInPandas(run, "model long, lang string, gram string, n long")
    return counted.groupBy(*_MODEL, "gram").agg(F.sum("n").alias("n"))


def _cut(gram: Column, start: int, size: int) -> Column:
    return F.substring(gram, start, size)


def _discounted(counts: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """From ``model, lang, gram, n``: ``model, lang, gram, context, p, left``.

    ``p`` is the interpolated probability of the last character after the others,
    ``left`` the weight that these leave to the lower order. The three discounts
    come from the numbers of grams that occur one to four times.
    """
    known = counts.groupBy(*_MODEL).agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)), F.count("*").alias("kinds"))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
    d = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)), F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}") for i in range(1, 4)]
    rows = counts.join(small(known.select(*_MODEL, "kinds", *d)), _MODEL).withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    rows = rows.withColumn("context", _cut(F.col("gram"), 1, order - 1))
    contexts = materialize(rows.groupBy(*_MODEL, "context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed")))
    rows = rows.join(contexts, [*_MODEL, "context"]).withColumn("left", F.col("freed") / F.col("total")).withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
    if lower is None:  # an unknown character is one kind more
        return rows.select(*_MODEL, "gram", "context", (F.col("own") + F.col("left") / (F.col("kinds") + 1)).alias("p"), "left", (F.col("left") / (F.col("kinds") + 1)).alias("unknown"))
    shorter = lower.select(*_MODEL, F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
    return rows.withColumn("suffix", _cut(F.col("gram"), 2, order - 1)).join(shorter, [*_MODEL, "suffix"]).select(*_MODEL, "gram", "context", (F.col("own") + F.col("left") * F.col("shorter")).alias("p"), "left")


def model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``model, lang, kind, gram, value`` of docs (models, lang, text): interpolated modified Kneser-Ney over characters.

    The highest order has counts, each lower one the number of characters that a
    gram follows. All orders are count tables, dealt out by gram and joined with
    their contexts' totals and with the next lower order. Of kind ``p`` is the
    probability of a gram's last character, of kind ``left`` the weight that a
    context leaves to the lower order, of kind ``unknown`` (empty gram) the
    probability of a character that the text does not have.
    """
    tables = [materialize(count(docs, order))]
    for _ in range(order - 1):
        tables.append(materialize(tables[-1].groupBy(*_MODEL, F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    found, out = None, None
    for n, table in enumerate(reversed(tables), 1):
        found = materialize(_discounted(table, found, n))
        parts = found.select(*_MODEL, F.lit("p").alias("kind"), "gram", F.col("p").alias("value"))
        if n == 1:
            parts = parts.union(found.select(*_MODEL, F.lit("unknown"), F.lit(""), "unknown").distinct())
        else:
            parts = parts.union(found.select(*_MODEL, F.lit("left"), "context", "left").distinct())
        out = parts if out is None else out.union(parts)
    return out


def _entries(table: DataFrame, shards: int) -> DataFrame:
    """``shard, kind, code, value`` of a ``model``: what is looked up after which character; single ones are in every shard."""

    def run(batches):
        for batch in batches:
            for (m, lang, kind, size), part in batch.groupby([*_MODEL, "kind", batch["gram"].str.len()], dropna=False):
                rows = np.array([_points(g) for g in part["gram"]], np.uint32).reshape(len(part), int(size))
                code = codes(rows, int(m), lang).view(np.int64)
                which = {"p": 0, "left": 1, "unknown": 2}[kind]
                if size > 1 or kind == "left":
                    before = rows[:, -1] if kind == "left" else rows[:, -2]
                    yield pd.DataFrame({"shard": place(before, shards), "kind": which, "code": code, "value": part["value"].to_numpy()})
                else:
                    for s in range(shards):
                        yield pd.DataFrame({"shard": s, "kind": which, "code": code, "value": part["value"].to_numpy()})

    return table.mapInPandas(run, "shard int, kind int, code long, value double")


class Shard:
    """One part of the model as sorted arrays."""

    def __init__(self, kind: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.tables = []
        for k in range(3):
            own, values = code[kind == k].view(np.uint64), value[kind == k]
            order = np.argsort(own)
            self.tables.append((own[order], values[order]))

    def get(self, kind: int, code: np.ndarray) -> np.ndarray:
        """The values of codes; NaN for those that are not there."""
        known, value = self.tables[kind]
        if not len(known):
            return np.full(len(code), np.nan)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[at] == code, value[at], np.nan)

    def logs(self, rows: np.ndarray, m: int, lang: str) -> np.ndarray | None:
        """Log-probabilities of the last characters of rows of code points; None without a model."""
        unknown = self.get(2, codes(np.zeros((1, 0), np.uint32), m, lang))[0]
        if np.isnan(unknown):
            return None
        p, order = np.full(len(rows), np.nan), rows.shape[1]
        weight, open_ = np.ones(len(rows)), np.arange(len(rows))
        for n in range(order, 0, -1):  # what a higher order does not have comes from the next lower one, by the weight that is left
            found = self.get(0, codes(rows[open_, order - n :], m, lang))
            here = ~np.isnan(found)
            p[open_[here]] = found[here] * weight[open_[here]]
            open_ = open_[~here]
            if n > 1 and len(open_):
                left = self.get(1, codes(rows[open_, order - n : -1], m, lang))
                weight[open_] *= np.where(np.isnan(left), 1.0, left)
        p[open_] = unknown * weight[open_]
        return np.log(np.maximum(p, LEAST))


def score(docs: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """``id, lang, n_chars, perplexity`` of docs (id, lang, text, model); null for no text or a language without a model.

    The model is split by the character before the one that is judged, so that a
    character needs one shard only. The shards go to the documents one by one,
    SHARD entries each, and leave one sum per document and shard; so neither the
    driver nor a worker ever holds more, and no text is dealt out.
    """
    spark = docs.sparkSession
    table = materialize(table)
    shards = max(1, -(-table.count() // SHARD))
    entries = materialize(_entries(table, shards))
    kind = docs.schema["id"].dataType.simpleString()
    keyed = small_batches(docs).withColumn("row", F.xxhash64("id", "text"))
    sums = None
    for s in range(shards):
        own = entries.filter(F.col("shard") == s).select("kind", "code", "value").toArrow()  # about SHARD entries
        shared = spark.sparkContext.broadcast(Shard(*(own.column(c).to_numpy() for c in own.column_names)))

        def run(batches, s=s, shared=shared):
            for batch in batches:
                for part in portions(batch):
                    total = np.full(len(part), np.nan)
                    for (m, lang), own in part.reset_index(drop=True).groupby(["model", "lang"]):
                        blocks = [(i, x[place(x[:, -2], shards) == s] if shards > 1 else x) for i, t in zip(own.index, own["text"], strict=True) for x in grams(t, order)]
                        if not blocks:
                            continue
                        rows, owner = np.concatenate([x for _, x in blocks]), np.repeat([i for i, _ in blocks], [len(x) for _, x in blocks])
                        first, which = _distinct(rows)
                        logs = shared.value.logs(rows[first], int(m), lang)
                        if logs is not None:
                            touched = own.index[own["text"].str.len() > 0]
                            total[touched] = np.bincount(owner, logs[which], minlength=len(part))[touched]
                    yield part[["id", "lang", "row"]].assign(n_chars=part["text"].str.len(), total=total)

        found = materialize(keyed.select("id", "lang", "text", "model", "row").mapInPandas(run, f"id {kind}, lang string, row long, n_chars long, total double"))
        shared.destroy()  # one shard at a time
        sums = found if sums is None else sums.unionByName(found)
    if shards > 1:
        # A row that is there several times has its sums as often; so have its shards.
        times = F.count("*") / F.lit(shards)
        summed = sums.groupBy("id", "lang", "row", "n_chars").agg((F.sum(F.nanvl("total", F.lit(None))) / times).alias("total"), times.cast("int").alias("times"))
        sums = summed.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    total = F.nanvl("total", F.lit(None).cast("double"))
    return sums.select("id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-total / F.col("n_chars"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """``id, lang, n_chars, perplexity, threshold, kept`` for every document.

    Trusted are documents labelled of quality 1 and not toxic. By a hash of the id
    they fall into ``folds`` parts, and each is judged by a model of the others;
    all other documents are judged by a model of all trusted text of their
    language. The ``quantile`` of the trusted documents' perplexities is the
    language's threshold, and a document is kept if its perplexity is not above it.

    A null text is empty. Empty texts have no perplexity and are not kept. A
    language without trusted text, or whose trusted documents are all in one part,
    has no threshold and keeps all others. A null language is one of its own ("").
    Of repeated labels the worst counts. Repeated rows are judged one by one; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
    trusted = materialize(marks.filter("quality = 1 and toxic = 0 and id is not null").select("id"))
    fold = F.pmod(F.xxhash64("id"), F.lit(folds)) + 1
    without = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(folds).cast("long")), lambda m: m != fold)
    table = model(small_batches(only(rows, trusted, ["id"], IDS)).select("lang", "text", without.alias("models")), order)
    sure = small(trusted.select("id", fold.alias("fold")), IDS)
    scored = materialize(score(rows.join(sure, "id", "left").select("id", "lang", "text", F.coalesce("fold", F.lit(0)).cast("long").alias("model")), table, order))
    limits = only(scored, trusted, ["id"], IDS).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"))
    judged = scored.join(small(limits), "lang", "left")
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
