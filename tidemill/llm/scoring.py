"""Language-model scoring by cross-entropy difference.

A target model and a background model of the same order count n-grams of the same tokens,
with a start mark before each text: words (`score_words`), or UTF-8 bytes, a vocabulary of 256
that both share by construction (`score`). Both are smoothed alike (interpolated absolute discounting down to the uniform
distribution), so that the difference of their losses is a matter of their counts alone.
Counts cover every token of every document; a document's score is the mean difference of its
per-token losses, target minus background: low scores look like the target.

N-grams of words are 64-bit codes in tables that grow with the corpus: counts, contexts and
losses are made by grouping and joining, and documents are joined with the losses of their
n-grams. Only what makes up more than a millionth of all tokens, of which there is little, is
broadcast or looked up on the spot, so no code of a join has more than that share of the rows.
Contexts are dealt into parts by their code. One part after the other is counted, joined with
the documents and added up, and its tables are deleted, so that only a part's share of the
n-grams is on disk at a time; every part reads the texts again.
The uniform distribution is over all words of the corpus. Tables of bytes are bounded by the
vocabulary, 257 x 256 x 256 trigrams at most; tasks send the n-grams that they saw, added up.

Defined results: a null or empty text has no tokens, losses and score null. With no target
rows, or no background rows, that model is uniform. Target keys that are null or repeated
mark a document once. Repeated rows count and are scored each. Texts are read whole, in
pieces of fixed size. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, numbered, release, slices
from tidemill.llm.neardup import PRIME, _mix

START = 256
BASE = 257
ORDER = 3
PIECE = 1 << 20
#: words are coded in pieces of so many bytes of text, which stay in a processor's cache
NEAR = 1 << 17
#: longer words, in bytes, are coded one by one
LONG = 512
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass(frozen=True)
class LmSettings:
    discount: float = 0.5
    order: int = 2  # of the word models
    frequent: int = 1 << 20  # an n-gram with more than one of so many tokens is looked up, not joined
    piece: int = 16 << 20  # bytes of text that a task works on at a time
    parts: int = 8  # contexts are dealt into so many parts, of which one is on disk at a time


def trigrams(data: bytes) -> Iterator[np.ndarray]:
    """Codes of the (two before, byte) triples of a text, piece by piece."""
    for at in range(0, len(data), PIECE):
        left = data[max(0, at - 2) : at]
        own = np.frombuffer(left + data[at : at + PIECE], np.uint8).astype(np.int32)
        own = np.concatenate((np.full(2 - len(left), START, np.int32), own))
        yield (own[:-2] * BASE + own[1:-1]) * BASE + own[2:]


def count_trigrams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts in target rows, counts in the others) over all rows (text, target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(BASE**ORDER, np.uint32) for _ in range(2)]
        for batch in batches:
            for value, target in zip(batch.column("text"), batch.column("target").to_pylist()):
                for codes in trigrams((value.as_py() or "").encode()):
                    np.add.at(totals[0 if target else 1], codes, 1)
        for which, total in enumerate(totals):
            index = np.flatnonzero(total)
            for at in range(0, len(index), 1 << 18):
                part = index[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), which == 0)), pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))],
                    names=["target", "code", "n"],
                )

    counted = rows.mapInArrow(count, "target boolean, code int, n long")
    both = counted.groupBy("code").agg(
        F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("target"), 0).otherwise(F.col("n"))).alias("b"),
    )
    found = both.toArrow().sort_by("code")  # at most 257 x 257 x 256 rows
    return tuple(found.column(c).to_numpy().astype(np.int64) for c in ("code", "t", "b"))


class Model:
    """Losses in bits of bytes after two others, from trigram counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, discount: float):
        self.d = discount
        self.levels = []
        for n in range(ORDER, 0, -1):
            grams, place = np.unique(codes % BASE**n, return_inverse=True)
            total = np.bincount(place, weights=counts, minlength=len(grams))
            contexts, own = np.unique(grams // BASE, return_inverse=True)
            size = np.bincount(own, weights=total, minlength=len(contexts))
            kinds = np.bincount(own, weights=total > 0, minlength=len(contexts))
            self.levels.append((grams, total, contexts, size, kinds))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / 256)
        for n, (grams, total, contexts, size, kinds) in zip(range(1, ORDER + 1), reversed(self.levels)):
            if not len(grams):
                continue
            wanted = codes % BASE**n
            at = np.minimum(np.searchsorted(grams, wanted), len(grams) - 1)
            count = np.where(grams[at] == wanted, total[at], 0)
            context = np.minimum(np.searchsorted(contexts, wanted // BASE), len(contexts) - 1)
            known = (contexts[context] == wanted // BASE) & (size[context] > 0)
            whole = np.where(known, size[context], 1)
            spare = self.d * kinds[context] / whole
            p = np.where(known, np.maximum(count - self.d, 0) / whole + spare * p, p)
        return p

    def loss(self, codes: np.ndarray) -> np.ndarray:
        return -np.log2(self.probability(codes))


def score(docs: DataFrame, key: str, text: str, targets: DataFrame, target_key: str, settings: LmSettings | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for every row of `docs`.

    `targets` names by `target_key` the rows of `docs` that the target model is made of.
    """
    s = settings or LmSettings()
    marks = targets.select(F.col(target_key).alias("_mark")).filter("_mark is not null").distinct()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = rows.join(marks, F.col("doc_id") == F.col("_mark"), "left")
    marked = marked.select("text", F.col("_mark").isNotNull().alias("target"))
    codes, target, background = count_trigrams(marked)
    # both losses of every trigram that any document has: as many as were counted
    shared = docs.sparkSession.sparkContext.broadcast(
        (codes.astype(np.int32), *(Model(codes, n, s.discount).loss(codes).astype(np.float32) for n in (target, background)))
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *losses = shared.value
        tables = []
        for loss in losses:
            table = np.zeros(BASE**ORDER, np.float32)
            table[known] = loss
            tables.append(table)
        for batch in batches:
            sizes, sums = [], ([], [])
            for value in batch.column("text"):
                data = (value.as_py() or "").encode()
                total = [0.0, 0.0]
                for grams in trigrams(data):
                    for i, table in enumerate(tables):
                        total[i] += float(table[grams].sum(dtype=np.float64))
                sizes.append(len(data))
                for i in (0, 1):
                    sums[i].append(total[i] / len(data) if data else None)
            ours, theirs = sums
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ours, pa.float64()), pa.array(theirs, pa.float64()),
                    pa.array([None if a is None else a - b for a, b in zip(ours, theirs)], pa.float64()),
                ],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts in order, the same on every machine, and the number of words of each text."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    solid = (data != 32) & ((data - np.uint8(9)) > 4)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    for ends, at in ((first, offsets[:-1][full]), (last, offsets[1:][full] - 1)):  # no word goes on in the next text
        ends[at] = solid[at]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    eights = np.zeros(len(data) // 8 + 3, "<u8")
    eights.view(np.uint8)[: len(data)] = data
    codes = _mix(sizes.astype(np.uint64))
    mine, at, left = np.arange(len(starts)), starts, sizes
    for _ in range(LONG // 8):  # eight bytes of every word that has as many left
        shift, cell = (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3), at >> 3
        eight = (eights[cell] >> shift) | ((eights[cell + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        codes[mine] = _mix((codes[mine] ^ (eight & LOW_BYTES[np.minimum(left, 8)])) * PRIME)
        more = left > 8
        mine, at, left = mine[more], at[more] + 8, left[more] - 8
        if not len(mine):
            break
    for i in np.flatnonzero(sizes > LONG):
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        codes[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return codes, np.diff(np.searchsorted(starts, offsets))


def word_grams(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the column text the code of its context, `order` - 1 words, and that of the n-gram one shorter; words per text.

    Their exclusive or is the n-gram's own code; that of a word alone has no context and is as it is.
    """
    contexts, grams, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in slices([batch], "text", NEAR):
        own, counts = word_codes(piece.column("text"))
        ahead = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)  # words of the text before this one
        context, gram = np.zeros(len(own), np.uint64), own
        for n in range(2, order + 1):
            gram, context = gram ^ context, np.full(len(own), n, np.uint64)
            for back in range(n - 1, 0, -1):
                word = np.zeros(len(own), np.uint64)  # the start mark
                word[back:] = np.where(ahead[back:] >= back, own[: max(len(own) - back, 0)], 0)
                context = _mix(context * PRIME + word)
        contexts.append(context)
        grams.append(gram)
        sizes.append(counts)
    return np.concatenate(contexts), np.concatenate(grams), np.concatenate(sizes)


def _mine(contexts: np.ndarray, part: int, s: LmSettings) -> np.ndarray:
    return contexts % np.uint64(s.parts) == part


def count_words(rows: DataFrame, n: int, s: LmSettings, part: int = 0) -> DataFrame:
    """x, g, t, b: n-grams by the codes of `word_grams`, with their counts in target rows and in others; from 2 on those of a part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", s.piece):
            contexts, grams, sizes = word_grams(batch, n)
            flag = np.repeat(batch.column("target").to_numpy(zero_copy_only=False).astype(bool), sizes)
            if n > 1:
                mine = _mine(contexts, part, s)
                contexts, grams, flag = contexts[mine], grams[mine], flag[mine]
            _, first, place = np.unique(contexts ^ grams, return_index=True, return_inverse=True)
            counts = (np.bincount(place[own], minlength=len(first)).astype(np.int64) for own in (flag, ~flag))
            arrays = [pa.array(c[first].view(np.int64)) for c in (contexts, grams)] + [pa.array(c) for c in counts]
            yield pa.RecordBatch.from_arrays(arrays, names=["x", "g", "t", "b"])

    counted = rows.select("text", "target").mapInArrow(count, "x long, g long, t long, b long")
    return counted.groupBy("x", "g").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def _totals() -> list[Column]:
    return [F.sum(c).alias(f"{c}_size") for c in "tb"] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in "tb"]


def _smoothed(c: str, lower: Column, s: LmSettings) -> Column:
    size = F.coalesce(F.col(f"{c}_size"), F.lit(0))
    own = (F.greatest(F.col(c) - s.discount, F.lit(0.0)) + s.discount * F.col(f"{c}_kinds") * lower) / size
    return F.when(size > 0, own).otherwise(lower)


def _joined(rows: DataFrame, table: DataFrame, on: str, often: Column) -> DataFrame:
    """An inner join; the rows of `table` that are met `often`, of which there are few, are broadcast."""
    few = table.filter(often)
    seldom = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(table.filter(~often), on)
    return rows.join(F.broadcast(few), on).unionByName(seldom)


def word_model(words: DataFrame, s: LmSettings) -> DataFrame:
    """g, n, t_p, b_p: probabilities of single words in both models, from their counts."""
    whole = words.agg(*_totals(), F.count("*").alias("words"))
    known = words.crossJoin(F.broadcast(whole))  # one row
    return known.select("g", (F.col("t") + F.col("b")).alias("n"), *(_smoothed(c, 1 / F.col("words"), s).alias(f"{c}_p") for c in "tb"))


def gram_model(rows: DataFrame, n: int, lower: DataFrame, total: int, s: LmSettings, part: int) -> DataFrame:
    """Like `word_model`, written, for the n-grams of a part; `lower` has the probabilities of all that are one word shorter."""
    level = materialize(count_words(rows, n, s, part), "lm-grams")
    contexts = materialize(level.groupBy("x").agg(*_totals()), "lm-contexts")
    joined = _joined(level, contexts, "x", (F.col("t_size") + F.col("b_size")) * s.frequent > total)
    lower = lower.select("g", F.col("n").alias("n_q"), F.col("t_p").alias("t_q"), F.col("b_p").alias("b_q"))
    joined = _joined(joined, lower, "g", F.col("n_q") * s.frequent > total)
    known = joined.select(
        F.col("x").bitwiseXOR(F.col("g")).alias("g"), (F.col("t") + F.col("b")).alias("n"),
        *(_smoothed(c, F.col(f"{c}_q"), s).alias(f"{c}_p") for c in "tb"),
    )
    written = materialize(known, "lm-model")
    release(level, contexts)
    return written


def _part_sums(rows: DataFrame, model: DataFrame, total: int, s: LmSettings, part: int) -> DataFrame:
    """_row, n_tokens, t, b, written: for every text the losses, added up, of its n-grams of a part; part 0 has the number of words."""
    often = F.col("n") * s.frequent > total
    losses = model.select("g", "n", *((-F.log2(f"{c}_p")).alias(f"{c}_loss") for c in "tb"))
    table = losses.filter(often).toArrow().sort_by("g")  # fewer than `frequent` rows over all parts
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("g", "t_loss", "b_loss")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, *known = shared.value
        for batch in slices(batches, "text", s.piece):
            contexts, grams, sizes = word_grams(batch, s.order)
            place = np.repeat(np.arange(len(sizes)), sizes)
            if s.order > 1:
                mine = _mine(contexts, part, s)
                contexts, grams, place = contexts[mine], grams[mine], place[mine]
            grams = (contexts ^ grams).view(np.int64)
            at = np.minimum(np.searchsorted(codes, grams), max(len(codes) - 1, 0))
            hit = codes[at] == grams if len(codes) else np.zeros(len(grams), bool)
            found = [np.bincount(place[hit], weights=loss[at[hit]], minlength=len(sizes)) for loss in known]
            ids, rest = batch.column("_row").to_numpy(), grams[~hit]
            # one row for each text, under any code, then one for each n-gram that is still to be joined
            spread = _mix(ids.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((ids, ids[place[~hit]]))),
                    pa.array(np.concatenate((spread, rest))),
                    pa.array(np.concatenate((sizes if part == 0 else np.zeros_like(sizes), np.zeros(len(rest), np.int64)))),
                    *(pa.concat_arrays([pa.array(f, pa.float64()), pa.nulls(len(rest), pa.float64())]) for f in found),
                ],
                names=["_row", "g", "n_tokens", "t", "b"],
            )

    mapped = rows.select("_row", "text").mapInArrow(look_up, "_row long, g long, n_tokens long, t double, b double")
    joined = mapped.join(losses.filter(~often).drop("n").hint("shuffle_hash"), "g", "left")
    sums = joined.groupBy("_row").agg(F.sum("n_tokens").alias("n_tokens"), *(F.sum(F.coalesce(c, f"{c}_loss")).alias(c) for c in "tb"))
    written = materialize(sums, "lm-sums")
    shared.destroy()
    return written


def score_words(docs: DataFrame, key: str, text: str, targets: DataFrame, target_key: str, settings: LmSettings | None = None) -> DataFrame:
    """Like `score`, with models of words; n_tokens counts words."""
    s = settings or LmSettings()
    marks = targets.select(F.col(target_key).alias("_mark")).filter("_mark is not null").distinct()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = rows.join(marks, F.col("doc_id") == F.col("_mark"), "left").select("doc_id", "text", F.col("_mark").isNotNull().alias("target"))
    rows = numbered(marked, "lm-rows")
    words = materialize(count_words(rows, 1, s), "lm-words")
    total = words.agg(F.sum(F.col("t") + F.col("b"))).first()[0] or 0
    lower = materialize(word_model(words, s), "lm-model")
    release(words)
    used = [lower]
    for n in range(2, s.order):
        models = [gram_model(rows, n, lower, total, s, part) for part in range(s.parts)]
        lower, used = reduce(DataFrame.union, models), used + models
    sums = []
    for part in range(s.parts if s.order > 1 else 1):
        model = gram_model(rows, s.order, lower, total, s, part) if s.order > 1 else lower
        sums.append(_part_sums(rows, model, total, s, part))
        if model is not lower:
            release(model)
    release(*used)
    added = reduce(DataFrame.union, sums).groupBy("_row").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "t", "b")))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    scored = rows.select("_row", "doc_id").join(added, "_row")
    scored = scored.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    written = materialize(scored.withColumn("score", F.col("target_loss") - F.col("background_loss")), "lm-scores")
    release(rows, *sums)
    return written
