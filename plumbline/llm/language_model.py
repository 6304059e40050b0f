"""Language-model scores by deleted interpolation of bigrams, unigrams and the uniform distribution.

p(w | v) = a c(v w) / c(v) + b c(w) / N + (1 - a - b) / (V + 1), with one pair of weights for each
doubling of the context's frequency c(v). The weights are learned by expectation-maximisation on deleted
counts: at every position of every training document, counts over all other documents. Positions whose
estimates agree within an eighth of a doubling are one cell, with their mean; so what the rounds
read is bounded, and the error is of second order. A text is its words and one end,
which is also the context of the first word; so a context's count is its count as a token.

Counts cover every training document. Texts are dealt into chunks by a hash. A chunk asks once for each
different n-gram in it, by a 64-bit key, however often it has it: it sends sorted keys with its own
counts to key ranges, which add them up and send the totals back in the same order, with the numbers of
tokens and types. So a word or pair
that every text has costs a key per chunk, and no text meets another. The texts are shuffled once: the
questions and the answers read the same exchange. The counts at all positions are written to the shared
folder; from them the weights are learned and the texts scored.

Null texts are empty: one token, the end. Null ids are never held out. Ties and repeated rows score
alike. An empty table gives an empty table; without training documents every token is unknown and the
uniform distribution alone remains. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shipped
from plumbline.session import stage

shipped(__name__)

#: Doublings of a context's frequency with weights of their own; 0 is for contexts never seen.
BUCKETS = 48
#: Odd multiplier for mixing two words' keys to a pair's.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a pair's key. Words have all 64, as their counts must be right; two of 10 million million pairs
#: sharing a key would only blur an estimate.
PAIR_BITS = 48
#: Documents that a task scores at once.
AT_ONCE = 500
#: Positions, in whole documents, whose counts a task deletes from at once.
BLOCK = 1 << 18
#: Eighths of doublings that a cell tells apart in an estimate; 0 is for none.
EIGHTHS = 512
CELL = ("cell", "n", "pair", "word")


class Grams:
    """The tokens and pairs of some texts: different ones with keys, and where each text has them."""

    def __init__(self, texts):
        places: dict[bytes, int] = {b"": 0}
        at = array("q")
        lengths = []
        for text in texts:
            # for bytes, lower() and split() know ASCII only
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            at.extend(places.setdefault(w, len(places)) for w in words)
            at.append(0)
            lengths.append(len(words) + 1)
        #: Tokens in order; each text ends with word 0, the end.
        self.tokens = np.frombuffer(at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        digest = xxhash.xxh64_intdigest
        self.word_keys = np.fromiter((digest(w) for w in places), dtype=np.uint64, count=len(places))
        before = np.empty_like(self.tokens)
        if len(before):
            before[1:] = self.tokens[:-1]
            before[0] = 0
        self.contexts = before
        pairs, self.pair_of = np.unique(before * len(places) + self.tokens, return_inverse=True)
        with np.errstate(over="ignore"):
            first, second = self.word_keys[pairs // len(places)], self.word_keys[pairs % len(places)]
            mixed = (first * MIX) ^ (first >> np.uint64(29))
            mixed = (mixed + second) * MIX
            self.pair_keys = (mixed ^ (mixed >> np.uint64(32))) * MIX >> np.uint64(64 - PAIR_BITS)

    def counts(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the different words and pairs, by the weight of the text they are in."""
        per = np.repeat(weight, self.lengths)
        words = np.bincount(self.tokens, weights=per, minlength=len(self.word_keys))
        return words.astype(np.int64), np.bincount(self.pair_of, weights=per, minlength=len(self.pair_keys)).astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).clip(0, BUCKETS - 1).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, dtype=np.int64, offset=n) if len(data) > n else 0
    return counts


def narrow(keys: np.ndarray) -> bytes:
    """Pairs' keys without their empty bytes."""
    return keys.view(np.uint8).reshape(-1, 8)[:, : PAIR_BITS // 8].tobytes()


def widened(data: bytes) -> np.ndarray:
    some = np.frombuffer(data, dtype=np.uint8).reshape(-1, PAIR_BITS // 8)
    keys = np.zeros((len(some), 8), dtype=np.uint8)
    keys[:, : PAIR_BITS // 8] = some
    return keys.view(np.uint64).ravel()


def learn(estimates: np.ndarray, buckets: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Mixture weights [bucket, estimate] by expectation-maximisation, where each row of estimates stands for
    ``n`` positions. A bucket starts from the weights of all positions together and counts as ten positions
    of these; the uniform part never vanishes."""

    def maximise(rows: np.ndarray, n: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        weights = start
        for _ in range(rounds):
            share = rows * weights
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            weights = (share.sum(axis=0) + prior * start) / (n.sum() + prior)
        return weights

    def floored(weights: np.ndarray) -> np.ndarray:
        weights = np.maximum(weights, [0.0, 0.0, 1e-4])
        return weights / weights.sum()

    together = maximise(estimates, n, np.full(3, 1 / 3), 1.0)
    unseen = together * [0, 1, 1]
    out = []
    for b in range(BUCKETS):
        of = buckets == b
        out.append(floored(maximise(estimates[of], n[of], unseen / unseen.sum() if b == 0 else together, 10.0)))
    out[0] = floored(out[0] * [0, 1, 1])
    return np.array(out)


def added(cells: list[np.ndarray]) -> list[np.ndarray]:
    """(cell, n, pair, word) with a row for each different cell, the others added up."""
    different, inverse = np.unique(cells[0], return_inverse=True)
    return [different, *(np.bincount(inverse, weights=x, minlength=len(different)) for x in cells[1:])]


def deleted_cells(grams: Grams, training: np.ndarray, word: np.ndarray, pair: np.ndarray, tokens: int) -> list[np.ndarray]:
    """The positions of training texts by cell: (cell, positions, sums of the pair and the word estimates).

    Estimates are from the counts in all other texts. A cell is a context bucket and, for either estimate
    as a multiple of 1 / tokens, an eighth of a doubling.
    """

    def eighth(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, 1 + np.floor(8 * np.log2(np.maximum(x, 1))), 0).clip(0, EIGHTHS - 1).astype(np.int64)

    cells = [np.zeros(0, dtype=np.int64), *(np.zeros(0) for _ in range(3))]
    begins = np.flatnonzero(np.diff(grams.starts // BLOCK, prepend=-1)).tolist()
    for a, b in zip(begins, [*begins[1:], len(grams.starts)]):
        taught, lengths = training[a:b], grams.lengths[a:b]
        at = grams.starts[a] + np.flatnonzero(np.repeat(taught, lengths))
        document = np.repeat(np.arange(b - a), np.where(taught, lengths, 0))

        def deleted(of: np.ndarray, total: np.ndarray) -> np.ndarray:
            """At each position, the count of what stands there in all documents but this one."""
            _, inverse, n = np.unique(document * len(total) + of, return_inverse=True, return_counts=True)
            return np.maximum(total[of] - n[inverse], 0)

        words = deleted(grams.tokens[at], word)
        # the end is once in every text, so the end of the text before counts as much as that of its own
        context = np.roll(words, 1)
        pairs = np.minimum(deleted(grams.pair_of[at], pair), context) / np.maximum(context, 1)
        cell = (bucket_of(context) * EIGHTHS + eighth(pairs * tokens)) * EIGHTHS + eighth(words)
        own = added([cell, np.ones(len(at)), pairs, words / max(tokens, 1)])
        cells = added([np.concatenate(both) for both in zip(cells, own)])
    return cells


def weights(cells: DataFrame, tokens: int) -> np.ndarray:
    """Mixture weights from the cells of all training positions.

    The cells' number is bounded, whatever the size of the table; their sums reach the driver. The uniform
    estimate takes what the others can't explain, whatever its size, so here it is one in all tokens.
    """
    summed = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "pair", "word"))).toArrow()
    cell, n, pair, word = (summed[c].to_numpy() for c in ("cell", "n", "pair", "word"))
    order = np.argsort(cell)
    cell, n, pair, word = cell[order], n[order], pair[order], word[order]
    estimates = np.stack([pair / n, word / n, np.full(len(n), 1.0 / max(tokens, 1))], axis=1)
    return learn(estimates, cell // EIGHTHS**2, n)


def packed_positions(own: np.ndarray, pair: np.ndarray) -> bytes:
    """The counts of a text's words and pairs at each of its positions, byte by byte of the numbers."""
    planes = np.concatenate([own, pair]).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked_positions(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 16 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(2, n)


def score(df: DataFrame, training, id: str = "doc_id", text: str = "text", chunks: int | None = None) -> DataFrame:
    """``id, training, n_tokens, n_known, train_tokens, base_score, score`` for every text.

    ``training`` is a column that says which rows teach. ``chunks``: by default two for each task that
    reads the table, so that a chunk is as large as half a file split; 64 at least.
    """
    rows = df.select(df[id].alias("id"), F.coalesce(df[text], F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    if chunks is None:
        chunks = max(64, 2 * (df.select(F.spark_partition_id().alias("p")).distinct().count()))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))

    def cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int]]:
        """Where each key range begins and ends among sorted keys."""
        edges = np.array([(b << bits) // chunks for b in range(1, chunks)], dtype=np.uint64)
        at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        return list(zip(at, at[1:]))

    def ask(table: pa.Table) -> pa.Table:
        """A row for each key range: the chunk's different keys there, in order, and its training counts."""
        grams = Grams(table["text"].to_pylist())
        columns = []
        for keys, n, bits in zip((grams.word_keys, grams.pair_keys), grams.counts(table["training"].to_numpy().astype(float)), (64, PAIR_BITS)):
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            send = np.ndarray.tobytes if bits == 64 else narrow
            columns += [[send(keys[a:b]) for a, b in cuts(keys, bits)], [packed(n[a:b]) for a, b in cuts(keys, bits)]]
        return pa.table({
            "chunk": pa.array([table["chunk"][0].as_py()] * chunks, pa.int32()),
            "part": pa.array(range(chunks), pa.int32()),
            **{name: pa.array(c, pa.binary()) for name, c in zip(("words", "n_words", "pairs", "n_pairs"), columns)},
        })

    def total(table: pa.Table) -> pa.Table:
        """For each chunk, the totals of its keys in its order; for all, the range's tokens and types."""
        out, sizes = {"chunk": table["chunk"], "part": table["part"]}, []
        for name, read in (("words", lambda x: np.frombuffer(x, dtype=np.uint64)), ("pairs", widened)):
            keys = [read(x.as_py()) for x in table[name]]
            n = np.concatenate([unpacked(x.as_py(), len(k)) for x, k in zip(table[f"n_{name}"], keys)])
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, weights=n).astype(np.int64)
            sizes += [int(sums.sum()), int((sums > 0).sum())]
            ends = np.cumsum([len(k) for k in keys])
            out[name] = pa.array([packed(sums[inverse[e - len(k) : e]]) for k, e in zip(keys, ends)], pa.binary())
        rows = table.num_rows
        return pa.table(out | {"tokens": pa.array([sizes[0]] * rows, pa.int64()), "types": pa.array([sizes[1]] * rows, pa.int64())})

    def look_up(texts: pa.Table, totals: pa.Table) -> pa.Table:
        """Counts at every position of the chunk's texts; the cells of all its texts are in its first row."""
        grams = Grams(texts["text"].to_pylist())
        totals = totals.sort_by("part")
        tokens, types = sum(totals["tokens"].to_pylist()), sum(totals["types"].to_pylist())
        counts = []
        for name, keys, bits in (("words", grams.word_keys, 64), ("pairs", grams.pair_keys, PAIR_BITS)):
            order = np.argsort(keys, kind="stable")
            found = np.empty(len(keys), dtype=np.int64)
            for data, (a, b) in zip(totals[name], cuts(keys[order], bits)):
                found[order[a:b]] = unpacked(data.as_py(), b - a)
            counts.append(found)
        word, pair = counts
        own = word[grams.tokens]
        base = np.log10((own + 1) / (tokens + types + 1))
        each = lambda x: np.add.reduceat(x, grams.starts)  # noqa: E731  no text is without a token
        spans = [slice(a, a + n) for a, n in zip(grams.starts.tolist(), grams.lengths.tolist())]
        cells = deleted_cells(grams, texts["training"].to_numpy(), word, pair, tokens)
        cells[1] = cells[1].astype(np.int64)
        none = [None] * (len(spans) - 1)
        return pa.table({
            "id": texts["id"],
            "training": texts["training"],
            "n_tokens": pa.array(grams.lengths),
            "n_known": pa.array(each((own > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(spans), tokens, dtype=np.int64)),
            "types": pa.array(np.full(len(spans), types, dtype=np.int64)),
            "base_score": pa.array(each(base)),
            "positions": pa.array([packed_positions(own[s], pair[grams.pair_of[s]]) for s in spans], pa.binary()),
            **{
                name: pa.array([x, *none], pa.list_(kind))
                for name, x, kind in zip(CELL, cells, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))
            },
        })

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                lengths = part.column("n_tokens").to_numpy()
                counts = [unpacked_positions(x, n) for x, n in zip(part.column("positions").to_pylist(), lengths.tolist())]
                own, pair = np.concatenate(counts, axis=1)
                tokens, types = part.column("train_tokens")[0].as_py(), part.column("types")[0].as_py()
                context = np.roll(own, 1)  # every text's first context is the end, as its last word is
                bucket = bucket_of(context)
                model = mixture[bucket, 0] * (pair / np.maximum(context, 1))
                model += mixture[bucket, 1] * (own / max(tokens, 1))
                model += mixture[bucket, 2] / (types + 1)
                score = np.add.reduceat(np.log10(model), np.cumsum(lengths) - lengths)
                out = ["id", "training", "n_tokens", "n_known", "train_tokens", "base_score"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(score)], [*out, "score"])

    kind = df.schema[id].dataType.simpleString()
    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, part int, words binary, n_words binary, pairs binary, n_pairs binary")
    totals = asked.groupBy("part").applyInArrow(total, "chunk int, part int, words binary, pairs binary, tokens long, types long")
    scores = f"id {kind}, training boolean, n_tokens long, n_known long, train_tokens long"
    cells = "cell array<long>, n array<long>, pair array<double>, word array<double>"
    counted = stage(
        dealt.groupBy("chunk")
        .cogroup(totals.groupBy("chunk"))
        .applyInArrow(look_up, f"{scores}, types long, base_score double, positions binary, {cells}"),
        "counted",
    )
    any_row = counted.select("train_tokens").first()
    mixture = weights(counted.where(F.col("cell").isNotNull()).select(F.inline(F.arrays_zip(*CELL))), any_row[0] if any_row else 0)
    return counted.drop(*CELL).mapInArrow(finish, f"{scores}, base_score double, score double")
