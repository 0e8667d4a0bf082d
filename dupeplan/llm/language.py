"""Language-model scores from a weighted backoff automaton.

The model is a trigram model over all training texts. A word's probability
after a context is its count there plus ``strength`` times its probability after
the context without its first word, over the context's count plus ``strength``.
As an automaton, the root has an arc for every word; every known word is a state
with an arc for each word seen after it, and every pair seen at least twice is a
state with an arc for each word seen after that. A failure arc leads from a pair
to its last word and from a word to the root; it weighs
``strength / (count + strength)``. The context before a text is the end of
another. A text is scored by one walk from left to right; the state that it
carries is the longest known context.

The model grows with the corpus and is never held in one place. Each chunk of
documents counts its own n-grams and asks for the corpus's counts of them;
shards, whose number follows the input, add the counts up. Triples are asked for
in a second round, those whose context is a state. A chunk then builds the part
of the automaton that its own texts can reach and walks it. An n-gram costs a
shard one entry for each chunk, however often it occurs.

N-grams are told apart by 64-bit hashes. Null and empty texts are the end token
alone. Repeated rows and null keys are scored like any others. Without training
texts every token is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import LOWERED, answered, bound_batches, chunks, fixed_splits, mixed, read_replies, shard_count, shards_of, squeezed, stamp, text_bytes, unsqueezed, words_of, write_replies

#: Counts that the lower order adds to a context of one word, and of two.
STRENGTH = (20.0, 5.0)
#: Occurrences that make a pair a state.
SEEN = 2
#: Added to every unigram count.
ADDED = 0.1
#: Text bytes of a chunk; its part of the automaton must fit a Python worker.
CHUNK = 2 << 20
WORDS, PAIRS, TRIPLES = 0, 1, 2
END_HASH = np.uint64(0xD1B54A32D192ED03)
REQUEST = "kind int, shard int, task int, seq int, stamp long, keys binary, counts binary"
REPLY = "task int, seq int, shard int, kind int, stamp long, totals binary, n_distinct long, n_tokens long"


class Grams:
    """The tokens of a chunk and its distinct words, pairs and triples, each in the order of asking."""

    def __init__(self, table: pa.Table, shards: int):
        words, ids, at = words_of(table.column(1), LOWERED)
        held = table.column(2).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.n, self.shards = len(words) + 1, shards
        end = len(words)
        self.ids = np.insert(ids, at[1:], end)
        self.at = at + np.arange(len(at))
        self.train = np.repeat(~held, np.diff(self.at))
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, end)
        self.hashes = {WORDS: np.append(hashes, END_HASH)}
        self.counts = {WORDS: np.bincount(self.ids[self.train], minlength=self.n)}
        self.before = np.concatenate([[end], self.ids[:-1]])  # a text begins after the end of another
        pairs, self.pair_at = self._distinct(PAIRS, self.before * self.n + self.ids, self.train)
        self._hash(PAIRS, self.hashes[WORDS][pairs // self.n], pairs % self.n)
        first = np.zeros(len(self.ids), bool)
        first[self.at[:-1]] = True
        self.context = np.where(first, -1, np.concatenate([[-1], self.pair_at[:-1]]))

    def _distinct(self, kind: int, keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, whose training counts are kept, and each entry's number among them."""
        by = np.argsort(keys, kind="stable")
        ordered = keys[by]
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.counts[kind] = np.add.reduceat(train[by].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        number = np.empty(len(keys), np.int64)
        number[by] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        return ordered[starts], number

    def _hash(self, kind: int, context: np.ndarray, word: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.hashes[kind] = mixed(context * np.uint64(0x9E3779B97F4A7C15) ^ mixed(self.hashes[WORDS][word] + np.uint64(0x632BE59BD9B4E019)))

    def take_triples(self, pair_totals: np.ndarray) -> None:
        """Finds the triples whose context is a state; ``triple_at`` is -1 where there is none."""
        live = np.flatnonzero((self.context >= 0) & (np.append(pair_totals, 0)[self.context] >= SEEN))
        triples, number = self._distinct(TRIPLES, self.context[live] * self.n + self.ids[live], self.train[live])
        self.triple_at = np.full(len(self.ids), -1)
        self.triple_at[live] = number
        self._hash(TRIPLES, self.hashes[PAIRS][triples // self.n], triples % self.n)

    def requests(self, kinds: tuple[int, ...], task: int, seq: int, mark: int) -> list[dict]:
        rows = []
        for kind in kinds:
            by = np.argsort(self.hashes[kind], kind="stable")
            keys, counts = self.hashes[kind][by], self.counts[kind][by].astype(np.int32)
            shard = shards_of(keys, self.shards)
            edges = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
            rows += [{"kind": kind, "shard": int(shard[a]), "task": task, "seq": seq, "stamp": mark, "keys": squeezed(keys[a:b]), "counts": counts[a:b].tobytes()} for a, b in zip(edges, edges[1:])]
        return rows

    def totals(self, replies: list[dict], kind: int) -> np.ndarray:
        """Corpus counts in the order of the n-grams."""
        hashes = self.hashes[kind]
        parts = [np.frombuffer(r["totals"], np.int64) for r in replies if r["kind"] == kind]
        found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(found) != len(hashes):
            raise RuntimeError("a chunk of documents has changed between two passes; read the documents from a stored table")
        out = np.empty_like(found)
        out[np.argsort(hashes, kind="stable")] = found
        return out


def _add(table: pa.Table) -> pa.Table:
    """One shard: the sums of all chunks' counts, for every chunk that asks."""
    keys = [unsqueezed(x) for x in table.column("keys").to_pylist()]
    sizes = [len(x) for x in keys]
    keys = np.concatenate(keys)
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    by = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]]))
    sums = np.add.reduceat(counts[by], starts)
    totals = np.empty(len(keys), np.int64)
    totals[by] = np.repeat(sums, np.diff(np.append(starts, len(keys))))
    ends = np.cumsum(sizes)
    out = table.select(["task", "seq", "shard", "kind", "stamp"])
    out = out.append_column("totals", pa.array([totals[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary()))
    once = [0] * (table.num_rows - 1)
    out = out.append_column("n_distinct", pa.array([int((sums > 0).sum()), *once], pa.int64()))
    return out.append_column("n_tokens", pa.array([int(sums.sum()), *once], pa.int64()))


class Automaton:
    """The arcs and failure arcs of the states that a chunk's texts can reach; an arc that is not there weighs NaN."""

    def __init__(self, unigram: np.ndarray, counts: np.ndarray, before: np.ndarray, after: np.ndarray, pair_counts: np.ndarray, context: np.ndarray, last: np.ndarray, triple_counts: np.ndarray, strength: tuple[float, float]):
        """``before`` and ``after`` are the words of the pairs; ``context`` and ``last`` the pair that begins a triple and the pair that ends it."""
        one, two = strength
        arc = lambda seen, weight: np.where(seen > 0, np.log10(weight), np.nan)
        self.root = np.log10(unigram)
        self.word_falls = np.where(counts > 0, np.log10(one / (counts + one)), 0.0)
        after_word = (pair_counts + one * unigram[after]) / (counts[before] + one)
        self.word_arcs = arc(pair_counts, after_word)
        self.pair_falls = np.where(pair_counts >= SEEN, np.log10(two / (pair_counts + two)), 0.0)
        self.pair_arcs = arc(triple_counts, (triple_counts + two * after_word[last]) / (pair_counts[context] + two))

    def walk(self, words: np.ndarray, before: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, triples: np.ndarray) -> np.ndarray:
        """Log10 weight of every step.

        The state before a step depends on the two words before it alone, so the
        steps of all texts are taken at once: each by the arc of the longest
        context that has one, after the failure arcs down to there.
        """
        down = self.word_falls[before] + self.root[words]
        step = np.where(np.isnan(self.word_arcs[pairs]), down, self.word_arcs[pairs])
        own = np.append(self.pair_arcs, np.nan)[triples]
        return np.where(np.isnan(own), np.append(self.pair_falls, 0.0)[contexts] + step, own)


def _place(number: np.ndarray, n: int) -> np.ndarray:
    """A place at which each of ``n`` n-grams stands."""
    place = np.zeros(n + 1, np.int64)
    place[number] = np.arange(len(number))  # -1 falls on the last entry
    return place[:n]


def scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", strength: tuple[float, float] = STRENGTH, added: float = ADDED) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score, learned from the rows that are not held out.

    ``docs`` must be a stored table, read the same way each time; a pass that
    meets other rows than the one before it fails.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    fixed_splits(spark)
    plain = docs.select(key, text, F.coalesce(held_out, F.lit(True)).alias("held_out"))
    total = text_bytes(docs, text)
    shards = shard_count(spark, 2 * total)
    request_schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("task", pa.int32()), ("seq", pa.int32()), ("stamp", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    columns = ["kind", "stamp", "totals"]

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for seq, table in chunks(batches, text, CHUNK):
            rows = Grams(table, shards).requests((WORDS, PAIRS), task, seq, stamp(table, key, text))
            yield from pa.Table.from_pylist(rows, request_schema).to_batches()

    def asks_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        found = read_replies(coarse, task, columns)
        for seq, table in chunks(batches, text, CHUNK):
            grams, mark = Grams(table, shards), stamp(table, key, text)
            grams.take_triples(grams.totals(found.of(seq, mark), PAIRS))
            yield from pa.Table.from_pylist(grams.requests((TRIPLES,), task, seq, mark), request_schema).to_batches()

    asked = plain.mapInArrow(asks, REQUEST)
    coarse = write_replies(answered(asked, F.col("kind") * shards + F.col("shard"), 2 * shards, _add, REPLY), "counts", total)
    stored = spark.read.schema(REPLY).parquet(coarse)
    distinct, tokens = (x or 0 for x in stored.where(F.col("kind") == WORDS).agg(F.sum("n_distinct"), F.sum("n_tokens")).first())
    whole = tokens + added * (distinct + 1)
    fine = write_replies(answered(plain.mapInArrow(asks_triples, REQUEST), F.col("shard"), shards, _add, REPLY), "triples", total // 2)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        found, finer = read_replies(coarse, task, columns), read_replies(fine, task, columns)
        for seq, table in chunks(batches, text, CHUNK):
            grams, mark = Grams(table, shards), stamp(table, key, text)
            own = found.of(seq, mark)
            counts, pair_counts = grams.totals(own, WORDS), grams.totals(own, PAIRS)
            grams.take_triples(pair_counts)
            triple_counts = grams.totals(finer.of(seq, mark), TRIPLES)
            unigram = (counts + added) / whole
            pair, triple = _place(grams.pair_at, len(pair_counts)), _place(grams.triple_at, len(triple_counts))
            model = Automaton(unigram, counts, grams.before[pair], grams.ids[pair], pair_counts, grams.context[triple], grams.pair_at[triple], triple_counts, strength)
            weights = model.walk(grams.ids, grams.before, grams.pair_at, grams.context, grams.triple_at)
            at, base = grams.at.tolist(), model.root[grams.ids]
            known = np.concatenate([[0], np.cumsum(counts[grams.ids] > 0)])
            yield from pa.Table.from_arrays(
                [
                    table.column(0).combine_chunks(),
                    table.column(2).combine_chunks(),
                    pa.array(np.diff(grams.at), pa.int64()),
                    pa.array(known[grams.at[1:]] - known[grams.at[:-1]], pa.int64()),
                    pa.array([tokens] * table.num_rows, pa.int64()),
                    pa.array([math.fsum(base[a:b]) for a, b in zip(at, at[1:])], pa.float64()),
                    pa.array([math.fsum(weights[a:b]) for a, b in zip(at, at[1:])], pa.float64()),
                ],
                names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ).to_batches(max_chunksize=10_000)

    kind = docs.schema[key].dataType.simpleString()
    return plain.mapInArrow(walks, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_by_key(key: str = "doc_id", folds: int = 10) -> Column:
    """True where the CRC-32 of the key as text is divisible by ``folds``; null keys are held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0
