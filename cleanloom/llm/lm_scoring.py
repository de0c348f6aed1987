"""Language-model scores from a weighted backoff automaton over the corpus's own n-grams.

The model interpolates each order with the next lower one: P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu), h' being h
without its first token and mu that of h's length, down to P(w) = (c(w) + 1) / (N + V + 1), where one unit stands for all
unseen tokens. As an automaton, every n-gram below the full order that occurs in training is a state. A state has an arc
for each token seen after it, weighted log10 P(w | h), and a failure arc to the state of h', weighted log10(mu / (c(h) + mu)).
Texts are read from left to right: each token takes the arc of the state carried in, or failure arcs until a state has one,
and the weights on the way add up to its log-probability.

The automaton is as large as the corpus, so no task holds it whole. Documents form blocks of bounded size. A block sends
its distinct n-grams with their counts in training documents, dealt by hash; the receiving tasks add the counts of all
blocks and answer each block's own list. From the answers a block builds exactly the part of the automaton that its texts
can reach. An n-gram leaves a block once, however often it occurs, so frequent ones make no large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import _hashing
from cleanloom.llm._common import input_bytes, shipped
from cleanloom.llm._hashing import mix, packed, token_hashes, unpacked

shipped(__name__)
shipped(_hashing.__name__)

#: Stands for the end of a text.
END = np.uint64(0x0DDC0FFEE0DDF00D)
#: Longer n-grams are sent with so many more bits than number the input's bytes: one in a million meets another by chance.
SPARE_BITS = 20
#: Input bytes of a block of documents: at least, and at most where blocks would else be more than MANY, as each sends to each.
BLOCK_BYTES, MANY = (4 << 20, 32 << 20), 4096
#: Tokens that a lane of the traversal reads; long texts are read in several lanes.
LANE = 512


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each text's words and then its end, and the first position of each text."""
    parts, sizes = [], []
    for _, part in _hashing.chunks(texts):
        h, bounds = token_hashes(part)
        parts.append(np.insert(h, bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _ngrams(tokens: np.ndarray, first: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 2 to order: the positions at which an n-gram within one text ends, and the n-grams' hashes of so many bits."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    out, h = [], tokens
    for n in range(2, order + 1):
        h = np.concatenate((np.zeros(1, np.uint64), mix(mix(h[:-1] + np.uint64(n)) ^ tokens[1:])))
        at = np.flatnonzero(place >= n - 1)
        out.append((at, h[at] >> np.uint64(64 - bits)))
    return out


class _Block:
    """A block's distinct words and distinct longer n-grams, sorted by hash, and where each occurs."""

    def __init__(self, block: pa.Table, order: int, bits: int = 64):
        self.tokens, self.first = _sequence([x or b"" for x in block["text"].cast(pa.binary()).to_pylist()])
        self.grams = _ngrams(self.tokens, self.first, order, bits)
        self.words, index = np.unique(self.tokens, return_inverse=True)
        self.word_index, self.order = index.astype(np.int32), order
        longer = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in self.grams)])
        self.longer, index = np.unique(longer, return_inverse=True)
        self.index = np.split(index.astype(np.int32), np.cumsum([len(h) for _, h in self.grams])[:-1]) if self.grams else []


def _bounds(hashes: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's part of sorted hashes of so many bits begins; the last entry is the end."""
    steps = [(i << bits) // shards for i in range(1, shards)]
    return np.concatenate(([0], np.searchsorted(hashes, np.array(steps, np.uint64)), [len(hashes)]))


def _cut(values: np.ndarray, bounds: np.ndarray, delta: bool = False) -> list[bytes]:
    return [packed(values[a:b], delta) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _requests(order: int, bits: int, shards: int):
    def run(block: pa.Table) -> pa.Table:
        b = _Block(block, order, bits)
        train = np.repeat(~block["held_out"].to_numpy(), np.diff(b.first))
        words = np.bincount(b.word_index[train], minlength=len(b.words))
        longer = np.zeros(len(b.longer), np.int64)
        for (at, _), index in zip(b.grams, b.index, strict=True):
            longer += np.bincount(index[train[at]], minlength=len(longer))
        by_word, by_gram = _bounds(b.words, shards, 64), _bounds(b.longer, shards, bits)
        return pa.table({
            "shard": pa.array(np.arange(shards, dtype=np.int32)),
            "block": pa.array(np.full(shards, block["block"][0].as_py(), np.int32)),
            "words": pa.array(_cut(b.words, by_word, True), pa.binary()),
            "word_counts": pa.array(_cut(words, by_word), pa.binary()),
            "grams": pa.array(_cut(b.longer, by_gram, True), pa.binary()),
            "gram_counts": pa.array(_cut(longer, by_gram), pa.binary()),
        })

    return run


def _totals(lists: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The total of each distinct hash, and for each block its own list's totals."""
    hashes = [unpacked(x, True) for x in lists]
    values, index = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(index, np.concatenate([unpacked(x) for x in counts]).astype(np.float64), len(values)).astype(np.int64)
    bounds = np.cumsum([0, *map(len, hashes)])
    return total, _cut(total[index], bounds)


def _answers(part: pa.Table) -> pa.Table:
    words, word_totals = _totals(part["words"].to_pylist(), part["word_counts"].to_pylist())
    _, gram_totals = _totals(part["grams"].to_pylist(), part["gram_counts"].to_pylist())
    n = part.num_rows
    return pa.table({
        "block": part["block"],
        "shard": part["shard"],
        "word_totals": pa.array(word_totals, pa.binary()),
        "gram_totals": pa.array(gram_totals, pa.binary()),
        "tokens": pa.array(np.full(n, words.sum())),
        "types": pa.array(np.full(n, np.count_nonzero(words))),
    })


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    State 0 is the empty history, then come the block's words, then its longer n-grams below the full order; only those
    that occur in training are ever entered. Arcs are kept by (state, word) in order, failure arcs by state.
    """

    def __init__(self, b: _Block, words: np.ndarray, longer: np.ndarray, unseen: float, mus: tuple[float, ...]):
        order, n_words = b.order, len(b.words)
        states = 1 + n_words + len(b.longer)
        self.n_words = n_words
        self.fail, self.fail_weight = np.zeros(states, np.int32), np.zeros(states)
        # for each order: its distinct n-grams that occur in training, one place where each ends, and the state of each
        place = np.full((order + 1, len(b.tokens)), -1, np.int32)  # the state of the n-gram that ends here, -1 for none
        place[0] = 0
        if order > 1:
            place[1] = np.where(words[b.word_index] > 0, 1 + b.word_index, -1)
        keys, weights, targets = [np.arange(n_words)], [np.log10((words + 1) / unseen)], [np.where((words > 0) & (order > 1), 1 + np.arange(n_words), 0)]
        probability = np.zeros(len(b.tokens))  # of each token after the history of the order below
        probability[:] = 10.0 ** weights[0][b.word_index]
        for n in range(2, order + 1):
            at, index = b.grams[n - 2][0], b.index[n - 2]
            count = longer[index]
            history = place[n - 1][at - 1]
            known = history >= 0
            seen = (words if n == 2 else longer)[np.where(known, history - 1 - (n_words if n > 2 else 0), 0)]
            mu = mus[n - 2]
            # histories are states if they occur in training; their failure arcs drop the first token
            self.fail[history[known]] = place[n - 2][at[known] - 1]
            self.fail_weight[history[known]] = np.log10(mu / (seen[known] + mu))
            lower = probability[at]
            probability[at] = np.where(known, (count + mu * lower) / (seen + mu), lower)
            if n < order:
                place[n][at] = np.where(count > 0, 1 + n_words + index, -1)
            some = np.flatnonzero(count > 0)
            one = some[np.unique(index[some], return_index=True)[1]]
            keys.append(history[one].astype(np.int64) * n_words + b.word_index[at[one]])
            weights.append(np.log10(probability[at[one]]))
            targets.append(place[n][at[one]] if n < order else place[n - 1][at[one]])
        key = np.concatenate(keys)
        by = np.argsort(key)
        self.key, self.weight, self.target = key[by], np.concatenate(weights)[by], np.concatenate(targets)[by].astype(np.int32)

    def read(self, words: np.ndarray, first: np.ndarray, warm: int) -> np.ndarray:
        """The log10 probability of each token of the texts (words by number, bounds of the texts).

        Lanes of all texts go forward together, a token at a time, each carrying its state. A lane that begins within a text
        reads the `warm` tokens before it first, which bring it to the state that the whole text up to there leads to.
        """
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, z, LANE) for a, z in zip(first[:-1], first[1:], strict=True))]).astype(np.int64)
        text = np.searchsorted(first, starts, "right") - 1
        ends = np.minimum(starts + LANE, first[text + 1])
        begin = np.maximum(starts - warm, first[text])
        by = np.argsort(begin - ends, kind="stable")  # the longest lanes first
        begin, length, starts = begin[by], (ends - begin)[by], starts[by]
        out, state = np.zeros(len(words)), np.zeros(len(starts), np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t, "left"))
            at = begin[:live] + t
            word, here, total = words[at], state[:live], np.zeros(live)
            waiting = np.arange(live)
            while len(waiting):
                want = here[waiting] * np.int64(self.n_words) + word[waiting]
                arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                hit = self.key[arc] == want
                done, arc = waiting[hit], arc[hit]
                total[done] += self.weight[arc]
                here[done] = self.target[arc]
                waiting = waiting[~hit]
                total[waiting] += self.fail_weight[here[waiting]]
                here[waiting] = self.fail[here[waiting]]
            own = at >= starts[:live]
            out[at[own]] = total[own]
        return out


def _scores(order: int, bits: int, mus: tuple[float, ...]):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(block, order, bits)
        answers = answers.sort_by("shard")
        joint = lambda name: np.concatenate([np.zeros(0, np.uint64), *(unpacked(x) for x in answers[name].to_pylist())]).astype(np.int64)
        words, longer = joint("word_totals"), joint("gram_totals")
        train_tokens, types = sum(answers["tokens"].to_pylist()), sum(answers["types"].to_pylist())
        unseen = float(train_tokens + types + 1)
        base = np.log10((words + 1) / unseen)[b.word_index]
        weight = Automaton(b, words, longer, unseen, mus).read(b.word_index, b.first, order - 1)
        sums = lambda x: np.add.reduceat(x, b.first[:-1]) if len(x) else np.zeros(0)
        return pa.table({
            "doc_id": block["doc_id"],
            "held_out": block["held_out"],
            "n_tokens": pa.array(np.diff(b.first).astype(np.int64)),
            "n_known": pa.array(sums((words[b.word_index] > 0).astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(b.first) - 1, train_tokens, np.int64)),
            "base_score": pa.array(sums(base).astype(np.float64)),
            "score": pa.array(sums(weight).astype(np.float64)),
        })

    return run


def lm_scores(docs: DataFrame, mus: tuple[float, ...] = (1000.0, 10.0), folds: int = 7, fold: int = 2, block_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text).

    mus are the weights of the lower order under histories of 1, 2, ... tokens; the model's order is one more than there are.

    The model learns from the documents whose crc32(doc_id as text) mod `folds` is not `fold`; a null doc_id counts as
    empty text. A null text is empty: its only token is the end. Tokens are words, A-Z in lower case, of any length. Rows
    that repeat are counted and scored one by one. An empty table gives an empty result; without any training document
    every token is unseen. Other columns of docs are ignored.
    """
    if any(mu <= 0 for mu in mus):
        raise ValueError("every mu must be above 0")
    order = len(mus) + 1
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    size = input_bytes(docs)
    blocks = max(1, -(-size // (block_bytes or min(max(BLOCK_BYTES[0], size // MANY), BLOCK_BYTES[1]))))
    bits = min(64, SPARE_BITS + size.bit_length())
    spark = docs.sparkSession
    tasks = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = blocks
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(tasks, "block")
    sent = keyed.groupBy("block").applyInArrow(_requests(order, bits, shards), "shard int, block int, words binary, word_counts binary, grams binary, gram_counts binary")
    answers = sent.repartition(tasks, "shard").groupBy("shard").applyInArrow(_answers, "block int, shard int, word_totals binary, gram_totals binary, tokens long, types long")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return keyed.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(_scores(order, bits, tuple(mus)), schema)
