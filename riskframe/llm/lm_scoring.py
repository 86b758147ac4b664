"""LM scoring (3): a class-factored gated recurrent language model over the whole corpus.

1. Word counts of all training texts: summed inside the tasks, then by one
   shuffle. They give the unigram base and everything the model says about
   single words.
2. Lexicon: the most frequent words (at most ``lexicon``, the size bound of what
   is broadcast). The first ``explicit`` of them (their number grows with the
   training tokens) are words of the recurrent model, in classes of about equal mass; every other word, known or not, stands
   for its spelling class (checksum of its first two bytes).
3. Encoding: every text's words are looked up once; its symbols, base figures and
   the words outside the lexicon are written, and training and scoring read them.
4. Training: every training document goes through the network once. In each
   round replicas start from the same weights, train by truncated
   backpropagation on their share of a slice of the documents, and the weights
   are averaged, weighted by tokens, in two grouping steps. The number of
   replicas depends on the tokens, a row's replica and place on its key.
5. Scoring: P(text) is the product over its tokens, ends included, of
   P(class | state) P(word | class, state), the state carried through the whole
   document. A word outside the explicit ones has P(word | class) =
   (c + 1) / (N_k + V_k + 1) from the counts of its spelling class, in which the
   unseen words of a class share one place, as in the base. Counts of words
   outside the lexicon come by a join on the word; rare words spread, and a
   frequent one over 64 bytes is the hot side of a join that AQE splits.

Defined results: null text counts as empty (one end token); a null id is a
training row (its checksum is 0); repeated rows are scored each on its own; with
no training text all counts are 0 and the model is uniform over its classes; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import gru
from riskframe.llm.common import id_remainder, pin

END = b"\n"  # no word holds white space
LEXICON = 1 << 18
LONGEST_HEAD_WORD = 64  # bytes, so that the lexicon is bounded in bytes too
EXPLICIT = 1024  # words of the network at least
GROWTH = 10
SPELLING = 96
HIDDEN = 16
ROUNDS = 3
RATE = 0.1
SEED = 11
REPLICA_TOKENS = 4_000_000
CHUNK_TOKENS = 2_000_000
COUNTER_WORDS = 500_000
BLOCK = 4096
BIN = 16  # bins of a doubling of the count
PIECE = 1 << 16  # bytes split into words at a time
HASH_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
HASH_MIX = np.uint64(0xD6E8FEB86659FD93)
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def explicit_words(tokens: int) -> int:
    """Words of the network for so many training tokens: ten times the fourth root, so that a token's cost grows by the eighth."""
    return max(EXPLICIT, int(GROWTH * tokens ** 0.25))


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only; bytes.split() cuts at 0x20 and 0x09-0x0D."""
    return (text or "").encode().lower().split()


def spelling_class(word: bytes, classes: int) -> int:
    return crc32(word[:2]) % classes


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([_strings(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for b in batches:
        for text in b.column(0):
            seen.update(words(text.as_py()))
            seen[END] += 1
            if len(seen) > COUNTER_WORDS:
                yield flush()
    if seen:
        yield flush()


class WordTable:
    """Words of whole texts as numbers, a batch of bytes at a time.

    A word's hash is a polynomial in its bytes, from one running sum over the
    batch; lexicon words lie in an open-addressed table of their hashes.
    """

    def __init__(self, lexicon: list[bytes]) -> None:
        self.power, self.inverse = _powers(PIECE)
        own = [w for w in lexicon if w != END]
        self.hash = np.concatenate([np.empty(0, dtype=np.uint64), *[self.split(b"\n".join(own[i:i + 1024]))[2] for i in range(0, len(own), 1024)]])
        self.number = np.array([i for i, w in enumerate(lexicon) if w != END], dtype=np.int32)
        bits = max(10, (4 * len(self.hash)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(self.hash)), (self.hash >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.table[slot] < 0)
            got, first = np.unique(slot[free], return_index=True)
            self.table[got] = left[free[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[free[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def split(self, low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words of lower-cased bytes."""
        a = np.frombuffer(low, dtype=np.uint8)
        inside = np.zeros(len(a) + 2, dtype=np.int8)
        inside[1:-1] = ~WHITE[a]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        power, inverse = (self.power, self.inverse) if len(a) < PIECE else _powers(len(a) + 1)
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return starts, ends, (h ^ (h >> np.uint64(29))) * HASH_MIX

    def find(self, h: np.ndarray) -> np.ndarray:
        """Lexicon numbers of hashes, -1 outside."""
        out = np.full(len(h), -1, dtype=np.int32)
        left, slot = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            at = self.table[slot]
            used = at >= 0
            hit = used & (self.hash[at] == h[left]) if len(self.hash) else used
            out[left[hit]] = self.number[at[hit]]
            on = used & ~hit
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (HASH_BASE, pow(HASH_BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], bool]]:
    """(bytes, document ends in them, whether the last document goes on) of about PIECE bytes.

    Documents are joined by white space; a long one is cut at white space.
    """
    parts, ends, size = [], [], 0
    for t in texts:
        while len(t) >= PIECE:
            cut = max(t.rfind(w, 0, PIECE - 1) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= 0:  # a word of that length: take all that is left
                break
            if size:
                yield b"".join(parts), ends, False
                parts, ends, size = [], [], 0
            yield t[:cut], [cut], True
            t = t[cut:]
        if size and size + len(t) + 1 > PIECE:
            yield b"".join(parts), ends, False
            parts, ends, size = [], [], 0
        parts += [t, b"\n"]
        size += len(t) + 1
        ends.append(size)
    if parts:
        yield b"".join(parts), ends, False


class Lexicon:
    """What the tasks know of words: a bounded dictionary with counts, and the model's symbols."""

    def __init__(self, entries: list[tuple[bytes, int]], explicit: int, classes: int, spelling: int,
                 class_tokens: np.ndarray, class_kinds: np.ndarray, hidden: int) -> None:
        entries = sorted(entries, key=lambda e: (-e[1], e[0]))
        if END not in {w for w, _ in entries}:
            entries.append((END, 0))
        own = entries[:explicit]
        if END not in {w for w, _ in own}:  # the end is always a word of the model
            end = next(e for e in entries if e[0] == END)
            entries.remove(end)
            entries.insert(len(own) - 1, end)
            own = entries[:explicit]
        self.words = [w for w, _ in entries]
        counts = np.array([n for _, n in entries], dtype=np.float64)
        self.spelling = spelling
        mass = np.cumsum(np.sqrt(counts[:len(own)] + 1))
        cls = np.minimum((mass / mass[-1] * classes).astype(int), classes - 1)
        bounds = np.concatenate([np.searchsorted(cls, np.unique(cls)), [len(own)]])
        self.shape = gru.Shape(hidden, bounds, spelling)
        # the spelling classes hold every word that is not explicit
        for w, n in own:
            if n:
                class_tokens[spelling_class(w, spelling)] -= n
                class_kinds[spelling_class(w, spelling)] -= 1
        self.word_counts = counts[:len(own)]
        self.class_counts = np.concatenate([np.add.reduceat(self.word_counts, bounds[:-1]), class_tokens])
        self.class_cost = np.log10(class_tokens + class_kinds + 1)
        k = np.array([spelling_class(w, spelling) for w in self.words[len(own):]], dtype=np.int64)
        self.log_count = np.log10(counts + 1)
        self.known = counts > 0
        # beside the network's class: nothing for explicit words, the count in the class for others
        self.beside = np.concatenate([np.zeros(len(own)), self.log_count[len(own):] - self.class_cost[k]])
        self.end = self.words.index(END)
        # spelling class by the first two bytes, and by the only byte of a word
        two = [crc32(bytes(x)) % spelling for x in np.array(np.meshgrid(range(256), range(256), indexing="ij")).reshape(2, -1).T.astype(np.uint8)]
        self.spelled = np.array(two, dtype=np.int32), np.array([crc32(bytes([i])) % spelling for i in range(256)], dtype=np.int32)
        self._table: WordTable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[bytes, int]]]:
        """For each text: lexicon numbers of its words, the model's symbols with the end last, words outside the lexicon."""
        if self._table is None:
            self._table = WordTable(self.words)
        table, own = self._table, self.shape.words
        waiting: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        # bytes.lower() changes A-Z only
        for low, ends, more in _pieces([(t or "").encode().lower() for t in texts]):
            starts, stops, h = table.split(low)
            at = table.find(h)
            a = np.frombuffer(low, dtype=np.uint8)
            first = a[starts].astype(np.int64)
            one = stops - starts == 1
            second = a[np.minimum(starts + 1, len(a) - 1)].astype(np.int64) if len(a) else first
            spelled = np.where(one, self.spelled[1][first], self.spelled[0][first * 256 + second])
            symbols = np.where((at >= 0) & (at < own), at, own + spelled).astype(np.int32)
            lo = 0
            for hi in np.searchsorted(starts, ends).tolist():
                missing = np.flatnonzero(at[lo:hi] < 0) + lo
                waiting.append((at[lo:hi], symbols[lo:hi], [low[starts[i]:stops[i]] for i in missing.tolist()]))
                lo = hi
                if more:
                    continue
                if len(waiting) == 1:
                    numbers, symbol, rare = waiting[0]
                else:
                    numbers, symbol = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
                    rare = [x for w in waiting for x in w[2]]
                yield numbers, np.append(symbol, np.int32(self.end)), Counter(rare) if rare else {}
                waiting = []


ENCODED = ("doc_id bigint, held_out boolean, slice int, key bigint, n_tokens bigint, n_known bigint, log_count double, beside double, "
           "symbols binary, rare array<struct<word:string,tf:bigint>>")


def _encode(shared):
    """(doc_id, held_out, slice, key, text) to ENCODED: a text's words are looked up once, for training and for scoring."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        gru.keep_freed_memory()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, known, base, beside, symbol, words_, tfs, heads = [], [], [], [], [], [], [], [0]
                for numbers, symbols, rare in lex.encode(part.column(4).to_pylist()):
                    at = numbers[numbers >= 0] if rare else numbers
                    n.append(len(symbols))
                    known.append(int(lex.known[at].sum()) + int(lex.known[lex.end]))
                    base.append(float(lex.log_count[at].sum() + lex.log_count[lex.end]))
                    own = float(lex.beside[at].sum())
                    if rare:
                        own -= float(lex.class_cost[symbols[:-1][numbers < 0] - lex.shape.words].sum())
                        words_.extend(rare)
                        tfs.extend(rare.values())
                    beside.append(own)
                    symbol.append(symbols.astype("<i4").tobytes())
                    heads.append(len(words_))
                items = pa.StructArray.from_arrays([_strings(words_), pa.array(tfs, pa.int64())], names=["word", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(4)], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(beside, pa.float64()), pa.array(symbol, pa.binary()), pa.ListArray.from_arrays(pa.array(heads, pa.int32()), items)],
                    names=[c.split()[0] for c in ENCODED.split(", ")])
    return run


def _chunks(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_py(), dtype="<i4")


def _blocks(flat: np.ndarray, weight: float) -> pa.RecordBatch:
    parts = [flat[i:i + BLOCK] for i in range(0, len(flat), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([weight] * len(parts)),
                                       pa.array([p.tolist() for p in parts], pa.list_(pa.float32()))], names=["block", "weight", "w"])


def _train(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, end, flat = shared.value
        p, sums = (gru.from_flat(shape, x) for x in np.split(flat, 2))
        trainer = gru.Trainer(p, shape, rate)
        trainer.sums = sums
        docs: list[np.ndarray] = []
        waiting = 0
        for b in batches:
            for symbols in _chunks(b.column(1)):
                docs.append(symbols)
                waiting += len(symbols)
                if waiting >= CHUNK_TOKENS:
                    trainer.fit(docs, end)
                    docs, waiting = [], 0
        if docs:
            trainer.fit(docs, end)
        if trainer.updates:
            yield _blocks(np.concatenate([trainer.p.flat(), trainer.sums.flat()]), float(trainer.tokens))
    return run


def _mean(t: pa.Table) -> pa.Table:
    t = t.sort_by("replica")  # one order of adding up, whatever order the parts come in
    w = t.column("weight").to_numpy()
    flat = t.column("w").combine_chunks().flatten().to_numpy().reshape(len(w), -1)
    mean = (w @ flat.astype(np.float64)) / w.sum()
    return pa.table({"block": t.column("block").slice(0, 1), "weight": pa.array([w.sum()]),
                     "w": pa.array([mean.astype(np.float32).tolist()], pa.list_(pa.float32())), "replica": t.column("replica").slice(0, 1)})


def fit(encoded: DataFrame, lex: Lexicon, tokens: int, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Weights of the model after ``rounds`` of local training and averaging over (key, symbols, slice).

    Rows are dealt by their key to as many replicas as the tokens ask for and read in the order of the
    key, so the weights do not depend on cores, executors or the files' partitions.
    """
    sc = encoded.sparkSession.sparkContext
    first = gru.initial(lex.shape, lex.class_counts, lex.word_counts, seed)
    flat = np.concatenate([first.flat(), np.full(first.flat().size, 1e-4)]).astype(np.float32)
    replicas = max(1, -(-tokens // REPLICA_TOKENS))
    for r in range(rounds):
        shared = sc.broadcast((lex.shape, lex.end, flat))
        dealt = (encoded.filter(F.col("slice") == r).select("key", "symbols").repartition(replicas, "key")
                 .sortWithinPartitions("key", "symbols"))
        trained = dealt.mapInArrow(_train(shared, rate), "block int, weight double, w array<float>").withColumn("replica", F.spark_partition_id())
        kind = "block int, weight double, w array<float>, replica int"
        near = trained.withColumn("near", F.pmod("replica", F.lit(max(1, replicas // 256)))).groupBy("block", "near").applyInArrow(
            lambda t: _mean(t.drop_columns(["near"])), kind)
        rows = near.groupBy("block").applyInArrow(_mean, kind).collect()  # the weights themselves, a fixed number
        if rows:
            flat = np.concatenate([np.array(x["w"], dtype=np.float32) for x in sorted(rows, key=lambda x: x["block"])])
    return np.split(flat, 2)[0]


ROW = "uid bigint, log_net double"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, end, flat = shared.value
        p = gru.from_flat(shape, flat)
        uids: list[int] = []
        docs: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            net = gru.score(p, shape, gru.Lanes(docs, end, gru.MAX_LANES), len(docs)) / np.log(10)
            out = pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(net)], names=["uid", "log_net"])
            uids.clear()
            docs.clear()
            return out

        for b in batches:
            for uid, symbols in zip(b.column(0).to_pylist(), _chunks(b.column(1)), strict=True):
                uids.append(uid)
                docs.append(symbols)
                waiting += len(symbols)
                if waiting >= CHUNK_TOKENS:
                    yield flush()
                    waiting = 0
        if docs:
            yield flush()
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, lexicon: int = LEXICON,
          explicit: int | None = None, classes: int | None = None, spelling: int = SPELLING, hidden: int = HIDDEN, rounds: int = ROUNDS,
          rate: float = RATE, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Without ``explicit`` the words of the network grow with the training tokens (``explicit_words``), in
    about as many ``classes`` as the square root.
    """
    spark: SparkSession = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                      (id_remainder(F.col(f"`{id_col}`"), modulus) == held).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    training = src.filter("not held_out")
    counts = pin(training.select("text").mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
                 .withColumn("bin", F.floor(F.log2("n") * F.lit(BIN)).cast("int")), "words")
    size = F.octet_length("word")
    short = size <= LONGEST_HEAD_WORD
    by_bin = counts.groupBy("bin").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()
    total, kinds = sum(r["n"] for r in by_bin), sum(r["kinds"] for r in by_bin)
    lowest, room = None, lexicon
    for r in sorted(by_bin, key=lambda r: -r["bin"]):  # at most BIN rows a doubling
        room -= r["short"]
        if room < 0:
            break
        lowest = r["bin"]
    in_head = (F.col("bin") >= F.lit(lowest)) & short if lowest is not None else F.lit(False)
    head = [(r["word"].encode(), r["n"]) for r in counts.filter(in_head).select("word", "n").collect()]  # at most `lexicon`
    class_tokens, class_kinds = np.zeros(spelling), np.zeros(spelling)
    spelled = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), 1, 2)), F.lit(spelling))
    for r in counts.groupBy(spelled.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        class_tokens[r["k"]], class_kinds[r["k"]] = r["n"], r["kinds"]
    explicit = explicit or explicit_words(total)
    lex = Lexicon(head, explicit, classes or int(explicit ** 0.5), spelling, class_tokens, class_kinds, hidden)
    shared = spark.sparkContext.broadcast(lex)
    key = F.xxhash64("doc_id", "text")
    slices = F.when(F.col("held_out"), F.lit(-1)).otherwise(F.pmod(key, F.lit(rounds)).cast("int"))
    encoded = src.select("doc_id", "held_out", slices.alias("slice"), F.xxhash64("text", "doc_id").alias("key"), "text").mapInArrow(_encode(shared), ENCODED)
    encoded = pin(encoded.withColumn("uid", F.monotonically_increasing_id()), "symbols", by="slice")
    weights = fit(encoded, lex, total, rounds, rate, seed)

    model = spark.sparkContext.broadcast((lex.shape, lex.end, weights))
    net = encoded.select("uid", "symbols").mapInArrow(_score(model), ROW)
    own = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "log_count", "beside")
    counted = counts.filter(~in_head).select("word", F.col("n").alias("c"))
    rare = (encoded.select("uid", F.inline("rare")).join(counted, "word").groupBy("uid")
            .agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare")))
    out = own.join(net, "uid").join(rare, "uid", "left")
    more = F.coalesce("rare", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(int(total)).cast("bigint").alias("train_tokens"),
                      (F.col("log_count") + more - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
                      (F.col("log_net") + F.col("beside") + more).alias("score"))
