"""Language ID (7): interpolated Kneser-Ney character language models.

Text is lower-cased, every run of non-letters becomes one space, and each
character is predicted from the two before it. Trigram counts per language are
taken over every whole training text, inside the tasks first, then by one
shuffle of (language, trigram) sums. The model keeps sorted arrays of hashed
trigrams, bigrams and characters; beside each hash stand the finished log
probabilities of all languages, so one sorted search serves them all, and the
back-off weights of the context serve what is not stored. The language with the
lowest bits per character wins.

Rejection is calibrated on the training documents. The excess of a document's
bits per character over its language's mean, scaled by the square root of its
length, is measured for all of them; a document is rejected if its scaled
excess is beyond ``reject_factor`` times the ``reject_quantile`` of that and its
bits are nearer to what characters drawn uniformly from its language's own would
cost than to its language. A text without letters is rejected.

Defined results: null text, or no letter, is ``und`` with score 0 and rejected;
a tie goes to the first name in order; with nothing to learn from everything is
``und``; rows with null lang are never learned from; repeated rows count each
on its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import id_remainder, keep_rows, pin, row_keys

UND = "und"
SPACE = 0x20
BITS = 21  # a code point
MAX_NGRAMS = 1_000_000
MAX_CELLS = 1 << 24  # entries × languages of what is broadcast
CHUNK = 1 << 20
SCORE_CHARS = 32
REJECT_QUANTILE = 0.99
REJECT_FACTOR = 4.0
# odd, so that multiplying modulo 2**64 is one to one: equal hashes mean equal n-grams
MIX = np.uint64(0x9E3779B97F4A7C15)

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of other characters is one space; none at the ends."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter
    out = np.where(letter, cp, SPACE)[keep]
    return out[:-1] if len(out) and out[-1] == SPACE else out


def trigrams(c: np.ndarray) -> np.ndarray:
    """Packed trigrams that end at each character of ``c``; two spaces stand before it."""
    x = np.concatenate([np.full(2, SPACE, dtype=np.uint64), c.astype(np.uint64)])
    return (x[:-2] << np.uint64(2 * BITS)) | (x[1:-1] << np.uint64(BITS)) | x[2:]


def hashed(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint64) * MIX


def _pieces(c: np.ndarray) -> Iterator[np.ndarray]:
    """The trigrams of a text of any length, a bounded number at a time."""
    keys_from = 0
    while keys_from < len(c):
        part = c[max(0, keys_from - 2):keys_from + CHUNK]
        yield trigrams(part)[0 if keys_from == 0 else min(2, keys_from):]
        keys_from += CHUNK


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, trigram, n) of a task's documents."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def settle(lang: str) -> None:
        key, n = np.unique(np.concatenate(waiting[lang]), return_counts=True)
        if lang in sums:
            both = np.concatenate([sums[lang][0], key])
            key, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([sums[lang][1], n]), minlength=len(key)).astype(np.int64)
        sums[lang] = (key, n)
        waiting[lang], size[lang] = [], 0

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for keys in _pieces(codes(text.as_py())):
                waiting.setdefault(lang, []).append(keys)
                size[lang] = size.get(lang, 0) + len(keys)
                if size[lang] >= 2 * CHUNK:
                    settle(lang)
    for lang in waiting:
        if size[lang]:
            settle(lang)
    for lang, (key, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)],
                                         names=["lang", "gram", "n"])


class Model(NamedTuple):
    """Sorted hash arrays with a row of log2 probabilities (one column a language) for each entry."""

    langs: list[str]
    tri: np.ndarray
    tri_p: np.ndarray
    bi: np.ndarray
    bi_p: np.ndarray
    bi_bow: np.ndarray  # back-off weight of a bigram as context
    uni: np.ndarray
    uni_p: np.ndarray
    uni_bow: np.ndarray
    unknown_p: np.ndarray
    flat_bits: np.ndarray  # cost of a character drawn uniformly from each language's own


class Tables(NamedTuple):
    """What one language's model is made of. Discounts, totals and kinds come from all counts, whatever entries are stored."""

    tri: np.ndarray      # packed trigrams, sorted
    n3: np.ndarray
    bi: np.ndarray       # packed bigrams, sorted
    n2: np.ndarray       # distinct characters before a bigram
    total3: np.ndarray   # rows and kinds of trigrams that a bigram begins
    kinds3: np.ndarray
    uni: np.ndarray      # all characters
    n1: np.ndarray
    total2: np.ndarray
    kinds2: np.ndarray
    d3: float
    d2: float
    d1: float


def _discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one and two else 0.5


def _discount_of(n: np.ndarray) -> float:
    return _discount(int((n == 1).sum()), int((n == 2).sum()))


LOW1, LOW2, ONE = np.uint64((1 << BITS) - 1), np.uint64((1 << 2 * BITS) - 1), np.uint64(BITS)


def tables(tri: np.ndarray, n3: np.ndarray) -> Tables:
    """The tables of all trigram counts of a language, nothing left out."""
    bi, at = np.unique(np.concatenate([tri >> ONE, tri & LOW2]), return_inverse=True)
    head, tail = at[:len(tri)], at[len(tri):]
    n2 = np.bincount(tail, minlength=len(bi))
    uni, at = np.unique(np.concatenate([bi >> ONE, bi & LOW1]), return_inverse=True)
    first, last = at[:len(bi)], at[len(bi):]
    n1 = np.bincount(last[n2 > 0], minlength=len(uni))
    return Tables(tri, n3, bi, n2, np.bincount(head, weights=n3, minlength=len(bi)), np.bincount(head, minlength=len(bi)), uni, n1,
                  np.bincount(first, weights=n2, minlength=len(uni)), np.bincount(first[n2 > 0], minlength=len(uni)),
                  _discount_of(n3), _discount_of(n2), _discount_of(n1))


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney from all trigram counts (packed trigrams, counts) of each language."""
    return fit_tables({k: tables(*v) for k, v in counts.items()})


def fit_tables(learned: dict[str, Tables]) -> Model:
    """Kneser-Ney from each language's tables.

    Where entries of a context are not stored, its back-off weight is what the stored ones leave, so a
    context's probabilities sum to one either way.
    """
    langs = sorted(learned)
    tri, bi, uni = (np.unique(np.concatenate([getattr(t, k) for t in learned.values()])) for k in ("tri", "bi", "uni"))
    shape = lambda a: np.empty((len(a), len(langs)))
    tri_p, bi_p, bi_bow, uni_p, uni_bow, unknown = shape(tri), shape(bi), shape(bi), shape(uni), shape(uni), np.empty(len(langs))
    symbols = len(uni) + 1
    flat = np.empty(len(langs))
    ctx2, tail2 = np.searchsorted(uni, bi >> ONE), np.searchsorted(uni, bi & LOW1)
    head3 = np.minimum(np.searchsorted(bi, tri >> ONE), max(len(bi) - 1, 0))
    pair = np.minimum(np.searchsorted(bi, tri & LOW2), max(len(bi) - 1, 0))
    has_head, has_pair = (bi[head3] == tri >> ONE, bi[pair] == tri & LOW2) if len(bi) else (np.zeros(len(tri), bool),) * 2
    mid, end = np.searchsorted(uni, (tri & LOW2) >> ONE), np.searchsorted(uni, tri & LOW1)

    def spread(at: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at))
        out[np.searchsorted(at, key)] = n
        return out

    for col, lang in enumerate(langs):
        t = learned[lang]
        n1, total2, kinds2 = (spread(uni, t.uni, x) for x in (t.n1, t.total2, t.kinds2))
        total1, kinds1 = max(n1.sum(), 1.0), int((n1 > 0).sum())
        spare = t.d1 * kinds1 / total1 if kinds1 else 1.0
        p1 = np.maximum(n1 - t.d1, 0) / total1 + spare / symbols
        unknown[col] = np.log2(spare / symbols)
        flat[col] = np.log2(kinds1 + 1)  # of the language's own characters
        bow2 = np.where(total2 > 0, t.d2 * kinds2 / np.maximum(total2, 1), 1.0)
        n2, total3, kinds3 = (spread(bi, t.bi, x) for x in (t.n2, t.total3, t.kinds3))
        own2 = np.zeros(len(bi), dtype=bool)
        own2[np.searchsorted(bi, t.bi)] = True
        p2 = np.maximum(n2 - t.d2, 0) / np.maximum(total2, 1)[ctx2] + bow2[ctx2] * p1[tail2]
        if (kinds2 > np.bincount(ctx2[n2 > 0], minlength=len(uni))).any():  # bigrams left out
            left = lambda p: np.maximum(1 - np.bincount(ctx2[own2], weights=p[own2], minlength=len(uni)), 1e-12)
            missing = kinds2 > np.bincount(ctx2[n2 > 0], minlength=len(uni))
            bow2 = np.where(missing, left(p2) / left(p1[tail2]), bow2)
        p2 = np.where(own2, p2, bow2[ctx2] * p1[tail2])
        p2_tail = np.where(has_pair, p2[pair], bow2[mid] * p1[end])
        own3 = np.zeros(len(tri), dtype=bool)
        own3[np.searchsorted(tri, t.tri)] = True
        own3 &= has_head & own2[head3]
        bow3 = np.where(total3 > 0, t.d3 * kinds3 / np.maximum(total3, 1), 1.0)
        p3 = np.maximum(spread(tri, t.tri, t.n3) - t.d3, 0) / np.maximum(total3, 1)[head3] + bow3[head3] * p2_tail
        short = kinds3 > np.bincount(head3[own3], minlength=len(bi))
        if short.any():  # trigrams left out
            left = lambda p: np.maximum(1 - np.bincount(head3[own3], weights=p[own3], minlength=len(bi)), 1e-12)
            bow3 = np.where(short, left(p3) / left(p2_tail), bow3)
        p3 = np.where(own3, p3, np.where(has_head, bow3[head3], 1.0) * p2_tail)
        tri_p[:, col], bi_p[:, col], uni_p[:, col] = np.log2(p3), np.log2(p2), np.log2(p1)
        bi_bow[:, col], uni_bow[:, col] = np.log2(bow3), np.log2(bow2)

    def order(key: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
        h = hashed(key)
        by = np.argsort(h)
        return [h[by], *[r[by] for r in rows]]

    tri_h, tri_p = order(tri, tri_p)
    bi_h, bi_p, bi_bow = order(bi, bi_p, bi_bow)
    uni_h, uni_p, uni_bow = order(uni, uni_p, uni_bow)
    return Model(langs, tri_h, tri_p, bi_h, bi_p, bi_bow, uni_h, uni_p, uni_bow, unknown, flat)


def _find(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = hashed(key)
    i = np.searchsorted(at, h)
    i[i == len(at)] = 0
    return i, at[i] == h


def log_probs(m: Model, keys: np.ndarray) -> np.ndarray:
    """log2 probabilities (n, languages) of the last characters of packed trigrams."""
    i, hit = _find(m.tri, keys)
    out = m.tri_p[i]
    miss = np.flatnonzero(~hit)
    if len(miss):
        one, low1, low2 = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64((1 << 2 * BITS) - 1)
        k = keys[miss]
        context, context_hit = _find(m.bi, k >> one)
        pair, pair_hit = _find(m.bi, k & low2)
        before, before_hit = _find(m.uni, (k & low2) >> one)
        char, char_hit = _find(m.uni, k & low1)
        single = np.where(char_hit[:, None], m.uni_p[char], m.unknown_p)
        lower = np.where(pair_hit[:, None], m.bi_p[pair], np.where(before_hit[:, None], m.uni_bow[before], 0.0) + single)
        out[miss] = np.where(context_hit[:, None], m.bi_bow[context], 0.0) + lower
    return out


def bits_of(m: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Total bits (texts, languages) and number of predicted characters of whole texts."""
    bits, length = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), dtype=np.int64)
    keys: list[np.ndarray] = []
    rows: list[int] = []

    def settle() -> None:
        if keys:
            starts = np.cumsum([0, *[len(k) for k in keys[:-1]]])
            np.subtract.at(bits, rows, np.add.reduceat(log_probs(m, np.concatenate(keys)), starts, axis=0))
            keys.clear()
            rows.clear()

    waiting = 0
    for row, text in enumerate(texts):
        for k in _pieces(codes(text)) if text else ():
            keys.append(k)
            rows.append(row)
            length[row] += len(k)
            waiting += len(k)
            if waiting >= CHUNK // 4:
                settle()
                waiting = 0
    settle()
    return bits, length


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = Model(*shared.value)
        names = np.array([*m.langs, UND], dtype=object)
        for b in batches:
            bits, length = bits_of(m, b.column(0).to_pylist())
            each = bits / np.maximum(length, 1)[:, None]
            best = np.argmin(each, axis=1)
            least = each[np.arange(len(best)), best]
            odds = np.exp2(-(each - least[:, None]) * np.minimum(length, SCORE_CHARS)[:, None]).sum(axis=1)
            none = length == 0
            best[none] = len(m.langs)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(1, b.num_columns)], pa.array(names[best], pa.string()),
                 pa.array(np.where(none, 0.0, 1.0 / odds)), pa.array(np.where(none, 0.0, least)), pa.array(length)],
                names=[*b.schema.names[1:], "lang_pred", "score", "bits", "length"])
    return run


def _stored(rows: DataFrame, weight: str, limit: int) -> DataFrame:
    """At most about ``limit`` rows of each language: whole bands of ``weight`` from the top, and a part of the next by a hash."""
    band = F.when(F.col(weight) < 64, F.col(weight)).otherwise(F.floor(F.log2(weight) * 16)).cast("int")  # steps of one, then of 1/16 octave
    rows = rows.withColumn("band", F.when(F.col(weight) < 64, band).otherwise(band - 32))
    sizes = rows.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("k")).collect()  # under a thousand rows a language
    keep = F.lit(False)
    for lang in {r["lang"] for r in sizes}:
        room, least, part = limit, None, 0
        for r in sorted((r for r in sizes if r["lang"] == lang), key=lambda r: -r["band"]):
            if r["k"] > room:
                least, part = r["band"], room * 1024 // r["k"]
                break
            room -= r["k"]
        inside = F.lit(True) if least is None else (F.col("band") > least) | (
            (F.col("band") == least) & (F.pmod(F.xxhash64("gram"), F.lit(1024)) < part))
        keep = F.when(F.col("lang") == lang, inside).otherwise(keep)
    return rows.filter(keep).drop("band")


def _by_lang(rows: DataFrame, *columns: str) -> dict[str, list[np.ndarray]]:
    t = rows.select("lang", "gram", *columns).toArrow()
    lang, gram = np.array(t.column("lang").to_pylist(), dtype=object), t.column("gram").to_numpy().astype(np.uint64)
    out = {}
    for name in sorted(set(lang.tolist())):
        mine = np.flatnonzero(lang == name)
        mine = mine[np.argsort(gram[mine])]
        out[name] = [gram[mine], *[t.column(c).to_numpy()[mine] for c in columns]]
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_ngrams: int = MAX_NGRAMS) -> Model | None:
    """The model of all given rows that have a text and a language; None if there are none.

    Counts, continuation counts, totals and discounts are summed by Spark over everything. ``max_ngrams``
    bounds what is stored of a language: beyond it the rarest trigrams (and bigrams) are left out, and the
    back-off weight of their context is worked out anew, so they cost what the shorter context says of
    them. With L languages the limit is also MAX_CELLS / L², the size bound of what is broadcast.
    """
    src = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    counts = pin(src.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    low1, low2 = F.lit((1 << BITS) - 1), F.lit((1 << 2 * BITS) - 1)
    g = F.col("gram")
    zero = F.lit(0).cast("bigint")
    ends = counts.select("lang", g.bitwiseAND(low2).alias("gram"), F.lit(1).cast("bigint").alias("n2"), zero.alias("total3"), zero.alias("kinds3"))
    heads = counts.select("lang", F.shiftright(g, BITS).alias("gram"), zero.alias("n2"), F.col("n").alias("total3"), F.lit(1).cast("bigint").alias("kinds3"))
    sums = lambda *cs: [F.sum(c).alias(c) for c in cs]
    bigrams = pin(ends.unionByName(heads).groupBy("lang", "gram").agg(*sums("n2", "total3", "kinds3")), "bigrams")
    some = (F.col("n2") > 0).cast("bigint")
    ends = bigrams.select("lang", g.bitwiseAND(low1).alias("gram"), some.alias("n1"), zero.alias("total2"), zero.alias("kinds2"))
    heads = bigrams.select("lang", F.shiftright(g, BITS).alias("gram"), zero.alias("n1"), F.col("n2").alias("total2"), some.alias("kinds2"))
    characters = pin(ends.unionByName(heads).groupBy("lang", "gram").agg(*sums("n1", "total2", "kinds2")), "characters")
    once = {c: {r["lang"]: _discount(r["one"], r["two"]) for r in rows.groupBy("lang").agg(
        F.count_if(F.col(c) == 1).alias("one"), F.count_if(F.col(c) == 2).alias("two")).collect()}
        for c, rows in (("n", counts), ("n2", bigrams), ("n1", characters))}
    langs = sorted(once["n"])
    if not langs:
        return None
    limit = max(1, min(max_ngrams, MAX_CELLS // len(langs) ** 2))
    tri = _by_lang(_stored(counts, "n", limit), "n")
    bi = _by_lang(_stored(bigrams.withColumn("weight", F.col("n2") + F.col("total3")), "weight", limit), "n2", "total3", "kinds3")
    uni = _by_lang(characters, "n1", "total2", "kinds2")  # a code point a row at most
    return fit_tables({k: Tables(*tri[k], *bi[k], *uni[k], once["n"][k], once["n2"][k], once["n1"][k]) for k in langs})


def identify(docs: DataFrame, model: Model | None, calibrate_on: str, id_col: str = "doc_id", text_col: str = "text",
             reject_quantile: float = REJECT_QUANTILE, reject_factor: float = REJECT_FACTOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, row keys, the columns named in ``keep``, lang_pred, score, bits, length, rejected.

    ``calibrate_on`` is a SQL condition on those columns: the rows whose bits set the limits.
    """
    own = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *row_keys(id_col, text_col), *keep]
    if model is None:
        return docs.select(*own, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"),
                           F.lit(0).cast("bigint").alias("length"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    slim = docs.select(F.col(f"`{text_col}`").alias("__text"), *own)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    scored = pin(slim.mapInArrow(_predict(shared), f"{kept}, lang_pred string, score double, bits double, length bigint"), "languages")
    base = scored.filter(f"({calibrate_on}) and length > 0")
    # one number for each learned language, written into the plan: no join on a hot key
    of = lambda numbers: F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("lang_pred"))
    flat = dict(zip(model.langs, map(float, model.flat_bits), strict=True))
    mean = flat | {
        r["lang_pred"]: r["m"] for r in base.groupBy("lang_pred").agg(F.avg("bits").alias("m")).collect()}
    excess = (F.col("bits") - of(mean)) * F.sqrt("length")
    limit = dict.fromkeys(model.langs, 0.0) | {
        r["lang_pred"]: r["q"] for r in base.groupBy("lang_pred").agg(
            F.percentile_approx(excess, F.lit(reject_quantile), F.lit(10000)).alias("q")).collect()}
    far = (excess > F.greatest(of(limit), F.lit(1.0)) * F.lit(reject_factor)) & (F.col("bits") > (of(mean) + of(flat)) / 2)
    return scored.withColumn("rejected", (F.col("lang_pred") == UND) | F.coalesce(far, F.lit(False)))


def split_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       modulus: int = 4, held: int = 2, **params) -> DataFrame:
    """Learn from the rows whose ``crc32(id as text) mod modulus`` is not ``held`` and identify all of them."""
    marked = docs.withColumn("held_out", id_remainder(F.col(f"`{id_col}`"), modulus) == held)
    model = train(marked.filter("not held_out"), text_col, lang_col)
    return identify(marked, model, "not held_out", id_col, text_col, keep=("held_out",), **params)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    verdict = split_and_identify(docs, id_col, text_col, **params).filter("not rejected")
    return keep_rows(docs, verdict, id_col, text_col, all_copies=True)
