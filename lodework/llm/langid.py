"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's vector is the mean of the embeddings of its hashed character n-grams; a linear softmax over it gives
the language. Both are learned by stochastic gradient descent in numpy on a bounded sample of labelled rows.

Buckets that no training text has hold nothing. So a text shows how much of it is known: the share of its trigrams that
are. Its score is the softmax's probability times that share. A held-back part of the sample, at several lengths,
sets what makes scores probabilities: a temperature, and how much less a short text tells. The score under which a
text is rejected, one for short texts and one for others, is what all but a few of the held-back texts reach, or less
where texts made of them by shuffling letters, by random letters and by another script score far below: then half-way.

As the mean and the softmax's weights are linear, the trained tables fold into one row of weights a bucket, so
a prediction is one table look-up an n-gram over the whole text, done for a batch of texts at once. Weights are whole
numbers of a small unit, so that sums don't depend on where a long text is cut.

Nulls and edge cases: a null text, or one without a letter, is `und` with score 0 and rejected. With no
labelled row at all every text is `und`. Ties go to the language that sorts first. Repeated rows are
predicted one by one; a null id is not held out. Very long texts go through in pieces that overlap by what an n-gram
needs, with the same result. Columns named like the result's are replaced, others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, tidy

UND = "und"
ORDERS = (2, 3)
#: Texts of fewer trigrams count as short ones.
SHORT = 30
#: The model holds a row of weights a language, so there may be so many at most.
MOST_LANGUAGES = 1000
_UNIT = 1 / 65536
OUT = "lang_pred string, score double, rejected boolean"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """By code point: Unicode's letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


@dataclass(frozen=True)
class Model:
    """weights: a row a bucket, languages in columns, in whole units; known: whether a training text has the bucket.

    A text's logits are the mean of its n-grams' weights times n / (n + slack), and the bias. thresholds: for short texts and
    for others. stopped: the share of made-up texts that the thresholds reject, by kind."""

    langs: tuple[str, ...]
    weights: np.ndarray
    known: np.ndarray
    bias: np.ndarray
    bits: int
    slack: float
    thresholds: tuple[float, float]
    stopped: tuple[tuple[str, float], ...] = ()


def features(texts: list[str], bits: int, own: list[int] | None = None, first: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket of each n-gram, text of each n-gram, how many of them, the first ones, are no trigrams) over all texts, which are in
    lower case. Anything but a letter is a blank; an n-gram begins at a letter or at the blank before one, and never
    reaches into the next text. own: only n-grams that begin in so many first characters count; first: whether a
    text's beginning is one, and not a cut."""
    pad = " " * max(ORDERS)
    joined = "".join([pad + t for t in texts]) + pad
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # the blank before a text's first letter is its own, so the padding goes before it
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + len(pad))
    owner = np.r_[owner, np.full(len(pad), len(texts) - 1, np.int32)]
    letter = _is_letter()[chars]
    code = np.where(letter, chars, np.uint32(32))
    starts = letter.copy()
    starts[:-1] |= letter[1:]
    if own:
        begin = np.cumsum(lengths + len(pad)) - lengths
        for k in np.flatnonzero((np.array(own) < lengths) | ~np.array(first)):
            starts[begin[k] + own[k] : begin[k] + lengths[k]] = False
            starts[begin[k] - len(pad) : begin[k]] &= first[k]
    buckets, owners, before = [], [], 0
    rolled = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] if n > 1 else code.copy()
        if n in ORDERS:
            at = np.flatnonzero((letter if n == 1 else starts)[: len(rolled)])
            mixed = (rolled[at] + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            buckets.append((mixed >> np.uint32(32 - bits)).astype(np.int32))
            owners.append(owner[at])
            before += len(at) if n < 3 else 0
    return np.concatenate(buckets), np.concatenate(owners), before


def _bags(texts: list[str], bits: int) -> list[np.ndarray]:
    b, o, _ = features([t.lower() for t in texts], bits)
    order = np.argsort(o, kind="stable")
    return np.split(b[order], np.searchsorted(o[order], np.arange(1, len(texts))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _made_up(texts: list[str], rng: np.random.Generator) -> dict[str, list[str]]:
    """Texts in no language: letters shuffled, words of random letters, and another script, all at a text's length."""
    letters = sorted({c for t in texts for c in t.lower() if c.isascii() and c.isalpha()}) or list("abcdefghijklmnopqrstuvwxyz")
    out: dict[str, list[str]] = {"shuffled": [], "random": [], "foreign": []}
    for t in texts:
        own = [c for c in t if c.isalpha()]
        rng.shuffle(own)
        rest = iter(own)
        out["shuffled"].append("".join(next(rest) if c.isalpha() else c for c in t))
        out["random"].append("".join(letters[int(rng.integers(len(letters)))] if c.isalpha() else c for c in t))
        shift = int(rng.integers(0x4E00, 0x9000))
        out["foreign"].append("".join(chr(shift + ord(c) % 0x300) if c.isalpha() else c for c in t))
    return out


def train(texts: list[str], langs: list[str], bits: int = 18, dim: int = 16, epochs: int = 5, batch: int = 32, rate: float = 0.5, keep: float = 0.999, seed: int = 7) -> Model:
    """Texts are cut to windows by the caller. keep: the share of held-back texts that the rejection lets through."""
    names = tuple(sorted(set(langs)))
    none = Model(names, np.zeros((1 << bits, len(names)), np.float32), np.zeros(1 << bits, bool), np.zeros(len(names)), bits, 1.0, (0.0, 0.0))
    if not names:
        return none
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    bags = _bags(texts, bits)
    use = np.array([i for i, b in enumerate(bags) if len(b)])
    if not len(use):
        return none
    rng.shuffle(use)
    held, fit = (use[: len(use) // 5], use[len(use) // 5 :]) if len(use) >= 50 else (use, use)
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    steps = epochs * -(-len(fit) // batch)
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            part = fit[i : i + batch]
            idx = np.concatenate([bags[j] for j in part])
            n = np.array([len(bags[j]) for j in part])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            x = np.add.reduceat(emb[idx], at, axis=0) / n[:, None]
            g = _softmax(x @ w + b)
            g[np.arange(len(part)), y[part]] -= 1
            now = rate * (1 - step / steps)
            grad = (g @ w.T / n[:, None] * (now * 10)).astype(np.float32)
            w -= now * (x.T @ g) / len(part)
            b -= now * g.mean(axis=0)
            rows = np.repeat(np.arange(len(part)), n)
            flat, inverse = np.unique(idx, return_inverse=True)
            for d in range(dim):
                emb[flat, d] -= np.bincount(inverse, grad[rows, d], len(flat)).astype(np.float32)
            step += 1
    known = np.zeros(1 << bits, bool)
    known[np.concatenate([bags[j] for j in fit])] = True
    folded = np.where(known[:, None], emb.astype(np.float64) @ w, 0.0)

    # held-back texts whole, as 40 characters and as a word
    back = [texts[j] for j in held]
    words = [max(t[len(t) // 2 :].split() or [t], key=len) for t in back]
    sizes = [back, [t[:40] for t in back], words]
    want = np.tile(y[held], 3)
    sums = Model(names, np.round(folded / _UNIT).clip(-(1 << 23), 1 << 23).astype(np.float32), known, b, bits, 0.0, (0.0, 0.0))
    total, count, seen, three = _sums(sums, [t for part in sizes for t in part])
    some = count > 0
    total, count, want = total[some], count[some], want[some]
    best, temper, slack = np.inf, 1.0, 1.0
    for s in (0.0, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        z = total * _UNIT / (count + s)[:, None] + b
        for t in np.geomspace(0.05, 20, 60):
            loss = -np.log(_softmax(z / t)[np.arange(len(want)), want] + 1e-12).mean()
            if loss < best - 1e-12:
                best, temper, slack = loss, float(t), s
    model = Model(names, np.round(folded / temper / _UNIT).clip(-(1 << 23), 1 << 23).astype(np.float32), known, b / temper, bits, slack, (0.0, 0.0))
    good = _scored(model, [t for part in sizes for t in part])[1:]
    made = {kind: _scored(model, texts)[1:] for kind, texts in _made_up([t for part in sizes[:2] for t in part], rng).items()}
    limits = []
    for k in (True, False):
        own = good[0][(good[1] == k) & (good[0] > 0)]
        bad = np.concatenate([score[short == k] for score, short in made.values()])
        least = float(np.quantile(own, 1 - keep)) if len(own) else 0.0
        limits.append(min(least, (least + float(np.quantile(bad, keep))) / 2) if len(bad) else least)
    limits = tuple(limits)
    stopped = [(kind, float((score < np.where(short, *limits)).mean())) for kind, (score, short) in made.items()]
    return Model(names, model.weights, known, model.bias, bits, slack, limits, tuple(stopped))


def _sums(model: Model, texts: list[str | None], block: int = 500_000) -> tuple[np.ndarray, ...]:
    """For each whole text its n-grams' weights, added up; their number; its known trigrams; its trigrams. Texts go through in
    groups of about `block` characters."""
    total = np.zeros((len(texts), len(model.langs)))
    count, seen, three = (np.zeros(len(texts), np.int64) for _ in range(3))
    group: list[tuple[int, str, int, bool]] = []

    def flush() -> None:
        ids, parts, own, first = zip(*group, strict=True)
        group.clear()
        b, o, two = features(list(parts), model.bits, list(own), list(first))
        if not len(b):
            return
        for k in range(len(model.langs)):
            np.add.at(total[:, k], list(ids), np.bincount(o, model.weights[b, k], len(ids)))
        for to, n in ((count, np.bincount(o, minlength=len(ids))), (seen, np.bincount(o[two:], model.known[b[two:]], len(ids))), (three, np.bincount(o[two:], minlength=len(ids)))):
            np.add.at(to, list(ids), n.astype(np.int64))

    size = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for a in range(0, len(t), block):
            group.append((i, t[a : a + block + max(ORDERS)], min(block, len(t) - a), a == 0))
            size += len(group[-1][1])
            if size >= block:
                flush()
                size = 0
    if group:
        flush()
    return total, count, seen, three


def _scored(model: Model, texts: list[str | None], block: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its best language (-1: none), score, and whether it is short."""
    total, count, seen, three = _sums(model, texts, block)
    p = _softmax(total * _UNIT / np.maximum(count + model.slack, 1)[:, None] + model.bias)
    best = p.argmax(axis=1)
    score = p[np.arange(len(p)), best] * seen / np.maximum(three, 1)
    return np.where(count > 0, best, -1), np.where(count > 0, score, 0.0), three < SHORT


def predict(model: Model, texts: list[str | None], block: int = 500_000) -> list[tuple[str, float, bool]]:
    """For each whole text its language, the calibrated score and whether it is rejected."""
    if not model.langs or not texts:
        return [(UND, 0.0, True)] * len(texts)
    best, score, short = _scored(model, texts, block)
    low = score < np.where(short, *model.thresholds)
    return [(model.langs[k], float(s), bool(r)) if k >= 0 else (UND, 0.0, True) for k, s, r in zip(best, score, low, strict=True)]


def training_sample(docs: DataFrame, eligible: Column, per_lang: int = 1500, window: int = 1000) -> tuple[list[str], list[str]]:
    """A bounded, repeatable sample for each language: about per_lang of its eligible rows, by a hash of the id,
    and of each one window of text at a place given by the same hash."""
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return [], []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_lang / n))])
    h = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.length("text") - window, F.lit(1)))
    found = (
        rows.where(h < F.element_at(share, F.col("lang")) * 1_000_000)
        .select("doc_id", "lang", F.substring(F.col("text"), (at + 1).cast("int"), F.lit(window)).alias("text"))
        .limit(4 * per_lang * len(counts))
        .collect()
    )
    found.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.lang, r.text))
    texts, langs = [r.text for r in found], [r.lang for r in found]
    short = [t[k : k + 40] for t in texts for k in [len(t) // 3]]  # so that short texts are known, too
    return texts + short, langs + langs


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    names = [c.split(" ")[0] for c in OUT.split(", ")]
    carried = docs.select(*[c for c in docs.columns if c not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = predict(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            made = [pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)] if got else [pa.array([], k) for k in (pa.string(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return carried.mapInArrow(tidy(run), StructType([*carried.schema.fields, *StructType.fromDDL(OUT).fields]))


#: In the query, ids whose checksum is divisible by 5 are held out from training.
def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return train(*training_sample(docs, ~held_out()))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, learned(docs)).drop("text")


QUERIES = {"op2_language_id": op2}
ORACLE: dict[str, str] = {}
