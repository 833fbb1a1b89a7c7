"""Language identification by averaged hashed subword embeddings.

Method. A text's subwords are its byte n-grams of 2 to 4 bytes inside words (a word's edge counts as a
space), hashed into ``BUCKETS`` embeddings. The text is the average of its embeddings; a linear softmax names the
language. Both are trained by stochastic gradient descent in numpy on the driver, over the sparse features
of ``TRAIN_ROWS`` labelled rows at most, those with the smallest hash of id and text. A fifth of these rows is
not trained on but calibrates: a temperature for the probabilities, and two limits below which an answer
is rejected, on the probability and on the share of subwords that training had seen. What was seen is looked up by
``SEEN_BITS`` bits of a subword's hash, of which its bucket is the first part, so few unseen subwords pass for seen ones. Each limit
rejects at most ``FALSE_REJECT`` of the calibration fold, and lies midway between that and what negatives reach if they
stay below: the same texts with shuffled letters and, for the seen share, the texts of each language as training without it sees them.

Prediction reads the whole text, sums each n-gram's product with the softmax (embedding times weights is
kept as one table of BUCKETS x languages), and so needs one pass and no shuffle.

Null or letterless text gives ``und`` with score 0 and is rejected. Rows without a label are never trained on.
If no row has a label, every text is ``und``. Rows are judged one by one: equal texts alike, whatever their ids, texts of any length as a whole. Repeated rows train once. An
empty table gives no row. Ids keep their type.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.batches import OWN, blocks, release, strings, table, with_id
from viaduct.llm.words import LOWER

BUCKETS, DIM, NGRAMS, TRAIN_ROWS, EPOCHS = 1 << 15, 8, (2, 3, 4), 1500, 5
SEEN_BITS, FALSE_REJECT = 24, 0.0025
_codes = np.arange(256)
#: ASCII letters in lower case and all bytes above; every other byte is a space.
LETTERS = np.where(((LOWER >= 97) & (LOWER <= 122)) | (_codes >= 128), LOWER, 32).astype(np.uint8)


def subwords(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``SEEN_BITS`` bits of all n-grams' hashes and, for each text, where its n-grams begin."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = np.full(size, n, np.uint32)
    for j in range(n):
        code = code * np.uint32(0x9E3779B1) + data[j : j + size]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    letter = data != 32
    good = letter[:size] | letter[1:] if n == 2 else letter[1 : size + 1].copy()
    for j in range(2, n - 1):
        good &= letter[j : j + size]
    cross = np.zeros(size, bool)
    for b in at[1:-1]:
        cross[max(0, b - n + 1) : b] = True  # no n-gram reaches into the next text
    where = np.flatnonzero(good & ~cross)
    return (code[where] >> np.uint32(32 - SEEN_BITS)).astype(np.int64), np.searchsorted(where, at)


def bucket_of(seen: np.ndarray) -> np.ndarray:
    return seen >> SEEN_BITS - 15


def has_letters(data: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
    ascii_letters = (LETTERS[data] != 32) & (data < 128)
    total = np.concatenate([[0], np.cumsum(ascii_letters)])
    out = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def calibrates(keys: np.ndarray) -> np.ndarray:
    """Which rows calibrate: a fifth, by their key."""
    return np.asarray(keys, np.int64) % 5 == 4


def training_features(rows: DataFrame) -> DataFrame:
    """``k, lang, grams, shares`` of ``text``, and of texts that calibrate ``noise, noise_shares``, of the text with shuffled letters."""
    schema = pa.schema([("k", pa.int64()), ("lang", pa.string()), ("grams", pa.binary()), ("shares", pa.binary()), ("noise", pa.binary()), ("noise_shares", pa.binary())])

    def features(batches):
        for batch in blocks(batches, "text"):
            keys = batch.column("k").to_numpy()
            for i, held in enumerate(calibrates(keys).tolist()):
                data, at = strings(batch.column("text").slice(i, 1))
                data = LETTERS[data]
                texts = [data]
                if held:
                    letters = np.flatnonzero(data != 32)
                    texts.append(data.copy())
                    texts[1][letters] = np.random.default_rng(len(letters)).permutation(data[letters])
                row = [keys[i], batch.column("lang")[i].as_py()]
                for text in texts:
                    ids, n = np.unique(np.concatenate([subwords(text, at, n)[0] for n in NGRAMS]), return_counts=True)
                    row += [ids.astype("<u4").tobytes(), (n / max(n.sum(), 1)).astype("<f4").tobytes()]
                yield table(schema, *[[x] for x in (*row, None, None)[:6]])

    return rows.mapInArrow(features, "k bigint, lang string, grams binary, shares binary, noise binary, noise_shares binary")


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        self.logits = np.zeros((BUCKETS, max(len(langs), 1)), np.float32)  # an n-gram's part in each language's logit
        self.bias = np.zeros(max(len(langs), 1), np.float32)
        self.seen = np.zeros(0, np.int64)  # the grams of the training texts, ascending
        self.temperature, self.least_score, self.least_seen = 1.0, 0.0, 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def limit(own: np.ndarray, negative: np.ndarray) -> float:
    """At most ``FALSE_REJECT`` of the calibration texts' values are below; midway to the negatives' if those are lower."""
    low = float(np.quantile(own, FALSE_REJECT, method="lower"))
    high = float(np.quantile(negative, 0.99)) if len(negative) else low
    return (low + high) / 2 if high < low else low


def fit(rows: list, seed: int = 7, rate: float = 20.0) -> Model:
    """Train on the rows of ``training_features``; a fifth calibrates."""
    rows = sorted(rows)
    langs = sorted({r[1] for r in rows})
    model = Model(langs)
    if not rows:
        return model
    grams, noise = ([(np.frombuffer(r[c] or b"", "<u4"), np.frombuffer(r[c + 1] or b"", "<f4")) for r in rows] for c in (2, 4))
    x = [(bucket_of(g), share) for g, share in grams]
    y = np.array([langs.index(r[1]) for r in rows])
    held = calibrates([r[0] for r in rows])
    held &= held.any() and not held.all()
    train = np.flatnonzero(~held)
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weights += random.normal(0, 0.1, weights.shape)
    for epoch in range(EPOCHS):
        step = rate * (1 - epoch / EPOCHS)
        for batch in np.array_split(random.permutation(train), max(1, len(train) // 16)):
            ids, share = np.concatenate([x[i][0] for i in batch]), np.concatenate([x[i][1] for i in batch])
            sizes = np.array([len(x[i][0]) for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            mean = np.stack([np.bincount(row, share * embed[ids, d], len(batch)) for d in range(DIM)], axis=1)
            z = mean @ weights + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(batch)), y[batch]] -= 1
            z /= len(batch)
            back = (z @ weights.T)[row] * share[:, None]
            weights -= step * 0.1 * (mean.T @ z)
            bias -= step * 0.02 * z.sum(axis=0)
            for d in range(DIM):
                embed[:, d] -= step * np.bincount(ids, back[:, d], BUCKETS)
    model.logits, model.bias = (embed @ weights).astype(np.float32), bias
    of_lang = [np.unique(np.concatenate([np.zeros(0, np.int64), *[grams[i][0] for i in train if y[i] == j]])) for j in range(len(langs))]
    model.seen = np.unique(np.concatenate(of_lang))
    test = np.flatnonzero(held) if held.any() else train
    score = lambda ids, share: (share[:, None] * model.logits[ids]).sum(axis=0) + bias
    logits = np.stack([score(*x[i]) for i in test])
    # a few wrong answers are taken for possible, or texts that are all named rightly would have no best temperature
    doubt = 1 / (len(test) + 2)
    best = np.inf
    for t in np.geomspace(0.001, 50, 121):
        model.temperature = t
        logs = np.log(np.maximum(model.probabilities(logits), 1e-300))
        right = logs[np.arange(len(test)), y[test]]
        loss = -((1 - doubt) * right + doubt * (logs.sum(axis=1) - right) / max(len(langs) - 1, 1)).mean()
        if loss < best - 1e-9:
            best, chosen = loss, t
    model.temperature = float(chosen)
    known = lambda row, seen: float(row[1][np.isin(row[0], seen)].sum())
    shuffled = [i for i in test if len(noise[i][0])]
    model.least_score = limit(model.probabilities(logits).max(axis=1), np.array([model.probabilities(score(bucket_of(noise[i][0]), noise[i][1])[None]).max() for i in shuffled]))
    others = [np.unique(np.concatenate([np.zeros(0, np.int64), *[g for k, g in enumerate(of_lang) if k != j]])) for j in range(len(langs))]
    foreign = [known(grams[i], others[y[i]]) for i in test] if len(langs) > 1 else []
    model.least_seen = limit(np.array([known(grams[i], model.seen) for i in test]), np.array([*[known(noise[i], model.seen) for i in shuffled], *foreign]))
    return model


def train(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``rows`` rows that are ``usable`` and have a label and a text."""
    good = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    good = good.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), key.alias("k"))
    last = [r[0] for r in good.select("k").distinct().orderBy("k").limit(rows).collect()]  # rows numbers
    if not last:
        return Model([])
    # features, not texts, of the chosen rows gather in one task; repeated rows are one
    model = fit(list(map(tuple, training_features(good.where(F.col("k") <= last[-1])).dropDuplicates(["k"]).collect())))
    release()
    return model


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


_tables: dict[bytes, np.ndarray] = {}


def seen_table(seen: np.ndarray) -> np.ndarray:
    """``seen`` as flags, kept for the next block."""
    key = hashlib.blake2b(seen.tobytes(), digest_size=16).digest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = np.zeros(1 << SEEN_BITS, bool)
        _tables[key][seen] = True
    return _tables[key]


def predict_texts(model: Model, texts: pa.Array) -> pa.RecordBatch:
    raw, at = strings(texts)
    letters = has_letters(raw, at, texts)
    data = LETTERS[raw]
    n_langs = max(len(model.langs), 1)
    total, n, seen = np.zeros((len(texts), n_langs)), np.zeros(len(texts)), np.zeros(len(texts))
    was_seen = seen_table(model.seen)
    for size in NGRAMS:
        gram, first = subwords(data, at, size)
        bucket = bucket_of(gram)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            for j in range(n_langs):
                total[some, j] += np.add.reduceat(model.logits[:, j][bucket].astype(np.float64), first[some])
            seen[some] += np.add.reduceat(was_seen[gram].astype(np.float64), first[some])
            n += np.diff(first)
    sure = model.probabilities(total / np.maximum(n, 1)[:, None] + model.bias)
    best, score = sure.argmax(axis=1), sure.max(axis=1)
    named = letters & bool(model.langs)
    accepted = named & (score >= model.least_score) & (seen / np.maximum(n, 1) >= model.least_seen)
    names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), named.tolist(), strict=True)]
    return table(PREDICTED, names, np.where(named, score, 0.0), accepted)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every text."""
    schema = pa.schema([("doc_id", OWN), *PREDICTED])

    def run(batches):
        for batch in blocks(batches, "text"):
            found = predict_texts(model, batch.column("text"))
            yield table(schema, batch.column("id"), *found.columns)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, with_id(docs, id_col, "lang_pred string, score double, accepted boolean"))


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is accepted, all columns as they are."""

    def run(batches):
        for batch in blocks(batches, text_col):
            yield batch.filter(predict_texts(model, batch.column(text_col)).column("accepted"))

    return docs.mapInArrow(run, docs.schema)
