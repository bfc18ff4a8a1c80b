"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of 1 to ``ORDERS``
characters are hashed into ``DIM`` features. A text's vector is its TF-IDF weights divided by
their sum, so a score is one weighted sum over the whole text.

Document frequencies come from all labelled rows. Weights are learned from a bounded sample of their
distinct texts (``max_rows``, spread evenly over the labels by hash): follow-the-regularised-leader with elastic-net penalties on
shards of the sample in parallel, whose weights are averaged, then a temperature that calibrates
the softmax on a part of the sample the shards did not see. Prediction covers all rows and reads
only the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import common as c

DIM, ORDERS, SCALE = 1 << 17, 3, 40.0
ALPHA, BETA, L1, L2, EPOCHS, SHARDS = 0.5, 1.0, 0.02, 0.05, 2, 4
MAX_LABELS = 1000
# bytes of text, and places in it, that are worked on at once
CHUNK, SLICE = 1 << 18, 1 << 16


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For each character that may be a letter its lower-case form, or a space if it is none."""
    out = np.full(0x33480, 32, np.uint32)                     # the planes above hold no letters
    for k in range(len(out)):
        ch = chr(k)
        if ch.isalpha():
            low = ch.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 rows, non-letters as spaces: (characters, offsets)."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    off = np.concatenate(([0], np.cumsum(head)))[offsets]
    pad = np.concatenate((data, np.zeros(3, np.uint8)))
    b0 = data[at].astype(np.uint32)
    b1, b2, b3 = ((pad[at + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3))
    ch = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(
        b0 < 0xF0, (b0 & 0xF) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    table = _alphabet()
    out = table[np.minimum(ch, len(table) - 1)]
    return np.where(ch < len(table), out, np.uint32(32)), off


def grams(ch: np.ndarray, off: np.ndarray):
    """(feature, row start offsets) of each order's n-grams; an n-gram lies within a row. Grams
    that begin or end with two spaces are feature 0, which carries no weight."""
    for n in range(1, ORDERS + 1):
        m = len(ch) - n + 1
        if m <= 0:
            return
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ ch[k:k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h = (h % np.uint32(DIM - 1)).astype(np.int32) + 1
        blank = ch[:m] == 32
        if n > 1:
            blank = (blank & (ch[1:m + 1] == 32)) | ((ch[n - 1:] == 32) & (ch[n - 2:len(ch) - 1] == 32))
            for j in range(1, n):                             # grams that cross into the next row
                edge = off[1:-1] - j
                blank[edge[(edge >= 0) & (edge < m)]] = True
        h[blank] = 0
        yield h


def _row_sums(table: np.ndarray, h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row the sum of ``table`` over its places in ``h`` (which may miss the last few
    places), a slice at a time, so that one long text needs no more memory than many short ones."""
    out = np.zeros((len(off) - 1, table.shape[1]))
    for lo in range(0, len(h), SLICE):
        part = h[lo:lo + SLICE]
        total = np.concatenate((np.zeros((1, table.shape[1])), np.cumsum(table[part], axis=0, dtype=np.float64)))
        o = np.clip(off - lo, 0, len(part))
        out += total[o[1:]] - total[o[:-1]]
    return out


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray              # DIM
    weights: np.ndarray          # DIM x labels
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, has a letter) of each row."""
        ch, off = letters(data, offsets)
        k = len(self.labels)
        table = np.empty((DIM, k + 1), np.float32)
        table[:, :k] = self.weights * self.idf[:, None]
        table[:, k] = self.idf
        table[0] = 0
        acc = np.zeros((len(offsets) - 1, k + 1))
        for h in grams(ch, off):
            for lo in range(0, k + 1, 8):
                acc[:, lo:lo + 8] += _row_sums(table[:, lo:lo + 8], h, off)
        seen = np.concatenate(([0], np.cumsum(ch != 32)))
        some = seen[off[1:]] > seen[off[:-1]]
        return SCALE * acc[:, :k] / np.maximum(acc[:, k:], 1e-12) + self.bias, some


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- fitting

def _vectors(texts: list[str]):
    """Per text its features and their counts."""
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        ch, off = letters(data, np.array([0, len(data)]))
        h = np.concatenate([*grams(ch, off), np.zeros(1, np.int32)])
        u, n = np.unique(h[h > 0], return_counts=True)
        yield u, n


def _frequencies(batches):
    """Texts with each feature; those of feature 0 are all texts."""
    df, last = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
    for batch in c.tidy(batches):
        for a, b, data, offsets in c.text_chunks(batch.column(0), CHUNK):
            ch, off = letters(data, offsets)
            orders = list(grams(ch, off))
            for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
                h = np.concatenate([*(x[i:j] for x in orders), np.zeros(1, np.int32)])
                at = np.arange(len(h))
                last[h] = at
                df[h[(last[h] == at) & (h > 0)]] += 1         # one place of each feature
            df[0] += b - a
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["feature", "df"])


def _train(labels: list[str], idf):
    """FTRL-proximal over one shard: rows (feature, label, weight), feature 0 for the bias."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        weight, k = idf.value, len(labels)
        y = pdf["label"].map({v: j for j, v in enumerate(labels)}).to_numpy()
        z, n = np.zeros((DIM, k)), np.zeros((DIM, k))
        rows = list(_vectors(pdf["text"].tolist()))

        def current(u):
            w = -(z[u] - np.sign(z[u]) * L1) / ((BETA + np.sqrt(n[u])) / ALPHA + L2)
            return np.where(np.abs(z[u]) > L1, w, 0.0)

        for _ in range(EPOCHS):
            for (u, count), label in zip(rows, y):
                x = count * weight[u]
                u, x = np.append(u, 0), np.append(SCALE * x / max(x.sum(), 1e-12), 1.0)
                w = current(u)
                g = softmax((x @ w)[None])[0]
                g[label] -= 1
                g = x[:, None] * g
                root = np.sqrt(n[u] + g * g)
                z[u] += g - (root - np.sqrt(n[u])) / ALPHA * w
                n[u] += g * g
        w = current(np.arange(DIM))
        f, j = np.nonzero(w)
        return pd.DataFrame({"feature": f.astype(np.int32), "label": j.astype(np.int32), "weight": w[f, j]})

    return run


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows, by golden-section search of its log."""
    def loss(s):
        return -np.log(np.maximum(softmax(logits / np.exp(s))[np.arange(len(y)), y], 1e-300)).mean()

    a, b, g = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    while b - a > 1e-3:
        x, y2 = b - g * (b - a), a + g * (b - a)
        a, b = (a, y2) if loss(x) < loss(y2) else (x, b)
    return float(np.exp((a + b) / 2))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", max_rows: int = 8_000) -> Model:
    """Fit on a sample of about ``max_rows`` labelled texts at most (expected, by hash; equal texts of
    a label count once, also in its share), with the document frequencies of all labelled rows. Rows with a null text or label are not used; with no rows left, the
    model has no labels."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    rows = rows.withColumn("order", F.xxhash64("text", "label"))
    counts = {r.label: r.n for r in rows.select("label", "order").distinct().groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return Model([], np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0))
    share = spark.createDataFrame([(k, min(1.0, max_rows / len(counts) / n)) for k, n in counts.items()], "label string, share double")
    sample = c.stage(rows.join(F.broadcast(share), "label").where(F.pmod(F.shiftright("order", 20), F.lit(1_000_000)) < F.col("share") * 1_000_000)
                     .dropDuplicates(["label", "order"]).select("text", "label", "order", (F.pmod("order", F.lit(10)) == 0).alias("held")))
    df = rows.select("text").mapInArrow(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()   # DIM rows at most
    count, idf = np.zeros(DIM), np.zeros(DIM)
    count[df["feature"]] = df["df"]
    idf[1:] = np.where(count[1:] > 0, 1.0 + np.log((1 + count[0]) / (1 + count[1:])), 0.0)
    labels = sorted(counts)
    shared = spark.sparkContext.broadcast(idf)                 # DIM numbers
    shard = F.pmod(F.shiftright("order", 8), F.lit(SHARDS)).cast("int").alias("shard")
    learned = sample.where("not held").select("text", "label", "order", shard).groupBy("shard").applyInPandas(
        _train(labels, shared), "feature int, label int, weight double")
    w = np.zeros((DIM, len(labels)))
    shards = max(1, sample.where("not held").select(shard).distinct().count())
    for r in learned.groupBy("feature", "label").agg(F.sum("weight").alias("w")).toPandas().itertuples():
        w[r.feature, r.label] = r.w / shards
    bias = w[0].copy()
    w[0] = 0
    model = Model(labels, idf, w, bias)
    back = sample.where("held").select("text", "label").toPandas()   # a tenth of the sample
    if len(back) and len(labels) > 1:
        blobs = [t.encode("utf-8", "replace") for t in back["text"]]
        parts = [model.logits(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in blobs]
        model.temperature = _temperature(np.concatenate(parts), back["label"].map({v: j for j, v in enumerate(labels)}).to_numpy())
    return model


# ---------------------------------------------------------------- prediction

def _predict(shared, keep_text):
    def run(batches):
        model = shared.value
        for batch in c.tidy(batches):
            for a, b, data, offsets in c.text_chunks(batch.column(1), CHUNK):
                if model.labels:
                    z, some = model.logits(data, offsets)
                    p = softmax(z / model.temperature)
                    best = p.argmax(axis=1)
                    pred = [model.labels[j] if s else "und" for j, s in zip(best.tolist(), some.tolist())]
                    score = np.where(some, p[np.arange(len(best)), best], 0.0)
                else:
                    pred, score = ["und"] * (b - a), np.zeros(b - a)
                text = [batch.column(1).slice(a, b - a)] if keep_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *text, pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0))],
                                                 names=["_row", *["_text"] * keep_text, "_pred", "_score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None,
            pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Per input row its ``columns`` (default: all), ``pred_col`` and ``score_col`` (the calibrated
    probability). Null texts and texts without a letter are ``und`` with score 0; repeated rows
    get a row each; an empty table gives no rows. The caller names the new columns so that they
    clash with none of ``columns``."""
    columns = docs.columns if columns is None else columns
    keep_text = text_col in columns                           # the text goes through once
    fields = [docs[x].alias(f"c{k}") for k, x in enumerate(columns) if x != text_col]
    rows = docs.select(F.struct(F.lit(0).alias("none"), *fields).alias("_row"), docs[text_col].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_predict(shared, keep_text), f"_row {rows.schema['_row'].dataType.simpleString()}, " + "_text string, " * keep_text + "_pred string, _score double")
    return out.select(*[F.col("_text" if x == text_col else f"_row.c{k}").alias(x) for k, x in enumerate(columns)],
                      F.col("_pred").alias(pred_col), F.col("_score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Rows that are not learned from: crc32 of the id as text has remainder 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = 8_000) -> Model:
    """Fit on the documents with an id that are not held out."""
    return fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col, label_col, max_rows)
