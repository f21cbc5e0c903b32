"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of `PASSAGE_WORDS` words. Each passage is encoded (shares of character classes, word shape and
repetition, then a learned layer); gated attention weighs the passages; the weighted mean is scored. Labels belong to
documents, and the attention learns which passages carry them: a page of prose with one bad passage is told by it.

Training takes a bounded sample: at most `max_docs` labelled documents, half of them of each label, chosen by a hash, and
at most `doc_passages` passages of each, spread evenly over its whole length; weights restore the labels' true shares. The sample's ids are few enough to broadcast, so the texts
are scanned, not shuffled. Scoring reads every text whole, a passage at a time, and sees nothing but the text.

Null and empty texts are one passage without words. Labels other than 0 and 1, and labels of ids that no document has, are
left out; of repeated labels of an id the highest counts. Without labels every score is 0.5, with one label only it is
that label. Repeated rows need no special case; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_hash, table, tidy

PASSAGE_WORDS = 50
MAX_DOCS = 4000
DOC_PASSAGES = 40
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, SEED = 40, 64, 0.01, 7
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """256 x C: the class of each byte. Each ASCII mark is a class, then capitals, small letters, digits, the rest."""
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out = np.zeros((256, len(marks) + 4), np.float32)
    out[marks, range(len(marks))] = 1
    for c in range(256):
        kind = 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c >= 128 else None
        if kind is not None:
            out[c, len(marks) + kind] = 1
    return out


_CLASSES = _classes()
WIDTH = _CLASSES.shape[1] + 6


def passages(text: bytes, words: int = PASSAGE_WORDS) -> np.ndarray:
    """(passages, WIDTH) features; one row of zeros if there is no word."""
    parts = text.split()
    if not parts:
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(parts) // words)
    out = np.zeros((n, WIDTH), np.float32)
    step = 2000
    for lo in range(0, n, step):  # a very long text goes in runs of passages
        hi = min(n, lo + step)
        some = parts[lo * words : hi * words]
        size = np.fromiter(map(len, some), np.int64, len(some))
        starts = np.arange(0, len(some), words)
        chars = np.add.reduceat(size, starts)
        count = np.diff(np.append(starts, len(some)))
        raw = np.frombuffer(b"".join(some), np.uint8)
        of = np.repeat(np.arange(hi - lo) * 256, chars)
        hist = np.bincount(of + raw, minlength=(hi - lo) * 256).reshape(hi - lo, 256)
        out[lo:hi, : _CLASSES.shape[1]] = (hist @ _CLASSES) / np.maximum(chars, 1)[:, None]
        same = np.fromiter(map(eq, some[1:], some[:-1]), np.int64, len(some) - 1)
        same = np.append(0, same)
        upper = np.fromiter(map(bytes.isupper, some), np.int64, len(some))
        more = out[lo:hi, _CLASSES.shape[1] :]
        more[:, 0] = count / words
        more[:, 1] = chars / count / 10
        more[:, 2] = [len(set(some[a : a + words])) / c for a, c in zip(starts.tolist(), count.tolist(), strict=True)]
        more[:, 3] = np.add.reduceat(same, starts) / count
        more[:, 4] = np.add.reduceat(upper, starts) / count
        more[:, 5] = np.add.reduceat((size == 1).astype(np.int64), starts) / count
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention, score."""

    def __init__(self, constant: float | None = None, seed: int = SEED):
        self.constant = constant
        r = np.random.default_rng(seed)
        scale = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        self.mean, self.sd = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"w": scale(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": scale(HIDDEN, GATE), "u": scale(HIDDEN, GATE), "a": scale(GATE, 1)[:, 0], "c": scale(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (v * u) @ p["a"]
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        alpha = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "alpha": alpha, "z": z, "size": size, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, starts: np.ndarray, f: dict[str, np.ndarray], off: np.ndarray) -> dict[str, np.ndarray]:
        """off: the loss's slope by each bag's logit."""
        p = self.p
        dz = off[:, None] * p["c"]
        dz_i = np.repeat(dz, f["size"], axis=0)
        da = (dz_i * f["h"]).sum(axis=1)
        de = f["alpha"] * (da - np.repeat(np.add.reduceat(f["alpha"] * da, starts), f["size"]))
        dv, du = de[:, None] * p["a"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["a"] * f["v"] * f["u"] * (1 - f["u"])
        dh = f["alpha"][:, None] * dz_i + dv @ p["v"].T + du @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": (de[:, None] * f["v"] * f["u"]).sum(axis=0), "c": f["z"].T @ off, "d": np.array([off.sum()])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        x = (np.concatenate(bags) - self.mean) / self.sd
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(x, starts)["y"]


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    if not len(bags) or labels.min() == labels.max():
        return Model(constant=0.5 if not len(bags) else float(labels[0]))
    model, r = Model(seed=seed), np.random.default_rng(seed)
    every = np.concatenate(bags)
    model.mean, model.sd = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    bags = [(b - model.mean) / model.sd for b in bags]
    m, s, t = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(3))
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in some])
            starts = np.cumsum([0, *(len(bags[i]) for i in some)])[:-1]
            f = model.forward(x, starts)
            g = model.gradient(x, starts, f, (f["y"] - labels[some]) * weights[some] / len(some))
            step += 1
            for k, v in g.items():
                v = v + 1e-4 * model.p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * v, 0.999 * s[k] + 0.001 * v**2
                model.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: Column | None = None, max_docs: int = MAX_DOCS, doc_passages: int = DOC_PASSAGES) -> Model:
    """keep: the rows of labels to learn from (all, if None)."""
    told = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    told = told if keep is None else told.filter(keep)
    n = {int(k): v for k, v in told.groupBy(label_col).count().collect()}
    if not n:
        return train([], np.zeros(0), np.zeros(0))
    pick = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 30))
    bound = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(int(min(1.0, max_docs / len(n) / v) * (1 << 30))))])
    told = told.filter(pick < F.element_at(bound, F.col(label_col).cast("int"))).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    # some max_docs ids: their hashes are uniform, and the limit makes the bound hold for certain
    told = told.orderBy(F.xxhash64(id_col)).limit(2 * max_docs)
    src = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(told), id_col).select(F.col(id_col).alias("id"), "label", F.col("__text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = passages(batch.column("text")[i].as_py() or b"")
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), doc_passages)).round().astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([x.tobytes()], pa.binary())], names=["id", "label", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    # in one order, so that reruns agree; a document that has several rows counts once
    found = src.mapInArrow(tidy(run), f"id {kind}, label int, x binary").groupBy("id").agg(F.min(F.struct("x", "label")).alias("row"))
    rows = found.orderBy(F.xxhash64("id"), "id").select("row.label", "row.x").toArrow()
    bags = [np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH) for x in rows.column("x")]
    y = np.array(rows.column("label").to_pylist(), np.float64)
    have = {k: max(1, int((y == k).sum())) for k in n}
    total = sum(n.values())
    return train(bags, y, np.array([n[int(k)] / total * len(y) / have[int(k)] for k in y]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score, double; a column of that name is replaced. Only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            done, bags, held = [], [], 0
            for t in batch:
                bags.append(passages(t.as_buffer().to_pybytes() if t.is_valid else b""))
                held += len(bags[-1])
                if held > 2000:
                    done.append(sent.value.scores(bags))
                    bags, held = [], 0
            if bags:
                done.append(sent.value.scores(bags))
            yield pa.array(np.concatenate(done) if done else np.zeros(0))

    return docs.withColumn(out, told(F.col(text_col)))


# ---- query -------------------------------------------------------------------------------------------------------


def op9_quality_mil(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = F.pmod(id_hash("doc_id"), F.lit(5)) == 0
    model = fit(docs, labels, keep=~held)
    out = score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
