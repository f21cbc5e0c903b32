"""Language identification by words first, then by progressively shorter character n-grams.

A word that the model knows scores its log10 relative frequency in each language; a word that it does not know falls back
to its longest character n-grams (the word between two spaces, n from 5 down to 1) of which the model knows any, and scores
their mean. What a language lacks scores a penalty below its rarest entry. A text's language has the highest mean word
score; its score is that language's share of the softmax over the means.

The model is fitted on a bounded sample of labelled rows (`docs_per_lang` documents a language, chosen by a hash) and keeps
the most frequent entries of each language and kind, `max_entries` in all and fewer with very many languages, so that its
size does not grow with the corpus. Every language that is labelled is learned. Prediction reads every text whole and
sees nothing but the text.

Null texts and texts without a letter are `und`, score 0; so is every text if no row is labelled. Ties of languages go to
the first in code-point order. Repeated rows and long texts need no special case; an empty table gives an empty one;
extra columns pass, but for those that have the names of the results, which `predict` replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, id_hash, table, tidy

DOCS_PER_LANG = 1500
#: Entries in all, of which each language and kind gets an equal share, and numbers in all (entries times languages).
MAX_ENTRIES, MAX_CELLS = 240_000, 30_000_000
MAX_N = 5
#: Chunks in a generation of the cache, and bytes of text that are split at once.
CACHE_CHUNKS = 80_000
RUN_BYTES = 2_000_000
_LETTERS = regex.compile(r"\p{L}+")
#: One word and ASCII marks after it, the common chunk.
_PLAIN = re.compile(r"([A-Za-z]+)[!-@\[-`{-~]*")


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """tables[0]: words, tables[n]: n-grams, each entry -> its row of log10 relative frequencies by language."""

    def __init__(self, langs: list[str], counts: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted(langs)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.tables: list[dict[str, int]] = [{} for _ in range(MAX_N + 1)]
        # what a language lacks: as if seen a tenth of a time
        floor = np.array([[np.log10(0.1 / max(1, totals.get((lang, k), 1))) for lang in self.langs] for k in range(MAX_N + 1)], np.float32).reshape(MAX_N + 1, len(self.langs))
        rows = [floor[1]]  # row 0: nothing is known
        for lang, k, entry, n in counts:
            if (i := self.tables[k].get(entry)) is None:
                i = self.tables[k][entry] = len(rows)
                rows.append(floor[k].copy())
            rows[i][at[lang]] = np.log10(n / totals[lang, k])
        self.rows = np.stack(rows)

    def entries(self, w: str) -> list[int]:
        """The rows whose mean scores a word: its own, or those of its longest known n-grams."""
        if (i := self.tables[0].get(w)) is not None:
            return [i]
        s = f" {w} "
        for n in range(min(MAX_N, len(s)), 0, -1):
            get = self.tables[n].get
            if found := [i for a in range(len(s) - n + 1) if (i := get(s[a : a + n])) is not None]:
                return found
        return [0]


class Scorer:
    """Scores texts, by chunks between ASCII white space; keeps those in a bounded cache of two generations."""

    def __init__(self, model: Model, cache: int = CACHE_CHUNKS):
        self.model, self.width = model, len(model.langs)
        self.cache = min(cache, 60_000_000 // (4 * (self.width + 1)))
        self.young, self.old = {}, {}
        self.rows = self.old_rows = np.zeros((0, self.width + 1), np.float32)

    def __call__(self, texts: list[bytes]) -> list[tuple[str, float]]:
        split = [t.split() for t in texts]
        self._prepare(set().union(*split))
        size = np.fromiter(map(len, split), np.int64, len(split))
        total = np.zeros((len(texts), self.width + 1))
        get = self.young.__getitem__
        for i, chunks in enumerate(split):
            if size[i]:
                total[i] = self.rows[list(map(get, chunks))].sum(axis=0, dtype=np.float64)
        return [self._told(row) for row in total]

    def _told(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1] or not self.width:
            return "und", 0.0
        mean = total[:-1] / total[-1] * np.log(10)
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())

    def _prepare(self, seen: set[bytes]) -> None:
        """Puts every chunk seen into the young generation."""
        new = seen.difference(self.young)
        if len(self.young) + len(new) > len(self.rows):
            self.old, self.old_rows = self.young, self.rows
            self.young, new = {}, seen
            self.rows = np.zeros((max(self.cache, len(seen)), self.width + 1), np.float32)
        back = [c for c in new if c in self.old]
        fresh = [c for c in new if c not in self.old]
        n = len(self.young)
        if back:
            self.rows[n : n + len(back)] = self.old_rows[[self.old[c] for c in back]]
        if fresh:
            self.rows[n + len(back) : n + len(new)] = self._scores(fresh)
        self.young.update(zip(back + fresh, range(n, n + len(new)), strict=True))

    def _scores(self, chunks: list[bytes]) -> np.ndarray:
        flat: list[int] = []
        of_word, of_chunk, held = [], [], []
        entries, match = self.model.entries, _PLAIN.fullmatch
        for i, c in enumerate(chunks):
            s = c.decode("utf-8", "replace")
            found = (m[1].lower(),) if (m := match(s)) else words(s)
            if found:
                held.append(i)
                of_chunk.append(len(of_word))
                for w in found:
                    of_word.append(len(flat))
                    flat += entries(w)
        out = np.zeros((len(chunks), self.width + 1), np.float32)
        if held:
            each = np.diff(np.append(of_word, len(flat)))[:, None]
            by_word = np.add.reduceat(self.model.rows[flat], of_word, axis=0) / each
            out[held, :-1] = np.add.reduceat(by_word, of_chunk, axis=0)
            out[held, -1] = np.diff(np.append(of_chunk, len(of_word)))
        return out


def scored(score: Scorer, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Languages and scores, by runs of some MB."""
    found, run, held = [], [], 0
    for t in texts:
        run.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        held += len(run[-1])
        if held > RUN_BYTES:
            found += score(run)
            run, held = [], 0
    found += score(run) if run else []
    return pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, docs_per_lang: int = DOCS_PER_LANG, max_entries: int = MAX_ENTRIES) -> Model:
    """A model of the labelled rows of docs. key: a hash (long) that picks the sample, by default one of the text."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"), F.pmod(F.xxhash64(text_col) if key is None else key, F.lit(1 << 20)).alias("pick"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not sizes:
        return Model([], [], {})
    each = max(1, min(max_entries, MAX_CELLS // len(sizes)) // ((MAX_N + 1) * len(sizes)))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1 << 20, int((1 << 20) * docs_per_lang / r["n"]) + 1)))])
    sample = rows.filter(F.col("pick") < F.element_at(share, F.col("lang")))
    if key is None:
        # a text that is copied often is in or out with all its copies: once is enough
        sample = sample.withColumn("of", F.xxhash64("text")).dropDuplicates(["lang", "of"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                seen.setdefault(lang, Counter()).update(words(text.as_py().decode("utf-8", "replace")))
            for lang, own in seen.items():
                for k in range(MAX_N + 1):
                    if k:
                        n = Counter()
                        for w, times in own.items():
                            for g in grams(w, k):
                                n[g] += times
                    else:
                        n = own
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), k, np.int32)), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "k", "entry", "n"])

    counts = sample.select("lang", "text").mapInArrow(tidy(count), "lang string, k int, entry string, n long").groupBy("lang", "k", "entry").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("lang", "k")
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "entry"))).filter(F.col("r") <= each)
    got = counts.select("lang", "k", "entry", "n", "total").toArrow()
    lang, k, entry, n, total = (got.column(c).to_pylist() for c in got.column_names)
    return Model([r["lang"] for r in sizes], list(zip(lang, k, entry, n, strict=True)), dict(zip(zip(lang, k, strict=True), total, strict=True)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with lang string, score double. Only texts go to Python, and only languages and scores come back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_entries entries
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang: string, score: double>")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(run)(texts)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for batch in texts:
            yield pa.StructArray.from_arrays(scored(scorer, batch), names=["lang", "score"])

    out = free_name(docs, "__told")
    return docs.withColumn(out, told(F.col(text_col))).withColumns({lang: F.col(f"{out}.lang"), score: F.col(f"{out}.score")}).drop(out)


def drop_unidentified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.4) -> DataFrame:
    """docs without the texts that have no letter or whose language stays open (a score below min_score)."""
    model = fit(docs, text_col, lang_col)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = predict(docs, model, text_col, lang, score)
    return found.filter((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)


# ---- query -------------------------------------------------------------------------------------------------------


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(id_hash("doc_id"), F.lit(4)) == 2
    model = fit(docs.filter(~held), key=F.xxhash64("doc_id"))
    return predict(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "lang_pred", "score")
