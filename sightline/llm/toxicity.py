r"""Toxicity by multiple-instance learning: only documents have labels, sentences are scored.

A document's score is the noisy-or of its sentences, 1 - prod(1 - p). A sentence's p is logistic in the
sum of its words' weights, a word's weight being that of its features: itself and its prefixes of 3 to 8
characters. Sentences in which no chosen feature occurs have p = 0, so that a long clean text gathers no
score. Weights maximise the likelihood of the documents' labels under the noisy-or (Adam over all of the
sample, with a ridge); the gradient shares a label among the sentences that may explain it. Scored
documents come with their offending sentences.

Sentences end at `.`, `!`, `?` or a line's end. Words are runs of letters and digits, lower-cased; other
characters part them, so `idiot***` is `idiot`.

The model is fitted on a bounded sample: about `per_class` labelled training documents of each label, by a
hash of the id, weighted so that each label counts as often as it has documents. From it features in at
least `least` documents whose log odds are `z` standard errors from nothing are chosen, the strongest
`features` at most. Both bounds hold the tables that reach the driver; equal feature sets of a document's
sentences are one row with a number. Scoring is one scan of all documents, whole texts, without a shuffle.

Labels: of several rows of an id the largest counts; null labels don't count, and neither do ids without a
document. Repeated documents of one id are one in training and each scored. Null and empty texts and
texts without words score 0. Without training documents of both labels every score is 0. Columns of the
input come back as they are, save that ones with the names of the results are replaced; an empty table
gives an empty table.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .text import slices, trim
from .workspace import Workspace

SENTENCE_END = r"[.!?\n]+"
NO_WORD = r"[^\p{L}\p{N}.!?\n]+"
SHORT, LONG = 3, 8


def features_of(word: str) -> list[str]:
    """The word itself, marked, and its prefixes."""
    return ["=" + word, *(word[:n] for n in range(SHORT, min(LONG, len(word) - 1) + 1))]


class Sentences:
    """Words of the sentences of many texts: word (index into words) and sentence of each, doc and text of a sentence."""

    def __init__(self, texts):
        trim()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.raw = pc.split_pattern_regex(texts, SENTENCE_END)
        clean = pc.replace_substring_regex(pc.utf8_lower(texts), NO_WORD, " ")
        parts = pc.split_pattern_regex(clean, SENTENCE_END)
        per = np.diff(parts.offsets.to_numpy())
        self.doc = np.repeat(np.arange(len(texts)), per)
        self.first = np.cumsum(per) - per
        tokens = pc.ascii_split_whitespace(parts.flatten())
        flat = tokens.flatten()
        real = pc.not_equal(pc.binary_length(flat), 0)
        coded = flat.filter(real).dictionary_encode()
        self.word = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary.to_pylist()
        self.sentence = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
        self.n_docs = len(texts)
        filled = np.bincount(self.sentence, minlength=len(self.doc)) > 0
        self.per_doc = np.bincount(self.doc[filled], minlength=self.n_docs)

    def spread(self, of_word: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature) of every word's features, of_word being the features of each distinct word."""
        size = np.array([len(x) for x in of_word], np.int64)
        flat = np.array([f for x in of_word for f in x], np.int64)
        begin = np.cumsum(size) - size
        n = size[self.word] if len(size) else np.zeros(0, np.int64)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.sentence, n), flat[np.repeat(begin[self.word], n) + inner] if len(flat) else np.zeros(0, np.int64)


def _counted(batches):
    """Sampled documents (text, label) to the documents of each label that a feature is in."""
    for batch in batches:
        for piece in slices(batch, 0):
            s = Sentences(piece.column(0))
            label = piece.column(1).to_numpy()
            names: dict[str, int] = {}
            of_word = [[names.setdefault(f, len(names)) for f in features_of(w)] for w in s.words]
            if not names:
                continue
            pair = np.unique(s.doc[s.sentence] * np.int64(len(s.words)) + s.word)  # words of a document once
            doc, word = pair // len(s.words), pair % len(s.words)
            size = np.array([len(x) for x in of_word])
            flat = np.concatenate([np.array(x) for x in of_word])
            begin, n = np.cumsum(size) - size, size[word]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            both = np.unique(np.repeat(doc, n) * np.int64(len(names)) + flat[np.repeat(begin[word], n) + inner])
            bad = np.bincount((both % len(names))[label[both // len(names)] == 1], minlength=len(names))
            seen = np.bincount(both % len(names), minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(names)), pa.array(seen - bad, pa.int64()), pa.array(bad, pa.int64())], names=["feature", "good", "bad"])


def _bags(table: dict[str, int]):
    """Sampled documents (text, label, doc_id) to the feature sets of their sentences with numbers."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 0):
                s = Sentences(piece.column(0))
                at, feature = s.spread([[table[f] for f in features_of(w) if f in table] for w in s.words])
                sets: list[Counter] = [Counter() for _ in range(piece.num_rows)]
                cut = np.flatnonzero(np.diff(at)) + 1
                for i, x in zip(at[np.concatenate([[0], cut])] if len(at) else [], np.split(feature, cut)):
                    sets[s.doc[i]][np.sort(x).astype(np.int32).tobytes()] += 1
                yield pa.RecordBatch.from_arrays([
                    piece.column(2), piece.column(1), pa.array([b"".join(c) for c in sets], pa.binary()),
                    *(pa.array([np.array(list(v), np.int32).tobytes() for v in x], pa.binary()) for x in ([[len(k) // 4 for k in c] for c in sets], [c.values() for c in sets])),
                ], names=["id", "label", "features", "sizes", "times"])

    return run


class Model:
    """Weights of features, and the bias of a sentence that has any."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, s: Sentences) -> np.ndarray:
        """p of every sentence."""
        own, known = np.zeros(len(s.words)), np.zeros(len(s.words), bool)
        for i, w in enumerate(s.words):
            found = [self.weights[f] for f in features_of(w) if f in self.weights]
            if found:
                own[i], known[i] = sum(found), True
        z = self.bias + np.bincount(s.sentence, weights=own[s.word], minlength=len(s.doc))
        some = np.bincount(s.sentence, weights=known[s.word], minlength=len(s.doc)) > 0
        return np.where(some, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) of each document's sentences."""
    return 0.0 - np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-15)), minlength=n))


def fitted(names: list[str], rows: pa.Table, weight: dict[int, float], rounds: int, ridge: float, part: int = 1 << 20) -> Model:
    """Adam on the likelihood of labels; rows (label, features, sizes, times: 32-bit integers) weigh weight[label] each.

    features holds a document's feature sets one after another, sizes and times how large each is and how many of its
    sentences have it. About `part` features are worked on at a time.
    """
    joined = lambda c: np.frombuffer(b"".join(x.as_buffer() for x in rows.column(c)), np.int32)
    y, feature, size, times = rows.column("label").to_numpy(), joined("features"), joined("sizes"), joined("times")
    doc = np.repeat(np.arange(len(y)), [x.as_buffer().size // 4 for x in rows.column("sizes")])
    per = np.array([weight[v] for v in y.tolist()])
    starts = np.cumsum(size, dtype=np.int64) - size
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(feature), part)))
    parts = list(zip(cuts, np.append(cuts[1:], len(size)))) if len(size) else []
    span = lambda i, j: slice(int(starts[i]), int(starts[j]) if j < len(size) else len(feature))
    x, first, second, z = np.append(np.zeros(len(names)), -4.0), 0.0, 0.0, np.zeros(len(size))
    for t in range(1, rounds + 1):
        for i, j in parts:
            z[i:j] = np.add.reduceat(x[feature[span(i, j)]], starts[i:j] - starts[i])
        z = np.clip(z + x[-1], -40, 40)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, weights=-times * np.logaddexp(0, z), minlength=len(y)))  # chance that no sentence is toxic
        pull = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0) * per
        dz = times * p * pull[doc]
        g = np.append(-ridge * x[:-1], dz.sum())
        for i, j in parts:
            g[:-1] += np.bincount(feature[span(i, j)], weights=np.repeat(dz[i:j], size[i:j]), minlength=len(names))
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        step = 0.15 * (1 + np.cos(np.pi * t / rounds))
        x = x + step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.98**t)) + 1e-8)
    return Model(dict(zip(names, x[:-1].tolist())), float(x[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 20000, features: int = 1 << 15, least: int = 3, z: float = 3.0, rounds: int = 120, ridge: float = 0.05) -> Model:
    """A model from the labelled documents; labels has id_col and label."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("_id")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("_label"))
    counts = {r._label: r.n for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return Model({}, 0.0)
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 31)) / float(1 << 31)
    share = F.when(F.col("_label") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    ids = F.broadcast(known.where(place < share))  # about 2 * per_class rows at most
    own = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    sample = space.keep(own.join(ids, F.col("id") == F.col("_id")).select("text", F.col("_label").alias("label"), "id"))
    taken = sample.groupBy("id").agg(F.max("label").alias("label"))
    found = {r.label: r.n for r in taken.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        space.clear()
        return Model({}, 0.0)
    per = sample.groupBy("label").agg(F.count("*").alias("n")).collect()
    bad_n, good_n = (next(r.n for r in per if r.label == v) for v in (1, 0))
    odds = F.log((F.col("bad") + 0.5) / (bad_n + 1)) - F.log((F.col("good") + 0.5) / (good_n + 1))
    strength = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    counted = sample.select("text", "label").mapInArrow(_counted, "feature string, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    strong = counted.where(F.col("good") + F.col("bad") >= least).withColumn("z", F.abs(strength)).where(F.col("z") > z)
    names = sorted(r.feature for r in strong.orderBy(F.desc("z"), "feature").limit(features).select("feature").collect())
    table = {f: i for i, f in enumerate(names)}
    bags = sample.mapInArrow(_bags(table), "id long, label int, features binary, sizes binary, times binary")
    once = bags.groupBy("id").agg(F.min(F.struct("label", "features", "sizes", "times")).alias("row"))
    rows = once.orderBy("id").select("row.*").toArrow()
    space.clear()
    scale = sum(found.values()) / sum(counts.values())
    return fitted(names, rows, {v: scale * counts[v] / found[v] for v in (0, 1)}, rounds, ridge)


def _score(schema: pa.Schema, kept: list[str], text: str, model: Model, offending: float, texts: bool):
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Sentences(batch.column(batch.schema.get_field_index(text)))
        p = model.sentences(s)
        score = noisy_or(p, s.doc, s.n_docs)
        hits = np.flatnonzero(p >= offending)
        at = np.searchsorted(s.doc[hits], np.arange(s.n_docs + 1))
        made = {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)), "n_sentences": pa.array(s.per_doc, pa.int64()), "n_offending": pa.array(np.diff(at), pa.int64())}
        if texts:
            raw, rows = s.raw.flatten(), []
            for d in range(s.n_docs):
                rows.append([{"number": int(i - s.first[d]), "score": float(p[i]), "sentence": raw[int(i)].as_py()} for i in hits[at[d] : at[d + 1]]])
            made["offending"] = pa.array(rows, schema.field("offending").type)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(made[f.name] for f in list(schema)[len(kept) :])], names=schema.names)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, batch.schema.get_field_index(text)):
                yield of(piece)

    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", offending: float = 0.5, texts: bool = True) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on), n_sentences (those with a word), n_offending (of score `offending` or more) and,
    with texts, offending: number (from 0, among all pieces between sentence ends), score and text of each of these."""
    made = StructType.fromDDL("score double, predicted int, n_sentences long, n_offending long" + (", offending array<struct<number:bigint,score:double,sentence:string>>" if texts else ""))
    kept = [f for f in docs.schema if f.name not in made.names]
    out = StructType([*kept, *made])
    carried = docs.select(*(F.col(f"`{f.name}`") for f in kept), *([] if text not in made.names else [F.col(f"`{text}`")]))
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    return carried.mapInArrow(_score(schema, [f.name for f in kept], text, model, offending, texts), out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0, texts: bool = True, **fit) -> DataFrame:
    """docs with held_out, then score_toxicity's columns; the model learns from the labels of ids whose crc32 mod folds isn't `held`.

    Rows without an id are neither held out nor learnt from.
    """
    remainder = F.crc32(F.col(f"`{id_col}`").cast("string")) % folds
    model = fit_toxicity(docs, labels.where(remainder != held), id_col, text, **fit)
    return score_toxicity(docs.withColumn("held_out", F.coalesce(remainder == held, F.lit(False))), model, text, texts=texts)
