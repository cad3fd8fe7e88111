"""Toxicity by a counterfactual-regularised classifier.

Features of a text are the distinct words and word beginnings of 4 to 6 bytes in
it; those that differ clearly between the classes (chi-squared) are kept, and all
identity terms.  Logistic regression is fitted on a bounded sample of labelled
rows.  In every sentence of a labelled text that holds an identity term, the term
is swapped for each other term of its group, the features of the swapped sentence
are extracted like any text's, and the squared change of the score is penalised,
so that naming a group neither raises nor lowers it.  Scoring reads each text
once and shuffles nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import written

#: Labelled rows to fit on at most (the first by a hash of their id).
MAX_LABELLED = 20_000
#: Features are kept from this chi-squared and number of labelled texts on, the best of them by chi-squared.
MIN_CHI2, MIN_TEXTS = 40.0, 3
MAX_FEATURES = 4096
COUNTERFACTUAL = 10.0
RIDGE = 1e-4
#: A text is toxic at this score at least, however well a lower one did on held-out rows.
MIN_THRESHOLD = 0.5
#: Interchangeable terms of one language, number and gender; the first of each group is neutral.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("person", "man", "woman", "girl", "boy", "transgender"),
    ("people", "men", "women", "girls", "boys", "immigrants", "refugees", "foreigners", "gays", "lesbians", "muslims", "jews", "christians", "hindus", "buddhists", "atheists", "asians", "africans", "americans", "europeans", "arabs", "mexicans"),
    ("human", "muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "american", "european", "arab", "mexican", "gay", "lesbian", "bisexual", "straight", "disabled", "blind", "deaf", "old", "young"),
    ("personne", "homme", "femme", "fille", "garçon"),
    ("gens", "hommes", "femmes", "filles", "garçons", "immigrés", "réfugiés", "étrangers", "homosexuels", "lesbiennes", "musulmans", "juifs", "chrétiens", "bouddhistes", "athées", "asiatiques", "africains", "américains", "européens", "arabes"),
    ("humain", "musulman", "juif", "chrétien", "hindou", "bouddhiste", "athée", "noir", "blanc", "africain", "américain", "européen", "homosexuel", "bisexuel", "handicapé", "aveugle", "sourd", "vieux", "jeune"),
    ("mensch", "mann", "frau", "mädchen", "junge"),
    ("menschen", "männer", "frauen", "jungen", "einwanderer", "flüchtlinge", "ausländer", "schwule", "lesben", "muslime", "juden", "christen", "buddhisten", "atheisten", "asiaten", "afrikaner", "amerikaner", "europäer", "araber"),
    ("menschlich", "muslimisch", "jüdisch", "christlich", "buddhistisch", "schwarz", "weiß", "asiatisch", "afrikanisch", "amerikanisch", "europäisch", "arabisch", "schwul", "lesbisch", "bisexuell", "behindert", "blind", "taub", "alt", "jung"),
    ("persona", "hombre", "mujer", "niña", "niño"),
    ("personas", "hombres", "mujeres", "niñas", "niños", "inmigrantes", "refugiados", "extranjeros", "homosexuales", "lesbianas", "musulmanes", "judíos", "cristianos", "budistas", "ateos", "asiáticos", "africanos", "americanos", "europeos", "árabes"),
    ("humano", "musulmán", "judío", "cristiano", "budista", "ateo", "negro", "blanco", "asiático", "africano", "americano", "europeo", "homosexual", "bisexual", "discapacitado", "ciego", "sordo", "viejo", "joven"),
)
_PREFIXES = (4, 5, 6)
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])  # bytes that end a sentence


def features(part: pa.RecordBatch, column: str = "text", terms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of one slice of texts.

    Words in ``terms`` (sorted hashes of the identity terms) have no beginnings,
    so that a swap of terms changes the features of the terms alone.
    """
    data, offsets = K.buffers(part.column(column))
    start, end, first = K.word_spans(data, offsets, K.ALNUM)
    doc = np.repeat(np.arange(part.num_rows), np.diff(first))
    run = K.prefix_sums(data)
    hashes, docs = [K.span_hashes(run, start, end)], [doc]
    free = np.ones(len(start), bool) if terms is None or not len(terms) else ~np.isin(hashes[0], terms)
    for size in _PREFIXES:
        long = (end - start > size) & free
        cut = K.span_hashes(run, start[long], start[long] + size)
        hashes.append(cut ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(hashes)


def _counter(terms: np.ndarray):
    """How many toxic and other texts hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False) == 1
                doc, h = features(part, terms=terms)
                at = K.first_of_each(h, doc)
                doc, h = doc[at], h[at]
                name, place = np.unique(h, return_inverse=True)
                bad = np.bincount(place, weights=toxic[doc], minlength=len(name)).astype(np.int64)
                all_ = np.bincount(place, minlength=len(name)).astype(np.int64)
                yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(bad), pa.array(all_)], ["h", "bad", "n"])

    return run


def locate(vocabulary: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in the sorted vocabulary) of the features that are in it."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.zeros(1 << 16, bool)  # most hashes begin unlike any in the vocabulary
    begins[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    near = np.flatnonzero(begins[(h >> np.uint64(48)).astype(np.int64)])
    doc, h = doc[near], h[near]
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == h
    pair = np.unique(doc[hit].astype(np.int64) * len(vocabulary) + at[hit])
    return pair // len(vocabulary), pair % len(vocabulary)


def _indexer(vocabulary: np.ndarray, terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                doc, place = locate(vocabulary, *features(part, terms=terms))
                size = np.bincount(doc, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.record_batch([part.column("_id"), part.column("toxic"), lists], ["_id", "toxic", "places"])

    return run


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    threshold: float
    terms: np.ndarray | None = None  # sorted hashes of the identity terms

    def scores(self, part: pa.RecordBatch, column: str = "text") -> np.ndarray:
        doc, place = locate(self.vocabulary, *features(part, column, self.terms))
        logit = self.bias + np.bincount(doc, weights=self.weights[place] if len(self.weights) else None, minlength=part.num_rows)[: part.num_rows]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


@dataclass
class Sparse:
    """Rows of a 0/1 matrix as (row, place) pairs in order of row."""

    row: np.ndarray
    place: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.place], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=r[self.row], minlength=self.shape[1])

    def part(self, keep: np.ndarray) -> Sparse:
        at = np.cumsum(keep) - 1
        live = keep[self.row]
        return Sparse(at[self.row[live]], self.place[live], (int(keep.sum()), self.shape[1]))


def sentences(part: pa.RecordBatch, terms: np.ndarray, column: str = "text") -> list[bytes]:
    """The sentences of a slice that hold an identity term, as often as they occur."""
    data, offsets = K.buffers(part.column(column))
    start, end, first = K.word_spans(data, offsets, K.ALNUM)
    hit = start[np.isin(K.word_hashes(data, start, end), terms)]
    if not len(hit):
        return []
    edges = np.unique(np.r_[offsets, np.flatnonzero(_ENDS[data]) + 1])
    at = np.unique(np.searchsorted(edges, hit, "right"))
    return [data[a:b].tobytes() for a, b in zip(edges[at - 1].tolist(), edges[at].tolist(), strict=True)]


def swapped(sentence: bytes, groups: list[list[bytes]]) -> list[bytes]:
    """The sentence with a term that it holds replaced, wherever it occurs, by another of its group; one for each such pair."""
    data = np.frombuffer(sentence, np.uint8)
    start, end, _ = K.word_spans(data, np.array([0, len(data)]), K.ALNUM)
    words = [sentence[a:b].lower() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    gaps = [sentence[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(sentence)], strict=True)]
    out = []
    for group in groups:
        for a in sorted(set(words) & set(group)):
            for b in group:
                if b != a:
                    kept = [b if w == a else w for w in words]
                    out.append(b"".join(x for pair in zip(gaps, [*kept, b""], strict=True) for x in pair))
    return out


def _swapper(vocabulary: np.ndarray, terms: np.ndarray, groups: list[list[bytes]]):
    """(places lost, places won, count) by swaps in the sentences of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                held = Counter(sentences(part, terms))
                texts, pairs = [], []
                for s, n in held.items():
                    others = swapped(s, groups)
                    pairs += [(len(texts), len(texts) + 1 + k, n) for k in range(len(others))]
                    texts += [s, *others]
                if not pairs:
                    continue
                rows = pa.record_batch([pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["text"])
                doc, place = locate(vocabulary, *features(rows, terms=terms))
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                sets = [frozenset(place[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                count: Counter = Counter()
                for a, b, n in pairs:
                    count[tuple(sorted(sets[a] - sets[b])), tuple(sorted(sets[b] - sets[a]))] += n
                yield pa.record_batch([pa.array([list(k[0]) for k in count], pa.list_(pa.int32())), pa.array([list(k[1]) for k in count], pa.list_(pa.int32())), pa.array(list(count.values()), pa.int64())], ["lost", "won", "n"])

    return run


def fit(x: Sparse, y: np.ndarray, swaps: list[tuple[list[int], list[int], int]], plain: np.ndarray | None = None, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on log loss, ridge and counterfactual penalty.

    ``swaps`` are (features lost, features won, how often); the penalty is the
    mean squared change of the score.  Features in ``plain`` are not scaled by
    frequency.
    """
    n, k = x.shape
    count = np.bincount(x.place, minlength=k).astype(float)
    rare = 1 / np.sqrt(np.maximum(count / n, 1e-4))  # scale by frequency, so rare words learn as fast
    if plain is not None:
        rare[plain] = 1
    change = Sparse(np.repeat(np.arange(2 * len(swaps)), [len(f) for lost, won, _ in swaps for f in (lost, won)]), np.array([i for lost, won, _ in swaps for f in (lost, won) for i in f], np.int64), (2 * len(swaps), k))
    often = np.array([c for *_, c in swaps], float)
    often /= max(often.sum(), 1.0)

    def penalty(v: np.ndarray) -> np.ndarray:
        """Half the gradient of the mean squared change."""
        d = change.dot(v[:k] * rare)
        r = often * (d[1::2] - d[::2])
        return np.r_[change.back(np.stack([-r, r], 1).ravel()) * rare, 0.0]

    score = lambda v: x.dot(v[:k] * rare) + v[k]
    back = lambda r: np.r_[x.back(r) * rare, r.sum()]

    def largest(f) -> float:
        v = np.random.default_rng(0).normal(size=k + 1)
        for _ in range(40):
            v /= np.linalg.norm(v)
            w = f(v)
            if not np.any(w):
                return 0.0
            top, v = float(v @ w), w
        return 1.05 * top

    rate = 1 / (largest(lambda v: back(score(v)) / n / 4) + ridge + 2 * counterfactual * largest(penalty))
    w = np.zeros(k + 1)
    at, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(score(at), -40, 40)))
        new = at - rate * (back(p - y) / n + ridge * at + 2 * counterfactual * penalty(at))
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at = new + (momentum - 1) / later * (new - w)
        w, momentum = new, later
    return w[:k] * rare, float(w[k])


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of the widest gap between scores it may lie in."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], y[order].astype(float)
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(t.sum(), 1))
    edge = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
    if not edge.any() or not t.sum():
        return 1.1
    at = int(np.argmax(np.where(edge, f1, -1)))
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0.0)) / 2)


def trained(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, identity=IDENTITY, counterfactual: float = COUNTERFACTUAL,
    min_chi2: float = MIN_CHI2, min_texts: int = MIN_TEXTS, max_features: int = MAX_FEATURES,
) -> Model:
    """The model; with no labelled rows or one class only it calls nothing toxic.

    One scan of ``docs`` stores the labelled rows, at most ``max_labelled`` and
    their repeats; all fitting reads those.  A null id, label or text isn't used.
    """
    sample = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic")).where("_id is not null and toxic is not null").orderBy(F.xxhash64("_id"), "_id", "toxic").limit(max_labelled)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "toxic", "text")
    rows = written(rows, "labelled")
    total = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, bad = int(total[0]), int(total[1])
    if not 0 < bad < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.1)
    terms = {w: np.uint64(K.hash_word(w.encode())) for g in identity for w in g}
    protected = np.unique(np.array(list(terms.values()), np.uint64))
    counts = rows.select("toxic", "text").mapInArrow(_counter(protected), "h bigint, bad bigint, n bigint").groupBy("h").agg(F.sum("bad").alias("a"), F.sum("n").alias("m"))
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    chi2 = n * F.pow(a * n - m * bad, F.lit(2)) / (m * (n - m) * float(bad) * float(n - bad))
    picked = counts.where((F.col("m") < n) & (F.col("m") >= min_texts)).withColumn("chi2", chi2).where(F.col("chi2") > min_chi2).orderBy(F.col("chi2").desc(), "h").limit(max_features).select("h").toArrow()
    vocabulary = np.unique(np.concatenate([picked.column("h").to_numpy().view(np.uint64), protected]))
    got = rows.mapInArrow(_indexer(vocabulary, protected), "_id bigint, toxic int, places array<int>").toArrow().combine_chunks()
    key = np.argsort(K.mix(got.column("_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
    lists = got.column("places").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    y = got.column("toxic").to_numpy().astype(np.float64)
    x = Sparse(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(), (len(size), len(vocabulary)))
    changes = rows.select("text").mapInArrow(_swapper(vocabulary, protected, [[w.encode() for w in g] for g in identity]), "lost array<int>, won array<int>, n bigint").groupBy("lost", "won").agg(F.sum("n").alias("n")).orderBy("lost", "won").collect()
    swaps = [(r.lost, r.won, r.n) for r in changes]  # pairs of terms: their number is bounded by the lists of terms
    held = np.zeros(len(y), bool)
    held[key[3::4]] = True
    w, b = fit(x.part(~held), y[~held], swaps, np.searchsorted(vocabulary, protected), counterfactual)
    threshold = best_threshold(1 / (1 + np.exp(-np.clip(x.part(held).dot(w) + b, -40, 40))), y[held])
    return Model(vocabulary, w, b, 0.5 if threshold > 1 else min(max(threshold, MIN_THRESHOLD), 0.9), protected)


def _scorer(held):
    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        parts = [held.value.scores(part) for part in K.slices(pa.record_batch([column], ["text"]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, score, toxic) for every row of ``docs``.

    Null and empty texts get the score of no feature at all and are not toxic.
    Repeated rows get equal scores; ids may be null; other columns are ignored.
    """
    model = trained(docs, labels, doc_id=doc_id, text=text, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("_n"), _scorer(held)(F.col(text)).alias("score"))
    return rows.select("doc_id", "score", ((F.col("_n") > 0) & (F.col("score") >= F.lit(model.threshold))).alias("toxic"))
