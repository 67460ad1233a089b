"""Language identification by hierarchical discrimination.

A text becomes the hashed counts of its byte bigrams and trigrams (A-Z lower-cased), square-rooted
and scaled to length 1. A linear support vector machine for each family tells the families apart;
within the family, one machine for each pair of its languages votes. The machines are fitted on a
sample of ``per_language`` distinct labelled texts a language, taken by a hash of the text; predictions
read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernels as K
from gleaner.llm.common import checkpointed, empty_caches, held_out_remainder

#: Families of ISO 639-1 codes. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lv lt",
    "celtic": "ga gd cy br",
    "indic": "hi bn mr ur pa gu ne",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 4096
UNKNOWN = "und"
#: Lengths (powers of two, in bytes) of the pieces that a language's likeness is calibrated on.
PIECES = range(4, 14)
_LETTER = regex.compile(r"\p{L}")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of DIMENSIONS numbers for each text."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, DIMENSIONS), np.float32)
    low = K._LOWER[data].astype(np.uint32)
    n = len(low)
    if n > 1:
        pair = low[:-1] | low[1:] << np.uint32(8)
        triple = pair[:-1] | low[2:] << np.uint32(16)
        two = (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        three = (triple * np.uint32(0x85EBCA6B) + np.uint32(0x5BD1E995)) >> np.uint32(32 - 12)
        for r in range(rows):
            a, b = offsets[r], offsets[r + 1]
            if b - a > 1:
                counts[r] = np.bincount(two[a : b - 1], minlength=DIMENSIONS)
                if b - a > 2:
                    counts[r] += np.bincount(three[a : b - 2], minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine with squared hinge loss, by
    accelerated gradient descent; both sides weigh the same."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, ahead, bias_scale = np.zeros(x.shape[1] + 1, np.float32), None, 1.0
    ahead = w.copy()
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + bias_scale * ahead[-1])) * weight * y
        gradient = np.concatenate((penalty * ahead[:-1] - 2 * (slack @ x), [-2 * bias_scale * slack.sum()])).astype(np.float32)
        new = ahead - 0.25 * gradient
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.languages = sorted(set(labels.tolist()))
        family = {c: FAMILY.get(c, c) for c in self.languages}
        self.families = sorted(set(family.values()))
        of = np.array([family[c] for c in labels]) if len(labels) else np.array([], str)
        none = np.zeros((0, DIMENSIONS + 1), np.float32)
        self.family_weights = np.array([fit_svm(x, of == f) for f in self.families]) if len(self.families) > 1 else none
        self.members = [[c for c in self.languages if family[c] == f] for f in self.families]
        self.pairs = [list(combinations(range(len(m)), 2)) for m in self.members]
        self.pair_weights = []
        for m, pairs in zip(self.members, self.pairs):
            fitted = []
            for a, b in pairs:
                both = (labels == m[a]) | (labels == m[b])
                fitted.append(fit_svm(x[both], labels[both] == m[a]))
            self.pair_weights.append(np.array(fitted) if fitted else none)

        sums = np.array([x[labels == c].sum(0) for c in self.languages]).reshape(-1, DIMENSIONS)
        self.sums = sums
        self.centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        #: Least likeness, by language and piece length; without calibration everything is claimed.
        self.least = np.full((len(self.languages), len(PIECES)), -np.inf)

    def calibrate(self, langs: np.ndarray, pieces: np.ndarray, likeness: np.ndarray, least_rows: int = 20, widths: float = 6.0, margin: float = 0.1) -> None:
        """From likenesses of the learned texts' pieces: the median less some robust standard deviations
        and a margin, so that junk among the learned texts doesn't count. Of too few pieces no bound is made."""
        for i, c in enumerate(self.languages):
            for k in range(len(PIECES)):
                of = likeness[(langs == c) & (pieces == k)]
                if len(of) >= least_rows:
                    middle = np.median(of)
                    self.least[i, k] = middle - margin - widths * max(1.4826 * np.median(np.abs(of - middle)), 0.01)

    def claimed(self, x: np.ndarray, found: list[str], lengths: np.ndarray) -> np.ndarray:
        """Whether each text of so many bytes is as like its language's learned texts as their pieces of
        that length (or of the longest calibrated one below) are."""
        at = np.searchsorted(self.languages, found)
        likeness = np.einsum("ij,ij->i", x, self.centres[at].astype(x.dtype))
        piece = np.clip(np.log2(np.maximum(lengths, 1)).astype(int), PIECES[0], PIECES[-1]) - PIECES[0]
        bounds = np.maximum.accumulate(self.least, axis=1)
        return (lengths < 1 << PIECES[0]) | (likeness >= bounds[at, piece])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (the smaller of two logistic margins) of each row."""
        rows = len(x)
        if len(self.families) > 1:
            margin = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
            chosen = margin.argmax(1)
            score = margin[np.arange(rows), chosen]
        else:
            chosen, score = np.zeros(rows, np.int64), np.full(rows, 4.0)
        out = np.empty(rows, object)
        for f, members in enumerate(self.members):
            at = np.flatnonzero(chosen == f)
            if not len(at):
                continue
            votes = np.zeros((len(at), len(members)))
            sums = np.zeros((len(at), len(members)))
            margins = x[at] @ self.pair_weights[f][:, :-1].T + self.pair_weights[f][:, -1] if len(members) > 1 else None
            for k, (a, b) in enumerate(self.pairs[f]):
                m = margins[:, k]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sums[:, a] += m
                sums[:, b] -= m
            best = np.lexsort((sums, votes), axis=1)[:, -1] if len(members) > 1 else np.zeros(len(at), np.int64)
            out[at] = np.array(members, object)[best]
            if len(members) > 1:
                score[at] = np.minimum(score[at], sums[np.arange(len(at)), best] / (len(members) - 1))
        return out.tolist(), 1 / (1 + np.exp(-3.0 * score.astype(np.float64)))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty_caches()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = features(*K.flat(part.column(0))).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1), part.column(2)], ["x", "lang", "hash"])


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """Of each lang, the per_language texts with the smallest hashes, once each; all where there are fewer."""
    marked = rows.select("lang", F.xxhash64("text", F.lit(7)).alias("hash"), "text")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, hashes = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            for lang in set(langs.tolist()):
                found[lang] = np.unique(np.concatenate((found.get(lang, hashes[:0]), hashes[langs == lang])))[:per_language]
        for lang, hashes in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes), pa.string()), pa.array(hashes)], ["lang", "hash"])

    few = marked.select("lang", "hash").mapInArrow(smallest, "lang string, hash long").groupBy("lang", F.pmod("hash", F.lit(16)).alias("part"))
    few = few.agg(F.slice(F.array_sort(F.collect_set("hash")), 1, per_language).alias("hashes"))
    of: dict[str, list[int]] = {}
    for r in few.collect():
        of.setdefault(r["lang"], []).extend(r["hashes"])
    taken = rows.sparkSession.sparkContext.broadcast({lang: set(sorted(hashes)[:per_language]) for lang, hashes in of.items()})

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key[1] in taken.value.get(key[0], ()) and key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return checkpointed(marked.mapInArrow(once, "lang string, hash long, text string").groupBy("lang", "hash").agg(F.min("text").alias("text")))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> Hierarchy:
    """Machines fitted on per_language distinct texts of each language, those of the smallest text hashes.
    Rows of null text or language are left out."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    chosen = sample(rows, per_language)
    table = chosen.select("text", "lang", "hash").mapInArrow(_feature_rows, "x binary, lang string, hash long").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), "<f4").reshape(-1, DIMENSIONS)
    labels = np.array(table.column("lang").to_pylist(), object)
    order = np.lexsort((table.column("hash").to_numpy(), labels.astype(str)))
    model = Hierarchy(x[order], labels[order])
    shipped = labelled.sparkSession.sparkContext.broadcast((model.languages, model.sums))

    def likenesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, sums = shipped.value
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                rest = sums[languages.index(lang)] - features(data, np.array([0, len(data)]))[0]  # of the other texts
                rest = rest / max(np.linalg.norm(rest), 1e-9)
                pieces = [k for k, power in enumerate(PIECES) if 1 << power <= len(data)]
                like = [float(features(data[: 1 << PIECES[k]], np.array([0, 1 << PIECES[k]]))[0] @ rest) for k in pieces]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces), pa.string()), pa.array(pieces, pa.int64()), pa.array(like, pa.float64())], ["lang", "piece", "likeness"])

    found = chosen.select("text", "lang").mapInArrow(likenesses, "lang string, piece long, likeness double").toArrow()
    model.calibrate(np.array(found.column("lang").to_pylist(), object), found.column("piece").to_numpy(), found.column("likeness").to_numpy())
    return model


def predict(docs: DataFrame, model: Hierarchy, text_col: str = "text") -> DataFrame:
    """docs and the columns __lang, __score and __claimed (whether the text is like those the language was
    learned from); of a text that is null or has no letter, or where no language was learned, ``und``, 0
    and false. Columns of these names are replaced."""
    docs = docs.drop("__lang", "__score", "__claimed")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        model = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(names.index(text_col))
                lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                langs, scores, claimed = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                if model.languages and lettered.any():
                    data, offsets = K.flat(texts.filter(pa.array(lettered)))
                    x = features(data, offsets)
                    found, score = model.predict(x)
                    claimed[lettered] = model.claimed(x, found, np.diff(offsets))
                    for i, lang in zip(np.flatnonzero(lettered).tolist(), found):
                        langs[i] = lang
                    scores[lettered] = score
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(claimed)], [*names, "__lang", "__score", "__claimed"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("__lang", StringType()).add("__score", DoubleType()).add("__claimed", BooleanType())
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32 of the id as text, modulo 3, isn't 1 (null ids count as held out); then
    every whole text is predicted from the text alone. Repeated rows are all returned; an empty table
    gives no rows; further columns are ignored.
    """
    held_out = F.coalesce(held_out_remainder(id_col, 3) == 1, F.lit(True))
    model = fit(docs.filter(~held_out), text_col, lang_col, per_language)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(narrow, model).select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
