"""Secret scans: candidates by shape and place, false positives removed by a random forest.

There are two kinds of candidates: runs of at least ``least`` characters of keys and digests (letters,
digits, + / _ -), and values of at least ``least_assigned`` characters of any sign that stand after = or :,
also as the password of a URL (``user:password@host``). The forest judges length, shares and
transitions of character classes, how usual its letter pairs are in the corpus, how much of it
dictionary words cover, whether it stands in a path, and which words stand before and after it: each
word weighs as much as it tells secrets from others among the labelled findings. Training is from such
findings; ``synthetic_findings`` makes a bounded set of them, from a seed.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gleaner.llm import kernels as K
from gleaner.llm.common import checkpointed, empty_caches, in_parts, most_frequent, small_batches

BLOCK = 1 << 20
MASK = "[SECRET]"
#: Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 sign of keys, 5 other ASCII sign.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 5
CLASS[list(string.ascii_lowercase.encode())] = 1
CLASS[list(string.ascii_uppercase.encode())] = 2
CLASS[list(string.digits.encode())] = 3
CLASS[list(b"+/_-")] = 4
_KEY = (CLASS > 0) & (CLASS < 5)
_VALUE = CLASS > 0
_VALUE[list(b"\"'`,;<>(){}[]\\")] = False
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Bytes on either side that neighbouring words are taken from, and their number.
AROUND, WORDS = 64, 3
FEATURES = ("length", "lower", "upper", "digit", "key_sign", "other_sign", "transitions", "distinct", "usual_pairs", "dictionary", "slashes", "path", "assigned", "closed", "words_before", "words_after")


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every run of inside; runs don't cross rows."""
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    start[edges] |= inside[edges]
    stop[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def candidates(data: np.ndarray, offsets: np.ndarray, least: int, least_assigned: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every candidate, in order; they don't cross rows but may overlap."""
    first, end = _runs(_KEY[data], offsets)
    long_ = end - first >= least
    found = [np.stack((first[long_], end[long_]), 1)]
    sign = np.flatnonzero((data == 61) | (data == 58))
    if len(sign):
        limit = offsets[np.searchsorted(offsets, sign, side="right")]
        at = sign + 1
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        for _ in range(2):
            at += padded[at] == 32
        at += np.isin(padded[at], list(b"\"'`"))
        value_first, value_end = _runs(_VALUE[data], offsets)
        run = np.minimum(np.searchsorted(value_end, at, side="right"), max(len(value_end) - 1, 0))
        if len(value_end):
            ok = (at < limit) & (value_first[run] <= at) & (at < value_end[run])
            at, stop, begin = at[ok], value_end[run[ok]].copy(), value_first[run[ok]]
            for _ in range(3):  # full stops and the like at the end of a sentence
                stop -= (stop > at) & np.isin(data[stop - 1], list(b".:?"))
            for i in np.flatnonzero(np.isin(data[at - 1], (58,)) & (stop - at >= least_assigned)).tolist():
                value, before = data[at[i] : stop[i]].tobytes(), data[begin[i] : at[i]].tobytes()
                if b"://" in before and b"@" in value:  # a password in a URL
                    stop[i] = at[i] + value.rindex(b"@")
            ok = stop - at >= least_assigned
            found.append(np.stack((at[ok], stop[ok]), 1))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1], np.searchsorted(offsets, both[:, 0], side="right") - 1


def merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Start, end and score of spans in order, overlapping ones joined (with the highest score)."""
    out: list[tuple[int, int, float]] = []
    for start, end, score in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(score, out[-1][2]))
        else:
            out.append((start, end, score))
    return out


class Neighbours:
    """How much words before and after tell secrets from other findings: smoothed log-odds."""

    def __init__(self, findings: list[tuple[list[bytes], list[bytes], int]]):
        self.weights = []
        total = Counter(label for *_, label in findings)
        for side in (0, 1):
            met: dict[bytes, list[int]] = {}
            for f in findings:
                for w in set(f[side]):
                    met.setdefault(w, [0, 0])[f[2]] += 1
            odds = {w: float(np.log((n[1] + 1) / (total[1] + 2)) - np.log((n[0] + 1) / (total[0] + 2))) for w, n in met.items()}
            self.weights.append({w: x for w, x in odds.items() if sum(met[w]) > 2})

    def of(self, before: list[bytes], after: list[bytes]) -> tuple[float, float]:
        """The strongest weight on either side; 0 if none of the words is known."""
        return tuple(max((w[x] for x in words if x in w), key=abs, default=0.0) for w, words in zip(self.weights, (before, after)))


def words_beside(raw: bytes, first: int, end: int, lo: int, hi: int) -> tuple[list[bytes], list[bytes]]:
    """The nearest WORDS words before and after a candidate, lower-cased."""
    before = _WORD.findall(raw[max(first - AROUND, lo) : first])[-WORDS:]
    after = _WORD.findall(raw[end : min(end + AROUND, hi)])[:WORDS]
    return [w.lower() for w in before], [w.lower() for w in after]


class Background:
    """What is usual in a corpus: log-probabilities of byte pairs, and the 4-byte pieces of its most
    frequent words (lower-cased) as a bitmap of 2**20 hashes."""

    def __init__(self, pairs: np.ndarray, words: list[bytes]):
        p = pairs.reshape(256, 256) + 0.1
        self.pairs = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)
        self.pieces = np.zeros(1 << 20, bool)
        for w in words:
            if len(w) >= 4:
                self.pieces[_pieces(np.frombuffer(w, np.uint8))] = True


def _pieces(data: np.ndarray) -> np.ndarray:
    x = K._LOWER[data].astype(np.uint32)
    x = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(12)


def features(data: np.ndarray, first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, background: Background, neighbours: Neighbours) -> np.ndarray:
    """A row of FEATURES for each candidate; lo and hi bound its text."""
    n = len(first)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    size = end - first
    begin = np.cumsum(size) - size
    shift = np.arange(size.sum()) - np.repeat(begin, size)
    chars = data[np.repeat(first, size) + shift]
    kind = CLASS[chars]

    def mean(x, of):
        return np.add.reduceat(x.astype(np.float64), begin) / np.maximum(of, 1)

    out[:, 0] = size
    for i in range(5):
        out[:, 1 + i] = mean(kind == i + 1, size)
    pair_in = np.r_[shift[1:] > 0, False]
    out[:, 6] = mean(pair_in & (kind != np.r_[kind[1:], 0]), size - 1)
    owner = np.repeat(np.arange(n), size)
    out[:, 7] = np.bincount(np.unique(owner * 256 + chars) // 256, minlength=n) / np.minimum(size, 32)
    out[:, 8] = mean(np.where(pair_in, background.pairs[chars, np.r_[chars[1:], 0]], 0), size - 1)
    if len(chars) > 3:
        piece_in = np.r_[shift[3:] == shift[:-3] + 3, np.zeros(3, bool)]
        out[:, 9] = mean(piece_in & np.r_[background.pieces[_pieces(chars)], np.zeros(3, bool)], size - 3)
    out[:, 10] = mean(chars == 47, size)
    ahead = np.where(first > lo, data[np.maximum(first - 1, 0)], 32)
    after = np.where(end < hi, data[np.minimum(end, len(data) - 1)], 32)
    out[:, 11] = np.isin(ahead, list(b"./~\\")) | np.isin(after, list(b"\\")) | (chars[begin] == 47)
    out[:, 13] = np.isin(after, list(b"\"'")) + 2 * (after == 64)
    raw = data.tobytes()
    for i, (a, b, c, d) in enumerate(zip(first.tolist(), end.tolist(), lo.tolist(), hi.tolist())):
        before = raw[max(a - 4, c) : a]
        out[i, 12] = b"=" in before or b":" in before
        out[i, 14:16] = neighbours.of(*words_beside(raw, a, b, c, d))
    return out


class Forest:
    """A random forest of binary trees by Gini impurity, kept as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 12, seed: int = 11):
        rng, self.trees = np.random.default_rng(seed), []
        tries = max(1, x.shape[1] // 2)
        for _ in range(trees):
            some = rng.integers(0, len(x), len(x))
            nodes: list[list] = []  # feature, threshold, left, right, share of positives
            self._grow(x[some], y[some], depth, tries, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))

    def _grow(self, x, y, depth, tries, rng, nodes) -> int:
        me, share = len(nodes), float(y.mean()) if len(y) else 0.0
        nodes.append([-1, 0.0, 0, 0, share])
        if depth == 0 or len(y) < 4 or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False).tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            left, right = cut, len(y) - cut
            p, q = t[cut - 1] / left, (t[-1] - t[cut - 1]) / right
            gain = share * (1 - share) - (left * p * (1 - p) + right * q * (1 - q)) / len(y)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] - 1]) / 2))
        if best[1] < 0:
            return me
        side = x[:, best[1]] <= best[2]
        left = self._grow(x[side], y[side], depth - 1, tries, rng, nodes)
        right = self._grow(x[~side], y[~side], depth - 1, tries, rng, nodes)
        nodes[me] = [best[1], best[2], left, right, share]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
            total += share[at]
        return total / len(self.trees)


def synthetic_findings(words: list[str], n: int = 8000, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """(text, start, length, label) in characters; half of them secrets: generated keys, pass words that
    people choose, and the same in places that others stand in too."""
    rnd = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["lorem", "ipsum", "dolor", "amet", "sed", "magna"]
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"

    def some(chars: str, least: int, most: int) -> str:
        return "".join(rnd.choices(chars, k=rnd.randint(least, most)))

    def text(most: int) -> str:
        return " ".join(rnd.choices(words, k=rnd.randint(0, most)))

    def joined(sign: str, least: int, most: int, change=str) -> str:
        return sign.join(change(w) for w in rnd.choices(words, k=rnd.randint(least, most)))

    def assigned(names: str, key: str) -> tuple[str, str]:
        name = rnd.choice(names.split())
        name = rnd.choice([name, name.upper(), name.capitalize(), rnd.choice(words) + rnd.choice("_-. ") + name])
        quote = rnd.choice(["", "", '"', "'"])
        return name + rnd.choice(["=", ":", ": ", " = ", " : "]) + quote, quote

    def chosen() -> str:
        """What people choose: a word or two, some letters replaced, with digits and signs."""
        base = joined("", 1, 2, rnd.choice([str, str.capitalize]))[: rnd.randint(5, 14)]
        base = "".join(rnd.choice(dig + "!@$") if rnd.random() < 0.25 else c for c in base)
        out = base + some(dig, 1, 4) + some("!#$%&*+-.?@^_~", 0, 2)
        return out if rnd.random() < 0.7 else some(low + up + dig + "!#$%&*+-.?@^_~", 8, 16)

    keys = [
        lambda: some(hexa, 16, 64), lambda: some(low + up + dig, 16, 44), lambda: some(low + dig, 16, 40), lambda: some(up + dig, 16, 32), lambda: some(low + up + dig + "+/", 24, 64),
        lambda: some(low + up, 2, 6) + rnd.choice(["", "_", "-"]) + some(rnd.choice([up + dig, low + up + dig]), 16, 40), lambda: some(low, 2, 5) + rnd.choice("_-") + some(dig, 6, 12) + rnd.choice("_-") + some(low + up + dig, 16, 32),
        lambda: some(low + up + dig + "_-", 30, 120),
    ]
    others = [
        lambda: joined("", 4, 9), lambda: joined("", 4, 8, str.capitalize), lambda: joined("_", 3, 8), lambda: joined("-", 3, 8), lambda: joined("/", 3, 8), lambda: some(dig, 16, 24),
        lambda: rnd.choice("xX0-_=*.") * rnd.randint(16, 40), lambda: "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)), lambda: joined("_", 2, 4, str.upper) + some(dig, 0, 3),
    ]
    values = [
        lambda: joined("", 1, 1) + joined("", 1, 1), lambda: joined("-", 1, 3), lambda: joined(".", 2, 3), lambda: ".".join(some(dig, 1, 3) for _ in range(4)), lambda: f"20{some(dig, 2, 2)}-{some(dig, 2, 2)}-{some(dig, 2, 2)}",
        lambda: some(dig, 6, 12), lambda: joined("/", 2, 4), lambda: "https://" + joined(".", 2, 3) + "/" + joined("/", 1, 3), lambda: joined("", 1, 1) + "@" + joined(".", 2, 2), lambda: joined("", 1, 1, str.capitalize) + some(dig, 0, 2),
        lambda: f"{some(dig, 2, 2)}:{some(dig, 2, 2)}:{some(dig, 2, 2)}", lambda: rnd.choice(["${", "%", "$", "<"]) + joined("_", 2, 3, str.upper) + rnd.choice(["}", "%", ""]), lambda: joined("", 1, 1) + "." + rnd.choice("txt json html py csv".split()),
    ]
    secret_names = "password passwd pwd pass passphrase secret token api_key apikey key auth credential credentials private_key access_key bearer login pin"
    other_names = "name host port path file version url link id label date time user mail email note title lang mode type size source ref tag status see index"
    digest_names = "sha256 sha1 md5 commit hash digest checksum etag revision uuid crc"
    out = []
    for i in range(n):
        secret, draw = i % 2, rnd.random()
        ahead = behind = ""
        if secret and draw < 0.6:
            kind = rnd.randrange(len(keys))
            key = keys[kind]()
            if kind == 0 or rnd.random() < 0.35:  # bare, the first kind is a digest
                ahead, behind = assigned(secret_names, key) if rnd.random() < 0.8 else (rnd.choice(["Bearer ", "token ", "key ", "secret is ", "password "]), "")
        elif secret and draw < 0.9:
            key = chosen()
            ahead, behind = assigned(secret_names, key)
        elif secret:
            key = chosen()
            ahead, behind = f"{rnd.choice(words)}://{rnd.choice(words)}:", f"@{joined('.', 2, 3)}/{rnd.choice(words)}"
        elif draw < 0.4:
            key = rnd.choice(others)()
            if rnd.random() < 0.3:
                ahead, behind = assigned(other_names if rnd.random() < 0.7 else secret_names, key)
            elif rnd.random() < 0.2:
                ahead = rnd.choice(["/", "./", "~/", "https://"])
        elif draw < 0.55:
            key = some(hexa, 32, 64)
            ahead, behind = assigned(digest_names, key) if rnd.random() < 0.6 else (rnd.choice(digest_names.split()) + " ", "")
        elif draw < 0.9:
            key = rnd.choice(values)()
            ahead, behind = assigned(other_names if rnd.random() < 0.6 else rnd.choice(words), key)
        else:  # placeholders and references where a secret might stand
            key = rnd.choice([lambda: rnd.choice(["your", "my", "example", "insert", "change", "some", "the"]) + rnd.choice("_-") + rnd.choice(secret_names.split()), lambda: rnd.choice("xX*.") * rnd.randint(6, 16), values[-2], lambda: joined("_", 2, 3), lambda: joined("", 1, 2)])()
            ahead, behind = assigned(secret_names, key)
        lead = text(8) + " " + ahead
        out.append((lead + key + behind + " " + text(6), len(lead), len(key), secret))
    return out


def background(docs: DataFrame, text_col: str = "text", dictionary_size: int = 20_000, least: int = 3) -> tuple[Background, list[str]]:
    """Byte pairs and word counts over all rows; only the pair table and the ``dictionary_size`` most
    frequent words of letters come to the driver. A word that occurs less than ``least`` times, as pieces
    of secrets do, is in no dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        pairs = np.zeros(65536, np.int64)
        kept: dict[int, list] = {}

        def words() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([v[1] for v in kept.values()], pa.binary()), pa.array([v[0] for v in kept.values()], pa.int64())], ["key", "n"])
            kept.clear()
            return out

        for batch in in_parts(batches):
            data, offsets = K.flat(batch.column(0))
            for a, b in K.blocks(offsets, BLOCK):
                part = data[offsets[a] : offsets[b]]
                if len(part) > 1:
                    pairs += np.bincount(part[:-1].astype(np.int64) << 8 | part[1:], minlength=65536)
                letters = np.isin(CLASS[part], (1, 2)) | (part >= 128)
                first = np.flatnonzero(letters & ~np.r_[False, letters[:-1]])
                end = np.flatnonzero(letters & ~np.r_[letters[1:], False]) + 1
                first, end = first[end - first >= 2], end[end - first >= 2]
                low = K._LOWER[part]
                sums, inverse = K.prefix_sums(low), K.powers(len(low) + 1)[1]
                hashes = K.mix((sums[end] - sums[first]) * inverse[first])
                unique, where, n = np.unique(hashes, return_index=True, return_counts=True)
                raw = low.tobytes()
                for h, i, k in zip(unique.tolist(), where.tolist(), n.tolist()):
                    if h in kept:
                        kept[h][0] += k
                    else:
                        kept[h] = [k, raw[first[i] : end[i]]]
            if len(kept) > 100_000:
                yield words()
        yield words()
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([b"\xff" + int(i).to_bytes(2, "big") for i in some], pa.binary()), pa.array(pairs[some])], ["key", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    is_pair = F.substring("key", 1, 1) == F.lit(b"\xff")
    table = counts.filter(is_pair).unionByName(most_frequent(counts.filter(~is_pair), dictionary_size)).collect()
    pairs, words = np.zeros(65536), []
    for key, n in table:
        key = bytes(key)
        if key[:1] == b"\xff":
            pairs[int.from_bytes(key[1:], "big")] = n
        elif n >= least:
            words.append((-n, key))
    words = [w for _, w in sorted(words)]
    return Background(pairs, words), [w.decode("utf-8", "replace") for w in words]


def train(findings: list[tuple[str, int, int, int]], known: Background, **forest) -> tuple[Neighbours, Forest]:
    """Neighbouring words and a forest from labelled findings (text, start, length, label). The forest sees
    each half of the findings with word weights from the other half, so that it doesn't trust them too much."""
    located = []
    for text, start, length, label in findings:
        raw, begin = text.encode(), len(text[:start].encode())
        located.append((raw, begin, begin + len(text[start : start + length].encode()), label))
    beside = [(*words_beside(raw, a, b, 0, len(raw)), label) for raw, a, b, label in located]
    rows = np.zeros((len(located), len(FEATURES)))
    for half in (0, 1):
        weights = Neighbours([f for i, f in enumerate(beside) if i // 2 % 2 != half])
        for i, (raw, a, b, _) in enumerate(located):
            if i // 2 % 2 == half:
                rows[i] = features(np.frombuffer(raw, np.uint8), *(np.array([v]) for v in (a, b, 0, len(raw))), known, weights)[0]
    return Neighbours(beside), Forest(rows, np.array([f[3] for f in located], float), **forest)


_SECRETS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("score", DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, text_col: str = "text", least: int = 16, least_assigned: int = 6, threshold: float = 0.5, findings=None) -> DataFrame:
    """docs and the columns n_candidates, secrets (array of start and length in bytes of UTF-8, and
    score) and redacted (the text with each secret as a mask).

    Whole texts are scanned. A null text has no candidate and stays null. Repeated rows are all returned;
    an empty table gives no rows. Further columns are kept; the three new names replace columns that are
    called so already. ``findings``: labelled findings for training (see train), else synthetic ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_candidates", "secrets", "redacted")
    known, words = background(docs, text_col)
    shipped = spark.sparkContext.broadcast((known, *train(findings or synthetic_findings(words[:5000]), known)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        known, neighbours, forest = shipped.value
        for batch in in_parts(batches):
            texts = batch.column(names.index(text_col))
            data, offsets = K.flat(texts)
            for a, b in K.blocks(offsets, BLOCK):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                first, end, row = candidates(part, at, least, least_assigned)
                scores = forest.predict(features(part, first, end, at[row], at[row + 1], known, neighbours)) if len(first) else np.zeros(0)
                hits: list[list] = [[] for _ in range(b - a)]
                for i in np.flatnonzero(scores >= threshold).tolist():
                    begin = int(at[row[i]])
                    hits[row[i]].append((int(first[i]) - begin, int(end[i]) - begin, float(scores[i])))
                found = [[{"start": x, "length": y - x, "score": z} for x, y, z in merged(h)] for h in hits]
                new = []
                for text, secrets in zip(texts.slice(a, b - a).to_pylist(), found):
                    if secrets:
                        raw, pieces, last = text.encode(), [], 0
                        for s in secrets:
                            pieces += [raw[last : s["start"]], MASK.encode()]
                            last = s["start"] + s["length"]
                        text = b"".join([*pieces, raw[last:]]).decode()
                    new.append(text)
                counts = pa.array(np.bincount(row, minlength=b - a), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), counts, pa.array(found, _ARROW), pa.array(new, pa.string())], [*names, "n_candidates", "secrets", "redacted"])

    schema = StructType([*docs.schema.fields, StructField("n_candidates", LongType()), StructField("secrets", _SECRETS), *StructType().add("redacted", "string").fields])
    return docs.mapInArrow(run, schema)
