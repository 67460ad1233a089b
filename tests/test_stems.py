"""Stems against plain versions of their rules, and lines of a page ranked by them."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import stems as S
from gleaner.operators import retrieval as R


class Porter:
    """The five steps on a string, letter by letter."""

    def consonant(self, w, i):
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not self.consonant(w, i - 1))

    def measure(self, w):
        kinds = [self.consonant(w, i) for i in range(len(w))]
        return sum(a is False and b for a, b in zip(kinds, kinds[1:]))

    def vowel(self, w):
        return any(not self.consonant(w, i) for i in range(len(w)))

    def cvc(self, w):
        return len(w) > 2 and self.consonant(w, len(w) - 1) and not self.consonant(w, len(w) - 2) and self.consonant(w, len(w) - 3) and w[-1] not in "wxy"

    def double(self, w):
        return len(w) > 1 and w[-1] == w[-2] and self.consonant(w, len(w) - 1)

    def by(self, w, rules, least):
        for suffix, new in rules:
            if w.endswith(suffix):
                stem = w[: len(w) - len(suffix)]
                ok = self.measure(stem) > least and (suffix != "ion" or stem[-1:] in ("s", "t"))
                return stem + new if ok else w
        return w

    def __call__(self, w):
        if len(w) <= 2:
            return w
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for e in ("ed", "ing"):
                if w.endswith(e) and self.vowel(w[: -len(e)]):
                    w = w[: -len(e)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self.double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self.by(w, S.STEP_2, 0)
        w = self.by(w, S.STEP_3, 0)
        w = self.by(w, [(s, "") for s in S.STEP_4], 1)
        if w.endswith("e") and (self.measure(w[:-1]) > 1 or self.measure(w[:-1]) == 1 and not self.cvc(w[:-1])):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.measure(w) > 1 else w


KNOWN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "roll": "roll", "rate": "rate",
}


def test_english(spark):
    rnd, porter = random.Random(2), Porter()
    endings = [s for s, _ in (*S.STEP_2, *S.STEP_3)] + S.STEP_4 + ["ed", "ing", "s", "sses", "ies", "eed", "y", "e", "ll", ""]
    words = [*KNOWN, *("".join(rnd.choices("aeioubcdlmnrstyz", k=rnd.randint(0, 6))) + rnd.choice(endings) for _ in range(3000))]
    words = [w for w in words if "yyy" not in w]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", S.english(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in KNOWN} == KNOWN
    for w in words:
        assert got[w] == porter(w), w


@pytest.mark.parametrize(
    ("language", "pairs"),
    [
        ("de", {"häuser": "haus", "kindern": "kind", "schönsten": "schonst", "tages": "tag", "autos": "autos", "hunde": "hund", "ei": "ei", "lachst": "lachst", "trinkt": "trink"}),
        ("es", {"casas": "cas", "luces": "luz", "intereses": "interes", "canción": "cancion", "amigo": "amig", "sol": "sol"}),
        ("it", {"amiche": "amic", "ragazzi": "ragazz", "famiglia": "famigl", "casa": "casa", "perché": "perc", "studio": "stud"}),
        ("fr", {"chevaux": "cheval", "maisons": "maison", "bateaux": "bateal", "parler": "parl", "belle": "belle", "grande": "grand", "chanteuse": "chanteus"}),
        ("pt", {"homens": "homem", "ações": "ação", "animais": "animal", "flores": "flor", "livros": "livro", "mas": "mas"}),
    ],
)
def test_other_languages(spark, language, pairs):
    df = spark.createDataFrame([(w,) for w in pairs], "w string")
    assert {r.w: r.s for r in df.select("w", S.LANGUAGES[language](F.col("w")).alias("s")).collect()} == pairs


def plain_lines(text, keywords, analyse):
    lines = text.split("\n")
    terms = {i: t for i, line in enumerate(lines) if line.strip() and (t := analyse(line))}
    out = []
    mean = sum(map(len, terms.values())) / max(len(terms), 1)
    for k in keywords:
        scores = {}
        for q in analyse(k):
            df = sum(q in t for t in terms.values())
            for i, t in terms.items():
                if tf := t.count(q):
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5], 1):
            around = " ".join(x.strip() for x in lines[max(i - 1, 0) : i + 2])
            out.append((k, rank, i, lines[i], f"...{around[:120]}..." if len(around) > 120 else around, round(s, 9)))
    return out


def test_stemmed_lines(spark):
    rnd, porter = random.Random(9), Porter()
    some = ["running", "runs", "runner", "the", "cats", "cat's", "relational", "relate", "prices", "pricing", "and", "of", "houses"]
    pages = [(n, "\n".join(" ".join(rnd.choices(some, k=rnd.randint(0, 9))) for _ in range(rnd.randint(1, 25)))) for n in range(30)]
    keywords = ["run", "Cats and relations", "price", "the", "house houses", "absent"]

    def analyse(text):
        return [porter(w) for w in "".join(c if c.isalnum() else " " for c in text.lower().replace("'s", "")).split() if w not in S.STOP]

    got = {}
    for r in R.stemmed_lines(spark.createDataFrame(pages, "page int, text string").repartition(3), "page", "text", keywords).collect():
        got.setdefault(r.page, []).append((r.keyword, r["rank"], r.line_no, r.line, r.context, round(r.score, 9)))
    for n, text in pages:
        want = plain_lines(text, keywords, analyse)
        mine = sorted(got.get(n, []), key=lambda x: (keywords.index(x[0]), x[1]))
        assert [x[:5] for x in mine] == [x[:5] for x in want]
        assert all(abs(a[5] - b[5]) < 1e-8 for a, b in zip(mine, want))


def test_lines_of_other_scripts(spark):
    pages = [(1, "東京大学の学生\n大学は東京にある\n何もない"), (2, "Москва большой город\nгород Москва"), (3, None), (4, "")]
    got = [(r.page, r.keyword, r.line_no) for r in R.stemmed_lines(spark.createDataFrame(pages, "page int, text string"), "page", "text", ["大学", "город"]).collect()]
    assert Counter(got) == Counter([(1, "大学", 0), (1, "大学", 1), (2, "город", 0), (2, "город", 1)])


def test_words_are_stemmed_once(spark):
    """Porter's rules are worked out for keywords and for distinct words alone, never for each word of each line."""
    pages = spark.createDataFrame([(1, "the cats ran\nrelational cats")], "page int, text string")
    plan = R.stemmed_lines(pages, "page", "text", ["cat"])._jdf.queryExecution().optimizedPlan().toString().split("\n")
    stemming = [i for i, line in enumerate(plan) if "ational" in line]
    assert stemming and all("Generate explode(" in plan[i] for i in stemming)
    assert any("Generate explode(array(" in plan[i] and "Aggregate [analyser" in "".join(plan[i + 1 : i + 3]) for i in stemming)
