"""Stems of words as column expressions: suffix rules with conditions on what is left of the word.

English has Porter's five steps, with the measure of a stem from its pattern of vowels and consonants;
German, Spanish and Italian light rules for endings of inflection; French and Portuguese, plurals and
endings of gender alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as X

#: Porter's rules, in the order in which they are tried, and English words that aren't looked for.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
GERMAN_ST = "[bdfghklmnt]"


def _let(value: Column, function: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _less(word: Column, n: int) -> Column:
    return F.left(word, F.greatest(F.length(word) - n, F.lit(0)))


def pattern(word: Column) -> Column:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    with_y = F.regexp_replace(word, "(?<=(?:^|[aeiou])y|[^aeiouy])y", "i")
    return F.regexp_replace(F.regexp_replace(with_y, "[^aeiou]", "c"), "[aeiou]", "v")


def measure(stem: Column) -> Column:
    """How often vowels are followed by consonants."""
    return F.regexp_count(pattern(stem), F.lit("v+c+"))


def _short(stem: Column) -> Column:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return pattern(stem).endswith("cvc") & ~stem.rlike("[wxy]$")


def _rules(word: Column, rules: Sequence[tuple[str, str]], least: int, also: Callable[[str, Column], Column] = lambda suffix, stem: F.lit(True)) -> Column:
    """The word by the first rule whose suffix it has, if its stem's measure is over ``least``."""
    out = F.when(F.lit(False), word)
    for suffix, new in rules:
        stem = _less(word, len(suffix))
        out = out.when(word.endswith(suffix), F.when((measure(stem) > least) & also(suffix, stem), F.concat(stem, F.lit(new))).otherwise(word))
    return out.otherwise(word)


def english(word: Column) -> Column:
    """Porter's stem of a lower-case word; words of two letters stay."""
    has_vowel = lambda stem: F.contains(pattern(stem), F.lit("v"))

    def one_a(w: Column) -> Column:
        return F.when(w.endswith("sses") | w.endswith("ies"), _less(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _less(w, 1)).otherwise(w)

    def after(s: Column) -> Column:
        double = s.rlike(r"([^aeiou])\1$") & pattern(s).endswith("cc") & ~s.rlike("[lsz]$")
        return F.when(s.rlike("(?:at|bl|iz)$"), F.concat(s, F.lit("e"))).when(double, _less(s, 1)).when((measure(s) == 1) & _short(s), F.concat(s, F.lit("e"))).otherwise(s)

    def one_b(w: Column) -> Column:
        cut = F.when(w.endswith("ed") & has_vowel(_less(w, 2)), _less(w, 2)).when(w.endswith("ing") & has_vowel(_less(w, 3)), _less(w, 3))
        return F.when(w.endswith("eed"), F.when(measure(_less(w, 3)) > 0, _less(w, 1)).otherwise(w)).otherwise(_let(cut, lambda s: F.when(s.isNull(), w).otherwise(after(s))))

    def one_c(w: Column) -> Column:
        return F.when(w.endswith("y") & has_vowel(_less(w, 1)), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)

    def four(w: Column) -> Column:
        return _rules(w, [(s, "") for s in STEP_4], 1, lambda suffix, stem: stem.rlike("[st]$") if suffix == "ion" else F.lit(True))

    def five(w: Column) -> Column:
        stem = _less(w, 1)
        cut = F.when(w.endswith("e") & ((measure(stem) > 1) | ((measure(stem) == 1) & ~_short(stem))), stem).otherwise(w)
        return _let(cut, lambda x: F.when(x.endswith("ll") & (measure(x) > 1), _less(x, 1)).otherwise(x))

    out = word
    for step in (one_a, one_b, one_c, lambda w: _rules(w, STEP_2, 0), lambda w: _rules(w, STEP_3, 0), four, five):
        out = _let(out, step)
    return F.when(F.length(word) <= 2, word).otherwise(out)


def german(word: Column) -> Column:
    """Umlauts and accents go, then endings of cases and numbers, then of comparison."""
    plain = F.translate(word, "äàáâöòóôïìíîüùúû", "aaaaooooiiiiuuuu")

    def first(w: Column) -> Column:
        n = F.length(w)
        return F.when((n > 5) & w.endswith("ern"), _less(w, 3)).when((n > 4) & w.rlike("e[mnrs]$"), _less(w, 2)).when((n > 3) & w.endswith("e"), _less(w, 1)).when((n > 3) & w.rlike(f"{GERMAN_ST}s$"), _less(w, 1)).otherwise(w)

    def second(w: Column) -> Column:
        n = F.length(w)
        return F.when((n > 5) & w.endswith("est"), _less(w, 3)).when((n > 4) & w.rlike("e[rn]$"), _less(w, 2)).when((n > 4) & w.rlike(f"{GERMAN_ST}t$"), _less(w, 1)).otherwise(w)

    return _let(_let(plain, first), second)


def spanish(word: Column) -> Column:
    def ending(w: Column) -> Column:
        plural = F.when(w.endswith("eses"), _less(w, 2)).when(w.endswith("ces"), F.concat(_less(w, 3), F.lit("z"))).when(w.rlike("[oae]s$"), _less(w, 2)).otherwise(w)
        return F.when(w.rlike("[oae]$"), _less(w, 1)).when(w.endswith("s"), plural).otherwise(w)

    return F.when(F.length(word) < 5, word).otherwise(_let(F.translate(word, "àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"), ending))


def italian(word: Column) -> Column:
    def ending(w: Column) -> Column:
        return F.when(w.rlike("(?:[ih][ei]|i[ao])$"), _less(w, 2)).when(w.rlike("[eiao]$"), _less(w, 1)).otherwise(w)

    return F.when(F.length(word) < 6, word).otherwise(_let(F.translate(word, "àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"), ending))


def french(word: Column) -> Column:
    """Plurals, then r, e and é at the end, then one of two equal letters."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "s$", ""), "r$", ""), "e$", ""), "é$", "")
    plural = F.when(word.endswith("aux"), F.concat(_less(word, 2), F.lit("l"))).otherwise(_less(word, 1))
    return F.when(F.length(word) < 6, word).when(word.endswith("x"), plural).otherwise(F.regexp_replace(bare, r"(.)\1$", "$1"))


def portuguese(word: Column) -> Column:
    """Plurals alone."""
    out = F.when(word.endswith("ns"), F.concat(_less(word, 2), F.lit("m"))).when(word.endswith("ões") | word.endswith("ães"), F.concat(_less(word, 3), F.lit("ão"))).when(word.rlike("[aeou]is$"), F.concat(_less(word, 2), F.lit("l")))
    return F.when(F.length(word) < 4, word).otherwise(out.when(word.rlike("(?:[rz])es$"), _less(word, 2)).when(word.endswith("s") & ~word.endswith("ss"), _less(word, 1)).otherwise(word))


LANGUAGES = {"en": english, "de": german, "fr": french, "es": spanish, "it": italian, "pt": portuguese}


ANALYSERS = ("cjk", "standard", *LANGUAGES)


def words(text: Column, analyser: Column) -> Column:
    """What an analyser (gleaner.functions.text.analyser) finds in a text before stems: pairs of CJK characters and
    words in other scripts, or words; in English none that aren't looked for."""
    plain = X.terms(text)
    cjk = F.concat(X.bigrams(text), F.filter(plain, lambda w: ~w.rlike(X.CJK)))
    en = F.filter(X.terms(F.regexp_replace(text, "['’]s(?![\\p{L}\\p{N}])", "")), lambda w: ~w.isin(STOP))
    return F.when(analyser == "cjk", cjk).when(analyser == "en", en).otherwise(plain)


def stem(word: Column, analyser: Column) -> Column:
    """A word's stem for a Latin language's analyser; for others the word."""
    out = F.when(F.lit(False), word)
    for name, function in LANGUAGES.items():
        out = out.when(analyser == name, function(word))
    return out.otherwise(word)


def analysed(text: Column, analyser: Column) -> Column:
    """The terms of a text for an analyser: stems of a Latin language, pairs of CJK characters and words in other
    scripts, or plain words."""
    return F.transform(words(text, analyser), lambda w: stem(w, analyser))
