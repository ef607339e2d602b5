"""Lexicon sentiment (F1) and the Arrow plug-in point for a library analyzer.

The compound score follows the published VADER method (MIT licence). A text is
cut at white space and punctuation is stripped from words of three letters or
more. Each word of the lexicon has a valence, which its surroundings change:

* a word in capitals counts more where the text has others that are not;
* boosters in the three words before it raise or lower it, less the farther
  they stand, more in capitals; two- and three-word boosters count too;
* a negator in those words turns it, "never so" and "never this" stress it,
  "without doubt" leaves it; "least" turns it but for "at least", "very least";
* "no" before a word of the lexicon has no valence and turns that word;
* idioms of two and three words have a valence of their own.

Words before the first "but" then count half, words after it half more;
exclamation and question marks add to the sum, which is squashed into -1..1
with ``s / sqrt(s*s + 15)``. Text without a lexicon word scores 0.0.

Two forms, one rule:

* :func:`sentiment`, a column expression for a word list given in code: hash
  lookups find the words of the lexicon and only their surroundings are
  looked at, in the task that reads the row (no shuffle, no Python);
* :func:`sentiment_join` for a lexicon that is a table: each text's different
  words are joined to it, and the same expression reads the words found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import col_of

# ----------------------------------------------------------------- fixed values
# Fixed test lexicon (word -> valence on the -4..4 scale). The text in the
# supplied tables is invented, so the list holds common English opinion
# words and the ones that occur in it.
LEXICON = {
    "good": 1.9, "great": 3.1, "best": 3.2, "excellent": 2.7, "amazing": 2.8,
    "awesome": 3.1, "brilliant": 2.8, "wonderful": 2.7, "fantastic": 2.6,
    "perfect": 2.7, "love": 3.2, "loved": 2.9, "like": 1.5, "liked": 1.8,
    "enjoy": 2.2, "enjoyed": 2.3, "fun": 2.3, "funny": 1.9, "beautiful": 2.9,
    "nice": 1.8, "happy": 2.7, "glad": 2.0, "win": 2.8, "hope": 1.9,
    "masterpiece": 3.1, "thanks": 1.9, "cool": 1.3, "free": 2.3, "safe": 1.9,
    "bad": -2.5, "worst": -3.1, "terrible": -2.1, "awful": -2.0, "horrible": -2.5,
    "hate": -2.7, "hated": -3.2, "boring": -1.3, "dull": -1.7, "poor": -2.1,
    "sad": -2.1, "angry": -2.3, "fail": -2.5, "failure": -2.3, "mess": -1.5,
    "waste": -1.8, "wasted": -2.2, "garbage": -2.1, "trash": -1.8, "stupid": -2.4,
    "idiot": -2.3, "moron": -2.2, "worthless": -1.9, "ugly": -2.3, "disappointing": -2.2,
    "disappointed": -1.9, "scam": -2.6, "fake": -2.1, "kill": -3.7, "dead": -3.3,
    "no": -1.2, "kind": 2.4, "pretty": 2.2, "doubt": -1.5,
}
# every other word that contains "n't" negates as well
NEGATORS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "uh-uh", "wasnt", "werent", "without", "wont", "wouldnt", "rarely",
    "seldom", "despite")
RAISERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "effing",
    "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely",
    "fabulously", "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully",
    "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible", "incredibly",
    "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually",
    "utter", "utterly", "very")
LOWERERS = (
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less", "little", "marginal",
    "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat",
    "sort of", "sorta", "sortof", "sort-of")
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9}
BOOST = 0.293
CAPITALS = 0.733
DECAY = (1.0, 0.95, 0.9)
NEGATION_FACTOR = -0.74
NEVER_SO = 1.25
BUT = (0.5, 1.5)
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MOST_QUESTIONS = 0.18, 0.96
ALPHA = 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_PATTERN = r"[^ \t\n\r\f\x0B]+"
# ------------------------------------------------------------------------------

BOOSTERS = {w: BOOST for w in RAISERS} | {w: -BOOST for w in LOWERERS}


def straight(text: Column) -> Column:
    """Typographic apostrophes as plain ones, null as ''."""
    return F.translate(F.coalesce(text, F.lit("")), "\u2019", "'")


def words(text: Column) -> Column:
    """The words of a text in their own case; short tokens keep their punctuation."""
    def stripped(w):
        bare = F.btrim(w, F.lit(PUNCTUATION))
        return F.when(F.length(bare) > 2, bare).otherwise(w)

    return F.transform(F.regexp_extract_all(straight(text), F.lit(WORD_PATTERN), 0), stripped)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(values: Mapping[str, float]) -> Column:
    """A literal map, written as one string so that plans stay small; the optimizer folds it."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{float(v)!r}" for k, v in values.items())), F.lit("\n"), F.lit("\t"))


def _value(words: Column, word: Column) -> Column:
    return F.try_element_at(words, word).cast("double")


def _is_one_of(word: Column, values) -> Column:
    return F.array_contains(F.split(F.lit("\n".join(values)), "\n"), word)


def _is_capital(word: Column) -> Column:
    return F.coalesce(word.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"), F.lit(False))


def _negates(word: Column) -> Column:
    return F.coalesce(_is_one_of(word, NEGATORS) | word.contains("n't"), F.lit(False))


def _valence(raw: Column, low: Column, i: Column, mixed: Column, known, value) -> Column:
    """Valence of the word at ``i`` of a text in its surroundings, without "but" and punctuation."""
    def at(k):
        return F.get(low, i + k)

    def sign(v):
        return F.when(v > 0, CAPITALS).otherwise(-CAPITALS)

    def capital(k):
        return mixed & _is_capital(F.get(raw, i + k))

    def boosted(v, k):
        b = _value(_map(BOOSTERS), at(k))
        s = F.when(v < 0, -b).otherwise(b) + F.when(capital(k), sign(v)).otherwise(0.0)
        return v + F.coalesce(s * DECAY[-k - 1], F.lit(0.0))

    def so(k):
        return at(k).isin("so", "this")

    def negated(v, k):
        turned = F.when(_negates(at(k)), v * NEGATION_FACTOR).otherwise(v)
        if k == -1:
            return turned
        near = (so(-1), at(-1) == "doubt") if k == -2 else (so(-2) | so(-1), (at(-2) == "doubt") | (at(-1) == "doubt"))
        return F.when((at(k) == "never") & near[0], v * NEVER_SO).when((at(k) == "without") & near[1], v).otherwise(turned)

    def phrase(a, b):
        return F.concat_ws(" ", *[at(k) for k in range(a, b + 1)])

    def idioms(v):
        # the first phrase that ends at or before the word, then those that go on after it
        idiom = _map(IDIOMS)
        for a, b in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)):
            found = _value(idiom, phrase(a, b))
            before = found if a == -1 else F.coalesce(before, found)
        after = F.coalesce(F.when(at(2).isNotNull(), _value(idiom, phrase(0, 2))),
                           F.when(at(1).isNotNull(), _value(idiom, phrase(0, 1))))
        v = F.coalesce(after, before, v)
        for a, b in ((-3, -1), (-3, -2), (-2, -1)):
            v = v + F.coalesce(_value(_map(BOOSTERS), phrase(a, b)), F.lit(0.0))
        return v

    def seen(v, k):
        free = at(k).isNotNull() & ~known(at(k))
        inner = _let(boosted(v, k), lambda x: negated(x, k))
        if k == -3:
            inner = _let(inner, idioms)
        return F.when(free, inner).otherwise(v)

    def least(v):
        turned = (at(-1) == "least") & ~known(at(-1)) & ~F.coalesce(at(-2).isin("at", "very"), F.lit(False))
        return F.when(turned, v * NEGATION_FACTOR).otherwise(v)

    own = value(at(0))
    after_no = (at(-1) == "no") | (at(-2) == "no") | ((at(-3) == "no") & at(-1).isin("or", "nor"))
    start = F.when(after_no, own * NEGATION_FACTOR).when(
        (at(0) == "no") & at(1).isNotNull() & known(at(1)), 0.0).otherwise(own)
    shouted = F.when(capital(0), start + sign(start)).otherwise(start)
    steps = [lambda v: seen(v, -1), lambda v: seen(v, -2), lambda v: seen(v, -3), least]
    for f in steps:
        shouted = _let(shouted, f)
    return shouted


def _compound(text: Column, listed: Callable[[Column], Column], lex: Column) -> Column:
    """The rule of the module for a lexicon given as a map; ``listed`` is a fast test of membership."""
    def known(w):
        return F.coalesce(F.map_contains_key(lex, w), F.lit(False))

    def value(w):
        return _value(lex, w)

    def hit(low):
        def counts(i):
            w = F.get(low, i)
            return listed(w) & ~_is_one_of(w, BOOSTERS) & ~((w == "kind") & F.coalesce(F.get(low, i + 1) == "of", F.lit(False)))

        return F.when(F.size(low) > 0, F.filter(F.sequence(F.lit(0), F.size(low) - 1), counts)).otherwise(
            F.array().cast("array<int>"))

    def scored(raw, low, hits):
        mixed = F.exists(raw, _is_capital) & F.exists(raw, lambda w: ~_is_capital(w))
        but = F.array_position(low, "but").cast("int") - 1

        def total(mixed):
            def weighed(acc, i):
                v = _valence(raw, low, i, mixed, known, value)
                return acc + v * F.when((but >= 0) & (i < but), BUT[0]).when((but >= 0) & (i > but), BUT[1]).otherwise(1.0)

            return F.aggregate(hits, F.lit(0.0), weighed)

        return F.when(F.size(hits) > 0, _let(mixed, total)).otherwise(0.0)

    def count(mark):
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    marks = F.least(count("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + F.when(count("?") > 3, MOST_QUESTIONS).when(
        count("?") > 1, count("?") * QUESTION).otherwise(0.0)
    total = _let(words(text), lambda raw: _let(F.transform(raw, F.lower), lambda low: _let(
        hit(low), lambda hits: scored(raw, low, hits))))
    return F.coalesce(_let(total, lambda s: normalize(
        F.when(s > 0, s + marks).when(s < 0, s - marks).otherwise(s))), F.lit(0.0))


def normalize(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + ALPHA), 4)


def sentiment(text, lexicon: Mapping[str, float] = LEXICON) -> Column:
    """Compound sentiment in -1..1 as a pure column expression."""
    return _compound(col_of(text), lambda w: F.coalesce(w.isin(*lexicon), F.lit(False)), _map(lexicon))


def sentiment_join(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                   out: str = "sentiment") -> DataFrame:
    """F1 for a lexicon table of any size (``token``, ``valence``; a token once).

    Each text's different words meet the lexicon in one join; those found, at
    most the text's own words, come back to it by ``id_col``, which names a row.
    """
    seen = df.select(id_col, F.explode(F.array_distinct(F.transform(words(F.col(text_col)), F.lower))).alias("token"))
    found = seen.join(lexicon.select("token", "valence"), "token").groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("token", F.col("valence").cast("double")))).alias("__lex"))
    lex = F.col("__lex")
    score = _compound(F.col(text_col), lambda w: F.map_contains_key(lex, w), lex)
    return df.join(found, id_col, "left").withColumn(
        out, F.when(lex.isNull(), 0.0).otherwise(score)).drop("__lex")


def sentiment_udf(analyzer_factory: Callable[[], Callable[[str], float]]):
    """X1 plug-in: score text with a library analyzer, batched through Arrow.

    ``analyzer_factory`` is called once per Python worker (cached), not per
    row; it returns ``text -> compound``. Use only when the lexicon method
    above is not acceptable - it leaves whole-stage code generation.
    """
    cache: dict = {}

    @F.pandas_udf("double")
    def _score(s: pd.Series) -> pd.Series:
        fn = cache.get("fn")
        if fn is None:
            fn = cache["fn"] = analyzer_factory()
        return s.map(lambda t: float(fn(t)) if t else 0.0)

    return _score


def compound_reference(text: str | None, lexicon: Mapping[str, float] = LEXICON) -> float:
    """Plain-Python statement of the same rule, for tests."""
    import regex

    text = (text or "").replace("\u2019", "'")
    raw = [w.strip(PUNCTUATION) if len(w.strip(PUNCTUATION)) > 2 else w for w in regex.findall(WORD_PATTERN, text)]
    low = [w.lower() for w in raw]

    def capital(w):
        return bool(regex.search(r"\p{Lu}", w)) and not regex.search(r"\p{Ll}", w)

    mixed = any(map(capital, raw)) and not all(map(capital, raw))

    def word(k):
        return low[k] if 0 <= k < len(low) else None

    def phrase(a, b):
        return " ".join(low[max(0, a):b + 1])

    def negates(w):
        return w in NEGATORS or "n't" in w

    def push(v):
        return CAPITALS if v > 0 else -CAPITALS

    total = 0.0
    but = low.index("but") if "but" in low else None
    for i, w in enumerate(low):
        if w not in lexicon or w in BOOSTERS or (w == "kind" and word(i + 1) == "of"):
            continue
        v = lexicon[w]
        if w == "no" and word(i + 1) in lexicon:
            v = 0.0
        if word(i - 1) == "no" or word(i - 2) == "no" or (word(i - 3) == "no" and word(i - 1) in ("or", "nor")):
            v = lexicon[w] * NEGATION_FACTOR
        if mixed and capital(raw[i]):
            v += push(v)
        for k in (1, 2, 3):
            p = word(i - k)
            if p is None or p in lexicon:
                continue
            if p in BOOSTERS:
                b = -BOOSTERS[p] if v < 0 else BOOSTERS[p]
                if mixed and capital(raw[i - k]):
                    b += push(v)
                v += b * DECAY[k - 1]
            between = [word(i - j) for j in range(1, k)]
            if p == "never" and {"so", "this"} & set(between):
                v *= NEVER_SO
            elif p == "without" and "doubt" in between:
                pass
            elif negates(p):
                v *= NEGATION_FACTOR
            if k == 3:
                before = [phrase(i - 1, i), phrase(i - 2, i), phrase(i - 2, i - 1), phrase(i - 3, i - 1), phrase(i - 3, i - 2)]
                after = ([phrase(i, i + 2)] if word(i + 2) is not None else []) + ([phrase(i, i + 1)] if word(i + 1) is not None else [])
                v = next((IDIOMS[x] for x in after + before if x in IDIOMS), v)
                v += sum(BOOSTERS.get(x, 0.0) for x in (phrase(i - 3, i - 1), phrase(i - 3, i - 2), phrase(i - 2, i - 1)))
        if word(i - 1) == "least" and "least" not in lexicon and word(i - 2) not in ("at", "very"):
            v *= NEGATION_FACTOR
        total += v * (1.0 if but is None or i == but else BUT[0] if i < but else BUT[1])
    q = text.count("?")
    marks = min(text.count("!"), MOST_EXCLAMATIONS) * EXCLAMATION + (MOST_QUESTIONS if q > 3 else q * QUESTION if q > 1 else 0.0)
    total += marks if total > 0 else -marks if total < 0 else 0.0
    return round(total / math.sqrt(total * total + ALPHA), 4)
