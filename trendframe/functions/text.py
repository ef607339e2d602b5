"""Text column functions.

All functions return Spark ``Column`` expressions built from built-in
functions (regex, array and higher-order functions), so they run inside
whole-stage code generation with no Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, constant, lit_array, try_cast

# ----------------------------------------------------------------- fixed values
# Fixed values that must equal the reference's for identical results, kept
# together in their natural order.

# Subreddit name (lower case) -> title it stands for.
SUBREDDIT_TITLES = {
    "strangerthings": "Stranger Things",
    "netflix": "Netflix",
    "marvelstudios": "Marvel",
    "dc_cinematic": "DC",
    "thelastofus": "The Last of Us",
    "gameofthrones": "Game of Thrones",
    "houseofthedragon": "House of the Dragon",
    "wandavision": "WandaVision",
    "themandalorian": "The Mandalorian",
    "starwars": "Star Wars",
}

# Capitalised words that are not titles (compared case-sensitively).
MENTION_STOP_WORDS = (
    "I", "A", "The", "It", "This", "That", "What", "Who", "When", "Where",
    "Why", "How", "My", "Your", "He", "She", "They", "We", "Is", "Are",
    "Was", "Were", "Been", "Being", "Have", "Has", "Had", "Do", "Does",
    "Did", "Will", "Would", "Could", "Should", "May", "Might", "Must",
    "Original", "Terrible", "Great", "Good", "Bad", "Best", "Worst",
    "First", "Last", "New", "Old", "People", "Saw", "Just", "Really",
    "Actually", "Probably", "Maybe", "Definitely", "Absolutely",
    "OP", "Commenters", "Edit", "Update", "Spoilers", "Spoiler",
    "Discussion", "Official", "Thread", "Post", "Reddit", "Sub",
    "One", "Two", "Three", "Realistically", "Honestly", "Seriously",
    "Vampire:", "Night", "Netflix", "Whatever", "Slackers.", "Super",
)

# Question fillers removed, in this order, to find the title in a question.
TITLE_FILLERS = (
    r"^what\s+(?:do\s+|did\s+|are\s+)?people\s+(?:think|say|saying)\s+about\s+(?:the\s+)?",
    r"^what\s+(?:is|are|was)\s+(?:the\s+)?consensus\s+(?:on|about)\s+(?:the\s+)?",
    r"^tell\s+me\s+about\s+(?:the\s+)?",
    r"^give\s+me\s+(?:the\s+)?reviews?\s+(?:of|for|on)\s+(?:the\s+)?",
    r"\b(?:the\s+)?(?:lead\s+)?actor(?:'?s)?\s+performance\s+in\s+(?:the\s+)?",
    r"\bperformance\s+(?:in|of)\s+(?:the\s+)?",
    r"\b(?:the\s+)?(?:movie|film|show|series|serie)\b",
    r"\b(?:netflix|hbo|disney\+|amazon\s+prime|streaming)\b",
    r"\bfrom\s+(?:the\s+)?last\s+\d+\s+hours?\b",
    r"\bbased\s+on\s+reviews?\b",
    r"\?+$",
)

# Sequel markers that trigger sequel variants, and the end-anchored strip.
SEQUEL_MARKERS = (" 2", " part 2", " part two", " ii", " part ii")
SEQUEL_SUFFIX = r"\s*(?:2|part\s+(?:2|two|ii)|ii)\s*$"
SEQUEL_FORMS = ("{b}", "{b} 2", "{b} part 2", "{b} part two", "{b}: part two", "{b} ii")

# Index filter: excluded authors (lower case) and boilerplate phrases.
INDEX_EXCLUDED_AUTHORS = ("automoderator", "[deleted]", "bot", "moderator")
INDEX_BOILERPLATE = ("please make sure there are no spoilers", "this post has been removed")

MENTION_STRIP = ".,!?;:"
TITLE_STRIP = ".,!?;:\"'"

# --------------------------------------------------------------------------- F4

# A run of whitespace-separated words that each start with an upper-case
# letter; the look-behind anchors the run at a word start. Possessive, as no
# shorter match is ever wanted: Java's regex then needs no stack frame a word.
_MENTION_RUN = r"(?<!\S)\p{Lu}\S*+(?:\s++\p{Lu}\S*+)*+"


def _strip_chars(c: Column, chars: str) -> Column:
    cls = "[" + "".join("\\" + ch for ch in chars) + "]"
    return F.regexp_replace(c, f"^{cls}+|{cls}+$", "")


def extract_mentions(text) -> Column:
    """capitalised word runs, joined by one space, ``.,!?;:`` stripped."""
    runs = F.regexp_extract_all(F.coalesce(col_of(text), F.lit("")), F.lit(_MENTION_RUN), 0)
    return F.transform(F.transform(runs, lambda r: F.regexp_replace(r, r"\s+", " ")),
                       lambda r: _strip_chars(r, MENTION_STRIP))


# ------------------------------------------------------------------------ F5/F6

def clean_mentions(mentions, stop_words: Sequence[str] = MENTION_STOP_WORDS) -> Column:
    """cleaned mentions that can be titles (stop words, <= 3 chars, ``:`` out)."""
    stop = constant(("stop", tuple(stop_words)), lambda: lit_array(stop_words))
    cleaned = F.transform(F.coalesce(col_of(mentions), F.array().cast("array<string>")),
                          lambda m: _strip_chars(m, TITLE_STRIP))
    return F.filter(cleaned, lambda m: ~F.array_contains(stop, m) & (F.length(m) > 3)
                    & ~m.endswith(":"))


def map_values(col, mapping: Mapping[str, str]) -> Column:
    """Look a value up in a small fixed map (NULL when absent)."""
    m = constant(("map", tuple(mapping.items())),
                 lambda: F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]))
    return F.try_element_at(m, col_of(col))


def attribute_title(source="source", movie_title="movie_title", subreddit="subreddit",
                    mentions="movie_mentions", mapping: Mapping[str, str] = SUBREDDIT_TITLES,
                    stop_words: Sequence[str] = MENTION_STOP_WORDS) -> Column:
    """the title a text is about.

    Priority: a review's own title (``Unknown`` if missing); the title of a
    mapped subreddit; the first mention that survives :func:`clean_mentions`;
    ``general``.
    """
    own = F.when(col_of(source) == "tmdb", F.coalesce(col_of(movie_title), F.lit("Unknown")))
    mapped = map_values(F.lower(F.coalesce(col_of(subreddit), F.lit(""))), mapping)
    first = F.try_element_at(clean_mentions(mentions, stop_words), F.lit(1))
    return F.coalesce(own, mapped, first, F.lit("general"))


def doc_id(*cols, content=None) -> Column:
    """first non-empty id; else a content hash (stable under retries)."""
    ids = [F.nullif(col_of(c), F.lit("")) for c in cols]
    if content is not None:
        ids.append(F.sha2(F.coalesce(col_of(content), F.lit("")), 256))
    return F.coalesce(*ids)


# ------------------------------------------------------------------------- F10

def extract_title(query) -> Column:
    """the title inside a question, or NULL if fewer than 3 chars remain."""
    t = F.lower(F.trim(col_of(query)))
    for pat in TITLE_FILLERS:
        t = F.regexp_replace(t, pat, "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) >= 3, t)


# ------------------------------------------------------------------------- F11

def title_variants(title) -> Column:
    """spellings of a title to look for literally (order kept, no repeats)."""
    t = F.lower(F.trim(col_of(title)))
    has_sequel = F.lit(False)
    for mk in SEQUEL_MARKERS:
        has_sequel = has_sequel | t.contains(mk)
    base = F.trim(F.regexp_replace(t, SEQUEL_SUFFIX, ""))
    sequel = F.when(has_sequel & (base != ""),
                    F.array(*[F.replace(F.lit(f), F.lit("{b}"), base) for f in SEQUEL_FORMS]))
    parts = F.split(t, r"\s+season\s+")
    sb, sn = F.trim(F.element_at(parts, 1)), F.trim(F.element_at(parts, 2))
    season = F.when(t.contains("season") & (F.size(parts) == 2),
                    F.array(sb, F.concat(sb, F.lit(" season "), sn), F.concat(sb, F.lit(" s"), sn)))
    fb = F.trim(F.element_at(F.split(t, r":|(?:\s+(?:and|the|of)\s+)"), 1))
    franchise = F.when((t.contains(":") | t.contains(" and ")) & (F.length(fb) > 3), F.array(fb))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(t), F.coalesce(sequel, empty),
                                     F.coalesce(season, empty), F.coalesce(franchise, empty)))


def match_any(text, variants, lowered: bool = False) -> Column:
    """Does the lower-cased text contain any of the variants? ``lowered``: the text is in lower case already."""
    low = col_of(text) if lowered else F.lower(col_of(text))
    return F.exists(col_of(variants), lambda v: low.contains(v))


# ------------------------------------------------------------------------- F12

def _csv_head(c, n: int | None) -> Column:
    arr = F.split(c, ",")
    arr = F.slice(arr, 1, n) if n else arr
    return F.when((c.isNotNull()) & (c != ""), arr).otherwise(F.array().cast("array<string>"))


def expand_query(query, cast="cast", genres="genres", keywords="keywords") -> Column:
    """question + top 3 cast + all genres + top 3 keywords, space-joined."""
    parts = F.concat(F.array(col_of(query)), _csv_head(col_of(cast), 3),
                     _csv_head(col_of(genres), None), _csv_head(col_of(keywords), 3))
    return F.array_join(parts, " ")


# ------------------------------------------------------------------------- F13

def ellipsis(text, n: int, mark: str = "...") -> Column:
    """cut to ``n`` characters and add ``mark`` only if it was longer."""
    c = col_of(text)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


# ------------------------------------------------------------------- F16-F19

def parse_votes(text) -> Column:
    """F16: ``1.2M`` / ``234K`` / ``987`` to an integer; NULL when no number."""
    c = col_of(text)
    num = try_cast(F.regexp_extract(c, r"([\d.]+)([KM])?", 1), "double")
    suf = F.regexp_extract(c, r"([\d.]+)([KM])?", 2)
    mult = F.when(suf == "K", 1000.0).when(suf == "M", 1000000.0).otherwise(1.0)
    return (num * mult).cast("bigint")


def format_votes(votes) -> Column:
    """integer to ``x.yM`` / ``xK`` / plain text; 0 or NULL gives ``N/A``."""
    v = col_of(votes)
    return (F.when(v.isNull() | (v == 0), F.lit("N/A"))
            .when(v >= 1000000, F.format_string("%.1fM", F.round(v / 1000000.0, 1)))
            .when(v >= 1000, F.concat(F.round(v / 1000.0, 0).cast("bigint").cast("string"), F.lit("K")))
            .otherwise(v.cast("bigint").cast("string")))


def extract_title_id(text) -> Column:
    """``tt`` id from a URL path ``/(tt\\d+)/``; NULL if absent."""
    return F.nullif(F.regexp_extract(col_of(text), r"/(tt\d+)/", 1), F.lit(""))


def build_queries(title="title", release_date="release_date", cast="cast",
                  directors="directors") -> Column:
    """ordered search queries: title + year, title + 2 cast, title + director."""
    t, rd = col_of(title), col_of(release_date)
    year = F.when(rd.isNotNull() & (rd != ""), F.substring(rd, 1, 4))
    q1 = F.when(year.isNotNull() & (year != ""), F.concat_ws(" ", t, year)).otherwise(t)
    c2 = F.slice(F.coalesce(col_of(cast), F.array().cast("array<string>")), 1, 2)
    q2 = F.when(F.size(c2) > 0, F.concat_ws(" ", t, F.array_join(c2, " ")))
    d = F.try_element_at(col_of(directors), F.lit(1))
    q3 = F.when(d.isNotNull(), F.concat_ws(" ", t, d))
    return F.filter(F.array(q1, q2, q3), lambda q: q.isNotNull())


# ------------------------------------------------------------------------- F33

def norm_key(col, trim: bool = True) -> Column:
    """matching key of a title (lower case, optionally trimmed)."""
    c = F.lower(col_of(col))
    return F.trim(c) if trim else c


# -------------------------------------------------------------------- F8, F9

def search_text(title="title", overview="overview", genres="genres", cast="cast",
                keywords="keywords", n_cast: int = 5, fallback_cast=None) -> Column:
    """F8: title, overview, genre names, top cast, keywords - one search text.

    ``fallback_cast`` (an array of names) is used where ``cast`` is empty.

    ``genres``/``keywords`` are arrays of names; ``cast`` an array of names.
    Empty parts are skipped exactly like falsy values are skipped upstream,
    except the title which is always present.
    """
    def nonempty(c):
        return F.when((c.isNotNull()) & (c != ""), c)

    def joined(arr, n=None):
        a = F.coalesce(col_of(arr), F.array().cast("array<string>"))
        a = F.slice(a, 1, n) if n else a
        return F.when(F.size(a) > 0, F.array_join(a, " "))

    parts = [F.coalesce(col_of(title), F.lit("")), nonempty(col_of(overview)), joined(genres),
             joined(cast, n_cast) if fallback_cast is None else F.coalesce(joined(cast, n_cast), joined(fallback_cast, n_cast)),
             joined(keywords)]
    return F.concat_ws(" ", *parts)


def csv_head(arr, n: int | None = None) -> Column:
    """F9 helper: first ``n`` names of an array as comma-separated text (NULL if none)."""
    a = col_of(arr)
    a = F.slice(a, 1, n) if n else a
    return F.when(F.size(a) > 0, F.array_join(a, ","))
