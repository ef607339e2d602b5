"""SQL (DuckDB) building blocks shared by the oracle texts."""

from __future__ import annotations

from ..functions import sentiment as S
from ..sources import testbed as tb


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lexicon_cte() -> str:
    rows = ", ".join(f"({_q(k)}, {float(v)!r})" for k, v in S.LEXICON.items())
    return f"lexicon AS (SELECT * FROM (VALUES {rows}) AS t(token, valence))"


def sentiment_ctes(src: str, id_col: str, text_col: str, out: str) -> str:
    """CTEs computing ``out(sid, compound)`` for rows of ``src``: one row per lexicon word, changed step by step."""
    raw = f"replace(coalesce({text_col}, ''), chr(8217), chr(39))"
    punct = _q(S.PUNCTUATION)
    negators, boosters, listed = _list(S.NEGATORS), _list(S.BOOSTERS), _list(S.LEXICON)
    n, cap = S.NEGATION_FACTOR, r"'^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'"

    def at(k):
        return f"CASE WHEN i + {k} >= 1 THEN low[i + {k}] END"

    def boost(x):
        cases = " ".join(f"WHEN list_contains({_list(ws)}, {x}) THEN {b}"
                         for ws, b in ((S.RAISERS, S.BOOST), (S.LOWERERS, -S.BOOST)))
        return f"(CASE {cases} ELSE 0.0 END)"

    def push(v):
        return f"(CASE WHEN {v} > 0 THEN {S.CAPITALS} ELSE -{S.CAPITALS} END)"

    def capital(k):
        return f"(mixed AND i + {k} >= 1 AND regexp_matches(raw[i + {k}], {cap}))"

    def phrase(a, b):
        return "concat_ws(' ', " + ", ".join(at(k) for k in range(a, b + 1)) + ")"

    def idiom(x):
        return f"(CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in S.IDIOMS.items()) + " END)"

    def free(k):
        return f"p{k} IS NOT NULL AND NOT list_contains(known, p{k})"

    def booster(k):
        own = f"CASE WHEN v < 0 THEN -{boost(f'p{k}')} ELSE {boost(f'p{k}')} END"
        caps = f"CASE WHEN {capital(-k)} THEN {push('v')} ELSE 0.0 END"
        return (f"CASE WHEN {free(k)} AND list_contains({boosters}, p{k}) "
                f"THEN v + ({own} + {caps}) * {S.DECAY[k - 1]} ELSE v END")

    def negation(k):
        between = [f"p{j}" for j in range(1, k)]
        special = "".join(
            f"WHEN {free(k)} AND p{k} = {_q(w)} AND ({' OR '.join(f'coalesce({b} IN {ws}, false)' for b in between)}) THEN v * {f} "
            for w, ws, f in (("never", "('so', 'this')", S.NEVER_SO), ("without", "('doubt')", 1.0))) if between else ""
        return (f"CASE {special}WHEN {free(k)} AND (list_contains({negators}, p{k}) OR contains(p{k}, 'n''t')) "
                f"THEN v * {n} ELSE v END")

    before = ", ".join(idiom(phrase(a, b)) for a, b in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)))
    after = ", ".join(f"CASE WHEN low[i + {k}] IS NOT NULL THEN {idiom(phrase(0, k))} END" for k in (2, 1))
    longer = " + ".join(boost(phrase(a, b)) for a, b in ((-3, -1), (-3, -2), (-2, -1)))
    steps = [
        f"CASE WHEN {capital(0)} THEN v + {push('v')} ELSE v END",
        booster(1), negation(1), booster(2), negation(2), booster(3), negation(3),
        f"CASE WHEN {free(3)} THEN coalesce({after}, {before}, v) + {longer} ELSE v END",
        f"CASE WHEN p1 = 'least' AND NOT list_contains(known, p1) AND NOT coalesce(p2 IN ('at', 'very'), false) THEN v * {n} ELSE v END"]
    value = f"""SELECT * EXCLUDE (own), CASE WHEN p1 = 'no' OR p2 = 'no' OR (p3 = 'no' AND p1 IN ('or', 'nor')) THEN own * {n}
          WHEN low[i] = 'no' AND coalesce(list_contains(known, low[i + 1]), false) THEN 0.0 ELSE own END AS v FROM {out}_hit"""
    for step in steps:
        value = f"SELECT * REPLACE ({step} AS v) FROM ({value})"
    return f"""
{out}_tok AS (SELECT {id_col} AS sid, {raw} AS txt, list_transform(regexp_extract_all({raw}, '[^ \t\n\r\f\x0B]+'),
                lambda w: CASE WHEN length(trim(w, {punct})) > 2 THEN trim(w, {punct}) ELSE w END) AS raw FROM {src}),
{out}_low AS (SELECT *, list_transform(raw, lambda w: lower(w)) AS low FROM {out}_tok),
{out}_pos AS (SELECT sid, raw, low, unnest(list_filter(range(1, len(low) + 1), lambda i: list_contains({listed}, low[i])
                AND NOT list_contains({boosters}, low[i]))) AS i FROM {out}_low),
{out}_in AS (SELECT p.*, l.valence AS own FROM {out}_pos p JOIN lexicon l ON l.token = p.low[p.i]
             WHERE NOT (p.low[p.i] = 'kind' AND coalesce(p.low[p.i + 1] = 'of', false))),
{out}_hit AS (SELECT *, {at(-1)} AS p1, {at(-2)} AS p2, {at(-3)} AS p3, {listed} AS known,
                len(list_filter(raw, lambda w: regexp_matches(w, {cap}))) BETWEEN 1 AND len(raw) - 1 AS mixed,
                list_position(low, 'but') AS but FROM {out}_in),
{out}_val AS (SELECT sid, sum(v * CASE WHEN coalesce(but, 0) = 0 OR i = but THEN 1.0 WHEN i < but THEN {S.BUT[0]} ELSE {S.BUT[1]} END) AS s
              FROM ({value}) GROUP BY sid),
{out}_sum AS (SELECT t.sid, coalesce(s, 0.0) AS s,
                least(length(txt) - length(replace(txt, '!', '')), {S.MOST_EXCLAMATIONS}) * {S.EXCLAMATION}
                + CASE WHEN length(txt) - length(replace(txt, '?', '')) > 3 THEN {S.MOST_QUESTIONS}
                       WHEN length(txt) - length(replace(txt, '?', '')) > 1 THEN (length(txt) - length(replace(txt, '?', ''))) * {S.QUESTION}
                       ELSE 0.0 END AS marks
              FROM {out}_tok t LEFT JOIN {out}_val v ON v.sid = t.sid),
{out} AS (SELECT sid, round(x / sqrt(x * x + {S.ALPHA}), 4) AS compound
          FROM (SELECT sid, s + CASE WHEN s > 0 THEN marks WHEN s < 0 THEN -marks ELSE 0.0 END AS x FROM {out}_sum))"""


def trends_ctes() -> str:
    """CTEs ending in ``trends``: unrounded C1 rows (1 day windows every 6 h)."""
    from .q_trend import _CA, _DA
    return _CA + "," + _DA + """,
trends AS (
  SELECT ca.window_start, ca.window_end, ca.movie_title, ca.movie_id, ca.popularity, ca.vote_average,
         CAST(da.mentions_count AS BIGINT) AS mentions_count, da.avg_sentiment, da.avg_reddit_score,
         CAST(da.mentions_count AS DOUBLE) AS mentions_rate,
         0.4 * ca.popularity + 0.3 * da.mentions_count * 10 + 0.3 * (da.avg_sentiment + 1) * 50 AS trend_score
  FROM ca JOIN da ON ca.window_start = da.window_start AND ca.movie_title = da.movie_title)"""


def with_trends(select: str) -> str:
    return tb.with_ctes(select, "catalogue", "discussion", extra=trends_ctes())


def sround(x: str, n: int) -> str:
    """Half-up rounding of the shortest decimal form of a double (as Spark's ``round``)."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _strip_class(chars: str) -> str:
    return "[" + chars.replace("'", "''") + "]"


def mentions_sql(text: str) -> str:
    """F4 in DuckDB: capitalised word runs (RE2 has no look-behind: pad with a space)."""
    from ..functions.text import MENTION_STRIP
    cls = _strip_class(MENTION_STRIP)
    runs = (f"regexp_extract_all(' ' || coalesce({text}, ''), "
            r"'\s(\p{Lu}\S*(?:\s+\p{Lu}\S*)*)', 1)")
    return (f"list_transform(list_transform({runs}, lambda r: regexp_replace(r, '\\s+', ' ', 'g')), "
            f"lambda r: regexp_replace(r, '^{cls}+|{cls}+$', '', 'g'))")


def clean_mentions_sql(mentions: str) -> str:
    from ..functions.text import MENTION_STOP_WORDS, TITLE_STRIP
    cls = _strip_class(TITLE_STRIP)
    cleaned = f"list_transform({mentions}, lambda m: regexp_replace(m, '^{cls}+|{cls}+$', '', 'g'))"
    return (f"list_filter({cleaned}, lambda m: NOT list_contains({_list(MENTION_STOP_WORDS)}, m) "
            f"AND length(m) > 3 AND NOT ends_with(m, ':'))")


def attribute_sql(source: str, movie_title: str, subreddit: str, mentions: str) -> str:
    from ..functions.text import SUBREDDIT_TITLES
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in SUBREDDIT_TITLES.items())
    mapped = f"(CASE lower(coalesce({subreddit}, '')) {cases} END)"
    own = f"(CASE WHEN {source} = 'tmdb' THEN coalesce({movie_title}, 'Unknown') END)"
    first = f"({clean_mentions_sql(mentions)})[1]"
    return f"coalesce({own}, {mapped}, {first}, 'general')"


def strip_ws_sql(x: str) -> str:
    """``str.strip()`` in DuckDB: trim the whitespace set given by code points."""
    from ..operators.clean import PY_WHITESPACE
    chars = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)
    return f"trim({x}, {chars})"
