"""Canonical schemas of the two feeds and of the derived tables."""

from pyspark.sql import types as T

S, D, I, L, B, TS = (T.StringType(), T.DoubleType(), T.IntegerType(),
                     T.LongType(), T.BooleanType(), T.TimestampType())


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


IMDB_DATA = T.StructType([
    _f("tconst", S), _f("title", S), _f("year", I), _f("imdb_rating", D),
    _f("imdb_votes", L), _f("source", S),
])

CREDITS = T.StructType([_f("cast", T.ArrayType(S)), _f("directors", T.ArrayType(S))])

# Catalogue event. Floats are widened to double; ``score``-like fields that can
# be fractional are double as well.
CATALOGUE = T.StructType([
    _f("movie_id", I), _f("title", S), _f("original_title", S),
    _f("popularity", D), _f("vote_average", D), _f("vote_count", I),
    _f("release_date", S), _f("genre_ids", T.ArrayType(I)), _f("overview", S),
    _f("adult", B), _f("original_language", S), _f("poster_path", S),
    _f("backdrop_path", S), _f("timestamp", S), _f("source", S),
    _f("imdb_data", IMDB_DATA), _f("credits", CREDITS),
])

# Discussion event: union of the comment, post, targeted-search and review
# shapes written to the discussion topic.
DISCUSSION = T.StructType([
    _f("comment_id", S), _f("post_id", S), _f("id", S), _f("post_title", S),
    _f("title", S), _f("text", S), _f("author", S), _f("score", D),
    _f("created_utc", S), _f("movie_mentions", T.ArrayType(S)), _f("subreddit", S),
    _f("timestamp", S), _f("source", S), _f("type", S), _f("num_comments", I),
    _f("upvote_ratio", D), _f("url", S), _f("permalink", S), _f("movie_id", I),
    _f("movie_title", S), _f("movie_year", S), _f("search_query", S),
    _f("targeted_search", B), _f("created_at", S),
])

# Discussion event that already carries a sentiment score.
DISCUSSION_SCORED = T.StructType(DISCUSSION.fields + [_f("sentiment_score", D)])

TREND_ROW = T.StructType([
    _f("window_start", TS), _f("window_end", TS), _f("movie_title", S),
    _f("movie_id", I), _f("popularity", D), _f("vote_average", D),
    _f("mentions_count", L), _f("avg_sentiment", D), _f("avg_reddit_score", D),
    _f("mentions_rate", D), _f("trend_score", D), _f("processed_time", TS),
])

PREDICTION_ROW = T.StructType([
    _f("movie_title", S), _f("timestamp", TS), _f("actual_trend_score", D),
    _f("predicted_trend_score", D), _f("prediction_error", D), _f("model_version", S),
    _f("features", T.MapType(S, D)),
])

# Tab-separated title dumps (null token ``\N``).
BASICS_TSV = T.StructType([
    _f("tconst", S), _f("titleType", S), _f("primaryTitle", S), _f("originalTitle", S),
    _f("isAdult", S), _f("startYear", S), _f("endYear", S), _f("runtimeMinutes", S),
    _f("genres", S),
])
RATINGS_TSV = T.StructType([_f("tconst", S), _f("averageRating", D), _f("numVotes", I)])
PRINCIPALS_TSV = T.StructType([_f("tconst", S), _f("ordering", I), _f("nconst", S),
                               _f("category", S)])
NAMES_TSV = T.StructType([_f("nconst", S), _f("primaryName", S), _f("primaryProfession", S)])

LEXICON = T.StructType([_f("token", S, False), _f("valence", D, False)])
