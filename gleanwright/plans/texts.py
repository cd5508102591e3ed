"""Queries of terms, samples, repeated records and co-occurrence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.functions.counts import display_count, is_censored, measured
from gleanwright.functions.text import normal, words
from gleanwright.functions.urls import host, normal_url
from gleanwright.operators import dedup, samples, selection, terms
from gleanwright.session import partitioned, spread, table

SQL: dict[str, str] = {}
EPOCH = "TIMESTAMPTZ '1970-01-01 00:00:00+00'"
NOW = "2025-06-01"


def term_sample_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of three and more characters with occurrences, documents and length statistics."""
    texts = partitioned(table(spark, folder, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    found = texts.select("doc_id", "n_chars", F.explode(words(F.col("text"), 3)).alias("term"))
    per_document = found.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    # A term has one row for each length that its documents have, however many they are.
    sized = per_document.groupBy("term", "n_chars").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))
    total = F.sum(F.col("n_chars") * F.col("documents"))
    measured_documents = F.sum(F.when(F.col("n_chars").isNotNull(), F.col("documents")))
    stats = sized.groupBy("term").agg(
        F.sum("n").alias("occurrences"), F.sum("documents").alias("documents"), total.alias("n_chars_sum"),
        F.round(total / measured_documents, 6).alias("n_chars_mean"), F.percentile("n_chars", 0.5, F.col("documents")).alias("n_chars_median"),
    )
    return stats.orderBy(F.col("documents").desc(), F.length("term").desc(), "term").limit(50)


SQL["term_sample_stats"] = r"""
WITH t AS (SELECT doc_id, n_chars, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
d AS (SELECT term, doc_id, count(*) AS n, max(n_chars) AS n_chars FROM t WHERE length(term) >= 3 GROUP BY ALL)
SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS documents, sum(n_chars)::BIGINT AS n_chars_sum, round(avg(n_chars), 6) AS n_chars_mean, median(n_chars) AS n_chars_median
FROM d GROUP BY term ORDER BY documents DESC, length(term) DESC, term LIMIT 50"""


def term_counts_local(spark: SparkSession, folder: str) -> DataFrame:
    return terms.top_phrases(terms.local_counts(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text"), "occurrences", 200)


STOPS = ", ".join(f"'{w}'" for w in terms.LOCAL_STOPWORDS)
SQL["term_counts_local"] = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]{{2,}}'), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, lower(regexp_replace(w, '[''-]+$', '')) AS w FROM t),
k AS (SELECT * FROM n WHERE w NOT IN ({STOPS})),
p AS (SELECT w, lead(w) OVER (ORDER BY doc_id, pos) AS f FROM k),
c AS (SELECT w AS phrase FROM p UNION ALL SELECT w || ' ' || f FROM p WHERE f IS NOT NULL AND w <> f),
g AS (SELECT phrase, count(*) AS occurrences FROM c GROUP BY phrase)
SELECT phrase, occurrences, round_even(occurrences / max(occurrences) OVER (), 4) AS score FROM g ORDER BY occurrences DESC, length(phrase) DESC, phrase LIMIT 200"""


def literal_ngrams_topk(spark: SparkSession, folder: str) -> DataFrame:
    return terms.top_phrases(terms.literal_counts(table(spark, folder, "documents"), "doc_id", "text"), "occurrences", 300)


FOLD = "replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"
SQL["literal_ngrams_topk"] = rf"""
WITH a AS (SELECT doc_id, regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}\p{{M}}''’‌\- \t]+', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(t, '(^|[ \t\n])[\p{{M}}''’‌-]+', '\1' || chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '[''’‌-]+([ \t\n]|$)', chr(10) || '\1', 'g') AS t FROM b),
r AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS run FROM c),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(run, '[ \t]+'), lambda x: x <> '') AS w FROM r),
g AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n),
s AS (SELECT doc_id, w[i] AS first, w[i + n - 1] AS last, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM g)
SELECT phrase, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM s WHERE first NOT IN ({STOPS}) AND last NOT IN ({STOPS}) AND (n > 1 OR length(first) > 1)
GROUP BY phrase ORDER BY occurrences DESC, length(phrase) DESC, phrase LIMIT 300"""


def hashtag_docfreq(spark: SparkSession, folder: str) -> DataFrame:
    return terms.tag_frequency(table(spark, folder, "documents"), "doc_id", "text")


SQL["hashtag_docfreq"] = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({FOLD}, '(^|[^\p{{L}}\p{{N}}_#])#([\p{{L}}\p{{M}}\p{{N}}_]{{1,100}})', 2)) AS tag FROM documents)
SELECT '#' || tag AS tag, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM t GROUP BY 1"""


def caption_docfreq(spark: SparkSession, folder: str) -> DataFrame:
    return terms.caption_words(table(spark, folder, "videos"), "id", "caption")


SAMPLE_STOPS = ", ".join(f"'{w}'" for w in terms.SAMPLE_STOPWORDS)
SQL["caption_docfreq"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, list_filter(regexp_extract_all(lower(caption), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3 AND x NOT IN ({SAMPLE_STOPS})) AS w FROM videos),
p AS (SELECT r, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS phrase FROM t WHERE len(w) > 0)
SELECT phrase, count(*) AS records FROM p GROUP BY phrase"""


def post_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts").select("id", F.concat_ws("\n", "title", "body").alias("text"))
    return terms.post_terms(posts, "id", "text", 2, 2)


def phrase_places(spark: SparkSession, folder: str) -> DataFrame:
    found = terms.phrase_spans(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")
    return found.orderBy(F.col("occurrences").desc(), F.length("phrase").desc(), "phrase").limit(100)


VIDEO_COUNTS = ["view_count", "like_count", "comment_count", "share_count", "save_count"]


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    order = F.coalesce("captured_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    rows = table(spark, folder, "videos").select("id", "captured_at", "channel_id", "tags", *[F.col(c).cast("double").alias(c) for c in VIDEO_COUNTS])
    return dedup.first_non_null(rows, "id", order, ["channel_id", "tags", "captured_at", *VIDEO_COUNTS])


def sample_stats_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Per tag entry: counters, interactions per view over complete rows, recency, channels."""
    videos = _videos(spark, folder)
    members = videos.select("id", F.explode("tags").alias("t")).select("id", F.lower(F.trim(F.ltrim(F.trim("t"), F.lit("#")))).alias("term"))
    now = F.lit(NOW).cast("timestamp")
    extra = [
        *samples.complete_ratio(["like_count", "comment_count", "share_count"], "view_count", "interactions_per_view"),
        samples.recent(F.col("captured_at"), now, 30).alias("last_30d"), F.count_distinct("channel_id").alias("channels"),
    ]
    found = samples.term_stats(members, videos.drop("tags"), "id", "term", VIDEO_COUNTS, extra)
    return found.select(*[F.round(c, 6).alias(c) if c.endswith(("_mean", "_median", "per_view")) else F.col(c) for c in found.columns])


def _first(c: str) -> str:
    return f"arg_min({c}, row(coalesce(captured_at, {EPOCH}), {c})) FILTER (WHERE {c} IS NOT NULL) AS {c}"


_STATS = ", ".join(f"count({c}) AS sample_{c}_available, sum({c}) AS sample_{c}_sum, round(avg({c}), 6) AS sample_{c}_mean, round(median({c}), 6) AS sample_{c}_median" for c in VIDEO_COUNTS)
_COMPLETE = "view_count > 0 AND like_count IS NOT NULL AND comment_count IS NOT NULL AND share_count IS NOT NULL"
_TYPED = ", ".join(f"{c}::DOUBLE AS {c}" for c in VIDEO_COUNTS)
SQL["sample_stats_tags"] = f"""
WITH v AS (SELECT id, captured_at, channel_id, tags, {_TYPED} FROM videos),
d AS (SELECT id, {", ".join(_first(c) for c in ["channel_id", "tags", *VIDEO_COUNTS])}, min(captured_at) AS captured_at FROM v GROUP BY id),
m AS (SELECT DISTINCT id, lower(trim(ltrim(trim(t), '#'))) AS term FROM (SELECT id, unnest(tags) AS t FROM d))
SELECT term, count(*) AS records, {_STATS},
  round(sum(like_count + comment_count + share_count) FILTER (WHERE {_COMPLETE}) / sum(view_count) FILTER (WHERE {_COMPLETE}), 6) AS interactions_per_view,
  count(*) FILTER (WHERE {_COMPLETE}) AS interactions_per_view_records,
  CASE WHEN count(captured_at) > 0 THEN count(*) FILTER (WHERE captured_at <= TIMESTAMPTZ '{NOW} 00:00:00+00' AND captured_at >= TIMESTAMPTZ '2025-05-02 00:00:00+00') END AS last_30d,
  count(DISTINCT channel_id) AS channels
FROM m JOIN d USING (id) WHERE term IS NOT NULL GROUP BY term"""


def sample_stats_media(spark: SparkSession, folder: str) -> DataFrame:
    counts = ["likes", "comments_count", "views", "reach", "saved", "shares"]
    rows = table(spark, folder, "media").select("media_type", *[F.col(c).cast("double").alias(c) for c in counts])
    out = rows.groupBy("media_type").agg(F.count("*").alias("records"), *samples.counter_stats(counts), *samples.complete_ratio(["likes", "comments_count"], "views", "engagement"))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("_mean", "_median", "engagement")) else F.col(c) for c in out.columns])


_M = ["likes", "comments_count", "views", "reach", "saved", "shares"]
SQL["sample_stats_media"] = f"""
SELECT media_type, count(*) AS records, {", ".join(f"count({c}) AS sample_{c}_available, sum({c}::DOUBLE) AS sample_{c}_sum, round(avg({c}::DOUBLE), 6) AS sample_{c}_mean, round(median({c}::DOUBLE), 6) AS sample_{c}_median" for c in _M)},
  round(sum((likes + comments_count)::DOUBLE) FILTER (WHERE views > 0 AND likes IS NOT NULL AND comments_count IS NOT NULL) / sum(views::DOUBLE) FILTER (WHERE views > 0 AND likes IS NOT NULL AND comments_count IS NOT NULL), 6) AS engagement,
  count(*) FILTER (WHERE views > 0 AND likes IS NOT NULL AND comments_count IS NOT NULL) AS engagement_records
FROM media GROUP BY media_type"""


def attention_competition(spark: SparkSession, folder: str) -> DataFrame:
    found = samples.attention(table(spark, folder, "posts"), "subreddit", "score", "num_comments")
    return found.withColumn("share", F.round("share", 9))


SQL["attention_competition"] = """
SELECT subreddit, count(*) AS posts, median(score) AS median_score, median(num_comments) AS median_comments, round(count(*) / (SELECT count(*) FROM posts), 9) AS share FROM posts GROUP BY subreddit"""


def community_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How each flair's posts spread over communities."""
    found = samples.distribution(table(spark, folder, "posts").where("flair IS NOT NULL"), ["flair"], F.col("subreddit"), "community")
    return found.withColumn("share", F.round("share", 9))


SQL["community_shares"] = """
WITH c AS (SELECT flair, subreddit AS community, count(*) AS records FROM posts WHERE flair IS NOT NULL AND subreddit IS NOT NULL GROUP BY ALL) SELECT *, round(records / sum(records) OVER (PARTITION BY flair), 9) AS share FROM c"""


def duration_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Durations and music of the videos of each content type."""
    rows = table(spark, folder, "videos")
    found = rows.groupBy("content_type").agg(F.count("*").alias("records"), *samples.counter_stats(["duration"]), F.min("duration").alias("shortest"), F.max("duration").alias("longest"), F.count_distinct("music_id").alias("sounds"))
    return found.select(*[F.round(c, 4).alias(c) if c.startswith("sample_duration_") and c != "sample_duration_available" else F.col(c) for c in found.columns])


SQL["duration_stats"] = """
SELECT content_type, count(*) AS records, count(duration) AS sample_duration_available, round(sum(duration), 4) AS sample_duration_sum, round(avg(duration), 4) AS sample_duration_mean, round(median(duration), 4) AS sample_duration_median, min(duration) AS shortest, max(duration) AS longest, count(DISTINCT music_id) AS sounds FROM videos GROUP BY content_type"""


def tagged_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Captions that hold the hashtag most videos have, as an exact tag."""
    videos = table(spark, folder, "videos").select("id", "captured_at", "caption")
    best = terms.tag_frequency(videos, "id", "caption").orderBy(F.col("records").desc(), "tag").first()
    return terms.with_tag(videos, "caption", best.tag if best else "#").groupBy("id").agg(F.count("*").alias("copies"))


SQL["tagged_captions"] = rf"""
WITH t AS (SELECT id, caption, regexp_extract_all({FOLD.replace("text", "caption")}, '(^|[^\p{{L}}\p{{N}}_#])#([\p{{L}}\p{{M}}\p{{N}}_]{{1,100}})', 2) AS tags FROM videos),
b AS (SELECT tag FROM (SELECT id, unnest(tags) AS tag FROM t) GROUP BY tag ORDER BY count(DISTINCT id) DESC, tag LIMIT 1)
SELECT id, count(*) AS copies FROM t WHERE list_contains(tags, (SELECT tag FROM b)) GROUP BY id"""


def merged_video_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of all deliveries of a video together."""
    return dedup.merged_tags(table(spark, folder, "videos"), "id", "tags").select("id", F.array_join("tags", "|").alias("tags"))


SQL["merged_video_tags"] = "SELECT id, string_agg(t, '|' ORDER BY t) AS tags FROM (SELECT DISTINCT id, unnest(tags) AS t FROM videos) WHERE t IS NOT NULL GROUP BY id"


def dedup_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "posts")
    found = dedup.keep_first(rows, "id", ["captured_at", "score", "num_comments"], ["score", "num_comments", "upvote_ratio"])
    return found.select("id", "copies", "conflicting")


SQL["dedup_conflicts"] = """
SELECT id, count(*) AS copies, count(DISTINCT (coalesce(score::VARCHAR, 'n') || '|' || coalesce(num_comments::VARCHAR, 'n') || '|' || coalesce(upvote_ratio::VARCHAR, 'n'))) > 1 AS conflicting FROM posts GROUP BY id"""


def dedup_first_nonnull(spark: SparkSession, folder: str) -> DataFrame:
    order = F.coalesce("captured_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    rows = table(spark, folder, "media").withColumn("likes", F.col("likes").cast("double"))
    return dedup.first_non_null(rows, "id", order, ["owner", "media_type", "likes"])


SQL["dedup_first_nonnull"] = f"""
WITH m AS (SELECT id, captured_at, owner, media_type, likes::DOUBLE AS likes FROM media)
SELECT id, count(*) AS copies, {", ".join(_first(c) for c in ("owner", "media_type", "likes"))},
  ((count(DISTINCT owner) > 1)::BIGINT + (count(DISTINCT media_type) > 1)::BIGINT + (count(DISTINCT likes) > 1)::BIGINT) AS conflicts FROM m GROUP BY id"""


def dedup_removed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "posts")
    kept = dedup.without_removed(rows, "id", F.col("body").isin("[removed]", "[deleted]"), ["captured_at"])
    return kept.select("id", "subreddit")


SQL["dedup_removed"] = "SELECT id, max(subreddit) AS subreddit FROM posts GROUP BY id HAVING NOT bool_or(coalesce(body IN ('[removed]', '[deleted]'), false))"


def serp_best_rank(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.best_rank(table(spark, folder, "serp_after"), ["serp_id", "observed_at"], "url", "rank")


SQL["serp_best_rank"] = """
WITH b AS (SELECT serp_id, observed_at, url, min(rank) AS rank FROM serp_after WHERE url IS NOT NULL GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY serp_id, observed_at, rank) > 1 AS tied FROM b"""


def cooccurrence_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Each tag's first twenty other tags by shared records."""
    videos = table(spark, folder, "videos").select("id", F.explode("tags").alias("t")).select("id", F.lower(F.trim("t")).alias("tag"))
    total = table(spark, folder, "videos").select("id").distinct().count()
    found = samples.cooccurrence(videos, "id", "tag", total, 20)
    return found.select("term", "other", "shared", *[F.round(c, 9).alias(c) for c in ("conditional", "jaccard", "lift")])


SQL["cooccurrence_tags"] = """
WITH t AS (SELECT DISTINCT id, lower(trim(t)) AS tag FROM (SELECT id, unnest(tags) AS t FROM videos) WHERE t IS NOT NULL),
n AS (SELECT tag, count(*) AS n FROM t GROUP BY tag),
s AS (SELECT a.tag AS term, b.tag AS other, count(*) AS shared FROM t a JOIN t b ON a.id = b.id AND a.tag <> b.tag GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY shared DESC, other) AS place FROM s)
SELECT term, other, shared, round(shared / x.n, 9) AS conditional, round(shared / (x.n + y.n - shared), 9) AS jaccard, round(shared * (SELECT count(DISTINCT id) FROM videos)::DOUBLE / (x.n::DOUBLE * y.n), 9) AS lift
FROM r JOIN n x ON x.tag = term JOIN n y ON y.tag = other WHERE place <= 20"""


def casefold_distinct(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observed_evidence").where("phrase IS NOT NULL")
    return dedup.ordered_distinct(rows, normal("phrase"), F.struct("evidence_id", "phrase"), "phrase")


SQL["casefold_distinct"] = f"""
SELECT {FOLD.replace("text", "trim(phrase)")} AS identity, arg_min(phrase, row(evidence_id, phrase)) AS first_spelling, count(*) AS rows FROM observed_evidence WHERE phrase IS NOT NULL GROUP BY 1"""


def evidence_values(spark: SparkSession, folder: str) -> DataFrame:
    """The union value of evidence, told apart: number, censored, label or missing."""
    v = F.col("value")
    shown = display_count(v)
    state = F.when(v.isNull(), "missing").when(is_censored(v), "censored").when(measured(v).isNotNull(), "number").when(shown["approximate"], "compact").otherwise("label")
    rows = table(spark, folder, "observed_evidence").select("metric", state.alias("state"), measured(v).alias("number"))
    return rows.groupBy("metric", "state").agg(F.count("*").alias("rows"), F.sum("number").alias("total"))


SQL["evidence_values"] = r"""
WITH t AS (SELECT metric, value, regexp_replace(trim(value), '%$', '') AS p FROM observed_evidence),
u AS (SELECT metric, value, CASE WHEN regexp_full_match(replace(p, ',', ''), '[+-]?\d+(\.\d+)?([eE][+-]?\d+)?') AND regexp_full_match(p, '[+-]?\d+(,\d{3})*(\.\d+)?([eE][+-]?\d+)?') THEN replace(p, ',', '')::DOUBLE END AS number FROM t)
SELECT metric, CASE WHEN value IS NULL THEN 'missing' WHEN regexp_matches(trim(value), '^[<>]\s*\d') THEN 'censored' WHEN number IS NOT NULL THEN 'number' WHEN regexp_full_match(trim(value), '\d+(\.\d+)?\s*[KkMmBb]') THEN 'compact' ELSE 'label' END AS state,
  count(*) AS rows, sum(number) AS total FROM u GROUP BY ALL"""


def tags_discovered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "videos").where("tags IS NOT NULL").withColumn("at", F.coalesce("captured_at", F.lit("1970-01-01 00:00:00").cast("timestamp")))
    return selection.discovered(rows.withColumn("at", F.struct("at", "id", "tags")), "id", "tags", "at")


SQL["tags_discovered"] = f"""
WITH t AS (SELECT id, coalesce(captured_at, {EPOCH}) AS c, tags, unnest(tags) AS spelling, generate_subscripts(tags, 1) AS i FROM videos WHERE tags IS NOT NULL)
SELECT lower(spelling) AS tag, count(DISTINCT id) AS records, arg_min(spelling, row(c, id, tags, i)) AS display FROM t GROUP BY 1"""


def url_hosts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "serp_after").where("url IS NOT NULL").select(normal_url(F.col("url")).alias("address"))
    return rows.groupBy(host(F.col("address"), True).alias("host")).agg(F.count("*").alias("rows"), F.count_distinct("address").alias("addresses"))


SQL["url_hosts"] = r"""
WITH t AS (SELECT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q']) AS x FROM serp_after WHERE url IS NOT NULL),
u AS (SELECT lower(x.h) AS h, lower(x.s) || '://' || lower(x.h) || CASE WHEN x.p = '' THEN '/' ELSE x.p END || x.q AS address FROM t)
SELECT nullif(regexp_replace(h, '^www\.', ''), '') AS host, count(*) AS rows, count(DISTINCT address) AS addresses FROM u GROUP BY 1"""


def sample_phrases(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "videos").select("id", F.lower("caption").alias("caption"))
    return terms.inventory(terms.sample_phrases(rows, "id", "caption", 2), "id", 2, 2)


SQL["sample_phrases"] = rf"""
WITH a AS (SELECT id, regexp_replace(lower(caption), 'https?://\S+', chr(10), 'g') AS t FROM videos), b AS (SELECT id, regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_#])#[\p{{L}}\p{{M}}\p{{N}}_]+', '\1' || chr(10), 'g') AS t FROM a),
c AS (SELECT id, regexp_replace(t, '[^\p{{L}}\p{{N}}''’ \t-]+', chr(10), 'g') AS t FROM b), d AS (SELECT id, regexp_replace(regexp_replace(t, '(^|[ \t\n])[''’-]+', '\1' || chr(10), 'g'), '[''’-]+([ \t\n]|$)', chr(10) || '\1', 'g') AS t FROM c),
e AS (SELECT id, regexp_replace(t, '[ \t]{{3,}}|\t[ \t]| \t', chr(10), 'g') AS t FROM d), r AS (SELECT id, unnest(string_split(t, chr(10))) AS run FROM e), w AS (SELECT id, list_filter(regexp_split_to_array(run, '[ \t]+'), lambda x: x <> '') AS w FROM r),
g AS (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (VALUES (1), (2)) v(n) WHERE len(w) >= n), p AS (SELECT id, w[i:i + n - 1] AS p FROM g)
SELECT array_to_string(p, ' ') AS phrase, count(*) AS occurrences, count(DISTINCT id) AS documents FROM p WHERE NOT list_has_any(p, [{SAMPLE_STOPS}]) AND length(p[1]) >= 2 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT id) >= 2"""


def tag_salience(spark: SparkSession, folder: str) -> DataFrame:
    """Salience of tags and title words of records, tags weighing more."""
    videos = table(spark, folder, "videos").select("id", F.posexplode("tags").alias("place", "t")).select("id", "place", F.lower(F.trim("t")).alias("phrase"), F.lit(4.0).alias("weight"))
    titles = table(spark, folder, "posts").select("id", F.posexplode(words(F.col("title"), 3)).alias("place", "phrase"), F.lit(1.0).alias("weight"))
    found = terms.salience(videos.unionByName(titles).where("phrase <> ''"), ["id", "place"], "weight")
    return found.select("phrase", "locations", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


SQL["tag_salience"] = r"""
WITH s AS (SELECT id, i AS place, lower(trim(t)) AS phrase, 4.0 AS weight FROM (SELECT id, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM videos) UNION ALL
  SELECT id, i, t, 1.0 FROM (SELECT id, unnest(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), lambda x: length(x) >= 3)) AS t, generate_subscripts(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), lambda x: length(x) >= 3), 1) AS i FROM posts)),
b AS (SELECT phrase, max(weight)::DOUBLE AS w, count(DISTINCT row(id, place)) AS locations FROM s WHERE phrase <> '' GROUP BY phrase), r AS (SELECT phrase, locations, w * (1 + log2(locations)) + least(len(string_split(phrase, ' ')), 5) * 0.1 AS raw FROM b)
SELECT phrase, locations, round(raw, 6) AS raw, round(raw / (SELECT max(raw) FROM r), 6) AS score FROM r"""

QUERIES = [
    term_sample_stats, term_counts_local, literal_ngrams_topk, hashtag_docfreq, caption_docfreq, post_term_counts, phrase_places, sample_stats_tags, sample_stats_media,
    attention_competition, community_shares, duration_stats, tagged_captions, merged_video_tags, dedup_conflicts, dedup_first_nonnull, dedup_removed, serp_best_rank, cooccurrence_tags, casefold_distinct, evidence_values, tags_discovered, url_hosts, sample_phrases, tag_salience,
]
