"""Terms of texts: local counts, literal phrases, tags, mentions and their frequencies.

Texts are composed and case-folded once in Arrow batches; cutting, pairing and
counting are built-in expressions.  Null texts have no terms.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwright.session import checkpointed, partitioned

# Words that local extraction leaves out.
LOCAL_STOPWORDS = [
    "about", "after", "again", "against", "also", "and", "are", "because", "been", "before", "being", "between", "but", "can", "could", "did", "does",
    "doing", "for", "from", "had", "has", "have", "here", "hers", "him", "his", "how", "into", "its", "just", "like", "more", "most", "not", "now",
    "only", "our", "out", "over", "she", "should", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "those", "through", "too", "under", "very", "was", "were", "what", "when", "where", "which", "while", "who", "will", "with", "would", "you",
    "your", "yeah", "oh", "ooh", "la",
]
# Words that no sampled phrase holds.
SAMPLE_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "has", "have", "he", "her", "his", "i", "in", "is",
    "it", "its", "me", "my", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "there", "these", "they", "this", "to", "was",
    "we", "were", "what", "when", "where", "which", "who", "will", "with", "you", "your",
]
LETTER, INNER = r"\p{L}\p{N}", "'’‌\\-"
TAG_CHARS = r"\p{L}\p{M}\p{N}_"


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Composed and case-folded, blanks kept."""
    return pd.Series([unicodedata.normalize("NFC", t).casefold() if isinstance(t, str) else None for t in texts], dtype=object)


def stopword_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def local_words(text: Column) -> Column:
    """Words of at least three ASCII-initial characters without outer hyphens, stopwords removed."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'’-]{2,}"), 0)
    plain = F.transform(found, lambda w: F.lower(F.regexp_replace(w, "['-]+$", "")))
    return F.filter(plain, lambda w: ~w.isin(LOCAL_STOPWORDS))


def ordered_bridges(rows: DataFrame, key: str, first: str, last: str, buckets: int = 32) -> DataFrame:
    """(left, right): the last value of each row with the first of the next, in the order of a
    numeric key.  Neighbours are found within ranges of the key; only one row per range meets
    in the last step, so no task orders the whole table."""
    bounds = rows.approxQuantile(key, [k / buckets for k in range(1, buckets)], 0.01)
    at = F.aggregate(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), F.lit(0), lambda n, b: n + F.when(F.col(key) > b, 1).otherwise(0)) if bounds else F.lit(0)
    ranged = rows.select(F.col(key).alias("k"), F.col(first).alias("f"), F.col(last).alias("l"), at.alias("range"))
    inside = ranged.select(F.col("l").alias("left"), F.lead("f").over(Window.partitionBy("range").orderBy("k")).alias("right")).where("right IS NOT NULL")
    ends = ranged.groupBy("range").agg(F.min_by("f", "k").alias("f"), F.max_by("l", "k").alias("l"))
    across = ends.select(F.col("l").alias("left"), F.lead("f").over(Window.orderBy("range")).alias("right")).where("right IS NOT NULL")
    return inside.unionAll(across)


def local_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(phrase, occurrences, score): words and adjacent pairs of different words over the whole
    corpus in the order of ``key``; pairs bridge stopwords, lines and documents."""
    # Words are cut once: counts, pairs and the bridges between documents read them.
    words = checkpointed(documents.select(F.col(key).alias("k"), local_words(F.col(text)).alias("w")).where("size(w) > 0"))
    single = words.select(F.explode("w").alias("phrase"))
    within = words.select(F.explode(F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> struct(x as left, w[i + 1] as right))")).alias("p")).select("p.left", "p.right")
    bridges = ordered_bridges(words.select("k", F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last")), "k", "first", "last")
    pairs = within.unionAll(bridges).where("left <> right").select(F.concat_ws(" ", "left", "right").alias("phrase"))
    counts = checkpointed(single.unionAll(pairs).groupBy("phrase").agg(F.count("*").alias("occurrences")))
    top = counts.agg(F.max("occurrences").alias("top"))
    return counts.select("phrase", "occurrences", F.bround(F.col("occurrences") / top.scalar(), 4).alias("score"))


def literal_runs(text: Column) -> Column:
    """Runs of words parted by blanks only; anything else between words ends a run."""
    inner = rf"{LETTER}\p{{M}}{INNER}"
    t = F.regexp_replace(text, rf"[^{inner} \t]+", "\n")
    t = F.regexp_replace(t, rf"(^|[ \t\n])[\p{{M}}{INNER}]+", "$1\n")
    t = F.regexp_replace(t, rf"[{INNER}]+([ \t\n]|$)", "\n$1")
    runs = F.transform(F.split(t, "\n"), lambda r: F.filter(F.split(r, "[ \t]+"), lambda w: w != ""))
    return F.filter(runs, lambda r: F.size(r) > 0)


def literal_phrases(documents: DataFrame, key: str, text: str, max_words: int = 3) -> DataFrame:
    """(key, phrase) of every contiguous phrase of up to ``max_words`` words that neither begins
    nor ends with a stopword; single words have at least two characters."""
    runs = documents.select(F.col(key), F.explode(literal_runs(folded(F.col(text)))).alias("run"))
    # Each word is judged once; wider phrases grow from the narrower ones by a word.
    grown = runs.select(key, F.transform("run", lambda w: F.struct(w.alias("w"), w.isin(LOCAL_STOPWORDS).alias("s"))).alias("words"))
    grown = grown.withColumn("g1", F.transform("words", lambda x: F.struct(x["w"].alias("p"), x["s"].alias("f"), x["s"].alias("l"))))
    for n in range(2, max_words + 1):
        left = F.expr(f"slice(g{n - 1}, 1, greatest(size(g{n - 1}) - 1, 0))")
        right = F.expr(f"slice(words, {n}, greatest(size(words) - {n - 1}, 0))")
        grown = grown.withColumn(f"g{n}", F.zip_with(left, right, lambda a, b: F.struct(F.concat(a["p"], F.lit(" "), b["w"]).alias("p"), a["f"].alias("f"), b["s"].alias("l"))))
    grams = F.concat(*[f"g{n}" for n in range(1, max_words + 1)])
    usable = F.filter(grams, lambda g: ~g["f"] & ~g["l"] & (F.length(g["p"]) > 1))
    return grown.select(key, F.explode(usable).alias("g")).select(key, F.col("g.p").alias("phrase"))


def counted_by_key(places: DataFrame, key: str, groups: list[str], records: str = "records") -> DataFrame:
    """(groups, occurrences, records) of rows that are already partitioned by key: counts go by
    key first, which needs no shuffle then, and are summed up with map-side combining."""
    by_key = places.groupBy(key, *groups).agg(F.count("*").alias("n"))
    return by_key.groupBy(*groups).agg(F.sum("n").alias("occurrences"), F.count(key).alias(records))


def literal_counts(documents: DataFrame, key: str, text: str, max_words: int = 3) -> DataFrame:
    """(phrase, occurrences, documents).  Texts are partitioned by key, which moves less than
    their phrases would be."""
    return counted_by_key(literal_phrases(partitioned(documents.select(key, text), key), key, text, max_words), key, ["phrase"], "documents")


def top_phrases(counts: DataFrame, metric: str, limit: int) -> DataFrame:
    """The usual order: most first, then longest, then by code point."""
    return counts.orderBy(F.col(metric).desc(), F.length("phrase").desc(), "phrase").limit(limit)


def hashtags(text: Column, variant: str = "plain") -> Column:
    """Array of case-folded ``#tags`` of a folded text.

    ``plain``: not after a letter, digit, ``_`` or ``#``; ``skip_urls``: as plain, outside
    addresses; ``strict``: also not after ``/``, ``&`` or ``=``; ``lettered``: as plain, with a
    letter in it."""
    before = {"strict": rf"[{LETTER}_#/&=]"}.get(variant, rf"[{LETTER}_#]")
    source = F.regexp_replace(text, r"(?i)https?://\S+", " ") if variant == "skip_urls" else text
    found = F.regexp_extract_all(source, F.lit(rf"(?<!{before})#([{TAG_CHARS}]{{1,100}})(?![{TAG_CHARS}])"), 1)
    if variant == "lettered":
        found = F.filter(found, lambda x: x.rlike(r"\p{L}"))
    return F.transform(found, lambda x: F.concat(F.lit("#"), x))


def with_tag(rows: DataFrame, text: str, tag: str, variant: str = "plain") -> DataFrame:
    """The rows whose text holds exactly this hashtag (``#`` or not), without regard to case."""
    wanted = "#" + unicodedata.normalize("NFC", tag.strip().lstrip("#")).casefold()
    return rows.where(F.array_contains(hashtags(folded(F.col(text)), variant), wanted))


def tag_frequency(documents: DataFrame, key: str, text: str, variant: str = "plain") -> DataFrame:
    """(tag, occurrences, records)."""
    return counted_by_key(documents.select(key, F.explode(hashtags(folded(F.col(text)), variant)).alias("tag")), key, ["tag"])


def caption_words(documents: DataFrame, key: str, text: str, at_least: int = 3) -> DataFrame:
    """(phrase, records): document frequency of words and of pairs of neighbouring words."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"[{LETTER}]+"), 0), lambda w: (F.length(w) >= at_least) & ~w.isin(SAMPLE_STOPWORDS))
    words = documents.select(key, found.alias("w")).where("size(w) > 0")
    pairs = F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> concat(x, ' ', w[i + 1]))")
    return words.select(key, F.explode(F.array_distinct(F.concat("w", pairs))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("records"))


def visible_text(text: Column) -> Column:
    """Text without code, quoted lines, link targets, addresses and mentions; order matters."""
    t = F.regexp_replace(text, r"(?s)```.*?```|`[^`\n]*`", " ")
    t = F.regexp_replace(t, r"(?m)^(?: {4}|\t| {0,3}>).*$", " ")
    t = F.regexp_replace(t, r"\[([^\]\n]*)\]\([^)\s]*\)", "$1")
    t = F.regexp_replace(t, r"(?i)https?://\S+", " ")
    return F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}_])/?u/[A-Za-z0-9_-]+", " ")


def post_terms(posts: DataFrame, key: str, text: str, min_occurrences: int = 1, max_words: int = 3) -> DataFrame:
    """(category, term, occurrences, records): hashtags, community mentions and keywords."""
    seen = partitioned(posts.select(key, text), key).select(key, folded(visible_text(F.col(text))).alias("t"))
    tags = seen.select(key, F.lit("hashtag").alias("category"), F.explode(hashtags(F.col("t"))).alias("term"))
    places = seen.select(key, F.lit("community-mention").alias("category"), F.explode(F.regexp_extract_all("t", F.lit(r"(?<![\p{L}\p{N}_/])/?(r/[a-z0-9_]{2,21})(?![a-z0-9_])"), 1)).alias("term"))
    words = literal_phrases(seen, key, "t", max_words).select(key, F.lit("keyword").alias("category"), F.col("phrase").alias("term"))
    return counted_by_key(tags.unionAll(places).unionAll(words), key, ["category", "term"]).where(F.col("occurrences") >= min_occurrences)


def phrase_spans(documents: DataFrame, key: str, text: str, max_words: int = 3, keep: int = 20, flush_phrases: int = 200_000) -> DataFrame:
    """(phrase, occurrences, spans): literal phrases with their first ``keep`` places
    (key, start, end) in the original text, in the order of key and start.

    A task counts its own places and hands on no more than the first ``keep`` of a phrase at a
    time; those are counted and ranked, again ``keep`` a task before the shuffle."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def cut(batches):
        held: dict[str, list] = {}

        def handed():
            out = [(p, n if at == 0 else 0, *place) for p, (n, places) in held.items() for at, place in enumerate(sorted(places)[:keep])]
            held.clear()
            return pd.DataFrame(out, columns=["phrase", "n", "key", "start", "end"])

        for batch in batches:
            for k, t in zip(batch["key"], batch["text"], strict=True):
                for phrase, start, end in spans_of(t, max_words) if isinstance(t, str) else ():
                    entry = held.setdefault(phrase, [0, []])
                    entry[0] += 1
                    entry[1].append((k, start, end))
                    if len(entry[1]) > 4 * keep:
                        entry[1] = sorted(entry[1])[:keep]
            if len(held) > flush_phrases:
                yield handed()
        if held:
            yield handed()

    found = checkpointed(source.where("key IS NOT NULL").mapInPandas(cut, f"phrase string, n bigint, key {dict(source.dtypes)['key']}, start int, end int"))
    counts = found.groupBy("phrase").agg(F.sum("n").alias("occurrences"))
    first = found.withColumn("at", F.row_number().over(Window.partitionBy("phrase").orderBy("key", "start"))).where(F.col("at") <= keep)
    spans = first.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("key", "start", "end"))).alias("spans"))
    return counts.join(spans, "phrase")


def spans_of(text: str, max_words: int) -> list[tuple[str, int, int]]:
    import regex

    tokens = [(unicodedata.normalize("NFC", m[0]).casefold(), m.start(), m.end()) for m in regex.finditer(rf"[{LETTER}](?:[{LETTER}\p{{M}}{INNER}]*[{LETTER}\p{{M}}])?", text)]
    stops, out = set(LOCAL_STOPWORDS), []
    for i, (word, start, end) in enumerate(tokens):
        phrase, last = word, end
        for width in range(1, max_words + 1):
            if width > 1:
                if i + width > len(tokens):
                    break
                following, begins, ends = tokens[i + width - 1]
                gap = text[last:begins]
                if not gap or gap.strip(" \t"):
                    break
                phrase, last, word = f"{phrase} {following}", ends, following
            if tokens[i][0] in stops or word in stops or (width == 1 and len(word) < 2):
                continue
            out.append((phrase, start, last))
    return out


# Word gaps within a phrase, and what may not stand before a word, by record family.
STYLES = {
    "video": {"gap": r"(?: {1,2}|\t)", "drop": r"(?i)https?://\S+|(?<![\p{L}\p{N}_#])#[\p{L}\p{M}\p{N}_]+"},
    "short-video": {"gap": r"[^\S\r\n]+", "drop": r"[#@][\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"},
}


def sample_phrases(documents: DataFrame, key: str, text: str, max_words: int = 3, style: str = "video", more_stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(key, phrase): contiguous words without a stopword among them.

    ``video``: one row per place; outside addresses and tags, words parted by one or two blanks
    or a tab, first word of two characters or more; ``short-video``: each phrase of a record
    once; not after ``#`` or ``@``, parted by blanks of a line, every word of two characters and
    no plain number, at most 160 characters."""
    rule, word = STYLES[style], LETTER
    t = F.regexp_replace(text, rule["drop"], "\n")
    t = F.regexp_replace(t, rf"(?<=[{word}]){rule['gap']}(?=[{word}])", "\u0001")
    t = F.regexp_replace(t, rf"(?<![{word}])['’\-]+|['’\-]+(?![{word}])|[^{word}'’\-\u0001]+", "\n")
    runs = F.filter(F.transform(F.split(t, "\n"), lambda r: F.filter(F.split(r, "\u0001"), lambda w: w != "")), lambda r: F.size(r) > 0)
    found = documents.select(key, F.explode(runs).alias("run"))
    stops = stopword_array([*SAMPLE_STOPWORDS, *more_stopwords])
    bad = F.transform("run", lambda w: F.array_contains(stops, w) | ((F.length(w) < 2) | w.rlike(r"^\d+$") if style == "short-video" else F.lit(False)))
    marked = found.select(key, "run", bad.alias("bad"))
    widths = F.array(*[F.lit(n) for n in range(1, max_words + 1)])
    spans = F.flatten(F.transform(widths, lambda n: F.when(F.size("run") >= n, F.transform(F.sequence(F.lit(1), F.size("run") - n + 1), lambda i: F.struct(F.slice("run", i, n).alias("w"), F.exists(F.slice("bad", i, n), lambda b: b).alias("b")))).otherwise(F.array().cast("array<struct<w:array<string>,b:boolean>>"))))
    fit = F.filter(spans, lambda s: ~s["b"] & (F.length(s["w"][0]) >= 2))
    phrases = marked.select(key, F.explode(fit).alias("s")).select(key, F.array_join("s.w", " ").alias("phrase"))
    return phrases.where(F.length("phrase") <= 160).distinct() if style == "short-video" else phrases


def inventory(phrases: DataFrame, key: str, min_occurrences: int = 1, min_documents: int = 1, allowed: DataFrame | None = None) -> DataFrame:
    """(phrase, occurrences, documents) of candidates that occur often enough."""
    rows = phrases.join(allowed, "phrase", "left_semi") if allowed is not None else phrases
    counted = counted_by_key(rows, key, ["phrase"], "documents")
    return counted.where((F.col("occurrences") >= min_occurrences) & (F.col("documents") >= min_documents))


def salience(spans: DataFrame, location: list[str], weight: str) -> DataFrame:
    """(phrase, locations, raw, score): the largest weight of a phrase's features times
    1 + log2(places), plus a tenth per word up to five, against the largest of all."""
    by = spans.groupBy("phrase").agg(F.max(weight).alias("w"), F.count_distinct(*location).alias("locations"))
    words = F.least(F.size(F.split("phrase", " ")), F.lit(5))
    raw = by.select("phrase", "locations", (F.col("w") * (1 + F.log2("locations")) + words * 0.1).alias("raw"))
    return raw.withColumn("score", F.col("raw") / raw.agg(F.max("raw")).scalar())
