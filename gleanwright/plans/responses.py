"""Queries of the parsers of saved responses: documents of a service's shape are made of the test
tables, read back by the parser, and summed up; the SQL sums the tables up themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.sources import connectors, records, responses
from gleanwright.session import table

SQL: dict[str, str] = {}
PAGE_ROWS = 50  # rows of one made-up response


def _gathered(rows: DataFrame, keys: list[str], order: list[str], item: Column) -> DataFrame:
    """(keys, l): the items of each key in order, as a service would return one page."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("i")))).alias("l")).select(*keys, F.transform("l", lambda x: x["i"]).alias("l"))


def service_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of every declared service, with parts for phrases."""
    part, out = table(spark, folder, "part"), None
    for name, spec in sorted(responses.RESPONSES.items()):
        rows = part.select(F.expr(f"p_partkey div {PAGE_ROWS}").alias("k"), F.col("p_partkey").alias("position"), F.col("p_name").alias("phrase"), *[(F.col("p_size") + n).cast("int").alias(m) for n, (m, _, _) in enumerate(spec.metrics)])
        read = responses.response_rows(responses.as_response(rows, "k", name), "k", "text", name)
        summed = read.groupBy("source", "relationship", "metric", "unit", "problem").agg(F.count("*").alias("rows"), F.sum("value").alias("total")).withColumn("service", F.lit(name))
        out = summed if out is None else out.unionAll(summed)
    return out


def _metric_rows() -> str:
    parts = []
    for name, spec in sorted(responses.RESPONSES.items()):
        head = f"'{spec.source}' AS source, '{spec.relationship}' AS relationship"
        cells = [(m, unit, f"sum(p_size + {n})") for n, (m, _, unit) in enumerate(spec.metrics)]
        cells += [(spec.order, "ordinal", "(SELECT sum(n * (n + 1) / 2) FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey // 50))")] if spec.order else []
        for metric, unit, total in cells or [(None, None, "NULL")]:
            shown = (f"'{metric}' AS metric, '{unit}' AS unit" if metric else "NULL::VARCHAR AS metric, NULL::VARCHAR AS unit") + ", NULL::VARCHAR AS problem"
            parts.append(f"SELECT {head}, {shown}, count(*) AS rows, {total}::DOUBLE AS total, '{name}' AS service FROM part")
    return " UNION ALL ".join(parts)


SQL["service_metrics"] = _metric_rows()


def keyed_and_delimited(spark: SparkSession, folder: str) -> DataFrame:
    """Volumes from objects by phrase and from semicolon reports."""
    part = table(spark, folder, "part").select(F.expr(f"p_partkey div {PAGE_ROWS}").alias("k"), F.concat_ws(" ", "p_name", "p_partkey").alias("phrase"), "p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("price"))
    entry = F.concat(F.to_json(F.array("phrase")), F.lit(":"), F.to_json(F.struct(F.col("phrase").alias("string"), F.col("p_size").alias("volume"), F.col("price").alias("cpc"))))
    keyed = _gathered(part, ["k"], ["p_partkey"], F.regexp_replace(entry, r'^\[(".*")\]:', "$1:")).select("k", F.concat(F.lit('{"results":{'), F.array_join("l", ","), F.lit("}}")).alias("text"))
    line = F.concat_ws(";", "phrase", "p_size", "price", F.lit("0.5"))
    report = _gathered(part, ["k"], ["p_partkey"], line).select("k", F.concat(F.lit("Keyword;Search Volume;CPC;Competition\n"), F.array_join("l", "\n")).alias("text"))
    a = responses.keyed_metrics(keyed, "k", "text").select(F.lit("keyed").alias("shape"), "metric", "unit", "value")
    b = responses.delimited_metrics(report, "k", "text").select(F.lit("delimited").alias("shape"), "metric", "unit", "value")
    return a.unionAll(b).groupBy("shape", "metric", "unit").agg(F.count("*").alias("rows"), F.count("value").alias("measured"), F.round(F.sum("value"), 2).alias("total"))


SQL["keyed_and_delimited"] = """
WITH n AS (SELECT count(*) AS rows, sum(p_size)::DOUBLE AS volume, round(sum(p_retailprice::DOUBLE), 2) AS price FROM part), o AS (SELECT sum(c * (c + 1) / 2)::DOUBLE AS ranks FROM (SELECT count(*) AS c FROM part GROUP BY p_partkey // 50))
SELECT 'keyed' AS shape, 'returned_order' AS metric, 'ordinal' AS unit, rows, rows AS measured, ranks AS total FROM n, o UNION ALL SELECT 'keyed', 'estimated_search_volume', 'searches_per_month', rows, rows, volume FROM n UNION ALL SELECT 'keyed', 'cpc', 'USD', rows, rows, price FROM n
UNION ALL SELECT 'keyed', 'paid_competition', 'index_0_1', rows, 0, NULL FROM n UNION ALL SELECT 'delimited', 'estimated_search_volume', 'searches_per_month', rows, rows, volume FROM n UNION ALL SELECT 'delimited', 'cpc', 'USD', rows, rows, price FROM n UNION ALL SELECT 'delimited', 'paid_competition', 'index_0_1', rows, rows, round(rows * 0.5, 2) FROM n"""


def result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Result pages of both shapes, one per snapshot and delivery; titles stand for suggestions."""
    rows, keys = table(spark, folder, "serp_after"), ["serp_id", "observed_at", "delivered_at"]
    flat = F.struct(F.col("rank").alias("position"), F.col("url").alias("link"), "title", "snippet")
    pages = _gathered(rows, keys, ["rank", "url", "title", "snippet"], flat).select(F.struct(*keys).alias("k"), F.to_json(F.struct(F.struct(F.lit("Success").alias("status")).alias("search_metadata"), F.col("l").alias("organic_results"), F.transform("l", lambda x: F.struct(x["title"].alias("query"))).alias("related_searches"))).alias("text"))
    typed = F.struct(F.lit("organic").alias("type"), F.col("rank").alias("rank_group"), (F.col("rank") + 2).alias("rank_absolute"), "url", "title", F.col("snippet").alias("description"))
    items = _gathered(rows, keys, ["rank", "url", "title", "snippet"], typed).select(F.struct(*keys).alias("k"), F.to_json(F.struct(F.col("l").alias("items"), F.size("l").alias("se_results_count"))).alias("text"))
    both = responses.result_page(pages, "k", "text", "flat", 10).withColumn("shape", F.lit("flat")).unionAll(responses.result_page(items, "k", "text", "typed").withColumn("shape", F.lit("typed")))
    return both.groupBy("shape", "part", "kind", "problem").agg(F.count("*").alias("rows"), F.sum("position").alias("positions"), F.count_distinct("url").alias("urls"), F.count_distinct("phrase").alias("phrases"))


SQL["result_pages"] = """
WITH p AS (SELECT *, bool_or(rank IS NULL) OVER w AS odd, row_number() OVER (PARTITION BY serp_id, observed_at, delivered_at ORDER BY rank NULLS FIRST, url NULLS FIRST, title NULLS FIRST, snippet NULLS FIRST) AS place FROM serp_after WINDOW w AS (PARTITION BY serp_id, observed_at, delivered_at))
SELECT 'flat' AS shape, 'organic' AS part, NULL AS kind, NULL AS problem, count(*) AS rows, sum(rank + 10)::BIGINT AS positions, count(DISTINCT url) AS urls, 0 AS phrases FROM p WHERE NOT odd HAVING count(*) > 0
UNION ALL SELECT 'flat', 'suggestion', 'related-search', NULL, count(*), sum(place)::BIGINT, 0, count(DISTINCT title) FROM p WHERE NOT odd HAVING count(*) > 0
UNION ALL SELECT 'flat', 'feature', 'related_searches', NULL, count(DISTINCT (serp_id, observed_at, delivered_at)), NULL, 0, 0 FROM p WHERE NOT odd HAVING count(*) > 0
UNION ALL SELECT 'flat', NULL, NULL, 'no-rank', count(DISTINCT (serp_id, observed_at, delivered_at)), NULL, 0, 0 FROM p WHERE odd HAVING count(*) > 0
UNION ALL SELECT 'typed', 'organic', NULL, NULL, count(*), sum(rank)::BIGINT, count(DISTINCT url), 0 FROM p"""


def native_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Native reports of queries, one per snapshot and delivery."""
    rows, keys = table(spark, folder, "bwt_before"), ["site_id", "observed_at", "delivered_at"]
    millis = F.unix_date("observed_at").cast("bigint") * 86_400_000
    item = F.struct(F.col("query").alias("Query"), F.concat(F.lit("/Date("), millis, F.lit(")/")).alias("Date"), F.col("clicks").alias("Clicks"), F.col("impressions").alias("Impressions"), F.col("average_click_position").alias("AvgClickPosition"), F.col("average_impression_position").alias("AvgImpressionPosition"))
    documents = _gathered(rows, keys, ["query", "clicks", "impressions"], item).select(F.struct(*keys).alias("k"), F.to_json(F.struct(F.col("l").alias("d"))).alias("text"))
    read = responses.native_performance(documents, "k", "text", "queries")
    return read.groupBy(F.col("k.site_id").alias("site_id"), "date").agg(F.count("*").alias("rows"), F.count("query").alias("queries"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.avg("average_impression_position"), 6).alias("position"), F.count("problem").alias("problems"))


SQL["native_reports"] = "SELECT site_id, observed_at AS date, count(*) AS rows, count(query) AS queries, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, round(avg(average_impression_position), 6) AS position, 0 AS problems FROM bwt_before GROUP BY ALL"


def console_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports by query and page, one per site and day."""
    rows, keys = table(spark, folder, "bwt_before"), ["site_id", "observed_at"]
    item = F.struct(F.array("query", "page").alias("keys"), "clicks", "impressions", F.try_divide("clicks", "impressions").alias("ctr"), F.col("average_impression_position").alias("position"))
    documents = _gathered(rows, keys, ["query", "page", "clicks", "impressions", "delivered_at"], item).select(F.struct(*keys).alias("k"), F.to_json(F.struct(F.col("l").alias("rows"))).alias("text"))
    read = responses.console_rows(documents, "k", "text", ["query", "page"])
    return read.groupBy("query", "page").agg(F.count("*").alias("rows"), F.sum("clicks").cast("bigint").alias("clicks"), F.sum("impressions").cast("bigint").alias("impressions"), F.round(F.sum("ctr"), 6).alias("rates"), F.count("average_position").alias("positions"))


SQL["console_reports"] = "SELECT query, page, count(*) AS rows, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, round(sum(CASE WHEN impressions <> 0 THEN clicks / impressions END), 6) AS rates, count(average_impression_position) AS positions FROM bwt_before GROUP BY ALL"


def column_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Channel reports of named columns: events of a day by user."""
    daily = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("views"), F.floor(F.sum("value")).alias("minutes"))
    values = F.array(F.col("user_id").cast("string"), F.col("minutes").cast("string"), F.col("views").cast("string"))
    names = F.lit('[{"name":"insightTrafficSourceDetail"},{"name":"estimatedMinutesWatched"},{"name":"views"}]')
    documents = _gathered(daily.withColumn("page", F.expr(f"user_id div {PAGE_ROWS}")), ["event_type", "page"], ["user_id"], values).select("event_type", F.concat(F.lit('{"columnHeaders":'), names, F.lit(',"rows":'), F.to_json("l"), F.lit("}")).alias("text"))
    read = responses.column_report(documents, "event_type", "text", "insightTrafficSourceDetail", {"views": ("attributed_views", "count"), "estimatedMinutesWatched": ("analytics_estimatedMinutesWatched", "minutes")})
    return read.groupBy("event_type", "metric", "unit").agg(F.count("*").alias("rows"), F.sum("value").alias("total"), F.count_distinct("phrase").alias("phrases"))


SQL["column_reports"] = """
WITH d AS (SELECT event_type, user_id, count(*) AS views, floor(sum(value)) AS minutes FROM events GROUP BY ALL)
SELECT event_type, 'attributed_views' AS metric, 'count' AS unit, count(*) AS rows, sum(views)::DOUBLE AS total, count(DISTINCT user_id) AS phrases FROM d GROUP BY event_type
UNION ALL SELECT event_type, 'analytics_estimatedMinutesWatched', 'minutes', count(*), sum(minutes)::DOUBLE, count(DISTINCT user_id) FROM d GROUP BY event_type"""


def platform_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of three platforms' responses, a document per minute of capture."""
    day = F.date_trunc("minute", "captured_at").alias("k")
    videos, media = table(spark, folder, "videos"), table(spark, folder, "media")
    text = lambda c: F.col(c).cast("string")
    first = F.struct(F.col("id"), F.struct("title", F.col("channel_id").alias("channelId"), "tags").alias("snippet"), F.struct(text("view_count").alias("viewCount"), text("like_count").alias("likeCount")).alias("statistics"))
    second = F.struct(F.col("id"), F.col("caption").alias("video_description"), F.col("tags").alias("hashtag_names"), text("view_count").alias("view_count"), text("like_count").alias("like_count"))
    third = F.struct(F.col("id"), "caption", "media_type", text("likes").alias("like_count"))
    order = lambda v, l: ["id", v, l, "captured_at"]
    a = _gathered(videos.select(day, "*"), ["k"], order("view_count", "like_count"), first).select("k", F.to_json(F.struct(F.col("l").alias("items"))).alias("text"))
    b = _gathered(videos.select(day, "*"), ["k"], order("view_count", "like_count"), second).select("k", F.to_json(F.struct(F.struct(F.col("l").alias("videos")).alias("data"))).alias("text"))
    c = _gathered(media.select(day, "*"), ["k"], order("likes", "caption"), third).select("k", F.to_json(F.struct(F.col("l").alias("data"))).alias("text"))
    none = F.lit(None).cast("decimal(38,0)")
    parts = [
        responses.typed_records(a, "k", "text", "youtube videos").select(F.lit("youtube videos").alias("family"), "k", "id", F.size("tags").alias("tags"), "views", "likes"),
        responses.typed_records(b, "k", "text", "tiktok research-videos").select(F.lit("tiktok research-videos").alias("family"), "k", "id", F.size("tags").alias("tags"), "views", "likes"),
        responses.typed_records(c, "k", "text", "instagram media").select(F.lit("instagram media").alias("family"), "k", "id", F.lit(None).cast("int").alias("tags"), none.alias("views"), "likes"),
    ]
    read = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return read.groupBy("family", F.year("k").alias("year")).agg(F.count("*").alias("records"), F.count_distinct("id").alias("ids"), F.sum("tags").alias("tags"), F.sum(F.col("views").cast("double")).alias("views"), F.count("likes").alias("liked"))


_FAMILY = "SELECT '{0}' AS family, year(captured_at AT TIME ZONE 'UTC') AS year, count(*) AS records, count(DISTINCT id) AS ids, {1} AS tags, {2} AS views, count({3}) AS liked FROM {4} GROUP BY ALL"
SQL["platform_records"] = " UNION ALL ".join([_FAMILY.format(f, "sum(len(tags))::BIGINT", "sum(view_count::DOUBLE)", "like_count", "videos") for f in ("youtube videos", "tiktok research-videos")] + [_FAMILY.format("instagram media", "NULL", "NULL", "likes", "media")])


def question_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as searches, nations as questions and customers' segments below them."""
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    leaf = customer.select("c_nationkey", F.col("c_mktsegment").alias("question")).distinct()
    below = _gathered(leaf, ["c_nationkey"], ["question"], F.struct("question")).withColumnRenamed("l", "results")
    tree = nation.join(below, nation.n_nationkey == below.c_nationkey, "left").select("n_regionkey", F.col("n_name").alias("question"), "results")
    query = _gathered(tree, ["n_regionkey"], ["question"], F.struct("question", "results")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    documents = query.select("r_regionkey", F.to_json(F.struct(F.lit("success").alias("status"), F.array(F.struct(F.col("r_name").alias("term"), F.col("l").alias("results"))).alias("queries"))).alias("text"))
    return responses.question_tree(documents, "r_regionkey", "text").select("r_regionkey", "position", "question", "parent", "depth")


SQL["question_trees"] = """
WITH t AS (SELECT n_regionkey AS r_regionkey, n_name AS top, NULL AS below, r_name AS parent, 1 AS depth, n_name AS question FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT n_regionkey, n_name, c_mktsegment, n_name, 2, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT r_regionkey, (row_number() OVER (PARTITION BY r_regionkey ORDER BY top, below NULLS FIRST) - 1)::INT AS position, question, parent, depth FROM t"""


def thing_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of posts by minute, each with its flair as a reply and a placeholder for more."""
    posts = table(spark, folder, "posts").select(F.date_trunc("minute", "captured_at").alias("k"), "id", "score", "num_comments", "flair")
    reply = F.struct(F.lit("t1").alias("kind"), F.struct(F.concat(F.lit("c"), "id").alias("id"), F.col("id").alias("parent_id"), F.col("flair").alias("body")).alias("data"))
    more = F.concat(F.lit('{"kind":"more","data":{"children":["m'), "id", F.lit('"]}}'))
    children = F.concat(F.lit("["), F.concat_ws(",", F.when(F.col("flair").isNotNull(), F.to_json(reply)), more), F.lit("]"))
    post = F.concat(F.lit('{"kind":"t3","data":{"id":"'), "id", F.lit('","replies":{"kind":"Listing","data":{"children":'), children, F.lit("}}}}"))
    documents = _gathered(posts, ["k"], ["id", "score", "num_comments"], post).select("k", F.concat(F.lit('{"kind":"Listing","data":{"children":['), F.array_join("l", ","), F.lit("]}}")).alias("text"))
    read = records.listing_things(documents, "k", "text")
    return read.groupBy(F.year("k").alias("year"), "kind", "depth").agg(F.count("*").alias("things"), F.count_distinct("id").alias("ids"))


SQL["thing_listings"] = """
WITH p AS (SELECT year(captured_at AT TIME ZONE 'UTC') AS year, id, flair FROM posts)
SELECT year, 't3' AS kind, 0 AS depth, count(*) AS things, count(DISTINCT id) AS ids FROM p GROUP BY year UNION ALL SELECT year, 't1', 1, count(*), count(DISTINCT id) FROM p WHERE flair IS NOT NULL GROUP BY year UNION ALL SELECT year, 'more', 1, count(*), count(DISTINCT id) FROM p GROUP BY year"""


def tool_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword payloads bare, in an envelope, twice in one, and failed, by part."""
    part = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("shape"), F.element_at(F.array(*[F.lit(m) for m in (*records.KEYWORD_MODES, "guess")]), (F.col("p_size") % 7 + 1).cast("int")).alias("mode"))
    bare = F.to_json(F.struct("mode", "p_partkey"))
    block = F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit(records.PAYLOAD_MARK), bare).alias("text")))
    text = F.when(F.col("shape") == 0, bare).when(F.col("shape") == 1, F.concat(F.lit('{"content":['), block, F.lit("]}"))).when(F.col("shape") == 2, F.concat(F.lit('{"content":['), block, F.lit(","), block, F.lit("]}"))).otherwise(F.concat(F.lit('{"isError":true,"structuredContent":'), bare, F.lit("}")))
    read = records.keyword_payloads(part.select("p_partkey", text.alias("text")), "p_partkey", "text")
    return read.groupBy("mode", "problem").agg(F.count("*").alias("documents"), F.sum(F.try_variant_get("payload", "$.p_partkey", "bigint")).alias("keys"))


SQL["tool_payloads"] = """
WITH p AS (SELECT p_partkey, p_partkey % 4 AS s, (['research', 'questions', 'matching_terms', 'country_top', 'country_search', 'rising', 'guess'])[p_size % 7 + 1] AS m FROM part),
q AS (SELECT p_partkey, m, CASE WHEN s = 3 THEN 'failed-call' WHEN s = 2 THEN 'not-one-payload' WHEN m = 'guess' THEN CASE WHEN s = 1 THEN 'not-one-payload' ELSE 'unknown-mode' END END AS problem FROM p)
SELECT CASE WHEN problem IS NULL THEN m END AS mode, problem, count(*) AS documents, sum(CASE WHEN problem IS NULL THEN p_partkey END)::BIGINT AS keys FROM q GROUP BY ALL"""


def answer_lists(spark: SparkSession, folder: str) -> DataFrame:
    """List answers made of the names of parts."""
    part = table(spark, folder, "part").withColumn("k", F.expr(f"p_partkey div {PAGE_ROWS}"))
    lines = _gathered(part, ["k"], ["p_partkey", "p_name"], F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.upper("p_name"))).select("k", F.concat(F.lit("Keywords:\n"), F.array_join("l", "\n")).alias("text"))
    return connectors.phrases_in_answer(lines, "k", "text").groupBy("phrase").agg(F.count("*").alias("answers"))


SQL["answer_lists"] = "SELECT lower(trim(p_name)) AS phrase, count(DISTINCT p_partkey // 50) AS answers FROM part GROUP BY 1"

QUERIES = [service_metrics, keyed_and_delimited, result_pages, native_reports, console_reports, column_reports, platform_records, question_trees, thing_listings, tool_payloads, answer_lists]
