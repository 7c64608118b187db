"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import ids_to_text, message_field, to_double, to_int
from ..functions.vectors import cosine_similarity, dot
from ..operators import (
    fallback, foldin, lookup, model, neighbours, onboarding, popularity, pruned, similarity, topn,
)
from ..schemas import RATINGS
from ..session import checkpointed, fresh_path, staged
from ..sources import changes, counts, layout, streams, tables
from ..streaming import messages as msg, realtime
from ..streaming.served import ServedLog
from . import views

# Cosine threshold for the given vectors: no pair of them reaches the default.
NEAR = 0.3


def _ids(recs="recs"):
    return ids_to_text(F.transform(recs, lambda rec: rec["mid"]))


# --- sources and sinks

def ratings_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files -> table -> counts per score."""
    path, name = fresh_path(spark, "ratings-csv"), f"ratings_{uuid.uuid4().hex}"
    views.ratings(spark, sf_dir).write.csv(path, header=True)
    loaded = tables.load_ratings_csv(spark, path)
    tables.save_table(loaded, name, path=fresh_path(spark, "ratings"))
    return (
        tables.read_table(spark, name).groupBy("score")
        .agg(F.count("*").alias("n"), F.sum("uid").alias("uids"), F.sum("mid").alias("mids"))
    )


def ingest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by name appended to the stored ratings, then counts per score."""
    path = fresh_path(spark, "ratings")
    views.ratings(spark, sf_dir).write.parquet(path)
    tables.ingest_ratings(
        views.rating_requests(spark, sf_dir), views.users(spark, sf_dir), path
    )
    return (
        spark.read.schema(RATINGS).parquet(path).groupBy("score")
        .agg(F.count("*").alias("n"), F.sum("uid").alias("uids"), F.sum("mid").alias("mids"))
    )


def publish_user_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.publish_user_recs(_user_recs(spark, sf_dir))


# --- popularity

def popular_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.popular_movies(views.ratings(spark, sf_dir), views.movies(spark, sf_dir))


def popular_movies_by_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.popular_movies(
        views.ratings(spark, sf_dir), views.movies(spark, sf_dir), distinct_users=True
    )


def hot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.hot_items(views.ratings(spark, sf_dir))


def popular_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items by popularity, from the partial counts of three thirds of the ratings."""
    path, ratings = fresh_path(spark, "counts"), staged(views.ratings(spark, sf_dir), "ratings")
    for third in range(3):
        counts.add_part(ratings.where(F.col("uid") % 3 == third), path, "ratings", str(third))
    return counts.places_of(counts.counts_of(spark, path, "ratings")).select("mid", "n", "place")


def rater_sketch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for sketches of raters merged over parts, counted: one for each item,
    none off by more than three standard errors."""
    path, ratings = fresh_path(spark, "counts"), staged(views.ratings(spark, sf_dir), "ratings")
    for third in range(3):
        counts.add_part(ratings.where(F.col("mid") % 2 + F.col("uid") % 2 == third), path, "ratings", str(third))
    found = counts.counts_of(spark, path, "ratings").join(
        popularity.rating_counts(ratings, distinct_users=True).withColumnRenamed("n", "exact"), "mid", "full"
    )
    near = F.abs(F.col("raters") - F.col("exact")) <= 3 * counts.ERROR * F.col("exact") + 1
    return found.agg(F.count("raters").alias("items"), F.count_if(~F.coalesce(near, F.lit(False))).alias("off"))


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.rating_histogram(views.ratings(spark, sf_dir))


def rating_histogram_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of one item, the most rated one."""
    ratings = views.ratings(spark, sf_dir)
    mid = popularity.hot_items(ratings, 1).first()["mid"]
    return popularity.rating_histogram(ratings, mid).withColumn("mid", F.lit(mid))


def rating_histograms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.rating_histograms_all(views.ratings(spark, sf_dir))


# --- lookups

def rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rating_history(
        views.users(spark, sf_dir), views.ratings(spark, sf_dir), views.movies(spark, sf_dir)
    )


def rating_history_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of three users, those with the largest ids that an event names."""
    users = views.users(spark, sf_dir)
    named = users.join(views.rating_requests(spark, sf_dir), "username", "left_semi")
    names = [row["username"] for row in named.orderBy(F.desc("id")).limit(3).collect()]
    return lookup.rating_history(
        users, views.ratings(spark, sf_dir), views.movies(spark, sf_dir), names
    )


# Parts of a laid-out table.
PARTS = 16


def _laid_out(df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    layout.write_laid_out(df, path, key, PARTS, dealt=dealt)
    return df.sparkSession.read.parquet(path)


def rating_history_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history from ratings laid out by user and names laid out by id."""
    users = views.users(spark, sf_dir)
    ratings = _laid_out(views.ratings(spark, sf_dir), "ratings-by-user", "uid")
    named = users.join(views.rating_requests(spark, sf_dir), "username", "left_semi")
    names = [row["username"] for row in named.orderBy(F.desc("id")).limit(3).collect()]
    return lookup.rating_history(users, ratings, views.movies(spark, sf_dir), names)


def resolve_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolve_users(views.users(spark, sf_dir), views.rating_requests(spark, sf_dir))


def movie_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.movie_names(views.movies(spark, sf_dir), views.rating_requests(spark, sf_dir))


def search_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each known title, looked for among all parts."""
    titles = views.titles(spark, sf_dir)
    return lookup.search_movies(titles, titles)


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys given as text, taken from two columns: numbers, and words that are none."""
    customers = views.table(spark, sf_dir, "customer")
    events = views.table(spark, sf_dir, "events")
    asked = customers.select(F.col("c_mktsegment").alias("record_id")).union(
        events.select(F.col("event_id").cast("string"))
    )
    return lookup.get_by_id(views.users(spark, sf_dir), asked).select(
        "record_id", "id", "username"
    )


# --- messages

def parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.parse_rating_messages(views.messages(spark, sf_dir))[0]


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.parse_rating_messages(views.messages(spark, sf_dir))[1]


def dropped_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model fit would leave out, were the raw messages its input."""
    value = F.col("value")
    raw = views.messages(spark, sf_dir).select(
        to_int(message_field(value, 1)).alias("uid"),
        to_int(message_field(value, 2)).alias("mid"),
        to_double(message_field(value, 3)).alias("score"),
    )
    return model.dropped_ratings(raw)


# --- similarity

def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour table as the offline job leaves it: stored."""
    return staged(similarity.similar_items(views.factors(spark, sf_dir), NEAR), "movie-recs")


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(views.factors(spark, sf_dir), NEAR)


def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = similarity.similar_items(views.factors(spark, sf_dir), NEAR)
    return items.select("mid", "start", F.size("recs").alias("n"), _ids().alias("recs"))


def top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.top_similar(_neighbours(spark, sf_dir)).select("mid", _ids().alias("recs"))


def top_similar_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists, cut to five inside the tiles."""
    items = similarity.similar_items(views.factors(spark, sf_dir), NEAR, k=5)
    return items.select("mid", _ids().alias("recs"))


def similar_items_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of vectors as they are, made from lists of earlier ones: a tenth of the
    vectors was another, a tenth wasn't there, and some have gone since."""
    now = views.factors(spark, sf_dir)
    before = now.where("id % 10 <> 0").withColumn(
        "features", F.when(F.col("id") % 10 == 1, F.reverse("features")).otherwise(F.col("features"))
    ).union(now.where("id % 10 = 2").withColumn("id", -F.col("id")))
    stored = staged(similarity.similar_items(before, NEAR), "movie-recs")
    changed = now.where("id % 10 in (0, 1)").select("id").union(
        now.where("id % 10 = 2").select(-F.col("id"))
    )
    items = neighbours.update_similar(stored, now, changed, NEAR)
    return items.select("mid", "start", F.size("recs").alias("n"), _ids().alias("recs"))


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of the two vectors named by each rating's keys."""
    vectors = views.factors(spark, sf_dir)
    pairs = views.ratings(spark, sf_dir).select("uid", "mid").distinct()
    a = vectors.select(F.col("id").alias("uid"), F.col("features").alias("a"))
    b = vectors.select(F.col("id").alias("mid"), F.col("features").alias("b"))
    return pairs.join(a, "uid").join(b, "mid").select(
        "uid", "mid", F.round(cosine_similarity("a", "b"), 6).alias("cosine")
    )


# --- factor scores and lists

def _user_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list table as the offline job leaves it: stored."""
    vectors = views.factors(spark, sf_dir)
    return staged(topn.topn_from_factors(vectors, vectors), "user-recs")


def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.factors(spark, sf_dir)
    scored = topn.factor_scores(views.ratings(spark, sf_dir), vectors, vectors)
    return scored.withColumn("prediction", F.round("prediction", 6))


def topn_from_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.factors(spark, sf_dir)
    return topn.topn_from_factors(vectors, vectors).select("uid", _ids().alias("recs"))


def topn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists, from the groups of items that each user's bound leaves."""
    vectors = views.factors(spark, sf_dir)
    return pruned.pruned_topn(vectors, vectors, side=64).select("uid", _ids().alias("recs"))


def exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without rated items, cut to ten after the exclusion."""
    vectors = views.factors(spark, sf_dir)
    lists = topn.topn_from_factors(vectors, vectors, exclude=views.ratings(spark, sf_dir))
    return lists.select("uid", _ids().alias("recs"))


def exclude_seen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items near an item the user is asked about, without those already rated. The pairs
    go from their tiles straight into the shuffle of the exclusion, without their scores."""
    pairs = similarity.similar_pairs(views.factors(spark, sf_dir), NEAR).select(
        F.col("mid").alias("uid"), F.col("other").alias("mid")
    )
    return fallback.exclude_seen(pairs, views.ratings(spark, sf_dir))


def rec_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rec_names(
        publish_user_recs(spark, sf_dir), views.movies(spark, sf_dir), "midrecs"
    )


def user_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.user_recommendations(
        views.users(spark, sf_dir), publish_user_recs(spark, sf_dir),
        views.movies(spark, sf_dir),
    )


def user_recs_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    popular = popularity.hot_items(views.ratings(spark, sf_dir), k=10)
    lists = fallback.user_recs_with_fallback(
        views.users(spark, sf_dir), _user_recs(spark, sf_dir), popular
    )
    return lists.select("uid", _ids().alias("recs"), "is_fallback")


def validate_new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onboarding.validate_new_users(
        views.name_requests(spark, sf_dir), views.registered_users(spark, sf_dir)
    )


# --- real time

def realtime_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.realtime_recs(
        parse_messages(spark, sf_dir), _neighbours(spark, sf_dir), hot_items(spark, sf_dir)
    )


def realtime_recs_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.realtime_recs(
        parse_messages(spark, sf_dir), _neighbours(spark, sf_dir),
        popularity.popular_places(views.ratings(spark, sf_dir)),
        seen=views.ratings(spark, sf_dir),
    )


def realtime_recs_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers as one micro-batch, from lists laid out by item and ratings laid
    out by user, of which the batch reads the parts that it asks for."""
    out = fresh_path(spark, "realtime")
    # Stored once, by the tasks that make them.
    lists = _laid_out(
        similarity.similar_items(views.factors(spark, sf_dir), NEAR, parts=PARTS),
        "lists-by-item", "mid", dealt=True)
    ratings = _laid_out(views.ratings(spark, sf_dir), "ratings-by-user", "uid")
    hot = staged(popularity.popular_places(views.ratings(spark, sf_dir)), "hot")
    static = realtime.Tables(lambda: lists, lambda: hot, realtime.batch_folder_sink(out),
                             ratings=lambda: ratings)
    realtime.realtime_batch(views.messages(spark, sf_dir), 0, static)
    return spark.read.parquet(out).select("uid", "mid", "score", "event_id", "recs")


def realtime_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the recommendations for every rating request; a served batch is a
    thousand messages."""
    served = realtime_recs(spark, sf_dir).select(
        "uid", "mid", "recs", F.floor(F.col("event_id") / 1000).alias("batch_id")
    )
    return lookup.realtime_lookup(
        views.rating_requests(spark, sf_dir), views.users(spark, sf_dir), served,
        views.movies(spark, sf_dir),
    )


def realtime_lookup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names from a log of served runs, merged after half of the batches."""
    answers = staged(realtime_recs(spark, sf_dir).withColumn(
        "batch_id", F.floor(F.col("event_id") / 1000)), "answers")
    log = ServedLog(spark, fresh_path(spark, "served"), query=1, parts=16)
    # The batch in the middle, of those there are, by its place.
    batches = staged(answers.select("batch_id").distinct(), "batches")
    placed = popularity.places(batches, F.col("batch_id"))
    middle = placed.where(F.col("place") == batches.count() // 2 + 1).first()
    if middle is not None:
        log.sink_all(answers.where(F.col("batch_id") <= middle["batch_id"]))
        log.compact()
        log.sink_all(answers.where(F.col("batch_id") > middle["batch_id"]))
    return lookup.realtime_lookup(
        views.rating_requests(spark, sf_dir), views.users(spark, sf_dir),
        log.read().select("uid", "mid", "recs", "batch_id"), views.movies(spark, sf_dir),
    )


def _drain(spark: SparkSession, sf_dir: str, source: DataFrame, columns: list[str],
           ratings: DataFrame | None = None) -> DataFrame:
    """Run the stream over all messages present, and read back what it wrote; with
    ``ratings`` the stream that keeps them as its state."""
    out = fresh_path(spark, "realtime")
    lists = _neighbours(spark, sf_dir)
    hot = staged(
        hot_items(spark, sf_dir) if ratings is None
        else popularity.popular_places(views.ratings(spark, sf_dir)), "hot",
    )
    static = realtime.Tables(
        movie_recs=lambda: lists, hot=lambda: hot,
        sink=realtime.batch_folder_sink(f"{out}/recs"),
        reject_sink=realtime.batch_folder_sink(f"{out}/rejects"),
        ratings=None if ratings is None else lambda: ratings,
    )
    start = realtime.start_realtime if ratings is None else realtime.start_keyed
    query = start(source, static, f"{out}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination()
    return spark.read.parquet(f"{out}/recs").select(columns)


def realtime_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the event files."""
    schema = views.table(spark, sf_dir, "events").schema
    # A pattern, since a stream's plain path has to be a folder, not one file.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return _drain(
        spark, sf_dir, views.event_messages(events), ["event_id", "uid", "mid", "score", "recs"]
    )


def realtime_stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream without rated items, which it keeps as its state."""
    schema = views.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return _drain(
        spark, sf_dir, views.event_messages(events), ["event_id", "uid", "mid", "score", "recs"],
        views.ratings(spark, sf_dir),
    )


def ratings_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the rating files themselves."""
    path = fresh_path(spark, "ratings")
    views.ratings(spark, sf_dir).write.parquet(path)
    return _drain(
        spark, sf_dir, streams.ratings_change_stream(spark, path), ["uid", "mid", "score", "recs"]
    )


def ratings_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over a feed: half of the ratings loaded, then all of them but a tenth,
    then that tenth ingested by name."""
    name, feed = f"ratings_{uuid.uuid4().hex}", fresh_path(spark, "feed")
    ratings = staged(views.ratings(spark, sf_dir), "ratings")
    late = F.col("uid") % 10 == 0
    for part in (ratings.where(~late & (F.col("uid") % 2 == 1)), ratings.where(~late)):
        version = tables.write_version(part, name, path=fresh_path(spark, "ratings"))
        changes.feed_load(spark, feed, version)
        tables.point_to(spark, {name: version})
    users = views.users(spark, sf_dir)
    asked = ratings.where(late).join(users, ratings["uid"] == users["id"]).select("username", "mid", "score")
    tables.ingest_into(
        asked, users, name, lambda rows, version: changes.feed_ingest(rows, feed, version))
    return _drain(spark, sf_dir, changes.fed_ratings(spark, feed), ["uid", "mid", "score", "recs"])


# --- evaluation

def rmse_item_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the item's mean training score on the held-out ratings."""
    train, test = model.split_ratings_by_key(views.ratings(spark, sf_dir))
    means = train.groupBy("mid").agg(F.avg("score").alias("prediction"))
    error = model.rmse(test.join(means, "mid"))
    return error.select(F.round("rmse", 6).alias("rmse"))


def _damped_mean_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the item mean drawn towards the overall mean, per strength."""
    train, test = model.split_ratings_by_key(views.ratings(spark, sf_dir))
    overall = train.agg(F.avg("score")).scalar()
    per_item = train.groupBy("mid").agg(F.count("score").alias("n"), F.sum("score").alias("s"))
    reg = F.col("reg")
    guesses = per_item.withColumn(
        "reg", F.explode(F.lit(list(model.GRID_REGS)))
    ).select("mid", "reg", ((F.col("s") + reg * overall) / (F.col("n") + reg)).alias("prediction"))
    return model.rmse(test.join(guesses, "mid"), by=["reg"])


def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _damped_mean_errors(spark, sf_dir).withColumn("rank", F.lit(0))
    return model.best_params(results).withColumn("rmse", F.round("rmse", 6))


# --- factor model

def _fitted(spark: SparkSession, sf_dir: str):
    ratings = views.ratings(spark, sf_dir)
    return ratings, model.fit_als(ratings)


def als_user_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fitted = _fitted(spark, sf_dir)
    return model.user_topn(fitted).select("uid", F.posexplode("recs").alias("pos", "rec")).select(
        "uid", (F.col("pos") + 1).alias("position"), "rec.mid", "rec.score"
    )


def als_user_topn_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings, fitted = _fitted(spark, sf_dir)
    lists = model.user_topn(fitted, exclude_seen=ratings)
    return lists.select("uid", _ids().alias("recs"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of ratings worked out once: the solver reads its rows twice."""
    return model.split_ratings_by_key(staged(views.ratings(spark, sf_dir), "ratings"))


def als_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return model.predict(model.fit_als(train), test)


def als_predict_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for predictions, counted: of the test rows, with one row of an
    unknown user and one of an unknown item put in, those whose user and item are in
    the training rows are kept, and each prediction is the product of the vectors."""
    train, test = _split(spark, sf_dir)
    strangers = test.agg(
        F.min("uid").alias("uid"), F.min("mid").alias("mid"), F.lit(1.0).alias("score")
    )
    asked = test.select("uid", "mid", "score").union(
        strangers.withColumn("uid", F.lit(-1))).union(strangers.withColumn("mid", F.lit(-1)))
    fitted = model.fit_als(train)
    found = staged(model.predict(fitted, asked), "predictions")
    own = topn.factor_scores(
        found.select("uid", "mid"), model.user_factors(fitted), model.item_factors(fitted)
    ).withColumnRenamed("prediction", "own").distinct()
    off = found.join(own, ["uid", "mid"], "left").agg(
        F.count("*").alias("kept"),
        F.count_if(F.coalesce(F.abs(F.col("own") - F.col("prediction")) > 1e-4, F.lit(True))).alias("off_product"),
    )
    return off.withColumn("cold", asked.agg(F.count("*")).scalar() - F.col("kept"))


def als_fold_in_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for users folded into a model fitted without them, a tenth of all:
    each has a vector that solves the system of the user's ratings, and a list."""
    ratings = views.ratings(spark, sf_dir)
    fitted = model.fit_als(ratings.where("uid % 10 <> 0"))
    items = model.item_factors(fitted)
    # Worked out once: what follows reads it five times.
    fresh = staged(ratings.where("uid % 10 = 0"), "fresh")
    vectors = staged(foldin.fold_in_users(fitted, fresh), "folded-users")
    # Joined by user last, by a shuffle: a user's rows are then in one place before each of
    # them becomes one row for each of its vector's components.
    rows = (
        fresh.join(items.select(F.col("id").alias("mid"), F.col("features").alias("y")), "mid")
        .join(vectors.select(F.col("id").alias("uid"), F.col("features").alias("x")).hint("merge"), "uid")
    )
    error = dot("x", "y") - F.col("score")
    sides = (
        rows.select("uid", error.alias("error"), F.posexplode(F.arrays_zip("x", "y")).alias("at", "c"))
        .groupBy("uid", "at").agg(
            F.sum(F.col("error") * F.col("c.y")).alias("side"), F.count("*").alias("n"),
            F.first("c.x").alias("x"))
    )
    off = F.abs(F.col("side") / F.col("n") + model.REG * F.col("x")) > 1e-4
    lists = foldin.new_user_topn(fitted, fresh)
    return vectors.agg(F.count("*").alias("users")).select(
        "users", lists.agg(F.sum(F.size("recs"))).scalar().alias("entries"),
        sides.agg(F.count_if(off)).scalar().alias("off_equations"),
    )


def als_grid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for a search over four points, counted: each point once, with an
    error that is a number, and the best point has the smallest."""
    found = checkpointed(model.grid_search(
        views.ratings(spark, sf_dir), ranks=(3, 5), regs=(0.05, 0.5), max_iter=3
    ))
    best = model.best_params(found).select("rmse").scalar()
    return found.agg(
        F.count_distinct("rank", "reg").alias("points"), F.count("*").alias("rows"),
        F.count_if(~(F.col("rmse") > 0)).alias("no_error"),
        F.count_if(F.col("rmse") < best).alias("better_than_best"),
    )


def als_rung_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for a search over four points in two rungs, counted: all points in
    the first, half of them in the second, with errors that are numbers, and those that
    went on had the smallest."""
    found = checkpointed(model.rung_search(
        views.ratings(spark, sf_dir), ranks=(3, 5), regs=(0.05, 0.5), rungs=(2, 4), keep=0.5
    ))
    later = found.where("iterations = 4").select("rank", "reg", F.lit(True).alias("went_on"))
    first = found.where("iterations = 2").join(later, ["rank", "reg"], "left")
    worst = F.max(F.when(F.col("went_on"), F.col("rmse")))
    best_left = F.min(F.when(F.col("went_on").isNull(), F.col("rmse")))
    return first.agg(
        F.count("*").alias("points"), F.count("went_on").alias("went_on"),
        F.count_if(~(F.col("rmse") > 0)).alias("no_error"),
        (worst > best_left).cast("int").alias("out_of_order"),
    )


def als_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fitted = _fitted(spark, sf_dir)
    items = model.model_similar_items(fitted)
    return items.select("mid", "start", F.size("recs").alias("n"), _ids().alias("recs"))


def als_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.grid_search(views.ratings(spark, sf_dir))


def als_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the model's lists, counted: one list per rating user, ten
    items each, in order, rated by somebody, scores equal to the model's own
    predictions, and no rated item in the lists without seen ones."""
    ratings, fitted = _fitted(spark, sf_dir)
    flat = checkpointed(
        model.user_topn(fitted)
        .select("uid", F.posexplode("recs").alias("pos", "rec"))
        .select("uid", "pos", "rec.mid", "rec.score")
    )
    by_place = Window.partitionBy("uid").orderBy("pos")
    stepped = flat.withColumn("above", F.lag("score").over(by_place))
    lists = stepped.agg(
        F.count_distinct("uid").alias("users"), F.count("*").alias("entries"),
        F.count_if(F.col("score") > F.col("above")).alias("out_of_order"),
    )
    unknown = flat.join(ratings.select("mid"), "mid", "left_anti").agg(
        F.count("*").alias("unknown_items")
    )
    predicted = model.predict(fitted, flat).agg(
        F.count_if(F.abs(F.col("prediction") - F.col("score")) > 1e-4).alias("off_prediction")
    )
    unseen = model.user_topn(fitted, exclude_seen=ratings).select(
        "uid", F.explode("recs.mid").alias("mid")
    )
    seen_left = unseen.join(ratings.select("uid", "mid"), ["uid", "mid"], "left_semi").agg(
        F.count("*").alias("seen_items")
    )
    return lists.select(
        "users", "entries", "out_of_order", unknown.scalar().alias("unknown_items"),
        predicted.scalar().alias("off_prediction"), seen_left.scalar().alias("seen_items"),
    )


def als_similar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the model's neighbours, counted: every rated item has a
    vector; pairs are of rated items, never of an item with itself, above the
    threshold, present both ways with one score, and equal to the column form."""
    ratings, fitted = _fitted(spark, sf_dir)
    vectors = model.item_factors(fitted)
    # Joined where they are found: pairs grow with the square of the items.
    checked = similarity.similar_pairs(vectors, joined=True)
    odd = checked.agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unknown_items"),
        F.count_if(F.col("mid") == F.col("other")).alias("self_pairs"),
        F.count_if(F.col("score") <= similarity.THRESHOLD).alias("not_above"),
        F.count_if(~F.col("score").eqNullSafe(F.col("back"))).alias("one_way"),
        F.count_if(F.abs(cosine_similarity("a", "b") - F.col("score")) > 1e-6).alias("off_score"),
    )
    items = vectors.join(ratings.select(F.col("mid").alias("id")), "id", "left_semi")
    return odd.withColumn("items", items.agg(F.count("*")).scalar())


WORKLOAD = {
    f.__name__: f
    for f in (
        ratings_load, ingest_ratings, publish_user_recs,
        popular_movies, popular_movies_by_raters, hot_items, popular_from_counts,
        rater_sketch_checks,
        rating_histogram, rating_histogram_item, rating_histograms_all,
        rating_history, rating_history_users, rating_history_laid_out, resolve_users, movie_names, search_movies, get_by_id,
        parse_messages, parse_rejects, dropped_ratings,
        similar_pairs, similar_items, similar_items_updated, top_similar, top_similar_direct, cosine_scores,
        factor_scores, topn_from_factors, topn_pruned, exclude_seen, exclude_seen_pairs,
        rec_names, user_recommendations, user_recs_with_fallback, validate_new_users,
        realtime_recs, realtime_recs_unseen, realtime_recs_laid_out, realtime_lookup,
        realtime_lookup_merged,
        realtime_stream, realtime_stream_unseen, ratings_change_stream, ratings_feed_stream,
        rmse_item_mean, best_params,
        als_user_topn, als_user_topn_unseen, als_predict, als_similar_items,
        als_grid_search, als_checks, als_similar_checks, als_predict_checks, als_grid_checks,
        als_fold_in_checks, als_rung_checks,
    )
}
