"""Queries over preferences, scores and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import dot
from ..operators import networks, quantize, ranking, search, sinks, stats
from ..sources.files import table
from ..storage import materialize
from .base import query
from .search_queries import VEC

MEMBERS = [11, 12, 13, 14]

# Scores of an ensemble: a member's score is the product with a stored vector.
SCORES = f"""
scores AS (SELECT a.vec_id AS id, m.vec_id AS member, 4 * list_dot_product(a.e, m.e) AS score FROM ({VEC}) a, ({VEC}) m WHERE m.vec_id IN (11, 12, 13, 14)),
pairs AS (SELECT vec_id AS a, vec_id + 1 AS b FROM ({VEC}) WHERE vec_id % 2 = 0),
prefs AS (SELECT a, b, x.member, 1 / (1 + exp(y.score - x.score)) AS p FROM pairs JOIN scores x ON a = x.id JOIN scores y ON b = y.id AND x.member = y.member)"""


def _scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    members = v.filter(F.col("vec_id").isin(MEMBERS)).select(F.col("vec_id").alias("member"), F.col("embedding").alias("m"))
    return v.crossJoin(F.broadcast(members)).select(F.col("vec_id").alias("id"), "member", F.lit(0).alias("channel"), (4 * dot("embedding", "m")).alias("score"))


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


@query(f"WITH {SCORES} SELECT a, b, member, round(p, 9) AS p FROM prefs")
def pref_prob(spark, sf_dir):
    s = _scores(spark, sf_dir)
    side = lambda c, n: s.select(F.col("id").alias(c), "member", F.col("score").alias(n))
    j = _pairs(spark, sf_dir).join(side("a", "x"), "a").join(side("b", "y"), ["b", "member"])
    return j.select("a", "b", "member", F.round(T.preference(F.col("x"), F.col("y")), 9).alias("p"))


@query(f"WITH {SCORES}, v AS (SELECT a, b, var_samp(p) AS variance FROM prefs GROUP BY a, b) SELECT a, b, round(variance, 9) AS variance FROM v ORDER BY v.variance DESC, a, b LIMIT 50")
def uncertain_pairs(spark, sf_dir):
    return ranking.uncertain_pairs(_pairs(spark, sf_dir), _scores(spark, sf_dir)).withColumn("variance", F.round("variance", 9))


@query(f"""
    WITH {SCORES}, m AS (SELECT id, avg(score) AS mean FROM scores GROUP BY id), r AS (SELECT id, row_number() OVER (ORDER BY mean DESC, id) AS n, count(*) OVER () AS c FROM m),
    h AS (SELECT id, row_number() OVER (ORDER BY md5('7|' || id), id) - 1 AS place FROM r WHERE n <= c // 10)
    SELECT min(id) FILTER (WHERE place % 2 = 0) AS a, min(id) FILTER (WHERE place % 2 = 1) AS b FROM h WHERE place < 40 GROUP BY place // 2 HAVING count(*) = 2""")
def top_pairs(spark, sf_dir):
    """Twenty random pairs among the best tenth by an ensemble's mean."""
    means = _scores(spark, sf_dir).groupBy("id").agg(F.avg("score").alias("mean"))
    return ranking.random_pairs(stats.top_fraction(means, [F.col("mean").desc(), F.col("id")], 10), "id", 20, seed=7)


# A network of fixed weights: members, hidden units, channels.
NETS, UNITS, CHANNELS = 2, 4, 3


def _network(dims: int) -> networks.Ensemble:
    hidden = np.sin(np.arange(NETS * UNITS * dims)).reshape(NETS, UNITS, dims)
    out = np.sin(0.5 + np.arange(NETS * CHANNELS * UNITS)).reshape(NETS, CHANNELS, UNITS)
    return networks.Ensemble([hidden, out], [np.cos(np.arange(NETS * UNITS)).reshape(NETS, UNITS), np.zeros((NETS, CHANNELS))])


@query(f"""
    WITH z AS (
      SELECT vec_id, m, h, list_dot_product(e, list_transform(range(len(e)), lambda k: sin((m * {UNITS} + h) * len(e) + k))) + cos(m * {UNITS} + h) AS z
      FROM ({VEC}), range({NETS}) t(m), range({UNITS}) u(h)
    ), a AS (SELECT *, 1 / (1 + exp(-z)) AS s FROM z
    ), out AS (SELECT m, c, h, sin(0.5::DOUBLE + (m * {CHANNELS} + c) * {UNITS} + h) AS w FROM range({NETS}) t(m), range({CHANNELS}) u(c), range({UNITS}) v(h)
    ), scores AS (SELECT vec_id, m, c, sum(z * s * w) AS score FROM a JOIN out USING (m, h) GROUP BY ALL
    ), pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, x.e) AS xx, list_dot_product(y.e, y.e) AS yy, list_dot_product(x.e, y.e) AS xy
                 FROM ({VEC}) x JOIN ({VEC}) y ON y.vec_id = x.vec_id + 1
    ), g AS (SELECT a, b, p.m, p.c, (1 / (1 + exp(q.score - p.score)) - 0.95) / {CHANNELS} AS g
             FROM pairs JOIN scores p ON p.vec_id = a JOIN scores q ON q.vec_id = b AND q.m = p.m AND q.c = p.c
    ), back AS (SELECT a, b, m, h, sum(g * w) AS v FROM g JOIN out USING (m, c) GROUP BY ALL
    ), sides AS (
      SELECT back.a, back.b, m, h, p.z * p.s - q.z * q.s AS gap, v * p.s * (1 + p.z * (1 - p.s)) AS u1, -v * q.s * (1 + q.z * (1 - q.s)) AS u2
      FROM back JOIN a p USING (m, h) JOIN a q USING (m, h) WHERE p.vec_id = back.a AND q.vec_id = back.b
    ), norms AS (
      SELECT a, b, m, sqrt(sum(gap * gap)) AS gap, sqrt(sum((u1 + u2) * (u1 + u2))) AS bias,
             sqrt(sum(u1 * u1) * any_value(xx) + sum(u2 * u2) * any_value(yy) + 2 * sum(u1 * u2) * any_value(xy)) AS weight
      FROM sides JOIN pairs USING (a, b) GROUP BY a, b, m
    ), n AS (
      SELECT norms.a, norms.b, sum(gap * gs + bias + weight) / {NETS} AS norm
      FROM norms JOIN (SELECT a, b, m, sqrt(sum(g * g)) AS gs FROM g GROUP BY a, b, m) USING (a, b, m) GROUP BY norms.a, norms.b
    ) SELECT a, b, round(norm, 9) AS norm FROM n ORDER BY n.norm DESC, a, b LIMIT 50""")
def steep_pairs(spark, sf_dir):
    """Pairs by the norm of the gradient that rating them would give a network of one hidden layer."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("x1"))
    pairs = x.join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("x2")), "b")
    return networks.steep_pairs(pairs, _network(_dims(spark, sf_dir))).withColumn("norm", F.round("norm", 9))


@query(f"""
    WITH {SCORES}, m AS (SELECT id, avg(score) AS mean FROM scores GROUP BY id), r AS (SELECT id, mean, row_number() OVER (ORDER BY mean DESC, id) AS n, count(*) OVER () AS c FROM m)
    SELECT id, round(mean, 9) AS mean FROM r WHERE n <= c // 20""")
def top_fraction(spark, sf_dir):
    """The best twentieth by an ensemble's mean."""
    m = _scores(spark, sf_dir).groupBy("id").agg(F.avg("score").alias("mean"))
    return stats.top_fraction(m, [F.col("mean").desc(), F.col("id")], 20).select("id", F.round("mean", 9).alias("mean"))


RATED = "SELECT 'd' || doc_id AS meme1, 'd' || (doc_id + 1) AS meme2, CASE doc_id % 4 WHEN 0 THEN '1,1+,eq' WHEN 1 THEN '2,2+,eq' WHEN 2 THEN '1p,2p,1' ELSE 'eq,eq,2' END AS rating FROM labels"


def _rated(spark, sf_dir):
    d = F.col("doc_id")
    rating = F.when(d % 4 == 0, "1,1+,eq").when(d % 4 == 1, "2,2+,eq").when(d % 4 == 2, "1p,2p,1").otherwise("eq,eq,2")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), d).alias("meme1"), F.concat(F.lit("d"), d + 1).alias("meme2"), rating.alias("rating"))


@query(f"""
    WITH r AS ({RATED}), m AS (SELECT meme1, unnest(string_split(rating, ',')) AS k, unnest(range(3)) AS pos FROM r)
    SELECT meme1, pos, CASE k WHEN '1' THEN 0.9::DOUBLE WHEN '1+' THEN 0.7 WHEN '1p' THEN 0.7 WHEN 'eq' THEN 0.5 WHEN '2+' THEN 0.3 WHEN '2p' THEN 0.3 ELSE 0.1 END AS strength FROM m""")
def rating_decode(spark, sf_dir):
    r = _rated(spark, sf_dir).select("meme1", F.posexplode(T.ratings(F.col("rating"))).alias("pos", "strength"))
    return r.withColumn("pos", F.col("pos").cast("long"))


@query(f"""
    WITH r AS ({RATED}), f AS (SELECT 'd' || vec_id AS name, e FROM ({VEC}))
    SELECT meme1, meme2, rating, round(list_dot_product(a.e, b.e), 9) AS score FROM r JOIN f a ON meme1 = a.name JOIN f b ON meme2 = b.name""")
def rated_pairs(spark, sf_dir):
    files = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("filename"), "embedding")
    j = ranking.rated_pairs(_rated(spark, sf_dir), files)
    return j.select("meme1", "meme2", "rating", F.round(dot("embedding1", "embedding2"), 9).alias("score"))


@query(f"""
    WITH r AS ({RATED}), c AS (SELECT 'd' || doc_id AS meme1, 'd' || (doc_id - 1) AS meme2 FROM documents UNION ALL SELECT 'd' || doc_id, 'd' || (doc_id + 2) FROM documents),
    d AS (SELECT meme1, meme2 FROM r UNION SELECT meme2, meme1 FROM r)
    SELECT c.meme1, c.meme2 FROM c LEFT JOIN d ON c.meme1 = d.meme1 AND c.meme2 = d.meme2 WHERE d.meme1 IS NULL""")
def unrated_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda k: F.concat(F.lit("d"), F.col("doc_id") + k)
    c = d.select(name(0).alias("meme1"), name(-1).alias("meme2")).union(d.select(name(0), name(2)))
    return ranking.unrated(c, _rated(spark, sf_dir))


HIDDEN, OUTPUTS, FEATURES = 128, 3, 256


def _waves(rows: int, columns: int, start: float = 0.0) -> np.ndarray:
    """Fixed weights that SQL can make as well."""
    return np.sin(start + np.arange(rows * columns)).reshape(rows, columns)


def _model(dims: int) -> ranking.ScoreModel:
    return ranking.ScoreModel(_waves(HIDDEN, dims), np.cos(np.arange(HIDDEN)), _waves(OUTPUTS, HIDDEN, 0.5) / HIDDEN)


def _dims(spark, sf_dir) -> int:
    return len(table(spark, sf_dir, "embeddings").first()["embedding"])


MODEL = f"""
hidden AS (
  SELECT vec_id, h, d, a / (1 + exp(-a)) AS s FROM (
    SELECT vec_id, h, len(e) AS d, list_dot_product(e, list_transform(range(len(e)), lambda k: sin(h * len(e) + k))) + cos(h) AS a FROM ({VEC}), range({HIDDEN}) t(h))
), outputs AS (
  SELECT vec_id, o AS output, sum(s * sin(0.5::DOUBLE + o * {HIDDEN} + h) / {HIDDEN}) * any_value(d) / {HIDDEN} AS score FROM hidden, range({OUTPUTS}) u(o) GROUP BY vec_id, o
)"""


@query(f"WITH {MODEL} SELECT vec_id, output, round(score, 9) AS score FROM outputs")
def score_model(spark, sf_dir):
    """Three outputs of a wide model with fixed weights."""
    s = ranking.scored(table(spark, sf_dir, "embeddings"), _model(_dims(spark, sf_dir)))
    out = s.select("vec_id", F.posexplode("scores").alias("output", "score"))
    return out.select("vec_id", F.col("output").cast("long").alias("output"), F.round("score", 9).alias("score"))


@query(f"""
    WITH {MODEL}, s AS (SELECT vec_id, max(score) FILTER (WHERE output = 0) AS s0, max(score) FILTER (WHERE output = 1) AS s1 FROM outputs GROUP BY vec_id),
    z AS (SELECT quantile_cont(s0, list_transform(range(255), lambda k: k / 254.0::DOUBLE)) AS c0, quantile_cont(s1, list_transform(range(255), lambda k: k / 254.0::DOUBLE)) AS c1 FROM s)
    SELECT vec_id AS id, len(list_filter(c0, lambda q: round(q, 9) < round(s0, 9))) AS d0, len(list_filter(c1, lambda q: round(q, 9) < round(s1, 9))) AS d1,
           vec_id % 50 = 0 OR round(s0, 9) < round(c0[26], 9) AS dead, CASE WHEN vec_id % 50 = 0 OR round(s0, 9) < round(c0[26], 9) THEN '' ELSE 'https://x/' || vec_id END AS url
    FROM s, z""")
def packed_index(spark, sf_dir):
    """Descriptor codes of an index and its dead rows: those dead before and those with a low score."""
    s = ranking.scored(table(spark, sf_dir, "embeddings"), _model(_dims(spark, sf_dir)))
    exact = s.withColumns({"s0": F.col("scores")[0], "s1": F.col("scores")[1]})
    # both sides are rounded: a quantile that falls on a value is not below it
    cdfs = {k: [round(q, 9) for q in stats.cdf(exact, f"s{k}").first()["cdf"]] for k in (0, 1)}
    nodes = s.select(
        F.col("vec_id").alias("id"), "embedding", F.array().cast("array<long>").alias("neighbours"), F.lit(0).cast("long").alias("timestamp"),
        F.transform("scores", lambda x: F.round(x, 9)).alias("scores"),
        F.concat(F.lit("https://x/"), "vec_id").alias("url"), F.array(F.col("label")).alias("shards"), (F.col("vec_id") % 50 == 0).alias("dead"),
    )
    index = sinks.packed(nodes, cdfs, {0: float(cdfs[0][25])})
    return index.select("id", F.col("descriptors")[0].cast("long").alias("d0"), F.col("descriptors")[1].cast("long").alias("d1"), "dead", "url")


@query(f"""
    WITH a AS (SELECT vec_id, f, greatest(0, list_dot_product(e, list_transform(range(len(e)), lambda k: sin(f * len(e) + k)))) AS x FROM ({VEC}), range({FEATURES}) t(f)),
    r AS (SELECT *, nth_value(x, 9) OVER (PARTITION BY vec_id ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM a)
    SELECT f AS feature, count(*) AS n FROM r WHERE x > cut GROUP BY f""")
def sparse_features(spark, sf_dir):
    """How often each feature of a fixed sparse autoencoder is active."""
    d = _dims(spark, sf_dir)
    up = _waves(FEATURES, d)
    model = ranking.SparseAutoencoder(up, np.zeros(FEATURES), up.T / FEATURES, np.zeros(d), 8)
    return ranking.feature_frequency(ranking.feature_table(table(spark, sf_dir, "embeddings"), model))


def preference_pairs(v, targets=(1, 2, 3)):
    """``id, x1, x2, p``: consecutive vectors, and how three stored vectors prefer between them."""
    pairs = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x1")).join(v.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("x2")), "id")
    wanted = v.filter(F.col("vec_id").isin(*targets)).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("_t"))
    return pairs.crossJoin(F.broadcast(wanted)).withColumn("p", F.transform("_t", lambda t: T.preference(8 * dot("x1", t["embedding"]), 8 * dot("x2", t["embedding"])))).drop("_t")


@query()
def preference_model(spark, sf_dir):
    """Networks trained on four fifths of all pairs: on the others, how many a channel orders rightly, and its cross entropy."""
    rows = materialize(preference_pairs(table(spark, sf_dir, "embeddings")))
    model = networks.Ensemble.fresh(_dims(spark, sf_dir), members=4)
    model = networks.train(rows.filter("id % 5 != 0"), model, epochs=4, batches=4, rate=1e-2)
    held = networks.judged(rows.filter("id % 5 = 0"), model).join(rows.select("id", F.posexplode("p").alias("channel", "p")), ["id", "channel"])
    loss = -(F.col("p") * F.ln("chance") + (1 - F.col("p")) * F.ln(1 - F.col("chance")))
    right = ((F.col("chance") > 0.5) == (F.col("p") > 0.5)).cast("double")
    return held.groupBy("channel").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(loss), 6).alias("loss"))


@query()
def chain_quantizer(spark, sf_dir):
    """Errors over all vectors of additive codebooks along a chain, and of the first codebook alone; a sample fits them."""
    v = table(spark, sf_dir, "embeddings")
    x = quantize.sample_matrix(v, 2000)
    errors = quantize.decoded_error(v, {k: quantize.ChainQuantizer.train(x, s, 16, 2) for k, s in (("one", 1), ("four", 4))})
    return errors.select("n", *[F.round(k, 6).alias(k) for k in ("one", "four")])


def _one_bit(v):
    """A one-bit quantizer whose rotation SQL can make too, around the mean of the first hundred vectors."""
    first = v.filter("vec_id < 100").agg(*[F.avg(F.get("embedding", k)).alias(f"x{k}") for k in range(len(v.first()["embedding"]))]).first()
    return quantize.OneBitQuantizer(np.array(first), turn=quantize.hadamard(len(first)))


@query(f"""
    WITH m AS (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC}) WHERE vec_id < 100) GROUP BY pos)),
    c AS (SELECT vec_id, list_transform(e, lambda x, j: x - m[j]) AS c, len(e) AS d FROM ({VEC}), m),
    u AS (SELECT vec_id, d, sqrt(list_dot_product(c, c)) AS norm, list_transform(range(d), lambda i: list_dot_product(c, list_transform(range(d), lambda j: (1 - 2 * (bit_count(i & j) % 2)) * (1 - 2 * CAST(j % 3 = 0 AS INTEGER)) / sqrt(d)))) AS y FROM c)
    SELECT vec_id, array_to_string(list_transform(y, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS signs, round(norm, 9) AS norm,
           round(list_sum(list_transform(y, lambda x: abs(x))) / norm / sqrt(d), 9) AS align FROM u""")
def one_bit_codes(spark, sf_dir):
    """Codes as they are packed: a word's bits from the lowest."""
    v = table(spark, sf_dir, "embeddings")
    coded = quantize.one_bit_codes(v, _one_bit(v))
    signs = F.array_join(F.transform("code", lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))), "")
    return coded.select("vec_id", F.substring(signs, 1, _dims(spark, sf_dir)).alias("signs"), F.round("norm", 9).alias("norm"), F.round("align", 9).alias("align"))


@query()
def one_bit_quantizer(spark, sf_dir):
    """Search by one-bit codes for every fiftieth vector, a tenth of the vectors scored exactly: recall of the ten nearest, and how estimates follow exact products."""
    v = table(spark, sf_dir, "embeddings")
    q = _one_bit(v)
    coded = materialize(quantize.one_bit_codes(v, q))
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    widen = max(10, v.count() // 100)
    found = quantize.one_bit_batch_top_k(coded, v, asked, q, 10, widen)
    recall = stats.recall(search.batch_top_k(v, asked, 10), found, 10)
    x = np.array(v.filter("vec_id = 0").first()["embedding"], np.float64)
    pairs = coded.join(v, "vec_id").select(quantize.one_bit_estimate(q, x).alias("estimate"), dot("embedding", F.array(*[F.lit(float(c)) for c in x])).alias("exact"))
    follows = pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("estimate", "exact"), 6).alias("correlation"))
    return recall.select("queries", F.round("recall", 6).alias("recall")).crossJoin(F.broadcast(follows))


@query(f"""
    WITH d AS (SELECT vec_id // 100 AS direction, e FROM ({VEC}) WHERE vec_id IN (0, 100, 200)),
    s AS (SELECT direction, side, v.vec_id, sign * list_dot_product(d.e, v.e) AS score FROM d, (VALUES ('max', 1), ('min', -1)) t(side, sign), ({VEC}) v),
    r AS (SELECT *, row_number() OVER (PARTITION BY direction, side ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT direction, side, vec_id, rank, round(score, 9) AS score FROM r WHERE rank <= 10""")
def signed_exemplars(spark, sf_dir):
    """Vectors furthest along and against three directions."""
    v = table(spark, sf_dir, "embeddings")
    directions = np.array([r.embedding for r in v.filter("vec_id IN (0, 100, 200)").orderBy("vec_id").select("embedding").collect()], np.float64)
    return ranking.signed_exemplars(v, directions, 10).withColumn("score", F.round("score", 9))
