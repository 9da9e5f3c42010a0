"""Windows over users' events and over embeddings read as frames and signals; schedules, parameters and genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import activations, arrays, schedules
from ..operators import lifecycle as L
from ..operators import sequences as S
from ..streaming import windows
from .common import Registry, r6, read, rounded

query = Registry()


def events(spark, sf_dir):
    """Each user's events numbered from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.row_number().over(w) - 1).alias("t"))


EVENTS = "(SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"


def frames(spark, sf_dir):
    """Embeddings as grey frames of 64 values from 0 to 255, ten sequences of them."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor((F.tanh(x) + 1) * 127.5).cast("double"))
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("seq"), F.floor(F.col("vec_id") / 10).alias("pos"), v.alias("frame"))


FRAMES = "(SELECT vec_id % 10 AS seq, vec_id // 10 AS pos, list_transform(embedding, lambda x: floor((tanh(x::DOUBLE) + 1) * 127.5)) AS frame FROM embeddings)"
LAGGED = f"(SELECT *, lag(frame) OVER (PARTITION BY seq ORDER BY pos) AS prev FROM {FRAMES})"
PAIR = "list_transform(list_zip(frame, prev), lambda z: {})"


@query("frame_difference", f"SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS difference FROM {EVENTS}")
def frame_difference(spark, sf_dir):
    return rounded(S.frame_differences(events(spark, sf_dir), "user_id", "t", "value").select("event_id", "difference"), "difference")


@query("rolling_variance", f"SELECT event_id, round(var_pop(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS variance FROM {EVENTS}")
def rolling_variance(spark, sf_dir):
    return S.rolling_variance(events(spark, sf_dir), "user_id", "t", "value").select("event_id", r6("variance").alias("variance"))


@query(
    "transition_detect",
    f"WITH d AS (SELECT event_id, user_id, t, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, count(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n, avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, round(abs(a - b), 4) AS shift FROM d WHERE n = 5 AND abs(a - b) > 40",
)
def transition_detect(spark, sf_dir):
    return S.transitions(events(spark, sf_dir), "user_id", "t", "value", 5, 40.0).select("event_id", F.round("shift", 4).alias("shift"))


@query("adaptive_threshold", f"SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id) + 2 * stddev_pop(value) OVER (PARTITION BY user_id) AS l FROM {EVENTS}) WHERE value > l")
def adaptive_threshold(spark, sf_dir):
    return S.adaptive_boundaries(events(spark, sf_dir), "user_id", "value").select("event_id")


@query(
    "two_pass_boundaries",
    "WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER w AS t, abs(value - lag(value) OVER w) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t) AS r FROM e WHERE d IS NULL OR d > 30), k AS (SELECT user_id, r, value AS last, 1 AS n FROM m WHERE r = 1 UNION ALL SELECT m.user_id, m.r, CASE WHEN abs(m.value - k.last) > 70 THEN m.value ELSE k.last END, CASE WHEN abs(m.value - k.last) > 70 THEN k.n + 1 ELSE k.n END FROM k JOIN m ON m.user_id = k.user_id AND m.r = k.r + 1) SELECT user_id, max(n)::INTEGER AS n FROM k GROUP BY 1",
)
def two_pass_boundaries(spark, sf_dir):
    return S.two_pass_boundaries(events(spark, sf_dir), "user_id", "t", "value", 30.0, 70.0).select("user_id", F.size("kept").alias("n"))


@query("keyframes", f"SELECT seq, pos FROM (SELECT seq, pos, prev, list_avg({PAIR.format('abs(z[1] - z[2])')}) AS c FROM {LAGGED}) WHERE prev IS NULL OR c > 75")
def keyframes(spark, sf_dir):
    return S.keyframes(frames(spark, sf_dir), "seq", "pos", "frame", 75.0).select("seq", "pos")


@query("motion_energy", f"SELECT seq, pos, CASE WHEN prev IS NOT NULL THEN round(list_avg({PAIR.format('pow(z[1] - z[2], 2)')}), 4) END AS energy FROM {LAGGED}")
def motion_energy(spark, sf_dir):
    return S.motion_energy(frames(spark, sf_dir), "seq", "pos", "frame").select("seq", "pos", F.round("energy", 4).alias("energy"))


HIST = "list_transform(range(0, 8), lambda b: len(list_filter({f}, lambda v: least(floor(v / 32), 7) = b)) / len({f}))"


@query("histogram", f"SELECT seq, pos, array_to_string(list_transform({HIST.format(f='frame')}, lambda x: round(x * 64)::BIGINT), ' ') AS counts FROM {FRAMES}")
def histogram(spark, sf_dir):
    h = F.transform(S.histogram(F.col("frame"), 8), lambda x: F.round(x * 64).cast("long").cast("string"))
    return frames(spark, sf_dir).select("seq", "pos", F.array_join(h, " ").alias("counts"))


@query(
    "scene_detect",
    f"WITH h AS (SELECT seq, pos, {HIST.format(f='frame')} AS h FROM {FRAMES}), d AS (SELECT seq, pos, h, lag(h) OVER (PARTITION BY seq ORDER BY pos) AS p FROM h), x AS (SELECT seq, pos, p, 0.5 * list_sum(list_transform(list_zip(h, p), lambda z: pow(z[1] - z[2], 2) / (z[1] + z[2] + 1e-10))) AS distance FROM d) SELECT seq, pos, CASE WHEN p IS NOT NULL THEN round(distance, 6) END AS distance FROM x WHERE p IS NULL OR distance > 0.1",
)
def scene_detect(spark, sf_dir):
    return rounded(S.scenes(frames(spark, sf_dir), "seq", "pos", "frame", 0.1, "histogram", 8).select("seq", "pos", "distance"), "distance")


@query("brightness_events", f"SELECT seq, pos, round(list_avg(frame) / 255, 6) AS brightness, list_avg(frame) / 255 > 0.55 OR list_avg(frame) / 255 < 1 - 0.55 AS flash, list_avg(frame) / 255 < 0.47 AS black FROM {FRAMES}")
def brightness_events(spark, sf_dir):
    return rounded(S.brightness_events(frames(spark, sf_dir), "frame", 0.55, 0.47).select("seq", "pos", "brightness", "flash", "black"), "brightness")


@query("frame_statistics", f"SELECT seq, pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, median(x) AS median FROM (SELECT seq, pos, unnest(frame) AS x FROM {FRAMES}) GROUP BY 1, 2")
def frame_statistics(spark, sf_dir):
    return rounded(S.frame_statistics(frames(spark, sf_dir), ["seq", "pos"], "frame"), "mean", "std")


@query("temporal_shift", f"SELECT event_id, (t + 3) % count(*) OVER (PARTITION BY user_id) AS t FROM {EVENTS}")
def temporal_shift(spark, sf_dir):
    return S.temporal_shift(events(spark, sf_dir), "user_id", "t", 3).select("event_id", F.col("t").cast("long").alias("t"))


@query("reverse_temporal", f"SELECT event_id, count(*) OVER (PARTITION BY user_id) - 1 - t AS t FROM {EVENTS}")
def reverse_temporal(spark, sf_dir):
    return S.reverse_temporal(events(spark, sf_dir), "user_id", "t").select("event_id", F.col("t").cast("long").alias("t"))


@query("temporal_interpolation", f"WITH n AS (SELECT user_id, t, value, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM {EVENTS}) SELECT user_id, t * 2 AS t, round(value, 6) AS value FROM n UNION ALL SELECT user_id, t * 2 + 1, round((value + nx) / 2, 6) FROM n WHERE nx IS NOT NULL")
def temporal_interpolation(spark, sf_dir):
    out = S.interpolated(events(spark, sf_dir), "user_id", "t", "value", 2)
    return rounded(out.withColumn("t", F.col("t").cast("long")), "value")


def signals(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


SIGNALS = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


@query("framing_energy", f"WITH f AS (SELECT vec_id, unnest(range(0, 49, 16)) AS s, x FROM {SIGNALS}) SELECT vec_id, s // 16 AS frame, round(list_sum(list_transform(x[s + 1:s + 16], lambda v: v * v)), 6) AS energy FROM f")
def framing_energy(spark, sf_dir):
    rows = signals(spark, sf_dir).select("vec_id", F.posexplode(S.framed(F.col("x"), 16, 16)).alias("frame", "f"))
    return rows.select("vec_id", F.col("frame").cast("long").alias("frame"), r6(S.energy(F.col("f"))).alias("energy"))


@query("zero_crossing", f"SELECT vec_id, round(list_sum(list_transform(list_zip(x[2:64], x[1:63]), lambda z: CASE WHEN sign(z[1]) <> sign(z[2]) THEN 1.0 ELSE 0.0 END)) / 64, 6) AS zcr FROM {SIGNALS}")
def zero_crossing(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", r6(S.zero_crossing_rate(F.col("x"))).alias("zcr"))


@query("signal_statistics", f"WITH s AS (SELECT vec_id, list_avg(x) AS mean, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM {SIGNALS}) SELECT vec_id, round(mean, 6) AS mean, round(rms, 6) AS rms, round(peak, 6) AS peak, round(peak / (rms + 1e-10), 6) AS crest FROM s")
def signal_statistics(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", *[r6(c).alias(n) for n, c in S.signal_statistics(F.col("x")).items()])


@query("array_algebra", f"SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS dot, round(list_sum(list_transform(x, lambda v: exp(v))), 6) AS exps, round(list_sum(list_transform(x, lambda v: abs(v) * 2 - 1)), 6) AS total, round(x[9], 6) AS item FROM {SIGNALS}")
def array_algebra(spark, sf_dir):
    x = F.col("x")
    total = arrays.total(arrays.subtract(arrays.multiply(arrays.absolute(x), 2.0), 1.0))
    return signals(spark, sf_dir).select("vec_id", r6(arrays.dot(x, x)).alias("dot"), r6(arrays.total(arrays.exp(x))).alias("exps"), r6(total).alias("total"), r6(arrays.item(arrays.transpose(arrays.reshape(x, 8))[0], 1)).alias("item"))


@query("matrix_product", "WITH a AS (SELECT vec_id AS k, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT x.i, y.i AS j, round(sum(x.v * y.v), 6) AS v FROM a x JOIN a y ON x.k = y.k GROUP BY 1, 2")
def matrix_product(spark, sf_dir):
    """The product of all embeddings' matrix, transposed, with itself."""
    rows = signals(spark, sf_dir).select(F.col("vec_id").alias("k"), F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    return rounded(arrays.matmul(rows.select("i", F.col("k").alias("j"), "v"), rows.select(F.col("k").alias("i"), F.col("i").alias("j"), "v")), "v")


@query(
    "activations",
    "SELECT event_id, round(greatest(x, 0), 6) AS relu, round(CASE WHEN x > 0 THEN x ELSE x * 0.01 END, 6) AS leaky_relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS gelu, round(ln(1 + exp(x)), 6) AS softplus FROM (SELECT event_id, value / 50 - 3 AS x FROM events)",
)
def activations_query(spark, sf_dir):
    x = F.col("value") / 50 - 3
    return read(spark, sf_dir, "events").select("event_id", *[r6(activations.get_activation(n)(x)).alias(n) for n in ("relu", "leaky_relu", "sigmoid", "tanh", "gelu", "softplus")])


@query("softmax", f"SELECT vec_id, round(exp(x[1]) / list_sum(list_transform(x, lambda v: exp(v))), 9) AS first FROM {SIGNALS}")
def softmax(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", F.round(activations.softmax(F.col("x"))[0], 9).alias("first"))


@query("lr_schedules", "SELECT e AS epoch, round(0.1 * pow(0.5, e // 10), 9) AS step, round(0.1 * pow(0.95, e), 9) AS exponential, round(0.001 + 0.099 * (1 + cos(pi() * e / 50)) / 2, 9) AS cosine FROM (SELECT DISTINCT p_size AS e FROM part)")
def lr_schedules(spark, sf_dir):
    e = F.col("p_size")
    rates = {"step": schedules.step_lr(0.1, e, 10, 0.5), "exponential": schedules.exponential_lr(0.1, e, 0.95), "cosine": schedules.cosine_lr(0.1, e, 50, 0.001)}
    return read(spark, sf_dir, "part").select(e.alias("epoch"), *[F.round(c, 9).alias(n) for n, c in rates.items()]).distinct()


@query(
    "early_stopping",
    f"WITH m AS (SELECT user_id, t, value, min(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {EVENTS}), i AS (SELECT user_id, t, value, b IS NULL OR value < b AS better FROM m), g AS (SELECT *, max(CASE WHEN better THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS last FROM i), s AS (SELECT user_id, min(t) AS stop_epoch FROM g WHERE t - last >= 7 GROUP BY 1) SELECT g.user_id, any_value(stop_epoch) AS stop_epoch, max(CASE WHEN better THEN t END) AS best_epoch, round(min(value), 6) AS best FROM g LEFT JOIN s USING (user_id) WHERE stop_epoch IS NULL OR t <= stop_epoch GROUP BY 1",
)
def early_stopping(spark, sf_dir):
    return rounded(schedules.early_stopping(events(spark, sf_dir), "user_id", "t", "value", 7), "best")


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    out = windows.windowed(read(spark, sf_dir, "events"), "ts", "value", ["event_type"], "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("mean").alias("mean"), F.round("variance", 4).alias("variance"), "low", "high")


@query(
    "session_events",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
)
def session_events(spark, sf_dir):
    out = windows.sessions(read(spark, sf_dir, "events"), "ts", ["user_id"], "12 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def updates(spark, sf_dir):
    """Order lines as updates of clients: supplier, line number as the parameter, discount as the change."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("client_id"), (F.col("l_linenumber") % 3).alias("param"), F.col("l_linenumber").alias("idx")).agg(F.avg("l_discount").alias("delta"), F.count("*").alias("n"))


UPDATES = "(SELECT l_suppkey AS client_id, l_linenumber % 3 AS param, l_linenumber AS idx, avg(l_discount) AS delta, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"


@query("fedavg", f"SELECT param, idx, round(sum(delta * n) / sum(n), 9) AS value FROM {UPDATES} GROUP BY 1, 2")
def fedavg(spark, sf_dir):
    return L.fedavg(updates(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query("fedavg_clipped", f"SELECT client_id, idx, round(delta / greatest(sqrt(sum(delta * delta) OVER (PARTITION BY client_id, param)) / 0.05, 1), 9) AS delta FROM {UPDATES}")
def fedavg_clipped(spark, sf_dir):
    return L.clipped(updates(spark, sf_dir), 0.05).select("client_id", "idx", F.round("delta", 9).alias("delta"))


@query(
    "quantize_int8",
    "WITH r AS (SELECT p_partkey, p_brand, p_retailprice AS x, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi FROM part), s AS (SELECT *, (hi - lo) / 255 AS scale FROM r), q AS (SELECT *, -lo / scale - 128 AS zero FROM s) SELECT p_partkey, round(scale, 9) AS scale, CAST(greatest(least(round_even(x / scale + zero, 0), 127), -128) AS INTEGER) AS q FROM q",
)
def quantize_int8(spark, sf_dir):
    out = L.quantized(read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("value")), ["p_brand"])
    return out.select("p_partkey", F.round("scale", 9).alias("scale"), "q")


@query("magnitude_prune", "SELECT p_partkey, CASE WHEN rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY p_brand) * 0.3)) THEN p_retailprice ELSE 0.0 END AS value FROM part")
def magnitude_prune(spark, sf_dir):
    return L.pruned(read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("value")), ["p_brand"], sparsity=0.7).select("p_partkey", "value")


@query("ensemble_mean_var", "SELECT l_suppkey, round(avg(l_tax), 6) AS mean, round(var_pop(l_tax), 6) AS variance FROM lineitem GROUP BY 1")
def ensemble_mean_var(spark, sf_dir):
    return rounded(L.ensemble(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_tax"), "mean", "variance")


@query("genome_distance", "WITH a AS (SELECT DISTINCT p_partkey AS i, p_retailprice AS x FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS i, p_size / 10 AS y FROM part WHERE p_partkey % 3 = 0), e AS (SELECT least((SELECT max(i) FROM a), (SELECT max(i) FROM b)) AS e), j AS (SELECT * FROM a FULL JOIN b USING (i), e) SELECT round((count(*) FILTER ((x IS NULL OR y IS NULL) AND i > e) + count(*) FILTER ((x IS NULL OR y IS NULL) AND i <= e)) / greatest(count(x), count(y)) + 0.4 * avg(abs(x - y)), 6) AS distance FROM j")
def genome_distance(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    one = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("innovation"), F.col("p_retailprice").alias("weight"))
    two = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("innovation"), (F.col("p_size") / 10).alias("weight"))
    return rounded(L.genome_distance(one, two), "distance")


@query("species_cull", "SELECT c_custkey, round(c_acctbal / n, 6) AS adjusted FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE n <= 2 OR r <= greatest(2, floor(n * 0.2))")
def species_cull(spark, sf_dir):
    rows = L.adjusted_fitness(read(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    return L.culled(rows, "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", r6("adjusted").alias("adjusted"))


@query("gradient_diagnostics", "SELECT event_type AS layer, round(avg(value), 6) AS mean_norm, max(value) AS max_norm, count(*) FILTER (value < 5) AS n_vanishing, count(*) FILTER (value > 100) AS n_exploding FROM events GROUP BY 1")
def gradient_diagnostics(spark, sf_dir):
    steps = read(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.col("value").alias("norm"), F.col("value").alias("mean_abs"))
    return rounded(L.gradient_diagnostics(steps, vanish=5.0, explode=100.0), "mean_norm")


@query("experiment_summary", "SELECT user_id AS exp_id, event_type AS metric, arg_max(value, event_id) AS last, max(value) AS best, round(avg(value), 6) AS mean, count(*) AS steps FROM events GROUP BY 1, 2")
def experiment_summary(spark, sf_dir):
    from ..sources.tracker import summary

    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("exp_id"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")
    return rounded(summary(rows), "mean")


def clips(spark, sf_dir):
    """Embeddings as frames of clips of fifty."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 50).alias("clip"), (F.col("vec_id") % 50).alias("t"), F.col("embedding").cast("array<double>").alias("frame"))


CLIPS = "(SELECT vec_id // 50 AS clip, vec_id % 50 AS t, list_transform(embedding, lambda x: x::DOUBLE) AS frame FROM embeddings)"


@query(
    "temporal_coherence",
    f"WITH n AS (SELECT clip, t, unnest(range(1, 65)) AS i, unnest(frame) AS x FROM {CLIPS}), v AS (SELECT clip, t, var_pop(x) OVER w AS v, count(*) OVER w AS k FROM n WINDOW w AS (PARTITION BY clip, i ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), m AS (SELECT clip, t, CASE WHEN any_value(k) = 7 THEN avg(v) END AS m FROM v GROUP BY 1, 2) SELECT clip, t, round(coalesce(m, first_value(m IGNORE NULLS) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(m IGNORE NULLS) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS coherence FROM m",
)
def temporal_coherence(spark, sf_dir):
    return rounded(S.temporal_coherence(clips(spark, sf_dir), "clip", "t", "frame").select("clip", "t", "coherence"), "coherence")


DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query("temporal_dropout", f"SELECT clip, t FROM {CLIPS} WHERE {DRAW.format(chr(39).join(['clip || ', ',', ' || t || ', ',0', '']))} >= {int(0.2 * 2**32)}")
def temporal_dropout(spark, sf_dir):
    return S.temporal_dropout(clips(spark, sf_dir), "clip", "t", 0.2).select("clip", "t")


@query("temporal_crop", f"SELECT clip, t FROM (SELECT clip, t, {DRAW.format(chr(39).join(['clip || ', ',0', '']))} % greatest(1, count(*) OVER (PARTITION BY clip) - 9) AS s FROM {CLIPS}) WHERE t >= s AND t < s + 10")
def temporal_crop(spark, sf_dir):
    return S.temporal_crop(clips(spark, sf_dir), "clip", "t", 10).select("clip", "t")


@query(
    "exponential_mean",
    "WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) SELECT a.event_id, round(sum(b.value / 7 * pow(6 / 7.0, a.t - b.t)), 6) AS mean FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t GROUP BY 1",
)
def exponential_mean(spark, sf_dir):
    return rounded(S.exponential_mean(events(spark, sf_dir), "user_id", "t", "value", 1 / 7, chunk=16).select("event_id", "mean"), "mean")


QUERIES, ORACLE_SQL = query.queries, query.sql
